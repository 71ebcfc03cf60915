"""Document quality by a linear-chain conditional random field over lines.

Every line is good or bad. A line's state sees its own features and those of the lines before and after it; neighbouring
states are coupled by learned transitions. Forward-backward gives each line's probability of being good; their mean,
weighted by line length, is the document's score.

Labels belong to documents, not to lines, so in training the lines' states are latent: a good document's label is strong evidence
that a line of it is good, a bad one's is weak evidence that a line is bad, for bad documents hold good lines too. The fit raises
the likelihood of that evidence, summed over all states (expected features given the evidence, less those without it): first from each
line's own features, by which good lines of bad documents are found, as they look like those of good ones; then for the whole
chain, with what the first step says of a line added to the evidence. So the chain learns where states change, and does not just
carry one state through a document.

Features count classes of bytes and words; label, language, source and id are not among them. All sums run
over flat arrays of a block's bytes, and line by line, so no step loops over characters. A line of more than ``LINE`` bytes is cut
into several at its white space. Texts go block by block (``SLICE`` bytes), and a line leaves behind only a few numbers, so a
very long text costs about its own size and 100 bytes a line.

The model is fitted on a bounded sample of labelled rows: ``sample`` documents, the first by a hash of the id, and of each at most
``lines`` consecutive lines, from a place that the hash picks. Scoring covers every whole text.

Defined results: null counts as empty; an empty text is one empty line and gets what the model gives it; with no labelled
rows at all every score is 0.5; a score of just 0.5 counts as good; repeated rows get equal scores; an empty table gives no rows; extra
columns pass through ``scored`` and ``accepted``, those of the result's name being replaced.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesloom.llm.common import text_of, trim

#: Byte classes: space, lower, upper, digit, sentence marks, other ASCII marks, other.
CLASSES = 7
OWN = 15  # features of one line
WIDTH = 3 * OWN + 3
#: Most bytes of texts whose features are computed at once.
SLICE = 1 << 19
#: Most bytes of a line, about.
LINE = 1 << 16
GAP = re.compile(rb"[ \t\x0b\x0c\r]")
#: How far a document's label moves a line's log-odds: that of a good document, that of a bad one.
EVIDENCE = (4.0, -0.6)


def _classes() -> np.ndarray:
    out = np.full(256, 6, np.uint8)
    for b in range(128):
        c = chr(b)
        out[b] = 0 if c in " \t\x0b\x0c\r" else 1 if c.islower() else 2 if c.isupper() else 3 if c.isdigit() else 4 if c in ".,;:?!'\"()-" else 5 if b >= 33 else 0
    return out


_CLASS = _classes()


def _sum_by(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of consecutive parts; every part must hold an item."""
    return np.add.reduceat(values, starts, dtype=np.float64) if len(values) else np.zeros(len(starts))


def pieces_of(text: str) -> list[bytes]:
    """A text's bytes as parts of about ``SLICE``, whole lines each; lines of more than ``LINE`` bytes are cut at white space, and
    where there is none for long, anywhere."""
    raw = bytearray(text.encode("utf-8", "surrogatepass"))
    raw += b"\n"
    if len(raw) <= LINE:
        return [bytes(raw)]
    ends = np.flatnonzero(np.frombuffer(raw, np.uint8) == 10)
    starts = np.concatenate([[0], ends[:-1] + 1])
    within = []  # cuts inside words
    for k in np.flatnonzero(ends - starts > LINE).tolist():
        at, end = int(starts[k]), int(ends[k])
        while end - at > LINE:
            stop = min(end, at + 4 * LINE)
            gap = GAP.search(raw, at + LINE, stop)
            if gap:
                raw[gap.start()] = 10
                at = gap.end()
            elif stop < end:
                within.append(stop)
                at = stop
            else:
                break
    if within:
        raw = bytearray(b"\n".join(raw[a:b] for a, b in zip([0, *within], [*within, len(raw)], strict=True)))
    ends = np.flatnonzero(np.frombuffer(raw, np.uint8) == 10)
    out, lo = [], 0
    while lo < len(raw):
        hi = int(ends[max(np.searchsorted(ends, lo + SLICE, "right") - 1, np.searchsorted(ends, lo))]) + 1
        out.append(bytes(raw[lo:hi]))
        lo = hi
    return out


def line_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features of all lines, bytes of each line, lines of each text)."""
    parts = [(i, p) for i, t in enumerate(texts) for p in pieces_of(t)]
    counts = np.bincount([i for i, _ in parts], weights=[p.count(b"\n") for _, p in parts], minlength=len(texts)).astype(np.int64)
    own, size = _features(b"".join(p for _, p in parts))
    return own, size, counts


def _features(block: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(features, bytes) of the lines of a block that ends with a line's end."""
    data = np.frombuffer(block, np.uint8)
    ends = np.flatnonzero(data == 10)
    starts = np.concatenate([[0], ends[:-1] + 1])
    size = (ends - starts).astype(np.float64)
    n = np.maximum(size, 1)
    kinds = _CLASS[data]
    kinds[ends] = 0
    share = np.stack([_sum_by(kinds == k, starts) / n for k in range(1, CLASSES)], 1)

    solid = kinds != 0
    before = np.concatenate([[False], solid[:-1]])
    first = np.flatnonzero(solid & ~before)
    own = np.zeros((len(ends), OWN))
    own[:, :6] = share
    own[:, 6] = np.log1p(size) / 8
    own[:, 7] = size == 0
    if len(first):
        last = np.flatnonzero(solid & ~np.concatenate([solid[1:], [False]])) + 1
        length = last - first
        line = np.searchsorted(ends, first)
        held = np.bincount(line, minlength=len(ends))
        some = np.maximum(held, 1)
        per = lambda flags: np.bincount(line, weights=flags, minlength=len(ends)) / some
        at = np.arange(len(data)) - np.repeat(np.concatenate([[0], first]), np.diff(np.concatenate([[0], first, [len(data)]])))
        with np.errstate(over="ignore"):
            mixed = (data.astype(np.uint64) + np.uint64(1)) * (at.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) | np.uint64(1))
            word = np.add.reduceat(np.where(solid, mixed * (mixed >> np.uint64(29) | np.uint64(1)), np.uint64(0)), first)
        same_line = line[1:] == line[:-1]
        again = np.concatenate([[False], (word[1:] == word[:-1]) & same_line])
        order = np.lexsort((word, line))
        new = np.ones(len(order), bool)
        new[1:] = (word[order][1:] != word[order][:-1]) | (line[order][1:] != line[order][:-1])
        distinct = np.bincount(line[order], weights=new, minlength=len(ends)) / some
        end_kind = kinds[last - 1]
        tail = data[last - 1]
        before_tail = data[np.maximum(last - 2, 0)]
        own[:, 8] = per(again)
        own[:, 9] = np.where(held >= 8, 1 - distinct, 0)
        own[:, 10] = np.minimum(per(length) / 20, 2)
        own[:, 11] = per(end_kind == 5)
        own[:, 12] = per((length > 1) & (tail == before_tail) & (end_kind >= 4) & (end_kind <= 5))
        own[:, 13] = per((length == 1) & (end_kind == 5))
        own[:, 14] = np.log1p(held) / 6
    return own, size


def with_neighbours(own: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A row for each line: its features, those of the lines before and after it, whether it is first or last, and 1."""
    x = np.zeros((len(own), WIDTH))
    upto = np.cumsum(counts)
    first, last = np.zeros(len(own), bool), np.zeros(len(own), bool)
    first[upto - counts], last[upto - 1] = True, True
    x[:, :OWN] = own
    x[1:, OWN : 2 * OWN] = own[:-1]
    x[first, OWN : 2 * OWN] = 0
    x[:-1, 2 * OWN : 3 * OWN] = own[1:]
    x[last, 2 * OWN : 3 * OWN] = 0
    x[:, -3], x[:, -2], x[:, -1] = first, last, 1
    return x


@dataclass
class Crf:
    """Two states, 0 bad and 1 good: ``weights`` score good over bad, ``moves[a, b]`` the step from a to b."""

    weights: np.ndarray
    moves: np.ndarray

    def marginals(self, good: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """(probability of good by line, expected steps summed, log of the partition function summed) from lines' scores of good over bad."""
        order = np.argsort(-counts, kind="stable")
        start = (np.cumsum(counts) - counts)[order]
        n = counts[order]
        ahead = np.zeros((len(good), 2))  # logs of forward messages; the backward ones start as 0
        back = np.zeros((len(good), 2))
        alive = [int(np.searchsorted(-n, -t, "left")) for t in range(int(n[1]) if len(n) > 1 else 0)]  # texts with more than t lines
        alive = [k for k in alive if k > 1]  # beyond, the longest text is alone
        for t, k in enumerate(alive):
            i = start[:k] + t
            if t:
                ahead[i] = np.logaddexp(ahead[i - 1, :1] + self.moves[0], ahead[i - 1, 1:] + self.moves[1])
            ahead[i, 1] += good[i]
        if len(n):
            self._alone(good, ahead, back, int(start[0]), int(start[0] + n[0]), len(alive))
        for t in range(len(alive) - 2, -1, -1):
            k = alive[t + 1]
            i = start[:k] + t
            nxt = back[i + 1] + np.stack([np.zeros(k), good[i + 1]], 1)
            back[i] = np.logaddexp(nxt[:, :1] + self.moves[:, 0], nxt[:, 1:] + self.moves[:, 1])
        both = ahead + back
        logz = np.logaddexp(both[:, 0], both[:, 1])
        p = np.exp(both[:, 1] - logz)
        inner = np.ones(len(good), bool)
        inner[start] = False
        i = np.flatnonzero(inner)
        steps = np.zeros((2, 2))
        for a in (0, 1):
            for b in (0, 1):
                steps[a, b] = np.exp(ahead[i - 1, a] + self.moves[a, b] + b * good[i] + back[i, b] - logz[i]).sum()
        return p, steps, float(logz[start].sum())

    def _alone(self, good: np.ndarray, ahead: np.ndarray, back: np.ndarray, lo: int, hi: int, done: int) -> None:
        """Messages of the longest text from its line ``done`` on, number by number; also the backward ones up to there."""
        (m00, m01), (m10, m11) = self.moves.tolist()

        def add(x: float, y: float) -> float:
            return max(x, y) + math.log1p(math.exp(-abs(x - y)))

        for i in range(lo + done, hi):
            if i == lo:
                x, y = 0.0, float(good[i])
            else:
                u, v = ahead[i - 1].tolist()
                x, y = add(u + m00, v + m10), add(u + m01, v + m11) + float(good[i])
            ahead[i, 0], ahead[i, 1] = x, y
        x = y = 0.0
        for i in range(hi - 2, lo + max(done, 1) - 2, -1):
            y += float(good[i + 1])
            x, y = add(m00 + x, m01 + y), add(m10 + x, m11 + y)
            back[i, 0], back[i, 1] = x, y

    @classmethod
    def fit(cls, x: np.ndarray, counts: np.ndarray, labels: np.ndarray, evidence: tuple[float, float] = EVIDENCE, **how: float) -> Crf:
        """The model of latent lines, in two steps: what lines alone tell, then the chain given that and the labels."""
        if len(labels) == 0:
            return cls(np.zeros(WIDTH), np.zeros((2, 2)))
        y = np.repeat(labels, counts)
        told = np.where(y == 1, *evidence)
        alone = x.copy()
        alone[:, OWN : 3 * OWN + 2] = 0
        by_line = alone @ cls._raised(alone, np.ones(len(y), np.int64), y, told, **how).weights
        return cls._raised(x, counts, labels, told + np.clip(by_line, -evidence[0], evidence[0]), **how)

    @classmethod
    def _raised(cls, x: np.ndarray, counts: np.ndarray, labels: np.ndarray, told: np.ndarray, rounds: int = 150, rate: float = 0.15, decay: float = 1e-4) -> Crf:
        """Raises the likelihood of the evidence ``told`` (log-odds of good by line) by Adam. Both labels weigh alike, whatever their number."""
        y = np.repeat(labels, counts)
        parts = [(0.5 / (labels == k).sum(), x[y == k], counts[labels == k], told[y == k]) for k in (0, 1) if (labels == k).any()]
        theta = np.zeros(WIDTH + 4)
        m, v = np.zeros_like(theta), np.zeros_like(theta)
        for r in range(1, rounds + 1):
            crf = cls(theta[:WIDTH], theta[WIDTH:].reshape(2, 2))
            g = -decay * theta
            for weight, rows, n, hint in parts:
                good = rows @ crf.weights
                known, seen, _ = crf.marginals(good + hint, n)
                p, steps, _ = crf.marginals(good, n)
                g = g + weight * np.concatenate([(known - p) @ rows, (seen - steps).ravel()])
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            theta = theta + rate * (m / (1 - 0.9**r)) / (np.sqrt(v / (1 - 0.99**r)) + 1e-8)
        return cls(theta[:WIDTH], theta[WIDTH:].reshape(2, 2))

    def lines(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(probability of good, bytes) of every line, and lines of each text."""
        w = self.weights
        sizes, scores, counts = [], [], np.zeros(len(texts), np.int64)
        pending: list[tuple[int, bytes]] = []

        def flush() -> None:
            if pending:
                own, size = _features(b"".join(p for _, p in pending))
                # what a line gives itself, the line after it and the line before it
                scores.append(own @ np.stack([w[:OWN], w[OWN : 2 * OWN], w[2 * OWN : 3 * OWN]], 1))
                sizes.append(size)
                pending.clear()

        held = 0
        for i, text in enumerate(texts):
            for part in pieces_of(text):
                if held + len(part) > SLICE:
                    flush()
                    held = 0
                pending.append((i, part))
                counts[i] += part.count(b"\n")
                held += len(part)
        flush()
        if not sizes:
            return np.zeros(0), np.zeros(0), counts
        share, size = np.concatenate(scores), np.concatenate(sizes)
        upto = np.cumsum(counts)
        first, last = np.zeros(len(size), bool), np.zeros(len(size), bool)
        first[upto - counts], last[upto - 1] = True, True
        good = share[:, 0] + w[-1] + np.where(first, w[-3], 0) + np.where(last, w[-2], 0)
        good[1:] += np.where(first[1:], 0, share[:-1, 1])
        good[:-1] += np.where(last[:-1], 0, share[1:, 2])
        return self.marginals(good, counts)[0], size, counts

    def score(self, texts: list[str]) -> np.ndarray:
        """Length-weighted mean of the lines' probabilities, for each text."""
        out, lo = [], 0
        while lo < len(texts):
            hi, held = lo, 0
            while hi < len(texts) and (hi == lo or held + 4 * len(texts[hi]) <= SLICE):
                held += 4 * len(texts[hi])
                hi += 1
            p, size, counts = self.lines(texts[lo:hi])
            at = np.cumsum(counts) - counts
            w = size + 1e-9
            out.append(np.add.reduceat(w * p, at) / np.add.reduceat(w, at))
            lo = hi
        return np.clip(np.concatenate(out).round(12), 0, 1) if out else np.zeros(0)  # sums of many lines differ in the last digits


def held_out(doc_id: str = "doc_id"):
    """Rows whose crc32 of the id as text leaves 1 when divided by 3; these are never learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = 4000, lines: int = 64) -> Crf:
    """Fits on at most ``sample`` labelled rows, the first by a hash of their id, and at most ``lines`` consecutive lines of each.

    What reaches the driver is bounded by both: 8 * OWN bytes a line, 31 MB with the defaults.
    """
    usable = labels.where("doc_id is not null and quality in (0, 1)").where(~held_out())
    chosen = usable.groupBy("doc_id").agg(F.max("quality").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select("doc_id", text_of().alias("text")).join(F.broadcast(chosen), "doc_id")  # at most ``sample`` pairs of numbers

    def featured(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for doc_id, y, text in zip(pdf["doc_id"], pdf["y"], pdf["text"], strict=True):
                own = np.concatenate([_features(p)[0] for p in pieces_of(text)])
                at = zlib.crc32(str(doc_id).encode()) % max(1, len(own) - lines + 1)
                own = own[at : at + lines]
                yield pd.DataFrame({"doc_id": [doc_id], "y": [int(y)], "lines": [len(own)], "own": [own.astype("<f8").tobytes()]})
        trim()

    # rows that share an id and a label count once, so the bound holds
    got = rows.mapInPandas(featured, "doc_id bigint, y int, lines int, own binary").groupBy("doc_id").agg(F.min(F.struct("y", "lines", "own")).alias("r")).select("doc_id", "r.*")
    got = sorted(got.collect(), key=lambda r: r["doc_id"])
    if not got:
        return Crf(np.zeros(WIDTH), np.zeros((2, 2)))
    counts = np.array([r["lines"] for r in got])
    own = np.concatenate([np.frombuffer(r["own"], "<f8").reshape(-1, OWN) for r in got])
    return Crf.fit(with_neighbours(own, counts), counts, np.array([r["y"] for r in got]))


def scored(docs: DataFrame, crf: Crf, column: str = "__score") -> DataFrame:
    """``docs`` with the score of each whole text."""

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series(crf.score(batch.tolist()))
        trim()

    return docs.withColumn(column, score(text_of()))


def accepted(docs: DataFrame, crf: Crf, threshold: float = 0.5) -> DataFrame:
    """Rows of ``docs`` whose score reaches the threshold."""
    return scored(docs, crf).where(F.col("__score") >= threshold).select(*docs.columns)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of every document."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    out = scored(docs.select("doc_id", "text"), train(docs, labels), "score")
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
