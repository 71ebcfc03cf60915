"""Hierarchical multi-length packing into windows of several context sizes.

A document's tokens first fill whole windows of the longest tier; its tail goes to the smallest tier that holds it.
From the longest tier down, every tail opens a window of its tier, and the gap behind it is filled from shorter tiers, the
longest tail that fits first, and then with a cut of one that does not, so windows are full to the last token.
The shortest tier's tails are laid end to end. Windows of a tier are counted by scan partition, and prefix sums over those counts
number them across all partitions; every ``step_tokens`` of them make a step group, so all groups but the last of a tier are full,
however many partitions there are.

Documents are packed in groups of at most ``group_tokens`` tokens and ``group_docs`` documents (which matters for empty and very
short ones), in the order of their scan; a group is bounded memory for one task, and packing needs no shuffle. Only the last window of a group can be short. A retried task reads the same rows and
makes the same windows. A very long text is encoded whole, as ids must not depend on cuts; one of more tokens than that is a group of
its own, and takes about 80 bytes a token in its task.

Defined results: null text is empty; an empty document is its end token alone; repeated rows, null doc_ids and ties are
documents like others; an empty table gives no rows; other columns are not carried.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seriesloom.llm.common import text_of, trim
from seriesloom.plans.scratch import Scratch

#: Context sizes, each a power of two.
TIERS = (1024, 512, 256, 128)
#: Rows of one scan partition stay below this many sequences.
STRIDE = 1 << 33
SCHEMA = "doc_id bigint, start bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint, tier int, nth bigint"
#: Rows of the table of window counts (one for each scan partition and tier) up to which it is broadcast.
BROADCAST_ROWS = 100_000

_encoders: dict = {}


def encoder(path: str):
    """A function from texts to lists of ids, as the tokenizers library gives them for the file at ``path``.

    Byte-level BPE whose ids are its merge ranks runs on tiktoken's merge loop, which is faster; other kinds of
    file, and texts with a special token's string, run on the library itself.
    """
    if path in _encoders:
        return _encoders[path]
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path)
    plain = lambda texts: [e.ids for e in own.encode_batch(texts, add_special_tokens=False)]
    encode = plain
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    byte_level = spec["model"]["type"] == "BPE" and (spec.get("pre_tokenizer") or {}).get("type") == "ByteLevel" and not spec.get("normalizer")
    if byte_level and not spec["pre_tokenizer"].get("add_prefix_space"):
        import tiktoken
        from public_tokenizers import PATTERN

        special = [t["content"] for t in spec["added_tokens"]]
        spell = _byte_spelling()
        ranks = {bytes(spell[c] for c in w): i for w, i in spec["model"]["vocab"].items() if w not in special}
        fast = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        probe = ["It's  a\ttest, naïve—ßü 12345\n\n  x é€😀!", "", " a  b ", "aaaaaaaaaaaa'll\r\n"]
        if [fast.encode_ordinary(t) for t in probe] == plain(probe):
            encode = lambda texts: [plain([t])[0] if any(s in t for s in special) else fast.encode_ordinary(t) for t in texts]
    _encoders[path] = encode
    del spec
    trim()  # the file's text and tables were several times the encoder
    return encode


def _byte_spelling() -> dict[str, int]:
    """Byte-level BPE files write bytes as printable characters: those that print stand for themselves, the rest follow from 256."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def pack_group(lengths: list[int], tiers: tuple[int, ...] = TIERS) -> list[tuple[int, list[tuple[int, int, int]]]]:
    """Windows (tier, pieces) for documents of these lengths; a piece is (document, start, length)."""
    top, low = tiers[0], tiers[-1]
    windows: list[tuple[int, list[tuple[int, int, int]]]] = []
    tails: dict[int, list[tuple[int, int, int]]] = {t: [] for t in tiers}
    for d, n in enumerate(lengths):
        windows += [(top, [(d, at, top)]) for at in range(0, n - top + 1, top)]
        if left := n % top:
            tails[min(t for t in tiers if t >= left)].append((left, d, n - left))
    for t in tails:
        tails[t].sort(key=lambda x: (x[0], -x[1]))  # the longest are at the end

    def fill(window: list, room: int, below: tuple[int, ...]) -> int:
        while room:
            tier = next((s for s in below if tails[s] and tails[s][0][0] <= room), None)
            if tier is None:  # no tail fits whole: cut the shortest at hand
                tier = next((s for s in reversed(below) if tails[s]), None)
                if tier is None:
                    return room
                n, d, at = tails[tier].pop(0)
            else:
                fits = tails[tier]
                k = _last_at_most(fits, room)
                n, d, at = fits.pop(k)
            take = min(n, room)
            window.append((d, at, take))
            room -= take
            if n > take:
                rest = n - take
                home = tails[min(s for s in tiers if s >= rest)]
                home.insert(_last_at_most(home, rest) + 1, (rest, d, at + take))
        return 0

    for i, t in enumerate(tiers):
        while tails[t]:
            n, d, at = tails[t].pop()
            window = [(d, at, n)]
            windows.append((t, window))
            if fill(window, t - n, tiers[i + 1 :] or (low,)):
                # nothing shorter is left: whole windows of this tier go on with its own tails
                fill(window, t - sum(p[2] for p in window), (t,))
    return windows


def _last_at_most(rows: list[tuple[int, int, int]], n: int) -> int:
    lo, hi = 0, len(rows)
    while lo < hi:
        mid = (lo + hi) // 2
        lo, hi = (mid + 1, hi) if rows[mid][0] <= n else (lo, mid)
    return lo - 1


def pack(docs: DataFrame, tokenizer: str, tiers: tuple[int, ...] = TIERS, group_tokens: int = 1 << 21, group_docs: int = 1 << 17) -> DataFrame:
    """Pieces with their ids (little-endian unsigned 32-bit), their place in a sequence, its tier, and its number ``nth`` among the
    windows of that tier from the same scan partition.

    Sequences shorter than their tier are to be padded up to it. ``with_steps`` adds step groups to the written table.
    """
    fields = pa.schema([(n, {"bigint": pa.int64(), "binary": pa.binary(), "int": pa.int32()}[k]) for n, k in (c.split() for c in SCHEMA.split(", "))])

    def emit(group: list, base: int, counts: dict[int, int]) -> tuple[pa.RecordBatch, int]:
        rows = []
        windows = pack_group([len(ids) for _, ids in group], tiers)
        for w, (tier, pieces) in enumerate(windows):
            nth = counts[tier] = counts.get(tier, -1) + 1
            offset = 0
            for d, start, n in pieces:
                doc, ids = group[d]
                rows.append((doc, start, ids[start : start + n].tobytes(), len(ids), base + w, offset, tier, nth))
                offset += n
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), fields, strict=True)], schema=fields), base + len(windows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode = encoder(tokenizer)
        base = TaskContext.get().partitionId() * STRIDE
        group: list = []
        held, counts = 0, {}
        for batch in batches:
            ids_of, texts = batch.column(0).to_pylist(), batch.column(1)
            for lo in range(0, len(ids_of), 64):
                for doc, ids in zip(ids_of[lo : lo + 64], encode(texts[lo : lo + 64].to_pylist()), strict=True):
                    if group and (held + len(ids) + 1 > group_tokens or len(group) == group_docs):
                        out, base = emit(group, base, counts)
                        yield out
                        group, held = [], 0
                    group.append((doc, np.array([*ids, 0], "<u4")))
                    held += len(ids) + 1
        if group:
            yield emit(group, base, counts)[0]
        trim()

    return docs.select("doc_id", text_of().alias("text")).mapInArrow(run, SCHEMA)


def with_steps(pieces: DataFrame, scratch: Scratch, step_tokens: int = 1 << 14, tiers: tuple[int, ...] = TIERS) -> DataFrame:
    """``pieces``, a written table, with step_group: windows of one tier that fill ``step_tokens``, numbered over all partitions.

    Only the counts of windows by partition and tier are gathered, in a table; windows stay where they are. Groups are numbered from 0,
    the longest tier's first.
    """
    part = F.shiftright("sequence_id", STRIDE.bit_length() - 1)
    counts = scratch.keep(pieces.groupBy(part.alias("__part"), F.col("tier").alias("__tier")).agg((F.max("nth") + 1).alias("n")))
    before = Window.partitionBy("__tier").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.withColumn("__base", F.coalesce(F.sum("n").over(before), F.lit(0)))
    groups = counts.groupBy("__tier").agg(F.ceil(F.sum("n") * F.col("__tier") / F.lit(step_tokens)).alias("g"))  # one row a tier
    totals = {r["__tier"]: r["g"] for r in groups.collect()}
    first = F.lit(0).cast("long")
    for i, t in enumerate(tiers):
        first = F.when(F.col("tier") == t, F.lit(sum(totals.get(x, 0) for x in tiers[:i]))).otherwise(first)
    table = F.broadcast(bases) if counts.count() <= BROADCAST_ROWS else bases
    placed = pieces.join(table.drop("n"), (part == F.col("__part")) & (F.col("tier") == F.col("__tier")))
    step = first + F.floor((F.col("__base") + F.col("nth")) * F.col("tier") / F.lit(step_tokens))
    return placed.withColumn("step_group", step.cast("long")).drop("__part", "__tier", "__base", "nth")


def op6_of(docs: DataFrame, scratch: Scratch) -> DataFrame:
    from public_tokenizers import path

    pieces = pack(docs, path("byte_bpe_50k.json")).select(
        "doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("length"), F.crc32("ids").alias("ids_crc32"),
        "doc_tokens", "sequence_id", "offset", "tier", "nth",
    )
    return with_steps(scratch.keep(pieces), scratch)


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 1024 tokens."""
    return op6_of(spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark, "op6"))
