import itertools
import zlib

import numpy as np
import oracle

from seriesloom.llm import quality


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(0)
    counts = np.array([3, 1, 5])
    x = rng.normal(size=(9, quality.WIDTH))
    crf = quality.Crf(rng.normal(size=quality.WIDTH) / 5, rng.normal(size=(2, 2)))
    p, steps, logz = crf.marginals(x @ crf.weights, counts)
    want_p, want_steps, want_logz, at = [], np.zeros((2, 2)), 0.0, 0
    for n in counts:
        weights, states = [], list(itertools.product((0, 1), repeat=int(n)))
        for s in states:
            e = sum(x[at + i] @ crf.weights * s[i] for i in range(n)) + sum(crf.moves[a, b] for a, b in zip(s, s[1:], strict=False))
            weights.append(np.exp(e))
        z = sum(weights)
        want_logz += np.log(z)
        for i in range(n):
            want_p.append(sum(w for w, s in zip(weights, states, strict=True) if s[i]) / z)
        for w, s in zip(weights, states, strict=True):
            for a, b in zip(s, s[1:], strict=False):
                want_steps[a, b] += w / z
        at += n
    assert np.allclose(p, want_p) and np.allclose(steps, want_steps) and np.isclose(logz, want_logz)


def direct_score(crf, text):
    """The score from whole features and messages in plain numbers, line by line."""
    own, size, counts = quality.line_features([text])
    good = quality.with_neighbours(own, counts) @ crf.weights
    n, m = len(good), np.exp(crf.moves)
    ahead, back = np.ones((n, 2)), np.ones((n, 2))
    for i in range(n):
        came = ahead[i - 1] @ m if i else np.ones(2)
        ahead[i] = came * [1, np.exp(good[i])]
        ahead[i] /= ahead[i].sum()
    for i in range(n - 2, -1, -1):
        back[i] = m @ (back[i + 1] * [1, np.exp(good[i + 1])])
        back[i] /= back[i].sum()
    both = ahead * back
    p = both[:, 1] / both.sum(axis=1)
    w = size + 1e-9
    return float((w * p).sum() / w.sum())


def test_scores_of_all_documents_equal_brute_force(spark):
    docs, labels = (spark.read.parquet(f"{oracle.SF}/{t}.parquet") for t in ("documents", "labels"))
    crf = quality.train(docs, labels)
    got = quality.op9(spark, oracle.SF).collect()
    texts = dict(oracle.duck("SELECT doc_id, coalesce(text, '') FROM documents")[1])
    assert len(got) == len(texts)
    for r in got:
        assert abs(r["score"] - direct_score(crf, texts[r["doc_id"]])) < 1e-6 and r["predicted"] == (r["score"] >= 0.5)


def test_good_and_bad_parts_of_spliced_documents_are_told_apart(spark):
    """Of held-out documents: clean ones and the junk of bad ones, laid end to end."""
    docs, labels = (spark.read.parquet(f"{oracle.SF}/{t}.parquet") for t in ("documents", "labels"))
    crf = quality.train(docs, labels)
    _, rows = oracle.duck("SELECT doc_id, quality, text FROM labels JOIN documents USING (doc_id) WHERE text <> '' ORDER BY doc_id")
    rows = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 3 == 1]
    good = [t for _, y, t in rows if y == 1 and t.count("\n") >= 2]
    bad = [t for _, y, t in rows if y == 0]
    right = total = mixed = 0
    for k, (a, b) in enumerate(zip(good * 3, bad * 3, strict=False)):
        a, b = "\n".join(a.split("\n")[:6]), "\n".join([x for x in b.split("\n") if quality_of(x) < 0.5][:4])
        if not b:
            continue
        text = f"{a}\n{b}" if k % 2 else f"{b}\n{a}"
        p, size, _ = crf.lines([text])
        n = a.count("\n") + 1
        want = np.array(([1] * n + [0] * (len(p) - n)) if k % 2 else ([0] * (len(p) - n) + [1] * n))
        keep = size > 20
        right += int(((p >= 0.5) == want)[keep].sum())
        total += int(keep.sum())
        mixed += 0 < int((p >= 0.5).sum()) < len(p)
    assert total > 100 and right / total > 0.95 and mixed > 0.8 * len(bad), (right, total, mixed, len(bad))
    parts = [crf.lines([t])[0] for t in bad]  # bad documents hold good lines of their own
    assert sum(p.max() - p.min() > 0.5 for p in parts if len(p) > 1) >= 0.2 * len(parts)


def quality_of(line):
    """How much a line is of plain words: what the tables' junk, of marks, bars, capitals and repetition, is not."""
    words = line.split()
    return sum(w.strip(".,").isalpha() and not w.isupper() for w in words) / max(len(words), 1)


def test_long_texts_are_cut_without_loss():
    line = "word " * 50_000
    for text in ("a\n" * 700_000, line, "x" * 600_000 + " end", f"{line}\nshort\n{line}", "é" * 400_000):
        parts = quality.pieces_of(text)
        assert all(p.endswith(b"\n") and len(p) <= quality.SLICE + 5 * quality.LINE for p in parts)
        strip = lambda b: b.translate(None, b"\n ")
        assert strip(b"".join(parts)) == strip(text.encode())
    crf = quality.Crf(np.random.default_rng(3).normal(size=quality.WIDTH) / 5, np.array([[1.0, -1.0], [-0.5, 0.5]]))
    texts = ["a b\n" * 30_000, "one\ntwo", "", line]
    assert np.allclose(crf.score(texts), [direct_score(crf, t) for t in texts], atol=1e-9)


def test_features_do_not_depend_on_the_batch():
    texts = ["One line.\nTwo two two two two two two two two.", "", "\n\n", "é ß 日本\r\nA### b###", "a | b | c"]
    own, size, counts = quality.line_features(texts)
    at = 0
    for t, n in zip(texts, counts, strict=True):
        alone, size1, n1 = quality.line_features([t])
        assert n1[0] == n == t.count("\n") + 1
        assert np.allclose(alone, own[at : at + n]) and np.allclose(size1, size[at : at + n])
        at += n


def test_held_out_accuracy(spark):
    got = {r["doc_id"]: r for r in quality.op9(spark, oracle.SF).collect()}
    _, rows = oracle.duck("SELECT doc_id, quality FROM labels")
    assert all(r["held_out"] == (zlib.crc32(str(d).encode()) % 3 == 1) for d, r in got.items())
    test = [(got[d]["predicted"], y) for d, y in rows if got[d]["held_out"]]
    assert len(test) > 100 and sum(p == y for p, y in test) / len(test) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert len(got) == len(oracle.duck("SELECT doc_id FROM documents")[1])


def test_odd_inputs(spark):
    docs = spark.createDataFrame([(1, "Good text here."), (None, None), (2, ""), (2, ""), (3, "x " * 100_000)], "doc_id bigint, text string").withColumn("score", quality.F.lit(3))
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (7, None)], "doc_id bigint, quality int")
    got = quality.accepted(docs, quality.train(docs, labels), threshold=0)
    assert got.columns == docs.columns and got.count() == 5
    untrained = quality.train(docs, labels.limit(0))
    assert {r["__score"] for r in quality.scored(docs, untrained).collect()} == {0.5}
    assert quality.scored(docs.limit(0), untrained).count() == 0
