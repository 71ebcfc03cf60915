import random
import re

import numpy as np
import oracle
import pytest

from seriesloom.llm import near_dedup as nd
from seriesloom.llm.components import components
from seriesloom.plans.scratch import Scratch


def brute(rows):
    """(n_shingles, component_id) of each row by comparing all pairs that share a shingle."""
    sets, at = [], {}
    for i, (_, t) in enumerate(rows):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        s = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
        sets.append(s)
        for x in s:
            at.setdefault(x, []).append(i)
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    seen = set()
    for ids in at.values():
        for a in ids:
            for b in ids:
                if a < b and (a, b) not in seen:
                    seen.add((a, b))
                    i = len(sets[a] & sets[b])
                    if 100 * i >= 75 * (len(sets[a]) + len(sets[b]) - i):
                        parent[find(a)] = find(b)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [(len(s), least.get(find(i))) for i, s in enumerate(sets)]


def solve(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = nd.NearDuplicates(docs, Scratch(spark, "t")).verdicts().collect()
    return sorted((r["doc_id"], r["n"], r["component_id"]) for r in got if r["doc_id"] is not None), len(got)


def noisy(words, rng, n):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"z{rng.randrange(10**6)}"
    return " ".join(out)


def test_components(spark):
    edges = [("a", "b"), ("b", "a"), ("c", "b"), ("d", "d"), ("e", "f"), (None, "g")] + [(f"p{i}", f"p{i + 1}") for i in range(40)] + [("hub", f"q{i}") for i in range(200)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a string, b string"), Scratch(spark, "t")).collect()}
    assert got["a"] == got["b"] == got["c"] != got["e"] == got["f"]
    assert len({got[f"p{i}"] for i in range(41)}) == 1 and len({got[f"q{i}"] for i in range(200)} | {got["hub"]}) == 1
    assert got["d"] == "d" and got["g"] == "g" and len(set(got.values())) == 6
    assert components(spark.createDataFrame([], "a string, b string"), Scratch(spark, "t")).count() == 0


def test_odd_sketches_estimate_high_similarities():
    rng = np.random.default_rng(5)
    for j in (0.75, 0.9, 0.98):
        n, errors = 1000, []
        for _ in range(20):
            common = int(2 * n * j / (1 + j))
            x = rng.integers(0, 1 << 63, 2 * n, dtype=np.uint64)
            a, b = np.sort(x[:n]), np.sort(np.concatenate([x[:common], x[n : 2 * n - common]]))
            z = np.bitwise_count((nd.odd_sketch(nd.samples(a)) ^ nd.odd_sketch(nd.samples(b))).view(np.uint64)).sum()
            errors.append(1 + np.log(1 - 2 * z / nd.BITS) * nd.BITS / 4 / nd.SAMPLES - j)
        assert abs(np.mean(errors)) < 0.03 and np.max(np.abs(errors)) < 0.14


def test_very_long_texts_are_hashed_in_blocks(monkeypatch):
    rng = random.Random(2)
    texts = ["".join(rng.choice(["a", "B", "\u00e9", " ", "\t\n", "\x0b", "\xa0"]) for _ in range(n)) for n in (0, 1, 3, 9, 40, 300, 3000)] + [" ", "a" * 500, "one two three four", " x " * 4 + "y" * 100 + " z"]
    whole = [nd.shingles(t) for t in texts]
    for block in (1, 7, 64):
        monkeypatch.setattr(nd, "BLOCK", block)
        assert all((nd.shingles(t) == w).all() and len(nd.shingles(t)) == len(w) for t, w in zip(texts, whole, strict=True))


def test_many_large_buckets_need_no_broadcast(spark, monkeypatch):
    monkeypatch.setattr(nd, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(nd, "HOT", 4)
    base = [f"w{i}" for i in range(100)]
    rng = random.Random(1)
    rows = [(i, noisy(base, rng, 1)) for i in range(60)] + [(100 + i, f"own text number {i} of few words {i}") for i in range(20)]
    want = sorted((d, k, c) for (d, _), (k, c) in zip(rows, brute(rows), strict=True))
    assert solve(spark, rows)[0] == want


@pytest.mark.parametrize("seed", [0, 1])
def test_same_as_brute_force(spark, seed, monkeypatch):
    if seed:  # nearly all buckets count as large, and are dealt to several tasks
        monkeypatch.setattr(nd, "SMALL", 3)
        monkeypatch.setattr(nd, "HOT", 8)
    rng = random.Random(seed)
    rows = []
    for g in range(12):
        base = [f"w{g}x{rng.randrange(400)}" for _ in range(rng.choice([4, 12, 60, 300]))]
        for _ in range(rng.randrange(2, 14)):
            rows.append((len(rows), noisy(base, rng, rng.randrange(0, 2 + len(base) // 25))))
    star = [f"s{i}" for i in range(200)]
    for i in range(60):  # each is near the middle one only
        rows.append((len(rows), noisy(star, rng, 6 if i != 30 else 0)))
    cloud = [f"c{i}" for i in range(150)]
    for i in range(80):  # from near the middle to out of reach, with every similarity between them
        rows.append((len(rows), noisy(cloud, rng, i // 8)))
    passage = [f"p{i}" for i in range(60)]
    for i in range(90):  # a common passage alone makes no link
        rows.append((len(rows), " ".join(passage + [f"o{i}_{k}" for k in range(25)])))
    rows += [(len(rows), None), (len(rows) + 1, " \t\n"), (len(rows) + 2, "Two Words"), (len(rows) + 3, "two\x0bwords"), (len(rows) + 4, "É two"), (len(rows) + 5, "é two")]
    rows += [(7, rows[7][1]), (None, rows[7][1]), (None, "nobody else has this text at all")]
    want = brute(rows)
    got, n = solve(spark, rows)
    assert n == len(rows)
    want = sorted((d, k, c if k else d) for (d, _), (k, c) in zip(rows, want, strict=True) if d is not None)
    assert got == want


def test_one_of_each(spark):
    text = "a long enough text to be near itself and its copies in every way " * 3
    rows = [(3, text, "x", 1), (1, text + "end", "y", 2), (1, text + "end", "y", 2), (2, text.upper(), "z", 3), (None, text, "q", 9), (8, "", "e", 4), (9, None, "e", 5), (4, "alone here", "f", 6)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, cls string, n int")
    got = nd.one_of_each(docs, nd.NearDuplicates(docs, Scratch(spark, "t")))
    assert got.columns == docs.columns
    assert sorted((r["doc_id"], r["cls"]) for r in got.collect()) == [(1, "y"), (4, "f"), (8, "e"), (9, "e")]
    assert nd.one_of_each(docs.limit(0), nd.NearDuplicates(docs.limit(0), Scratch(spark, "t"))).count() == 0


def test_whole_table_against_brute_force(spark):
    _, rows = oracle.duck("SELECT doc_id, text FROM documents")
    want = sorted((d, n, c if n else d) for (d, _), (n, c) in zip(rows, brute(rows), strict=True))
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in nd.op4(spark, oracle.SF).collect())
    assert got == want


def test_same_as_sql(spark):
    oracle.assert_same(spark, nd.op4, nd.OP4_SQL)
