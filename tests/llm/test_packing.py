import random
import zlib
from collections import defaultdict

import numpy as np
import oracle
from public_tokenizers import path
from tokenizers import Tokenizer

from seriesloom.llm import packing
from seriesloom.plans.scratch import Scratch


def check_windows(lengths, windows):
    seen = defaultdict(list)
    short = 0
    for tier, pieces in windows:
        used = sum(n for *_, n in pieces)
        assert 0 < used <= tier
        short += used < tier
        for d, at, n in pieces:
            assert n > 0
            seen[d].append((at, n))
    assert short <= 1
    for d, n in enumerate(lengths):
        at = 0
        for start, k in sorted(seen[d]):
            assert start == at
            at += k
        assert at == n


def test_pack_group_covers_every_token_and_leaves_one_short_window():
    rng = random.Random(1)
    for lengths in ([1], [1024], [1023, 1], [5] * 500, [700] * 50, [129] * 9, [1025, 3000, 20_000, 7]):
        check_windows(lengths, packing.pack_group(lengths))
    for _ in range(60):
        lengths = [int(rng.lognormvariate(5.5, 1.4)) + 1 for _ in range(rng.randrange(1, 300))]
        check_windows(lengths, packing.pack_group(lengths))


def test_short_tiers_are_used():
    tiers = {t for t, _ in packing.pack_group([900, 400, 200, 100, 100, 90, 250, 130] * 40)}
    assert len(tiers) > 1


def test_encoder_gives_the_library_ids():
    t = Tokenizer.from_file(path("byte_bpe_50k.json"))
    texts = ["", "plain text", "a <|endoftext|> b", "tabs\t\t\n é ß 😀  x", "x" * 5000, "don't  stop   now 12 34", "\x00\x01 \xa0\xad"]
    assert packing.encoder(path("byte_bpe_50k.json"))(texts) == [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def test_round_trip(spark):
    rows = [(1, "one two three"), (None, None), (3, ""), (3, ""), (4, "long text here " * 3000), (5, "same"), (5, "same")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("offset", packing.F.lit("clash"))
    got = packing.pack(docs.coalesce(1), path("byte_bpe_50k.json")).collect()
    sequences = defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append(r)
    for rs in sequences.values():
        at = 0
        for r in sorted(rs, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += len(r["ids"]) // 4
        assert at <= 1024
    t = Tokenizer.from_file(path("byte_bpe_50k.json"))
    ids = b"".join(bytes(r["ids"]) for r in sorted((r for r in got if r["doc_id"] == 4), key=lambda r: r["start"]))
    assert ids == np.array([*t.encode("long text here " * 3000, add_special_tokens=False).ids, 0], "<u4").tobytes()
    assert sum(len(r["ids"]) // 4 for r in got if r["doc_id"] == 3) == 2
    assert packing.pack(docs.limit(0), path("byte_bpe_50k.json")).count() == 0


def test_whole_table_against_brute_force(spark):
    t = Tokenizer.from_file(path("byte_bpe_50k.json"))
    _, rows = oracle.duck("SELECT doc_id, coalesce(text, '') FROM documents")
    want = {d: [*e.ids, 0] for (d, _), e in zip(rows, t.encode_batch([x for _, x in rows], add_special_tokens=False), strict=True)}
    got = packing.op6(spark, oracle.SF).collect()
    used = defaultdict(int)
    for r in got:
        ids = want[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["doc_tokens"] == len(want[r["doc_id"]])
        assert zlib.crc32(np.array(ids, "<u4").tobytes()) == r["ids_crc32"]
        used[r["sequence_id"]] += r["length"]
    total = sum(used.values())
    assert total == sum(map(len, want.values()))
    padding = sum(0 if n & (n - 1) == 0 else 1024 - n for n in used.values())
    assert padding < 0.01 * total


def test_groups_of_empty_documents_are_bounded(spark):
    docs = spark.range(5000).selectExpr("id AS doc_id", "'' AS text").coalesce(1)
    rows = packing.pack(docs, path("byte_bpe_50k.json"), group_docs=1000).collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(5000))
    places = {(r["sequence_id"], r["offset"]) for r in rows}
    assert len(places) == 5000
    by_sequence = defaultdict(set)
    for r in rows:
        by_sequence[r["sequence_id"]].add(r["doc_id"] // 1000)
    assert all(len(groups) == 1 for groups in by_sequence.values())


def test_step_groups_are_full_whatever_the_partitions(spark):
    docs = spark.read.parquet(f"{oracle.SF}/documents.parquet")
    many = docs.crossJoin(spark.range(8)).repartition(211)  # eight copies of a small table, to have enough tokens for many groups
    rows = packing.with_steps(Scratch(spark, "t").keep(packing.pack(many, path("byte_bpe_50k.json")).drop("ids")), Scratch(spark, "t")).select("sequence_id", "tier", "step_group").distinct().collect()
    tokens, tiers, parts = defaultdict(int), defaultdict(set), {r["sequence_id"] // packing.STRIDE for r in rows}
    assert len(rows) == len({r["sequence_id"] for r in rows}) and len(parts) == 211
    for r in rows:
        tokens[r["step_group"]] += r["tier"]
        tiers[r["step_group"]].add(r["tier"])
    assert sorted(tokens) == list(range(len(tokens))) and all(len(t) == 1 for t in tiers.values())
    short = [n for n in tokens.values() if n != 1 << 14]
    assert len(short) <= len(packing.TIERS) and len(tokens) - len(short) >= 0.98 * len(tokens) and max(tokens.values()) == 1 << 14
    empty = packing.with_steps(Scratch(spark, "t").keep(packing.pack(docs.limit(0), path("byte_bpe_50k.json"))), Scratch(spark, "t"))
    assert empty.count() == 0 and "step_group" in empty.columns


def test_both_encoders_agree_on_random_texts():
    """The faster loop is used only where it gives the library's ids; here on texts of all kinds of characters."""
    t = Tokenizer.from_file(path("byte_bpe_50k.json"))
    rng = random.Random(7)
    kinds = [" ", "  ", "\n", "\t", "'s", "'LL", "a", "The", "zz", "9", "1234", "é", "ß", "中文", "😀", "́", "​", "\xa0", "\x00", "_", "!?", "<|endoftext|>", "#", "İ", " ", "\U0001f468‍\U0001f469", "क्षि"]
    texts = ["".join(rng.choice(kinds) for _ in range(rng.randrange(40))) for _ in range(3000)]
    texts += ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0xA0, 0xD000), rng.randrange(0x10000, 0x20000)])) for _ in range(30)) for _ in range(1000)]
    assert packing.encoder(path("byte_bpe_50k.json"))(texts) == [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]
