from collections import defaultdict

import oracle
from public_tokenizers import path
from tokenizers import Tokenizer

import corpus_pipeline
from seriesloom.llm import exact_dedup, mixing, near_dedup, quality
from seriesloom.plans.scratch import Scratch

SF = "/root/testdata/sf0.001"


def test_stages_against_their_operators(spark):
    """Each stage's rows follow from the digest query's operator on its own input, and the last packs all tokens."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").cache()
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality classifier", "exact dedup", "near dedup", "mixing", "packing"]
    crf = quality.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    good = corpus_pipeline.keep_good(spark, docs, SF)
    want = {r["doc_id"] for r in quality.scored(docs, crf).where("__score >= 0.5").collect()}
    assert good.columns == docs.columns and {r["doc_id"] for r in good.collect()} == want
    labels = dict(oracle.duck("SELECT doc_id, quality FROM labels", SF)[1])
    assert sum(labels.get(d) == 0 for d in want) <= 2 and sum(q == 1 and d not in want for d, q in labels.items()) <= 1

    good = Scratch(spark, "t").keep(good)
    exact = Scratch(spark, "t").keep(corpus_pipeline.drop_copies(spark, good, SF))
    best = {}
    for r in good.collect():
        key = "".join((r["text"] or "").translate({ord(c): None for c in " \t\n\x0b\x0c\r"}))
        best[key] = min(best.get(key, (1, 0)), (-len(r["text"] or ""), r["doc_id"]))
    assert {r["doc_id"] for r in exact.collect()} == {d for _, d in best.values()}
    assert exact.columns == docs.columns

    near = Scratch(spark, "t").keep(corpus_pipeline.drop_near_copies(spark, exact, SF))
    rows = near_dedup.NearDuplicates(exact, Scratch(spark, "t")).verdicts().collect()
    assert {r["doc_id"] for r in near.collect()} == {r["component_id"] for r in rows}

    mixed = Scratch(spark, "t").keep(corpus_pipeline.mix_sources(spark, near, SF))
    taken = mixing.Mix(near, Scratch(spark, "t")).taken().collect()
    assert mixed.columns == docs.columns and mixed.count() == sum(r["starts"] for r in taken)

    pieces = defaultdict(int)
    for r in corpus_pipeline.pack(spark, mixed, SF).collect():
        pieces[r["doc_id"]] += r["length"]
    t = Tokenizer.from_file(path("byte_bpe_50k.json"))
    want = defaultdict(int)
    for r in mixed.collect():
        want[r["doc_id"]] += len(t.encode(r["text"] or "", add_special_tokens=False).ids) + 1
    assert pieces == want
    assert exact_dedup.OP10_SQL and corpus_pipeline.ORACLE_SQL is None


def test_run_and_empty_tables(spark, tmp_path):
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 100 and "sequence_id" in out.columns
    for t in ("documents", "labels"):
        spark.read.parquet(f"{SF}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
