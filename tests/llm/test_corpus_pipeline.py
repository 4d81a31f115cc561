import re

import corpus_pipeline
from tests.llm.test_jaccard_join import brute
from tidemark.llm.queries import read

D = "/root/testdata/sf0.01"


def flat(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def test_stages_against_brute_force(spark):
    """Each stage on its own input: what goes must go, and nothing else."""
    docs = read(spark, D, "documents")
    texts = {r.doc_id: r.text for r in docs.collect()}
    columns, now = docs.columns, docs
    after = []
    for name, stage in corpus_pipeline.STAGES[:4]:
        now = stage(spark, now, D).cache()
        assert now.columns == columns
        after.append({r.doc_id for r in now.select("doc_id").collect()})
    assert after[0] == {i for i, t in texts.items() if any(c.isalpha() for c in t or "")}
    least = {}
    for i in sorted(after[0]):
        least.setdefault(flat(texts[i]), i)
    assert after[1] == set(least.values())
    assert after[2] == {i for i, _, c in brute([(i, texts[i]) for i in sorted(after[1])], 80, 5) if i == c}
    items = [flat(r.text) for r in read(spark, D, "benchmark").collect()]
    planted = {i for i in after[2] if any(x in flat(texts[i]) for x in items)}
    assert planted <= after[2] - after[3] and len(after[2] - after[3]) <= len(planted) + 5
    pieces = corpus_pipeline.STAGES[4][1](spark, now, D)
    assert {r.doc_id for r in pieces.select("doc_id").collect()} == after[3]


def test_run_and_odd_rows(spark, odd, repeated, tmp_path):
    read(spark, D, "benchmark").write.parquet(f"{tmp_path}/benchmark.parquet")
    for k, docs in enumerate([odd, repeated.selectExpr("*", "'en' AS lang"), odd.limit(0)]):
        docs.write.parquet(f"{tmp_path}/{k}/documents.parquet")
        read(spark, D, "benchmark").write.parquet(f"{tmp_path}/{k}/benchmark.parquet")
        got = {r.doc_id for r in corpus_pipeline.run(spark, f"{tmp_path}/{k}").collect()}
        assert got == [{1, 6, 7, 9, 11}, {1}, set()][k]


def test_batches_of_texts_are_small(spark):
    """Larger batches are made smaller before the first stage, smaller ones stay."""
    before = spark.conf.get(corpus_pipeline.BATCH)
    try:
        for given, then in (("10000", "1000"), ("0", "1000"), ("50", "50")):
            spark.conf.set(corpus_pipeline.BATCH, given)
            corpus_pipeline._small_batches(spark)
            assert spark.conf.get(corpus_pipeline.BATCH) == then
    finally:
        spark.conf.set(corpus_pipeline.BATCH, before)
