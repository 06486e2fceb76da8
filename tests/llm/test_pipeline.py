"""The pipeline's stages against brute force, and its contract."""
import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from siftwork.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables absent")
def test_stages_follow_their_operators(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("kept", F.lit(1)).withColumn("hits", F.lit(2))
    cols, before = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, SF).checkpoint()
        assert after.columns == cols
        if name == "secret_scans":
            assert after.count() == before.count()
            changed = after.select("doc_id", F.col("text").alias("new")).join(before, "doc_id").where("new <> text")
            assert changed.where("not contains(new, '[SECRET]')").count() == 0
        elif name == "quality_rules":
            want = queries.quality.judge(before, cleaned=True, keep=["doc_id"]).where(F.col("kept")).select("doc_id", "cleaned")
            assert after.select("doc_id", "text").exceptAll(want).count() == 0 and after.count() == want.count()
            assert after.where("n_chars <> length(text)").count() == 0
        else:
            assert after.exceptAll(before).count() == 0
        before = after
    out = corpus_pipeline.STAGES[-1][1](spark, before, SF)
    assert out.count() == before.count() and "ids" in out.columns


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables absent")
def test_run_keeps_what_each_query_keeps(spark):
    out = corpus_pipeline.run(spark, SF)
    good = queries.op8_quality(spark, SF).where("kept").select("doc_id")
    ids = {r[0] for r in out.select("doc_id").collect()}
    assert ids <= {r[0] for r in good.collect()}
    # groups and passages are those of the good documents' remaining lines; one of each group stays
    docs = queries.stage_quality(spark, spark.read.parquet(f"{SF}/documents.parquet"), SF)
    least = {r[0] for r in queries.simhash.near_duplicates(docs, ["doc_id"]).select("component_id").collect()}
    hits = queries.decontam.scan(docs, queries.table(spark, SF, "benchmark"), keep=["doc_id"])
    clean = {r[0] for r in hits.where(~queries.decontam.contaminated(F.col("hits"))).select("doc_id").collect()}
    assert ids == least & clean


def test_stages_with_nulls_empty_texts_copies_and_no_rows(spark):
    prose = "\n".join(f"Sentence a{k} has b{k} words c{k} of d{k} text e{k} here." for k in range(20))
    other = " ".join(f"w{k} and x{k * 7}" for k in range(60))
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, prose, None, "s", len(prose)), (3, prose, None, "s", len(prose)),
            (4, prose, "fr", None, None), (5, prose + "\nAll rights reserved.", "en", "s", len(prose) + 21), (None, other, "en", "s", 9),
            (6, other + " password=abcdefghijkl123", "de", "s", 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for docs, want in ((spark.createDataFrame(rows, schema), {None, 3, 6}), (spark.createDataFrame([], schema), set())):
        for name, stage in corpus_pipeline.STAGES:
            after = stage(spark, docs, SF).checkpoint()
            assert name == "bpe_encoding" or after.columns == docs.columns
            docs = after
        got = [r["doc_id"] for r in docs.select("doc_id").collect()]
        assert set(got) <= want and len(got) == len(set(got)) and (3 in got or not want)
