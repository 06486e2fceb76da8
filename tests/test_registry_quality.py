import time

import pytest
from pyspark.sql import functions as F

from siftwork.operators.quality import (check_foreign_key, check_metric_bounds, check_schema,
                                        check_unique, embedding_coverage, last_non_null)
from siftwork.operators.registry import (assign_ids, fan_out, new_rows, new_rows_null_safe,
                                         upsert)
from siftwork.plans import norm_plans, quality_plans
from siftwork.schemas import SEARCH_RESULT
from siftwork.streaming import ingest_new_keys


def test_null_safe_new_rows(spark):
    cand = spark.createDataFrame([("a", None), ("b", 1), ("c", None)], "k string, v int")
    have = spark.createDataFrame([("a", None), ("b", 2)], "k string, v int")
    got = {(r["k"], r["v"]) for r in new_rows_null_safe(cand, have, ["k", "v"]).collect()}
    assert got == {("b", 1), ("c", None)}
    assert {r["k"] for r in new_rows(cand, have, ["k"]).collect()} == {"c"}


def test_upsert(spark):
    base = spark.createDataFrame([(1, "old"), (2, "keep")], "id int, v string")
    upd = spark.createDataFrame([(1, "new"), (3, "added")], "id int, v string")
    got = {r["id"]: r["v"] for r in upsert(base, upd, ["id"]).collect()}
    assert got == {1: "new", 2: "keep", 3: "added"}


def test_fan_out_and_ids(spark):
    strat = spark.createDataFrame([("pubmed",), ("embase",)], "database string")
    reviews = spark.createDataFrame([("r1",), ("r2",), ("r2",), ("r3",)], "review_id string")
    f = fan_out(strat, reviews, ["zero-shot", "few-shot"])
    assert f.count() == 2 * 3 * 2
    ids = assign_ids(f, ["database", "review_id", "vector_search"], 100, name="sid")
    got = sorted(r["sid"] for r in ids.collect())
    assert got == list(range(101, 113))


def test_quality_checks(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k int, v string")
    assert check_unique(df, ["k"]).count() == 1
    parent = spark.createDataFrame([(1,)], "k int")
    assert {r["k"] for r in check_foreign_key(df, parent, ["k"]).collect()} == {2}
    s = {(r["column"], r["problem"]) for r in check_schema(spark, df, SEARCH_RESULT).collect()}
    assert ("k", "extra") in s and ("original_id", "missing") in s
    m = spark.createDataFrame([(1.2, 0.5, 1.2), (0.5, 0.5, 0.4)], "recall double, precision double, recall_cutoff double")
    assert check_metric_bounds(m, equal_pairs=[("recall", "recall_cutoff")]).count() == 2
    lines = spark.createDataFrame([("q", 1, 10), ("q", 2, None), ("q", 3, 12), ("q", 4, None)],
                                  "q string, line int, results int")
    assert last_non_null(lines, ["q"], "results", "line").first()["results"] == 12
    v = spark.createDataFrame([("db", [1.0]), ("db", None)], "database string, embedding array<double>")
    exp = spark.createDataFrame([("db", 3)], "database string, expected long")
    r = embedding_coverage(v, exp, ["database"]).first()
    assert (r["n_rows"], r["n_vectors"], r["needs_rebuild"]) == (2, 1, True)


def test_streaming_ingest_new_keys(spark, tmp_dir):
    src, target = f"{tmp_dir}/landing", f"{tmp_dir}/target"
    schema = "id string, title string"
    spark.createDataFrame([("a", "x"), ("b", "y"), ("a", "x2")], schema).write.parquet(f"{src}/f1")
    q = ingest_new_keys(spark, f"{src}/f1", spark.createDataFrame([], schema).schema, target, ["id"],
                        order_col="title", checkpoint=f"{tmp_dir}/ck1")
    q.awaitTermination(120)
    # a second landing repeats key 'a' and adds 'c'
    spark.createDataFrame([("a", "dup"), ("c", "z")], schema).write.parquet(f"{src}/f2")
    q = ingest_new_keys(spark, f"{src}/f2", spark.createDataFrame([], schema).schema, target, ["id"],
                        order_col="title", checkpoint=f"{tmp_dir}/ck2")
    q.awaitTermination(120)
    rows = sorted((r["id"], r["title"]) for r in spark.read.parquet(target).collect())
    assert rows == [("a", "x"), ("b", "y"), ("c", "z")]


def test_build_ground_truth_priority_and_cleaning(spark):
    from siftwork.operators.truth import build_ground_truth, topic_lookup
    articles = spark.createDataFrame(
        [(1, "1.4.1, 1.4.2", "2019//"), (2, "1.4.1, 1.4.2", "2020"), (3, "9.9", "2018")],
        "included_article_id long, question_id string, year_pub_extract string")
    reviews = spark.createDataFrame([("1.4.1/1.4.2", "SR", 6), ("9.9", "SR", 2)],
                                    "question_id string, evidence_review_type string, included_num int")
    pm = spark.createDataFrame([(1, None, None, "pm second title", "pm &lt;b&gt;abs&lt;/b&gt;", " PMID1 ")],
                               "included_article_id long, title string, abstract string, title_2ndsearch string, "
                               "abstract_2ndsearch string, api_id_retrieved string")
    em = spark.createDataFrame([(1, "em title", "em abs", None), (2, "em title 2", None, "E2")],
                               "included_article_id long, title string, abstract string, api_id_retrieved string")
    oa = spark.createDataFrame([(2, "oa title 2", "oa   abs 2", "https://openalex.org/W2")],
                               "included_article_id long, title string, abstract string, api_id_retrieved string")
    gt = {r["included_article_id"]: r for r in
          build_ground_truth(articles, reviews, {"pubmed": pm, "embase": em, "openalex": oa}).collect()}
    assert set(gt) == {1, 2}                       # review 9.9 is not eligible (2 < 5)
    assert gt[1]["question_id"] == "1.4.1/1.4.2"
    assert gt[1]["title"] == "pm second title"      # pubmed > embase > openalex
    assert gt[1]["abstract"] == "pm abs"            # entities decoded, tags stripped
    assert gt[2]["title"] == "em title 2" and gt[2]["abstract"] == "oa abs 2"
    assert gt[1]["retrieved_pubmed_id"] == "pmid1" and gt[2]["retrieved_oa_id"] == "w2"
    assert gt[1]["year_pub_extract"] == 2019

    ids = spark.createDataFrame([("w1",), ("w2",), ("w3",)], "clean_id string")
    first = spark.createDataFrame([("w1", "T1")], "clean_id string, topic_id string")
    retry = spark.createDataFrame([("w1", None), ("w2", "T2")], "clean_id string, topic_id string")
    got, missing = topic_lookup(ids, first, retry)
    m = {r["clean_id"]: r["topic_id"] for r in got.collect()}
    assert m == {"w1": "T1", "w2": "T2", "w3": None}           # a retry never erases a hit
    assert [r["clean_id"] for r in missing.collect()] == ["w3"]


def test_register_is_idempotent(spark):
    from siftwork.operators.registry import register

    keys = ["database", "review_id", "vector_search"]
    strategies = spark.createDataFrame([("a",), (None,)], "database string")
    reviews = spark.createDataFrame([("r1",), (None,)], "review_id string")
    none = spark.createDataFrame([], "database string, review_id string, vector_search string, search_strategy_id long")
    first = register(strategies, reviews, ["x", "y"], none, keys)
    assert sorted(r["search_strategy_id"] for r in first.collect()) == list(range(1, 9))
    assert register(strategies, reviews, ["x", "y"], first, keys).count() == 0


def test_enforce_and_table_equality(spark):
    from siftwork.operators.quality import check_table_equality, enforce

    a = spark.createDataFrame([(1,), (None,)], "k int")
    enforce(check_table_equality(a, a, ["k"]), "same")
    with pytest.raises(AssertionError):
        enforce(check_table_equality(a, a.where("k = 1"), ["k"]), "one row lost")


# ------------------------------------------ checks over tables built here --


def _tables(spark, at):
    """Four documents in two reviews; one label without document, one review without German text."""
    d = [(1, "src1", "en", "a b"), (2, "src1", "de", "c d"), (3, "src2", "fr", "e f"), (4, "src2", "en", "g h")]
    spark.createDataFrame([(i, s, x, len(t), t) for i, s, x, t in d],
                          "doc_id long, source string, lang string, n_chars int, text string").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (2, 1, 0), (3, 1, 0), (9, 0, 1), (None, 1, 1)],
                          "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([("1994-02-03",), ("1996-05-06",)], "d string").select(
        F.to_timestamp("d").alias("o_orderdate")).write.parquet(f"{at}/orders.parquet")
    return at


def test_windows_are_returned(spark, tmp_dir):
    got = norm_plans.QUERIES["dq_windows"](spark, _tables(spark, tmp_dir))
    assert got.columns == ["window_id", "window_start", "window_end", "next_start"] and got.collect() == []


def test_labels_without_document_are_returned(spark, tmp_dir):
    got = quality_plans.QUERIES["dq_foreign_key"](spark, _tables(spark, tmp_dir))
    assert [r.asDict() for r in got.collect()] == [{"doc_id": 9, "quality": 0, "toxic": 1}]


def test_reviews_of_one_side_are_returned(spark, tmp_dir):
    got = quality_plans.QUERIES["dq_subset"](spark, _tables(spark, tmp_dir))
    assert [r.asDict() for r in got.collect()] == [{"review_id": "src2", "side": "missing_in_second"}]


def test_groups_that_lost_rows_are_returned(spark, tmp_dir, monkeypatch):
    from siftwork.plans.eval_plans import topic_metrics_df

    at = _tables(spark, tmp_dir)
    assert quality_plans.QUERIES["dq_conservation"](spark, at).collect() == []
    lost = topic_metrics_df(spark, at).withColumn("n_missed", F.col("n_missed") + (F.col("review_id") == "src1").cast("int"))
    monkeypatch.setattr(quality_plans, "topic_metrics_df", lambda *_: lost)
    got = quality_plans.QUERIES["dq_conservation"](spark, at)
    assert got.columns == ["database", "review_id", "truth_kind", "n_retrieved", "n_missed", "n_truth"]
    rows = got.collect()
    assert {r["review_id"] for r in rows} == {"src1"} and all(r["n_retrieved"] + r["n_missed"] == r["n_truth"] + 1 for r in rows)


def test_ratios_out_of_bounds_are_returned(spark, tmp_dir, monkeypatch):
    m = spark.createDataFrame([("pubmed", "src1", "raw", 1.5, 0.5), ("pubmed", "src2", "raw", 0.5, 0.5)],
                              "database string, review_id string, truth_kind string, recall double, precision double")
    assert quality_plans.QUERIES["dq_metrics"](spark, _tables(spark, tmp_dir)).columns == m.columns
    monkeypatch.setattr(quality_plans, "topic_metrics_df", lambda *_: m)
    assert [tuple(r) for r in quality_plans.QUERIES["dq_metrics"](spark, tmp_dir).collect()] == [("pubmed", "src1", "raw", 1.5, 0.5)]
