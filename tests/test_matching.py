import pytest
from pyspark.sql import functions as F

from siftwork.functions import clean_id
from siftwork.operators.matching import (matched_rows, missed_rows, overall_metrics,
                                         raw_and_adjusted, search_metrics)


def _truth(spark):
    # worked example: truth W1, W2, W3, null; adjusted keeps the three ids
    rows = [(1, "W1"), (2, "W2"), (3, "W3"), (4, None)]
    t = spark.createDataFrame(rows, "gt long, rid string").select(
        "gt", F.lit("q").alias("q"), clean_id("rid").alias("clean_id"))
    raw = t.withColumn("truth_kind", F.lit("raw"))
    adj = t.where(F.col("clean_id").isNotNull()).withColumn("truth_kind", F.lit("adjusted"))
    return raw.unionByName(adj)


def _results(spark):
    ids = ["https://openalex.org/W1", "w1", " W3", "W9", "W8"]
    return spark.createDataFrame([(i, x) for i, x in enumerate(ids)], "article_id long, oid string") \
        .select("article_id", F.lit("q").alias("q"), clean_id("oid").alias("clean_id"))


def test_worked_example(spark):
    m = {r["truth_kind"]: r for r in search_metrics(_truth(spark), _results(spark), ["q"]).collect()}
    raw, adj = m["raw"], m["adjusted"]
    assert (raw["n_retrieved"], raw["n_missed"], raw["overall_screening_workload"]) == (2, 2, 5)
    assert raw["recall"] == 0.5 and raw["precision"] == 0.4 and raw["nnr"] == 2.5
    assert raw["f1_score"] == pytest.approx(0.444444, abs=1e-6)
    assert raw["f2_score"] == pytest.approx(0.476190, abs=1e-6)
    assert raw["f3_score"] == pytest.approx(0.487805, abs=1e-6)
    assert (adj["n_retrieved"], adj["n_missed"]) == (2, 1)
    assert adj["recall"] == pytest.approx(2 / 3)
    assert adj["f1_score"] == pytest.approx(0.5)
    assert adj["f2_score"] == pytest.approx(0.588235, abs=1e-6)
    assert adj["f3_score"] == pytest.approx(0.625)


def test_match_and_missed_conserve(spark):
    t, r = _truth(spark), _results(spark)
    matched = matched_rows(t, r, ["q"]).groupBy("truth_kind").count().collect()
    missed = missed_rows(t, r, ["q"]).groupBy("truth_kind").count().collect()
    truth = t.groupBy("truth_kind").count().collect()
    mc, xc, tc = ({x["truth_kind"]: x["count"] for x in rs} for rs in (matched, missed, truth))
    for k in tc:
        assert mc.get(k, 0) + xc.get(k, 0) == tc[k]
    # first record (lowest article id) is the one joined
    ids = {x["article_id_results"] for x in matched_rows(t, r, ["q"]).collect() if x["clean_id"] == "w1"}
    assert ids == {0}


def test_empty_adjusted_truth_still_reported(spark):
    t = spark.createDataFrame([(1, "q", None, "raw")], "gt long, q string, clean_id string, truth_kind string")
    r = _results(spark)
    m = {x["truth_kind"]: x for x in search_metrics(t, r, ["q"]).collect()}
    assert set(m) == {"raw", "adjusted"}
    a = m["adjusted"]
    assert (a["n_retrieved"], a["n_missed"], a["recall"], a["nnr"]) == (0, 0, 0.0, 0.0)
    assert a["overall_screening_workload"] == 5


def test_overall_micro_average(spark):
    rows = [("a", "raw", 2, 2, 5), ("b", "raw", 0, 3, 4)]
    per = spark.createDataFrame(rows, "q string, truth_kind string, n_retrieved long, n_missed long, "
                                      "overall_screening_workload long")
    o = overall_metrics(per, ["truth_kind"]).first()
    assert (o["n_retrieved"], o["n_missed"], o["overall_screening_workload"]) == (2, 5, 9)
    assert o["recall"] == pytest.approx(2 / 7) and o["precision"] == pytest.approx(2 / 9)
    none = overall_metrics(per.where("q = 'b'"), ["truth_kind"]).first()
    assert none["nnr"] == float("inf") and none["recall"] == 0.0


def test_raw_and_adjusted(spark):
    m = search_metrics(_truth(spark), _results(spark), ["q"])
    row = raw_and_adjusted(m, ["q"], ["recall", "n_missed"]).first()
    assert row["recall"] == 0.5 and row["recall_adjusted"] == pytest.approx(2 / 3)
    assert (row["n_missed"], row["n_missed_adjusted"]) == (2, 1)
