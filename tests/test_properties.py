"""Property checks (few examples each: every example runs Spark jobs)."""
import datetime as dt

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siftwork.operators.matching import search_metrics
from siftwork.operators.ranked import ranked_metrics
from siftwork.operators.retrieval import rrf_fuse
from siftwork.operators.stats import bh_adjust
from siftwork.operators.truth import stable_sample
from siftwork.operators.windows import check_windows, date_windows

SETTINGS = settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
ids = st.lists(st.sampled_from([f"w{i}" for i in range(12)] + [None]), min_size=0, max_size=10)


@SETTINGS
@given(truth_ids=ids, result_ids=ids)
def test_conservation_and_bounds(spark, truth_ids, result_ids):
    t = spark.createDataFrame([("q", x, "raw") for x in truth_ids] or [("q", "w0", "raw")],
                              "q string, clean_id string, truth_kind string")
    r = spark.createDataFrame([("q", x) for x in result_ids], "q string, clean_id string")
    for m in search_metrics(t, r, ["q"], kinds=("raw",)).collect():
        n_truth = max(len(truth_ids), 1)
        assert m["n_retrieved"] + m["n_missed"] == n_truth
        assert 0.0 <= m["recall"] <= 1.0 and 0.0 <= m["precision"] <= 1.0


def _ranked(spark, orders):
    rows = []
    for qi, order in enumerate(orders):
        for r, doc in enumerate(order, start=1):
            rows.append(("topic", "few-shot", "r", "db", f"q{qi}", doc, int(doc[1:]), 1.0 / r, r))
    return spark.createDataFrame(rows, "scope string, shot string, review_id string, database string, "
                                       "query_id string, original_id string, article_id long, "
                                       "cosine_similarity double, rank long")


docs = [f"d{i}" for i in range(8)]
perm = st.permutations(docs)


@SETTINGS
@given(orders=st.lists(perm, min_size=1, max_size=3), data=st.data())
def test_rrf_order_invariance_and_permutation(spark, orders, data):
    a = {r["original_id"]: (r["rrf_score"], r["combined_rank"])
         for r in rrf_fuse(_ranked(spark, orders), method="window").collect()}
    shuffled = data.draw(st.permutations(orders))
    b = {r["original_id"]: (r["rrf_score"], r["combined_rank"])
         for r in rrf_fuse(_ranked(spark, shuffled), method="range").collect()}
    assert a == b
    assert sorted(v[1] for v in a.values()) == list(range(1, len(docs) + 1))


@SETTINGS
@given(order=perm, relevant=st.sets(st.sampled_from(docs), min_size=1, max_size=5))
def test_ranked_metric_properties(spark, order, relevant):
    fused = rrf_fuse(_ranked(spark, [order]), method="window")
    truth = spark.createDataFrame([("r", "db", "raw", int(d[1:]), d) for d in relevant],
                                  "review_id string, database string, truth_kind string, "
                                  "ground_truth_article_id long, clean_id string")
    q = spark.createDataFrame([], "scope string, shot string, review_id string, query_id string, query_kind string")
    m = [x for x in ranked_metrics(fused, truth, q, ks=(1, 3, 5, 10)).collect() if x["truth_kind"] == "raw"][0]
    assert m["recall_cutoff"] == m["recall"]
    assert m["precision_cutoff"] >= m["precision"]
    ks = [m["recall_at_1"], m["recall_at_3"], m["recall_at_5"], m["recall_at_10"]]
    assert ks == sorted(ks)
    assert m["overall_screening_workload_cutoff"] == max(order.index(d) + 1 for d in relevant)


@SETTINGS
@given(ps=st.lists(st.floats(min_value=0.0, max_value=1.0), min_size=1, max_size=12))
def test_bh_monotone_and_not_below_p(spark, ps):
    df = spark.createDataFrame([(i, p) for i, p in enumerate(ps)], "i long, p_value double")
    rows = sorted(bh_adjust(df, order_key=["i"]).collect(), key=lambda r: (r["p_value"], r["i"]))
    adj = [r["p_adjusted"] for r in rows]
    assert all(r["p_adjusted"] >= r["p_value"] - 1e-15 and r["p_adjusted"] <= 1.0 for r in rows)
    assert adj == sorted(adj)


@SETTINGS
@given(start=st.dates(dt.date(1980, 1, 1), dt.date(2020, 12, 31)), days=st.integers(0, 9000),
       years=st.integers(1, 4))
def test_windows_tile_the_range(spark, start, days, years):
    end = start + dt.timedelta(days=days)
    b = spark.createDataFrame([(start, end)], "start date, end date")
    w = sorted(date_windows(b, years=years).collect(), key=lambda r: r["window_start"])
    assert w[0]["window_start"] == start and w[-1]["window_end"] == end
    assert check_windows(date_windows(b, years=years)).count() == 0
    assert all(r["window_start"] <= r["window_end"] for r in w)


@SETTINGS
@given(n_parts=st.integers(1, 7))
def test_sample_stable_under_repartition(spark, n_parts):
    df = spark.range(300).select((F.col("id") % 7).alias("g"), F.col("id").alias("x"))
    a = {(r["g"], r["x"]) for r in stable_sample(df, ["g"], "x", 3).collect()}
    b = {(r["g"], r["x"]) for r in stable_sample(df.repartition(n_parts), ["g"], "x", 3).collect()}
    assert a == b and len(a) == 21
