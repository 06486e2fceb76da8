import numpy as np
import pytest
from pyspark.sql import functions as F

from siftwork.operators.ordinal import ordinal
from siftwork.operators.ranked import ranked_metrics
from siftwork.operators.retrieval import (cosine_scores, dedupe_space, embed, pick_one,
                                          rank_and_fuse, rrf_fuse, select_queries)

KEYS = ["scope", "shot", "database", "review_id"]


def _ranked(spark):
    rows = []
    for q, order in (("q1", "abc"), ("q2", "bca")):
        for r, doc in enumerate(order, start=1):
            rows.append(("topic", "few-shot", "r", "db", q, doc, ord(doc), 0.5, r))
    return spark.createDataFrame(rows, "scope string, shot string, review_id string, database string, "
                                       "query_id string, original_id string, article_id long, "
                                       "cosine_similarity double, rank long")


def test_rrf_worked_example(spark):
    fused = {r["original_id"]: r for r in rrf_fuse(_ranked(spark), method="window").collect()}
    assert fused["b"]["rrf_score"] == pytest.approx(0.032522475, abs=1e-9)
    assert fused["a"]["rrf_score"] == pytest.approx(0.032266458, abs=1e-9)
    assert fused["c"]["rrf_score"] == pytest.approx(0.032002048, abs=1e-9)
    assert [fused[d]["combined_rank"] for d in "bac"] == [1, 2, 3]


def _truth(spark):
    return spark.createDataFrame([("r", "db", "raw", 97, "a")],
                                 "review_id string, database string, truth_kind string, "
                                 "ground_truth_article_id long, clean_id string")


@pytest.mark.parametrize("a_is_query", [False, True])
def test_ranked_metrics_worked_example(spark, a_is_query):
    fused = rrf_fuse(_ranked(spark), method="window")
    qid = "97" if a_is_query else "1"
    queries = spark.createDataFrame([("topic", "few-shot", "r", qid, "article")],
                                    "scope string, shot string, review_id string, query_id string, query_kind string")
    m = {r["truth_kind"]: r for r in ranked_metrics(fused, _truth(spark), queries, KEYS).collect()}
    raw = m["raw"]
    assert raw["rank_first_relevant"] == 2 and raw["mrr"] == 0.5
    assert raw["overall_screening_workload_cutoff"] == 2 and raw["overall_screening_workload"] == 3
    assert raw["precision"] == pytest.approx(1 / 3) and raw["precision_cutoff"] == 0.5
    assert raw["nnr_cutoff"] == 2.0 and raw["recall"] == raw["recall_cutoff"] == 1.0
    assert raw["recall_at_10"] == 1.0
    if a_is_query:
        assert raw["rank_new_relevant"] is None and raw["mrr_new_relevant"] is None
    else:
        assert raw["rank_new_relevant"] == 2 and raw["mrr_new_relevant"] == 0.5
    # empty adjusted truth: keys only, metrics null
    assert m["adjusted"]["recall"] is None and m["adjusted"]["n_retrieved"] is None


def test_no_match_branch(spark):
    fused = rrf_fuse(_ranked(spark), method="window")
    truth = spark.createDataFrame([("r", "db", "raw", 5, "zzz")],
                                  "review_id string, database string, truth_kind string, "
                                  "ground_truth_article_id long, clean_id string")
    q = spark.createDataFrame([], "scope string, shot string, review_id string, query_id string, query_kind string")
    r = [x for x in ranked_metrics(fused, truth, q, KEYS).collect() if x["truth_kind"] == "raw"][0]
    assert (r["n_retrieved"], r["n_missed"], r["recall"], r["mrr"]) == (0, 1, 0.0, 0.0)
    assert r["nnr_raw"] is None and r["rank_first_relevant"] is None
    assert r["overall_screening_workload_cutoff"] == r["overall_screening_workload"] == 3


def test_range_ordinal_equals_window(spark):
    rng = np.random.default_rng(7)
    n = 3000
    # one hot group holding most rows, many small ones, tied scores
    grp = np.where(rng.random(n) < 0.7, 0, rng.integers(1, 40, n))
    score = rng.integers(0, 50, n).astype(float)
    df = spark.createDataFrame([(int(g), float(s), f"id{i:05d}") for i, (g, s) in enumerate(zip(grp, score))],
                               "g long, s double, id string")
    order = [F.col("s").desc(), F.col("id").asc()]
    a = {r["id"]: r["rank"] for r in ordinal(df, ["g"], order, method="range").collect()}
    b = {r["id"]: r["rank"] for r in ordinal(df, ["g"], order, method="window").collect()}
    assert a == b and len(a) == n


def _space(spark):
    rows = [("db", 1, "d1", [1.0, 0.0, 0.0]), ("db", 2, "d2", [0.6, 0.8, 0.0]),
            ("db", 3, "d3", [0.0, 0.0, 0.0]), ("db", 4, "d4", None), ("db", 5, "d5", [1.0, 1.0]),
            ("db", 6, "d6", [0.0, 1.0, 1.0]), ("other", 7, "d7", [1.0, 2.0, 3.0])]
    return spark.createDataFrame(rows, "database string, article_id long, original_id string, embedding array<double>")


def _queries(spark):
    rows = [("topic", "few-shot", "r", "q1", "article", [1.0, 1.0, 0.0], "db"),
            ("topic", "few-shot", "r", "q2", "article", [0.0, 0.0, 2.0], "db")]
    return spark.createDataFrame(rows, "scope string, shot string, review_id string, query_id string, "
                                       "query_kind string, embedding array<double>, database string")


def test_cosine_matches_numpy(spark):
    got = {(r["query_id"], r["original_id"]): r["cosine_similarity"]
           for r in cosine_scores(_queries(spark), _space(spark), dim=3).collect()}
    docs = {"d1": [1, 0, 0], "d2": [0.6, 0.8, 0], "d6": [0, 1, 1]}
    qs = {"q1": [1, 1, 0], "q2": [0, 0, 2]}
    want = {}
    for q, qv in qs.items():
        for d, dv in docs.items():
            qv_, dv_ = np.array(qv, float), np.array(dv, float)
            want[(q, d)] = float(qv_ @ dv_ / np.linalg.norm(qv_) / np.linalg.norm(dv_))
    assert set(got) == set(want)      # null, zero, wrong-length and other-space docs dropped
    for k in want:
        assert got[k] == pytest.approx(want[k], abs=1e-12)


@pytest.mark.parametrize("method", ["window", "range"])
def test_rank_and_fuse_methods_agree(spark, method):
    ranked, fused, used = rank_and_fuse(_queries(spark), _space(spark), dim=3, method=method)
    assert used == method
    got = sorted((r["original_id"], r["combined_rank"], r["rrf_score"]) for r in fused.collect())
    _, ref, _ = rank_and_fuse(_queries(spark), _space(spark), dim=3, method="window")
    want = sorted((r["original_id"], r["combined_rank"], r["rrf_score"]) for r in ref.collect())
    assert got == want
    ranks = sorted(r["combined_rank"] for r in fused.collect())
    assert ranks == list(range(1, len(ranks) + 1))          # a permutation


def test_query_selection(spark):
    gold = spark.createDataFrame([("r1", i, [float(i), 1.0]) for i in (3, 5, 9)] + [("r2", 4, [1.0, 0.0])],
                                 "review_id string, ground_truth_article_id long, embedding array<double>")
    few = select_queries(gold, None, "topic", "few-shot").collect()
    assert len(few) == 4
    one = {r["review_id"]: r["query_id"] for r in select_queries(gold, None, "topic", "one-shot").collect()}
    import hashlib
    want = min((hashlib.md5(str(i).encode()).hexdigest(), i) for i in (3, 5, 9))[1]
    assert one["r1"] == str(want) and one["r2"] == "4"
    overall = select_queries(gold, None, "overall", "one-shot").collect()
    assert {r["review_id"] for r in overall} == {"overall"} and len(overall) == 2
    picked = pick_one(gold.select("review_id", "ground_truth_article_id"), ["review_id"],
                      "ground_truth_article_id")
    assert picked.count() == 2


def test_dedupe_space_keeps_lowest_id(spark):
    df = spark.createDataFrame([("db", 9, "x"), ("db", 2, "x"), ("db", 5, "y")],
                               "database string, article_id long, original_id string")
    got = {r["original_id"]: r["article_id"] for r in dedupe_space(df).collect()}
    assert got == {"x": 2, "y": 5}


def test_embed_hashing_encoder(spark):
    df = spark.createDataFrame([(1, "Insulin resistance"), (2, None), (3, "insulin RESISTANCE")],
                               "id int, text string")
    rows = {r["id"]: r["embedding"] for r in embed(df, "text").collect()}
    assert rows[2] is None and len(rows[1]) == 64
    assert rows[1] == rows[3]                                # case-insensitive tokens
    assert np.linalg.norm(rows[1]) == pytest.approx(1.0)


def test_blocks_of_queries_score_alike(spark):
    import siftwork.operators.retrieval as R
    cols = ["scope", "shot", "review_id"]
    one = R.QueryMatrix.collect(_queries(spark), "database", cols, dim=3)
    many = R.QueryMatrix.collect(_queries(spark), "database", cols, dim=3, block_bytes=1)
    assert one.blocks == 1 and many.blocks > 1
    got = [sorted((r["query_id"], r["original_id"], r["cosine_similarity"]) for r in m.score(_space(spark)).collect())
           for m in (one, many)]
    assert got[0] == got[1] and got[0]


def test_an_over_long_query_vector_changes_nothing_else(spark):
    q = _queries(spark)
    odd = q.limit(1).withColumn("query_id", F.lit("odd")).withColumn("embedding", F.expr("array(1d, 2d, 3d, 4d)"))
    want = cosine_scores(q, _space(spark), dim=3).count()
    assert want and cosine_scores(q.unionByName(odd), _space(spark), dim=3).count() == want


def test_range_ordinal_keeps_null_groups(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), (7, 3)], "g long, v long")
    got = {m: sorted((r["v"], r["rank"]) for r in ordinal(df, ["g"], ["v"], method=m).collect())
           for m in ("range", "window")}
    assert got["range"] == got["window"] == [(1, 1), (2, 2), (3, 1)]
