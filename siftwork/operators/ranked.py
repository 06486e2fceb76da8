"""Ranked-retrieval metrics over a fused ranking (every strategy at once).

Only matched documents need their ranks looked at, so the heavy side (the
fused ranking) is touched by one join on (space, review, clean id) and one
count per strategy; everything after that is per-match or per-strategy.

Per strategy and truth kind (G truth rows, M matched, N ranked documents,
c = rank of the last relevant match):

* recall = M/G, precision = M/N, nnr_raw = N/M
* rank_first_relevant = min matched rank, mrr = 1/that
* rank_new_relevant = min matched rank among articles that were not query
  vectors, mrr_new_relevant = 1/that (null when there is none)
* recall_at_k = matches ranked <= k / G
* cut-off: workload c, precision M/c, nnr c/M, similarity = mean cosine of
  the last relevant match; cut-off recall equals recall
* M = 0: zeros, missed = G, null ranks/NNRs, both workloads = N
* G = 0 (empty evaluation set): only the keys, metrics null
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ids import clean_id
from ..functions.metrics import f_beta, ratio
from ..schemas import RANKED_METRIC_COLUMNS, RECALL_AT_K
from .counting import count_ranks
from .retrieval import QueryMatrix, rank_and_fuse


def scope_truth(truth: DataFrame, review_col: str = "review_id") -> DataFrame:
    """Truth for both scopes: per review (topic) and all reviews ('overall')."""
    t = truth.withColumn(review_col, F.col(review_col).cast("string"))
    return t.unionByName(t.withColumn(review_col, F.lit("overall")))


def match_ranking(fused: DataFrame, truth: DataFrame, keys: Sequence[str],
                  space_col: str = "database", review_col: str = "review_id",
                  truth_id: str = "ground_truth_article_id") -> DataFrame:
    """Matched truth rows with their best rank (ids equal after cleaning
    may occur twice in a ranking; the better rank wins)."""
    ranked = fused.select(*keys, F.col("original_id"), clean_id("original_id").alias("clean_id"),
                          "combined_rank", "cosine_similarity")
    t = truth.select(review_col, space_col, "truth_kind", truth_id, "clean_id")
    m = t.join(ranked, on=[review_col, space_col, "clean_id"], how="inner")
    return m.groupBy(*keys, "truth_kind", truth_id).agg(
        F.min("combined_rank").alias("combined_rank"),
        F.min_by("cosine_similarity", "combined_rank").alias("cosine_similarity"))


def ranked_metrics(fused: DataFrame, truth: DataFrame, queries: DataFrame,
                   keys: Sequence[str] = ("scope", "shot", "database", "review_id"),
                   space_col: str = "database", review_col: str = "review_id",
                   truth_id: str = "ground_truth_article_id",
                   ks: Sequence[int] = RECALL_AT_K, n_docs: DataFrame | None = None) -> DataFrame:
    """The 24 ranked metrics per (strategy keys, truth_kind).

    ``truth``: long truth with review_id, database, truth_kind, truth id and
    clean_id (see ``scope_truth`` / ``matching.truth_by_database``).
    ``queries``: the query rows (keys without the space + query_id,
    query_kind) — article queries are excluded from ``rank_new_relevant``.
    ``n_docs``: optional (keys, _n) ranked documents per strategy; given, the
    fused ranking is read once (by the match join) instead of twice.
    """
    keys = list(keys)
    qkeys = [k for k in keys if k != space_col]
    matches = match_ranking(fused, truth, keys, space_col, review_col, truth_id)
    qids = (queries.where(F.col("query_kind") == "article")
            .select(*qkeys, F.col("query_id").alias("_qid")).distinct()
            .withColumn("_is_query", F.lit(True)))
    matches = (matches.withColumn("_qid", F.col(truth_id).cast("string"))
               .join(qids, on=[*qkeys, "_qid"], how="left"))
    per = matches.groupBy(*keys, "truth_kind").agg(
        F.count(F.lit(1)).alias("_m"),
        F.min("combined_rank").alias("_first"),
        F.min(F.when(F.col("_is_query").isNull(), F.col("combined_rank"))).alias("_new"),
        F.max("combined_rank").alias("_cut"),
        F.max_by("cosine_similarity", "combined_rank").alias("_sim"),
        *[F.count_if(F.col("combined_rank") <= k).alias(f"_at{k}") for k in ks])

    if n_docs is None:
        n_docs = fused.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    g = truth.groupBy(review_col, space_col, "truth_kind").agg(F.count(F.lit(1)).alias("_g"))
    grid = n_docs.withColumn("truth_kind", F.explode(F.array(F.lit("raw"), F.lit("adjusted"))))
    t = (grid.join(g, on=[review_col, space_col, "truth_kind"], how="left")
         .join(per, on=[*keys, "truth_kind"], how="left")
         .fillna(0, subset=["_g", "_m"]))

    G, M, N, C = (F.col(c) for c in ("_g", "_m", "_n", "_cut"))
    hit = M > 0
    empty = G == 0
    recall = F.when(hit, ratio(M, G)).otherwise(0.0)
    precision = F.when(hit, ratio(M, N)).otherwise(0.0)
    prec_cut = F.when(hit, ratio(M, C)).otherwise(0.0)

    def z(expr):  # value when matched, 0 when not
        return F.when(hit, expr).otherwise(F.lit(0.0))

    cols = {
        "nnr_raw": F.when(hit, ratio(N, M)),
        "rank_new_relevant": F.col("_new").cast("double"),
        "rank_first_relevant": F.col("_first").cast("double"),
        "nnr_cutoff": F.when(hit, ratio(C, M)),
        "n_retrieved": M.cast("long"),
        "n_missed": (G - M).cast("long"),
        "recall": recall,
        "recall_cutoff": recall,
        "precision": precision,
        "precision_cutoff": prec_cut,
        "f1_score": z(f_beta(precision, recall, 1)),
        "f2_score": z(f_beta(precision, recall, 2)),
        "f3_score": z(f_beta(precision, recall, 3)),
        "f1_score_cutoff": z(f_beta(prec_cut, recall, 1)),
        "f2_score_cutoff": z(f_beta(prec_cut, recall, 2)),
        "f3_score_cutoff": z(f_beta(prec_cut, recall, 3)),
        **{f"recall_at_{k}": z(ratio(F.col(f"_at{k}"), G)) for k in ks},
        "similarity_threshold_cutoff": z(F.col("_sim")),
        "mrr": z(ratio(F.lit(1.0), F.col("_first"))),
        "mrr_new_relevant": F.when(hit, ratio(F.lit(1.0), F.col("_new"))),
        "overall_screening_workload": N.cast("long"),
        "overall_screening_workload_cutoff": F.when(hit, C).otherwise(N).cast("long"),
    }
    names = [c for c in RANKED_METRIC_COLUMNS if c in cols] + \
        [c for c in cols if c not in RANKED_METRIC_COLUMNS]
    return t.select(*keys, "truth_kind",
                    *[F.when(~empty, cols[c]).alias(c) for c in names])


def counted_ranking(matrix: QueryMatrix, space: DataFrame, truth: DataFrame, space_col: str = "database",
                    review_col: str = "review_id") -> DataFrame:
    """The rows of the fused ranking that hold an included article, of strategies
    with one query: the rank of a document is its place for that query, found by
    counting, so the other documents are never ranked."""
    included = truth.where(F.col("clean_id").isNotNull()).select(review_col, space_col, "clean_id").distinct()
    ids = space.select(space_col, "original_id", clean_id("original_id").alias("clean_id"))
    names = matrix.queries.select("_q", *matrix.query_cols, space_col)
    wanted = (included.join(ids, [space_col, "clean_id"]).select(review_col, space_col, "original_id")
              .join(names.select("_q", review_col, space_col), [review_col, space_col]).select("_q", "original_id").distinct())
    return count_ranks(matrix, space, wanted).join(names, "_q").select(
        *matrix.query_cols, space_col, "original_id", F.col("rank").alias("combined_rank"), "cosine_similarity")


def search_metrics_ranked(matrix: QueryMatrix, space: DataFrame, truth: DataFrame, queries: DataFrame, keys: Sequence[str],
                          n_docs: DataFrame, space_col: str = "database", method: str = "range") -> DataFrame:
    """``ranked_metrics`` of all strategies of ``matrix``: those with one query by
    counting, those with more by ranking and fusing every document."""
    columns = [*matrix.query_cols, space_col, "original_id", "combined_rank", "cosine_similarity"]
    one, many = matrix.split()
    parts = [] if one.queries.isEmpty() else [counted_ranking(one, space, truth, space_col)]
    if not parts or not many.queries.isEmpty():
        parts.append(rank_and_fuse(many.queries, space, space_col, matrix.query_cols, method=method, matrix=many)[1])
    fused = reduce(DataFrame.unionByName, [p.select(*columns) for p in parts])
    return ranked_metrics(fused, truth, queries, keys=keys, space_col=space_col, n_docs=n_docs)


def cutoff_prefix(fused: DataFrame, metrics: DataFrame, keys: Sequence[str],
                  truth_kind: str = "raw") -> DataFrame:
    """Ranked documents up to the last relevant hit of each strategy (the
    screening list a reviewer would read).  The cut-off table has one row
    per strategy."""
    cut = (metrics.where((F.col("truth_kind") == truth_kind) & (F.col("n_retrieved") > 0))
           .select(*keys, F.col("overall_screening_workload_cutoff").alias("_c")))
    return fused.join(cut, on=list(keys), how="inner") \
        .where(F.col("combined_rank") <= F.col("_c")).drop("_c")
