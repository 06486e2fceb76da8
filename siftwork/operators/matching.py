"""Truth matching and set-based search metrics (one job for every group).

Contract
--------
* ``truth``: one row per (group, truth article), with a cleaned id column
  ``clean_id`` (null = not indexed; null never matches) and ``truth_kind``.
* ``results``: one row per retrieved record, with the result-group columns
  and a cleaned id ``clean_id``.  Duplicates stay: they count in the
  screening workload ``N``; matching uses the distinct ids only.

Per group: G truth rows, M matched truth rows, N result rows.
M = 0 -> nnr, ratios and F-scores 0, missed = G (also for an empty truth).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ids import clean_id
from ..functions.metrics import f_beta, ratio
from ..schemas import TRUTH_ID_COLUMN

KINDS = ("raw", "adjusted")


def truth_by_database(truth: DataFrame, databases: Sequence[str],
                      keep: Sequence[str] = ()) -> DataFrame:
    """Long truth: one row per (database, truth_kind, article).

    The id for a database comes from its own id column (medline uses the
    pubmed id).  ``raw`` keeps every article; ``adjusted`` only the articles
    that database indexes (id not null).  A narrow ``explode`` — no join.
    """
    per_db = F.array(*[
        F.struct(F.lit(db).alias("database"),
                 clean_id(TRUTH_ID_COLUMN[db]).alias("clean_id"))
        for db in databases])
    kinds = F.when(F.col("_t.clean_id").isNull(), F.array(F.lit("raw"))) \
        .otherwise(F.array(F.lit("raw"), F.lit("adjusted")))
    return (truth.select(*keep, F.explode(per_db).alias("_t"))
            .select(*keep, "_t.database", "_t.clean_id", F.explode(kinds).alias("truth_kind")))


def distinct_keys(results: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct (group, clean_id) of the results; partial aggregation map-side
    collapses repeated ids before the shuffle, so a hot id costs one row per
    task."""
    return results.where(F.col("clean_id").isNotNull()).select(*keys, "clean_id").distinct()


def flag_matches(truth: DataFrame, results: DataFrame, result_keys: Sequence[str]) -> DataFrame:
    """Truth rows + boolean ``matched`` (left join on the distinct ids)."""
    hits = distinct_keys(results, result_keys).withColumn("matched", F.lit(True))
    return (truth.join(hits, on=[*result_keys, "clean_id"], how="left")
            .withColumn("matched", F.coalesce(F.col("matched"), F.lit(False))))


def matched_rows(truth: DataFrame, results: DataFrame, result_keys: Sequence[str],
                 order: str = "article_id") -> DataFrame:
    """Truth ⋈ results deduped on the clean id (first record by ``order``);
    result columns get a ``_results`` suffix."""
    from .ordinal import top_k

    dedup = top_k(results.where(F.col("clean_id").isNotNull()), [*result_keys, "clean_id"],
                  [F.col(order).asc()], 1, name="_rn").drop("_rn")
    other = [c for c in dedup.columns if c not in (*result_keys, "clean_id")]
    dedup = dedup.select(*result_keys, "clean_id", *[F.col(c).alias(f"{c}_results") for c in other])
    return truth.join(dedup, on=[*result_keys, "clean_id"], how="inner")


def missed_rows(truth: DataFrame, results: DataFrame, result_keys: Sequence[str]) -> DataFrame:
    """Truth rows whose id matched nothing (null ids included)."""
    return truth.join(distinct_keys(results, result_keys), on=[*result_keys, "clean_id"],
                      how="left_anti")


def metric_columns(g, m, n) -> list:
    """The nine set metrics from counts G, M, N (column expressions)."""
    g, m, n = F.col(g), F.col(m), F.col(n)
    none = m == 0
    recall = F.when(none, 0.0).otherwise(ratio(m, g))
    precision = F.when(none, 0.0).otherwise(ratio(m, n))
    return [
        F.when(none, 0.0).otherwise(ratio(n, m)).alias("nnr"),
        m.cast("long").alias("n_retrieved"),
        (g - m).cast("long").alias("n_missed"),
        recall.alias("recall"),
        precision.alias("precision"),
        F.when(none, 0.0).otherwise(f_beta(precision, recall, 1)).alias("f1_score"),
        F.when(none, 0.0).otherwise(f_beta(precision, recall, 2)).alias("f2_score"),
        F.when(none, 0.0).otherwise(f_beta(precision, recall, 3)).alias("f3_score"),
        n.cast("long").alias("overall_screening_workload"),
    ]


def search_metrics(truth: DataFrame, results: DataFrame, result_keys: Sequence[str],
                   kinds: Sequence[str] = KINDS, truth_keys: Sequence[str] = ()) -> DataFrame:
    """Recall, precision, NNR, F1-F3, workload per (result group, extra truth
    keys, truth_kind).

    ``truth_keys`` split one result set over several truth groups (a broad
    search evaluated per review).  Every group that has raw truth gets a row
    for every kind, even when its adjusted truth is empty.

    Each input is read once: one partial aggregate of the results per
    (group, id) gives both the distinct ids for matching and the workload
    (sum of the per-id counts); the grid of groups comes from the truth
    counts.  Reused subtrees plan as reused exchanges.
    """
    keys = [*result_keys, *truth_keys]
    per_id = results.groupBy(*result_keys, "clean_id").agg(F.count(F.lit(1)).alias("_c"))
    workload = per_id.groupBy(*result_keys).agg(F.sum("_c").alias("_n"))
    hits = per_id.where(F.col("clean_id").isNotNull()).select(*result_keys, "clean_id") \
        .withColumn("matched", F.lit(True))
    flagged = (truth.join(hits, on=[*result_keys, "clean_id"], how="left")
               .withColumn("matched", F.coalesce(F.col("matched"), F.lit(False))))
    counts = flagged.groupBy(*keys, "truth_kind").agg(
        F.count(F.lit(1)).alias("_g"), F.count_if("matched").alias("_m"))
    grid = (counts.where(F.col("truth_kind") == "raw").select(*keys)
            .withColumn("truth_kind", F.explode(F.array(*[F.lit(k) for k in kinds]))))
    table = (grid.join(counts, on=[*keys, "truth_kind"], how="left")
             .join(workload, on=list(result_keys), how="left")
             .fillna(0, subset=["_g", "_m", "_n"]))
    return table.select(*keys, "truth_kind", *metric_columns("_g", "_m", "_n"))


def overall_metrics(per_group: DataFrame, keys: Sequence[str],
                    label_col: str = "question_id", label: str = "overall") -> DataFrame:
    """Micro-average over groups: sum counts, then ratios.  NNR is +inf when
    nothing was found (precision 0), as in the per-guideline summary."""
    s = per_group.groupBy(*keys).agg(
        F.sum("n_retrieved").alias("_r"), F.sum("n_missed").alias("_x"),
        F.sum("overall_screening_workload").alias("_w"))
    total = F.col("_r") + F.col("_x")
    recall = F.coalesce(ratio("_r", total), F.lit(0.0))
    precision = F.coalesce(ratio("_r", "_w"), F.lit(0.0))
    return s.select(
        *keys, F.lit(label).alias(label_col),
        F.when(precision > 0, 1.0 / precision).otherwise(F.lit(float("inf"))).alias("nnr"),
        F.col("_r").cast("long").alias("n_retrieved"),
        F.col("_x").cast("long").alias("n_missed"),
        recall.alias("recall"), precision.alias("precision"),
        f_beta(precision, recall, 1).alias("f1_score"),
        f_beta(precision, recall, 2).alias("f2_score"),
        f_beta(precision, recall, 3).alias("f3_score"),
        F.col("_w").cast("long").alias("overall_screening_workload"),
    )


def raw_and_adjusted(metrics: DataFrame, keys: Sequence[str], metric_cols: Sequence[str],
                     kind_col: str = "truth_kind") -> DataFrame:
    """Raw and adjusted rows side by side (``<m>`` and ``<m>_adjusted``).

    One aggregation instead of a full outer join of two filtered copies."""
    aggs = []
    for m in metric_cols:
        aggs.append(F.max(F.when(F.col(kind_col) == "raw", F.col(m))).alias(m))
        aggs.append(F.max(F.when(F.col(kind_col) == "adjusted", F.col(m))).alias(f"{m}_adjusted"))
    return metrics.groupBy(*keys).agg(*aggs)
