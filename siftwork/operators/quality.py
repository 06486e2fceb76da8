"""Data-quality checks.  Every check returns a DataFrame of violations (empty
= pass); ``enforce`` turns a non-empty result into an error when the caller
wants a hard stop."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def enforce(violations: DataFrame, what: str) -> None:
    """Raise when a check found anything (reads at most one row)."""
    if not violations.isEmpty():
        raise AssertionError(f"data-quality check failed: {what}")


def check_schema(spark: SparkSession, df: DataFrame, expected: T.StructType) -> DataFrame:
    """Column-set comparison against a target schema: missing / extra."""
    have, want = set(df.columns), set(expected.fieldNames())
    rows = [(c, "missing") for c in sorted(want - have)] + [(c, "extra") for c in sorted(have - want)]
    return spark.createDataFrame(rows, "column string, problem string")


def check_min_rows(df: DataFrame, expected: int, name: str = "table") -> DataFrame:
    """Row count below the expected minimum (one aggregate)."""
    c = df.agg(F.count(F.lit(1)).alias("n_rows"))
    return c.where(F.col("n_rows") < expected).select(F.lit(name).alias("table"), "n_rows",
                                                      F.lit(expected).alias("expected"))


def check_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once (partial aggregation map-side)."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).where(F.col("n_rows") > 1)


def duplicate_rows(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every row whose key is duplicated, with the key's count — aggregated
    counts joined back, so a hot key is never one window partition."""
    dups = check_unique(df, keys)
    return df.join(dups, list(keys), "inner")


def check_foreign_key(child: DataFrame, parent: DataFrame, fk: Sequence[str],
                      pk: Sequence[str] | None = None) -> DataFrame:
    """Child rows whose (non-null) foreign key has no parent row."""
    pk = list(pk or fk)
    p = parent.select(*[F.col(a).alias(b) for a, b in zip(pk, fk)]).distinct()
    nonnull = [F.col(c).isNotNull() for c in fk]
    cond = nonnull[0]
    for c in nonnull[1:]:
        cond = cond & c
    return child.where(cond).join(p, list(fk), "left_anti")


def check_subset(a: DataFrame, b: DataFrame, keys: Sequence[str], allowed: Sequence = (),
                 both_ways: bool = True) -> DataFrame:
    """Keys of ``a`` missing from ``b`` (and, both ways, of ``b`` missing from
    ``a``), minus known exceptions; column ``side`` tells which."""
    ka, kb = a.select(*keys).distinct(), b.select(*keys).distinct()
    out = ka.join(kb, list(keys), "left_anti").withColumn("side", F.lit("missing_in_second"))
    if both_ways:
        out = out.unionByName(kb.join(ka, list(keys), "left_anti")
                              .withColumn("side", F.lit("missing_in_first")))
    if allowed:
        out = out.where(~F.col(keys[0]).isin(*allowed))
    return out


def last_non_null(df: DataFrame, by: Sequence[str], value: str, order: str | Column) -> DataFrame:
    """Last non-null value per group in ``order`` (``max_by``, partial)."""
    o = F.col(order) if isinstance(order, str) else order
    return df.where(F.col(value).isNotNull()).groupBy(*by).agg(F.max_by(value, o).alias(value))


def check_expected_counts(actual: DataFrame, expected: DataFrame, by: Sequence[str],
                          actual_col: str = "n_rows", expected_col: str = "expected") -> DataFrame:
    """Groups whose row count differs from the documented count (either side
    missing counts as a difference)."""
    j = actual.join(expected, list(by), "full_outer")
    return j.where(~F.col(actual_col).eqNullSafe(F.col(expected_col)))


def check_conservation(metrics: DataFrame, truth_counts: DataFrame, keys: Sequence[str],
                       truth_col: str = "n_truth") -> DataFrame:
    """matched + missed must equal the truth rows of the group."""
    j = metrics.join(truth_counts, list(keys), "full_outer")
    total = F.coalesce(F.col("n_retrieved"), F.lit(0)) + F.coalesce(F.col("n_missed"), F.lit(0))
    return j.where(total != F.coalesce(F.col(truth_col), F.lit(0)))


def check_metric_bounds(metrics: DataFrame, cols: Sequence[str] = ("recall", "precision"),
                        equal_pairs: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """Ratios outside [0, 1]; pairs that must be equal (cut-off recall)."""
    bad = None
    for c in cols:
        v = (F.col(c) < 0) | (F.col(c) > 1)
        bad = v if bad is None else bad | v
    for a, b in equal_pairs:
        v = ~F.col(a).eqNullSafe(F.col(b))
        bad = v if bad is None else bad | v
    return metrics.where(bad)


def embedding_coverage(vectors: DataFrame, expected: DataFrame, by: Sequence[str],
                       vec_col: str = "embedding", dim: int | None = None) -> DataFrame:
    """Per table/space: rows, non-null vectors, expected rows, and whether the
    embeddings must be rebuilt (fewer rows or null/wrong-size vectors)."""
    ok = F.col(vec_col).isNotNull()
    if dim is not None:
        ok = ok & (F.size(vec_col) == dim)
    c = vectors.groupBy(*by).agg(F.count(F.lit(1)).alias("n_rows"),
                                 F.count_if(ok).alias("n_vectors"))
    j = c.join(expected, list(by), "full_outer").fillna(0, subset=["n_rows", "n_vectors"])
    rebuild = (F.col("n_rows") < F.coalesce(F.col("expected"), F.lit(0))) | (F.col("n_vectors") < F.col("n_rows"))
    return j.withColumn("needs_rebuild", rebuild)


def check_table_equality(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that two tables do not hold equally often, with both counts (null
    keys are equal to each other)."""
    both = left.select(*keys, F.lit(1).alias("_l"), F.lit(0).alias("_r")).unionByName(
        right.select(*keys, F.lit(0).alias("_l"), F.lit(1).alias("_r")))
    n = both.groupBy(*keys).agg(F.sum("_l").alias("n_left"), F.sum("_r").alias("n_right"))
    return n.where(F.col("n_left") != F.col("n_right"))


def check_fan_out(fanned: DataFrame, strategies: DataFrame, reviews: DataFrame, shots: int) -> DataFrame:
    """Fan-out size must be strategies x reviews x shots (three one-row counts
    side by side; nothing is counted on the driver)."""
    n = [df.agg(F.count(F.lit(1)).alias(c)) for df, c in ((fanned, "n_rows"), (strategies, "_s"), (reviews, "_r"))]
    j = n[0].crossJoin(n[1]).crossJoin(n[2])
    return j.select("n_rows", (F.col("_s") * F.col("_r") * shots).alias("expected")).where("n_rows <> expected")
