"""Report-layer tables over metric results: totals with significant
figures, medians/IQR, pivots, NNR change, log transforms, labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.metrics import ratio, signif


def log_with_epsilon(df: DataFrame, cols: Sequence[str], floor: float = 1e-6,
                     prefix: str = "log_") -> DataFrame:
    """``log(x + eps)`` with a per-column eps = max(min positive / 10, floor).

    The eps values are one global aggregate (a single row); they are read as
    scalars and folded into the projection."""
    aggs = [F.greatest(F.min(F.when(F.col(c) > 0, F.col(c))) / 10.0, F.lit(floor)).alias(c) for c in cols]
    eps = df.agg(*aggs).first()
    out = df
    for c in cols:
        e = eps[c] if eps[c] is not None else floor
        out = out.withColumn(f"{prefix}{c}", F.log(F.col(c) + F.lit(float(e))))
    return out


def guideline_totals(df: DataFrame, by: Sequence[str], digits: int = 4) -> DataFrame:
    """Whole-guideline totals, then ratios rounded to ``digits`` significant
    figures at each step (NNR uses the rounded precision)."""
    t = df.groupBy(*by).agg(
        F.sum("n_retrieved").alias("n_retrieved"), F.sum("n_missed").alias("n_missed"),
        F.sum("overall_screening_workload").alias("overall_screening_workload"))
    recall = signif(ratio("n_retrieved", F.col("n_retrieved") + F.col("n_missed")), digits)
    precision = signif(ratio("n_retrieved", "overall_screening_workload"), digits)
    return t.withColumn("recall", recall).withColumn("precision", precision) \
        .withColumn("nnr", signif(ratio(F.lit(1.0), F.col("precision")), digits))


def median_iqr(df: DataFrame, by: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Median and inter-quartile range (linear interpolation) per group."""
    aggs = []
    for c in cols:
        aggs.append(F.percentile(F.col(c).cast("double"), [0.25, 0.5, 0.75]).alias(f"_{c}_q"))
    t = df.groupBy(*by).agg(*aggs)
    sel = list(by)
    for c in cols:
        q = F.col(f"_{c}_q")
        sel += [q[1].alias(f"{c}_median"), q[0].alias(f"{c}_q1"), q[2].alias(f"{c}_q3"),
                (q[2] - q[0]).alias(f"{c}_iqr")]
    return t.select(*sel)


def zero_counts(df: DataFrame, row_key: str, pivot_col: str, values: Sequence[str],
                count_col: str = "n_retrieved") -> DataFrame:
    """Topics with nothing retrieved, counted per row key x pivot value; the
    pivot values are listed, so no extra job discovers them; missing = 0."""
    z = df.where(F.col(count_col) == 0)
    return z.groupBy(row_key).pivot(pivot_col, list(values)).count().fillna(0, subset=list(values))


def workflow_pivot(df: DataFrame, by: Sequence[str], pivot_col: str, values: Sequence[str],
                   value_col: str) -> DataFrame:
    """One column per workflow; a missing combination stays null (N/A)."""
    return df.groupBy(*by).pivot(pivot_col, list(values)).agg(F.first(value_col, ignorenulls=True))


def nnr_change(df: DataFrame, key: Sequence[str], group_col: str, base: str, new: str,
               value_col: str = "nnr") -> DataFrame:
    """NNR of ``new`` minus NNR of ``base`` per key (both present and > 0)."""
    b = df.where((F.col(group_col) == base) & (F.col(value_col) > 0)) \
        .select(*key, F.col(value_col).alias("base_value"))
    n = df.where((F.col(group_col) == new) & (F.col(value_col) > 0)) \
        .select(*key, F.col(value_col).alias("new_value"))
    j = b.join(n, list(key), "inner")
    return j.withColumn("change", F.col("new_value") - F.col("base_value")) \
        .withColumn("change_pct", ratio(F.col("change") * 100.0, "base_value"))


def mean_change(changes: DataFrame, by: Sequence[str]) -> DataFrame:
    return changes.groupBy(*by).agg(F.avg("change").alias("mean_change"),
                                    F.avg("change_pct").alias("mean_change_pct"),
                                    F.count(F.lit(1)).alias("n_pairs"))


def prefer_cutoff(df: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Report the cut-off version of each metric under the base name."""
    out = df
    for m in metrics:
        if f"{m}_cutoff" in df.columns:
            out = out.drop(m).withColumnRenamed(f"{m}_cutoff", m)
    return out


def fill_nnr(df: DataFrame, nnr: str = "nnr", precision: str = "precision") -> DataFrame:
    """Missing NNR -> 1/precision."""
    return df.withColumn(nnr, F.coalesce(F.col(nnr), ratio(F.lit(1.0), F.col(precision))))


def label_workflow(df: DataFrame, workflow_col: str = "workflow", scenario_col: str | None = None,
                   database_col: str = "database") -> DataFrame:
    """Display labels: capitalised database and 'workflow + scenario'."""
    out = df.withColumn("database_label", F.initcap(F.col(database_col)))
    if scenario_col:
        out = out.withColumn("workflow_group", F.concat_ws(" + ", F.col(workflow_col), F.col(scenario_col)))
    return out


def zero_fill(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Report layer only: undefined metrics (null) shown as 0."""
    return df.fillna(0, subset=list(cols))


def order_key(col: str, values: Sequence[str], name: str | None = None):
    """Explicit category order as a sortable column (unknown values last)."""
    expr = F.array_position(F.array(*[F.lit(v) for v in values]), F.col(col))
    return F.when(expr > 0, expr).otherwise(F.lit(len(values) + 1)).cast("int").alias(name or f"{col}_order")


def reference_first(group_col: str, reference: str) -> list:
    """Order keys of a contrast table: the reference group, then the others by name."""
    return [(F.col(group_col) == reference).desc(), F.col(group_col).asc()]


def percent_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.select("*", *[(F.col(c) * 100.0).alias(f"{c}_pct") for c in cols])


def null_report(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Null count per column and rows with any null, in one aggregate."""
    cols = list(cols or df.columns)
    any_null = F.lit(False)
    for c in cols:
        any_null = any_null | F.col(c).isNull()
    aggs = [F.count_if(F.col(c).isNull()).alias(c) for c in cols]
    wide = df.agg(F.count(F.lit(1)).alias("_rows"), F.count_if(any_null).alias("_any"), *aggs)
    stack = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("n_null")) for c in cols]))
    return wide.select(F.col("_rows").alias("n_rows"), F.col("_any").alias("rows_with_null"), stack.alias("s")) \
        .select("s.column", "s.n_null", "n_rows", "rows_with_null")


def combined_table(summary: DataFrame, contrasts: DataFrame, keys: Sequence[str],
                   reference_label: str, group_col: str = "group") -> DataFrame:
    """Summary rows left-joined to contrasts; the reference group is
    labelled and has no contrast."""
    j = summary.join(contrasts, list(keys), "left")
    return j.withColumn("is_reference", F.col(group_col) == reference_label) \
        .withColumn("contrast", F.when(F.col("is_reference"), F.lit("reference"))
                    .otherwise(F.concat(F.col(group_col), F.lit(" vs "), F.lit(reference_label))))


def published_totals(metrics: DataFrame, by: Sequence[str], digits: int = 4) -> DataFrame:
    """Whole-guideline totals of ranked results, raw and adjusted side by side.

    Sums over the reviews first; then recall, precision against the cut-off
    workload, NNR and F1-F3, each rounded to ``digits`` significant figures and
    computed from the rounded ones before it.  A precision of zero gives an
    infinite NNR, a zero denominator an F of zero."""
    def total(col: str, kind: str):
        return F.sum(F.when(F.col("truth_kind") == kind, F.col(col))).cast("double")

    t = metrics.groupBy(*by).agg(
        total("overall_screening_workload_cutoff", "raw").alias("_workload"),
        *[total(c, kind).alias(f"_{c}_{kind}") for c in ("n_retrieved", "n_missed") for kind in ("raw", "adjusted")])
    out = list(by)
    for kind, suffix in (("raw", ""), ("adjusted", "_adjusted")):
        found, missed = F.col(f"_n_retrieved_{kind}"), F.col(f"_n_missed_{kind}")
        t = t.withColumn(f"recall{suffix}", signif(ratio(found, found + missed), digits))
        t = t.withColumn(f"precision{suffix}", signif(ratio(found, "_workload"), digits))
        r, p = F.col(f"recall{suffix}"), F.col(f"precision{suffix}")
        t = t.withColumn(f"nnr{suffix}", F.when(p == 0, F.lit(float("inf"))).otherwise(signif(ratio(F.lit(1.0), p), digits)))
        out += [f"recall{suffix}", f"precision{suffix}", f"nnr{suffix}"]
        for beta in (1, 2, 3):
            b2 = float(beta * beta)
            t = t.withColumn(f"f{beta}_score{suffix}", F.when(
                b2 * p + r > 0, signif((1 + b2) * p * r / (b2 * p + r), digits)).otherwise(0.0))
            out.append(f"f{beta}_score{suffix}")
    return t.select(*out)


def ranking_change(metrics: DataFrame, keys: Sequence[str]) -> DataFrame:
    """NNR at the cut-off minus NNR of the whole ranking, and in per cent of it."""
    change = F.col("nnr_cutoff") - F.col("nnr_raw")
    return metrics.select(*keys, change.alias("nnr_change"), (ratio(change, "nnr_raw") * 100.0).alias("nnr_change_pct"))


def pre_ranking_change(ranked: DataFrame, before: DataFrame, keys: Sequence[str]) -> DataFrame:
    """NNR before ranking (``nnr_before``) minus that after (``nnr``), by key;
    rows whose baseline is zero are left out, undefined ones stay."""
    j = ranked.join(before, list(keys)).where(F.coalesce(F.col("nnr_before") != 0, F.lit(True)))
    change = F.col("nnr_before") - F.col("nnr")
    return j.select(*keys, change.alias("nnr_change"), (ratio(change, "nnr_before") * 100.0).alias("nnr_change_pct"))
