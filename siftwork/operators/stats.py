"""Paired comparisons of workflows: differences, Wilcoxon signed-rank,
Benjamini-Hochberg, effect ratios and log-ratio contrasts.

All of it is aggregates and distributed scans over the per-topic metric table;
the normal CDF is a closed-form polynomial, and the exact signed-rank
distribution an array built in the row, so it stays JVM-side.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.metrics import ratio
from .scan import Placed, average_ranks

# fixed values: Abramowitz & Stegun 26.2.17 coefficients for the normal CDF
_AS_P = 0.2316419
_AS_B = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)
_INV_SQRT_2PI = 0.3989422804014327


def normal_sf(z: Column) -> Column:
    """Upper tail P(Z > z) for z >= 0 (|error| < 7.5e-8)."""
    t = 1.0 / (1.0 + _AS_P * z)
    poly = t * (_AS_B[0] + t * (_AS_B[1] + t * (_AS_B[2] + t * (_AS_B[3] + t * _AS_B[4]))))
    return F.exp(-z * z / 2.0) * _INV_SQRT_2PI * poly


def paired(df: DataFrame, key: Sequence[str], group_col: str, a: str, b: str,
           value_col: str) -> DataFrame:
    """Values of group ``a`` and ``b`` side by side per ``key`` (topics
    present in both; one row per key and group is expected); ``diff`` = b - a.
    One aggregation instead of joining two filtered copies."""
    g = df.where(F.col(group_col).isin(a, b)).groupBy(*key).agg(
        F.max(F.when(F.col(group_col) == a, F.col(value_col))).alias("value_a"),
        F.max(F.when(F.col(group_col) == b, F.col(value_col))).alias("value_b"),
        F.count_if(F.col(group_col) == a).alias("_na"), F.count_if(F.col(group_col) == b).alias("_nb"))
    return g.where((F.col("_na") > 0) & (F.col("_nb") > 0)).drop("_na", "_nb") \
        .withColumn("diff", F.col("value_b") - F.col("value_a"))


EXACT_UP_TO = 50


def signed_rank_p(n: Column, w: Column) -> Column:
    """Two-sided exact p of a signed-rank sum ``w`` (the smaller one) of ``n``
    differences without ties: every sign pattern is as likely, and the number of
    patterns of each sum is built up rank by rank, each rank shifting the counts so
    far.  Counts are whole numbers below 2**n, so doubles hold them for n up to 50."""
    counts = F.aggregate(
        F.sequence(F.lit(1), n.cast("int")), F.array(F.lit(1.0)),
        lambda so_far, rank: F.zip_with(F.concat(so_far, F.array_repeat(F.lit(0.0), rank)),
                                        F.concat(F.array_repeat(F.lit(0.0), rank), so_far), lambda a, b: a + b))
    below = F.aggregate(F.slice(counts, F.lit(1), w.cast("int") + 1), F.lit(0.0), lambda a, b: a + b)
    return F.least(F.lit(1.0), 2.0 * below / F.pow(F.lit(2.0), n))


def wilcoxon(pairs: DataFrame, by: Sequence[str], diff_col: str = "diff") -> DataFrame:
    """Two-sided Wilcoxon signed-rank test per group.

    Zero differences are dropped; tied |d| get average ranks; W = min(W+, W-).
    Up to ``EXACT_UP_TO`` differences without ties and zeros p is exact, else it is
    the normal approximation with tie correction (no continuity correction);
    ``p_method`` says which.  Differences are summed per size before they are
    ranked, and ranks are a distributed running sum, so no group needs one task."""
    d = F.col(diff_col)
    known = pairs.where(d.isNotNull()).withColumn("_a", F.abs(d))
    ranked = average_ranks(known.where(d != 0), by, "_a", {"_plus": F.count_if(d > 0), "_minus": F.count_if(d < 0)})
    s = ranked.groupBy(*by).agg(
        F.sum("ties").alias("n"),
        F.sum(F.col("rank") * F.col("_plus")).alias("w_plus"),
        F.sum(F.col("rank") * F.col("_minus")).alias("w_minus"),
        F.sum(F.col("ties").cast("double") * (F.col("ties") * F.col("ties") - 1)).alias("_tc"))
    zeros = known.where(d == 0).select(*[F.col(c).alias(f"_z{i}") for i, c in enumerate(by)]).distinct().withColumn("_zero", F.lit(True))
    same = F.lit(True)
    for i, c in enumerate(by):
        same = same & s[c].eqNullSafe(zeros[f"_z{i}"])
    s = s.join(zeros, same, "left")
    n = F.col("n").cast("double")
    mean = n * (n + 1) / 4.0
    var = n * (n + 1) * (2 * n + 1) / 24.0 - F.col("_tc") / 48.0
    w = F.least("w_plus", "w_minus")
    z = F.when(var > 0, (w - mean) / F.sqrt(var))
    exact = (F.col("n") <= EXACT_UP_TO) & (F.col("_tc") == 0) & F.col("_zero").isNull()
    p = F.when(exact, signed_rank_p(F.least(F.col("n"), F.lit(EXACT_UP_TO)), w)).otherwise(F.least(F.lit(1.0), 2.0 * normal_sf(F.abs(z))))
    return s.select(*by, F.col("n").cast("long").alias("n"), "w_plus", "w_minus", w.alias("w"), z.alias("z"),
                    p.alias("p_value"), F.when(exact, "exact").otherwise("normal").alias("p_method"))


def bh_adjust(df: DataFrame, p_col: str = "p_value", by: Sequence[str] = (),
              order_key: Sequence[str] = (), out_col: str = "p_adjusted") -> DataFrame:
    """Benjamini-Hochberg: least(1, min over j >= i of p_j * m / j), ranks by
    p ascending (ties by ``order_key``, which must tell rows of a family apart).
    Ranks and the minimum from the end are distributed scans, so a family of any
    size is spread over tasks."""
    order = [F.col(p_col).asc()] + [F.col(c).asc() for c in order_key]
    placed = Placed(df, by, order).running_sum(F.lit(1), "_i").total(F.lit(1), "_m")
    out = placed.suffix_min(F.col(p_col) * F.col("_m") / F.col("_i"), "_q").rows()
    return out.withColumn(out_col, F.least(F.lit(1.0), F.col("_q"))).drop("_i", "_m", "_q")


def significance_code(p: str | Column) -> Column:
    c = F.col(p) if isinstance(p, str) else p
    return (F.when(c < 0.001, "***").when(c < 0.01, "**").when(c < 0.05, "*")
            .when(c < 0.1, ".").otherwise(""))


def p_text(p: str | Column) -> Column:
    """``<0.01`` up to and including 0.01, else six decimals; null for no p."""
    c = F.col(p) if isinstance(p, str) else p
    return F.when(c <= 0.01, F.lit("<0.01")).when(c > 0.01, F.format_string("%.6f", c))


def ratio_effects(df: DataFrame, est: str = "estimate", lo: str = "lower", hi: str = "upper") -> DataFrame:
    """Log-scale estimate and CI -> ratio, percent change, direction."""
    r = F.exp(est)
    return df.withColumn("ratio", r).withColumn("ratio_lower", F.exp(lo)) \
        .withColumn("ratio_upper", F.exp(hi)).withColumn("pct_change", (r - 1.0) * 100.0) \
        .withColumn("direction", F.when(F.col(est) > 0, "higher").when(F.col(est) < 0, "lower")
                    .otherwise("no change"))


def log_ratio_contrast(pairs: DataFrame, by: Sequence[str], eps: float = 1e-6) -> DataFrame:
    """Within-topic contrast of group b vs a on the log scale: mean, sd, n,
    standard error and a normal 95% interval of log((b+eps)/(a+eps))."""
    lr = pairs.withColumn("_lr", F.log(F.col("value_b") + eps) - F.log(F.col("value_a") + eps))
    s = lr.groupBy(*by).agg(F.avg("_lr").alias("estimate"), F.stddev_samp("_lr").alias("sd"),
                            F.count(F.lit(1)).alias("n"))
    se = ratio(F.col("sd"), F.sqrt(F.col("n").cast("double")))
    return s.withColumn("se", se).withColumn("lower", F.col("estimate") - 1.959963984540054 * F.col("se")) \
        .withColumn("upper", F.col("estimate") + 1.959963984540054 * F.col("se"))
