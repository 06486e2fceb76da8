"""Exact quantiles of groups that may be arbitrarily large.

``percentile`` gathers a group's values in one task.  Here the two order statistics
around each quantile are found by selection: every round counts, for all groups at
once, the values that fall into the bins of the statistic's present interval, and
goes on with the bin that holds its rank.  A bin's own least and greatest value
bound it, so that a round always tells apart what is left, and a bin of one value
ends the search.  Counts are summed before they are shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written_once

BINS = 2048


def _same(a: DataFrame, b: DataFrame, by: Sequence[str]) -> Column:
    out = F.lit(True)
    for i, c in enumerate(by):
        out = out & a[c].eqNullSafe(b[f"_k{i}"])
    return out


def _keyed(df: DataFrame, by: Sequence[str], *rest: str) -> DataFrame:
    return df.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(by)], *rest)


def _share(x: Column, lo: Column, hi: Column) -> Column:
    """Where ``x`` stands in [lo, hi], from 0 to 1, in the order of the values: even
    in the numbers while they are within a factor of two, else even in their
    logarithms, so that an interval of any spread is narrowed in a few rounds."""
    def spread(v):     # logarithms of double numbers lie between -745 and 710
        return F.when(v == 0, 0.0).otherwise(F.signum(v) * (F.log(F.abs(v)) + 750))

    close = ((lo > 0) & (hi / 2 <= lo)) | ((hi < 0) & (lo / 2 >= hi))
    return F.when(close, (x - lo) / (hi - lo)).otherwise((spread(x) - spread(lo)) / (spread(hi) - spread(lo)))


def order_statistics(df: DataFrame, wanted: DataFrame, by: Sequence[str], col: str, bins: int = BINS) -> DataFrame:
    """(by, pos, x): ``wanted`` has (by, pos, lo, hi), pos from 0 among the
    non-null values of the group, all of which lie in [lo, hi]."""
    by = list(by)
    values = df.where(F.col(col).isNotNull()).select(*by, F.col(col).cast("double").alias("_x"))
    # an interval is asked for once, however many positions lie in it
    open_ = written_once(wanted.select(*by, "pos", F.col("pos").alias("_left"), "lo", "hi"))
    done = None
    while True:
        ended = open_.where(F.col("lo") == F.col("hi")).select(*by, "pos", F.col("lo").alias("x"))
        done = ended if done is None else done.unionByName(ended)
        open_ = open_.where(F.col("lo") < F.col("hi"))
        if open_.isEmpty():
            return done
        spans = _keyed(open_.select(*by, "lo", "hi").distinct(), by, "lo", "hi")
        inside = values.join(spans, _same(values, spans, by) & F.col("_x").between(F.col("lo"), F.col("hi")))
        share = _share(F.col("_x"), F.col("lo"), F.col("hi"))
        # the least and the greatest value never share a bin
        bin_ = F.when(F.col("_x") == F.col("hi"), bins - 1).when(F.col("_x") == F.col("lo"), 0).otherwise(
            F.greatest(F.lit(0), F.least(F.floor(share * (bins - 1)), F.lit(bins - 2))))
        counted = inside.groupBy(*by, "lo", "hi", bin_.cast("int").alias("_bin")).agg(
            F.count(F.lit(1)).alias("_n"), F.min("_x").alias("_min"), F.max("_x").alias("_max"))
        # a group's bins are at most ``bins`` rows
        packed = counted.groupBy(*by, "lo", "hi").agg(F.array_sort(F.collect_list(F.struct("_bin", "_n", "_min", "_max"))).alias("_bins"))
        packed = _keyed(packed, by, F.col("lo").alias("_lo"), F.col("hi").alias("_hi"), "_bins")
        j = open_.join(packed, _same(open_, packed, by) & (F.col("lo") == F.col("_lo")) & (F.col("hi") == F.col("_hi")))
        start = F.struct(F.lit(0).cast("long").alias("before"), F.lit(None).cast("double").alias("lo"), F.lit(None).cast("double").alias("hi"))

        def step(acc, b):
            here = acc["lo"].isNull() & (F.col("_left") < acc["before"] + b["_n"])
            return F.struct(F.when(acc["lo"].isNull() & ~here, acc["before"] + b["_n"]).otherwise(acc["before"]).alias("before"),
                            F.when(here, b["_min"]).otherwise(acc["lo"]).alias("lo"), F.when(here, b["_max"]).otherwise(acc["hi"]).alias("hi"))

        found = j.withColumn("_f", F.aggregate("_bins", start, step))
        open_ = written_once(found.select(*by, "pos", (F.col("_left") - F.col("_f.before")).alias("_left"),
                                         F.col("_f.lo").alias("lo"), F.col("_f.hi").alias("hi")))


def exact_quantiles(df: DataFrame, by: Sequence[str], col: str, probs: Sequence[float], bins: int = BINS) -> DataFrame:
    """(by, n, q): n non-null values and the quantiles at ``probs``, interpolated
    linearly, as ``percentile`` does; a group without values has n 0 and nulls.
    NaN is greater than any number and may only be told apart by itself, so
    groups that hold one give NaN quantiles."""
    by = list(by)
    sizes = written_once(df.groupBy(*by).agg(F.count(col).alias("n"), F.min(F.col(col).cast("double")).alias("lo"),
                                            F.max(F.col(col).cast("double")).alias("hi")))
    at = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(p)).alias("p")) for i, p in enumerate(probs)]))
    asked = sizes.where((F.col("n") > 0) & ~F.isnan("hi")).select(*by, "n", "lo", "hi", at.alias("_q")) \
        .withColumn("_at", F.col("_q.p") * (F.col("n") - 1)) \
        .withColumn("_below", F.floor("_at")).withColumn("_above", F.ceil("_at"))
    wanted = asked.select(*by, "lo", "hi", F.explode(F.array("_below", "_above")).alias("pos")).distinct()
    clean = df.where(~F.isnan(F.col(col).cast("double")))
    found = order_statistics(clean, wanted, by, col, bins)
    low, high = _keyed(found, by, F.col("pos").alias("_p0"), F.col("x").alias("_x0")), _keyed(found, by, F.col("pos").alias("_p1"), F.col("x").alias("_x1"))
    both = asked.join(low, _same(asked, low, by) & (F.col("_below") == F.col("_p0"))).select(*asked.columns, "_x0")
    both = both.join(high, _same(both, high, by) & (F.col("_above") == F.col("_p1")))
    value = F.when(F.col("_below") == F.col("_above"), F.col("_x0")).otherwise(
        (F.col("_above") - F.col("_at")) * F.col("_x0") + (F.col("_at") - F.col("_below")) * F.col("_x1"))
    got = both.select(*by, F.col("_q.i").alias("i"), value.alias("v")).groupBy(*by).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda s: s["v"]).alias("q"))
    got = _keyed(got, by, "q")
    nan = F.when(F.isnan("hi"), F.array_repeat(F.lit(float("nan")), len(probs))).otherwise(F.array_repeat(F.lit(None).cast("double"), len(probs)))
    out = sizes.join(got, _same(sizes, got, by), "left")
    return out.select(*by, "n", F.coalesce("q", nan).alias("q"))
