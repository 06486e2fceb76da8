"""Running sums and minima over groups that may be arbitrarily large.

``sum(...) over (partition by g order by x)`` holds a group in one task.  Here rows
are range-partitioned on (group, order), each task scans its slice, and a table of
one row a task and group, scanned in turn, says what the slices before (or behind)
add.  The placement is written to the checkpoint folder, so that a row stays in its
slice whatever is computed again.  Null groups are groups like any other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir


class Placed:
    """``df`` in order within ``by``, dealt to slices; ``order`` must be total within a group."""

    def __init__(self, df: DataFrame, by: Sequence[str], order: Sequence[Column], parts: int | None = None):
        ensure_checkpoint_dir(df.sparkSession)
        n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        keys = [F.col(c).asc_nulls_first() for c in by] + list(order)
        self.by, self.columns = list(by), list(df.columns)
        self.df = (df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
                   .withColumn("_slice", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id())
                   .checkpoint(eager=True))

    def _with(self, name: str, own: Column, whole: Column, rest: Column, join: Column) -> Placed:
        """Adds ``name``: ``own`` inside the slice, with what ``rest`` makes of the
        other slices' ``whole`` joined to it."""
        spans = self.df.groupBy("_slice", *self.by).agg(whole.alias("_whole"))
        spans = spans.select(F.col("_slice").alias("_s"), *[F.col(c).alias(f"_k{i}") for i, c in enumerate(self.by)], "_whole")
        spans = spans.withColumn("_rest", rest).drop("_whole")
        d = self.df.withColumn("_own", own)
        same = d["_slice"] == spans["_s"]
        for i, c in enumerate(self.by):
            same = same & d[c].eqNullSafe(spans[f"_k{i}"])
        out = d.join(spans, same).withColumn(name, join)
        new = object.__new__(Placed)
        new.by, new.columns = self.by, [*(c for c in self.columns if c != name), name]
        new.df = out.select(*new.columns, "_slice", "_at")
        return new

    def _groups(self) -> list[str]:
        return [f"_k{i}" for i in range(len(self.by))]

    def running_sum(self, value: str | Column, name: str) -> Placed:
        """Sum over the rows up to and with this one."""
        v = F.col(value) if isinstance(value, str) else value
        inside = Window.partitionBy("_slice", *self.by).orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
        before = Window.partitionBy(*self._groups()).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
        return self._with(name, F.sum(v).over(inside), F.sum(v), F.sum("_whole").over(before),
                          F.col("_own") + F.coalesce(F.col("_rest"), F.lit(0)))

    def total(self, value: str | Column, name: str) -> Placed:
        """Sum over the whole group."""
        v = F.col(value) if isinstance(value, str) else value
        return self._with(name, F.lit(0), F.sum(v), F.sum("_whole").over(Window.partitionBy(*self._groups())), F.col("_rest"))

    def suffix_min(self, value: str | Column, name: str) -> Placed:
        """Least over this row and all behind it (nulls take no part): a running
        minimum from the end, since a frame without end is read anew for every row."""
        v = F.col(value) if isinstance(value, str) else value
        inside = Window.partitionBy("_slice", *self.by).orderBy(F.col("_at").desc()).rowsBetween(Window.unboundedPreceding, 0)
        behind = Window.partitionBy(*self._groups()).orderBy(F.col("_s").desc()).rowsBetween(Window.unboundedPreceding, -1)
        return self._with(name, F.min(v).over(inside), F.min(v), F.min("_whole").over(behind), F.least("_own", "_rest"))

    def rows(self) -> DataFrame:
        return self.df.select(*self.columns)


def average_ranks(df: DataFrame, by: Sequence[str], value: str, sums: dict[str, Column]) -> DataFrame:
    """One row per (by, value): ``ties`` rows share it, at the average ``rank``;
    ``sums`` are further aggregates of those rows.  A value that many rows share is
    summed before it is shuffled."""
    each = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("ties"), *[c.alias(n) for n, c in sums.items()])
    placed = Placed(each, by, [F.col(value).asc()]).running_sum("ties", "_to")
    return placed.rows().withColumn("rank", F.col("_to") - (F.col("ties") - 1) / 2.0).drop("_to")
