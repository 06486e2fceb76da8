"""Row numbers inside groups that may be arbitrarily large.

``Window.partitionBy(g).orderBy(...)`` puts a whole group in one task. A
ranking group here is "every document of a search space for one query",
so one group can hold a large share of all rows.  ``ordinal`` therefore
ranks with a range shuffle instead:

1. ``repartitionByRange`` on (group, order) splits even a single huge group
   over many tasks; ``sortWithinPartitions`` orders each task's slice.
2. Each row gets its position inside its task; the result is checkpointed
   (reliable, to ``spark.checkpoint.dir``) so sampled range bounds and
   positions can never change under recomputation after executor loss.
3. A small table of (task, group) -> first position, row count is prefix-
   summed per group; its size is at most tasks + groups, and the join is left
   to the optimiser.  Null group keys are groups like any other.

``method="window"`` is the plain window: the twin that tests compare with.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

def _cols(cs) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in cs]


def ordinal(df: DataFrame, by: Sequence[str], order: Sequence[Column | str],
            name: str = "rank", method: str = "range",
            num_partitions: int | None = None) -> DataFrame:
    """Add ``name`` = 1-based row number of each row within ``by`` by ``order``.

    ``order`` must be a total order inside each group (add a unique id as
    the last key) so the result is deterministic.
    """
    by = list(by)
    order = _cols(order)
    if method == "window":
        w = Window.partitionBy(*by).orderBy(*order)
        return df.withColumn(name, F.row_number().over(w).cast("long"))
    if method != "range":
        raise ValueError(f"unknown ordinal method {method!r}")

    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(c).asc_nulls_first() for c in by] + order
    cols = df.columns
    placed = (
        df.repartitionByRange(n, *keys)
        .sortWithinPartitions(*keys)
        .withColumn("_pid", F.spark_partition_id())
        .withColumn("_pos", F.monotonically_increasing_id())
        .checkpoint(eager=True)
    )
    spans = placed.groupBy("_pid", *by).agg(
        F.min("_pos").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*by).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = spans.select(
        "_pid", *by, "_first",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    keyed = offsets.select(F.col("_pid").alias("_p"), *[F.col(c).alias(f"_k{i}") for i, c in enumerate(by)],
                           "_first", "_before")
    same = placed["_pid"] == keyed["_p"]
    for i, c in enumerate(by):
        same = same & placed[c].eqNullSafe(keyed[f"_k{i}"])
    joined = placed.join(keyed, on=same, how="inner")
    rank = (F.col("_pos") - F.col("_first") + F.col("_before") + 1).cast("long")
    return joined.select(*[placed[c] for c in cols], rank.alias(name))


def top_k(df: DataFrame, by: Sequence[str], order: Sequence[Column | str], k: int,
          name: str = "rank") -> DataFrame:
    """First ``k`` rows per group; ``row_number() <= k`` is planned as a
    WindowGroupLimit, so each map task keeps only k rows per group before the
    shuffle — a hot group never reaches one task whole."""
    w = Window.partitionBy(*by).orderBy(*_cols(order))
    return df.withColumn(name, F.row_number().over(w).cast("long")).where(F.col(name) <= k)
