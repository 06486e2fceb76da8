"""Strategy registry and idempotent table maintenance: new keys only,
null-safe new rows, upserts, surrogate ids, strategy fan-out."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordinal import ordinal, top_k


def new_rows(df: DataFrame, existing: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key is not in ``existing`` (``NOT EXISTS``)."""
    return df.join(existing.select(*keys), on=list(keys), how="left_anti")


def new_rows_null_safe(df: DataFrame, existing: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows with no equal row in ``existing`` where null equals null on every
    column (``IS NOT DISTINCT FROM``)."""
    e = existing.select(*[F.col(c).alias(f"_e_{c}") for c in cols])
    cond = reduce(lambda a, b: a & b, [df[c].eqNullSafe(e[f"_e_{c}"]) for c in cols])
    return df.join(e, on=cond, how="left_anti")


def whole_row(df: DataFrame, without: Sequence[str] = ()) -> Column:
    """A row as one value that orders rows: its columns by name; a map as its
    sorted entries, as maps have no order."""
    cols = [F.array_sort(F.map_entries(f.name)) if f.dataType.typeName() == "map" else F.col(f.name)
            for f in sorted(df.schema.fields, key=lambda f: f.name) if f.name not in without]
    return F.struct(*[c.alias(f"_{i}") for i, c in enumerate(cols)])


def upsert(base: DataFrame, updates: DataFrame, keys: Sequence[str],
           version_col: str | None = None) -> DataFrame:
    """Base rows replaced by updates with the same key (null equals null): the
    newest version wins, an update before a base row, and of several the greatest
    whole row, so that one input gives one answer in any order.  Top-1 per key
    is a WindowGroupLimit, so a key with many versions is cut map-side."""
    b = base.withColumn("_src", F.lit(0))
    u = updates.withColumn("_src", F.lit(1))
    allrows = b.unionByName(u, allowMissingColumns=True)
    order: list[Column] = []
    if version_col:
        order.append(F.col(version_col).desc_nulls_last())
    order += [F.col("_src").desc(), whole_row(allrows, [*keys, "_src"]).desc()]
    return top_k(allrows, keys, order, 1, name="_rn").drop("_rn", "_src")


def assign_ids(df: DataFrame, order: Sequence[Column | str], start_after: int | Column = 0,
               name: str = "id") -> DataFrame:
    """Surrogate ids ``start_after + 1, 2, ...`` in ``order`` (distributed
    ordinal: no single-partition window)."""
    ranked = ordinal(df, [], order, name="_ord", method="range")
    base = start_after if isinstance(start_after, Column) else F.lit(int(start_after))
    return ranked.withColumn(name, (base + F.col("_ord")).cast("long")).drop("_ord")


def max_id(df: DataFrame, col: str) -> int:
    """``coalesce(max(id), 0)`` of an existing table (a scalar aggregate)."""
    return int(df.agg(F.coalesce(F.max(col), F.lit(0))).first()[0])


def fan_out(strategies: DataFrame, reviews: DataFrame, shots: Sequence[str],
            review_col: str = "review_id") -> DataFrame:
    """Broad strategies become one strategy per (review, shot).

    The product of two dimensions is what is asked for: every strategy with
    every distinct review (a null review is one, too).  Neither side goes
    through the driver."""
    ids = reviews.select(review_col).distinct()
    out = strategies.crossJoin(ids)
    return out.withColumn("vector_search", F.explode(F.array(*[F.lit(s) for s in shots])))


def register(strategies: DataFrame, reviews: DataFrame, shots: Sequence[str], existing: DataFrame,
             keys: Sequence[str], id_col: str = "search_strategy_id") -> DataFrame:
    """Strategies to add to ``existing``: one per (strategy, review, shot) that is
    not there yet (null equals null), with the ids after the largest stored one.
    Registering the same strategies again adds nothing."""
    wanted = fan_out(strategies, reviews, shots).select(*keys).distinct()
    return assign_ids(new_rows_null_safe(wanted, existing, keys), keys, max_id(existing, id_col), name=id_col)


def load_results(results: DataFrame, strategies: DataFrame, existing: DataFrame | None,
                 strategy_keys: Sequence[str], key: Sequence[str] = ("search_strategy_id", "original_id"),
                 order: Sequence[Column | str] = ("original_id",),
                 id_col: str = "search_result_article_id") -> DataFrame:
    """Search results ready to append: each result gets its strategy id (join
    on the strategy descriptor), rows already stored are skipped, new rows
    get surrogate ids after the stored maximum."""
    r = results.join(strategies.select(*strategy_keys, "search_strategy_id"), list(strategy_keys), "inner")
    start = 0
    if existing is not None:
        r = new_rows(r, existing, key)
        start = max_id(existing, id_col)
    return assign_ids(r, ["search_strategy_id", *order], start, name=id_col)


def with_overall_row(dim: DataFrame, key: str, values: dict | None = None) -> DataFrame:
    """Dimension plus one constant ``overall`` row (other columns from
    ``values`` or null)."""
    values = values or {}
    row = dim.sparkSession.range(1).select(*[
        (F.lit("overall") if f.name == key else F.lit(values.get(f.name))).cast(f.dataType).alias(f.name)
        for f in dim.schema.fields])
    return dim.unionByName(row)
