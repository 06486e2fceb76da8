"""Writers: Parquet/CSV outputs, per-question folders, run appends, and the
build-or-reuse stage helper."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators.ordinal import top_k
from ..operators.registry import upsert
from ..session import stored_once

# what a read of a table that was never written fails with
_ABSENT = {"PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"}


def stored(spark: SparkSession, path: str) -> DataFrame | None:
    """The Parquet table at ``path``; None if there is none.  Any other failure
    is raised, so that an unreadable table is never taken for an absent one."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in _ABSENT:
            return None
        raise


def path_safe(col: str | Column) -> Column:
    """Question id usable as a folder name ('.', '/', '\\' -> '_')."""
    c = F.col(col) if isinstance(col, str) else col
    return F.regexp_replace(c, r"[./\\]", "_")


def write_table(df: DataFrame, path: str, mode: str = "overwrite", fmt: str = "parquet",
                partition_by: Sequence[str] = (), run_id: str | None = None) -> None:
    """One writer for every output; ``run_id`` tags appended runs."""
    out = df.withColumn("run_id", F.lit(run_id)) if run_id is not None else df
    w = out.write.mode(mode).format(fmt)
    if fmt == "csv":
        w = w.option("header", True)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)


def write_sorted(df: DataFrame, path: str, order: Sequence[str | Column], mode: str = "overwrite") -> None:
    """Ordered output: the part files in name order hold the rows in ``order``
    (one range exchange, each file sorted)."""
    df.orderBy(*order).write.mode(mode).parquet(path)


def write_per_question(df: DataFrame, path: str, question_col: str = "question_id",
                       kind_col: str = "truth_kind") -> None:
    """Matched/missed rows in one folder per (question, raw|adjusted)."""
    out = df.withColumn("question_key", path_safe(question_col))
    out.write.mode("overwrite").partitionBy("question_key", kind_col).parquet(path)


def stage(spark: SparkSession, path: str, build: Callable[[], DataFrame],
          refresh: bool = False) -> DataFrame:
    """Reuse a stored stage unless ``refresh``; otherwise build, write, and
    read back (the written table also cuts the lineage)."""
    if not refresh:
        found = stored(spark, path)
        if found is not None:
            return found
    build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def first_per_key(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per key: the first by the hash of the whole row."""
    whole = F.xxhash64(*[F.to_json(F.struct(*df.columns))])
    return top_k(df, keys, [whole.asc()], 1, name="_rn").drop("_rn")


def not_stored(df: DataFrame, existing: DataFrame | None, keys: Sequence[str]) -> DataFrame:
    """Rows whose key ``existing`` does not hold; null keys are equal to each other."""
    if existing is None:
        return df
    e = existing.select(*[F.col(k).alias(f"_e{i}") for i, k in enumerate(keys)])
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & df[k].eqNullSafe(e[f"_e{i}"])
    return df.join(e, same, "left_anti")


def append_new(df: DataFrame, path: str, keys: Sequence[str], spark: SparkSession) -> int:
    """Append one row per key that is not stored yet (idempotent re-runs; null
    keys are equal to each other).  Returns the number of appended rows, which the
    write itself counts."""
    new = not_stored(first_per_key(df, keys), stored(spark, path), keys)
    written = Observation()
    new.observe(written, F.count(F.lit(1)).alias("n")).write.mode("append").parquet(path)
    return written.get["n"]


BUCKET = "_bucket"


def _bucketed(df: DataFrame, keys: Sequence[str], buckets: int) -> DataFrame:
    return df.withColumn(BUCKET, F.pmod(F.xxhash64(*[F.col(k).cast("string") for k in keys]), F.lit(buckets)).cast("int"))


def _write_buckets(df: DataFrame, path: str) -> None:
    (df.repartition(BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(BUCKET).parquet(path))


def upsert_bucketed(updates: DataFrame, path: str, keys: Sequence[str], buckets: int,
                    version_col: str | None = None) -> list[int]:
    """Upsert into a Parquet table whose rows lie in ``buckets`` folders by the hash
    of their key: only folders that hold a key of ``updates`` are read and written
    again, all others keep their files.  Returns the folders written.

    Of the rows of a key (null is a key) one stays, as ``registry.upsert`` chooses.
    A table that is not there yet is begun.  The new rows are stored before any
    folder is replaced, so a lost executor never reads what is being replaced, and
    running the same updates again changes nothing."""
    spark = updates.sparkSession
    new = stored_once(_bucketed(updates, keys, buckets))
    touched = sorted(r[0] for r in new.select(BUCKET).distinct().collect())        # at most ``buckets`` numbers
    base = stored(spark, path)
    if not touched:
        return []
    old = new.limit(0) if base is None else base.where(F.col(BUCKET).isin(touched))
    _write_buckets(stored_once(upsert(old, new, keys, version_col)), path)
    return touched
