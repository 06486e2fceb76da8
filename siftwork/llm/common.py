"""Helpers that every operator of this folder shares."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, ship_package

# The word patterns of the contracts.
SPACE_CLASS = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE_CLASS}]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
LOWER_BYTES = bytes.maketrans(UPPER.encode(), LOWER.encode())

# gives the Python workers this package
ship = ship_package


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(taken, name: str) -> str:
    """``name``, or ``name`` with underscores, so that no column clashes."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name += "_"
    return name


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(col, UPPER, LOWER)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it from there:
    later jobs do not repeat its work, and lost executors lose nothing."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder name inside the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def shuffle_parts(spark: SparkSession, at_least: int = 1) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), at_least)


def firm(col: Column) -> Column:
    """``col``, computed once where it stands: the optimiser moves no filter
    and merges no projection across a column that is not deterministic, and
    would otherwise copy an array's whole expression into lambdas above it."""
    return F.when(F.monotonically_increasing_id() >= 0, col)
