"""Tables at rest: typed reads, folder consolidation, file-name descriptors,
per-database projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import SOURCE_COLUMNS


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None,
               fmt: str = "parquet", **options) -> DataFrame:
    """Typed read (no inference when a schema is given); CSV gets a header."""
    r = spark.read.format(fmt)
    if schema is not None:
        r = r.schema(schema)
    if fmt == "csv":
        r = r.option("header", True)
    for k, v in options.items():
        r = r.option(k, v)
    return r.load(path)


def read_folder(spark: SparkSession, path: str, suffix: str = ".parquet",
                merge_schema: bool = True, fail_if_empty: bool = True) -> DataFrame:
    """Every file of a folder with the suffix, unioned by column name
    (``mergeSchema``); other files are ignored by the listing glob."""
    df = (spark.read.option("mergeSchema", merge_schema)
          .option("pathGlobFilter", f"*{suffix}").parquet(path))
    if fail_if_empty and df.isEmpty():
        raise ValueError(f"no rows under {path}")
    return df


def strategy_from_file_name(col: str | Column) -> Column:
    """``<db>_<search type>_consolidated_<strategy>_results.parquet`` ->
    struct(database, search_type, strategy_type)."""
    c = F.col(col) if isinstance(col, str) else col
    parts = F.split(c, "_")
    db = F.element_at(parts, 1)
    st = F.element_at(parts, 2)
    strat = F.concat_ws("_", F.try_element_at(parts, F.lit(4)), F.try_element_at(parts, F.lit(5)))
    return F.struct(
        F.when(db == "oa", "openalex").otherwise(db).alias("database"),
        F.when(st == "topic", "topic-specific").when(st == "overarching", "overarching").alias("search_type"),
        F.when(strat.isin("boolkw_search", "consolidated_boolkw"), "boolean-kw")
        .when(strat == "topic_search", "openalex-topic-search").alias("strategy_type"),
    )


def project_source(df: DataFrame, database: str) -> DataFrame:
    """Per-database column names -> (original_id, title, abstract,
    publication_year) with typed nulls for absent columns."""
    m = SOURCE_COLUMNS[database]
    out = []
    for target, src in m.items():
        out.append((F.col(src) if src in df.columns else F.lit(None).cast("string")).alias(target))
    return df.select(*out, *[c for c in df.columns if c not in m.values()])


def for_review(df: DataFrame, review: str, col: str = "evidence_review_id") -> DataFrame:
    """Rows of one review; ``overall`` means every review (no filter)."""
    return df if review == "overall" else df.where(F.col(col) == review)


def review_ids(strategies: DataFrame, search_types: DataFrame, type_name: str) -> DataFrame:
    """Distinct review ids that have a strategy of the given search type."""
    t = search_types.where(F.col("name") == type_name).select("search_type_id")
    return strategies.join(t, "search_type_id", "left_semi") \
        .select("evidence_review_id").distinct()
