"""Landed JSON result pages (cursor-paged API responses saved to files)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import decode_inverted_index
from ..schemas import OPENALEX_PAGE
from ..session import written_once

# file names carry the retrieval window: ..._<YYYY-MM-DD>_<YYYY-MM-DD>_...
_WINDOW = r"(\d{4}-\d{2}-\d{2})_(\d{4}-\d{2}-\d{2})"


def read_landed_pages(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    """Pages -> one row per work: ids flattened, abstract decoded from the
    inverted index, retrieval window parsed from the file name, next cursor
    kept.  Reading is split per file by Spark; nothing goes through the
    driver."""
    pages = (spark.read.schema(OPENALEX_PAGE).option("multiLine", multiline).json(path)
             .select(F.col("meta.next_cursor").alias("next_cursor"), "results",
                     F.col("_metadata.file_name").alias("origin_file")))
    works = pages.select("next_cursor", "origin_file", F.explode("results").alias("w"))
    return works.select(
        F.col("w.id").alias("id"),
        F.col("w.ids.*"),
        F.col("w.title").alias("title"),
        F.col("w.publication_year").alias("publication_year"),
        F.col("w.publication_date").alias("publication_date"),
        F.col("w.type").alias("type"),
        decode_inverted_index(F.col("w.abstract_inverted_index")).alias("abstract"),
        F.col("w.primary_topic.id").alias("topic_id"),
        F.col("w.primary_topic.display_name").alias("topic_name"),
        F.to_date(F.regexp_extract("origin_file", _WINDOW, 1)).alias("window_start"),
        F.to_date(F.regexp_extract("origin_file", _WINDOW, 2)).alias("window_end"),
        "next_cursor", "origin_file",
    )


FIRST_CURSOR = "*"      # fixed value: how a chain of pages begins


def check_cursor_chain(pages: DataFrame, by: Sequence[str], cursor: str = "cursor",
                       next_cursor: str = "next_cursor") -> DataFrame:
    """Faults of landed pages, (by, cursor, fault): each page names the next one of
    its window, from ``*`` to a page that names none.

    ``lost``: a named page has not landed; ``doubled``: a page has landed more than
    once; ``headless``: pages that no chain from ``*`` reaches; ``looping``: pages
    from which no end (nor a lost page) is reached.  Where each page leads, and where
    it comes from, is found by pointer jumping: every round doubles the distance, so
    a window of n pages takes log2(n) rounds, all windows at once.  A page without
    cursor is a first page.  Null windows are windows like any other."""
    by = list(by)
    w = [f"_w{i}" for i in range(len(by))]
    p = pages.select(*[F.col(c).alias(n) for c, n in zip(by, w, strict=True)],
                     F.coalesce(F.col(cursor), F.lit(FIRST_CURSOR)).alias("cursor"), F.col(next_cursor).alias("next"))
    p = written_once(p.groupBy(*w, "cursor").agg(F.count(F.lit(1)).alias("n"), F.min("next").alias("next")))

    def follow(df: DataFrame, on: str, links: DataFrame, how: str) -> DataFrame:
        """``df`` with ``to`` of the link whose cursor is its ``on``."""
        other = links.select(*[F.col(c).alias(f"{c}_") for c in w], F.col("cursor").alias("_cursor"), "to")
        same = F.col(on) == F.col("_cursor")
        for c in w:
            same = same & F.col(c).eqNullSafe(F.col(f"{c}_"))
        return df.join(other, same, how).drop("_cursor", *[f"{c}_" for c in w])

    named = follow(p.select(*w, "cursor", "next"), "next", p.select(*w, "cursor", F.col("cursor").alias("to")), "left")
    links = written_once(named)                               # ``to``: the page named, if it has landed
    lost = links.where("next is not null and to is null").select(*w, F.col("next").alias("cursor")).distinct()
    links = links.select(*w, "cursor", "to")
    reached = p.where(F.col("cursor") == FIRST_CURSOR).select(*w, "cursor")
    most = p.groupBy(*w).agg(F.count(F.lit(1)).alias("c")).agg(F.max("c")).first()[0] or 0
    for _ in range(most.bit_length() + 1):
        if links.where("to is not null").isEmpty():
            break
        further = follow(reached, "cursor", links, "inner").where("to is not null").select(*w, F.col("to").alias("cursor"))
        reached = written_once(reached.unionByName(further).distinct())
        links = written_once(follow(links.withColumnRenamed("to", "at"), "at", links, "left").select(*w, "cursor", "to"))
    looping = links.where("to is not null").select(*w, "cursor")
    known = reached.select(*[F.col(c).alias(f"{c}_") for c in w], F.col("cursor").alias("_cursor"))
    same = F.col("cursor") == F.col("_cursor")
    for c in w:
        same = same & F.col(c).eqNullSafe(F.col(f"{c}_"))
    headless = p.select(*w, "cursor").join(known, same, "left_anti")
    doubled = p.where("n > 1").select(*w, "cursor")
    parts = {"lost": lost, "doubled": doubled, "headless": headless, "looping": looping}
    out = reduce(DataFrame.unionByName, [df.withColumn("fault", F.lit(name)) for name, df in parts.items()])
    return out.select(*[F.col(n).alias(c) for c, n in zip(by, w, strict=True)], "cursor", "fault")


def topic_window_filter(df: DataFrame, topics, types=("article", "review"),
                        start: str | None = None, end: str | None = None,
                        date_col: str = "publication_date") -> DataFrame:
    """Topic + document type + date window (the API filter, re-aimed as a
    predicate that prunes Parquet row groups when the data is at rest)."""
    cond = F.col("topic_id").isin(*topics) & F.col("type").isin(*types)
    if start:
        cond = cond & (F.col(date_col) >= F.to_date(F.lit(start)))
    if end:
        cond = cond & (F.col(date_col) <= F.to_date(F.lit(end)))
    return df.where(cond)
