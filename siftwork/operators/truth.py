"""Ground truth, evaluation set, gold (query) set and topic lookups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ids import clean_id, clean_year, fix_question_id
from ..functions.text import clean_html
from ..schemas import (GOLD_SAMPLE_SEED, GOLD_SAMPLE_SIZE, MIN_INCLUDED_FOR_EVAL,
                       REVIEW_TYPE_BY_SR_UPDATE, REVIEW_TYPE_FOR_NULL)
from .ordinal import top_k
from .registry import whole_row

# fixed values: reviews left out of the evaluation set
EXCLUDED_EVAL_REVIEWS = ("5.7.5", "5.7.1")


def sample_order(id_col: str, seed: int = GOLD_SAMPLE_SEED) -> list[Column]:
    """Seeded pseudo-random order that does not depend on partitioning."""
    return [F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string"))).asc(),
            F.col(id_col).asc()]


def stable_sample(df: DataFrame, by: Sequence[str], id_col: str,
                  n: int = GOLD_SAMPLE_SIZE, seed: int = GOLD_SAMPLE_SEED) -> DataFrame:
    """Up to ``n`` rows per group in seeded md5 order (top-k per group:
    WindowGroupLimit keeps n rows per group per task before the shuffle)."""
    return top_k(df, by, sample_order(id_col, seed), n, name="_rn").drop("_rn")


def eligible_reviews(reviews: DataFrame, type_col: str = "evidence_review_type",
                     n_col: str = "included_num", min_included: int = MIN_INCLUDED_FOR_EVAL) -> DataFrame:
    """Systematic reviews with at least ``min_included`` included articles."""
    return reviews.where((F.col(type_col) == "SR") & (F.col(n_col) >= min_included))


def recode_review_type(col) -> Column:
    """sr_update Y/N/null -> review type text; any other value fails."""
    c = F.col(col) if isinstance(col, str) else col
    out = None
    for flag, label in REVIEW_TYPE_BY_SR_UPDATE:
        out = F.when(c == flag, label) if out is None else out.when(c == flag, label)
    return out.when(c.isNull(), REVIEW_TYPE_FOR_NULL).otherwise(
        F.raise_error(F.concat(F.lit("unknown sr_update value: "), c)))


def first_per_group(df: DataFrame, by: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """``DISTINCT ON (by) ORDER BY order``: one row per group, explicit order."""
    return top_k(df, by, order, 1, name="_rn").drop("_rn")


def build_evaluation_set(truth: DataFrame, strategies: DataFrame | None = None,
                         review_col: str = "review_id", year_col: str = "publication_year",
                         excluded: Sequence[str] = EXCLUDED_EVAL_REVIEWS) -> DataFrame:
    """Articles new to the guideline edition under evaluation.

    The search start year comes from the review's first strategy (lowest
    strategy id) when ``strategies`` is given, else from the truth row.
    Keep: start <= publication year, or start unknown.  Whole-row distinct.
    """
    t = truth
    if strategies is not None:
        first = first_per_group(strategies.select(review_col, "search_strategy_id",
                                                  "searchstrat_year_start"),
                                [review_col], [F.col("search_strategy_id").asc()])
        t = t.drop("searchstrat_year_start").join(
            first.select(review_col, "searchstrat_year_start"), review_col, "left")
    start = F.col("searchstrat_year_start")
    keep = ((start <= F.col(year_col)) | start.isNull()) & ~F.col(review_col).isin(*excluded)
    return t.where(keep).distinct()


def build_gold_set(truth: DataFrame, eval_reviews: DataFrame, review_col: str = "review_id",
                   id_col: str = "ground_truth_article_id", year_col: str = "publication_year",
                   n: int = GOLD_SAMPLE_SIZE, seed: int = GOLD_SAMPLE_SEED,
                   require_text: bool = True) -> DataFrame:
    """Query (gold) articles: per evaluation review, up to ``n`` articles of
    the previous edition (sr_update = Y, published up to the search start);
    reviews without those draw from their articles with title and abstract;
    reviews still without any draw from all their articles.  Every review in
    ``eval_reviews`` is covered when it has any article.

    One pass: each candidate gets a tier (1 previous edition, 2 with text,
    3 other); a review keeps its best tier (a partial min aggregate joined
    back on the review) and a seeded top-``n`` (WindowGroupLimit) is drawn.
    """
    pool = truth.join(eval_reviews.select(review_col).distinct(), review_col, "left_semi")
    has_text = (F.col("title").isNotNull() & F.col("abstract").isNotNull()) if require_text \
        else F.lit(True)
    prev = (F.col("sr_update") == "Y") & (F.col(year_col) <= F.col("searchstrat_year_start"))
    tier = F.when(prev & has_text, 1).when(has_text, 2).otherwise(3)
    tiered = pool.withColumn("_tier", tier)
    best = tiered.groupBy(review_col).agg(F.min("_tier").alias("_best"))
    chosen = tiered.join(best, review_col).where(F.col("_tier") == F.col("_best")).drop("_tier", "_best")
    return stable_sample(chosen, [review_col], id_col, n, seed)


def build_ground_truth(articles: DataFrame, reviews: DataFrame, sources: dict[str, DataFrame],
                       key: str = "included_article_id", review_col: str = "question_id",
                       priority: Sequence[str] = ("pubmed", "embase", "openalex")) -> DataFrame:
    """Ground truth of eligible reviews with merged title/abstract.

    ``sources``: per database a frame (key, title, abstract, title_2ndsearch,
    abstract_2ndsearch, api_id_retrieved); the first non-null value in
    ``priority`` order wins.  Ids are cleaned, years coerced, question ids
    fixed, HTML removed.
    """
    elig = eligible_reviews(reviews).select(fix_question_id(review_col).alias(review_col))
    gt = articles.withColumn(review_col, fix_question_id(review_col)) \
        .join(elig, review_col, "left_semi")
    titles, abstracts = [], []
    for db in priority:
        s = sources[db]
        t = F.coalesce(F.col("title"), F.col("title_2ndsearch")) if "title_2ndsearch" in s.columns \
            else F.col("title")
        a = F.coalesce(F.col("abstract"), F.col("abstract_2ndsearch")) \
            if "abstract_2ndsearch" in s.columns else F.col("abstract")
        s = first_per_group(s, [key], [whole_row(s).asc()]).select(
            key, t.alias(f"_t_{db}"), a.alias(f"_a_{db}"),
            clean_id("api_id_retrieved").alias(f"retrieved_{'oa' if db == 'openalex' else db}_id"))
        gt = gt.join(s, key, "left")
        titles.append(F.col(f"_t_{db}"))
        abstracts.append(F.col(f"_a_{db}"))
    out = gt.withColumn("title", clean_html(F.coalesce(*titles))) \
        .withColumn("abstract", clean_html(F.coalesce(*abstracts))) \
        .drop(*[c for c in gt.columns if c.startswith("_t_") or c.startswith("_a_")])
    if "year_pub_extract" in out.columns:
        out = out.withColumn("year_pub_extract", clean_year("year_pub_extract"))
    return out


def adjusted_truth(truth: DataFrame, id_col: str) -> DataFrame:
    """Only the articles the database indexes."""
    return truth.where(F.col(id_col).isNotNull())


def topic_lookup(ids: DataFrame, topics: DataFrame, retry: DataFrame | None = None,
                 id_col: str = "clean_id", topic_col: str = "topic_id") -> tuple[DataFrame, DataFrame]:
    """Attach a topic to every id: first lookup, then the retry lookup for the
    ids the first missed (coalesce, a retry never erases a hit).  Returns
    (ids with topic, ids still unmatched)."""
    first = first_per_group(topics, [id_col], [F.col(topic_col).asc_nulls_last()]) \
        .select(id_col, F.col(topic_col).alias("_t1"))
    out = ids.join(first, id_col, "left")
    if retry is not None:
        second = first_per_group(retry, [id_col], [F.col(topic_col).asc_nulls_last()]) \
            .select(id_col, F.col(topic_col).alias("_t2"))
        out = out.join(second, id_col, "left").withColumn(topic_col, F.coalesce("_t1", "_t2")) \
            .drop("_t1", "_t2")
    else:
        out = out.withColumnRenamed("_t1", topic_col)
    return out, out.where(F.col(topic_col).isNull()).select(id_col).distinct()


def merge_sources(base: DataFrame, sources: Sequence[tuple[str, DataFrame]], key: str,
                  cols: Sequence[str]) -> DataFrame:
    """Fill ``cols`` of ``base`` from lookup sources; the first source (in the
    given priority order) with a non-null value wins.  Each source is cut to
    one row per key first, so the left joins never fan out."""
    out = base
    for name, src in sources:
        one = first_per_group(src, [key], [whole_row(src).asc()])
        out = out.join(one.select(key, *[F.col(c).alias(f"_{name}_{c}") for c in cols]), key, "left")
    for c in cols:
        out = out.withColumn(c, F.coalesce(*[F.col(f"_{n}_{c}") for n, _ in sources]))
    return out.drop(*[f"_{n}_{c}" for n, _ in sources for c in cols])
