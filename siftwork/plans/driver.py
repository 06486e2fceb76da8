"""Reference-shaped views over the driver tables.

The evaluated workflow's own tables are not available, so every plan in
``plans.catalog`` reads the driver tables through these fixed mappings
(the same rules are written in SQL for the DuckDB oracle):

* ``articles`` (documents): search results; database by language
  (en pubmed, fr medline, de embase, es openalex); review = source;
  original id = md5-derived key of the text in mixed spellings, so exact
  copies of a text are the same article retrieved twice.
* ``truth`` (labels ⋈ documents, quality = 1): included articles of the
  review; per-database ids, every 7th one missing in a database.
* ``vectors`` (embeddings): article = vec_id, review = label, database =
  vec_id mod 4, so four search spaces share the reviews.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.truth import stable_sample
from ..schemas import GOLD_SAMPLE_SEED, GOLD_SAMPLE_SIZE

LANG_DB = {"en": "pubmed", "fr": "medline", "de": "embase", "es": "openalex"}
DB_BY_MOD4 = ["pubmed", "medline", "embase", "openalex"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table, as Spark splits it."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _db_of_lang(col):
    out = None
    for lang, db in LANG_DB.items():
        out = (F.when(col == lang, db) if out is None else out.when(col == lang, db))
    return out


def _text_key(text_col="text"):
    return F.md5(F.col(text_col))


def _messy_id(n_col, key):
    """Same article written three ways: URL prefix, padded lower, upper."""
    m = F.col(n_col) % 3
    return (F.when(m == 0, F.concat(F.lit("https://openalex.org/W"), F.upper(key)))
            .when(m == 1, F.concat(F.lit(" w"), key, F.lit(" ")))
            .otherwise(F.concat(F.lit("W"), F.upper(key))))


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").alias("article_id"),
        _db_of_lang(F.col("lang")).alias("database"),
        F.col("source").alias("review_id"),
        _messy_id("doc_id", _text_key()).alias("original_id"),
        (F.lit(1985) + F.col("doc_id") % 45).cast("int").alias("publication_year"),
        F.col("text"),
    )


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    lab = table(spark, sf_dir, "labels").where(F.col("quality") == 1).select("doc_id")
    j = d.join(lab, "doc_id", "left_semi")
    key = _text_key()
    rid = _messy_id("doc_id", key)
    m7 = F.col("doc_id") % 7
    return j.select(
        F.col("doc_id").alias("ground_truth_article_id"),
        F.col("source").alias("review_id"),
        key.alias("included_reference"),
        F.when(m7 != 0, rid).alias("retrieved_pubmed_id"),
        F.when(m7 != 1, rid).alias("retrieved_embase_id"),
        F.when(m7 != 2, rid).alias("retrieved_oa_id"),
        (F.lit(1985) + F.col("doc_id") % 45).cast("int").alias("publication_year"),
        F.when(F.col("doc_id") % 11 != 0, F.lit(2000) + F.col("doc_id") % 10).cast("int")
        .alias("searchstrat_year_start"),
        F.when(F.col("doc_id") % 3 == 0, "Y").when(F.col("doc_id") % 3 == 1, "N")
        .alias("sr_update"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    db = F.element_at(F.array(*[F.lit(x) for x in DB_BY_MOD4]), (F.col("vec_id") % 4 + 1).cast("int"))
    return e.select(
        F.col("vec_id").alias("article_id"),
        F.col("label").cast("string").alias("review_id"),
        db.alias("database"),
        F.concat(F.when(F.col("vec_id") % 5 == 0, "V").otherwise("v"),
                 F.col("vec_id").cast("string")).alias("original_id"),
        F.col("embedding"),
    )


def vector_truth(vecs: DataFrame) -> DataFrame:
    """Every vector is an included article of its review; the id exists in
    its own database only (medline shares the pubmed id)."""
    rid = F.concat(F.lit("v"), F.col("article_id").cast("string"))
    db = F.col("database")
    return vecs.select(
        F.col("article_id").alias("ground_truth_article_id"), "review_id",
        F.when(db.isin("pubmed", "medline"), rid).alias("retrieved_pubmed_id"),
        F.when(db == "embase", rid).alias("retrieved_embase_id"),
        F.when(db == "openalex", rid).alias("retrieved_oa_id"),
    )


def vector_gold(vecs: DataFrame, n: int = GOLD_SAMPLE_SIZE, seed: int = GOLD_SAMPLE_SEED) -> DataFrame:
    """Gold (query) articles: up to n per review in seeded md5 order."""
    g = vecs.select(F.col("article_id").alias("ground_truth_article_id"), "review_id", "embedding")
    return stable_sample(g, ["review_id"], "ground_truth_article_id", n, seed)
