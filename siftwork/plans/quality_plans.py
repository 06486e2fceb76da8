"""Data-quality plans over the driver tables and their oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.ids import clean_id
from ..operators.quality import (check_conservation, check_expected_counts, check_foreign_key,
                                 check_metric_bounds, check_subset, check_unique, duplicate_rows,
                                 embedding_coverage, last_non_null)
from . import driver
from .common import DATABASES4, SQL_ARTICLES, SQL_TRUTH, SQL_VECTORS, sql_clean_id
from .eval_plans import _SQL_TOPIC_COUNTS, broad_results, long_truth, topic_metrics_df


def _ids(spark, sf):
    return driver.articles(spark, sf).select("article_id", "database", clean_id("original_id").alias("clean_id"))


def dq_unique_q(spark, sf):
    return check_unique(_ids(spark, sf), ["database", "clean_id"])


def dq_duplicates_q(spark, sf):
    return duplicate_rows(_ids(spark, sf), ["database", "clean_id"])


def dq_foreign_key_q(spark, sf):
    return check_foreign_key(driver.table(spark, sf, "labels"), driver.table(spark, sf, "documents"),
                             ["doc_id"])


def dq_subset_q(spark, sf):
    return check_subset(driver.truth(spark, sf).select("review_id"),
                        driver.articles(spark, sf).where(F.col("database") == "embase").select("review_id"),
                        ["review_id"])


def dq_expected_counts_q(spark, sf):
    d = driver.table(spark, sf, "documents")
    lines = d.groupBy("source", "lang").agg(F.count(F.lit(1)).alias("results")) \
        .withColumn("results", F.when(F.col("lang") != "fr", F.col("results")))
    expected = last_non_null(lines, ["source"], "results", "lang") \
        .select(F.col("source").alias("review_id"), F.col("results").alias("expected"))
    expected = expected.withColumn("database", F.explode(F.array(*map(F.lit, DATABASES4))))
    actual = broad_results(spark, sf) \
        .join(driver.articles(spark, sf).select("article_id", "review_id"), "article_id") \
        .groupBy("review_id", "database").agg(F.count(F.lit(1)).alias("n_rows"))
    return check_expected_counts(actual, expected, ["review_id", "database"])


def dq_conservation_q(spark, sf):
    m = topic_metrics_df(spark, sf)
    t = long_truth(spark, sf).groupBy("database", "review_id", "truth_kind") \
        .agg(F.count(F.lit(1)).alias("n_truth"))
    return check_conservation(m, t, ["database", "review_id", "truth_kind"]) \
        .select("database", "review_id", "truth_kind", "n_retrieved", "n_missed", "n_truth")


def dq_metrics_q(spark, sf):
    return check_metric_bounds(topic_metrics_df(spark, sf)) \
        .select("database", "review_id", "truth_kind", "recall", "precision")


def embedding_coverage_q(spark, sf):
    v = driver.vectors(spark, sf)
    expected = driver.articles(spark, sf).groupBy("database").agg(F.count(F.lit(1)).alias("expected"))
    return embedding_coverage(v, expected, ["database"], dim=64)


QUERIES = {
    "dq_unique": dq_unique_q,
    "dq_duplicates": dq_duplicates_q,
    "dq_foreign_key": dq_foreign_key_q,
    "dq_subset": dq_subset_q,
    "dq_expected_counts": dq_expected_counts_q,
    "dq_conservation": dq_conservation_q,
    "dq_metrics": dq_metrics_q,
    "embedding_coverage": embedding_coverage_q,
}

_IDS = f"""WITH {SQL_ARTICLES},
ids AS (SELECT article_id, database, {sql_clean_id('original_id')} AS clean_id FROM articles)"""

ORACLES = {
    "dq_unique": _IDS + "\nSELECT database, clean_id, count(*) AS n_rows FROM ids GROUP BY ALL HAVING count(*) > 1",
    "dq_duplicates": _IDS + """,
d AS (SELECT database, clean_id, count(*) AS n_rows FROM ids GROUP BY ALL HAVING count(*) > 1)
SELECT i.database, i.clean_id, i.article_id, d.n_rows FROM ids i
JOIN d ON i.database = d.database AND i.clean_id = d.clean_id""",
    "dq_foreign_key": "SELECT * FROM labels l WHERE l.doc_id IS NOT NULL AND NOT EXISTS "
                      "(SELECT 1 FROM documents d WHERE d.doc_id = l.doc_id)",
    "dq_subset": f"""WITH {SQL_ARTICLES}, {SQL_TRUTH},
a AS (SELECT DISTINCT review_id FROM truth),
b AS (SELECT DISTINCT review_id FROM articles WHERE database = 'embase')
SELECT review_id, 'missing_in_second' AS side FROM a WHERE review_id NOT IN (SELECT review_id FROM b)
UNION ALL
SELECT review_id, 'missing_in_first' FROM b WHERE review_id NOT IN (SELECT review_id FROM a)""",
    "dq_expected_counts": f"""WITH {SQL_ARTICLES},
lines AS (SELECT source, lang, CASE WHEN lang <> 'fr' THEN n END AS results
           FROM (SELECT source, lang, count(*) AS n FROM documents GROUP BY source, lang)),
ex AS (SELECT source AS review_id, arg_max(results, lang) AS expected FROM lines WHERE results IS NOT NULL GROUP BY source),
br AS (SELECT * FROM articles WHERE publication_year BETWEEN 1990 AND 2022
       QUALIFY row_number() OVER (PARTITION BY database, original_id ORDER BY article_id) = 1),
ac AS (SELECT review_id, database, count(*) AS n_rows FROM br GROUP BY ALL),
e4 AS (SELECT ex.*, unnest(['pubmed', 'medline', 'embase', 'openalex']) AS database FROM ex)
SELECT coalesce(ac.review_id, ex.review_id) AS review_id, coalesce(ac.database, ex.database) AS database, ac.n_rows, ex.expected
FROM ac FULL OUTER JOIN e4 ex ON ac.review_id = ex.review_id AND ac.database = ex.database
WHERE ac.n_rows IS DISTINCT FROM ex.expected""",
    "dq_conservation": _SQL_TOPIC_COUNTS + """,
tc AS (SELECT database, review_id, truth_kind, count(*) AS n_truth FROM truth_long GROUP BY ALL)
SELECT coalesce(p.database, tc.database) AS database, coalesce(p.review_id, tc.review_id) AS review_id,
       coalesce(p.truth_kind, tc.truth_kind) AS truth_kind, p.n_retrieved, p.n_missed, tc.n_truth
FROM per p FULL OUTER JOIN tc ON p.database = tc.database AND p.review_id = tc.review_id AND p.truth_kind = tc.truth_kind
WHERE coalesce(p.n_retrieved, 0) + coalesce(p.n_missed, 0) <> coalesce(tc.n_truth, 0)""",
    "dq_metrics": _SQL_TOPIC_COUNTS + """
SELECT database, review_id, truth_kind, recall, precision FROM per
WHERE recall < 0 OR recall > 1 OR precision < 0 OR precision > 1""",
    "embedding_coverage": f"""WITH {SQL_ARTICLES}, {SQL_VECTORS},
c AS (SELECT database, count(*) AS n_rows, count(*) FILTER (WHERE embedding IS NOT NULL AND len(embedding) = 64) AS n_vectors
      FROM v GROUP BY database),
e AS (SELECT database, count(*) AS expected FROM articles GROUP BY database),
j AS (SELECT coalesce(c.database, e.database) AS database, coalesce(c.n_rows, 0) AS n_rows,
             coalesce(c.n_vectors, 0) AS n_vectors, e.expected
      FROM c FULL OUTER JOIN e ON c.database = e.database)
SELECT database, n_rows, n_vectors, expected,
       (n_rows < coalesce(expected, 0)) OR (n_vectors < n_rows) AS needs_rebuild FROM j""",
}
