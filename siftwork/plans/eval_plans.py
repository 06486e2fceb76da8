"""Boolean-search evaluation plans (topic-specific W1, broad W2) over the
``documents`` / ``labels`` driver tables, and their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ids import clean_id
from ..operators.matching import (matched_rows, missed_rows, overall_metrics, raw_and_adjusted,
                                  search_metrics, truth_by_database)
from ..operators.ordinal import top_k
from ..operators.truth import build_evaluation_set, build_gold_set, stable_sample
from ..schemas import BROAD_YEAR_RANGE, EVAL_METRIC_COLUMNS
from . import driver
from .common import (DATABASES4, SQL_ARTICLES, SQL_TRUTH, SQL_TRUTH_LONG, round_doubles,
                     sql_clean_id, sql_round)

TKEYS = ["database", "review_id"]
_DOUBLE_SET_METRICS = ["nnr", "recall", "precision", "f1_score", "f2_score", "f3_score"]


def topic_results(spark, sf_dir) -> DataFrame:
    """Topic-specific results: every article, grouped by (database, review);
    no year filter and no dedupe (duplicates count in the workload)."""
    a = driver.articles(spark, sf_dir)
    return a.select("database", "review_id", "article_id", "original_id",
                    clean_id("original_id").alias("clean_id"))


def broad_results(spark, sf_dir) -> DataFrame:
    """Broad results per database: years 1990-2022, one record per raw id
    (the lowest article id)."""
    lo, hi = BROAD_YEAR_RANGE
    a = driver.articles(spark, sf_dir).where(F.col("publication_year").between(lo, hi))
    a = top_k(a, ["database", "original_id"], [F.col("article_id").asc()], 1, name="_rn").drop("_rn")
    return a.select("database", "article_id", "original_id", "publication_year",
                    clean_id("original_id").alias("clean_id"))


def long_truth(spark, sf_dir) -> DataFrame:
    return truth_by_database(driver.truth(spark, sf_dir), DATABASES4,
                             keep=["ground_truth_article_id", "review_id"])


def topic_metrics_df(spark, sf_dir) -> DataFrame:
    return search_metrics(long_truth(spark, sf_dir), topic_results(spark, sf_dir), TKEYS)


def broad_metrics_df(spark, sf_dir) -> DataFrame:
    t = long_truth(spark, sf_dir).drop("review_id")
    m = search_metrics(t, broad_results(spark, sf_dir), ["database"])
    return m.withColumn("review_id", F.lit("overall"))


# ------------------------------------------------------------------ plans --

def topic_metrics_q(spark, sf_dir):
    return round_doubles(topic_metrics_df(spark, sf_dir))


def overall_metrics_q(spark, sf_dir):
    per = topic_metrics_df(spark, sf_dir)
    return round_doubles(overall_metrics(per, ["database", "truth_kind"], label_col="review_id"))


def raw_adjusted_merge_q(spark, sf_dir):
    m = topic_metrics_df(spark, sf_dir)
    return round_doubles(raw_and_adjusted(m, TKEYS, EVAL_METRIC_COLUMNS))


def broad_metrics_q(spark, sf_dir):
    return round_doubles(broad_metrics_df(spark, sf_dir))


def match_q(spark, sf_dir):
    m = matched_rows(long_truth(spark, sf_dir), topic_results(spark, sf_dir), TKEYS)
    return m.select("database", "review_id", "truth_kind", "ground_truth_article_id",
                    "clean_id", "article_id_results")


def missed_q(spark, sf_dir):
    m = missed_rows(long_truth(spark, sf_dir), topic_results(spark, sf_dir), TKEYS)
    return m.select("database", "review_id", "truth_kind", "ground_truth_article_id", "clean_id")


def adjusted_truth_q(spark, sf_dir):
    return long_truth(spark, sf_dir)


def year_filter_q(spark, sf_dir):
    return broad_results(spark, sf_dir).select("database", "article_id", "original_id",
                                               "publication_year")


def eval_set_q(spark, sf_dir):
    t = driver.truth(spark, sf_dir)
    return build_evaluation_set(t).select("ground_truth_article_id", "review_id",
                                          "publication_year", "searchstrat_year_start")


def gold_sample_q(spark, sf_dir):
    t = driver.truth(spark, sf_dir)
    ev = build_evaluation_set(t)
    g = build_gold_set(t, ev, require_text=False)
    return g.select("review_id", "ground_truth_article_id")


def stable_sample_q(spark, sf_dir):
    a = driver.articles(spark, sf_dir).select("database", "review_id", "article_id")
    return stable_sample(a, ["database", "review_id"], "article_id", 3, 42)


QUERIES = {
    "topic_metrics": topic_metrics_q,
    "overall_metrics": overall_metrics_q,
    "raw_adjusted_merge": raw_adjusted_merge_q,
    "broad_metrics": broad_metrics_q,
    "match": match_q,
    "missed": missed_q,
    "adjusted_truth": adjusted_truth_q,
    "year_filter": year_filter_q,
    "eval_set": eval_set_q,
    "gold_sample": gold_sample_q,
    "stable_sample": stable_sample_q,
}

# ------------------------------------------------------------- oracle SQL --

_BASE = f"WITH {SQL_ARTICLES},\n{SQL_TRUTH},\n{SQL_TRUTH_LONG}"

_SQL_TOPIC_RES = f"""
res AS (
  SELECT database, review_id, article_id, original_id, {sql_clean_id('original_id')} AS clean_id
  FROM articles
),
hits AS (SELECT DISTINCT database, review_id, clean_id FROM res WHERE clean_id IS NOT NULL)"""

_SQL_BROAD_RES = f"""
res AS (
  SELECT database, article_id, original_id, publication_year, {sql_clean_id('original_id')} AS clean_id
  FROM articles
  WHERE publication_year BETWEEN 1990 AND 2022
  QUALIFY row_number() OVER (PARTITION BY database, original_id ORDER BY article_id) = 1
),
hits AS (SELECT DISTINCT database, clean_id FROM res WHERE clean_id IS NOT NULL)"""


def _sql_set_metrics(keys: str, src: str) -> str:
    """SQL twin of matching.metric_columns over a relation with G, M, N."""
    return f"""
SELECT {keys}, truth_kind,
  {sql_round(_DOUBLE_SET_METRICS)},
  n_retrieved, n_missed, overall_screening_workload
FROM (
  SELECT *,
    CASE WHEN M = 0 THEN 0.0 ELSE N / M END AS nnr,
    CAST(M AS BIGINT) AS n_retrieved, CAST(G - M AS BIGINT) AS n_missed,
    r AS recall, p AS precision,
    CASE WHEN M = 0 THEN 0.0 ELSE coalesce((2.0 * p * r) / nullif(1.0 * p + r, 0), 0.0) END AS f1_score,
    CASE WHEN M = 0 THEN 0.0 ELSE coalesce((5.0 * p * r) / nullif(4.0 * p + r, 0), 0.0) END AS f2_score,
    CASE WHEN M = 0 THEN 0.0 ELSE coalesce((10.0 * p * r) / nullif(9.0 * p + r, 0), 0.0) END AS f3_score,
    CAST(N AS BIGINT) AS overall_screening_workload
  FROM (
    SELECT *, CASE WHEN M = 0 THEN 0.0 ELSE M / G END AS r,
              CASE WHEN M = 0 THEN 0.0 ELSE M / N END AS p
    FROM {src}
  )
)"""


_SQL_TOPIC_COUNTS = f"""{_BASE},
{_SQL_TOPIC_RES},
flag AS (
  SELECT t.database, t.review_id, t.truth_kind, h.clean_id IS NOT NULL AS matched
  FROM truth_long t LEFT JOIN hits h
    ON t.database = h.database AND t.review_id = h.review_id AND t.clean_id = h.clean_id
),
cnt AS (SELECT database, review_id, truth_kind, count(*) AS g, count(*) FILTER (WHERE matched) AS m
        FROM flag GROUP BY ALL),
grid AS (SELECT DISTINCT database, review_id, k.truth_kind FROM truth_long, (VALUES ('raw'), ('adjusted')) k(truth_kind)
         WHERE truth_long.truth_kind = 'raw'),
wl AS (SELECT database, review_id, count(*) AS n FROM res GROUP BY ALL),
tm AS (
  SELECT grid.database, grid.review_id, grid.truth_kind,
         CAST(coalesce(cnt.g, 0) AS DOUBLE) AS G, CAST(coalesce(cnt.m, 0) AS DOUBLE) AS M,
         CAST(coalesce(wl.n, 0) AS DOUBLE) AS N
  FROM grid LEFT JOIN cnt USING (database, review_id, truth_kind) LEFT JOIN wl USING (database, review_id)
),
per AS ({_sql_set_metrics('database, review_id', 'tm')})"""

_SQL_OVERALL = _SQL_TOPIC_COUNTS + """,
s AS (SELECT database, truth_kind, sum(n_retrieved) AS r_, sum(n_missed) AS x_, sum(overall_screening_workload) AS w_
      FROM per GROUP BY ALL),
o AS (
  SELECT database, truth_kind, r_, x_, w_,
         coalesce(CAST(r_ AS DOUBLE) / nullif(CAST(r_ + x_ AS DOUBLE), 0), 0.0) AS rc,
         coalesce(CAST(r_ AS DOUBLE) / nullif(CAST(w_ AS DOUBLE), 0), 0.0) AS pc
  FROM s
)
SELECT database, truth_kind, 'overall' AS review_id,
  round(CASE WHEN pc > 0 THEN 1.0 / pc ELSE 'Infinity'::DOUBLE END, 9) AS nnr,
  CAST(r_ AS BIGINT) AS n_retrieved, CAST(x_ AS BIGINT) AS n_missed,
  round(rc, 9) AS recall, round(pc, 9) AS precision,
  round(coalesce((2.0 * pc * rc) / nullif(1.0 * pc + rc, 0), 0.0), 9) AS f1_score,
  round(coalesce((5.0 * pc * rc) / nullif(4.0 * pc + rc, 0), 0.0), 9) AS f2_score,
  round(coalesce((10.0 * pc * rc) / nullif(9.0 * pc + rc, 0), 0.0), 9) AS f3_score,
  CAST(w_ AS BIGINT) AS overall_screening_workload
FROM o"""


def _pivot_sql():
    cols = []
    for m in EVAL_METRIC_COLUMNS:
        cols.append(f"max(CASE WHEN truth_kind = 'raw' THEN {m} END) AS {m}")
        cols.append(f"max(CASE WHEN truth_kind = 'adjusted' THEN {m} END) AS {m}_adjusted")
    return _SQL_TOPIC_COUNTS + "\nSELECT database, review_id, " + ", ".join(cols) + \
        "\nFROM per GROUP BY database, review_id"


_SQL_BROAD = f"""{_BASE},
{_SQL_BROAD_RES},
flag AS (
  SELECT t.database, t.truth_kind, h.clean_id IS NOT NULL AS matched
  FROM truth_long t LEFT JOIN hits h ON t.database = h.database AND t.clean_id = h.clean_id
),
cnt AS (SELECT database, truth_kind, count(*) AS g, count(*) FILTER (WHERE matched) AS m FROM flag GROUP BY ALL),
grid AS (SELECT DISTINCT database, k.truth_kind FROM truth_long, (VALUES ('raw'), ('adjusted')) k(truth_kind)
         WHERE truth_long.truth_kind = 'raw'),
wl AS (SELECT database, count(*) AS n FROM res GROUP BY ALL),
tm AS (
  SELECT grid.database, 'overall' AS review_id, grid.truth_kind,
         CAST(coalesce(cnt.g, 0) AS DOUBLE) AS G, CAST(coalesce(cnt.m, 0) AS DOUBLE) AS M,
         CAST(coalesce(wl.n, 0) AS DOUBLE) AS N
  FROM grid LEFT JOIN cnt USING (database, truth_kind) LEFT JOIN wl USING (database)
)
{_sql_set_metrics('database, review_id', 'tm')}"""

_SQL_EVAL_SET = """
ev AS (
  SELECT DISTINCT * FROM truth
  WHERE (searchstrat_year_start <= publication_year OR searchstrat_year_start IS NULL)
    AND review_id NOT IN ('5.7.5', '5.7.1')
)"""

_SQL_GOLD_CTES = """
pool AS (SELECT * FROM truth WHERE review_id IN (SELECT review_id FROM ev)),
prev AS (SELECT * FROM pool WHERE sr_update = 'Y' AND publication_year <= searchstrat_year_start),
newp AS (SELECT * FROM pool WHERE review_id NOT IN (SELECT review_id FROM prev)),
s1 AS (
  SELECT review_id, ground_truth_article_id FROM prev
  QUALIFY row_number() OVER (PARTITION BY review_id
     ORDER BY md5('42:' || CAST(ground_truth_article_id AS VARCHAR)), ground_truth_article_id) <= 3
  UNION ALL
  SELECT review_id, ground_truth_article_id FROM newp
  QUALIFY row_number() OVER (PARTITION BY review_id
     ORDER BY md5('42:' || CAST(ground_truth_article_id AS VARCHAR)), ground_truth_article_id) <= 3
),
rest AS (SELECT * FROM pool WHERE review_id NOT IN (SELECT review_id FROM s1)),
gold_ids AS (
  SELECT * FROM s1
  UNION ALL
  SELECT review_id, ground_truth_article_id FROM rest
  QUALIFY row_number() OVER (PARTITION BY review_id
     ORDER BY md5('42:' || CAST(ground_truth_article_id AS VARCHAR)), ground_truth_article_id) <= 3
)"""

_SQL_GOLD = f"{_BASE},{_SQL_EVAL_SET},{_SQL_GOLD_CTES}\nSELECT * FROM gold_ids"

ORACLES = {
    "topic_metrics": _SQL_TOPIC_COUNTS + "\nSELECT * FROM per",
    "overall_metrics": _SQL_OVERALL,
    "raw_adjusted_merge": _pivot_sql(),
    "broad_metrics": _SQL_BROAD,
    "match": f"""{_BASE},
{_SQL_TOPIC_RES},
first_rec AS (
  SELECT database, review_id, clean_id, article_id AS article_id_results FROM res
  WHERE clean_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY database, review_id, clean_id ORDER BY article_id) = 1
)
SELECT t.database, t.review_id, t.truth_kind, t.ground_truth_article_id, t.clean_id, f.article_id_results
FROM truth_long t JOIN first_rec f
  ON t.database = f.database AND t.review_id = f.review_id AND t.clean_id = f.clean_id""",
    "missed": f"""{_BASE},
{_SQL_TOPIC_RES}
SELECT t.database, t.review_id, t.truth_kind, t.ground_truth_article_id, t.clean_id
FROM truth_long t
WHERE NOT EXISTS (SELECT 1 FROM hits h WHERE h.database = t.database
                  AND h.review_id = t.review_id AND h.clean_id = t.clean_id)""",
    "adjusted_truth": f"{_BASE}\nSELECT ground_truth_article_id, review_id, database, clean_id, truth_kind FROM truth_long",
    "year_filter": f"{_BASE},\n{_SQL_BROAD_RES}\nSELECT database, article_id, original_id, publication_year FROM res",
    "eval_set": f"{_BASE},{_SQL_EVAL_SET}\n"
                "SELECT ground_truth_article_id, review_id, publication_year, searchstrat_year_start FROM ev",
    "gold_sample": _SQL_GOLD,
    "stable_sample": f"""{_BASE}
SELECT database, review_id, article_id FROM articles
QUALIFY row_number() OVER (PARTITION BY database, review_id
   ORDER BY md5('42:' || CAST(article_id AS VARCHAR)), article_id) <= 3""",
}
