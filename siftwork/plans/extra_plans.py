"""Remaining inventory items as plans over the driver tables: question-id
remap, strict years, per-database projection, result loading with registry
ids, eligible reviews, strategy star join, vector-search report layer,
combined contrast table, null and distinct reports, encoder."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.ids import clean_id, fix_question_id, year_strict
from ..operators.registry import assign_ids, fan_out, load_results, with_overall_row
from ..operators.report import (combined_table, fill_nnr, label_workflow, median_iqr, null_report,
                                order_key, percent_columns, prefer_cutoff, zero_fill)
from ..operators.stats import log_ratio_contrast, paired, wilcoxon
from ..operators.truth import eligible_reviews
from ..schemas import DATABASE_ORDER, DATABASES, SEARCH_TYPES, SHOTS
from ..sources.ris import remap_question
from ..sources.tables import project_source
from . import driver
from .common import SQL_ARTICLES, SQL_TRUTH, round_doubles, sql_clean_id, sql_round
from .norm_plans import _SQL_MESSY_Q, _SQL_MESSY_YEAR, _messy_question, _messy_year
from .report_plans import _WM, _pairs, _wilcoxon, workflow_metrics
from .vector_plans import KEYS, VectorRun, _metrics_sql


def question_remap_q(spark, sf):
    d = driver.table(spark, sf, "documents").select("doc_id", fix_question_id(_messy_question()).alias("slash_id"))
    return d.withColumn("question_id", remap_question(F.col("slash_id")))


def year_strict_q(spark, sf):
    d = driver.table(spark, sf, "documents").select("doc_id", _messy_year().alias("raw_year"))
    return d.withColumn("year", year_strict("raw_year"))


def _exports(spark, sf):
    """Per-database result exports with each database's own column names."""
    a = driver.articles(spark, sf)
    title = F.concat(F.col("review_id"), F.lit("-"), F.col("article_id").cast("string"))
    abstract = F.when(F.col("article_id") % 2 == 0, F.concat(F.lit("abstract "), F.col("article_id").cast("string")))
    out = {}
    for db, m in (("pubmed", ("pmid", "title", "abstract")), ("openalex", ("id", "title", "abstract")),
                  ("embase", ("accession_number", "primary_title", "notes_abstract")),
                  ("medline", ("id", "primary_title", "notes_abstract"))):
        out[db] = a.where(F.col("database") == db).select(
            F.col("original_id").alias(m[0]), title.alias(m[1]), abstract.alias(m[2]),
            F.col("publication_year").cast("string").alias("publication_year"), "article_id")
    return out


def project_source_q(spark, sf):
    parts = [project_source(df, db).withColumn("database", F.lit(db)) for db, df in _exports(spark, sf).items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("database", "article_id", "original_id", "title", "abstract", "publication_year")


def _strategies(spark, sf):
    a = driver.articles(spark, sf).select("database", "review_id").distinct()
    return assign_ids(a, ["database", "review_id"], 0, name="search_strategy_id")


def load_results_q(spark, sf):
    a = driver.articles(spark, sf).select("database", "review_id", "original_id", "article_id", "publication_year")
    strategies = _strategies(spark, sf)
    earlier = load_results(a.where(F.col("publication_year") < 2000), strategies, None, ["database", "review_id"],
                           order=["original_id", "article_id"])
    new = load_results(a, strategies, earlier, ["database", "review_id"], order=["original_id", "article_id"])
    return new.select("search_strategy_id", "article_id", "original_id", "search_result_article_id")


def eligible_reviews_q(spark, sf):
    t = driver.truth(spark, sf)
    reviews = t.groupBy("review_id").agg(
        F.count(F.lit(1)).alias("included_num"),
        F.when(F.count_if(F.col("sr_update") == "Y") > 0, "SR").otherwise("other").alias("evidence_review_type"))
    return eligible_reviews(reviews).select("review_id", "included_num")


def strategy_catalog_q(spark, sf):
    """Topic-specific vector strategies joined to the database and search
    type dimensions (literal, broadcast); reviews include 'overall'."""
    dbs = spark.createDataFrame(DATABASES, "database_id int, database string, free_api_available boolean")
    types = spark.createDataFrame(SEARCH_TYPES, "search_type_id int, search_type string")
    reviews = with_overall_row(driver.truth(spark, sf).select("review_id").distinct(), "review_id")
    s = fan_out(driver.articles(spark, sf).select("database").distinct(), reviews, SHOTS)
    s = s.withColumn("search_type_id", F.when(F.col("review_id") == "overall", 1).otherwise(2))
    s = s.join(F.broadcast(dbs), "database").join(F.broadcast(types), "search_type_id")
    return s.select("database_id", "database", "search_type", "review_id", "vector_search",
                    order_key("database", DATABASE_ORDER, "database_order"))


def vs_report_q(spark, sf):
    run = VectorRun(spark, sf, shots=("few-shot",))
    m = run.metrics().where(F.col("truth_kind") == "raw")
    m = prefer_cutoff(m.drop("nnr_raw").withColumnRenamed("nnr_cutoff", "nnr"),
                      ["recall", "precision", "f1_score", "f2_score", "f3_score", "overall_screening_workload"])
    m = fill_nnr(m)
    m = zero_fill(m, ["rank_new_relevant", "mrr_new_relevant", "rank_first_relevant"])
    m = m.withColumn("workflow", F.when(F.col("scope") == "overall", "O+OVS").otherwise("O+TVS"))
    m = label_workflow(m, "workflow", "shot")
    m = percent_columns(m, ["recall", "precision"])
    return round_doubles(m.select(*KEYS, "workflow", "workflow_group", "database_label", "recall", "precision",
                                  "nnr", "overall_screening_workload", "rank_new_relevant", "mrr_new_relevant",
                                  "recall_pct", "precision_pct"), 9)


def combined_table_q(spark, sf):
    wm = workflow_metrics(spark, sf)
    summary = median_iqr(wm, ["workflow", "database"], ["recall"]).withColumnRenamed("workflow", "group")
    pairs = paired(wm, ["database", "review_id"], "workflow", "T", "O", "recall")
    c = log_ratio_contrast(pairs, ["database"]).join(wilcoxon(pairs, ["database"]).select("database", "p_value"),
                                                     "database", "left")
    c = c.withColumn("group", F.lit("O")).select("database", "group", "estimate", "p_value")
    out = combined_table(summary, c, ["database", "group"], "T")
    return round_doubles(out.select("database", "group", "recall_median", "estimate", "p_value",
                                    "is_reference", "contrast"), 6)


def null_report_q(spark, sf):
    t = driver.truth(spark, sf).drop("included_reference")
    return null_report(t)


def distinct_counts_q(spark, sf):
    a = driver.articles(spark, sf).withColumn("clean_id", clean_id("original_id"))
    return a.groupBy("database").agg(F.count(F.lit(1)).alias("n_rows"),
                                     F.countDistinct("clean_id").alias("n_distinct_ids"),
                                     F.countDistinct("review_id").alias("n_reviews"))


QUERIES = {
    "question_remap": question_remap_q,
    "year_strict": year_strict_q,
    "project_source": project_source_q,
    "load_results": load_results_q,
    "eligible_reviews": eligible_reviews_q,
    "strategy_catalog": strategy_catalog_q,
    "vs_report": vs_report_q,
    "combined_table": combined_table_q,
    "null_report": null_report_q,
    "distinct_counts": distinct_counts_q,
}

# ------------------------------------------------------------- oracle SQL --

_SLASH = ("trim(lower(regexp_replace(replace(regexp_replace(raw_id, '\\s+', '', 'g'), ',', '/'), "
          "'\\.$', '')))")

_VS_COLS = ("scope, shot, database, review_id, workflow, workflow_group, database_label, "
            + sql_round(["recall", "precision", "nnr", "rank_new_relevant", "mrr_new_relevant",
                         "recall_pct", "precision_pct"]) + ", overall_screening_workload")

ORACLES = {
    "question_remap": f"""WITH x AS (SELECT doc_id, {_SQL_MESSY_Q} AS raw_id FROM documents),
s AS (SELECT doc_id, {_SLASH} AS slash_id FROM x)
SELECT doc_id, slash_id, CASE slash_id WHEN '4.2.4.3.combined' THEN '4.2/4.3' WHEN '1.5' THEN '1.5.1/1.5.2'
  WHEN '1.4' THEN '1.4.1/1.4.2' WHEN '2.1' THEN '2.1.1/2.1.2' WHEN '1.9.1.embase' THEN '1.9.1'
  ELSE slash_id END AS question_id FROM s""",
    "year_strict": f"""WITH x AS (SELECT doc_id, {_SQL_MESSY_YEAR} AS raw_year FROM documents),
s AS (SELECT doc_id, raw_year, trim(split_part(replace(raw_year, '//', ''), ',', 1)) AS s FROM x)
SELECT doc_id, raw_year, CASE WHEN regexp_full_match(s, '[+-]?[0-9]+') THEN TRY_CAST(s AS INTEGER) END AS year FROM s""",
    "project_source": f"""WITH {SQL_ARTICLES}
SELECT database, article_id, original_id, review_id || '-' || CAST(article_id AS VARCHAR) AS title,
  CASE WHEN article_id % 2 = 0 THEN 'abstract ' || CAST(article_id AS VARCHAR) END AS abstract,
  CAST(publication_year AS VARCHAR) AS publication_year
FROM articles""",
    "load_results": f"""WITH {SQL_ARTICLES},
st AS (SELECT database, review_id, row_number() OVER (ORDER BY database, review_id) AS search_strategy_id
       FROM (SELECT DISTINCT database, review_id FROM articles)),
r AS (SELECT s.search_strategy_id, a.article_id, a.original_id, a.publication_year FROM articles a JOIN st s USING (database, review_id)),
earlier AS (SELECT *, row_number() OVER (ORDER BY search_strategy_id, original_id, article_id) AS search_result_article_id
            FROM r WHERE publication_year < 2000),
new AS (SELECT * FROM r WHERE NOT EXISTS (SELECT 1 FROM earlier e WHERE e.search_strategy_id = r.search_strategy_id
                                          AND e.original_id = r.original_id))
SELECT search_strategy_id, article_id, original_id,
  (SELECT coalesce(max(search_result_article_id), 0) FROM earlier)
    + row_number() OVER (ORDER BY search_strategy_id, original_id, article_id) AS search_result_article_id
FROM new""",
    "eligible_reviews": f"""WITH {SQL_TRUTH},
r AS (SELECT review_id, count(*) AS included_num,
        CASE WHEN count(*) FILTER (WHERE sr_update = 'Y') > 0 THEN 'SR' ELSE 'other' END AS t
      FROM truth GROUP BY review_id)
SELECT review_id, included_num FROM r WHERE t = 'SR' AND included_num >= 5""",
    "strategy_catalog": f"""WITH {SQL_ARTICLES}, {SQL_TRUTH},
dbs AS (SELECT * FROM (VALUES (1, 'pubmed'), (2, 'medline'), (3, 'embase'), (4, 'openalex')) v(database_id, database)),
rv AS (SELECT DISTINCT review_id FROM truth UNION ALL SELECT 'overall'),
s AS (SELECT DISTINCT database FROM articles),
sh AS (SELECT unnest(['zero-shot', 'one-shot', 'few-shot']) AS vector_search)
SELECT d.database_id, s.database, CASE WHEN rv.review_id = 'overall' THEN 'overarching' ELSE 'topic-specific' END AS search_type,
  rv.review_id, sh.vector_search,
  CASE s.database WHEN 'pubmed' THEN 1 WHEN 'medline' THEN 2 WHEN 'embase' THEN 3 WHEN 'openalex' THEN 4 ELSE 5 END AS database_order
FROM s, rv, sh, dbs d WHERE d.database = s.database""",
    "vs_report": _metrics_sql("q0.shot = 'few-shot'", select="*").replace(
        "\nSELECT * FROM z", """,
r AS (
  SELECT scope, shot, database, review_id,
    CASE WHEN scope = 'overall' THEN 'O+OVS' ELSE 'O+TVS' END AS workflow,
    recall_cutoff AS recall, precision_cutoff AS precision,
    coalesce(nnr_cutoff, 1.0 / nullif(precision_cutoff, 0)) AS nnr,
    overall_screening_workload_cutoff AS overall_screening_workload,
    coalesce(rank_new_relevant, 0) AS rank_new_relevant, coalesce(mrr_new_relevant, 0) AS mrr_new_relevant
  FROM z WHERE truth_kind = 'raw'
),
l AS (SELECT *, workflow || ' + ' || shot AS workflow_group,
        upper(substr(database, 1, 1)) || lower(substr(database, 2)) AS database_label,
        recall * 100.0 AS recall_pct, precision * 100.0 AS precision_pct FROM r)
SELECT """ + _VS_COLS + " FROM l"),
    "combined_table": _WM + ",\n" + _pairs("recall") + ",\n" + _wilcoxon("pr", "wx") + """,
summ AS (SELECT workflow AS "group", database, quantile_cont(recall, 0.5) AS recall_median FROM wm GROUP BY ALL),
l AS (SELECT database, avg(ln(value_b + 1e-6) - ln(value_a + 1e-6)) AS estimate FROM pr GROUP BY database),
c AS (SELECT l.database, 'O' AS "group", l.estimate, wx.p_value FROM l LEFT JOIN wx USING (database))
SELECT s.database, s."group", round(s.recall_median, 6) AS recall_median, round(c.estimate, 6) AS estimate,
  round(c.p_value, 6) AS p_value, s."group" = 'T' AS is_reference,
  CASE WHEN s."group" = 'T' THEN 'reference' ELSE s."group" || ' vs T' END AS contrast
FROM summ s LEFT JOIN c ON s.database = c.database AND s."group" = c."group\"""",
    "null_report": f"""WITH {SQL_TRUTH},
n AS (SELECT count(*) AS n_rows, count(*) FILTER (WHERE ground_truth_article_id IS NULL OR review_id IS NULL
        OR retrieved_pubmed_id IS NULL OR retrieved_embase_id IS NULL OR retrieved_oa_id IS NULL
        OR publication_year IS NULL OR searchstrat_year_start IS NULL OR sr_update IS NULL) AS rows_with_null FROM truth)
SELECT c.column, c.n_null, n.n_rows, n.rows_with_null FROM n, (
  SELECT 'ground_truth_article_id' AS column, count(*) FILTER (WHERE ground_truth_article_id IS NULL) AS n_null FROM truth
  UNION ALL SELECT 'review_id', count(*) FILTER (WHERE review_id IS NULL) FROM truth
  UNION ALL SELECT 'retrieved_pubmed_id', count(*) FILTER (WHERE retrieved_pubmed_id IS NULL) FROM truth
  UNION ALL SELECT 'retrieved_embase_id', count(*) FILTER (WHERE retrieved_embase_id IS NULL) FROM truth
  UNION ALL SELECT 'retrieved_oa_id', count(*) FILTER (WHERE retrieved_oa_id IS NULL) FROM truth
  UNION ALL SELECT 'publication_year', count(*) FILTER (WHERE publication_year IS NULL) FROM truth
  UNION ALL SELECT 'searchstrat_year_start', count(*) FILTER (WHERE searchstrat_year_start IS NULL) FROM truth
  UNION ALL SELECT 'sr_update', count(*) FILTER (WHERE sr_update IS NULL) FROM truth) c""",
    "distinct_counts": f"""WITH {SQL_ARTICLES}
SELECT database, count(*) AS n_rows, count(DISTINCT {sql_clean_id('original_id')}) AS n_distinct_ids,
       count(DISTINCT review_id) AS n_reviews FROM articles GROUP BY database""",
}
