"""Helpers shared by the registered plans and their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DATABASES4 = ["pubmed", "medline", "embase", "openalex"]


def round_doubles(df: DataFrame, decimals: int = 9, overrides: dict[str, int] | None = None) -> DataFrame:
    """Round every double column (oracle comparisons hash exact values)."""
    overrides = overrides or {}
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            out.append(F.round(F.col(f.name).cast("double"), overrides.get(f.name, decimals)).alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


# ---------------------------------------------------------------- SQL side --

def sql_round(cols: list[str], decimals: int = 9, overrides: dict[str, int] | None = None) -> str:
    overrides = overrides or {}
    return ", ".join(f"round(CAST({c} AS DOUBLE), {overrides.get(c, decimals)}) AS {c}" for c in cols)


SQL_DB_OF_MOD4 = ("CASE {c} % 4 WHEN 0 THEN 'pubmed' WHEN 1 THEN 'medline' "
                  "WHEN 2 THEN 'embase' ELSE 'openalex' END")

SQL_DB_OF_LANG = ("CASE {c} WHEN 'en' THEN 'pubmed' WHEN 'fr' THEN 'medline' "
                  "WHEN 'de' THEN 'embase' WHEN 'es' THEN 'openalex' END")


def sql_clean_id(expr: str) -> str:
    """SQL twin of functions.ids.clean_id."""
    return (f"nullif(regexp_replace(regexp_replace(lower({expr}), '^\\s+|\\s+$', '', 'g'), "
            f"'^https://openalex\\.org/', ''), '')")


def sql_messy_id(n: str, key: str) -> str:
    return (f"CASE {n} % 3 WHEN 0 THEN 'https://openalex.org/W' || upper({key}) "
            f"WHEN 1 THEN ' w' || {key} || ' ' ELSE 'W' || upper({key}) END")


# documents as search results
SQL_ARTICLES = f"""
articles AS (
  SELECT doc_id AS article_id,
         {SQL_DB_OF_LANG.format(c='lang')} AS database,
         source AS review_id,
         {sql_messy_id('doc_id', 'md5(text)')} AS original_id,
         CAST(1985 + doc_id % 45 AS INTEGER) AS publication_year,
         text
  FROM documents
)"""

# labels (quality = 1) as the included articles
SQL_TRUTH = f"""
truth AS (
  SELECT doc_id AS ground_truth_article_id,
         source AS review_id,
         md5(text) AS included_reference,
         CASE WHEN doc_id % 7 <> 0 THEN {sql_messy_id('doc_id', 'md5(text)')} END AS retrieved_pubmed_id,
         CASE WHEN doc_id % 7 <> 1 THEN {sql_messy_id('doc_id', 'md5(text)')} END AS retrieved_embase_id,
         CASE WHEN doc_id % 7 <> 2 THEN {sql_messy_id('doc_id', 'md5(text)')} END AS retrieved_oa_id,
         CAST(1985 + doc_id % 45 AS INTEGER) AS publication_year,
         CASE WHEN doc_id % 11 <> 0 THEN CAST(2000 + doc_id % 10 AS INTEGER) END AS searchstrat_year_start,
         CASE WHEN doc_id % 3 = 0 THEN 'Y' WHEN doc_id % 3 = 1 THEN 'N' END AS sr_update
  FROM documents
  WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)
)"""

def sql_truth_long(src: str = "truth", name: str = "truth_long") -> str:
    """Truth in long form: one row per (article, database, kind)."""
    return f"""
{name} AS (
  SELECT ground_truth_article_id, review_id, database, clean_id, kind.truth_kind
  FROM (
    SELECT ground_truth_article_id, review_id, 'pubmed' AS database, {sql_clean_id('retrieved_pubmed_id')} AS clean_id FROM {src}
    UNION ALL SELECT ground_truth_article_id, review_id, 'medline', {sql_clean_id('retrieved_pubmed_id')} FROM {src}
    UNION ALL SELECT ground_truth_article_id, review_id, 'embase', {sql_clean_id('retrieved_embase_id')} FROM {src}
    UNION ALL SELECT ground_truth_article_id, review_id, 'openalex', {sql_clean_id('retrieved_oa_id')} FROM {src}
  ) t
  JOIN (VALUES ('raw'), ('adjusted')) kind(truth_kind)
    ON kind.truth_kind = 'raw' OR t.clean_id IS NOT NULL
)"""


SQL_TRUTH_LONG = sql_truth_long()

# embeddings as four search spaces
SQL_VECTORS = f"""
v AS (
  SELECT vec_id AS article_id, CAST(label AS VARCHAR) AS review_id,
         {SQL_DB_OF_MOD4.format(c='vec_id')} AS database,
         CASE WHEN vec_id % 5 = 0 THEN 'V' ELSE 'v' END || CAST(vec_id AS VARCHAR) AS original_id,
         CAST(embedding AS DOUBLE[]) AS embedding
  FROM embeddings
)"""
