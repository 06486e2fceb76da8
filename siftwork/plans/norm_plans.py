"""Normalisation, filter, date-window and registry plans over the driver
tables, and their oracle SQL.  Messy inputs (years, question ids, ids) are
derived from the tables by fixed rules, so every row of the table is
processed."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.ids import clean_id, clean_year, fix_question_id, std_question_id
from ..functions.keyword import And, Not, Or, Term, compile_query
from ..functions.metrics import signif
from ..functions.text import decode_inverted_index, strip_tags, with_inverted_index
from ..operators.registry import (assign_ids, fan_out, max_id, new_rows, new_rows_null_safe,
                                  upsert)
from ..operators.truth import first_per_group, merge_sources, recode_review_type
from ..operators.windows import assign_window, check_windows, date_windows
from ..schemas import SHOTS
from . import driver
from .common import SQL_ARTICLES, SQL_TRUTH, round_doubles, sql_clean_id

# ------------------------------------------------------------ Spark side --


def _messy_year():
    d = F.col("doc_id")
    y = (F.lit(1985) + d % 45).cast("string")
    m = d % 9
    return (F.when(m == 0, F.concat(y, F.lit("//"))).when(m == 1, F.concat(F.lit("/"), y, F.lit("/")))
            .when(m == 2, F.concat(y, F.lit(",03"))).when(m == 3, F.concat(F.lit(" "), y, F.lit(".0 ")))
            .when(m == 4, F.concat(y, F.lit(".5"))).when(m == 5, F.lit("")).when(m == 6, F.lit("nan"))
            .when(m == 7, F.lit("abcd")).otherwise(y))


def _messy_question():
    d = F.col("doc_id")
    a = (d % 4 + 1).cast("string")
    b = (d % 7).cast("string")
    c = (d % 3 + 1).cast("string")
    m = d % 5
    return (F.when(m == 0, F.concat(F.lit(" "), a, F.lit("."), b, F.lit(". ")))
            .when(m == 1, F.concat(a, F.lit("."), b, F.lit(", "), a, F.lit("."), c))
            .when(m == 2, F.concat(a, F.lit("."), b, F.lit(" / "), a, F.lit("."), c))
            .when(m == 3, F.concat(F.lit("Q"), a, F.lit("."), b))
            .otherwise(F.concat(F.lit("1.10."), c)))


def clean_ids_q(spark, sf):
    a = driver.articles(spark, sf)
    return a.select("article_id", "original_id", clean_id("original_id").alias("clean_id"))


def clean_years_q(spark, sf):
    d = driver.table(spark, sf, "documents").select("doc_id", _messy_year().alias("raw_year"))
    return d.select("doc_id", "raw_year", clean_year("raw_year").alias("year"))


def question_ids_q(spark, sf):
    d = driver.table(spark, sf, "documents").select("doc_id", _messy_question().alias("raw_id"))
    return d.select("doc_id", "raw_id", fix_question_id("raw_id").alias("slash_id"),
                    std_question_id("raw_id").alias("comma_id"))


def strip_html_q(spark, sf):
    p = driver.table(spark, sf, "pages")
    return p.select("page_id", strip_tags("html").alias("text"))


def decode_abstract_q(spark, sf):
    """Whole texts -> inverted index {word: positions} -> decoded abstract,
    plus the flattened id struct of an OpenAlex-shaped record.  Both the
    index and the decoding are per-row array expressions (no shuffle)."""
    d = with_inverted_index(driver.table(spark, sf, "documents").select("doc_id", "text"), "text")
    rec = d.select("doc_id", F.struct(F.concat(F.lit("W"), F.col("doc_id").cast("string")).alias("openalex"),
                                      F.col("doc_id").cast("string").alias("pmid")).alias("ids"),
                   "abstract_inverted_index")
    return rec.select("doc_id", "ids.*", decode_inverted_index("abstract_inverted_index").alias("abstract"))


def _sources(spark, sf):
    d = driver.table(spark, sf, "documents")
    i = F.col("doc_id").cast("string")
    pm = d.where(F.col("doc_id") % 2 == 0).select(
        "doc_id", F.concat(F.lit("pm-"), i).alias("title"),
        F.coalesce(F.when(F.col("doc_id") % 4 != 0, F.concat(F.lit("pm abstract "), i)),
                   F.concat(F.lit("pm2 "), i)).alias("abstract"))
    em = d.where(F.col("doc_id") % 3 == 0).select(
        "doc_id", F.when(F.col("doc_id") % 9 != 0, F.concat(F.lit("em-"), i)).alias("title"),
        F.concat(F.lit("em abstract "), i).alias("abstract"))
    oa = d.where(F.col("doc_id") % 5 == 0).select(
        "doc_id", F.concat(F.lit("oa-"), i).alias("title"), F.concat(F.lit("oa abstract "), i).alias("abstract"))
    return [("pubmed", pm), ("embase", em), ("openalex", oa)]


def coalesce_sources_q(spark, sf):
    t = driver.truth(spark, sf).select(F.col("ground_truth_article_id").alias("doc_id"), "review_id")
    return merge_sources(t, _sources(spark, sf), "doc_id", ["title", "abstract"])


def recode_type_q(spark, sf):
    t = driver.truth(spark, sf)
    return t.select("ground_truth_article_id", "sr_update",
                    recode_review_type("sr_update").alias("evidence_review_type"))


def sigfig_q(spark, sf):
    li = driver.table(spark, sf, "lineitem")
    return round_doubles(li.select("l_orderkey", "l_linenumber",
                                   signif("l_extendedprice", 4).alias("price_4sf"),
                                   signif("l_discount", 2).alias("discount_2sf")))


def log_epsilon_q(spark, sf):
    li = driver.table(spark, sf, "lineitem")
    from ..operators.report import log_with_epsilon
    out = log_with_epsilon(li.select("l_orderkey", "l_linenumber", "l_discount", "l_tax"),
                           ["l_discount", "l_tax"])
    return round_doubles(out.select("l_orderkey", "l_linenumber", "log_l_discount", "log_l_tax"))


KEYWORD_QUERY = Or(And(Term("the", ("text",)), Term("ation*", ("text",))),
                   And(Term("le", ("text",)), Not(Term("des", ("text",)))),
                   Term("und der", ("text",)))


def keyword_search_q(spark, sf):
    d = driver.table(spark, sf, "documents")
    return d.select("doc_id", compile_query(KEYWORD_QUERY).alias("matched"))


def topic_filter_q(spark, sf):
    a = driver.articles(spark, sf)
    keep = (F.col("review_id").isin("src1", "src2", "src3") & F.col("database").isin("pubmed", "openalex")
            & F.col("publication_year").between(2000, 2010))
    return a.where(keep).select("article_id", "database", "review_id", "publication_year")


def first_per_group_q(spark, sf):
    a = driver.articles(spark, sf)
    return first_per_group(a, ["database", "review_id"], [F.col("article_id").asc()]) \
        .select("database", "review_id", "article_id", "original_id")


def new_keys_q(spark, sf):
    a = driver.articles(spark, sf).select("article_id", clean_id("original_id").alias("clean_id"))
    known = driver.truth(spark, sf).select(clean_id("retrieved_pubmed_id").alias("clean_id")) \
        .where(F.col("clean_id").isNotNull())
    return new_rows(a, known, ["clean_id"])


def null_safe_new_q(spark, sf):
    t = driver.truth(spark, sf)
    cols = ["review_id", "sr_update", "searchstrat_year_start"]
    cand = t.select(*cols).distinct()
    existing = t.where(F.col("publication_year") < 2000).select(*cols).distinct()
    return new_rows_null_safe(cand, existing, cols)


def upsert_q(spark, sf):
    base = driver.table(spark, sf, "labels")
    upd = driver.table(spark, sf, "documents").where(F.col("lang") == "de").select(
        "doc_id", F.when(F.col("n_chars") > 5000, 1).otherwise(0).cast("int").alias("quality"),
        F.lit(0).cast("int").alias("toxic"))
    return upsert(base, upd, ["doc_id"])


def fan_out_q(spark, sf):
    strategies = driver.articles(spark, sf).select("database").distinct()
    reviews = driver.truth(spark, sf).select("review_id")
    f = fan_out(strategies, reviews, SHOTS)
    start = max_id(driver.table(spark, sf, "labels"), "doc_id")
    return assign_ids(f, ["database", "review_id", "vector_search"], start, name="search_strategy_id")


def assign_ids_q(spark, sf):
    a = driver.articles(spark, sf).select("article_id", "database", "original_id")
    start = max_id(driver.table(spark, sf, "labels"), "doc_id")
    return assign_ids(a, ["database", "original_id", "article_id"], start, name="new_id") \
        .select("article_id", "new_id")


def _order_bounds(spark, sf):
    o = driver.table(spark, sf, "orders")
    return o.agg(F.trunc(F.min("o_orderdate"), "year").alias("start"),
                 F.to_date(F.max("o_orderdate")).alias("end"))


def date_windows_q(spark, sf):
    return date_windows(_order_bounds(spark, sf), years=2)


def dq_windows_q(spark, sf):
    return check_windows(date_windows(_order_bounds(spark, sf), years=1))


def window_assign_q(spark, sf):
    o = driver.table(spark, sf, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("order_date"))
    return assign_window(o, "order_date")


QUERIES = {
    "clean_ids": clean_ids_q,
    "clean_years": clean_years_q,
    "std_question_id": question_ids_q,
    "strip_html": strip_html_q,
    "decode_abstract": decode_abstract_q,
    "coalesce_sources": coalesce_sources_q,
    "recode_type": recode_type_q,
    "sigfig": sigfig_q,
    "log_epsilon": log_epsilon_q,
    "keyword_search": keyword_search_q,
    "topic_filter": topic_filter_q,
    "first_per_group": first_per_group_q,
    "new_keys": new_keys_q,
    "null_safe_new": null_safe_new_q,
    "upsert": upsert_q,
    "fan_out": fan_out_q,
    "assign_ids": assign_ids_q,
    "date_windows": date_windows_q,
    "dq_windows": dq_windows_q,
    "window_assign": window_assign_q,
}

# ------------------------------------------------------------- oracle SQL --

_Y = "CAST(1985 + doc_id % 45 AS VARCHAR)"
_SQL_MESSY_YEAR = (f"CASE doc_id % 9 WHEN 0 THEN {_Y} || '//' WHEN 1 THEN '/' || {_Y} || '/' "
                   f"WHEN 2 THEN {_Y} || ',03' WHEN 3 THEN ' ' || {_Y} || '.0 ' WHEN 4 THEN {_Y} || '.5' "
                   f"WHEN 5 THEN '' WHEN 6 THEN 'nan' WHEN 7 THEN 'abcd' ELSE {_Y} END")
_A, _B, _C = ("CAST(doc_id % 4 + 1 AS VARCHAR)", "CAST(doc_id % 7 AS VARCHAR)",
              "CAST(doc_id % 3 + 1 AS VARCHAR)")
_SQL_MESSY_Q = (f"CASE doc_id % 5 WHEN 0 THEN ' ' || {_A} || '.' || {_B} || '. ' "
                f"WHEN 1 THEN {_A} || '.' || {_B} || ', ' || {_A} || '.' || {_C} "
                f"WHEN 2 THEN {_A} || '.' || {_B} || ' / ' || {_A} || '.' || {_C} "
                f"WHEN 3 THEN 'Q' || {_A} || '.' || {_B} ELSE '1.10.' || {_C} END")

_KW = ("(regexp_matches(lower(text), '(^|[^\\p{L}\\p{N}_])the([^\\p{L}\\p{N}_]|$)') "
       "AND regexp_matches(lower(text), '(^|[^\\p{L}\\p{N}_])ation[\\p{L}\\p{N}_]*')) "
       "OR (regexp_matches(lower(text), '(^|[^\\p{L}\\p{N}_])le([^\\p{L}\\p{N}_]|$)') "
       "AND NOT regexp_matches(lower(text), '(^|[^\\p{L}\\p{N}_])des([^\\p{L}\\p{N}_]|$)')) "
       "OR regexp_matches(lower(text), '(^|[^\\p{L}\\p{N}_])und\\s+der([^\\p{L}\\p{N}_]|$)')")

_SQL_SIGFIG = ("CASE WHEN {x} = 0 THEN 0.0 ELSE round({x} * pow(10.0, {k} - floor(log10(abs({x})))))"
               " / pow(10.0, {k} - floor(log10(abs({x})))) END")

_SQL_BOUNDS = """
b AS (SELECT date_trunc('year', min(o_orderdate))::DATE AS s, max(o_orderdate)::DATE AS e FROM orders)"""


def _sql_windows(years: int) -> str:
    return f"""{_SQL_BOUNDS},
st AS (
  SELECT b.s, b.e, CAST(g.t AS DATE) AS window_start,
         CAST(row_number() OVER (ORDER BY g.t) - 1 AS INTEGER) AS window_id
  FROM b, generate_series(CAST(b.s AS TIMESTAMP), CAST(b.e AS TIMESTAMP), INTERVAL {years} YEAR) g(t)
),
w AS (
  SELECT window_id, window_start,
         coalesce(CAST(lead(window_start) OVER (ORDER BY window_start) - INTERVAL 1 DAY AS DATE), e) AS window_end
  FROM st
)"""


ORACLES = {
    "clean_ids": f"WITH {SQL_ARTICLES}\nSELECT article_id, original_id, {sql_clean_id('original_id')} AS clean_id FROM articles",
    "clean_years": f"""WITH x AS (SELECT doc_id, {_SQL_MESSY_YEAR} AS raw_year FROM documents),
s AS (SELECT doc_id, raw_year,
        trim(split_part(trim(regexp_replace(replace(raw_year, '//', ''), '^/+|/+$', '', 'g')), ',', 1)) AS s
      FROM x),
d AS (SELECT doc_id, raw_year, CASE WHEN s IN ('', 'nan', 'None', 'NaT') THEN NULL ELSE TRY_CAST(s AS DOUBLE) END AS v FROM s)
SELECT doc_id, raw_year, CASE WHEN v = floor(v) THEN CAST(v AS INTEGER) END AS year FROM d""",
    "std_question_id": f"""WITH x AS (SELECT doc_id, {_SQL_MESSY_Q} AS raw_id FROM documents)
SELECT doc_id, raw_id,
  trim(lower(regexp_replace(replace(regexp_replace(raw_id, '\\s+', '', 'g'), ',', '/'), '\\.$', ''))) AS slash_id,
  regexp_replace(regexp_replace(regexp_replace(replace(raw_id, '/', ','), '\\s*,\\s*', ',', 'g'), '\\s+', '', 'g'), '\\.$', '') AS comma_id
FROM x""",
    "strip_html": "SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g')) AS text FROM pages",
    "decode_abstract": "SELECT doc_id, 'W' || CAST(doc_id AS VARCHAR) AS openalex, CAST(doc_id AS VARCHAR) AS pmid, "
                       "trim(regexp_replace(text, '\\s+', ' ', 'g')) AS abstract FROM documents",
    "coalesce_sources": f"""WITH {SQL_TRUTH},
pm AS (SELECT doc_id, 'pm-' || CAST(doc_id AS VARCHAR) AS title,
              coalesce(CASE WHEN doc_id % 4 <> 0 THEN 'pm abstract ' || CAST(doc_id AS VARCHAR) END,
                       'pm2 ' || CAST(doc_id AS VARCHAR)) AS abstract FROM documents WHERE doc_id % 2 = 0),
em AS (SELECT doc_id, CASE WHEN doc_id % 9 <> 0 THEN 'em-' || CAST(doc_id AS VARCHAR) END AS title,
              'em abstract ' || CAST(doc_id AS VARCHAR) AS abstract FROM documents WHERE doc_id % 3 = 0),
oa AS (SELECT doc_id, 'oa-' || CAST(doc_id AS VARCHAR) AS title,
              'oa abstract ' || CAST(doc_id AS VARCHAR) AS abstract FROM documents WHERE doc_id % 5 = 0)
SELECT t.ground_truth_article_id AS doc_id, t.review_id,
       coalesce(pm.title, em.title, oa.title) AS title,
       coalesce(pm.abstract, em.abstract, oa.abstract) AS abstract
FROM truth t LEFT JOIN pm ON pm.doc_id = t.ground_truth_article_id
LEFT JOIN em ON em.doc_id = t.ground_truth_article_id LEFT JOIN oa ON oa.doc_id = t.ground_truth_article_id""",
    "recode_type": f"""WITH {SQL_TRUTH}
SELECT ground_truth_article_id, sr_update,
  CASE sr_update WHEN 'Y' THEN 'systematic review update' WHEN 'N' THEN 'new systematic review'
  ELSE 'narrative reivew' END AS evidence_review_type FROM truth""",
    "sigfig": "SELECT l_orderkey, l_linenumber, round(" + _SQL_SIGFIG.format(x="l_extendedprice", k=3)
              + ", 9) AS price_4sf, round(" + _SQL_SIGFIG.format(x="l_discount", k=1) + ", 9) AS discount_2sf FROM lineitem",
    "log_epsilon": """WITH e AS (
  SELECT greatest(min(l_discount) FILTER (WHERE l_discount > 0) / 10, 1e-6) AS ed,
         greatest(min(l_tax) FILTER (WHERE l_tax > 0) / 10, 1e-6) AS et FROM lineitem)
SELECT l_orderkey, l_linenumber, round(ln(l_discount + ed), 9) AS log_l_discount,
       round(ln(l_tax + et), 9) AS log_l_tax FROM lineitem, e""",
    "keyword_search": f"SELECT doc_id, coalesce({_KW}, false) AS matched FROM documents",
    "topic_filter": f"""WITH {SQL_ARTICLES}
SELECT article_id, database, review_id, publication_year FROM articles
WHERE review_id IN ('src1', 'src2', 'src3') AND database IN ('pubmed', 'openalex')
  AND publication_year BETWEEN 2000 AND 2010""",
    "first_per_group": f"""WITH {SQL_ARTICLES}
SELECT database, review_id, article_id, original_id FROM articles
QUALIFY row_number() OVER (PARTITION BY database, review_id ORDER BY article_id) = 1""",
    "new_keys": f"""WITH {SQL_ARTICLES}, {SQL_TRUTH},
a AS (SELECT article_id, {sql_clean_id('original_id')} AS clean_id FROM articles),
k AS (SELECT {sql_clean_id('retrieved_pubmed_id')} AS clean_id FROM truth)
SELECT article_id, clean_id FROM a
WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.clean_id = a.clean_id)""",
    "null_safe_new": f"""WITH {SQL_TRUTH},
c AS (SELECT DISTINCT review_id, sr_update, searchstrat_year_start FROM truth),
e AS (SELECT DISTINCT review_id, sr_update, searchstrat_year_start FROM truth WHERE publication_year < 2000)
SELECT * FROM c WHERE NOT EXISTS (
  SELECT 1 FROM e WHERE e.review_id IS NOT DISTINCT FROM c.review_id
    AND e.sr_update IS NOT DISTINCT FROM c.sr_update
    AND e.searchstrat_year_start IS NOT DISTINCT FROM c.searchstrat_year_start)""",
    "upsert": """WITH u AS (
  SELECT doc_id, quality, toxic, 0 AS src FROM labels
  UNION ALL
  SELECT doc_id, CAST(CASE WHEN n_chars > 5000 THEN 1 ELSE 0 END AS INTEGER), CAST(0 AS INTEGER), 1
  FROM documents WHERE lang = 'de')
SELECT doc_id, quality, toxic FROM u
QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY src DESC) = 1""",
    "fan_out": f"""WITH {SQL_ARTICLES}, {SQL_TRUTH},
s AS (SELECT DISTINCT database FROM articles),
r AS (SELECT DISTINCT review_id FROM truth),
v AS (SELECT unnest(['zero-shot', 'one-shot', 'few-shot']) AS vector_search)
SELECT database, review_id, vector_search,
  (SELECT coalesce(max(doc_id), 0) FROM labels)
    + row_number() OVER (ORDER BY database, review_id, vector_search) AS search_strategy_id
FROM s, r, v""",
    "assign_ids": f"""WITH {SQL_ARTICLES}
SELECT article_id, (SELECT coalesce(max(doc_id), 0) FROM labels)
  + row_number() OVER (ORDER BY database, original_id, article_id) AS new_id FROM articles""",
    "date_windows": "WITH " + _sql_windows(2)[1:] + "\nSELECT window_id, window_start, window_end FROM w",
    "dq_windows": "WITH " + _sql_windows(1)[1:] + """,
n AS (SELECT *, lead(window_start) OVER (ORDER BY window_start) AS next_start FROM w)
SELECT window_id, window_start, window_end, next_start FROM n
WHERE next_start IS NOT NULL AND datediff('day', window_end, next_start) <> 1""",
    "window_assign": """WITH st AS (
  SELECT CAST(g.t AS DATE) AS window_start, CAST(row_number() OVER (ORDER BY g.t) - 1 AS INTEGER) AS window_id
  FROM generate_series(TIMESTAMP '1990-01-01', TIMESTAMP '2022-12-31', INTERVAL 2 YEAR) g(t)),
w AS (SELECT window_id, window_start,
        coalesce(CAST(lead(window_start) OVER (ORDER BY window_start) - INTERVAL 1 DAY AS DATE), DATE '2022-12-31') AS window_end
      FROM st)
SELECT o_orderkey, CAST(o_orderdate AS DATE) AS order_date, w.window_id, w.window_start, w.window_end
FROM orders LEFT JOIN w ON CAST(o_orderdate AS DATE) BETWEEN w.window_start AND w.window_end""",
}
