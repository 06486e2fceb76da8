"""Checks over tables with planted violations, file-format and text clean-up
plans with known answers, and the report tables over ranked results.

The planted rows are derived from the driver tables by fixed rules, so every
check finds something, and more of it in larger tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.ids import question_from_file_name
from ..functions.text import clean_html
from ..operators.quality import (check_conservation, check_fan_out, check_foreign_key, check_metric_bounds,
                                 check_min_rows, check_schema, check_subset, check_table_equality)
from ..operators.registry import assign_ids, fan_out, register
from ..operators.report import order_key, pre_ranking_change, published_totals, ranking_change, reference_first
from ..operators.retrieval import hash_counts
from ..operators.windows import check_windows, date_windows
from ..schemas import DATABASE_ORDER, QUESTION_ID_REMAP, SHOTS
from ..sources.ris import parse_records, project_fields, remap_question
from ..sources.sinks import path_safe
from . import driver
from .common import SQL_ARTICLES, SQL_TRUTH, round_doubles
from .eval_plans import _SQL_TOPIC_COUNTS, long_truth, topic_metrics_df
from .hybrid_plans import ORACLES as _HYBRID
from .hybrid_plans import SearchThenRank
from .norm_plans import _sql_windows, _order_bounds
from .report_plans import _WM, workflow_metrics
from .vector_plans import ORACLES as _VECTOR
from .vector_plans import VectorRun

ORPHAN = 1 << 40


def dq_orphans_q(spark, sf):
    """Foreign key (DQ-8): every seventh label points beyond the documents."""
    lab = driver.table(spark, sf, "labels").withColumn(
        "doc_id", F.when(F.col("doc_id") % 7 == 0, F.col("doc_id") + ORPHAN).otherwise(F.col("doc_id")))
    return check_foreign_key(lab, driver.table(spark, sf, "documents"), ["doc_id"])


def dq_subset_sides_q(spark, sf):
    """Subset both ways (DQ-3, SET-4): either side lacks some reviews; src3 is a known exception."""
    a = driver.truth(spark, sf).select("review_id").where(~F.col("review_id").isin("src1", "src2"))
    b = driver.articles(spark, sf).select("review_id").where(~F.col("review_id").isin("src2", "src3", "src4"))
    return check_subset(a, b, ["review_id"], allowed=["src3"])


def dq_conservation_lost_q(spark, sf):
    """Conservation (DQ-5): one missed row too many in four reviews."""
    m = topic_metrics_df(spark, sf).withColumn(
        "n_missed", F.col("n_missed") + F.when(F.col("review_id").isin("src1", "src2", "src3", "src4"), 1).otherwise(0))
    t = long_truth(spark, sf).groupBy("database", "review_id", "truth_kind").agg(F.count(F.lit(1)).alias("n_truth"))
    return check_conservation(m, t, ["database", "review_id", "truth_kind"]).select(
        "database", "review_id", "truth_kind", "n_retrieved", "n_missed", "n_truth")


def dq_metrics_bounds_q(spark, sf):
    """Bounds and equal pairs (DQ-6): a recall above one, a cut-off recall unlike the recall."""
    m = topic_metrics_df(spark, sf).select("database", "review_id", "truth_kind", "recall", "precision")
    m = m.withColumn("recall_cutoff", F.when(F.col("database") == "embase", F.col("recall") / 2).otherwise(F.col("recall")))
    m = m.withColumn("recall", F.when(F.col("review_id") == "src1", F.col("recall") + 2).otherwise(F.col("recall")))
    out = check_metric_bounds(m, ["recall", "precision"], [("recall", "recall_cutoff")])
    return round_doubles(out.select("database", "review_id", "truth_kind", "recall", "recall_cutoff"), 6)


def dq_windows_gaps_q(spark, sf):
    """Date windows (DQ-9): every third one ends a day early."""
    w = date_windows(_order_bounds(spark, sf), years=1)
    w = w.withColumn("window_end", F.when(F.col("window_id") % 3 == 1, F.date_sub("window_end", 1)).otherwise(F.col("window_end")))
    return check_windows(w)


def dq_schema_q(spark, sf):
    """Columns against a target schema (DQ-1)."""
    want = T.StructType([T.StructField(c, T.StringType()) for c in ("doc_id", "text", "source", "title", "abstract")])
    return check_schema(spark, driver.table(spark, sf, "documents"), want)


def dq_min_rows_q(spark, sf):
    """Least number of rows (DQ-2): labels are fewer than a billion."""
    return check_min_rows(driver.table(spark, sf, "labels"), 1_000_000_000, "labels")


def dq_table_equality_q(spark, sf):
    """A stored copy against its source (DQ-2): some ids missing, some new, some doubled."""
    d = driver.table(spark, sf, "documents").select("doc_id", "source")
    copy = d.where(F.col("doc_id") % 11 != 0).withColumn(
        "doc_id", F.when(F.col("doc_id") % 13 == 0, F.col("doc_id") + ORPHAN).otherwise(F.col("doc_id")))
    copy = copy.unionByName(copy.where(F.col("doc_id") % 17 == 0))
    return check_table_equality(copy, d, ["doc_id"])


def dq_fan_out_q(spark, sf):
    """Size of the fan-out (DQ-13): the few-shot rows of one review are lost."""
    strategies = driver.articles(spark, sf).select("database").distinct()
    reviews = driver.truth(spark, sf).select("review_id").distinct()
    fanned = fan_out(strategies, reviews, SHOTS)
    lost = fanned.where(~((F.col("review_id") == "src1") & (F.col("vector_search") == "few-shot")))
    return check_fan_out(lost, strategies, reviews, len(SHOTS))


def _records(spark, sf):
    d = driver.table(spark, sf, "documents")
    n = F.col("doc_id").cast("string")
    end = F.when(F.col("doc_id") % 2 == 0, "\r\n").otherwise("\n")
    lines = F.concat_ws("\n", F.lit("TY  - JOUR"), F.concat(F.lit("TI  - Title of "), n, F.lit(", CANCER  - part")),
                        F.concat(F.lit("  continued "), n), F.concat(F.lit("AU  - First, A"), n), F.lit("AU  - Second, B"),
                        F.concat(F.lit("PY  - "), (F.col("doc_id") % 30 + 1990).cast("string"), F.lit("//")),
                        F.lit("ZZ  - unknown"), F.concat(F.lit("AN  - "), n))
    return d.select("doc_id", F.replace(lines, F.lit("\n"), end).alias("value"))


def tagged_records_q(spark, sf):
    """Tagged-text records (SRC-3, SRC-5): CRLF, a continuation line, repeated and unknown tags."""
    out = project_fields(parse_records(_records(spark, sf)))
    return out.select("doc_id", "record_type", "primary_title", "accession_number", "publication_year",
                      F.array_join("authors", ";").alias("authors"))


def file_questions_q(spark, sf):
    """Question id from a file name (SRC-4, NRM-3) and back to a folder name (SNK-3)."""
    d = driver.table(spark, sf, "documents")
    name = F.concat(F.lit("gdg"), (F.col("doc_id") % 5 + 1).cast("string"), F.lit("_"), (F.col("doc_id") % 13).cast("string"),
                    F.lit("_embase-"), (F.col("doc_id") % 3 + 1).cast("string"), F.lit(".ris"))
    q = remap_question(question_from_file_name(name))
    return d.select("doc_id", q.alias("question_id"), path_safe(q).alias("question_key"))


# References in titles and abstracts, and what they are to read as.
REFERENCES = [
    ("5&#150;10", "5–10"), ("it&#146;s", "it’s"), ("&#128;", "€"), ("&#0;", "\ufffd"), ("&notit;", "¬it;"), ("&ampx", "&x"), ("AT&ampT", "AT&T"),
    ("&copy2020", "©2020"), ("&#00000150;z", "–z"), ("&#129;", "\x81"), ("&#55296;", "\ufffd"), ("&#1114112;", "\ufffd"), ("&#99999999999;", "\ufffd"),
    ("a&#8;b", "ab"), ("&#xFDD0;", ""), ("&CounterClockwiseContourIntegral;", "∳"), ("&nGt;", "≫⃒"), ("&Amp;", "&Amp;"), ("a&b", "a&b"), ("&;", "&;"),
    ("&#;", "&#;"), ("x &lt; 5", "x < 5"), ("&lt;b&gt;bold&lt;/b&gt;", "<b>bold</b>"), ("&amp;lt;", "&lt;"), ("&#X3b1", "α"), ("&#x1F600;", "😀"),
    ("&eacutes", "és"), ("caf&eacute;", "café"), ("&&amp;", "&&"), ("&nosuch;", "&nosuch;"), ("&hearts;", "♥"), ("10&micro;g", "10µg"),
]


def clean_html_q(spark, sf):
    """Clean-up (NRM-7) of whole texts whose commas have become references and tags."""
    d = driver.table(spark, sf, "documents").select("doc_id", "text")
    ref = F.element_at(F.array(*[F.lit(r) for r, _ in REFERENCES]), (F.col("doc_id") % len(REFERENCES) + 1).cast("int"))
    dirty = F.replace("text", F.lit(","), F.concat(F.lit(" <i class='a'>"), ref, F.lit(" </i><!-- x > y -->")))
    return d.select("doc_id", clean_html(dirty).alias("clean"))


def published_totals_q(spark, sf):
    """Whole-guideline totals (AGG-8) of the topic scope, raw and adjusted."""
    m = VectorRun(spark, sf, scopes=("topic",)).metrics()
    return round_doubles(published_totals(m, ["database", "shot"]))


def ranking_change_q(spark, sf):
    """NNR at the cut-off against the whole ranking (overall scope)."""
    m = VectorRun(spark, sf, scopes=("overall",)).metrics().where(F.col("truth_kind") == "raw")
    return round_doubles(ranking_change(m, ["database", "shot"]), 6)


def pre_ranking_change_q(spark, sf):
    """NNR of the broad search against that of its ranking (topic scope), by
    question and database; a baseline of zero is left out."""
    m = SearchThenRank(spark, sf, scopes=("topic",), shots=("few-shot",)).metrics().where(F.col("truth_kind") == "raw")
    base = workflow_metrics(spark, sf).where(F.col("workflow") == "O").select("review_id", "database", F.col("nnr").alias("nnr_before"))
    return round_doubles(pre_ranking_change(m.select("review_id", "database", F.col("nnr_cutoff").alias("nnr")), base,
                                            ["review_id", "database"]), 6)


_STRATEGY = ["database", "review_id", "vector_search"]


def _registered(spark, sf):
    strategies = driver.articles(spark, sf).select("database").distinct()
    reviews = driver.truth(spark, sf).select("review_id").distinct()
    early = fan_out(strategies, reviews.where("review_id < 'src3'"), SHOTS).select(*_STRATEGY)
    return strategies, reviews, assign_ids(early, _STRATEGY, 0, name="search_strategy_id")


def register_strategies_q(spark, sf):
    """Registration (VEC-6): later reviews join those that are stored."""
    strategies, reviews, stored = _registered(spark, sf)
    return register(strategies, reviews, SHOTS, stored, _STRATEGY)


def hash_counts_q(spark, sf):
    """The default encoder's bucket counts (VEC-1) of every document."""
    v = hash_counts(driver.table(spark, sf, "documents"), "doc_id", "text")
    return v.select("doc_id", F.array_join(F.transform("counts", lambda x: x.cast("string")), " ").alias("counts"))


def ordered_report_q(spark, sf):
    """Ordered output (SRT-1, SRT-3, SRT-4) as positions: databases in report
    order, the broad workflow first as reference, then by review."""
    w = workflow_metrics(spark, sf).select("database", "workflow", "review_id")
    order = [order_key("database", DATABASE_ORDER, "_o"), *reference_first("workflow", "O"), F.col("review_id").asc_nulls_first()]
    return assign_ids(w, order, 0, name="position")


QUERIES = {f.__name__[:-2]: f for f in (
    dq_orphans_q, dq_subset_sides_q, dq_conservation_lost_q, dq_metrics_bounds_q, dq_windows_gaps_q, dq_schema_q,
    dq_min_rows_q, dq_table_equality_q, dq_fan_out_q, tagged_records_q, file_questions_q, clean_html_q,
    published_totals_q, ranking_change_q, pre_ranking_change_q, register_strategies_q, hash_counts_q, ordered_report_q)}

# ------------------------------------------------------------- oracle SQL --

_REVIEWS = "'src1', 'src2', 'src3', 'src4'"


def _sig(x: str) -> str:
    """Four significant figures."""
    return f"(CASE WHEN {x} = 0 THEN 0 ELSE round({x}, CAST(3 - floor(log10(abs({x}))) AS INTEGER)) END)"


def _published(suffix: str, kind: str) -> str:
    r, p = f"recall{suffix}", f"precision{suffix}"
    f = ", ".join(f"CASE WHEN {b * b} * {p} + {r} > 0 THEN {_sig(f'({1 + b * b} * {p} * {r} / ({b * b} * {p} + {r}))')} ELSE 0 END AS f{b}_score{suffix}"
                  for b in (1, 2, 3))
    return f"""
{kind}_t AS (SELECT database, shot, sum(n_retrieved) AS ret, sum(n_missed) AS mis, sum(overall_screening_workload_cutoff) AS wl
             FROM rm WHERE scope = 'topic' AND truth_kind = '{kind}' GROUP BY ALL),
{kind}_p AS (SELECT database, shot, {_sig('(ret / nullif(ret + mis, 0))')} AS {r}, {_sig('(ret / nullif(wl, 0))')} AS {p} FROM
             (SELECT database, shot, CAST(ret AS DOUBLE) AS ret, CAST(mis AS DOUBLE) AS mis,
                     CAST((SELECT wl FROM raw_t w WHERE w.database = t.database AND w.shot = t.shot) AS DOUBLE) AS wl FROM {kind}_t t)),
{kind}_m AS (SELECT database, shot, {r}, {p}, CASE WHEN {p} = 0 THEN CAST('Infinity' AS DOUBLE) ELSE {_sig(f'(1 / {p})')} END AS nnr{suffix}, {f} FROM {kind}_p)"""


_COLS = [f"{m}{s}" for s in ("", "_adjusted") for m in ("recall", "precision", "nnr", "f1_score", "f2_score", "f3_score")]

ORACLES = {
    "dq_orphans": f"SELECT doc_id + {ORPHAN} AS doc_id, quality, toxic FROM labels WHERE doc_id % 7 = 0",
    "dq_subset_sides": f"""WITH {SQL_ARTICLES}, {SQL_TRUTH},
a AS (SELECT DISTINCT review_id FROM truth WHERE review_id NOT IN ('src1', 'src2')),
b AS (SELECT DISTINCT review_id FROM articles WHERE review_id NOT IN ('src2', 'src3', 'src4'))
SELECT * FROM (
  SELECT review_id, 'missing_in_second' AS side FROM a ANTI JOIN b USING (review_id)
  UNION ALL SELECT review_id, 'missing_in_first' FROM b ANTI JOIN a USING (review_id)) WHERE review_id <> 'src3'""",
    "dq_conservation_lost": _SQL_TOPIC_COUNTS + f"""
SELECT database, review_id, truth_kind, n_retrieved, n_missed + 1 AS n_missed, n_retrieved + n_missed AS n_truth
FROM per WHERE review_id IN ({_REVIEWS})""",
    "dq_metrics_bounds": _SQL_TOPIC_COUNTS + """,
m AS (SELECT database, review_id, truth_kind, precision, CASE WHEN review_id = 'src1' THEN recall + 2 ELSE recall END AS recall,
             CASE WHEN database = 'embase' THEN recall / 2 ELSE recall END AS recall_cutoff FROM per)
SELECT database, review_id, truth_kind, round(recall, 6) AS recall, round(recall_cutoff, 6) AS recall_cutoff
FROM m WHERE recall < 0 OR recall > 1 OR precision < 0 OR precision > 1 OR recall IS DISTINCT FROM recall_cutoff""",
    "dq_windows_gaps": "WITH " + _sql_windows(1)[1:] + """,
p AS (SELECT window_id, window_start, CASE WHEN window_id % 3 = 1 THEN CAST(window_end - INTERVAL 1 DAY AS DATE) ELSE window_end END AS window_end FROM w),
n AS (SELECT *, lead(window_start) OVER (ORDER BY window_start) AS next_start FROM p)
SELECT window_id, window_start, window_end, next_start FROM n
WHERE next_start IS NOT NULL AND datediff('day', window_end, next_start) <> 1""",
    "dq_schema": "SELECT * FROM (VALUES ('abstract', 'missing'), ('title', 'missing'), ('lang', 'extra'), ('n_chars', 'extra')) t(\"column\", problem)",
    "dq_min_rows": "SELECT 'labels' AS \"table\", count(*) AS n_rows, 1000000000 AS expected FROM labels",
    "dq_table_equality": f"""WITH c0 AS (
  SELECT CASE WHEN doc_id % 13 = 0 THEN doc_id + {ORPHAN} ELSE doc_id END AS doc_id FROM documents WHERE doc_id % 11 <> 0),
c AS (SELECT doc_id, count(*) + CASE WHEN doc_id % 17 = 0 THEN 1 ELSE 0 END AS n_left FROM c0 GROUP BY doc_id),
d AS (SELECT doc_id, count(*) AS n_right FROM documents GROUP BY doc_id)
SELECT coalesce(c.doc_id, d.doc_id) AS doc_id, coalesce(n_left, 0) AS n_left, coalesce(n_right, 0) AS n_right
FROM c FULL JOIN d ON c.doc_id = d.doc_id WHERE coalesce(n_left, 0) <> coalesce(n_right, 0)""",
    "dq_fan_out": f"""WITH {SQL_ARTICLES}, {SQL_TRUTH},
s AS (SELECT count(DISTINCT database) AS n FROM articles), r AS (SELECT count(DISTINCT review_id) AS n FROM truth)
SELECT s.n * r.n * {len(SHOTS)} - s.n AS n_rows, s.n * r.n * {len(SHOTS)} AS expected FROM s, r
WHERE EXISTS (SELECT 1 FROM truth WHERE review_id = 'src1')""",
    "tagged_records": """SELECT doc_id, 'JOUR' AS record_type,
  'Title of ' || doc_id || ', CANCER  - part continued ' || doc_id AS primary_title, CAST(doc_id AS VARCHAR) AS accession_number,
  CAST(1990 + doc_id % 30 AS VARCHAR) || '//' AS publication_year, 'First, A' || doc_id || ';Second, B' AS authors FROM documents""",
    "file_questions": f"""WITH q AS (SELECT doc_id, CAST(doc_id % 5 + 1 AS VARCHAR) || '.' || CAST(doc_id % 13 AS VARCHAR) AS q FROM documents),
m AS (SELECT doc_id, CASE q {' '.join(f"WHEN '{a}' THEN '{b}'" for a, b in QUESTION_ID_REMAP)} ELSE q END AS question_id FROM q)
SELECT doc_id, question_id, replace(replace(question_id, '.', '_'), '/', '_') AS question_key FROM m""",
    "clean_html": "WITH r AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{read.replace(chr(39), chr(39) * 2)}')" for i, (_, read) in enumerate(REFERENCES))
    + f""") v(i, read)),
t AS (SELECT doc_id, replace(text, ',', ' <i class=''a''>' || read || ' </i><!-- x > y -->') AS x FROM documents JOIN r ON i = doc_id % {len(REFERENCES)}),
c AS (SELECT doc_id, regexp_replace(x, '<!--.*?-->', ' ', 'gs') AS x FROM t)
SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(x, '</?[A-Za-z][^<>]*>|<[!?][^<>]*>', ' ', 'g'), '[\\t\\n\\x0B\\f\\r ]+', ' ', 'g'), '^ | $', '', 'g') AS clean
FROM c""",
    "register_strategies": f"""WITH {SQL_ARTICLES}, {SQL_TRUTH},
s AS (SELECT DISTINCT database FROM articles), r AS (SELECT DISTINCT review_id FROM truth),
f AS (SELECT database, review_id, shot AS vector_search FROM s, r, (SELECT unnest([{', '.join(f"'{x}'" for x in SHOTS)}]) AS shot)),
n AS (SELECT count(*) AS n FROM f WHERE review_id < 'src3')
SELECT database, review_id, vector_search, n + row_number() OVER (ORDER BY database, review_id, vector_search) AS search_strategy_id
FROM f, n WHERE NOT review_id < 'src3'""",
    "hash_counts": """WITH w AS (SELECT doc_id, md5(unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+'))) AS h FROM documents),
b AS (SELECT doc_id, CAST('0x' || substr(h, 1, 2) AS INTEGER) % 64 AS b, sum(CASE WHEN substr(h, 15, 1) >= '8' THEN 1 ELSE -1 END) AS s FROM w GROUP BY ALL),
g AS (SELECT doc_id, i FROM documents, (SELECT unnest(generate_series(0, 63)) AS i))
SELECT g.doc_id, string_agg(CAST(coalesce(s, 0) AS VARCHAR), ' ' ORDER BY i) AS counts
FROM g LEFT JOIN b ON g.doc_id = b.doc_id AND g.i = b.b GROUP BY g.doc_id""",
    "ordered_report": f"""{_WM} SELECT database, workflow, review_id, row_number() OVER (
  ORDER BY coalesce(list_position([{', '.join(f"'{x}'" for x in DATABASE_ORDER)}], database), {len(DATABASE_ORDER) + 1}),
           (workflow = 'O') DESC, workflow, review_id NULLS FIRST) AS position FROM wm""",
    "published_totals": f"""WITH rm AS ({_VECTOR['ranked_metrics']}), {_published('', 'raw')}, {_published('_adjusted', 'adjusted')}
SELECT database, shot, {', '.join(f'round({c}, 9) AS {c}' for c in _COLS)} FROM raw_m JOIN adjusted_m USING (database, shot)""",
    "ranking_change": f"""WITH rm AS ({_VECTOR['ranked_metrics']})
SELECT database, shot, round(nnr_cutoff - nnr_raw, 6) AS nnr_change,
       round((nnr_cutoff - nnr_raw) / nullif(nnr_raw, 0) * 100, 6) AS nnr_change_pct
FROM rm WHERE scope = 'overall' AND truth_kind = 'raw'""",
    "pre_ranking_change": f"""WITH sr AS ({_HYBRID['search_then_rank']}), wm0 AS ({_WM} SELECT workflow, database, review_id, nnr FROM wm)
SELECT sr.review_id, sr.database, round(wm0.nnr - sr.nnr_cutoff, 6) AS nnr_change,
       round((wm0.nnr - sr.nnr_cutoff) / nullif(wm0.nnr, 0) * 100, 6) AS nnr_change_pct
FROM sr JOIN wm0 ON wm0.workflow = 'O' AND wm0.database = sr.database AND wm0.review_id = sr.review_id
WHERE sr.scope = 'topic' AND sr.shot = 'few-shot' AND sr.truth_kind = 'raw' AND (wm0.nnr <> 0 OR wm0.nnr IS NULL)""",
}
