"""Operators whose groups may hold any share of the rows, over the driver tables:
exact tests, running minima, selection of quantiles, interval joins, chains of
landed pages, bucketed upserts, many query texts at once; and their oracle SQL."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import functions as F

from ..functions.keyword import And, MeshTerm, Not, Term, read_query
from ..operators.ordinal import ordinal
from ..operators.postings import evaluate
from ..operators.quantiles import exact_quantiles
from ..operators.stats import bh_adjust, wilcoxon
from ..operators.windows import join_windows
from ..session import ensure_checkpoint_dir
from ..sources.pages import FIRST_CURSOR, check_cursor_chain
from ..sources.sinks import upsert_bucketed
from . import driver
from .common import round_doubles, sql_round

PROBS = (0.0, 0.05, 0.25, 0.5, 0.75, 0.999)


def _length_pairs(spark, sf):
    """Per source: how much longer texts of a language are, on average, than English ones."""
    d = driver.table(spark, sf, "documents").groupBy("source").pivot("lang", ["en", "de", "fr", "es"]).agg(F.avg("n_chars"))
    each = F.explode(F.array(*[F.struct(F.lit(x).alias("lang"), (F.col(x) - F.col("en")).alias("diff")) for x in ("de", "fr", "es")]))
    return d.select("source", each.alias("p")).select("source", "p.*")


def signed_rank_exact_q(spark, sf):
    """Exact p where differences have no ties (20 sources)."""
    return round_doubles(wilcoxon(_length_pairs(spark, sf), ["lang"]), 9)


def signed_rank_large_q(spark, sf):
    """Tied differences of whole order tables: ranks by a distributed running sum."""
    li = driver.table(spark, sf, "lineitem")
    d = li.select("l_returnflag", (F.col("l_quantity") - 25).alias("diff"))
    return round_doubles(wilcoxon(d, ["l_returnflag"]), 6)


def bh_families_q(spark, sf):
    """Each order a test (a p derived from its price), each priority a family."""
    o = driver.table(spark, sf, "orders").select(
        "o_orderkey", "o_orderpriority", ((F.round(F.col("o_totalprice") * 100).cast("long") % 99991 + 1) / 100000.0).alias("p_value"))
    return round_doubles(bh_adjust(o, "p_value", ["o_orderpriority"], ["o_orderkey"]), 9)


def group_quantiles_q(spark, sf):
    li = driver.table(spark, sf, "lineitem")
    q = exact_quantiles(li, ["l_returnflag", "l_linestatus"], "l_extendedprice", PROBS)
    return q.select("l_returnflag", "l_linestatus", "n",
                    *[F.round(F.get("q", F.lit(i)), 6).alias(f"q{i}") for i in range(len(PROBS))])


def _windows(spark, sf):
    """A window of 1 to 1,900 days for each supplier."""
    k = F.col("s_suppkey")
    start = F.date_add(F.lit("1994-06-01").cast("date"), (k * 37 % 2600).cast("int"))
    return driver.table(spark, sf, "supplier").select(
        k.alias("window_id"), start.alias("window_start"),
        F.date_add(start, F.when(k % 5 == 0, k % 3).otherwise(k * k % 1900).cast("int")).alias("window_end"))


def window_join_q(spark, sf):
    """Orders are summed by day before they meet the windows: a pair of window and
    day, not of window and order, so that the join grows with the windows alone.
    Windows are dealt to all tasks, days (2,400 here) are sent to them."""
    o = driver.table(spark, sf, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("keys"))
    w = _windows(spark, sf).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "window_id")
    met = join_windows(F.broadcast(o), "day", w)
    return met.groupBy("window_id", "window_start", "window_end").agg(
        F.sum("n").alias("n_orders"), F.sum("keys").alias("key_sum"))


def _landed(spark, sf):
    """Documents of a source in pages of up to three, with planted faults: pages
    lost, landed twice, and a last page that points back."""
    d = driver.table(spark, sf, "documents").select("source", F.floor(F.col("doc_id") / 60).alias("block")).distinct()
    p = ordinal(d, ["source"], [F.col("block")], name="page").drop("block")
    most = p.groupBy("source").agg(F.max("page").alias("last"))
    p = p.join(most, "source")
    name = lambda page: F.when(page == 1, F.lit(FIRST_CURSOR)).otherwise(F.concat("source", F.lit("-"), page.cast("string")))
    kind = F.substring("source", 4, 10).cast("int") % 5
    after = F.when(F.col("page") < F.col("last"), name(F.col("page") + 1)).when((kind == 3) & (F.col("last") > 3), name(F.lit(3)))
    p = p.select("source", name(F.col("page")).alias("cursor"), after.alias("next_cursor"), "page", kind.alias("kind"))
    p = p.where(~((F.col("kind") == 1) & (F.col("page") % 7 == 3)))
    again = p.where((F.col("kind") == 2) & (F.col("page") % 6 == 4))
    return p.unionByName(again).select("source", "cursor", "next_cursor")


def cursor_chain_q(spark, sf):
    return check_cursor_chain(_landed(spark, sf), ["source"])


def bucketed_upsert_q(spark, sf):
    """Orders as the stored table; the orders of every third customer are updated,
    some twice, and some keys are new."""
    o = driver.table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice", F.lit(1).alias("version"))
    path = f"{ensure_checkpoint_dir(spark)}/orders-{uuid.uuid4().hex}"
    upsert_bucketed(o, path, ["o_orderkey"], 32, "version")
    u = o.where(F.col("o_custkey") % 3 == 0)
    twice = u.where(F.col("o_orderkey") % 2 == 0).withColumn("o_totalprice", F.col("o_totalprice") + 1)
    new = u.where(F.col("o_orderkey") % 5 == 0).withColumn("o_orderkey", -F.col("o_orderkey") - 1)
    updates = u.withColumn("o_totalprice", -F.col("o_totalprice")).unionByName(twice).unionByName(new).withColumn("version", F.lit(2))
    upsert_bucketed(updates, path, ["o_orderkey"], 32, "version")
    return spark.read.parquet(path).select("o_orderkey", "o_custkey", F.round("o_totalprice", 2).alias("o_totalprice"), "version")


QUERIES = {
    "signed_rank_exact": signed_rank_exact_q,
    "signed_rank_large": signed_rank_large_q,
    "bh_families": bh_families_q,
    "group_quantiles": group_quantiles_q,
    "window_join": window_join_q,
    "cursor_chain": cursor_chain_q,
    "bucketed_upsert": bucketed_upsert_q,
}


def sql_signed_rank(src: str, by: str, decimals: int = 9) -> str:
    """SQL twin of ``stats.wilcoxon`` over ``src`` (by, diff); a WITH tail and its SELECT."""
    t = "(1.0 / (1.0 + abs(z) * 0.2316419))"
    poly = f"({t} * (0.319381530 + {t} * (-0.356563782 + {t} * (1.781477937 + {t} * (-1.821255978 + {t} * 1.330274429)))))"
    return f"""known AS (SELECT * FROM {src} WHERE diff IS NOT NULL),
ranked AS (SELECT *, rank() OVER (PARTITION BY {by} ORDER BY abs(diff)) + (count(*) OVER (PARTITION BY {by}, abs(diff)) - 1) / 2.0 AS r,
                  count(*) OVER (PARTITION BY {by}, abs(diff)) AS t FROM known WHERE diff <> 0),
sums AS (SELECT {by}, count(*) AS n, sum(CASE WHEN diff > 0 THEN r ELSE 0 END) AS w_plus,
                sum(CASE WHEN diff < 0 THEN r ELSE 0 END) AS w_minus, sum(CAST(t AS DOUBLE) * t - 1) AS tc FROM ranked GROUP BY {by}),
zeros AS (SELECT DISTINCT {by} FROM known WHERE diff = 0),
var AS (SELECT *, least(w_plus, w_minus) AS w, CAST(n AS DOUBLE) * (n + 1) * (2.0 * n + 1) / 24.0 - tc / 48.0 AS v FROM sums),
scores AS (SELECT *, CASE WHEN v > 0 THEN (w - CAST(n AS DOUBLE) * (n + 1) / 4.0) / sqrt(v) END AS z,
                  n <= 50 AND tc = 0 AND {by} NOT IN (SELECT {by} FROM zeros) AS exact FROM var),
patterns AS (SELECT 0 AS m, 0 AS s, 1.0::DOUBLE AS c
             UNION ALL
             SELECT m + 1, s + (m + 1) * up, sum(c) FROM patterns, (SELECT unnest([0, 1]) AS up) WHERE m < 50 GROUP BY ALL),
p AS (SELECT sc.{by}, least(1.0, 2 * sum(c) / pow(2.0, any_value(n))) AS p
      FROM scores sc JOIN patterns ON m = n AND s <= w WHERE exact GROUP BY sc.{by})
SELECT scores.{by}, CAST(n AS BIGINT) AS n, {sql_round(["w_plus", "w_minus", "w", "z"], decimals)},
  round(CASE WHEN exact THEN p.p ELSE least(1.0, 2.0 * exp(-abs(z) * abs(z) / 2.0) * 0.3989422804014327 * {poly}) END, {decimals}) AS p_value,
  CASE WHEN exact THEN 'exact' ELSE 'normal' END AS p_method
FROM scores LEFT JOIN p ON p.{by} = scores.{by}"""


ORACLES = {
    "signed_rank_exact": f"""WITH RECURSIVE a AS (SELECT source, lang, avg(n_chars) AS v FROM documents GROUP BY ALL),
d AS (SELECT o.lang, o.v - e.v AS diff FROM a o JOIN a e ON e.source = o.source AND e.lang = 'en' WHERE o.lang <> 'en'),
{sql_signed_rank('d', 'lang')}""",
    "signed_rank_large": f"""WITH RECURSIVE d AS (SELECT l_returnflag, l_quantity - 25 AS diff FROM lineitem),
{sql_signed_rank('d', 'l_returnflag', 6)}""",
    "bh_families": """
WITH t AS (SELECT o_orderkey, o_orderpriority, (CAST(round(o_totalprice * 100) AS BIGINT) % 99991 + 1) / 100000.0 AS p_value FROM orders),
q AS (SELECT *, p_value * count(*) OVER (PARTITION BY o_orderpriority)
                / row_number() OVER (PARTITION BY o_orderpriority ORDER BY p_value, o_orderkey) AS q FROM t)
SELECT o_orderkey, o_orderpriority, round(CAST(p_value AS DOUBLE), 9) AS p_value,
  round(least(1.0, min(q) OVER (PARTITION BY o_orderpriority ORDER BY p_value, o_orderkey
                                ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 9) AS p_adjusted FROM q""",
    "group_quantiles": "SELECT l_returnflag, l_linestatus, count(l_extendedprice) AS n, "
                       + ", ".join(f"round(quantile_cont(l_extendedprice, {p}), 6) AS q{i}" for i, p in enumerate(PROBS))
                       + " FROM lineitem GROUP BY ALL",
    "window_join": """
WITH w AS (SELECT s_suppkey AS window_id, DATE '1994-06-01' + CAST(s_suppkey * 37 % 2600 AS INTEGER) AS window_start,
                  CAST(CASE WHEN s_suppkey % 5 = 0 THEN s_suppkey % 3 ELSE s_suppkey * s_suppkey % 1900 END AS INTEGER) AS more FROM supplier),
v AS (SELECT window_id, window_start, window_start + more AS window_end FROM w)
SELECT window_id, window_start, window_end, count(*) AS n_orders, CAST(sum(o_orderkey) AS BIGINT) AS key_sum
FROM orders JOIN v ON CAST(o_orderdate AS DATE) BETWEEN window_start AND window_end GROUP BY ALL""",
    "cursor_chain": """
WITH RECURSIVE d AS (SELECT DISTINCT source, doc_id // 60 AS block FROM documents),
n AS (SELECT source, row_number() OVER (PARTITION BY source ORDER BY block) AS page, count(*) OVER (PARTITION BY source) AS last,
             CAST(substr(source, 4) AS INTEGER) % 5 AS kind FROM d),
c AS (SELECT *, CASE WHEN page = 1 THEN '*' ELSE source || '-' || page END AS cursor,
             CASE WHEN page < last THEN source || '-' || (page + 1) WHEN kind = 3 AND last > 3 THEN source || '-3' END AS nxt FROM n),
p AS (SELECT * FROM c WHERE NOT (kind = 1 AND page % 7 = 3)),
reach AS (SELECT source, cursor, nxt FROM p WHERE cursor = '*'
          UNION
          SELECT p.source, p.cursor, p.nxt FROM reach JOIN p ON p.source = reach.source AND p.cursor = reach.nxt),
ending AS (SELECT source, cursor FROM p WHERE nxt IS NULL OR nxt NOT IN (SELECT cursor FROM p q WHERE q.source = p.source)
           UNION
           SELECT p.source, p.cursor FROM ending JOIN p ON p.source = ending.source AND p.nxt = ending.cursor)
SELECT DISTINCT source, nxt AS cursor, 'lost' AS fault FROM p WHERE nxt IS NOT NULL AND nxt NOT IN (SELECT cursor FROM p q WHERE q.source = p.source)
UNION ALL SELECT source, cursor, 'doubled' FROM p WHERE kind = 2 AND page % 6 = 4
UNION ALL SELECT source, cursor, 'headless' FROM p WHERE (source, cursor) NOT IN (SELECT source, cursor FROM reach)
UNION ALL SELECT source, cursor, 'looping' FROM p WHERE (source, cursor) NOT IN (SELECT source, cursor FROM ending)""",
    "bucketed_upsert": """
WITH u AS (SELECT * FROM orders WHERE o_custkey % 3 = 0),
v AS (SELECT o_orderkey, o_custkey, -o_totalprice AS o_totalprice FROM u
      UNION ALL SELECT o_orderkey, o_custkey, o_totalprice + 1 FROM u WHERE o_orderkey % 2 = 0
      UNION ALL SELECT -o_orderkey - 1, o_custkey, o_totalprice FROM u WHERE o_orderkey % 5 = 0),
best AS (SELECT o_orderkey, o_custkey, max(o_totalprice) AS o_totalprice, 2 AS version FROM v GROUP BY ALL)
SELECT o_orderkey, o_custkey, round(o_totalprice, 2) AS o_totalprice, version FROM best
UNION ALL SELECT o_orderkey, o_custkey, round(o_totalprice, 2), 1 FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM best)""",
}


# ------------------------------------------------- many query texts at once --

QUERY_TEXTS = {
    "phrase": '"in the" OR "of the"[ab]',
    "prefix": "th*[ab] AND NOT (que OR der)",
    "left to right": "the AND of NOT and OR les",
    "bare phrase": "of the[ab] AND src3",
    "title": "src1*[ti] NOT src1[ti]",
    "tag": "fr[mh] OR (es[mh] AND src4[mh])",
    "nested": "((the OR la) AND (of OR de)) NOT (en[mh] NOT src2[mh])",
    "not alone": "NOT (the OR la OR der OR que)",
    "long phrase": '"of the in" OR "de la le" OR "en el de"',
    "punctuated": '"the, and" OR "|" OR "the."',
    "upper case": "THE AND Und*",
    "inner": "on* AND th* AND in*",
}


def _searched(spark, sf):
    return driver.table(spark, sf, "documents").select(
        "doc_id", F.col("source").alias("title"), F.col("text").alias("abstract"), F.array("lang", "source").alias("mesh"))


def query_texts_q(spark, sf):
    """Query texts read and evaluated over all documents in one scan."""
    return evaluate(_searched(spark, sf), "doc_id", {name: read_query(text) for name, text in QUERY_TEXTS.items()})


def _sql_query(node) -> str:
    """SQL twin of ``keyword.compile_query`` for an expression tree."""
    if isinstance(node, MeshTerm):
        return f"list_contains(list_transform(mesh, lambda h: lower(h)), '{node.heading}')"
    if isinstance(node, Term):
        words = node.text.split()
        parts = [re.escape(w[:-1]) + r"[\p{L}\p{N}_]*" if w.endswith("*") else re.escape(w) for w in words]
        tail = "" if words[-1].endswith("*") else r"([^\p{L}\p{N}_]|$)"
        pattern = (r"(^|[^\p{L}\p{N}_])" + r"\s+".join(parts) + tail).replace("'", "''")
        return "(" + " OR ".join(f"coalesce(regexp_matches(lower({f}), '{pattern}'), false)" for f in node.fields) + ")"
    if isinstance(node, Not):
        return f"(NOT {_sql_query(node.item)})"
    return "(" + (" AND " if isinstance(node, And) else " OR ").join(map(_sql_query, node.items)) + ")"


QUERIES["query_texts"] = query_texts_q
ORACLES["query_texts"] = ("WITH d AS (SELECT doc_id, source AS title, text AS abstract, [lang, source] AS mesh FROM documents)\n"
                          + "\nUNION ALL ".join(f"SELECT '{name}' AS query, doc_id FROM d WHERE {_sql_query(read_query(text))}"
                                                for name, text in QUERY_TEXTS.items()))
