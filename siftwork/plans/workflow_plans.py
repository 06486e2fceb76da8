"""Steps of the evaluated workflow from end to end over the driver tables: ground
truth from several sources, topics with a second lookup, evaluation and gold sets
with their options, search by question text, mean changes; and their oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.ids import clean_id, fix_question_id
from ..functions.text import embedding_text
from ..operators.report import ranking_change
from ..operators.retrieval import QueryMatrix, dedupe_space, hash_embed, on_spaces, top_search
from ..operators.truth import build_evaluation_set, build_gold_set, build_ground_truth, topic_lookup
from . import driver
from .common import DATABASES4, SQL_ARTICLES, SQL_TRUTH, round_doubles, sql_clean_id, sql_messy_id
from .eval_plans import _SQL_EVAL_SET
from .norm_plans import _SQL_MESSY_Q, _SQL_MESSY_YEAR, _messy_question, _messy_year
from .vector_plans import ORACLES as _VECTOR
from .vector_plans import VectorRun


def _bare(col="text"):
    return F.regexp_replace(col, "[&<>]", " ")


def ground_truth_q(spark, sf):
    """Included articles (labels) of eligible reviews, titles and abstracts from
    three sources in their order of priority, whole texts as abstracts."""
    d = driver.table(spark, sf, "documents")
    labelled = d.join(driver.table(spark, sf, "labels").where("quality = 1").select("doc_id"), "doc_id", "left_semi")
    articles = labelled.select(F.col("doc_id").alias("included_article_id"), _messy_question().alias("question_id"),
                               _messy_year().alias("year_pub_extract"))
    reviews = articles.groupBy(fix_question_id("question_id").alias("question_id")).agg(F.count(F.lit(1)).alias("included_num")) \
        .withColumn("evidence_review_type", F.when(F.col("question_id").startswith("1"), "SR").when(F.col("included_num") % 2 == 0, "SR").otherwise("NR"))
    key, n = F.col("doc_id").alias("included_article_id"), F.col("doc_id")
    name = F.concat("source", F.lit(" "), n.cast("string"))
    own = driver._messy_id("doc_id", driver._text_key()).alias("api_id_retrieved")
    pubmed = d.where(n % 2 == 0).select(key, F.when(n % 4 != 0, F.concat(F.lit("<b>pm</b> "), name)).alias("title"),
                                        F.when(n % 6 != 0, F.concat(F.lit("5&#150;6 "), _bare())).alias("abstract"),
                                        F.when(n % 8 != 0, F.concat(F.lit("second "), name)).alias("title_2ndsearch"),
                                        F.lit(None).cast("string").alias("abstract_2ndsearch"), own)
    embase = d.where(n % 3 == 0).select(key, F.concat(F.lit("em  "), name).alias("title"), F.when(n % 9 != 0, _bare()).alias("abstract"), own)
    openalex = d.where(n % 5 != 0).select(key, F.concat(F.lit("oa &amp; "), name).alias("title"), F.substring(_bare(), 1, 300).alias("abstract"), own)
    gt = build_ground_truth(articles, reviews, {"pubmed": pubmed, "embase": embase, "openalex": openalex})
    return gt.select("included_article_id", "question_id", "year_pub_extract", "title", "abstract",
                     "retrieved_pubmed_id", "retrieved_embase_id", "retrieved_oa_id")


def topic_retry_q(spark, sf):
    """Topics of all retrieved articles: a first lookup, a second for what it missed."""
    a = driver.articles(spark, sf).select("article_id", "review_id", clean_id("original_id").alias("clean_id"))
    n = F.col("article_id")
    topic = F.concat("review_id", F.lit(":"), (n % 7).cast("string"))
    first = a.where(n % 3 == 0).select("clean_id", F.when(n % 9 != 0, topic).alias("topic_id"))
    retry = a.where(n % 2 == 0).select("clean_id", F.concat(F.lit("retry "), topic).alias("topic_id"))
    return topic_lookup(a.select("clean_id").distinct(), first, retry)[0].select("clean_id", "topic_id")


def eval_set_strategies_q(spark, sf):
    """Evaluation set whose search start is that of a review's first strategy."""
    t = driver.truth(spark, sf)
    s = driver.articles(spark, sf).select("review_id", F.col("article_id").alias("search_strategy_id"),
                                          F.when(F.col("article_id") % 4 != 0, F.col("publication_year")).alias("searchstrat_year_start"))
    return build_evaluation_set(t, s).select("ground_truth_article_id", "review_id", "publication_year", "searchstrat_year_start")


def gold_with_text_q(spark, sf):
    """Gold articles that need a title and an abstract while there are any."""
    t = driver.truth(spark, sf)
    n = F.col("ground_truth_article_id")
    t = t.withColumn("title", F.when(n % 4 != 0, F.col("review_id"))).withColumn("abstract", F.when(n % 3 != 1, F.col("included_reference")))
    return build_gold_set(t, build_evaluation_set(t)).select("review_id", "ground_truth_article_id")


def mean_ranking_change_q(spark, sf):
    """Mean change of NNR by ranking, per database and scenario."""
    m = VectorRun(spark, sf).metrics().where((F.col("truth_kind") == "raw") & (F.col("n_retrieved") > 0))
    c = ranking_change(m, ["database", "scope", "shot"])
    return round_doubles(c.groupBy("database", "scope", "shot").agg(
        F.avg("nnr_change").alias("mean_change"), F.avg("nnr_change_pct").alias("mean_change_pct"), F.count(F.lit(1)).alias("n")), 6)


def embed_documents_q(spark, sf):
    """The default encoder over whole documents (source, then text)."""
    d = driver.table(spark, sf, "documents").select("doc_id", embedding_text(F.col("source"), F.col("text"), sep=". ").alias("t"))
    e = hash_embed(d, "doc_id", "t")
    return e.select("doc_id", F.size("embedding").alias("dim"), F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x), 6).alias("norm"),
                    *[F.round(F.get("embedding", F.lit(i)), 9).alias(f"e{i}") for i in (0, 13, 63)])


def question_search_q(spark, sf):
    """Zero-shot search by question text: benchmark questions and whole documents
    through the default encoder, the first 20 articles of every question and
    database with the articles' columns."""
    items = driver.table(spark, sf, "benchmark").select(F.col("item_id").cast("string").alias("review_id"), "text")
    q = hash_embed(items, "review_id", "text").withColumns(
        {"scope": F.lit("topic"), "shot": F.lit("zero-shot"), "query_id": F.concat(F.lit("question:"), "review_id")})
    a = driver.articles(spark, sf)
    vectors = hash_embed(a.select("article_id", "text"), "article_id", "text")
    space = dedupe_space(a.select("article_id", "database", "original_id").join(vectors, "article_id"))
    queries = on_spaces(q, DATABASES4)
    top = top_search(queries, space, 20, matrix=QueryMatrix.collect(queries, "database", ["scope", "shot", "review_id"]))
    columns = a.select("article_id", F.col("review_id").alias("source"), "publication_year")
    return top.join(columns, "article_id").select("review_id", "database", "original_id", "source", "publication_year", "cosine_similarity", "rank")


QUERIES = {f.__name__[:-2]: f for f in (ground_truth_q, topic_retry_q, eval_set_strategies_q, gold_with_text_q, mean_ranking_change_q,
                                        embed_documents_q, question_search_q)}

# ------------------------------------------------------------- oracle SQL --

_ID = sql_clean_id(sql_messy_id("doc_id", "md5(text)"))
_CLEAN = "regexp_replace(regexp_replace({}, '[\\t\\n\\x0B\\f\\r ]+', ' ', 'g'), '^ | $', '', 'g')"
_BARE = "regexp_replace(text, '[&<>]', ' ', 'g')"


def _sql_counts(name: str, src: str, key: str) -> str:
    """SQL twin of ``retrieval.hash_counts`` over ``src`` (key, t): (key, e)."""
    return f"""{name}_w AS (SELECT {key}, md5(unnest(regexp_extract_all(lower(t), '[\\p{{L}}\\p{{N}}_]+'))) AS h FROM {src}),
{name}_b AS (SELECT {key}, CAST('0x' || substr(h, 1, 2) AS INTEGER) % 64 AS b, sum(CASE WHEN substr(h, 15, 1) >= '8' THEN 1 ELSE -1 END) AS s FROM {name}_w GROUP BY ALL),
{name}_g AS (SELECT {key}, i FROM {src}, (SELECT unnest(generate_series(0, 63)) AS i)),
{name} AS (SELECT g.{key}, list(CAST(coalesce(s, 0) AS DOUBLE) ORDER BY i) AS e FROM {name}_g g LEFT JOIN {name}_b b ON g.{key} = b.{key} AND g.i = b.b GROUP BY g.{key})"""


ORACLES = {
    "ground_truth": f"""WITH l AS (SELECT * FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)),
x AS (SELECT *, {_SQL_MESSY_Q} AS raw_id, {_SQL_MESSY_YEAR} AS raw_year FROM l),
q AS (SELECT *, trim(lower(regexp_replace(replace(regexp_replace(raw_id, '\\s+', '', 'g'), ',', '/'), '\\.$', ''))) AS question_id FROM x),
r AS (SELECT question_id, count(*) AS n FROM q GROUP BY ALL HAVING count(*) >= 5 AND (question_id LIKE '1%' OR count(*) % 2 = 0)),
s AS (SELECT doc_id AS included_article_id, question_id, raw_year, doc_id, {_ID} AS own, source || ' ' || doc_id AS name, {_BARE} AS bare FROM q SEMI JOIN r USING (question_id)),
c AS (SELECT *,
  coalesce(CASE WHEN doc_id % 2 = 0 THEN coalesce(CASE WHEN doc_id % 4 <> 0 THEN 'pm ' || name END, CASE WHEN doc_id % 8 <> 0 THEN 'second ' || name END) END,
           CASE WHEN doc_id % 3 = 0 THEN 'em  ' || name END, CASE WHEN doc_id % 5 <> 0 THEN 'oa & ' || name END) AS title0,
  coalesce(CASE WHEN doc_id % 2 = 0 AND doc_id % 6 <> 0 THEN '5–6 ' || bare END, CASE WHEN doc_id % 3 = 0 AND doc_id % 9 <> 0 THEN bare END,
           CASE WHEN doc_id % 5 <> 0 THEN substr(bare, 1, 300) END) AS abstract0 FROM s),
y AS (SELECT *, trim(split_part(trim(regexp_replace(replace(raw_year, '//', ''), '^/+|/+$', '', 'g')), ',', 1)) AS ys FROM c),
z AS (SELECT *, CASE WHEN ys NOT IN ('', 'nan', 'None', 'NaT') THEN TRY_CAST(ys AS DOUBLE) END AS v FROM y)
SELECT included_article_id, question_id, CASE WHEN v = floor(v) THEN CAST(v AS INTEGER) END AS year_pub_extract,
  {_CLEAN.format('title0')} AS title, {_CLEAN.format('abstract0')} AS abstract,
  CASE WHEN doc_id % 2 = 0 THEN own END AS retrieved_pubmed_id, CASE WHEN doc_id % 3 = 0 THEN own END AS retrieved_embase_id,
  CASE WHEN doc_id % 5 <> 0 THEN own END AS retrieved_oa_id FROM z""",
    "topic_retry": f"""WITH {SQL_ARTICLES},
a AS (SELECT article_id AS n, review_id || ':' || article_id % 7 AS topic, {sql_clean_id('original_id')} AS clean_id FROM articles)
SELECT clean_id, coalesce(min(CASE WHEN n % 3 = 0 AND n % 9 <> 0 THEN topic END), min(CASE WHEN n % 2 = 0 THEN 'retry ' || topic END)) AS topic_id
FROM a GROUP BY clean_id""",
    "eval_set_strategies": f"""WITH {SQL_ARTICLES}, {SQL_TRUTH},
f AS (SELECT review_id, arg_min(CASE WHEN article_id % 4 <> 0 THEN publication_year ELSE -1 END, article_id) AS y FROM articles GROUP BY review_id),
t AS (SELECT ground_truth_article_id, review_id, publication_year, nullif(f.y, -1) AS searchstrat_year_start FROM truth LEFT JOIN f USING (review_id))
SELECT DISTINCT * FROM t WHERE (searchstrat_year_start <= publication_year OR searchstrat_year_start IS NULL) AND review_id NOT IN ('5.7.5', '5.7.1')""",
    "gold_with_text": f"""WITH {SQL_TRUTH},{_SQL_EVAL_SET},
p AS (SELECT *, ground_truth_article_id % 4 <> 0 AND ground_truth_article_id % 3 <> 1 AS txt FROM truth WHERE review_id IN (SELECT review_id FROM ev)),
k AS (SELECT *, CASE WHEN txt AND sr_update = 'Y' AND publication_year <= searchstrat_year_start THEN 1 WHEN txt THEN 2 ELSE 3 END AS tier FROM p),
b AS (SELECT *, min(tier) OVER (PARTITION BY review_id) AS best FROM k)
SELECT review_id, ground_truth_article_id FROM b WHERE tier = best
QUALIFY row_number() OVER (PARTITION BY review_id ORDER BY md5('42:' || CAST(ground_truth_article_id AS VARCHAR)), ground_truth_article_id) <= 3""",
    "mean_ranking_change": f"""WITH m AS ({_VECTOR['ranked_metrics']})
SELECT database, scope, shot, round(avg(nnr_cutoff - nnr_raw), 6) AS mean_change, round(avg((nnr_cutoff - nnr_raw) / nullif(nnr_raw, 0) * 100.0), 6) AS mean_change_pct,
  count(*) AS n FROM m WHERE truth_kind = 'raw' AND n_retrieved > 0 GROUP BY ALL""",
    "embed_documents": f"""WITH t AS (SELECT doc_id, source || '. ' || text AS t FROM documents),
{_sql_counts('v', 't', 'doc_id')},
u AS (SELECT doc_id, e, sqrt(list_dot_product(e, e)) AS l FROM v)
SELECT doc_id, 64 AS dim, round(CASE WHEN l > 0 THEN list_dot_product(e, e) / (l * l) ELSE 0.0 END, 6) AS norm,
  {', '.join(f'round(CASE WHEN l > 0 THEN e[{i + 1}] / l ELSE 0.0 END, 9) AS e{i}' for i in (0, 13, 63))} FROM u""",
    "question_search": f"""WITH {SQL_ARTICLES},
qt AS (SELECT CAST(item_id AS VARCHAR) AS review_id, text AS t FROM benchmark),
dt AS (SELECT article_id, text AS t FROM articles),
{_sql_counts('q', 'qt', 'review_id')},
{_sql_counts('d', 'dt', 'article_id')},
s AS (SELECT a.article_id, a.database, a.original_id, a.review_id AS source, a.publication_year, d.e FROM articles a JOIN d USING (article_id)
      QUALIFY row_number() OVER (PARTITION BY a.database, a.original_id ORDER BY a.article_id) = 1),
p AS (SELECT q.review_id, s.database, s.original_id, s.source, s.publication_year, round(list_cosine_similarity(q.e, s.e), 9) AS cosine_similarity
      FROM q, s WHERE list_dot_product(q.e, q.e) > 0 AND list_dot_product(s.e, s.e) > 0)
SELECT *, row_number() OVER (PARTITION BY review_id, database ORDER BY cosine_similarity DESC, original_id) AS rank FROM p QUALIFY rank <= 20""",
}
