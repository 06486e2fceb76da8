"""Broad search, then vector ranking (the O+OVS / O+TVS workflows as they
compose): the year-filtered, deduplicated broad results of each database
are the search space; their embeddings are looked up by article id in one
embeddings table (missing vectors drop out, as null vectors do); gold
articles of the evaluation reviews are the queries; the evaluation set is
the truth.  A review whose gold articles have no vector finds nothing: it is
reported with no documents and every article missed."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.matching import truth_by_database
from ..operators.ranked import scope_truth, search_metrics_ranked
from ..operators.retrieval import QueryMatrix, all_scenarios, on_spaces, space_sizes
from ..operators.truth import build_evaluation_set, build_gold_set
from ..schemas import SCOPES
from ..session import stored_once
from . import driver
from .common import DATABASES4, SQL_ARTICLES, SQL_TRUTH, round_doubles, sql_round, sql_truth_long
from .eval_plans import _SQL_BROAD_RES, _SQL_EVAL_SET, _SQL_GOLD_CTES, broad_results
from .vector_plans import _DOUBLE_METRICS, _SQL_ONE, _SQL_RANK_FUSE, KEYS, metrics_core_sql

SHOTS_WITH_ARTICLES = ("one-shot", "few-shot")


class SearchThenRank:
    def __init__(self, spark: SparkSession, sf_dir: str, scopes=SCOPES, shots=SHOTS_WITH_ARTICLES,
                 method: str = "range"):
        emb = driver.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("article_id"), "embedding")
        results = broad_results(spark, sf_dir).select("database", "article_id", "original_id")
        # broad results hold an id once per database, so one join is all
        self.space = results.join(emb, "article_id", "left")
        # the included-article tables are small and feed the gold set, the
        # queries and the evaluation: build each once per run
        truth = stored_once(driver.truth(spark, sf_dir))
        self.eval_set = stored_once(build_evaluation_set(truth))
        gold = build_gold_set(truth, self.eval_set, require_text=False)
        gold_vecs = gold.select("review_id", "ground_truth_article_id").join(
            emb.withColumnRenamed("article_id", "ground_truth_article_id"), "ground_truth_article_id")
        queries = on_spaces(all_scenarios(gold_vecs, None, scopes, shots), DATABASES4)
        self.matrix = QueryMatrix.collect(queries, "database", ["scope", "shot", "review_id"],
                                          extra_cols=["query_kind"])
        self.query_rows = self.matrix.rows()
        self.scopes, self.shots, self.method = scopes, shots, method

    def strategies(self) -> DataFrame:
        """Every evaluation review and the whole, with every shot, in every database,
        also where no gold article has a vector."""
        reviews = self.eval_set.select(F.col("review_id").cast("string").alias("review_id")).distinct()
        by_scope = {"topic": reviews, "overall": reviews.sparkSession.range(1).select(F.lit("overall").alias("review_id"))}
        out = reduce(DataFrame.unionByName, [by_scope[s].withColumn("scope", F.lit(s)) for s in self.scopes])
        return on_spaces(out.withColumn("shot", F.explode(F.array(*map(F.lit, self.shots)))), DATABASES4)

    def metrics(self) -> DataFrame:
        truth = scope_truth(truth_by_database(self.eval_set, DATABASES4,
                                              keep=["ground_truth_article_id", "review_id"]))
        sized = space_sizes(self.space, self.query_rows.select(*KEYS).distinct(), self.matrix.dim)
        n_docs = self.strategies().join(sized, KEYS, "left").select(*KEYS, F.coalesce("_n", F.lit(0)).alias("_n"))
        return search_metrics_ranked(self.matrix, self.space, truth, self.query_rows, KEYS, n_docs, method=self.method)


def search_then_rank_q(spark, sf_dir):
    return round_doubles(SearchThenRank(spark, sf_dir).metrics(), 9, {"similarity_threshold_cutoff": 6})


QUERIES = {"search_then_rank": search_then_rank_q}

_SQL = f"""WITH {SQL_ARTICLES},
{SQL_TRUTH},
{_SQL_EVAL_SET},
{_SQL_GOLD_CTES},
emb AS (SELECT vec_id AS article_id, CAST(embedding AS DOUBLE[]) AS embedding FROM embeddings),
gold AS (SELECT g.review_id, g.ground_truth_article_id, e.embedding
         FROM gold_ids g JOIN emb e ON e.article_id = g.ground_truth_article_id
         WHERE e.embedding IS NOT NULL AND len(e.embedding) = 64 AND list_dot_product(e.embedding, e.embedding) > 0),
{_SQL_ONE},
q0 AS (
  SELECT 'topic' AS scope, 'one-shot' AS shot, review_id, CAST(ground_truth_article_id AS VARCHAR) AS query_id, 'article' AS query_kind, embedding FROM one
  UNION ALL SELECT 'topic', 'few-shot', review_id, CAST(ground_truth_article_id AS VARCHAR), 'article', embedding FROM gold
  UNION ALL SELECT 'overall', 'one-shot', 'overall', CAST(ground_truth_article_id AS VARCHAR), 'article', embedding FROM one
  UNION ALL SELECT 'overall', 'few-shot', 'overall', CAST(ground_truth_article_id AS VARCHAR), 'article', embedding FROM gold
),
dbs AS (SELECT unnest(['pubmed', 'medline', 'embase', 'openalex']) AS database),
q AS (SELECT q0.*, dbs.database FROM q0, dbs),
{_SQL_BROAD_RES},
space0 AS (
  SELECT r.database, r.article_id, r.original_id, e.embedding
  FROM res r LEFT JOIN emb e ON e.article_id = r.article_id
  QUALIFY row_number() OVER (PARTITION BY r.database, r.original_id ORDER BY r.article_id) = 1
),
space AS (SELECT * FROM space0 WHERE embedding IS NOT NULL AND len(embedding) = 64
          AND list_dot_product(embedding, embedding) > 0),
{_SQL_RANK_FUSE},
{sql_truth_long('ev', 'tl1')},
tl AS (SELECT * FROM tl1 UNION ALL SELECT ground_truth_article_id, 'overall', database, clean_id, truth_kind FROM tl1),
strategies AS (
  SELECT s.scope, shots.shot, dbs.database, s.review_id
  FROM (SELECT DISTINCT 'topic' AS scope, review_id FROM ev UNION ALL SELECT 'overall', 'overall') s,
       (SELECT unnest(['one-shot', 'few-shot']) AS shot) shots, dbs),
{metrics_core_sql('strategies')}
SELECT scope, shot, database, review_id, truth_kind, n_retrieved, n_missed,
  overall_screening_workload, overall_screening_workload_cutoff,
  {sql_round(_DOUBLE_METRICS, 9, {"similarity_threshold_cutoff": 6})}
FROM z"""

ORACLES = {"search_then_rank": _SQL}
