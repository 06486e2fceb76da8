"""Vector-ranking workflow plans (overall / topic scope × zero/one/few shot)
over the ``embeddings`` driver table, and their oracle SQL."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.matching import truth_by_database
from ..operators.ranked import cutoff_prefix, scope_truth, search_metrics_ranked
from ..operators.retrieval import (QueryMatrix, all_scenarios, dedupe_space, on_spaces, pick_one,
                                   rank_and_fuse, select_queries, space_sizes, top_search, topic_vectors)
from ..session import stored_once
from ..schemas import RANKED_METRIC_COLUMNS, SCOPES, SHOTS
from . import driver
from .common import DATABASES4, SQL_VECTORS, round_doubles, sql_clean_id, sql_round

KEYS = ["scope", "shot", "database", "review_id"]


class VectorRun:
    """Every stage of the vector workflow as lazily built DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str, scopes=SCOPES, shots=SHOTS,
                 method: str = "range"):
        self.vecs = driver.vectors(spark, sf_dir)
        # gold vectors, at most a few per review, and one vector per review
        self.gold = stored_once(driver.vector_gold(self.vecs))
        self.topics = topic_vectors(self.vecs)
        self.queries = on_spaces(all_scenarios(self.gold, self.topics, scopes, shots), DATABASES4)
        self.space = dedupe_space(self.vecs.select("database", "article_id", "original_id", "embedding"))
        self.matrix = QueryMatrix.collect(self.queries, "database", ["scope", "shot", "review_id"],
                                          extra_cols=["query_kind"])
        self.query_rows = self.matrix.rows()
        self.method = method

    @functools.cached_property
    def _ranking(self):
        return rank_and_fuse(self.queries, self.space, method=self.method, matrix=self.matrix)

    @property
    def ranked(self) -> DataFrame:
        return self._ranking[0]

    @property
    def fused(self) -> DataFrame:
        return self._ranking[1]

    def truth(self) -> DataFrame:
        long = truth_by_database(driver.vector_truth(self.vecs), DATABASES4,
                                 keep=["ground_truth_article_id", "review_id"])
        return scope_truth(long)

    def metrics(self) -> DataFrame:
        n_docs = space_sizes(self.space, self.query_rows.select(*KEYS).distinct(), self.matrix.dim)
        return search_metrics_ranked(self.matrix, self.space, self.truth(), self.query_rows, KEYS, n_docs, method=self.method)


# ------------------------------------------------------------------ plans --

def ranked_metrics_q(spark, sf_dir):
    """Flagship: every scenario ranked, fused and evaluated in one plan."""
    m = VectorRun(spark, sf_dir).metrics()
    return round_doubles(m, 9, {"similarity_threshold_cutoff": 6})


def cosine_rank_q(spark, sf_dir):
    """Per-query cosine ranking, topic scope, few-shot."""
    run = VectorRun(spark, sf_dir, scopes=("topic",), shots=("few-shot",))
    return run.ranked.select("review_id", "database", "query_id", "original_id",
                             "cosine_similarity", "rank")


def rrf_fuse_q(spark, sf_dir):
    """Fused ranking of the overall few-shot scenario."""
    run = VectorRun(spark, sf_dir, scopes=("overall",), shots=("few-shot",))
    f = run.fused.select("database", "original_id", "rrf_score", "cosine_similarity",
                         "combined_rank", "n_queries")
    return round_doubles(f, 12, {"cosine_similarity": 6})


def distributed_rank_q(spark, sf_dir):
    """The overall few-shot fused ranking forced through the distributed
    ordinal (range shuffle + checkpoint + prefix sums): the plan used when
    one search space does not fit a task; it must equal ``rrf_fuse``."""
    run = VectorRun(spark, sf_dir, scopes=("overall",), shots=("few-shot",), method="range")
    f = run.fused.select("database", "original_id", "rrf_score", "cosine_similarity",
                         "combined_rank", "n_queries")
    return round_doubles(f, 12, {"cosine_similarity": 6})


def combined_rank_q(spark, sf_dir):
    """Combined rank of every document, topic scope, one-shot."""
    run = VectorRun(spark, sf_dir, scopes=("topic",), shots=("one-shot",))
    return run.fused.select("review_id", "database", "original_id", "combined_rank")


def cutoff_prefix_q(spark, sf_dir):
    """Screening list up to the last relevant hit (topic few-shot)."""
    run = VectorRun(spark, sf_dir, scopes=("topic",), shots=("few-shot",))
    m = run.metrics()
    p = cutoff_prefix(run.fused, m, KEYS)
    return p.select("review_id", "database", "original_id", "combined_rank")


def recall_at_k_q(spark, sf_dir):
    run = VectorRun(spark, sf_dir, scopes=("topic",), shots=("zero-shot",))
    m = run.metrics().select(*KEYS, "truth_kind", "recall_at_10", "recall_at_100", "recall_at_1000")
    return round_doubles(m, 9)


def top_search_q(spark, sf_dir):
    """The first 100 documents of every topic few-shot query, by bounded selection."""
    run = VectorRun(spark, sf_dir, scopes=("topic",), shots=("few-shot",))
    top = top_search(run.queries, run.space, 100, matrix=run.matrix)
    return top.select("review_id", "database", "query_id", "original_id", "cosine_similarity", "rank")


def few_shot_queries_q(spark, sf_dir):
    vecs = driver.vectors(spark, sf_dir)
    q = select_queries(driver.vector_gold(vecs), None, "topic", "few-shot")
    return q.select("review_id", "query_id")


def one_shot_pick_q(spark, sf_dir):
    vecs = driver.vectors(spark, sf_dir)
    p = pick_one(vecs.select("review_id", "article_id"), ["review_id"], "article_id")
    return p.select("review_id", F.col("article_id").alias("picked_id"))


def topic_vector_q(spark, sf_dir):
    vecs = driver.vectors(spark, sf_dir)
    t = topic_vectors(vecs)
    return t.select("review_id", F.posexplode("embedding").alias("pos", "value")) \
        .select("review_id", F.col("pos").cast("long").alias("pos"), F.round("value", 9).alias("value"))


QUERIES = {
    "ranked_metrics": ranked_metrics_q,
    "cosine_rank": cosine_rank_q,
    "rrf_fuse": rrf_fuse_q,
    "combined_rank": combined_rank_q,
    "distributed_rank": distributed_rank_q,
    "cutoff_prefix": cutoff_prefix_q,
    "recall_at_k": recall_at_k_q,
    "top_search": top_search_q,
    "few_shot_queries": few_shot_queries_q,
    "one_shot_pick": one_shot_pick_q,
    "topic_vectors": topic_vector_q,
}

# ------------------------------------------------------------- oracle SQL --

_SQL_GOLD = """
gold AS (
  SELECT article_id AS ground_truth_article_id, review_id, embedding
  FROM v
  QUALIFY row_number() OVER (PARTITION BY review_id
            ORDER BY md5('42:' || CAST(article_id AS VARCHAR)), article_id) <= 3
)"""

_SQL_TOPICS = """
topic_pos AS (
  SELECT review_id, p, avg(x) AS m FROM (
    SELECT review_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS p FROM v
  ) GROUP BY review_id, p
),
topics AS (SELECT review_id, list(m ORDER BY p) AS embedding FROM topic_pos GROUP BY review_id)"""

_SQL_ONE = """
one AS (
  SELECT review_id, ground_truth_article_id, embedding FROM gold
  QUALIFY row_number() OVER (PARTITION BY review_id
            ORDER BY md5(CAST(ground_truth_article_id AS VARCHAR)), ground_truth_article_id) = 1
)"""

_SQL_SCENARIOS = """
q0 AS (
  SELECT 'topic' AS scope, 'zero-shot' AS shot, review_id, 'topic:' || review_id AS query_id, 'topic' AS query_kind, embedding FROM topics
  UNION ALL SELECT 'topic', 'one-shot', review_id, CAST(ground_truth_article_id AS VARCHAR), 'article', embedding FROM one
  UNION ALL SELECT 'topic', 'few-shot', review_id, CAST(ground_truth_article_id AS VARCHAR), 'article', embedding FROM gold
  UNION ALL SELECT 'overall', 'zero-shot', 'overall', 'topic:' || review_id, 'topic', embedding FROM topics
  UNION ALL SELECT 'overall', 'one-shot', 'overall', CAST(ground_truth_article_id AS VARCHAR), 'article', embedding FROM one
  UNION ALL SELECT 'overall', 'few-shot', 'overall', CAST(ground_truth_article_id AS VARCHAR), 'article', embedding FROM gold
)"""


_SQL_RANK_FUSE = """scored AS (
  SELECT q.scope, q.shot, q.review_id, q.database, q.query_id, s.article_id, s.original_id,
         round(list_cosine_similarity(q.embedding, s.embedding), 9) AS cosine_similarity
  FROM q JOIN space s ON q.database = s.database
),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY scope, shot, review_id, database, query_id
                               ORDER BY cosine_similarity DESC, original_id) AS rank
  FROM scored
),
fused0 AS (
  SELECT scope, shot, review_id, database, original_id,
         round(sum(1.0::DOUBLE / (60 + rank)), 12) AS rrf_score,
         avg(cosine_similarity) AS cosine_similarity,
         min(article_id) AS article_id, count(*) AS n_queries
  FROM ranked GROUP BY scope, shot, review_id, database, original_id
),
fused AS (
  SELECT *, row_number() OVER (PARTITION BY scope, shot, review_id, database
                               ORDER BY rrf_score DESC, original_id) AS combined_rank
  FROM fused0
)"""


def _sql_rank_stages(scenario_filter: str = "TRUE") -> str:
    return f"""
WITH {SQL_VECTORS},
{_SQL_GOLD},
{_SQL_TOPICS},
{_SQL_ONE},
{_SQL_SCENARIOS},
dbs AS (SELECT unnest(['pubmed', 'medline', 'embase', 'openalex']) AS database),
q AS (SELECT q0.*, dbs.database FROM q0, dbs WHERE {scenario_filter}),
space AS (
  SELECT * FROM v
  WHERE embedding IS NOT NULL AND list_dot_product(embedding, embedding) > 0
  QUALIFY row_number() OVER (PARTITION BY database, original_id ORDER BY article_id) = 1
),
{_SQL_RANK_FUSE}"""


_SQL_VEC_TRUTH = """vt AS (
  SELECT article_id AS ground_truth_article_id, review_id,
         CASE WHEN database IN ('pubmed', 'medline') THEN 'v' || CAST(article_id AS VARCHAR) END AS pm,
         CASE WHEN database = 'embase' THEN 'v' || CAST(article_id AS VARCHAR) END AS em,
         CASE WHEN database = 'openalex' THEN 'v' || CAST(article_id AS VARCHAR) END AS oa
  FROM v
),
tl0 AS (
  SELECT ground_truth_article_id, review_id, 'pubmed' AS database, pm AS clean_id FROM vt
  UNION ALL SELECT ground_truth_article_id, review_id, 'medline', pm FROM vt
  UNION ALL SELECT ground_truth_article_id, review_id, 'embase', em FROM vt
  UNION ALL SELECT ground_truth_article_id, review_id, 'openalex', oa FROM vt
),
tl1 AS (
  SELECT tl0.*, k.truth_kind FROM tl0 JOIN (VALUES ('raw'), ('adjusted')) k(truth_kind)
    ON k.truth_kind = 'raw' OR tl0.clean_id IS NOT NULL
),
tl AS (SELECT * FROM tl1 UNION ALL SELECT ground_truth_article_id, 'overall', database, clean_id, truth_kind FROM tl1)"""

_SQL_METRICS_CORE = """m AS (
  SELECT f.scope, f.shot, f.database, f.review_id, t.truth_kind, t.ground_truth_article_id,
         min(f.combined_rank) AS combined_rank,
         arg_min(f.cosine_similarity, f.combined_rank) AS cos
  FROM tl t JOIN fused f
    ON t.review_id = f.review_id AND t.database = f.database
   AND t.clean_id = {clean_f}
  GROUP BY ALL
),
qid AS (SELECT DISTINCT scope, shot, review_id, query_id FROM q0 WHERE query_kind = 'article'),
per AS (
  SELECT m.scope, m.shot, m.database, m.review_id, m.truth_kind,
         count(*) AS mm, min(combined_rank) AS r_first,
         min(CASE WHEN qid.query_id IS NULL THEN combined_rank END) AS r_new,
         max(combined_rank) AS r_cut, arg_max(cos, combined_rank) AS sim,
         count(*) FILTER (WHERE combined_rank <= 10) AS at10,
         count(*) FILTER (WHERE combined_rank <= 100) AS at100,
         count(*) FILTER (WHERE combined_rank <= 1000) AS at1000
  FROM m LEFT JOIN qid
    ON m.scope = qid.scope AND m.shot = qid.shot AND m.review_id = qid.review_id
   AND CAST(m.ground_truth_article_id AS VARCHAR) = qid.query_id
  GROUP BY ALL
),
nd AS (SELECT scope, shot, database, review_id, count(*) AS nn FROM fused GROUP BY ALL),
g AS (SELECT review_id, database, truth_kind, count(*) AS gg FROM tl GROUP BY ALL),
grid AS (SELECT nd.*, k.truth_kind FROM nd, (VALUES ('raw'), ('adjusted')) k(truth_kind)),
t AS (
  SELECT grid.scope, grid.shot, grid.database, grid.review_id, grid.truth_kind,
         CAST(coalesce(g.gg, 0) AS DOUBLE) AS G, CAST(coalesce(per.mm, 0) AS DOUBLE) AS M,
         CAST(grid.nn AS DOUBLE) AS N, CAST(per.r_cut AS DOUBLE) AS C,
         per.r_first, per.r_new, per.sim, per.at10, per.at100, per.at1000
  FROM grid
  LEFT JOIN g ON g.review_id = grid.review_id AND g.database = grid.database AND g.truth_kind = grid.truth_kind
  LEFT JOIN per ON per.scope = grid.scope AND per.shot = grid.shot AND per.database = grid.database
               AND per.review_id = grid.review_id AND per.truth_kind = grid.truth_kind
),
x AS (
  SELECT *,
    CASE WHEN M > 0 THEN M / G ELSE 0.0 END AS rec,
    CASE WHEN M > 0 THEN M / N ELSE 0.0 END AS prec,
    CASE WHEN M > 0 THEN M / C ELSE 0.0 END AS precc
  FROM t
),
y AS (
  SELECT scope, shot, database, review_id, truth_kind, G, M, N, C, r_first, r_new, sim, at10, at100, at1000, rec, prec, precc,
    CASE WHEN M > 0 THEN N / M END AS nnr_raw,
    CAST(r_new AS DOUBLE) AS rank_new_relevant,
    CAST(r_first AS DOUBLE) AS rank_first_relevant,
    CASE WHEN M > 0 THEN C / M END AS nnr_cutoff,
    CAST(M AS BIGINT) AS n_retrieved, CAST(G - M AS BIGINT) AS n_missed,
    rec AS recall, rec AS recall_cutoff, prec AS precision, precc AS precision_cutoff,
    CASE WHEN M > 0 THEN coalesce((2.0 * prec * rec) / nullif(1.0 * prec + rec, 0), 0.0) ELSE 0.0 END AS f1_score,
    CASE WHEN M > 0 THEN coalesce((5.0 * prec * rec) / nullif(4.0 * prec + rec, 0), 0.0) ELSE 0.0 END AS f2_score,
    CASE WHEN M > 0 THEN coalesce((10.0 * prec * rec) / nullif(9.0 * prec + rec, 0), 0.0) ELSE 0.0 END AS f3_score,
    CASE WHEN M > 0 THEN coalesce((2.0 * precc * rec) / nullif(1.0 * precc + rec, 0), 0.0) ELSE 0.0 END AS f1_score_cutoff,
    CASE WHEN M > 0 THEN coalesce((5.0 * precc * rec) / nullif(4.0 * precc + rec, 0), 0.0) ELSE 0.0 END AS f2_score_cutoff,
    CASE WHEN M > 0 THEN coalesce((10.0 * precc * rec) / nullif(9.0 * precc + rec, 0), 0.0) ELSE 0.0 END AS f3_score_cutoff,
    CASE WHEN M > 0 THEN at10 / G ELSE 0.0 END AS recall_at_10,
    CASE WHEN M > 0 THEN at100 / G ELSE 0.0 END AS recall_at_100,
    CASE WHEN M > 0 THEN at1000 / G ELSE 0.0 END AS recall_at_1000,
    CASE WHEN M > 0 THEN sim ELSE 0.0 END AS similarity_threshold_cutoff,
    CASE WHEN M > 0 THEN 1.0::DOUBLE / r_first ELSE 0.0 END AS mrr,
    CASE WHEN M > 0 THEN 1.0::DOUBLE / r_new END AS mrr_new_relevant,
    CAST(N AS BIGINT) AS overall_screening_workload,
    CAST(CASE WHEN M > 0 THEN C ELSE N END AS BIGINT) AS overall_screening_workload_cutoff
  FROM x
),
z AS (
  SELECT scope, shot, database, review_id, truth_kind,
    {metric_list}
  FROM y
)"""


def _metrics_select(names):
    cols = []
    for c in names:
        if c in ("n_retrieved", "n_missed", "overall_screening_workload", "overall_screening_workload_cutoff"):
            cols.append(f"CASE WHEN G > 0 THEN {c} END AS {c}")
        else:
            cols.append(f"CASE WHEN G > 0 THEN CAST({c} AS DOUBLE) END AS {c}")
    return ",\n    ".join(cols)


_DOUBLE_METRICS = [c for c in RANKED_METRIC_COLUMNS if c not in (
    "n_retrieved", "n_missed", "overall_screening_workload", "overall_screening_workload_cutoff")]


_SQL_ND = "nd AS (SELECT scope, shot, database, review_id, count(*) AS nn FROM fused GROUP BY ALL)"


def metrics_core_sql(strategies: str | None = None) -> str:
    """CTEs m .. z: ranked metrics from ``fused``, truth ``tl`` and queries ``q0``;
    of all of ``strategies`` (scope, shot, database, review_id), if given."""
    core = _SQL_METRICS_CORE
    if strategies:
        core = core.replace(_SQL_ND, _SQL_ND.replace("nd AS", "nd0 AS") + f""",
nd AS (SELECT st.scope, st.shot, st.database, st.review_id, coalesce(nd0.nn, 0) AS nn
       FROM {strategies} st LEFT JOIN nd0 USING (scope, shot, database, review_id))""")
    return (core.replace("{metric_list}", _metrics_select(RANKED_METRIC_COLUMNS))
            .replace("{clean_f}", sql_clean_id("f.original_id")))


def _metrics_sql(scenario_filter="TRUE", select="*"):
    return (_sql_rank_stages(scenario_filter) + ",\n" + _SQL_VEC_TRUTH + ",\n" + metrics_core_sql()
            + f"\nSELECT {select} FROM z")


_RANKED_SELECT = ("scope, shot, database, review_id, truth_kind, n_retrieved, n_missed, "
                  "overall_screening_workload, overall_screening_workload_cutoff, "
                  + sql_round(_DOUBLE_METRICS, 9, {"similarity_threshold_cutoff": 6}))

ORACLES = {
    "ranked_metrics": _metrics_sql(select=_RANKED_SELECT),
    "distributed_rank": _sql_rank_stages("q0.scope = 'overall' AND q0.shot = 'few-shot'")
    + "\nSELECT database, original_id, round(rrf_score, 12) AS rrf_score, "
      "round(cosine_similarity, 6) AS cosine_similarity, combined_rank, n_queries FROM fused",
    "cosine_rank": _sql_rank_stages("q0.scope = 'topic' AND q0.shot = 'few-shot'")
    + "\nSELECT review_id, database, query_id, original_id, cosine_similarity, rank FROM ranked",
    "top_search": _sql_rank_stages("q0.scope = 'topic' AND q0.shot = 'few-shot'")
    + "\nSELECT review_id, database, query_id, original_id, cosine_similarity, rank FROM ranked WHERE rank <= 100",
    "rrf_fuse": _sql_rank_stages("q0.scope = 'overall' AND q0.shot = 'few-shot'")
    + "\nSELECT database, original_id, round(rrf_score, 12) AS rrf_score, "
      "round(cosine_similarity, 6) AS cosine_similarity, combined_rank, n_queries FROM fused",
    "combined_rank": _sql_rank_stages("q0.scope = 'topic' AND q0.shot = 'one-shot'")
    + "\nSELECT review_id, database, original_id, combined_rank FROM fused",
    "cutoff_prefix": _metrics_sql("q0.scope = 'topic' AND q0.shot = 'few-shot'",
                                  select="scope, shot, database, review_id, overall_screening_workload_cutoff AS c")
    .replace("\nSELECT scope, shot, database, review_id, overall_screening_workload_cutoff AS c FROM z",
             ",\ncut AS (SELECT scope, shot, database, review_id, overall_screening_workload_cutoff AS c "
             "FROM z WHERE truth_kind = 'raw' AND n_retrieved > 0)\n"
             "SELECT f.review_id, f.database, f.original_id, f.combined_rank FROM fused f "
             "JOIN cut USING (scope, shot, database, review_id) WHERE f.combined_rank <= cut.c"),
    "recall_at_k": _metrics_sql("q0.scope = 'topic' AND q0.shot = 'zero-shot'",
                                select="scope, shot, database, review_id, truth_kind, "
                                + sql_round(["recall_at_10", "recall_at_100", "recall_at_1000"], 9)),
    "few_shot_queries": f"WITH {SQL_VECTORS},{_SQL_GOLD}\n"
                        "SELECT review_id, CAST(ground_truth_article_id AS VARCHAR) AS query_id FROM gold",
    "one_shot_pick": f"WITH {SQL_VECTORS}\nSELECT review_id, article_id AS picked_id FROM v "
                     "QUALIFY row_number() OVER (PARTITION BY review_id "
                     "ORDER BY md5(CAST(article_id AS VARCHAR)), article_id) = 1",
    "topic_vectors": f"WITH {SQL_VECTORS},{_SQL_TOPICS}\n"
                     "SELECT review_id, CAST(p - 1 AS BIGINT) AS pos, round(m, 9) AS value FROM topic_pos",
}
