"""Report and statistics plans: workflow comparison tables over per-topic
metrics of the topic-specific (T) and broad (O) searches, and their oracle
SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.matching import search_metrics
from ..operators.report import (guideline_totals, mean_change, median_iqr, nnr_change,
                                workflow_pivot, zero_counts)
from ..operators.stats import (bh_adjust, log_ratio_contrast, p_text, paired, ratio_effects,
                               significance_code, wilcoxon)
from ..session import stored_once
from .common import (SQL_ARTICLES, SQL_TRUTH, SQL_TRUTH_LONG, round_doubles, sql_clean_id,
                     sql_round)
from .eval_plans import broad_results, long_truth, topic_metrics_df

WORKFLOWS = ["T", "O"]
_COLS = ["workflow", "database", "review_id", "recall", "precision", "nnr", "n_retrieved",
         "n_missed", "overall_screening_workload"]


def workflow_metrics(spark, sf_dir) -> DataFrame:
    """Per (workflow, database, review) raw-truth metrics of both searches."""
    t = topic_metrics_df(spark, sf_dir).where(F.col("truth_kind") == "raw") \
        .withColumn("workflow", F.lit("T")).select(*_COLS)
    o = search_metrics(long_truth(spark, sf_dir), broad_results(spark, sf_dir), ["database"],
                       kinds=("raw",), truth_keys=["review_id"]) \
        .withColumn("workflow", F.lit("O")).select(*_COLS)
    return t.unionByName(o)


def _recall_pairs(spark, sf_dir, metric="recall"):
    return paired(workflow_metrics(spark, sf_dir), ["database", "review_id"], "workflow", "T", "O", metric)


def median_iqr_q(spark, sf):
    m = median_iqr(workflow_metrics(spark, sf), ["workflow", "database"], ["recall", "precision"])
    return round_doubles(m, 6)


def zero_pivot_q(spark, sf):
    return zero_counts(workflow_metrics(spark, sf), "database", "workflow", WORKFLOWS)


def workflow_pivot_q(spark, sf):
    return round_doubles(workflow_pivot(workflow_metrics(spark, sf), ["database", "review_id"],
                                        "workflow", WORKFLOWS, "recall"))


def guideline_totals_q(spark, sf):
    return round_doubles(guideline_totals(workflow_metrics(spark, sf), ["workflow", "database"]))


def nnr_change_q(spark, sf):
    ch = nnr_change(workflow_metrics(spark, sf), ["database", "review_id"], "workflow", "T", "O")
    return round_doubles(mean_change(ch, ["database"]))


def paired_diff_q(spark, sf):
    return round_doubles(median_iqr(_recall_pairs(spark, sf), ["database"], ["diff"]), 6)


def wilcoxon_q(spark, sf):
    return round_doubles(wilcoxon(_recall_pairs(spark, sf), ["database"]))


def _stacked_pairs(spark, sf):
    """Broad against topic search per (database, review, metric): the metrics are
    stacked, so the metric table is built once."""
    wm = workflow_metrics(spark, sf).select(
        "workflow", "database", "review_id",
        F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value"))
                            for m in ("recall", "precision")])).alias("_m"))
    wm = wm.select("workflow", "database", "review_id", "_m.metric", "_m.value")
    return paired(wm, ["database", "review_id", "metric"], "workflow", "T", "O", "value")


def _tests(spark, sf):
    return wilcoxon(_stacked_pairs(spark, sf), ["database", "metric"])


def bh_adjust_q(spark, sf):
    adj = bh_adjust(_tests(spark, sf).where(F.col("p_value").isNotNull()), "p_value",
                    order_key=["database", "metric"])
    out = adj.select("database", "metric", "p_value", "p_adjusted",
                     significance_code("p_adjusted").alias("signif"))
    return round_doubles(out)


def workflow_stats_q(spark, sf):
    """The published contrasts: per database and metric, the broad search against
    the topic search as a ratio with its interval, percent and direction, and the
    adjusted p as a number, as text and as a code."""
    key = ["database", "metric"]
    pairs = stored_once(_stacked_pairs(spark, sf))
    effects = ratio_effects(log_ratio_contrast(pairs, key)).drop("sd", "se").withColumnRenamed("n", "n_pairs")
    tests = bh_adjust(wilcoxon(pairs, key).where(F.col("p_value").isNotNull()), "p_value", order_key=key)
    out = effects.join(tests.select(*key, "p_value", "p_adjusted"), key, "left")
    out = round_doubles(out.withColumn("contrast", F.lit("O vs T")), 9)
    return out.withColumn("p_text", p_text("p_adjusted")).withColumn("signif", significance_code("p_adjusted"))


def log_ratio_contrast_q(spark, sf):
    c = log_ratio_contrast(_recall_pairs(spark, sf), ["database"])
    return round_doubles(ratio_effects(c))


QUERIES = {
    "median_iqr": median_iqr_q,
    "zero_pivot": zero_pivot_q,
    "workflow_pivot": workflow_pivot_q,
    "guideline_totals": guideline_totals_q,
    "nnr_change": nnr_change_q,
    "paired_diff": paired_diff_q,
    "wilcoxon": wilcoxon_q,
    "bh_adjust": bh_adjust_q,
    "workflow_stats": workflow_stats_q,
    "log_ratio_contrast": log_ratio_contrast_q,
}

# ------------------------------------------------------------- oracle SQL --

_WM = f"""WITH RECURSIVE {SQL_ARTICLES},
{SQL_TRUTH},
{SQL_TRUTH_LONG},
res_t AS (SELECT database, review_id, {sql_clean_id('original_id')} AS clean_id FROM articles),
hits_t AS (SELECT DISTINCT database, review_id, clean_id FROM res_t WHERE clean_id IS NOT NULL),
res_b AS (
  SELECT database, original_id, {sql_clean_id('original_id')} AS clean_id FROM articles
  WHERE publication_year BETWEEN 1990 AND 2022
  QUALIFY row_number() OVER (PARTITION BY database, original_id ORDER BY article_id) = 1
),
hits_b AS (SELECT DISTINCT database, clean_id FROM res_b WHERE clean_id IS NOT NULL),
raw_t AS (SELECT * FROM truth_long WHERE truth_kind = 'raw'),
cnt_t AS (SELECT t.database, t.review_id, count(*) AS g, count(h.clean_id) AS m
          FROM raw_t t LEFT JOIN hits_t h
            ON t.database = h.database AND t.review_id = h.review_id AND t.clean_id = h.clean_id
          GROUP BY ALL),
cnt_b AS (SELECT t.database, t.review_id, count(*) AS g, count(h.clean_id) AS m
          FROM raw_t t LEFT JOIN hits_b h ON t.database = h.database AND t.clean_id = h.clean_id
          GROUP BY ALL),
n_t AS (SELECT database, review_id, count(*) AS n FROM res_t GROUP BY ALL),
n_b AS (SELECT database, count(*) AS n FROM res_b GROUP BY ALL),
tm AS (
  SELECT 'T' AS workflow, c.database, c.review_id, CAST(c.g AS DOUBLE) AS G, CAST(c.m AS DOUBLE) AS M,
         CAST(coalesce(n.n, 0) AS DOUBLE) AS N
  FROM cnt_t c LEFT JOIN n_t n USING (database, review_id)
  UNION ALL
  SELECT 'O', c.database, c.review_id, CAST(c.g AS DOUBLE), CAST(c.m AS DOUBLE), CAST(coalesce(n.n, 0) AS DOUBLE)
  FROM cnt_b c LEFT JOIN n_b n USING (database)
),
wm AS (
  SELECT workflow, database, review_id,
    CASE WHEN M = 0 THEN 0.0 ELSE M / G END AS recall,
    CASE WHEN M = 0 THEN 0.0 ELSE M / N END AS precision,
    CASE WHEN M = 0 THEN 0.0 ELSE N / M END AS nnr,
    CAST(M AS BIGINT) AS n_retrieved, CAST(G - M AS BIGINT) AS n_missed,
    CAST(N AS BIGINT) AS overall_screening_workload
  FROM tm
)"""


def _pairs(metric: str, name: str = "pr") -> str:
    return f"""{name} AS (
  SELECT a.database, a.review_id, a.{metric} AS value_a, b.{metric} AS value_b, b.{metric} - a.{metric} AS diff
  FROM wm a JOIN wm b ON a.database = b.database AND a.review_id = b.review_id
  WHERE a.workflow = 'T' AND b.workflow = 'O'
)"""


def _sf(z: str) -> str:
    """SQL twin of stats.normal_sf."""
    t = f"(1.0 / (1.0 + {z} * 0.2316419))"
    poly = (f"({t} * (0.319381530 + {t} * (-0.356563782 + {t} * (1.781477937 + {t} * "
            f"(-1.821255978 + {t} * 1.330274429)))))")
    return f"(exp(-{z} * {z} / 2.0) * 0.3989422804014327 * {poly})"


def _wilcoxon(pairs: str, out: str) -> str:
    return f"""nz_{out} AS (SELECT *, abs(diff) AS a FROM {pairs} WHERE diff <> 0),
rk_{out} AS (
  SELECT *, rank() OVER (PARTITION BY database ORDER BY a) + (count(*) OVER (PARTITION BY database, a) - 1) / 2.0 AS ar
  FROM nz_{out}
),
ties_{out} AS (
  SELECT database, sum(pow(t, 3) - t) AS tc FROM (SELECT database, a, count(*) AS t FROM nz_{out} GROUP BY ALL)
  GROUP BY database
),
s_{out} AS (
  SELECT r.database, count(*) AS n,
    sum(CASE WHEN diff > 0 THEN ar ELSE 0.0 END) AS w_plus,
    sum(CASE WHEN diff < 0 THEN ar ELSE 0.0 END) AS w_minus
  FROM rk_{out} r GROUP BY r.database
),
v_{out} AS (
  SELECT s.database, s.n, s.w_plus, s.w_minus, least(s.w_plus, s.w_minus) AS w,
    CAST(s.n AS DOUBLE) * (CAST(s.n AS DOUBLE) + 1) / 4.0 AS mu,
    CAST(s.n AS DOUBLE) * (CAST(s.n AS DOUBLE) + 1) * (2 * CAST(s.n AS DOUBLE) + 1) / 24.0 - t.tc / 48.0 AS var,
    s.n <= 50 AND t.tc = 0 AND s.database NOT IN (SELECT database FROM {pairs} WHERE diff = 0) AS exact
  FROM s_{out} s LEFT JOIN ties_{out} t USING (database)
),
z_{out} AS (SELECT *, CASE WHEN var > 0 THEN (w - mu) / sqrt(var) END AS z FROM v_{out}),
patterns_{out} AS (
  SELECT 0 AS m, 0 AS s, 1.0::DOUBLE AS c
  UNION ALL
  SELECT m + 1, s + (m + 1) * up, sum(c) FROM patterns_{out}, (SELECT unnest([0, 1]) AS up) WHERE m < 50 GROUP BY ALL
),
exact_{out} AS (SELECT database, least(1.0, 2 * sum(c) / pow(2.0, any_value(n))) AS p
                FROM z_{out} JOIN patterns_{out} ON m = n AND s <= w WHERE exact GROUP BY database),
{out} AS (
  SELECT z_{out}.database, CAST(n AS BIGINT) AS n, w_plus, w_minus, w, z,
    CASE WHEN exact THEN p ELSE least(1.0, 2.0 * {_sf('abs(z)')}) END AS p_value,
    CASE WHEN exact THEN 'exact' ELSE 'normal' END AS p_method
  FROM z_{out} LEFT JOIN exact_{out} USING (database)
)"""


def _median_sql(group: str, col: str, src: str) -> str:
    return (f"SELECT {group}, "
            f"round(quantile_cont({col}, 0.5), 6) AS {col}_median, "
            f"round(quantile_cont({col}, 0.25), 6) AS {col}_q1, "
            f"round(quantile_cont({col}, 0.75), 6) AS {col}_q3, "
            f"round(quantile_cont({col}, 0.75) - quantile_cont({col}, 0.25), 6) AS {col}_iqr "
            f"FROM {src} GROUP BY {group}")


_SIG = "CASE WHEN {x} = 0 THEN 0.0 ELSE round({x} * pow(10.0, 3 - floor(log10(abs({x}))))) / pow(10.0, 3 - floor(log10(abs({x})))) END"

ORACLES = {
    "median_iqr": _WM + """,
r AS (SELECT workflow, database,
  quantile_cont(recall, 0.5) AS recall_median, quantile_cont(recall, 0.25) AS recall_q1,
  quantile_cont(recall, 0.75) AS recall_q3,
  quantile_cont(recall, 0.75) - quantile_cont(recall, 0.25) AS recall_iqr,
  quantile_cont(precision, 0.5) AS precision_median, quantile_cont(precision, 0.25) AS precision_q1,
  quantile_cont(precision, 0.75) AS precision_q3,
  quantile_cont(precision, 0.75) - quantile_cont(precision, 0.25) AS precision_iqr
  FROM wm GROUP BY workflow, database)
SELECT workflow, database, """ + sql_round(["recall_median", "recall_q1", "recall_q3", "recall_iqr",
                                            "precision_median", "precision_q1", "precision_q3",
                                            "precision_iqr"], 6) + " FROM r",
    "zero_pivot": _WM + """
SELECT database, count(*) FILTER (WHERE workflow = 'T') AS "T", count(*) FILTER (WHERE workflow = 'O') AS "O"
FROM wm WHERE n_retrieved = 0 GROUP BY database""",
    "workflow_pivot": _WM + """
SELECT database, review_id, round(max(CASE WHEN workflow = 'T' THEN recall END), 9) AS "T",
       round(max(CASE WHEN workflow = 'O' THEN recall END), 9) AS "O"
FROM wm GROUP BY database, review_id""",
    "guideline_totals": _WM + """,
s AS (SELECT workflow, database, sum(n_retrieved) AS n_retrieved, sum(n_missed) AS n_missed,
             sum(overall_screening_workload) AS overall_screening_workload FROM wm GROUP BY ALL),
r AS (SELECT *, CAST(n_retrieved AS DOUBLE) / nullif(CAST(n_retrieved + n_missed AS DOUBLE), 0) AS rr,
             CAST(n_retrieved AS DOUBLE) / nullif(CAST(overall_screening_workload AS DOUBLE), 0) AS pr FROM s),
g AS (SELECT *, """ + _SIG.format(x="rr") + " AS recall, " + _SIG.format(x="pr") + """ AS precision FROM r)
SELECT workflow, database, CAST(n_retrieved AS BIGINT) AS n_retrieved, CAST(n_missed AS BIGINT) AS n_missed,
  CAST(overall_screening_workload AS BIGINT) AS overall_screening_workload,
  round(recall, 9) AS recall, round(precision, 9) AS precision,
  round(""" + _SIG.format(x="(1.0 / nullif(precision, 0))") + """, 9) AS nnr
FROM g""",
    "nnr_change": _WM + """,
b AS (SELECT database, review_id, nnr AS base_value FROM wm WHERE workflow = 'T' AND nnr > 0),
n AS (SELECT database, review_id, nnr AS new_value FROM wm WHERE workflow = 'O' AND nnr > 0),
c AS (SELECT database, new_value - base_value AS change, (new_value - base_value) * 100.0 / base_value AS change_pct
      FROM b JOIN n USING (database, review_id))
SELECT database, round(avg(change), 9) AS mean_change, round(avg(change_pct), 9) AS mean_change_pct,
       count(*) AS n_pairs FROM c GROUP BY database""",
    "paired_diff": _WM + ",\n" + _pairs("recall") + "\n" + _median_sql("database", "diff", "pr"),
    "wilcoxon": _WM + ",\n" + _pairs("recall") + ",\n" + _wilcoxon("pr", "wx") + """
SELECT database, n, """ + sql_round(["w_plus", "w_minus", "w", "z", "p_value"]) + ", p_method FROM wx",
    "bh_adjust": None,  # filled below
    "log_ratio_contrast": _WM + ",\n" + _pairs("recall") + """,
l AS (SELECT database, ln(value_b + 1e-6) - ln(value_a + 1e-6) AS lr FROM pr),
s AS (SELECT database, avg(lr) AS estimate, stddev_samp(lr) AS sd, count(*) AS n FROM l GROUP BY database),
e AS (SELECT *, sd / sqrt(CAST(n AS DOUBLE)) AS se FROM s),
c AS (SELECT *, estimate - 1.959963984540054 * se AS lower, estimate + 1.959963984540054 * se AS upper FROM e)
SELECT database, n, """ + sql_round(["estimate", "sd", "se", "lower", "upper"]) + """,
  round(exp(estimate), 9) AS ratio, round(exp(lower), 9) AS ratio_lower, round(exp(upper), 9) AS ratio_upper,
  round((exp(estimate) - 1.0) * 100.0, 9) AS pct_change,
  CASE WHEN estimate > 0 THEN 'higher' WHEN estimate < 0 THEN 'lower' ELSE 'no change' END AS direction
FROM c""",
}

_BH = _WM + ",\n" + _pairs("recall", "pr_r") + ",\n" + _pairs("precision", "pr_p") + ",\n" \
    + _wilcoxon("pr_r", "wr") + ",\n" + _wilcoxon("pr_p", "wp") + """,
tests AS (SELECT database, 'recall' AS metric, p_value FROM wr
          UNION ALL SELECT database, 'precision', p_value FROM wp),
q AS (SELECT *, p_value * count(*) OVER () / row_number() OVER (ORDER BY p_value, database, metric) AS qq
      FROM tests WHERE p_value IS NOT NULL),
a AS (SELECT *, least(1.0, min(qq) OVER (ORDER BY p_value, database, metric
                                          ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS p_adjusted FROM q)
SELECT database, metric, round(p_value, 9) AS p_value, round(p_adjusted, 9) AS p_adjusted,
  CASE WHEN p_adjusted < 0.001 THEN '***' WHEN p_adjusted < 0.01 THEN '**' WHEN p_adjusted < 0.05 THEN '*'
       WHEN p_adjusted < 0.1 THEN '.' ELSE '' END AS signif
FROM a"""
ORACLES["bh_adjust"] = _BH
ORACLES["workflow_stats"] = _BH[:_BH.rindex("SELECT database, metric, round")].rstrip() + """,
pairs AS (SELECT 'recall' AS metric, * FROM pr_r UNION ALL SELECT 'precision', * FROM pr_p),
l AS (SELECT database, metric, ln(value_b + 1e-6) - ln(value_a + 1e-6) AS lr FROM pairs),
s AS (SELECT database, metric, avg(lr) AS estimate, count(*) AS n_pairs, stddev_samp(lr) / sqrt(CAST(count(*) AS DOUBLE)) AS se FROM l GROUP BY ALL),
e AS (SELECT *, estimate - 1.959963984540054 * se AS lower, estimate + 1.959963984540054 * se AS upper FROM s),
j AS (SELECT database, metric, n_pairs, """ + sql_round(["estimate", "lower", "upper"]) + """,
        round(exp(estimate), 9) AS ratio, round(exp(lower), 9) AS ratio_lower, round(exp(upper), 9) AS ratio_upper,
        round((exp(estimate) - 1.0) * 100.0, 9) AS pct_change,
        CASE WHEN estimate > 0 THEN 'higher' WHEN estimate < 0 THEN 'lower' ELSE 'no change' END AS direction,
        round(p_value, 9) AS p_value, round(p_adjusted, 9) AS p_adjusted, 'O vs T' AS contrast
      FROM e LEFT JOIN a USING (database, metric))
SELECT *, CASE WHEN p_adjusted <= 0.01 THEN '<0.01' ELSE printf('%.6f', p_adjusted) END AS p_text,
  CASE WHEN p_adjusted < 0.001 THEN '***' WHEN p_adjusted < 0.01 THEN '**' WHEN p_adjusted < 0.05 THEN '*'
       WHEN p_adjusted < 0.1 THEN '.' ELSE '' END AS signif
FROM j"""
