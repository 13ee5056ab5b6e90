"""Queries of evaluation analytics over surrogate experiment rows, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluate as E
from . import views as V
from .registry import query

R6 = lambda c: F.round(c, 6)


@query(rf"""WITH {V.RESULTS_SQL}
  SELECT experiment, coalesce(qtype, 'ALL') AS qtype, count(*) AS n, round(avg(recall), 6) AS recall, count(DISTINCT cluster) FILTER (WHERE recall IS NOT NULL) AS n_clusters,
    round(avg(llm_calls), 6) AS llm_calls, round(avg(prompt_tokens + completion_tokens), 6) AS tokens,
    round(quantile_cont(latency_s, 0.5), 6) AS lat_p50, round(quantile_cont(latency_s, 0.95), 6) AS lat_p95, round(avg(escalated::INT), 6) AS escalated,
    round(avg((label = gold_route)::INT) FILTER (WHERE NOT starts_with(route_source, 'fixed:') AND gold_route IS NOT NULL), 6) AS route_acc
  FROM results GROUP BY GROUPING SETS ((experiment), (experiment, qtype))""")
def stratified_report(spark: SparkSession, sf: str) -> DataFrame:
    report = E.stratified(V.results(spark, sf))
    return report.select("experiment", "qtype", "n", *[R6(c).alias(c) for c in ("recall", "llm_calls", "tokens", "lat_p50", "lat_p95", "escalated", "route_acc")], "n_clusters")


@query(None)
def report_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The report with both intervals, in the order of its rows; clusters come from the questions' gold papers (numpy's generator: tests compare it with direct resampling)."""
    asked = V.results(spark, sf).select("id").distinct()
    gold = F.when(F.col("id") % 4 != 0, F.array(F.concat(F.lit("p"), F.col("id") % 13))).otherwise(F.array().cast("array<string>"))
    kinds = tuple(sorted(("view", "click", "purchase", "signup", "error")))
    return E.report_rows(V.results(spark, sf), asked.withColumn("gold_paper_ids", gold), kinds)


@query(r"""WITH q AS (SELECT DISTINCT event_id // 4 AS id FROM events), g AS (SELECT id, CASE WHEN id % 4 <> 0 THEN ['p' || (id % 13), 'x'] ELSE [] END AS papers FROM q) SELECT id, coalesce(papers[1], id::VARCHAR) AS cluster FROM g""")
def question_clusters(spark: SparkSession, sf: str) -> DataFrame:
    """Every question's cluster: its first gold paper, else itself."""
    asked = V.results(spark, sf).select("id").distinct()
    papers = F.when(F.col("id") % 4 != 0, F.array(F.concat(F.lit("p"), F.col("id") % 13), F.lit("x"))).otherwise(F.array().cast("array<string>"))
    return asked.select("id", E.gold_cluster(papers, F.col("id")).alias("cluster"))


@query(rf"""WITH {V.RESULTS_SQL} SELECT experiment, round(quantile_cont(latency_s, 0.5), 6) AS p50, round(quantile_cont(latency_s, 0.9), 6) AS p90, round(quantile_cont(latency_s, 0.95), 6) AS p95 FROM results GROUP BY experiment""")
def percentile_latency(spark: SparkSession, sf: str) -> DataFrame:
    return V.results(spark, sf).groupBy("experiment").agg(*[R6(F.percentile("latency_s", p / 100)).alias(f"p{p}") for p in (50, 90, 95)])


@query(rf"""WITH {V.RESULTS_SQL}, l AS (SELECT experiment, recall, row_number() OVER (PARTITION BY experiment ORDER BY id) - 1 AS i FROM results WHERE recall IS NOT NULL),
  s AS (SELECT experiment, count(*) AS n, avg(recall) AS mean FROM l GROUP BY experiment),
  d AS (SELECT l.experiment, x.rep, ('0x' || substr(md5(x.rep || ':' || l.i), 1, 8))::BIGINT % s.n AS pick FROM l JOIN s USING (experiment), (SELECT unnest(range(1000)) AS rep) x),
  m AS (SELECT d.experiment, d.rep, avg(l.recall) AS m FROM d JOIN l ON l.experiment = d.experiment AND l.i = d.pick GROUP BY d.experiment, d.rep)
  SELECT s.experiment, s.n, round(s.mean, 6) AS mean, round(quantile_cont(m, 0.025), 6) AS lo, round(quantile_cont(m, 0.975), 6) AS hi FROM s JOIN m USING (experiment) GROUP BY s.experiment, s.n, s.mean""")
def bootstrap_ci_hashed(spark: SparkSession, sf: str) -> DataFrame:
    """The portable interval of each experiment's mean, from 1000 replicates."""
    ci = E.hashed_bootstrap(V.results(spark, sf), ["experiment"], "recall", "id", E.REPS)
    return ci.select("experiment", "n", *[R6(c).alias(c) for c in ("mean", "lo", "hi")])


@query(None)
def bootstrap_ci(spark: SparkSession, sf: str) -> DataFrame:
    """The interval of numpy's generator, by position; tests compare it with direct resampling."""
    return E.bootstrap(V.results(spark, sf), ["experiment", "qtype"], "recall", "id")


@query(None)
def cluster_bootstrap_ci(spark: SparkSession, sf: str) -> DataFrame:
    return E.cluster_bootstrap(V.results(spark, sf), ["experiment"], "recall", "cluster", "id")


@query(rf"""WITH {V.RESULTS_SQL}, d AS (SELECT a.experiment, a.recall - b.recall AS diff FROM results a JOIN results b ON a.id = b.id AND b.experiment = 'exp1' WHERE a.experiment <> 'exp1')
  SELECT experiment, count(*) AS n, round(avg(diff), 6) AS mean_diff, count(*) FILTER (WHERE diff > 0) AS wins, count(*) FILTER (WHERE diff = 0) AS ties, count(*) FILTER (WHERE diff < 0) AS losses FROM d GROUP BY experiment""")
def paired_vs_ref(spark: SparkSession, sf: str) -> DataFrame:
    return E.paired_summary(E.paired(V.results(spark, sf), "exp1")).withColumn("mean_diff", R6("mean_diff"))


@query(None)
def paired_intervals(spark: SparkSession, sf: str) -> DataFrame:
    """Paired differences with intervals by question and by cluster, and whether they exclude 0."""
    diffs = E.paired(V.results(spark, sf), "exp1")
    q = E.bootstrap(diffs, ["experiment"], "diff", "id", reps=E.PAIRED_REPS).withColumn("excludes_zero", E.excludes_zero(F.col("lo"), F.col("hi")))
    c = E.cluster_bootstrap(diffs, ["experiment"], "diff", "cluster", "id").select("experiment", "n_clusters", F.col("lo").alias("clo"), F.col("hi").alias("chi"))
    return q.join(c, "experiment").withColumn("excludes_zero_by_cluster", E.excludes_zero(F.col("clo"), F.col("chi")))


@query(rf"""WITH {V.RESULTS_SQL}, g AS (SELECT *, 1 + id % 2 AS run FROM results),
  m AS (SELECT experiment, avg(recall) FILTER (WHERE run = 1) AS m1, avg(recall) FILTER (WHERE run = 2) AS m2 FROM g GROUP BY experiment),
  r AS (SELECT *, row_number() OVER (ORDER BY round(m1, 9) DESC, experiment) AS r1, row_number() OVER (ORDER BY round(m2, 9) DESC, experiment) AS r2 FROM m WHERE m1 IS NOT NULL AND m2 IS NOT NULL)
  SELECT experiment, round(m1, 6) AS mean_1, round(m2, 6) AS mean_2, r1 AS rank_1, r2 AS rank_2, round(abs(m1 - m2), 6) AS abs_diff, bool_and(r1 = r2) OVER () AS stable FROM r""")
def rank_stability(spark: SparkSession, sf: str) -> DataFrame:
    out = E.rank_stability(V.results(spark, sf).withColumn("run", (F.col("id") % 2 + 1).cast("int")), "run")
    return out.select("experiment", R6("mean_1").alias("mean_1"), R6("mean_2").alias("mean_2"), F.col("rank_1").cast("long").alias("rank_1"), F.col("rank_2").cast("long").alias("rank_2"), R6("abs_diff").alias("abs_diff"), "stable")


@query(rf"""WITH {V.RESULTS_SQL} SELECT experiment, count(*) AS n, round(avg((label = gold_route)::INT), 6) AS route_acc FROM results
  WHERE NOT starts_with(route_source, 'fixed:') AND gold_route IS NOT NULL GROUP BY experiment""")
def route_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    rows = V.results(spark, sf).where(~F.col("route_source").startswith("fixed:") & F.col("gold_route").isNotNull())
    return rows.groupBy("experiment").agg(F.count("*").alias("n"), R6(F.avg((F.col("label") == F.col("gold_route")).cast("double"))).alias("route_acc"))


_RUNS_SQL = rf"""{V.RESULTS_SQL},
  runs AS (SELECT r.id, r.label AS rl, r.recall AS rr, r.llm_calls AS rc, o.label AS ol, o.recall AS orr, o.llm_calls AS oc, s.label AS sl, s.recall AS sr, s.llm_calls AS sc, r.id % 3 <> 0 AS suff,
      CASE r.label WHEN 'SIMPLE' THEN 0 WHEN 'MULTI_HOP' THEN 1 ELSE 2 END AS rk, CASE o.label WHEN 'SIMPLE' THEN 0 WHEN 'MULTI_HOP' THEN 1 ELSE 2 END AS ok
    FROM results r JOIN results o ON o.id = r.id AND o.experiment = 'exp2' JOIN results s ON s.id = r.id AND s.experiment = 'exp3' WHERE r.experiment = 'exp1' AND r.recall IS NOT NULL AND o.recall IS NOT NULL AND s.recall IS NOT NULL)"""


def _runs(spark: SparkSession, sf: str) -> DataFrame:
    rows = V.results(spark, sf).where("recall is not null")
    of = lambda name: rows.where(F.col("experiment") == name)
    questions = V.results(spark, sf).select("id", (F.col("id") % 3 != 0).alias("oracle_sufficient")).distinct()
    return E.aligned_runs(of("exp1"), of("exp2"), of("exp3"), questions)


@query(rf"""WITH {_RUNS_SQL},
  a AS (SELECT count(*) AS n, avg(rr) AS recall, avg(orr) AS recall_oracle, avg(sr) AS recall_strong, avg(rc) AS calls, avg(oc) AS calls_oracle, avg(sc) AS calls_strong, avg((rk = ok)::INT) AS exact_route_match,
    count(*) FILTER (WHERE rk > ok) AS over_routed, count(*) FILTER (WHERE rk > ok AND rr <= orr + 1e-9) AS wasted, count(*) FILTER (WHERE rk < ok) AS under_routed, count(*) FILTER (WHERE rk < ok AND rr < orr - 1e-9) AS harmful,
    avg((rr >= 1 - 1e-9)::INT) FILTER (WHERE suff) AS sufficient_cover_rate FROM runs)
  SELECT n, round(recall, 6) AS recall, round(recall_oracle, 6) AS recall_oracle, round(recall_strong, 6) AS recall_strong, round(calls, 6) AS calls, round(calls_oracle, 6) AS calls_oracle, round(calls_strong, 6) AS calls_strong,
    round(exact_route_match, 6) AS exact_route_match, over_routed, wasted, under_routed, harmful, round(sufficient_cover_rate, 6) AS sufficient_cover_rate, round(recall / recall_strong, 6) AS recall_retention_vs_strong,
    round(calls_strong - calls, 6) AS calls_saved_vs_strong, round(recall_oracle - recall, 6) AS regret_recall_vs_oracle, round(calls - calls_oracle, 6) AS regret_calls_vs_oracle FROM a""")
def route_diagnostics(spark: SparkSession, sf: str) -> DataFrame:
    d = E.diagnose(_runs(spark, sf))
    return d.select(*[R6(c).alias(c) if t == "double" else F.col(c) for c, t in d.dtypes])


@query(rf"""WITH {_RUNS_SQL} SELECT rl AS r_label, count(*) FILTER (WHERE ol = 'SIMPLE') AS "SIMPLE", count(*) FILTER (WHERE ol = 'MULTI_HOP') AS "MULTI_HOP", count(*) FILTER (WHERE ol = 'UNCERTAIN') AS "UNCERTAIN" FROM runs GROUP BY rl""")
def route_confusion(spark: SparkSession, sf: str) -> DataFrame:
    return E.confusion(_runs(spark, sf))


# A ladder: experiments 1 to 3 of a question stand for the three strategies, cheapest first.
_LADDER_SQL = rf"""{V.RESULTS_SQL}, ladder AS (SELECT id, ['SIMPLE', 'MULTI_HOP', 'UNCERTAIN'][substr(experiment, 4)::INT] AS label, substr(experiment, 4)::INT AS p, recall FROM results WHERE experiment <> 'exp0')"""


def _ladder(spark: SparkSession, sf: str) -> DataFrame:
    step = F.substring("experiment", 4, 1).cast("int")
    return V.results(spark, sf).where("experiment <> 'exp0'").select("id", F.element_at(F.array(*[F.lit(x) for x in E.LABELS]), step).alias("label"), "recall")


_V1 = r"""v1 AS (SELECT id, coalesce(arg_min(label, p) FILTER (WHERE recall >= 1), 'UNCERTAIN') AS gold_route, count(*) FILTER (WHERE recall >= 1) > 0 AS sufficient_v1 FROM ladder GROUP BY id)"""
_V2 = r"""b AS (SELECT *, max(recall) OVER (PARTITION BY id) AS best FROM ladder WHERE recall IS NOT NULL),
  v2 AS (SELECT id, arg_min(label, p) FILTER (WHERE recall >= best - 1e-9) AS gold_route_v2, max(best) AS best_recall, max(best) >= 1 - 1e-9 AS oracle_sufficient FROM b GROUP BY id)"""


@query(rf"""WITH {_LADDER_SQL}, {_V1} SELECT id, gold_route, sufficient_v1 AS oracle_sufficient FROM v1""")
def oracle_v1_labels(spark: SparkSession, sf: str) -> DataFrame:
    return E.oracle_v1(_ladder(spark, sf))


@query(rf"""WITH {_LADDER_SQL}, {_V2} SELECT id, gold_route_v2, best_recall, oracle_sufficient FROM v2""")
def oracle_v2_labels(spark: SparkSession, sf: str) -> DataFrame:
    return E.oracle_v2(_ladder(spark, sf)).drop("ladder_recalls")


@query(rf"""WITH {_LADDER_SQL}, {_V1}, {_V2} SELECT gold_route_v2 AS label, count(*) AS n, count(*) FILTER (WHERE NOT oracle_sufficient) AS insufficient, count(*) FILTER (WHERE gold_route <> gold_route_v2) AS differs_from_v1 FROM v1 JOIN v2 USING (id) GROUP BY gold_route_v2""")
def oracle_v2_counts(spark: SparkSession, sf: str) -> DataFrame:
    ladder = _ladder(spark, sf)
    both = E.oracle_v1(ladder).select("id", "gold_route").join(E.oracle_v2(ladder), "id")
    return both.groupBy(F.col("gold_route_v2").alias("label")).agg(
        F.count("*").alias("n"), F.count_if(~F.col("oracle_sufficient")).alias("insufficient"), F.count_if(F.col("gold_route") != F.col("gold_route_v2")).alias("differs_from_v1")
    )


@query(rf"""WITH {_LADDER_SQL}, {_V1}, {_V2}, j AS (SELECT id::VARCHAR AS text, gold_route, gold_route_v2, oracle_sufficient FROM v1 JOIN v2 USING (id))
  SELECT 'v1' AS scheme, text, gold_route AS label FROM j UNION ALL SELECT 'v2', text, gold_route_v2 FROM j UNION ALL SELECT 'v2_sufficient', text, gold_route_v2 FROM j WHERE oracle_sufficient""")
def training_pairs(spark: SparkSession, sf: str) -> DataFrame:
    ladder = _ladder(spark, sf)
    rows = E.oracle_v1(ladder).select("id", "gold_route").join(E.oracle_v2(ladder), "id").withColumn("text", F.col("id").cast("string"))
    parts = [E.training_pairs(rows, s).select(F.lit(s).alias("scheme"), "text", "label") for s in ("v1", "v2", "v2_sufficient")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(rf"""WITH {_LADDER_SQL}, {_V1}, c AS (SELECT gold_route AS label, count(*) AS n, count(*) FILTER (WHERE NOT sufficient_v1) AS bad FROM v1 GROUP BY gold_route), t AS (SELECT *, sum(n) OVER () AS total, sum(bad) OVER () AS all_bad FROM c)
  SELECT label, n, round(n / total, 6) AS share, concat_ws(',', CASE WHEN total < 150 THEN 'few_labels' END, CASE WHEN n < 0.1 * total THEN 'rare_class' END, CASE WHEN all_bad > 0.25 * total THEN 'many_insufficient' END) AS warnings FROM t""")
def label_stats(spark: SparkSession, sf: str) -> DataFrame:
    return E.label_stats(E.oracle_v1(_ladder(spark, sf))).withColumn("share", R6("share"))
