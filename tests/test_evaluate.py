import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.operators import evaluate as E

ROW = "experiment string, id long, qtype string, recall double, cluster string, llm_calls int, prompt_tokens int, completion_tokens int, latency_s double, escalated boolean, label string, route_source string, gold_route string"


def runs(spark, recalls, experiment="A", label="SIMPLE", calls=0, cluster=None):
    return spark.createDataFrame([(experiment, i, "simple", r, cluster(i) if cluster else str(i), calls, 1, 1, float(i), False, label, "llm", None) for i, r in enumerate(recalls)], ROW)


def test_set_recall(spark):
    got = spark.sql("select array('a','b') g, array('a','c') f").select(E.set_recall(F.col("g"), F.col("f")).alias("x")).first().x
    assert got == 0.5
    assert spark.sql("select array() g, array('a') f").select(E.set_recall(F.col("g"), F.col("f")).alias("x")).first().x is None


def test_report_skips_missing_recall_and_interpolates(spark):
    rows = spark.createDataFrame([("A", i, "simple" if i < 3 else "chain", r, "c", 1, 1, 1, float(i + 1), i == 0, "SIMPLE", "llm" if i else "fixed:SIMPLE", "SIMPLE") for i, r in enumerate([1.0, 0.0, None, 1.0])], ROW)
    got = {r.qtype: r for r in E.stratified(rows).collect()}
    assert set(got) == {"ALL", "simple", "chain"} and got["ALL"].n == 4
    assert got["ALL"].recall == pytest.approx(2 / 3) and got["simple"].recall == 0.5 and got["ALL"].lat_p50 == 2.5 and got["ALL"].route_acc == 1.0


def test_bootstrap_is_by_position_and_handles_few(spark):
    values = [0.0, 1.0, 0.5, None, 1.0]
    got = E.bootstrap(runs(spark, values), ["experiment"], "recall", "id", 300).first()
    v = np.array([x for x in values if x is not None])
    draw = np.random.RandomState(0)
    means = [draw.choice(v, len(v)).mean() for _ in range(300)]
    assert (got.mean, got.lo, got.hi) == pytest.approx((v.mean(), np.percentile(means, 2.5), np.percentile(means, 97.5)))
    assert E.bootstrap_means(np.array([0.3])) == (0.3, 0.3, 0.3) and math.isnan(E.bootstrap_means(np.array([]))[0])


def test_clusters_widen_the_interval(spark):
    rows = runs(spark, [float(i // 10 % 2) for i in range(60)], cluster=lambda i: f"p{i // 10}")
    q, c = E.bootstrap(rows, ["experiment"], "recall", "id").first(), E.cluster_bootstrap(rows, ["experiment"], "recall", "cluster", "id").first()
    assert c.mean == 0.5 and c.n_clusters == 6 and c.hi - c.lo > 1.5 * (q.hi - q.lo)
    two = E.cluster_bootstrap(runs(spark, [0.0, 1.0], cluster=str), ["experiment"], "recall", "cluster", "id").first()
    assert two.mean == 0.5 and two.lo is None and two.hi is None


def test_paired(spark):
    rows = runs(spark, [0.5] * 10, "B").unionByName(runs(spark, [1.0] * 6 + [0.5] * 4, "F"))
    diffs = E.paired(rows, "B")
    s = E.paired_summary(diffs).first()
    assert (s.wins, s.ties, s.losses, s.n) == (6, 4, 0, 10)
    ci = E.bootstrap(diffs, ["experiment"], "diff", "id", 500).withColumn("x", E.excludes_zero(F.col("lo"), F.col("hi"))).first()
    assert ci.lo > 0 and ci.x == "yes"


def test_rank_stability(spark):
    rows = runs(spark, [1.0, 0.0], "A").unionByName(runs(spark, [0.5, 0.5], "B")).withColumn("run", (F.col("id") % 2 + 1).cast("int"))
    got = {r.experiment: r for r in E.rank_stability(rows, "run").collect()}
    assert (got["A"].rank_1, got["A"].rank_2, got["A"].stable, got["A"].abs_diff) == (1, 2, False, 1.0)


def test_diagnostics(spark):
    row = lambda ls, rs, cs: spark.createDataFrame([(i, l, r, c) for i, (l, r, c) in enumerate(zip(ls, rs, cs, strict=True))], "id long, label string, recall double, llm_calls int")  # noqa: E731, E741
    router = row(["SIMPLE", "UNCERTAIN", "SIMPLE", "SIMPLE"], [1.0, 1.0, 0.5, 0.5], [0, 1, 0, 0])
    oracle = row(["SIMPLE", "SIMPLE", "MULTI_HOP", "UNCERTAIN"], [1.0, 1.0, 1.0, 0.5], [0, 0, 1, 1])
    strong = row(["UNCERTAIN"] * 4, [1.0] * 4, [1] * 4)
    questions = spark.createDataFrame([(i, i < 3) for i in range(4)], "id long, oracle_sufficient boolean")
    aligned = E.aligned_runs(router, oracle, strong, questions)
    d = E.diagnose(aligned).first()
    assert (d.over_routed, d.wasted, d.under_routed, d.harmful, d.exact_route_match, d.recall, d.calls_saved_vs_strong) == (1, 1, 2, 1, 0.25, 0.75, 0.75)
    assert d.sufficient_cover_rate == pytest.approx(2 / 3)
    assert {r.r_label: r.SIMPLE for r in E.confusion(aligned).collect()} == {"SIMPLE": 1, "UNCERTAIN": 1}
    with pytest.raises(Exception, match="adaptive"):
        E.diagnose(E.aligned_runs(row(["STATIC"], [1.0], [0]), oracle, strong, questions)).collect()


def test_oracles_and_training_pairs(spark):
    ladders = [(1, 1, 1), (0, 1, 1), (0.5, 0.5, 0.5), (0, 0, 0.5)]
    rows = spark.createDataFrame([(i, l, float(r)) for i, x in enumerate(ladders) for l, r in zip(E.LABELS, x, strict=True)], "id long, label string, recall double")  # noqa: E741
    v1, v2 = {r.id: r for r in E.oracle_v1(rows).collect()}, {r.id: r for r in E.oracle_v2(rows).collect()}
    assert [v2[i].gold_route_v2 for i in range(4)] == ["SIMPLE", "MULTI_HOP", "SIMPLE", "UNCERTAIN"]
    assert [v1[i].gold_route for i in range(4)] == ["SIMPLE", "MULTI_HOP", "UNCERTAIN", "UNCERTAIN"]
    assert sum(not v2[i].oracle_sufficient for i in range(4)) == 2 and v2[3].ladder_recalls == {"SIMPLE": 0.0, "MULTI_HOP": 0.0, "UNCERTAIN": 0.5}
    q = spark.createDataFrame([("a", "SIMPLE", None, True), ("b", None, "MULTI_HOP", False)], "text string, gold_route string, gold_route_v2 string, oracle_sufficient boolean")
    assert [len(E.training_pairs(q, s).collect()) for s in ("v1", "v2", "v2_sufficient")] == [1, 1, 0]
    stats = {r.label: r.warnings for r in E.label_stats(E.oracle_v1(rows)).collect()}
    assert stats["UNCERTAIN"] == "few_labels,many_insufficient"


def test_md5_heads_are_those_of_the_library():
    for prefix, first, last in ((b"0:", 0, 10), (b"999:", 90, 100), (b"17:", 123456, 123999)):
        assert E.md5_heads(prefix, first, last).tolist() == [int(hashlib.md5(prefix + b"%d" % i).hexdigest()[:8], 16) for i in range(first, last)]


@pytest.mark.parametrize("distinct", [4, 1000])
def test_hashed_bootstrap_against_direct_draws(spark, distinct):
    """Groups of several blocks, a null group, values of few and of many kinds, missing ones left out."""
    rows = [(g, i, None if i % 9 == 0 else float((i * 7919 + n) % distinct) / 4) for n, (g, size) in enumerate((("a", 700), ("b", 131), (None, 1300))) for i in range(size)]
    got = {r.g: (r.n, r.mean, r.lo, r.hi) for r in E.hashed_bootstrap(spark.createDataFrame(rows, "g string, i long, v double"), ["g"], "v", "i", 30, block=250, pieces=7).collect()}
    for g in ("a", "b", None):
        v = np.array([x for k, _, x in rows if k == g and x is not None])
        m = [np.mean([v[int(hashlib.md5(b"%d:%d" % (rep, i)).hexdigest()[:8], 16) % len(v)] for i in range(len(v))]) for rep in range(30)]
        assert got[g] == pytest.approx((len(v), v.mean(), np.percentile(m, 2.5), np.percentile(m, 97.5)))


def test_recall_reads_gold_once(spark):
    from cairn.operators.evaluate import recall_of

    gold = spark.createDataFrame([(1, "a"), (1, "b"), (1, "b"), (2, None), (2, "c")], "query long, item string").mapInPandas(lambda batches: batches, "query long, item string")
    found = spark.createDataFrame([(1, "b"), (1, "b"), (1, "z"), (2, None), (3, "c")], "query long, item string")
    got = recall_of(found, gold, spark.createDataFrame([(1,), (2,), (3,)], "query long"), "item")
    assert {r["query"]: (r.n_gold, r.n_found, r.recall) for r in got.collect()} == {1: (2, 1, 0.5), 2: (2, 0, 0.0), 3: (0, 0, None)}
    assert got._jdf.queryExecution().analyzed().toString().count("MapInPandas") == 1
