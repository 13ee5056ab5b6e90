"""Evaluation analytics over experiment rows.

Missing recalls (no gold) are null throughout and take no part in means, as a NaN would poison them. Result rows have
experiment, id, qtype, recall, cluster, llm_calls, prompt_tokens, completion_tokens, latency_s, escalated, label, route_source, gold_route.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.shared import shared_folder
from .route import LABELS

EPS = 1e-9
REPS, PAIRED_REPS, CLUSTER_REPS, MIN_CLUSTERS, SEED = 1000, 2000, 2000, 5, 0
DRAWS = 4_000_000  # of one piece of the matrix of draws


def set_recall(gold: Column, found: Column) -> Column:
    """Share of the distinct gold ids that were found; null without gold."""
    return F.try_divide(F.size(F.array_intersect(gold, found)), F.size(F.array_distinct(gold)).cast("double"))


def recall_of(retrieved: DataFrame, gold: DataFrame, questions: DataFrame, item: str) -> DataFrame:
    """(query, n_gold, n_found, recall) on distinct ``item`` ids, one row per question, recall null without gold."""
    wanted = gold.select("query", item).distinct()
    found = retrieved.select("query", item).distinct().withColumn("_found", F.lit(1))
    counts = wanted.join(found, ["query", item], "left").groupBy("query").agg(F.count("*").alias("n_gold"), F.count("_found").alias("n_found"))  # gold, a scan, is read once
    joined = questions.select("query").join(counts, "query", "left").na.fill(0, ["n_gold", "n_found"])
    return joined.withColumn("recall", F.try_divide(F.col("n_found"), F.col("n_gold").cast("double")))


def stratified(rows: DataFrame) -> DataFrame:
    """Each experiment over ALL and each question type, from one pass with grouping sets; types without rows don't appear."""
    routed = F.col("label").isin(*LABELS) & ~F.col("route_source").startswith("fixed:") & F.col("gold_route").isNotNull()
    report = rows.groupingSets([[F.col("experiment")], [F.col("experiment"), F.col("qtype")]], "experiment", "qtype").agg(
        F.grouping("qtype").alias("_all"), F.count("*").alias("n"), F.avg("recall").alias("recall"), F.count_distinct(F.when(F.col("recall").isNotNull(), F.col("cluster"))).alias("n_clusters"),
        F.avg("llm_calls").alias("llm_calls"), F.avg(F.col("prompt_tokens") + F.col("completion_tokens")).alias("tokens"),
        F.percentile("latency_s", 0.5).alias("lat_p50"), F.percentile("latency_s", 0.95).alias("lat_p95"),
        F.avg(F.col("escalated").cast("double")).alias("escalated"), F.avg(F.when(routed, (F.col("label") == F.col("gold_route")).cast("double"))).alias("route_acc"),
    )
    return report.withColumn("qtype", F.when(F.col("_all") == 1, "ALL").otherwise(F.col("qtype"))).drop("_all")


def resampled(weights: np.ndarray, counts: np.ndarray, reps: int, seed: int) -> tuple[float, float]:
    """Percentile interval of sum(weights) / sum(counts) when units are drawn with replacement: one matrix of draws becomes a
    matrix of how often each unit is drawn, and both sums are products with it. Plain values are units of count 1."""
    n, draw, means = len(weights), np.random.RandomState(seed), []
    for rows in np.array_split(np.arange(reps), max(1, reps * n // DRAWS)):
        drawn = draw.randint(0, n, (len(rows), n)) + np.arange(len(rows))[:, None] * n
        often = np.bincount(drawn.ravel(), minlength=drawn.size).reshape(drawn.shape)
        means.append(often @ weights / (often @ counts))
    low, high = np.percentile(np.concatenate(means), [2.5, 97.5])
    return float(low), float(high)


def bootstrap_means(values: np.ndarray, reps: int = REPS, seed: int = SEED) -> tuple[float, float, float]:
    """Mean with a percentile interval; one value has no width, none gives NaN."""
    if not len(values):
        return (np.nan,) * 3
    mean = float(values.mean())
    return (mean, *resampled(values, np.ones(len(values)), reps, seed)) if len(values) > 1 else (mean,) * 3


def bootstrap_clusters(sums: np.ndarray, counts: np.ndarray, reps: int = CLUSTER_REPS, seed: int = SEED) -> tuple[float, float, float]:
    """Ratio of sums over resampled clusters; under MIN_CLUSTERS clusters there is a mean but no interval (null in a table)."""
    if not len(sums):
        return (np.nan,) * 3
    mean = float(sums.sum() / counts.sum())
    return (mean, *resampled(sums, counts, reps, seed)) if len(sums) >= MIN_CLUSTERS else (mean, np.nan, np.nan)


def bootstrap(rows: DataFrame, by: list[str], value: str, order: str, reps: int = REPS) -> DataFrame:
    """(by.., n, mean, lo, hi). Resampling is by position, so each group is sorted by ``order`` first. Groups are
    one experiment's questions: a benchmark's size, not the corpus's."""
    schema = rows.select(*by).schema
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema.fields)

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        v = pdf.sort_values(order)[value].dropna().to_numpy(float)
        return pd.DataFrame([(*key, len(v), *bootstrap_means(v, reps))], columns=[*by, "n", "mean", "lo", "hi"])

    return rows.select(*by, value, order).groupBy(*by).applyInPandas(one, f"{kinds}, n long, mean double, lo double, hi double")


def cluster_bootstrap(rows: DataFrame, by: list[str], value: str, cluster: str, order: str, reps: int = CLUSTER_REPS) -> DataFrame:
    """(by.., n_clusters, mean, lo, hi): sums per cluster combine in Spark, only they are resampled, in first-seen order."""
    sums = rows.where(F.col(value).isNotNull()).groupBy(*by, cluster).agg(F.sum(value).alias("s"), F.count("*").alias("c"), F.min(order).alias("seen"))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*by).schema.fields)

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seen")
        return pd.DataFrame([(*key, len(pdf), *bootstrap_clusters(pdf.s.to_numpy(float), pdf.c.to_numpy(float), reps))], columns=[*by, "n_clusters", "mean", "lo", "hi"])

    return sums.groupBy(*by).applyInPandas(one, f"{kinds}, n_clusters long, mean double, lo double, hi double")


def gold_cluster(gold_papers: Column, own_id: Column) -> Column:
    """The cluster of a question: its first gold paper, or itself without any."""
    return F.coalesce(F.get(gold_papers, F.lit(0)).cast("string"), own_id.cast("string"))


def report_rows(rows: DataFrame, questions: DataFrame, order: tuple[str, ...] = ("simple", "multi_hop", "conflicting", "temporal", "chain")) -> DataFrame:
    """The report: ``stratified`` with both intervals (lo, hi by question; clo, chi by cluster) and ``place``, the order of its
    rows: ALL first, then the types in theirs. A question's cluster comes from its gold papers; a result without a question is
    its own cluster."""
    cluster = questions.select("id", gold_cluster(F.col("gold_paper_ids"), F.col("id")).alias("_c"))
    known = rows.drop("cluster").join(cluster, "id", "left").withColumn("cluster", F.coalesce("_c", F.col("id").cast("string"))).drop("_c")
    both = known.withColumn("qtype", F.explode(F.array(F.lit("ALL"), F.col("qtype"))))
    by = ["experiment", "qtype"]
    q = bootstrap(both, by, "recall", "id").select(*by, F.col("lo").alias("recall_lo"), F.col("hi").alias("recall_hi"))
    c = cluster_bootstrap(both, by, "recall", "cluster", "id").select(*by, F.col("lo").alias("recall_clo"), F.col("hi").alias("recall_chi"))
    place = F.array_position(F.array(*[F.lit(t) for t in ("ALL", *order)]), F.col("qtype"))
    return stratified(known).join(q, by, "left").join(c, by, "left").withColumn("place", place)


_SHIFTS = np.repeat([[7, 12, 17, 22], [5, 9, 14, 20], [4, 11, 16, 23], [6, 10, 15, 21]], 4, axis=0).ravel()
_SINES = (np.abs(np.sin(np.arange(1, 65))) * 2**32).astype(np.uint64).astype(np.uint32)
_DRAWN = 1 << 14  # messages hashed at once: their words stay in a core's cache


def md5_heads(prefix: bytes, first: int, last: int) -> np.ndarray:
    """The first 4 bytes, read as one number, of the md5 of ``prefix`` and i in decimal, for i from ``first`` to before ``last``;
    all of them have the same number of digits."""
    i, digits = np.arange(first, last, dtype=np.int64), len(str(first))
    size = len(prefix) + digits
    block = np.zeros((len(i), 64), np.uint8)
    block[:, : len(prefix)] = np.frombuffer(prefix, np.uint8)
    for d in range(digits):
        block[:, size - 1 - d] = i // 10**d % 10 + 48
    block[:, size] = 0x80
    block[:, 56] = size * 8  # messages of one block: under 32 bytes here
    words = [np.ascontiguousarray(w) for w in block.view("<u4").T]
    a, b, c, d = (np.full(len(i), x, np.uint32) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476))
    for n in range(61):  # the last three steps leave the first word as it is
        if n < 16:
            f, g = d ^ (b & (c ^ d)), n
        elif n < 32:
            f, g = c ^ (d & (b ^ c)), (5 * n + 1) % 16
        elif n < 48:
            f, g = b ^ c ^ d, (3 * n + 5) % 16
        else:
            f, g = c ^ (b | ~d), 7 * n % 16
        f = f + a + _SINES[n] + words[g]
        s = int(_SHIFTS[n])
        a, d, c, b = d, c, b, b + ((f << np.uint32(s)) | (f >> np.uint32(32 - s)))
    return (b + np.uint32(0x67452301)).byteswap()


def _packed(values: np.ndarray) -> bytes:
    """Values as codes of one byte beside the distinct ones, where those are few; else as they are."""
    kinds, codes = np.unique(values, return_inverse=True)
    return b"c" + np.uint32(len(kinds)).tobytes() + kinds.tobytes() + codes.astype(np.uint8).tobytes() if len(kinds) <= 256 else b"v" + values.tobytes()


def _unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray | None]:
    """(codes, distinct values), or (values, None)."""
    if blob[:1] == b"v":
        return np.frombuffer(blob, np.float64, offset=1), None
    n = int(np.frombuffer(blob, np.uint32, 1, 1)[0])
    return np.frombuffer(blob, np.uint8, offset=5 + 8 * n), np.frombuffer(blob, np.float64, n, 5)


def _joined(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray | None]:
    """The blocks of one group as one array of codes, or of values."""
    parts = [_unpacked(b) for b in blobs]
    kinds = np.unique(np.concatenate([x if k is None else k for x, k in parts]))
    if len(kinds) > 256:
        return np.concatenate([x if k is None else k[x] for x, k in parts]), None
    return np.concatenate([np.searchsorted(kinds, x if k is None else k)[slice(None) if k is None else x].astype(np.uint8) for x, k in parts]), kinds


def hashed_means(groups: list[tuple[np.ndarray, np.ndarray | None]], rep: int) -> list[float]:
    """The mean of one replicate for each group: position i draws the value at md5('rep:i') modulo the group's size."""
    sums, most, at = [0.0] * len(groups), max(len(x) for x, _ in groups), 0
    while at < most:
        end = min(most, at + _DRAWN, 10 ** len(str(at)))
        heads = md5_heads(b"%d:" % rep, at, end)
        for n, (x, kinds) in enumerate(groups):
            drawn = x[heads[: max(0, len(x) - at)] % np.uint32(len(x))]
            sums[n] += float(drawn.sum()) if kinds is None else float(np.bincount(drawn, minlength=len(kinds)) @ kinds)
        at = end
    return [s / len(x) for s, (x, _) in zip(sums, groups, strict=True)]


def hashed_bootstrap(rows: DataFrame, by: list[str], value: str, order: str, reps: int, block: int = 1 << 20, pieces: int = 100) -> DataFrame:
    """The portable bootstrap: the draw for (replicate, position) comes from md5, so any SQL engine gives the same interval.

    A draw is never a row. Values are packed in blocks of positions (a byte a value where few are distinct, as recalls are); every
    piece of the replicates gets them all and hashes (replicate, position) once for all groups. A task holds a byte (or 8) a row.
    """
    place = W.partitionBy(*by).orderBy(order)
    listed = rows.where(F.col(value).isNotNull()).select(*by, order, F.col(value).cast("double").alias("_v")).withColumn("i", F.row_number().over(place).cast("long") - 1)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*by).schema.fields)

    def pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(*key, len(pdf), float(pdf._v.sum()), _packed(pdf.sort_values("i")._v.to_numpy(float)))], columns=[*by, "part", "n", "s", "data"])

    parts = listed.withColumn("part", F.floor(F.col("i") / block).cast("long")).groupBy(*by, "part").applyInPandas(pack, f"{kinds}, part long, n long, s double, data binary")
    path = shared_folder(rows.sparkSession, "bootstrap")
    parts.write.parquet(path)
    parts = rows.sparkSession.read.parquet(path)
    sizes = parts.groupBy(*by).agg(F.sum("n").alias("n"), (F.sum("s") / F.sum("n")).alias("mean"))
    pieces = min(pieces, reps)

    def draw(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        own = [(k, _joined(list(g.sort_values("part").data))) for k, g in pdf.groupby(by, dropna=False)]
        return pd.DataFrame([(*k, rep, m) for rep in range(key[0], reps, pieces) for (k, _), m in zip(own, hashed_means([x for _, x in own], rep), strict=True)], columns=[*by, "rep", "m"])

    dealt = parts.withColumn("piece", F.explode(F.sequence(F.lit(0), F.lit(pieces - 1)))).repartition(pieces, "piece")
    means = dealt.groupBy("piece").applyInPandas(draw, f"{kinds}, rep int, m double")
    ends = means.groupBy(*by).agg(F.percentile("m", 0.025).alias("lo"), F.percentile("m", 0.975).alias("hi"))
    same = [F.col(f"s.{c}").eqNullSafe(F.col(f"e.{c}")) for c in by]
    return sizes.alias("s").join(ends.alias("e"), same).select(*[f"s.{c}" for c in by], "n", "mean", "lo", "hi")


def paired(rows: DataFrame, reference: str) -> DataFrame:
    """Differences against a reference experiment: (experiment, id, cluster, diff) where both have a recall."""
    base = rows.where(F.col("experiment") == reference).select("id", F.col("recall").alias("base"))
    return rows.where(F.col("experiment") != reference).join(base, "id").withColumn("diff", F.col("recall") - F.col("base"))


def paired_summary(diffs: DataFrame) -> DataFrame:
    return diffs.groupBy("experiment").agg(
        F.count("*").alias("n"), F.avg("diff").alias("mean_diff"), F.count_if(F.col("diff") > 0).alias("wins"), F.count_if(F.col("diff") == 0).alias("ties"),
        F.count_if(F.col("diff") < 0).alias("losses"),
    )


def excludes_zero(lo: Column, hi: Column) -> Column:
    undefined = lo.isNull() | hi.isNull() | F.isnan(lo) | F.isnan(hi)
    return F.when(undefined, "n/a").when((lo > 0) | (hi < 0), "yes").otherwise("no")


def rank_stability(rows: DataFrame, group: str) -> DataFrame:
    """(experiment, mean_1, mean_2, rank_1, rank_2, abs_diff, stable): means of experiments that both groups ran, ranked in each."""
    means = rows.groupBy("experiment").pivot(group, [1, 2]).agg(F.avg("recall")).where(F.col("1").isNotNull() & F.col("2").isNotNull())
    ranks = [F.row_number().over(W.orderBy(F.round(str(g), 9).desc(), "experiment")).alias(f"rank_{g}") for g in (1, 2)]  # a handful of experiments
    out = means.select("experiment", F.col("1").alias("mean_1"), F.col("2").alias("mean_2"), *ranks)
    return out.withColumn("abs_diff", F.abs(F.col("mean_1") - F.col("mean_2"))).withColumn("stable", F.min(F.col("rank_1") == F.col("rank_2")).over(W.partitionBy(F.lit(0))))


def route_rank(label: Column) -> Column:
    """0, 1, 2; a label that is no adaptive one is an error."""
    known = F.coalesce(*[F.when(label == name, F.lit(i)) for i, name in enumerate(LABELS)])
    return F.coalesce(known, F.raise_error(F.lit("diagnostics need an adaptive router")).cast("int"))


def aligned_runs(router: DataFrame, oracle: DataFrame, strong: DataFrame, questions: DataFrame) -> DataFrame:
    """One row per id that all four hold: r_, o_, s_ label, recall, llm_calls, and oracle_sufficient."""
    named = lambda df, p: df.select("id", *[F.col(c).alias(f"{p}_{c}") for c in ("label", "recall", "llm_calls")])
    return named(router, "r").join(named(oracle, "o"), "id").join(named(strong, "s"), "id").join(questions.select("id", "oracle_sufficient"), "id")


def diagnose(runs: DataFrame) -> DataFrame:
    """One row: how a router compares with the oracle and the strongest strategy."""
    r, o = route_rank(F.col("r_label")), route_rank(F.col("o_label"))
    over, under = r > o, r < o
    row = runs.agg(
        F.count("*").alias("n"), F.avg("r_recall").alias("recall"), F.avg("o_recall").alias("recall_oracle"), F.avg("s_recall").alias("recall_strong"),
        F.avg("r_llm_calls").alias("calls"), F.avg("o_llm_calls").alias("calls_oracle"), F.avg("s_llm_calls").alias("calls_strong"),
        F.avg((r == o).cast("double")).alias("exact_route_match"), F.count_if(over).alias("over_routed"),
        F.count_if(over & (F.col("r_recall") <= F.col("o_recall") + EPS)).alias("wasted"), F.count_if(under).alias("under_routed"),
        F.count_if(under & (F.col("r_recall") < F.col("o_recall") - EPS)).alias("harmful"),
        F.avg(F.when(F.col("oracle_sufficient"), (F.col("r_recall") >= 1 - EPS).cast("double"))).alias("sufficient_cover_rate"),
    )
    kept = F.when(F.col("recall_strong") > 0, F.col("recall") / F.col("recall_strong"))
    return row.withColumns({
        "recall_retention_vs_strong": kept, "calls_saved_vs_strong": F.col("calls_strong") - F.col("calls"),
        "regret_recall_vs_oracle": F.col("recall_oracle") - F.col("recall"), "regret_calls_vs_oracle": F.col("calls") - F.col("calls_oracle"),
    })


def confusion(runs: DataFrame) -> DataFrame:
    """Router labels against oracle labels, one column each."""
    return runs.groupBy("r_label").pivot("o_label", list(LABELS)).count().na.fill(0)


def oracle_v1(ladder: DataFrame, min_recall: float = 1.0) -> DataFrame:
    """ladder (id, label, recall) -> cheapest label whose recall suffices, else the last; and whether any did."""
    place = route_rank(F.col("label"))
    enough = F.min_by(F.col("label"), F.when(F.col("recall") >= min_recall, place))
    found = ladder.groupBy("id").agg(F.min(F.when(F.col("recall") >= min_recall, place)).alias("_p"), enough.alias("_l"))
    return found.select("id", F.when(F.col("_p").isNull(), LABELS[-1]).otherwise(F.col("_l")).alias("gold_route"), F.col("_p").isNotNull().alias("oracle_sufficient"))


def oracle_v2(ladder: DataFrame) -> DataFrame:
    """Cheapest label within EPS of the best recall, the ladder's recalls as a map, and whether the best is 1. Ids without recalls are dropped."""
    best = ladder.where(F.col("recall").isNotNull()).withColumn("best", F.max("recall").over(W.partitionBy("id")))
    near = F.when(F.col("recall") >= F.col("best") - EPS, route_rank(F.col("label")))
    return best.groupBy("id").agg(
        F.min_by("label", near).alias("gold_route_v2"), F.first("best").alias("best_recall"), (F.first("best") >= 1 - EPS).alias("oracle_sufficient"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("label", "recall")))).alias("ladder_recalls"),
    )


def training_pairs(questions: DataFrame, scheme: str) -> DataFrame:
    """(text, label) by scheme v1, v2 or v2_sufficient; questions without a label are dropped."""
    label = F.col("gold_route" if scheme == "v1" else "gold_route_v2")
    rows = questions.where("oracle_sufficient") if scheme == "v2_sufficient" else questions
    return rows.where(label.isNotNull() & (label != "")).select("text", label.alias("label"))


def label_stats(questions: DataFrame, label: str = "gold_route") -> DataFrame:
    """Counts and shares of labels, with the warnings a trainer wants: few rows, rare class, many insufficient."""
    counts = questions.groupBy(label).agg(F.count("*").alias("n"), F.count_if(~F.col("oracle_sufficient")).alias("insufficient"))
    everything = W.partitionBy(F.lit(0))
    total, bad = F.sum("n").over(everything), F.sum("insufficient").over(everything)
    warn = F.filter(F.array(F.when(total < 150, "few_labels"), F.when(F.col("n") < 0.1 * total, "rare_class"), F.when(bad > 0.25 * total, "many_insufficient")), lambda x: x.isNotNull())
    return counts.select(F.col(label).alias("label"), "n", (F.col("n") / total).alias("share"), F.array_join(warn, ",").alias("warnings"))
