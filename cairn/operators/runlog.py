"""Analytics of generation runs and model calls: yield, budgets, accounting, retry schedules.

A run has run_no, outcomes map<string,bigint>, llm map<string,bigint>, stop_reason, model, judge_model. A call has query,
call_no, cache_hit, prompt_tokens, completion_tokens.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import json_text

# Waiting and retry limits in seconds.
MAX_HINT_WAIT, DEFAULT_WAIT, EXTRA_WAIT = 30.0, 10.0, 0.5
COOLDOWN_BASE, COOLDOWN_CAP = 30.0, 900.0
NOT_REJECTIONS = ("passed", "generator_returned_none")


def _count(of: str, key: str) -> Column:
    return F.coalesce(F.try_element_at(F.col(of), F.lit(key)), F.lit(0))


def provider_tokens() -> Column:
    """Provider-counted tokens of a run."""
    return _count("llm", "provider_prompt_tokens") + _count("llm", "provider_completion_tokens")


def spent_tokens() -> Column:
    """Tokens of a run that count against a budget; the generic counters stand in where it has none of the provider's."""
    get = lambda k: F.try_element_at(F.col("llm"), F.lit(k))
    part = lambda k: F.greatest(F.coalesce(get(f"provider_{k}"), get(k), F.lit(0)), F.lit(0))
    return part("prompt_tokens") + part("completion_tokens")


def run_yield(runs: DataFrame) -> DataFrame:
    """(run_no, qtype, attempts, survived, survival_rate): from outcome keys ``attempt:T`` and ``survived:T``; rate to 3 digits, null on 0."""
    counts = runs.select("run_no", F.explode("outcomes").alias("key", "n")).where(F.col("key").rlike("^(attempt|survived):"))
    split = counts.select("run_no", F.substring_index("key", ":", 1).alias("kind"), F.expr("substring(key, instr(key, ':') + 1)").alias("qtype"), "n")
    wide = split.groupBy("run_no", "qtype").agg(
        F.coalesce(F.sum(F.when(F.col("kind") == "attempt", F.col("n"))), F.lit(0)).alias("attempts"), F.coalesce(F.sum(F.when(F.col("kind") == "survived", F.col("n"))), F.lit(0)).alias("survived"),
        F.bool_or(F.col("kind") == "attempt").alias("tried"),
    )
    return wide.where("tried").drop("tried").withColumn("survival_rate", F.bround(F.try_divide(F.col("survived"), F.col("attempts").cast("double")), 3))


def rejections(runs: DataFrame, top: int = 8) -> DataFrame:
    """(run_no, rank, reason, n): each run's most frequent outcomes that are neither counts by type nor passes."""
    counts = runs.select("run_no", F.explode("outcomes").alias("reason", "n"))
    only = counts.where(~F.col("reason").rlike("^(attempt|survived):") & ~F.col("reason").isin(*NOT_REJECTIONS))
    return only.withColumn("rank", F.row_number().over(W.partitionBy("run_no").orderBy(F.desc("n"), "reason"))).where(F.col("rank") <= top)


def last_run(runs: DataFrame) -> DataFrame:
    return runs.agg(F.max_by(F.struct(*runs.columns), "run_no").alias("r")).select("r.*")


def pilot_summary(runs: DataFrame, questions: DataFrame) -> DataFrame:
    """One row over all runs and the questions saved."""
    r = runs.agg(
        F.count("*").alias("runs"), F.sum(provider_tokens()).alias("provider_tokens_total"), F.sum(_count("llm", "provider_calls")).alias("provider_calls_total"),
        F.sum(_count("llm", "cache_hits")).alias("cache_hits_total"), F.sum(_count("llm", "rate_limit_errors")).alias("rate_limit_errors_total"),
        F.count_if(F.col("stop_reason") == "rate_limited").alias("runs_stopped_by_rate_limit"), F.count_if(F.col("stop_reason") == "token_budget").alias("runs_stopped_by_token_budget"),
    )
    named = lambda c: F.array_join(F.array_sort(F.collect_set(F.when(F.col(c) != "", F.col(c)))), ",")
    r = r.crossJoin(runs.agg(named("model").alias("generator_models"), named("judge_model").alias("judge_models")))
    judge = F.from_json("validation", "judge_model string")["judge_model"]
    q = questions.agg(F.count("*").alias("saved_total"), F.count_if(F.coalesce(judge, F.lit("")) == "").alias("saved_without_judge_model"))
    types = questions.groupBy("qtype").agg(F.count("*").alias("n")).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("qtype", "n")))).alias("saved_per_type"))  # a row a type
    p = questions.select(F.explode("gold_paper_ids").alias("p")).agg(F.count_distinct("p").alias("distinct_gold_papers"))
    each = F.bround(F.try_divide(F.col("provider_tokens_total"), F.col("saved_total").cast("double")), 0).cast("long")
    return r.crossJoin(q).crossJoin(types).crossJoin(p).withColumn("tokens_per_saved_candidate", each)  # one-row tables


def run_summary(runs: DataFrame) -> DataFrame:
    """(run_no, total_survivors, provider_tokens, tokens_per_survivor and what the run noted): survivors of the types it tried."""
    survived = run_yield(runs).groupBy("run_no").agg(F.sum("survived").alias("n"))
    met = runs.withColumn("provider_tokens", provider_tokens()).join(survived, "run_no", "left").withColumn("total_survivors", F.coalesce("n", F.lit(0)))
    each = F.bround(F.try_divide(F.col("provider_tokens"), F.col("total_survivors").cast("double")), 0).cast("long")
    noted = lambda k: F.try_element_at(F.col("llm"), F.lit(k)).alias(k)
    return met.select("run_no", "total_survivors", "provider_tokens", noted("provider_calls"), noted("rate_limit_errors"), each.alias("tokens_per_survivor"), "stop_reason", "judge_model", "model")


def request_key(model: Column, messages: Column, temperature: Column, max_tokens: Column, effort: Column | None = None, headroom: Column | None = None) -> Column:
    """The cache key of a request: sha256 of its fields as a JSON list, messages (role, content) with sorted keys, ASCII only."""
    quoted = lambda c: F.when(c.isNull(), "null").otherwise(json_text(c))
    plain = lambda c: F.coalesce(c.cast("string"), F.lit("null"))
    none = F.lit(None).cast("string")
    said = F.array_join(F.transform(messages, lambda m: F.concat(F.lit('{"content": '), quoted(m["content"]), F.lit(', "role": '), quoted(m["role"]), F.lit("}"))), ", ")
    parts = [quoted(model), F.concat(F.lit("["), said, F.lit("]")), plain(temperature.cast("double")), plain(max_tokens), quoted(none if effort is None else effort), plain(none if headroom is None else headroom)]
    return F.sha2(F.concat(F.lit("["), F.concat_ws(", ", *parts), F.lit("]")).cast("binary"), 256)


def budget(runs: DataFrame, limit: int) -> DataFrame:
    """(run_no, tokens, cumulative, over): running token use against a limit; 0 or less is no limit."""
    line = W.orderBy("run_no").rowsBetween(W.unboundedPreceding, 0)  # a log of runs, not of documents
    spent = runs.select("run_no", spent_tokens().alias("tokens")).withColumn("cumulative", F.sum("tokens").over(line))
    return spent.withColumn("over", F.lit(limit > 0) & (F.col("cumulative") >= limit))


def pending(existing: DataFrame, targets: DataFrame) -> DataFrame:
    """(qtype, have, target, missing): candidates and accepted questions against what is wanted."""
    have = existing.where(F.coalesce("status", F.lit("candidate")).isin("candidate", "accepted")).groupBy("qtype").agg(F.count("*").alias("have"))
    met = targets.join(have, "qtype", "left").select("qtype", F.coalesce("have", F.lit(0)).alias("have"), "target")
    return met.withColumn("missing", F.greatest(F.col("target") - F.col("have"), F.lit(0)))


def call_accounting(calls: DataFrame) -> DataFrame:
    """(query, logical and provider calls and tokens): cache hits count as logical calls only."""
    real = ~F.col("cache_hit")
    return calls.groupBy("query").agg(
        F.count("*").alias("calls"), F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"), F.count_if(real).alias("provider_calls"),
        F.coalesce(F.sum(F.when(real, F.col("prompt_tokens") + F.col("completion_tokens"))), F.lit(0)).alias("provider_tokens"),
    )


def counter_deltas(counters: DataFrame) -> DataFrame:
    """counters (stream, seq, calls, tokens), monotone -> what each step added."""
    line = W.partitionBy("stream").orderBy("seq")
    added = lambda c: F.col(c) - F.coalesce(F.lag(c).over(line), F.lit(0))
    return counters.select("stream", "seq", added("calls").alias("calls"), added("tokens").alias("tokens"))


def usable_cache(entries: DataFrame) -> DataFrame:
    """Cache entries with text and counts that can be true; the rest counts as corrupt."""
    return entries.withColumn("usable", (F.trim(F.coalesce("text", F.lit(""))) != "") & (F.col("prompt_tokens") >= 0) & (F.col("completion_tokens") >= 0))


def read_through(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """requests (key, ..) with the cached text, and whether it was a hit; corrupt entries miss."""
    good = usable_cache(cache).where("usable").select("key", F.col("text").alias("cached"))
    return requests.join(good, "key", "left").withColumn("cache_hit", F.col("cached").isNotNull())


def retry_delay(attempt: Column, hint: Column, base: float = 1.0, most: float = 8.0) -> Column:
    """Seconds before the next try: the provider's hint if it is short enough, doubling otherwise; null is to stop."""
    return F.when(hint > MAX_HINT_WAIT, F.lit(None).cast("double")).when(hint.isNotNull(), hint + EXTRA_WAIT).otherwise(F.least(base * F.pow(F.lit(2.0), attempt), F.lit(most)))


def batch_wait(hint: Column) -> Column:
    """Seconds a batch waits out a limit; null where the hint is too long to wait."""
    return F.when(hint > MAX_HINT_WAIT, F.lit(None).cast("double")).otherwise(F.coalesce(hint, F.lit(DEFAULT_WAIT)) + EXTRA_WAIT)


def cooldown(n: Column, hint: Column) -> Column:
    """Seconds between batches: hint rounded up plus two, or doubling up to a cap."""
    return F.coalesce(F.ceil(hint).cast("double") + 2.0, F.least(COOLDOWN_BASE * F.pow(F.lit(2.0), n), F.lit(COOLDOWN_CAP)))
