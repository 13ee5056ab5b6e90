"""Routers: a question becomes a strategy label with confidence and source. All are column expressions or lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import SPACE, collapsed, greedy_array, greedy_object

LABELS = ("SIMPLE", "MULTI_HOP", "UNCERTAIN")

# The strategy table (label, hybrid, rerank, decompose, final k) and retrieval depths.
STRATEGIES = (
    ("VANILLA", False, False, False, 5),
    ("SIMPLE", False, False, False, 5),
    ("STATIC", True, True, False, 8),
    ("MULTI_HOP", True, True, True, 8),
    ("UNCERTAIN", True, True, True, 10),
    ("STATIC_K10", True, True, False, 10),
)
DENSE_K, BM25_K = 20, 20
ESCALATE_BELOW = 0.7

# Words that hint at a comparison across papers; stems need a word boundary behind them.
HINTS = (
    r"(?i)\b(compare|contrast|versus|vs\.?|across|differ|disagree|conflict|consistent with|both|relationship between"
    r"|agree|evolv|over time|which (?:paper|study)|papers|studies)\b"
)

# Experiment codes with router and whether it escalates.
EXPERIMENTS = (
    ("A", "vanilla", False), ("B", "static", False), ("C", "llm", False), ("D", "compass", True), ("E", "oracle", False),
    ("E2", "oracle", False), ("F", "strongest", False), ("G", "multihop", False), ("K", "static_k10", False), ("H", "heuristic", True),
)
FIXED = {"vanilla": "VANILLA", "static": "STATIC", "strongest": "UNCERTAIN", "multihop": "MULTI_HOP", "static_k10": "STATIC_K10"}


def strategies(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(STRATEGIES), "label string, use_hybrid boolean, rerank boolean, decompose boolean, final_k int")


def decision(label: Column, confidence: Column, source: Column, escalated: Column | None = None) -> Column:
    return F.struct(label.alias("label"), confidence.cast("double").alias("confidence"), source.alias("source"), (escalated if escalated is not None else F.lit(False)).alias("escalated"))


def fixed(label: str) -> Column:
    return decision(F.lit(label), F.lit(1.0), F.lit(f"fixed:{label}"))


def heuristic(question: Column) -> Column:
    """Two hints or more: several hops, sure; one: several hops, unsure; none: simple."""
    hits = F.regexp_count(question, F.lit(HINTS))
    label = F.when(hits >= 1, "MULTI_HOP").otherwise("SIMPLE")
    confidence = F.when(hits >= 2, 0.8).when(hits == 1, 0.55).otherwise(0.7)
    return decision(label, confidence, F.lit("heuristic"))


def llm_reply(reply: Column, source: str = "llm") -> Column:
    """Reads a model's JSON reply: a label in any case, and a confidence that is 0 where it isn't given. Anything but a known
    label with a finite confidence (null is none) is an uncertain parse failure."""
    text = greedy_object(reply)
    read = F.from_json(text, "label string, confidence string")
    given = F.array_contains(F.json_object_keys(text), "confidence")
    label = F.upper(read["label"])
    confidence = F.when(given, read["confidence"].try_cast("double")).otherwise(F.lit(0.0))
    finite = confidence.isNotNull() & ~F.isnan(confidence) & (F.abs(confidence) != float("inf"))
    good = F.coalesce(label.isin(*LABELS) & finite, F.lit(False))
    return F.when(good, decision(label, F.least(F.greatest(confidence, F.lit(0.0)), F.lit(1.0)), F.lit(source))).otherwise(
        decision(F.lit("UNCERTAIN"), F.lit(0.0), F.lit(f"{source}:parse_fail"))
    )


def oracle(questions: DataFrame, known: DataFrame) -> DataFrame:
    """Lookup by normalised question text in known (question, label); a miss is an error when it is read."""
    keys = known.select(collapsed(F.col("question")).alias("key"), F.col("label").alias("known"))
    met = questions.withColumn("key", collapsed(F.col("text"))).join(keys, "key", "left").drop("key")
    label = F.when(F.col("known").isNull(), F.raise_error(F.lit("no oracle label for a question")).cast("string")).otherwise(F.col("known"))
    return met.withColumn("route", decision(label, F.lit(1.0), F.lit("oracle"))).drop("known")


def escalating(first: Column, fallback: Column, threshold: float = ESCALATE_BELOW) -> Column:
    """The first decision where it is sure enough, else the fallback's, marked as escalated and naming both sources."""
    other = decision(fallback["label"], fallback["confidence"], F.concat(fallback["source"], F.lit(" (escalated from "), first["source"], F.lit(")")), F.lit(True))
    return F.when(first["confidence"] >= threshold, first).otherwise(other)


def experiments(spark: SparkSession) -> DataFrame:
    """(code, router, label of a fixed router, escalates)."""
    rows = [(code, router, FIXED.get(router), escalates) for code, router, escalates in EXPERIMENTS]
    return spark.createDataFrame(rows, "code string, router string, fixed_label string, escalates boolean")


def routed(questions: DataFrame, router: str, replies: DataFrame | None = None, known: DataFrame | None = None) -> DataFrame:
    """questions (query, text) with the ``route`` of a router by name. Fixed and heuristic ones need the question alone, ``llm``
    the model's replies (query, reply; a missing one is a parse failure), ``oracle`` the known labels (question, label); a
    name that is unknown, untrained or lacks what it needs is an error."""
    if router in FIXED:
        return questions.withColumn("route", fixed(FIXED[router]))
    if router == "heuristic":
        return questions.withColumn("route", heuristic(F.col("text")))
    if router == "llm" and replies is not None:
        met = questions.join(replies.select("query", "reply"), "query", "left")
        return met.withColumn("route", llm_reply(F.coalesce("reply", F.lit("")))).drop("reply")
    if router == "oracle" and known is not None:
        return oracle(questions, known)
    raise ValueError(f"router {router!r} is unknown, or what it needs is missing")


def experiment(questions: DataFrame, code: str, replies: DataFrame | None = None, known: DataFrame | None = None) -> DataFrame:
    """questions with the route of an experiment's code; those that escalate fall back to the strongest strategy when unsure."""
    router, escalates = next(((r, e) for c, r, e in EXPERIMENTS if c == code), (None, False))
    if router is None:
        raise ValueError(f"experiment {code!r} is unknown")
    out = routed(questions, router, replies, known)
    return out.withColumn("route", escalating(F.col("route"), fixed(FIXED["strongest"]))) if escalates else out


def decomposed(reply: Column, question: Column) -> Column:
    """Sub-questions of a model's reply: the non-blank texts of its JSON array, at most three; the question alone without any."""
    items = F.from_json(greedy_array(reply), "array<variant>")
    texts = F.transform(F.filter(items, lambda x: F.schema_of_variant(x) == "STRING"), lambda x: F.try_variant_get(x, "$", "string"))
    kept = F.slice(F.filter(texts, lambda t: F.regexp_replace(t, SPACE, "") != ""), 1, 3)
    return F.when(F.size(F.coalesce(kept, F.array().cast("array<string>"))) > 0, kept).otherwise(F.array(question))
