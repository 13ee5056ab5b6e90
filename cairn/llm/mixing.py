"""Mixing sources to target weights by systematic sampling.

Every document of a source expects ``target / source_size`` copies. Documents are laid in a line by
(size, id), the expected copies are prefix-summed within the source, one random offset is added, and a copy is
emitted for each integer boundary that a document's stretch crosses. Ordering by size stratifies the sample, so
the words taken stay within about one document of the target.

Scale: one range shuffle on (source, size, id), so a source with a third of all rows spreads over a third of the
partitions; positions come from the sorted partitions, and only (partition, source) counts are summed by a window.

Edge cases: null text has size 0; a null source is a source of its own, ordered last; a source without words gets
target 0 and no copies; repeated rows each hold their own place in line; an empty table gives an empty result. Fixed-point
products are exact for sources of up to 2^34 rows at two copies a row; more rows need fewer ``FRACTION_BITS``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD_CLASS, Scratch, text_or_empty

#: Expected copies are kept in fixed point with so many binary digits, so that prefix sums are exact.
FRACTION_BITS = 28


def word_targets(totals: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, max_copies: int = 2) -> DataFrame:
    """(source, source_size) -> plus target: weights dealt to sources in code point order (null last), repeating.

    The total is ``share`` of all sizes; no target passes ``max_copies`` times its source's size, and the excess is
    shared out again by weight. That fixed point is a water level: sources are filled in the order of cap over
    weight, and the level is the first that leaves all later ones below their caps.
    """
    n = len(weights)
    place = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_place") % n + 1).cast("int"))
    ranked = (
        totals.withColumn("_place", place).withColumn("_w", weight)
        .withColumn("_cap", (F.col("source_size") * max_copies).cast("double"))
    )
    filled = W.orderBy(F.col("_cap") / F.col("_w"), "_place").rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy(F.lit(0))
    levels = (
        ranked.withColumn("_total", F.sum("source_size").over(everything) * F.lit(float(share)))
        .withColumn("_cap_before", F.coalesce(F.sum("_cap").over(filled), F.lit(0.0)))
        .withColumn("_w_left", F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(filled), F.lit(0.0)))
        .withColumn("_level", (F.col("_total") - F.col("_cap_before")) / F.col("_w_left"))
        .withColumn("_fits", F.col("_level") * F.col("_w") <= F.col("_cap"))
    )
    water = F.min(F.when(F.col("_fits"), F.struct(F.col("_cap") / F.col("_w"), F.col("_place"), F.col("_level")))).over(everything)
    target = F.coalesce(F.least(F.col("_cap"), F.col("_water._level") * F.col("_w")), F.col("_cap"))
    return levels.withColumn("_water", water).select("source", "source_size", target.alias("target"))


def mix_sources(docs: DataFrame, keep: Sequence[str], weights: Sequence[float] = (3, 1, 2), share: float = 1.5,
                max_copies: int = 2, seed: str = "mix", id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """One row per document: the ``keep`` columns (as struct ``doc``), source, size, source_size, target, copies, taken.

    The same input and seed give the same copies, however the rows are partitioned.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "mix")
    size = F.regexp_count(text_or_empty(text_col), F.lit(WORD_CLASS)).cast("long")
    rows = docs.select(
        F.struct(*[F.col(c) for c in keep]).alias("doc"), F.col(id_col).alias("id"),
        F.col(source_col).cast("string").alias("source"), size.alias("size"),
    )
    order = ["source", "size", "id"]
    lined = scratch.save(
        rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("seq", F.monotonically_increasing_id()), "lined"
    ).withColumn("part", F.shiftright("seq", 33))

    totals = lined.groupBy("source").agg(F.sum("size").alias("source_size"))
    runs = lined.groupBy("part", "source").agg(F.min("seq").alias("first"), F.count("*").alias("n"))
    before = W.partitionBy("source").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    runs = runs.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    one = F.lit(float(1 << FRACTION_BITS))
    step = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") * one)).otherwise(F.lit(0))
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce("source", F.lit("")))), 1, 7), 16, 10).cast("long")
    goals = word_targets(totals, weights, share, max_copies).withColumn("step", step.cast("long")).withColumn("offset", offset)
    plan = runs.alias("r").join(goals.alias("g"), F.col("r.source").eqNullSafe(F.col("g.source"))).select(
        "r.part", F.col("r.source").alias("run_source"), "r.first", "r.before", "g.source_size", "g.target", "g.step", "g.offset"
    )
    placed = lined.alias("d").join(plan.alias("p"), (F.col("d.part") == F.col("p.part")) & F.col("d.source").eqNullSafe(F.col("p.run_source")))
    nth = F.col("before") + F.col("seq") - F.col("first")
    crossed = F.shiftright((nth + 1) * F.col("step") + F.col("offset"), FRACTION_BITS) - F.shiftright(nth * F.col("step") + F.col("offset"), FRACTION_BITS)
    return placed.select(
        "doc", "id", "d.source", "size", "source_size", "target", crossed.alias("copies"), (crossed * F.col("size")).alias("taken")
    )


def emit_mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus itself: each row of ``docs`` as often as its copies say, with its own columns only."""
    mixed = mix_sources(docs, keep=docs.columns, **options).where("copies > 0")
    repeated = mixed.select("doc", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
    return repeated.select(*[F.col("doc").getField(c).alias(c) for c in docs.columns])
