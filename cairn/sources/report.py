"""Markdown reports of small result tables (a row for each experiment and type)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cell(value: object, digits: int = 2) -> str:
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "-"
    return f"{value:.{digits}f}" if isinstance(value, float) else str(value)


def markdown(df: DataFrame, order: list[str | Column]) -> str:
    """A table with the frame's columns as heads; for results that a person reads."""
    rows = df.orderBy(*order).collect()
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(cell(v) for v in r) + " |" for r in rows])


def interval(lo: Column, hi: Column) -> Column:
    """'[0.10, 0.20]', or n/a without an interval."""
    two = lambda c: F.format_string("%.2f", c)
    none = lo.isNull() | hi.isNull() | F.isnan(lo) | F.isnan(hi)
    return F.when(none, "n/a").otherwise(F.concat(F.lit("["), two(lo), F.lit(", "), two(hi), F.lit("]")))


def type_order(qtype: Column, order: tuple[str, ...] = ("ALL", "simple", "multi_hop", "conflicting", "temporal", "chain")) -> Column:
    return F.coalesce(*[F.when(qtype == t, F.lit(i)) for i, t in enumerate(order)], F.lit(len(order)))
