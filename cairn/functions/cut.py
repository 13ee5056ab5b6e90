"""Tokens cut in Python's workers, character by character of a table, exactly as ``text.tokens`` cuts them in Spark."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from .text import WORD, tokens

POINTS, PIECE = 0x110000, 1 << 22  # code points there are, and bytes that are cut at once


@dataclass(frozen=True)
class Cutter:
    """``packed``: what each code point is in a token, blank for those of none. ``special``: characters whose lower case is several or hangs on
    their neighbours; texts that hold one are left to Spark."""

    packed: bytes
    special: tuple[str, ...]

    def columns(self, text: Column) -> list[Column]:
        """What ``cut`` takes of a text: its bytes (``raw``), or for the few with a special character its tokens (``words``)."""
        left = reduce(lambda a, b: a | b, (F.contains(text, F.lit(c)) for c in self.special), F.lit(False))
        return [F.when(~left, text.cast("binary")).alias("raw"), F.when(left, F.array_join(tokens(text), " ")).alias("words")]

    def cut(self, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows with ``raw`` and ``words`` -> with ``words`` alone, the tokens with blanks between ("" for none), in pieces of some PIECE bytes."""
        table = _unpacked(self.packed)
        for pdf in batches:
            ends = np.cumsum([len(t) if t is not None else 0 for t in pdf.raw])
            lo = 0
            while lo < len(pdf):
                hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + PIECE, "right")))
                part = pdf.iloc[lo:hi]
                # rows are parted by zero bytes, which are no part of a token
                joined = b"\0".join((t or b"").replace(b"\0", b" ") for t in part.raw).decode("utf-8", "replace").encode("utf-32-le")
                listed = table.take(np.frombuffer(joined, "<u4")).tobytes().decode("utf-32-le").split("\n")
                yield part.drop(columns="raw").assign(words=[w if own is None else own for w, own in zip(listed, part.words, strict=True)])
                lo = hi


def _packed(table: np.ndarray) -> bytes:
    return zlib.compress(np.diff(table.astype("<u4"), prepend=np.zeros(1, "<u4")).tobytes())


def _unpacked(packed: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zlib.decompress(packed), "<u4"), dtype=np.uint32).astype("<u4")


_CUTTERS: dict[str, Cutter] = {}


def cutter(spark: SparkSession) -> Cutter:
    """The table is asked of Spark once a session: each code point by itself, behind, before and between letters."""
    key = spark.sparkContext.applicationId
    if key not in _CUTTERS:
        c = F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32").alias("c")
        a, s, low = F.lit("a"), F.lit(" "), F.lower("c")
        met = F.array(low, F.concat(a, low), F.concat(low, a), F.concat(a, low, a))
        every = spark.range(POINTS).where("id not between 55296 and 57343 and id <> 65279").select("id", c)  # but surrogates and the mark that decoding drops
        every = every.where((low != F.col("c")) | low.rlike(WORD))
        every = every.select("id", low.alias("low"), met.alias("met"), tokens(F.concat("c", s, a, "c", s, "c", a, s, a, "c", a)).alias("ts"))
        plain = (F.length("low") == 1) & (F.col("ts") == F.col("met"))
        rows = every.where(F.col("ts") != F.array(a, a, a, a)).select("id", F.ascii("low").alias("low"), plain.alias("plain")).toArrow()  # Row by Row it takes more of the driver
        ids, low, plain = (rows[n].to_numpy() for n in ("id", "low", "plain"))
        table = np.full(POINTS, ord(" "), np.uint32)
        table[ids[plain]] = low[plain]
        table[0] = ord("\n")
        _CUTTERS[key] = Cutter(_packed(table), tuple(map(chr, ids[~plain].tolist())))
    return _CUTTERS[key]
