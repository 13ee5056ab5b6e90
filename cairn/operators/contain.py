"""Chunks that hold a passage, character by character: one scan of the texts for all passages."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ANCHOR, BITS, PIECE = 8, 20, 1 << 22  # bytes of a passage that are looked for first, of the table of their hashes, and bytes searched at once
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def _spot(grams: np.ndarray) -> np.ndarray:
    return (grams * _FACTOR) >> np.uint64(64 - BITS)


def _grams(data: bytes) -> np.ndarray:
    """The ANCHOR bytes from each position on as one number."""
    return np.ndarray(max(0, len(data) - ANCHOR + 1), "<u8", data, strides=(1,)) if len(data) >= ANCHOR else np.empty(0, "<u8")


def _search(passages: dict[bytes, list[int]]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """A task's scan of (chunk_idx, paper_id, raw). A passage is looked for by ANCHOR of its bytes, those that differ most, and compared where
    they are met, so a chunk that holds it anywhere is found; shorter passages are looked for in every text."""
    anchors: dict[int, list[tuple[bytes, int]]] = {}
    for p in passages:
        if len(p) >= ANCHOR:
            at = max(range(len(p) - ANCHOR + 1), key=lambda i: len(set(p[i : i + ANCHOR])))
            anchors.setdefault(int.from_bytes(p[at : at + ANCHOR], "little"), []).append((p, at))
    short = [p for p in passages if len(p) < ANCHOR]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = np.zeros(1 << BITS, bool)
        table[_spot(np.array(list(anchors), "<u8"))] = True
        for pdf in batches:
            ends = np.cumsum([len(t) for t in pdf.raw])
            lo = 0
            while lo < len(pdf):
                begin = int(ends[lo - 1]) if lo else 0
                hi = max(lo + 1, int(np.searchsorted(ends, begin + PIECE, "right")))
                data, own = b"".join(pdf.raw[lo:hi]), ends[lo:hi] - begin
                found = {(row, p) for row, text in enumerate(pdf.raw[lo:hi]) for p in short if p in text}
                for start in range(0, len(data), PIECE):  # a text may be longer
                    grams = _grams(data[start : start + PIECE + ANCHOR - 1])
                    hits = np.flatnonzero(table[_spot(grams)])
                    for pos, gram in zip((hits + start).tolist(), grams[hits].tolist(), strict=True):
                        for p, at in anchors.get(gram, ()):
                            if data.startswith(p, max(pos - at, 0)) and pos >= at:
                                row = int(np.searchsorted(own, pos, "right"))
                                if pos - at >= (own[row - 1] if row else 0) and pos - at + len(p) <= own[row]:
                                    found.add((row, p))
                rows = [(q, pdf.chunk_idx.iloc[lo + row], pdf.paper_id.iloc[lo + row]) for row, p in found for q in passages[p]]
                yield pd.DataFrame(rows, columns=["query", "chunk_idx", "paper_id"]).astype({"paper_id": object})
                lo = hi

    return run


def holders(chunks: DataFrame, asked: DataFrame) -> DataFrame:
    """chunks (chunk_idx, paper_id, text), asked (query, text) -> (query, chunk_idx, paper_id): each chunk whose text holds the asked text, as it is
    spelled; no text is held by none, an empty one by all. Passages, as many as people ask, go to the chunks."""
    passages: dict[bytes, list[int]] = {}
    for r in asked.where("text is not null").select("query", F.col("text").cast("binary").alias("p")).distinct().collect():
        passages.setdefault(bytes(r.p), []).append(r["query"])
    raw = chunks.where("text is not null").select("chunk_idx", "paper_id", F.col("text").cast("binary").alias("raw"))
    return raw.mapInPandas(_search(passages), "query long, chunk_idx long, paper_id string")
