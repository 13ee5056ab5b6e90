"""Best-fit packing by bin completion with branch and bound.

Documents of equal length are interchangeable, so the search runs over the histogram of lengths (at most ``capacity``
entries, whatever the input): it takes the largest remaining length, enumerates all undominated fillings around it, and each
number of times that the counts allow. Waste bounds prune: a branch ends when its bins plus the least number of bins for the
rest reach the incumbent. The first incumbent is best-fit decreasing. ``NODES`` alone bounds the effort: where it ends the
search the incumbent, a whole and valid packing, stays as good as proven so far.

Ids are those of the vocabulary file for the ``tokenizers`` library; texts without a special token's string are encoded by a
faster implementation of the same merges, which tests hold against that library.

Documents over the capacity are cut into full pieces; the first piece takes the remainder and joins the search.

Scale: tokens are made in one pass that writes a narrow piece table; ranks within a length come from a range
shuffle; the plan (runs of equal bins, bounded by capacity squared) goes to the tasks as a broadcast value.

Edge cases: null text is the empty text (one end id); ties of length are placed by id and piece; repeated rows are
packed each for itself; a null id is packed last of its length; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, text_or_empty

CAPACITY = 2048
NODES, OPEN_FRAMES = 4_000, 32
END_ID = 0

# --- tokens ---------------------------------------------------------------------------------------------------


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies: printable bytes stand for themselves, the rest follow from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBpe:
    """Ids of a byte-level BPE vocabulary file. Texts that hold a special token's string go to the file's own
    library; all others to a faster implementation of the same merges (rank order is id order), checked by tests."""

    def __init__(self, vocabulary: str):
        import tiktoken
        from public_tokenizers import PATTERN
        from tokenizers import Tokenizer

        with open(vocabulary, encoding="utf-8") as f:
            described = json.load(f)
        self.special = [t["content"] for t in described.get("added_tokens", [])]
        alphabet = byte_alphabet()
        ranks = {bytes(alphabet[c] for c in token): i for token, i in described["model"]["vocab"].items() if token not in set(self.special)}
        self.fast = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.slow = Tokenizer.from_file(vocabulary)

    def __call__(self, text: str) -> list[int]:
        if any(s in text for s in self.special):
            return self.slow.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


def pieces_of(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: only the first may be short of the capacity."""
    if n <= capacity:
        return [(0, n)]
    head = n % capacity
    return ([(0, head)] if head else []) + [(s, capacity) for s in range(head, n, capacity)]


def piece_table(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, crc) of every document's ids with the end id behind them."""

    def compute(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = ByteBpe(vocabulary)
        for pdf in batches:
            out = []
            for doc, text in zip(pdf.id, pdf.text, strict=True):
                ids = np.array(encode(text) + [END_ID], "<u4")
                out += [(doc, k, s, n, zlib.crc32(ids[s : s + n].tobytes())) for k, (s, n) in enumerate(pieces_of(len(ids), capacity))]
            yield pd.DataFrame(out, columns=["id", "piece", "start", "length", "crc"])

    rows = docs.select(F.col(id_col).cast("string").alias("id"), text_or_empty(text_col).alias("text"))  # a null among numbers would make pandas round them
    return rows.mapInPandas(compute, "id string, piece int, start long, length long, crc long").withColumn("id", F.col("id").cast("long"))


# --- the search over the histogram ----------------------------------------------------------------------------


def fillings(room: int, counts: np.ndarray) -> Iterator[tuple[int, ...] | None]:
    """The undominated fillings of ``room`` out of ``counts`` (by length), one after another: by rising waste, then with the larger
    pieces first; None for each dominated one that is passed over, so that the search can count its effort. Sums that the smaller lengths can reach are kept as bits, so that no step leads to a dead end."""
    lengths = [int(n) for n in np.flatnonzero(counts[: room + 1]) if n]
    everything = (1 << (room + 1)) - 1
    reach = [1]  # reach[j]: sums of the first j lengths
    for n in lengths:
        bits, left, step = reach[-1], min(int(counts[n]), room // n), 1
        while left:
            step = min(step, left)
            bits |= (bits << (n * step)) & everything
            left -= step
            step *= 2
        reach.append(bits)

    def exactly(j: int, total: int) -> Iterator[tuple[int, ...]]:
        """Multisets of the first j lengths with this sum."""
        if not total:
            yield ()
        while j and total and reach[j] >> total & 1:
            j -= 1
            n = lengths[j]
            for k in range(min(int(counts[n]), total // n), 0, -1):
                if reach[j] >> (total - k * n) & 1:
                    yield from ((n,) * k + rest for rest in exactly(j, total - k * n))

    for waste in range(room + 1):
        if reach[-1] >> (room - waste) & 1:
            yield from (None if dominated(f, waste, lengths, counts) else f for f in exactly(len(lengths), room - waste))


def dominated(filling: tuple[int, ...], waste: int, lengths: list[int], counts: np.ndarray) -> bool:
    """Whether a piece left over could take the place of some of the filling's pieces (or of none) that are together no larger
    and small enough for it to fit: any packing with this filling is then no better than one with that piece in it."""
    sums, some, single = 1, 0, 1  # bits: sums of any pieces, of two or more, of one or none
    for n in filling:
        some |= (sums ^ 1) << n
        sums |= sums << n
        single |= 1 << n
    window = (1 << (waste + 1)) - 1
    for r in lengths:
        if counts[r] > filling.count(r):
            low = max(0, r - waste)
            below = window >> (waste - (r - low))
            if (some >> low) & below or (single >> low) & (below >> 1):
                return True
    return False


def lower_bound(histogram: dict[int, int], capacity: int) -> int:
    counts = np.zeros(capacity + 1, np.int64)
    for n, c in histogram.items():
        counts[n] = c
    return least_bins(counts, capacity)


def least_bins(counts: np.ndarray, capacity: int) -> int:
    """Bins needed at least, the greatest over all k: pieces over capacity - k are alone, those over half each have a bin, and
    what pieces of k up to half leave over the room of those needs bins of its own. k = 0 is the volume."""
    n = np.arange(capacity + 1)
    half = capacity // 2
    total = np.r_[0, np.cumsum(counts)]
    volume = np.r_[0, np.cumsum(counts * n)]
    k = np.arange(half + 1)
    beside = np.maximum(capacity - k, half)  # pieces over half and up to this may share their bin
    n_half, v_half = total[beside + 1] - total[half + 1], volume[beside + 1] - volume[half + 1]
    small = volume[half + 1] - volume[k]
    return int((total[-1] - total[half + 1] + np.maximum(0, -((n_half * capacity - v_half - small) // capacity))).max())


def best_fit_decreasing(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Runs of equal bins: every piece, largest first, goes to the open bins of least sufficient room."""
    bins: dict[int, dict[tuple[int, ...], int]] = {}  # room -> content -> number
    for n in sorted(counts, reverse=True):
        left = counts[n]
        while left:
            room = min((r for r in bins if r >= n), default=None)
            if room is None:
                fit = capacity // n
                whole, rest = divmod(left, fit)
                for content, k in (((n,) * fit, whole), ((n,) * rest, 1 if rest else 0)):
                    if k:
                        spot = bins.setdefault(capacity - sum(content), {})
                        spot[content] = spot.get(content, 0) + k
                break
            content, k = next(iter(bins[room].items()))
            fit = min(room // n, left)
            used = min(k, max(1, left // fit))
            bins[room][content] -= used
            if not bins[room][content]:
                del bins[room][content]
            if not bins[room]:
                del bins[room]
            new = content + (n,) * fit
            spot = bins.setdefault(capacity - sum(new), {})
            spot[new] = spot.get(new, 0) + used
            left -= fit * used
    return [(content, k) for spot in bins.values() for content, k in spot.items()]


@dataclass
class Frame:
    """A node of the search: bins so far, what is left, its choices and how many of them were taken."""

    bins: int
    left: np.ndarray
    choices: Iterator | None
    taken: int = 0


def complete_bins(histogram: dict[int, int], capacity: int = CAPACITY, nodes: int = NODES) -> list[tuple[tuple[int, ...], int]]:
    """[(lengths in a bin, number of such bins)] for all pieces of the histogram, in as few bins as found.

    A node takes the largest piece left, a filling around it and how often (a run of equal bins is one step, shorter runs are
    branches of their own); equal remainders that were reached with no more bins before are not searched again.
    """
    counts = np.zeros(capacity + 1, np.int64)
    for n, c in histogram.items():
        counts[n] = c
    if not counts.any():
        return []
    incumbent = best_fit_decreasing({n: c for n, c in histogram.items() if c}, capacity)
    n_best, bound = sum(k for _, k in incumbent), least_bins(counts, capacity)
    seen: dict[bytes, int] = {}

    def children(left: np.ndarray) -> Iterator[tuple[tuple[int, ...], int, np.ndarray] | None]:
        """(bin, times, what is left then), or None for a dominated filling"""
        large = int(np.flatnonzero(left)[-1])
        beside = left.copy()
        beside[large] -= 1
        for filling in fillings(capacity - large, beside):
            if filling is None:
                yield None
                continue
            uses = np.bincount((large, *filling), minlength=capacity + 1)
            used = np.flatnonzero(uses)
            for times in range(int((left[used] // uses[used]).min()), 0, -1):
                yield (large, *filling), times, left - times * uses

    ended = object()
    path: list[tuple[tuple[int, ...], int]] = []
    stack = [Frame(0, counts, children(counts))]
    while stack and n_best > bound and nodes:
        frame = stack[-1]
        n_done = frame.bins
        if frame.choices is None:  # deep frames let their enumeration go, and take it up again where it was
            frame.choices = islice(children(frame.left), frame.taken, None)
        step = next(frame.choices, ended)
        if step is ended:
            stack.pop()
            if path:
                path.pop()
            continue
        nodes -= 1
        frame.taken += 1
        if step is None:
            continue
        content, times, left = step
        n_now = n_done + times
        if n_now + least_bins(left, capacity) >= n_best:
            continue
        if not left.any():
            n_best, incumbent = n_now, [*path, (content, times)]
            continue
        key = hashlib.blake2b(left.tobytes(), digest_size=16).digest()
        if seen.get(key, n_now + 1) > n_now:
            seen[key] = n_now
            path.append((content, times))
            stack.append(Frame(n_now, left, children(left)))
            if len(stack) > OPEN_FRAMES:
                stack[-OPEN_FRAMES - 1].choices = None
    return incumbent


# --- placing --------------------------------------------------------------------------------------------------


def pack(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, nodes: int = NODES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: id, piece, start, length, crc, sequence, place (offset in its sequence)."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "pack")
    table = scratch.save(piece_table(docs, vocabulary, capacity, id_col, text_col), "pieces")
    order = ["length", "id", "piece", "start"]
    lined = scratch.save(table.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("seq", F.monotonically_increasing_id()), "lined")
    lined = lined.withColumn("part", F.shiftright("seq", 33))
    runs = lined.groupBy("part", "length").agg(F.min("seq").alias("first"), F.count("*").alias("n"))
    before = W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    runs = runs.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    histogram = {int(r.length): int(r.n) for r in table.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows

    # for each length: the rank at which a run of bins starts to take it, how many a bin takes, where they lie
    spots: dict[int, list[tuple[int, int, int, int, int]]] = {}
    taken: dict[int, int] = {}
    sequence = 0
    for content, times in complete_bins(histogram, capacity, nodes):
        place = 0
        for n in sorted(set(content), reverse=True):
            per = content.count(n)
            spots.setdefault(n, []).append((taken.get(n, 0), per, sequence, place, n))
            taken[n] = taken.get(n, 0) + per * times
            place += per * n
        sequence += times
    plan = spark.sparkContext.broadcast({n: np.array(rows, np.int64) for n, rows in spots.items()})

    def place_all(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            at = np.zeros((len(pdf), 2), np.int64)
            rank = (pdf.before + pdf.seq - pdf["first"]).to_numpy(np.int64)
            for n, rows in pdf.groupby("length").indices.items():
                spot = plan.value[int(n)]
                own = spot[np.searchsorted(spot[:, 0], rank[rows], "right") - 1]
                nth = rank[rows] - own[:, 0]
                at[rows, 0] = own[:, 2] + nth // own[:, 1]
                at[rows, 1] = own[:, 3] + nth % own[:, 1] * own[:, 4]
            out = pdf[["id", "piece", "start", "length", "crc"]].copy()
            out["sequence"], out["place"] = at[:, 0], at[:, 1]
            yield out

    placed = lined.join(runs, ["part", "length"])
    return placed.select(F.col("id").cast("string").alias("id"), "piece", "start", "length", "crc", "seq", "first", "before").mapInPandas(
        place_all, "id string, piece int, start long, length long, crc long, sequence long, place long"
    ).withColumn("id", F.col("id").cast("long"))
