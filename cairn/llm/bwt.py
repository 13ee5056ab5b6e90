"""Burrows-Wheeler transforms of string collections and their merge by interleave refinement.

A shard holds the sorted rotations of its strings (each closed by a terminator) up to ``DEPTH`` symbols, and for each
rotation the symbols before it. Shards are merged without comparing their suffixes again: the interleave starts as shard
after shard and is refined by a stable distribution on the preceding symbols, which turns an order by h symbols into one
by h + m. Blocks of rotations with a common prefix are carried along: two neighbours stay in one block if the symbols
before them and their former blocks agree. At the end a block holds the rotations with one common prefix of the
depth asked for, a repeated interval.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

SYMBOL_BITS, STRIDE = 9, 7  # a symbol is a byte plus one, or the terminator 0; STRIDE of them fit 63 bits


@dataclass
class Shard:
    """Sorted rotations: ``owner`` and ``offset`` of each, the symbol before it, and the STRIDE symbols before it."""

    owner: np.ndarray
    offset: np.ndarray
    before: np.ndarray
    before_stride: np.ndarray


def build_shard(strings: list[bytes], depth: int) -> Shard:
    sizes = np.array([len(s) + 1 for s in strings], np.int64)
    starts = np.cumsum(sizes) - sizes
    closed = np.frombuffer(b"\0".join(strings) + b"\0", np.uint8)
    symbols = closed.astype(np.uint64) + np.uint64(1)
    symbols[starts + sizes - 1] = 0
    owner = np.repeat(np.arange(len(strings)), sizes)
    start, size = starts[owner], sizes[owner]
    offset = np.arange(len(symbols)) - start

    def ahead(n: int) -> np.ndarray:
        """Position n symbols on, around the string."""
        at = offset + n
        return start + (at % size if n > 1 or n < -1 else np.where(at >= size, 0, np.where(at < 0, size - 1, at)))

    step = ahead(1)
    packed, at = np.zeros(len(symbols), np.uint64), np.arange(len(symbols))
    for _ in range(STRIDE):
        packed = (packed << np.uint64(SYMBOL_BITS)) | symbols[at]
        at = step[at]
    rank, known = dense_rank(packed), STRIDE
    while known < depth and int(rank.max(initial=0)) < len(rank) - 1:
        rank, known = dense_rank((rank << np.uint64(31)) | rank[ahead(known)]), 2 * known
    order = placed_order(rank)[0]
    return Shard(owner[order], offset[order], symbols[ahead(-1)][order].astype(np.uint16), packed[ahead(-STRIDE)][order])


def dense_rank(keys: np.ndarray) -> np.ndarray:
    """The number of distinct smaller keys, for each key."""
    order = np.argsort(keys)
    line = keys[order]
    out = np.empty(len(keys), np.uint64)
    out[order] = np.cumsum(np.r_[False, line[1:] != line[:-1]][: len(keys)], dtype=np.uint64)
    return out


def placed_order(ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stable order of small numbers, and the numbers in it: each carries its place in its low bits, so that values are sorted."""
    bits = np.uint64(max(1, len(ranks) - 1).bit_length())
    held = np.sort((ranks << bits) | np.arange(len(ranks), dtype=np.uint64))
    return (held & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64), held >> bits


def merge_shards(shards: list[Shard], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, block) in merged order: the rotation's place in the shards laid end to end, and the number of its block.

    Rotations of one block, and only those, agree in their first ``depth`` symbols.
    """
    before = np.concatenate([s.before for s in shards]).astype(np.uint64)
    before_stride = dense_rank(np.concatenate([s.before_stride for s in shards]))
    n = len(before)
    interleave = np.repeat(np.arange(len(shards), dtype=np.uint8), [len(s.owner) for s in shards])
    block = np.zeros(n, np.int32)
    row = np.empty(n, np.int32)
    line = np.arange(n, dtype=np.int32)
    for m in [1] * (depth % STRIDE) + [STRIDE] * (depth // STRIDE):
        row[np.argsort(interleave, kind="stable")] = line  # the next of its shard, for each place
        symbol = (before if m == 1 else before_stride)[row]
        order, symbol = placed_order(symbol)
        block, interleave = block[order], interleave[order]
        block = np.cumsum(np.r_[False, (symbol[1:] != symbol[:-1]) | (block[1:] != block[:-1])], dtype=np.int32)
    row[np.argsort(interleave, kind="stable")] = line
    return row, block


def least_by_window(shards: list[list[bytes]], ids: list[np.ndarray], width: int) -> list[list[np.ndarray]]:
    """For every string of every shard: the least id among all strings that hold the window, for each window of it."""
    built = [build_shard(s, width) for s in shards]
    row, block = merge_shards(built, width)
    owner, offset = np.concatenate([s.owner for s in built])[row], np.concatenate([s.offset for s in built])[row]
    shard = np.repeat(np.arange(len(built)), [len(s.owner) for s in built])[row]
    base = np.cumsum([0] + [len(s) for s in shards])[:-1]
    string = base[shard] + owner
    lengths = np.array([len(x) for s in shards for x in s], np.int64)
    whole = offset + width <= lengths[string]  # the window does not run over the terminator
    string, offset, block = string[whole], offset[whole], block[whole]
    least_of = np.full(int(block[-1]) + 1 if len(block) else 0, np.iinfo(np.int64).max)
    np.minimum.at(least_of, block, np.concatenate(ids)[string])
    windows = np.maximum(lengths - width + 1, 0)
    at = np.cumsum(windows) - windows
    flat = np.empty(int(windows.sum()), np.int64)
    flat[at[string] + offset] = least_of[block]
    parts = np.split(flat, at[1:])
    return [parts[b : b + len(s)] for b, s in zip(base, shards, strict=True)]
