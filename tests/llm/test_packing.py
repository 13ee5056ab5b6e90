import random
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cairn.llm import packing, queries

from .conftest import pairs


def least_bins(lengths, capacity):
    """The optimum by exhaustive search (small inputs)."""
    best = len(lengths)
    lengths = sorted(lengths, reverse=True)

    def place(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(lengths):
            best = len(rooms)
            return
        for r in set(rooms):
            if r >= lengths[i]:
                rest = list(rooms)
                rest.remove(r)
                place(i + 1, [*rest, r - lengths[i]])
        place(i + 1, [*rooms, capacity - lengths[i]])

    place(0, [])
    return best


def histogram(lengths):
    return {n: lengths.count(n) for n in set(lengths)}


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=0, max_size=9))
def test_bins_are_least_on_small_inputs(lengths):
    runs = packing.complete_bins(histogram(lengths), 20)
    placed = [n for content, k in runs for n in list(content) * k]
    assert sorted(placed) == sorted(lengths) and all(sum(c) <= 20 for c, _ in runs)
    assert sum(k for _, k in runs) == least_bins(lengths, 20)


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 500), max_size=30))
def test_any_histogram_is_packed_whole(counts):
    for runs in (packing.best_fit_decreasing(counts, 60), packing.complete_bins(counts, 60, nodes=200)):
        got = {}
        for content, k in runs:
            assert sum(content) <= 60 and k > 0
            for n in content:
                got[n] = got.get(n, 0) + k
        assert got == counts
    bins = sum(k for _, k in packing.complete_bins(counts, 60, nodes=200))
    assert packing.lower_bound(counts, 60) <= bins <= sum(k for _, k in packing.best_fit_decreasing(counts, 60)) if counts else bins == 0


def test_bin_completion_beats_best_fit():
    lengths = [6, 6, 5, 5, 4, 4, 3, 3, 2, 2] * 3  # of 10: best fit decreasing opens more
    counts = histogram([44, 24, 24, 22, 21, 17, 8, 8, 6, 6] * 2 + lengths)
    assert sum(k for _, k in packing.complete_bins(counts, 60)) <= sum(k for _, k in packing.best_fit_decreasing(counts, 60))


def test_pieces():
    assert packing.pieces_of(10, 10) == [(0, 10)] and packing.pieces_of(11, 10) == [(0, 1), (1, 10)] and packing.pieces_of(30, 10) == [(0, 10), (10, 10), (20, 10)]


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.vocabulary_path())


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_ids_equal_the_files_own_library(text):
    from tokenizers import Tokenizer

    global _both
    if "_both" not in globals():
        _both = (packing.ByteBpe(queries.vocabulary_path()), Tokenizer.from_file(queries.vocabulary_path()))
    assert _both[0](text) == _both[1].encode(text, add_special_tokens=False).ids


def holds(rows, docs, encode, capacity=2048):
    ids = {}
    for d, t in docs:
        ids.setdefault(d, []).append([*encode(t), 0])
    bins, seen = {}, {}
    for r in rows:
        texts = ids[r.id]
        assert any(zlib.crc32(np.array(x[r.start : r.start + r.length], "<u4").tobytes()) == r.crc for x in texts)
        bins.setdefault(r.sequence, []).append((r.place, r.length))
        seen.setdefault(r.id, []).append(r.length)
    assert {d: sum(n) for d, n in seen.items()} == {d: sum(map(len, x)) for d, x in ids.items()}
    for parts in bins.values():
        at = 0
        for place, n in sorted(parts):
            assert place == at
            at += n
        assert at <= capacity
    return len(bins)


def test_packing_edges(spark, edge_docs, no_docs, reference):
    encode = lambda t: reference.encode(t, add_special_tokens=False).ids
    rows = packing.pack(edge_docs, queries.vocabulary_path()).collect()
    bins = holds(rows, pairs(edge_docs), encode)
    assert bins == -(-sum(r.length for r in rows) // 2048)
    assert packing.pack(no_docs, queries.vocabulary_path()).count() == 0


def test_packing_query(spark, sf, small_docs, reference):
    df = queries.op10_best_fit_packing(spark, sf)
    assert df.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    rows = df.toDF("id", "piece", "start", "length", "crc", "sequence", "place").collect()
    bins = holds(rows, pairs(small_docs), lambda t: reference.encode(t, add_special_tokens=False).ids)
    assert bins <= -(-sum(r.length for r in rows) // 2048) + 1


def test_every_small_case_is_packed_best():
    """Against all packings: fillings of equal waste and shorter runs are tried, too."""
    assert sum(k for _, k in packing.complete_bins(Counter([50, 41, 39, 37, 33, 30, 27, 23, 20]), 100)) == 3
    rng = random.Random(3)

    def best(items, bins, cap, bound):
        if len(bins) >= bound:
            return bound
        if not items:
            return len(bins)
        for i, room in enumerate(bins):
            if room >= items[0] and room not in bins[:i]:
                bound = best(items[1:], [*bins[:i], room - items[0], *bins[i + 1 :]], cap, bound)
        return best(items[1:], [*bins, cap - items[0]], cap, bound)

    for _ in range(1500):
        cap = rng.choice([10, 20, 50, 100])
        items = sorted((rng.randint(max(1, cap // 6), cap * 2 // 3) for _ in range(rng.randint(1, 9))), reverse=True)
        got = packing.complete_bins(Counter(items), cap)
        used = Counter()
        for content, times in got:
            assert sum(content) <= cap
            used.update({n: times * content.count(n) for n in set(content)})
        assert used == Counter(items) and sum(k for _, k in got) == best(items, [], cap, len(items) + 1)
