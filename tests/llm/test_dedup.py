import hashlib
import random
import re

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from cairn.llm import bwt, exact_dedup, near_dedup, queries, substring_dedup

from .conftest import pairs


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text)


def exact(docs):
    groups = {}
    for d, t in docs:
        groups.setdefault(normal(t), []).append(d)
    keep = {t: min((d for d in g if d is not None), default=None) for t, g in groups.items()}
    return sorted([(d, keep[normal(t)], len(groups[normal(t)]), hashlib.sha256(normal(t).encode()).hexdigest()) for d, t in docs], key=repr)


def got_exact(df):
    return sorted([(r.id, r.keep_id, r.group_size, bytes(r.digest).hex()) for r in df.collect()], key=repr)


def test_exact_edges(spark, edge_docs, no_docs):
    assert got_exact(exact_dedup.exact_groups(edge_docs)) == exact(pairs(edge_docs))
    assert exact_dedup.exact_groups(no_docs).count() == 0 and exact_dedup.drop_exact_copies(no_docs).count() == 0
    kept = exact_dedup.drop_exact_copies(edge_docs)
    assert kept.columns == edge_docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 4, 5, 7, 8, 9, 10, 11, 12, 13, 14]


def test_exact_with_many_rounds(spark, edge_docs, monkeypatch):
    monkeypatch.setattr(exact_dedup, "ROWS_PER_SLOT", 1)
    monkeypatch.setattr(exact_dedup, "RUN_ROWS", 3)
    many = edge_docs.unionByName(spark.range(200).selectExpr("id + 100 AS doc_id", "concat('text ', id % 40) AS text", "'' AS lang", "'s' AS source", "1L AS n_chars", "'' AS id", "'' AS size", "'' AS rank")).repartition(7)
    assert got_exact(exact_dedup.exact_groups(many)) == exact(pairs(many))


def test_merging_verifies_lengths():
    d = np.zeros((2, 32), np.uint8)
    with pytest.raises(ValueError, match="length"):
        exact_dedup._merged(d, np.array([1, 2]), np.array([1, 1]), np.array([3, 4]))


def shingles(text, n):
    w = text.encode().lower().split()
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)]) if w else frozenset()


def near(docs, n, percent):
    sets = [(d, shingles(t, n)) for d, t in docs]
    up = {d: d for d, _ in docs if d is not None}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, (a, s) in enumerate(sets):
        for b, t in sets[:i]:
            if a is not None and b is not None and s and t and 100 * len(s & t) >= percent * len(s | t):
                p, q = root(a), root(b)
                up[max(p, q)] = min(p, q)
    return sorted([(d, len(s), None if d is None else root(d)) for d, s in sets], key=repr)


def got_near(df):
    return sorted([(r.id, r.n_shingles, r.component) for r in df.collect()], key=repr)


@pytest.mark.parametrize("n, percent", [(3, 85), (5, 80)])
def test_near_edges(spark, edge_docs, no_docs, n, percent):
    assert got_near(near_dedup.near_components(edge_docs, n, percent)) == near(pairs(edge_docs), n, percent)
    assert near_dedup.near_components(no_docs, n, percent).count() == 0
    assert near_dedup.drop_near_copies(no_docs).columns == no_docs.columns


def family(seed, size, edits, length=80):
    """Copies of one text, each with a few words changed: some linked, some not, the smallest id a far one."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(5000)}" for _ in range(length)]
    out = []
    for i in range(size):
        w = list(base)
        for _ in range(edits + 3 if i == 0 else rng.randrange(edits + 1)):
            w[rng.randrange(length)] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def test_near_families_with_hot_buckets(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 16)
    texts = family(1, 70, 6) + family(2, 40, 3) + family(3, 5, 1) + ["unrelated text number %d with its own words %d" % (i, i * 7) for i in range(20)]
    docs = list(enumerate(texts, 10))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert got_near(near_dedup.near_components(df, 3, 85)) == near(docs, 3, 85)


def test_links_in_a_chain(spark):
    """Neighbours are linked, ends are not: one component, whatever the pivots."""
    words = [f"w{i}" for i in range(300)]
    docs = [(i, " ".join(words[i * 4 : i * 4 + 100])) for i in range(40)]
    assert got_near(near_dedup.near_components(spark.createDataFrame(docs, "doc_id long, text string"), 3, 85)) == near(docs, 3, 85)


def test_word_and_set_hashes_follow_the_words():
    texts = [b"A b  c\td", b"a B c d", b"", b" \n ", b"x", b"a b c d e", b"bcd a", b"a bcd"]
    sets = [set(s.tolist()) for s in near_dedup.shingle_sets(texts, 3, near_dedup.Powers())]
    assert sets[0] == sets[1] and len(sets[0]) == 2 and not sets[2] and not sets[3] and len(sets[4]) == 1 and sets[5] > sets[0] and sets[6] != sets[7]


def test_estimate_is_corrected_for_chance(spark):
    rng = np.random.default_rng(0)
    rows = []
    for share in (0.0, 0.5, 0.9, 1.0):
        for _ in range(30):
            n = int(1000 * share)
            common, own = rng.integers(0, 2**63, n, np.uint64), [rng.integers(0, 2**63, 1000 - n, np.uint64) for _ in range(2)]
            a, b = (near_dedup.packed(near_dedup.minima([np.unique(np.r_[common, o])])).astype(np.int64)[0].tolist() for o in own)
            rows.append((share, n / (2000 - n), a, b))
    got = spark.createDataFrame(rows, "share double, true double, a array<long>, b array<long>").select("share", "true", near_dedup.estimate("a", "b").alias("e")).groupBy("share").agg({"true": "avg", "e": "avg"}).collect()
    for r in got:
        assert r["avg(e)"] == pytest.approx(r["avg(true)"], abs=0.03)


def test_near_query(spark, sf, small_docs):
    rows = queries.op7_minhash_near_dedup(spark, sf).collect()
    assert sorted([(r.doc_id, r.n_shingles, r.component_id) for r in rows], key=repr) == near(pairs(small_docs), 3, 85)
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)


def cut(docs, width=50):
    """Every window of every text, by hand."""
    first, out = {}, []
    for d, t in sorted(docs, key=lambda r: (r[0] is None, r[0] or 0)):
        b = t.encode()
        for i in range(len(b) - width + 1):
            first.setdefault(b[i : i + width], d)
    for d, t in docs:
        b, gone = t.encode(), bytearray(len(t.encode()))
        for i in range(len(b) - width + 1):
            f = first[b[i : i + width]]
            if f is not None and (d is None or f < d):
                gone[i : i + width] = b"\1" * width
        runs = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((d, len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=repr)


def got_cut(df):
    return sorted([(r.id, r.n_bytes, r.n_removed, r.n_spans, r.kept) for r in df.collect()], key=repr)


def test_substrings_edges(spark, edge_docs, no_docs):
    assert got_cut(substring_dedup.remove_repeats(edge_docs, digest=True)) == cut(pairs(edge_docs))
    assert substring_dedup.remove_repeats(no_docs).count() == 0
    kept = {r.id: bytes(r.kept) for r in substring_dedup.remove_repeats(edge_docs.where("doc_id < 3")).collect() if r.n_removed == 0}
    assert len(kept[1]) > 50


@pytest.mark.parametrize("part_bytes", [1 << 23, 2048])
def test_substrings_of_shared_passages(spark, monkeypatch, part_bytes):
    monkeypatch.setattr(substring_dedup, "PART_BYTES", part_bytes)
    monkeypatch.setattr(substring_dedup, "MERGE_BYTES", 700)
    rng = random.Random(5)
    text = lambda n: "".join(rng.choice("abcdé \n") for _ in range(n))
    passages = [text(n) for n in (49, 50, 51, 70, 120, 300)]
    docs = []
    for i in range(60):
        parts = [text(rng.randrange(80)) for _ in range(3)]
        parts.insert(rng.randrange(4), rng.choice(passages)[rng.randrange(8) :])
        docs.append((i * 3 % 61, "".join(parts) + ("ab" * rng.randrange(60) if i % 5 == 0 else "")))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert got_cut(substring_dedup.remove_repeats(df, digest=True)) == cut(docs)


def test_substring_query(spark, sf, small_docs):
    rows = queries.op5_suffix_dedup(spark, sf).collect()
    assert sorted([(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows], key=repr) == cut(pairs(small_docs))


@settings(max_examples=60, deadline=None, suppress_health_check=[HealthCheck.too_slow])
@given(st.lists(st.lists(st.binary(min_size=0, max_size=30).map(lambda b: bytes(x % 3 for x in b)), min_size=1, max_size=5), min_size=1, max_size=4), st.integers(1, 12))
def test_merged_transforms_against_brute_force(shards, width):
    ids = [np.array([hash((i, j)) % 50 for j in range(len(s))], np.int64) for i, s in enumerate(shards)]
    least = {}
    for s, k in zip(shards, ids, strict=True):
        for text, i in zip(s, k, strict=True):
            for at in range(len(text) - width + 1):
                w = text[at : at + width]
                least[w] = min(least.get(w, 99), int(i))
    got = bwt.least_by_window(shards, ids, width)
    for s, parts in zip(shards, got, strict=True):
        for text, p in zip(s, parts, strict=True):
            assert p.tolist() == [least[text[at : at + width]] for at in range(len(text) - width + 1)]


def test_shards_are_sorted_and_merge_without_comparing():
    strings = [b"banana", b"bandana", b"ananas"]
    shard = bwt.build_shard(strings, 20)
    turn = lambda s, o: ([x + 1 for x in s] + [0])[o:] + ([x + 1 for x in s] + [0])[:o]
    rotations = [turn(strings[w], o)[:8] for w, o in zip(shard.owner, shard.offset, strict=True)]
    assert rotations == sorted(rotations)
    parts = [bwt.build_shard([s], 8) for s in strings]
    row, block = bwt.merge_shards(parts, 3)
    where = [(i, int(o)) for i, p in enumerate(parts) for o in p.offset]
    merged = [turn(strings[where[r][0]], where[r][1])[:3] for r in row]
    assert merged == sorted(merged) and all((merged[i] == merged[i - 1]) == (block[i] == block[i - 1]) for i in range(1, len(row)))


def test_texts_of_one_id_are_one_node(spark):
    a = " ".join(f"alpha{i}" for i in range(60))
    b = " ".join(f"beta{i}" for i in range(60))
    rows = [(1, a), (1, b), (2, b + " x"), (3, a + " y"), (4, "something else entirely")]
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, "doc_id long, text string")
        assert sorted((r.id, r.component) for r in near_dedup.near_components(df, 3, 85).collect()) == [(1, 1), (1, 1), (2, 1), (3, 1), (4, 4)]


def test_exact_copies_with_columns_of_any_name(spark):
    df = spark.createDataFrame([(1, "a  b", 7, "q", 1), (2, "a b", 8, "r", 2)], "doc_id long, text string, _key int, digest string, row int")
    assert [tuple(r) for r in exact_dedup.drop_exact_copies(df).collect()] == [(1, "a  b", 7, "q", 1)]
