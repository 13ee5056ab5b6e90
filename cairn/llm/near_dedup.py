"""Near-duplicate detection by b-bit MinHash.

A document's set holds its distinct word shingles. ``MINIMA`` minima are taken of each set; bands of full minima
give the candidates, only the low ``BITS`` bits of each minimum are kept and packed into a signature, and the
similarity of a candidate pair is estimated by counting equal lanes, corrected for chance collisions
(1 / 2^BITS of the lanes of unrelated sets agree). Pairs estimated up to ``MARGIN`` (over five standard deviations)
below the threshold are confirmed on the full sets, so an estimate never makes a link.

No pairs are formed within a group of equal sets: such documents are one class with one representative. In a band's
bucket every member is first held against the bucket's smallest member, then, while a bucket holds several components,
against a few drawn members, ``ROUNDS`` times: one pair each. What is left to compare are members outside the commonest
component of their bucket, against the bucket. Those comparisons run in blocks on the full sets, and only links that join
components become rows.

A link at the threshold is missed by all bands with probability (1 - t^ROWS)^BANDS: 2e-8 at 0.85, 3e-6 at 0.8.

Edge cases: null or empty text has an empty set and is linked with nothing; fewer words than a shingle make one
shingle of the whole sequence; rows of one id are one node with the links of all its texts (where texts of one id differ,
their classes of equal sets go by numbers of their own until components are named); a null id is linked with nothing and
kept; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, join_groups, mix64, slices, text_or_empty
from .graph import components

MINIMA, BANDS, ROWS, BITS = 256, 24, 4, 2
LANES = 64 // BITS
MARGIN = 0.15
ROUNDS, PIVOTS = 2, 4
BLOCK, ITEMS = 2048, 1 << 13
SLICE_BYTES = 1 << 19
BASE = np.uint64(0x9E3779B97F4A7C15)
_IS_WORD = np.ones(256, bool)
_IS_WORD[[32, 9, 10, 11, 12, 13]] = False


class Powers:
    """Powers of the hash base and of its inverse modulo 2^64, as far as asked for; one for each task."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, 1 << 20)
            self.up = np.cumprod(np.r_[np.uint64(1), np.full(n, BASE, np.uint64)])
            self.down = np.cumprod(np.r_[np.uint64(1), np.full(n, pow(int(BASE), -1, 1 << 64), np.uint64)])
        return self.up, self.down


def word_hashes(texts: list[bytes], powers: Powers) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the lower-cased (A-Z) words of several texts, and each word's text number."""
    buf = np.frombuffer(b"\n".join(texts).lower() + b"\n", np.uint8)
    word = _IS_WORD[buf]
    edge = np.flatnonzero(np.diff(np.r_[False, word]))
    starts, ends = edge[::2], edge[1::2]
    up, down = powers.of(len(buf) + 1)
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * up[: len(buf)], out=total[1:])
    hashes = mix64((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    closes = np.cumsum([len(t) + 1 for t in texts])
    return hashes, np.searchsorted(closes, starts, "right")


def shingle_sets(texts: list[bytes], words: int, powers: Powers) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    hashes, owner = word_hashes(texts, powers)
    bounds = np.searchsorted(owner, np.arange(len(texts) + 1))
    rolled = hashes.copy()
    for j in range(1, words):
        rolled[: len(rolled) - j] = mix64(rolled[: len(rolled) - j] * BASE + hashes[j:]) if len(rolled) > j else rolled[: len(rolled) - j]
    out = []
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if b - a >= words:
            out.append(np.unique(rolled[a : b - words + 1]))
        elif b > a:
            h = np.uint64(b - a)
            for x in hashes[a:b]:
                h = mix64(np.array([h], np.uint64) * BASE + x)[0]
            out.append(np.array([h ^ np.uint64(1)], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


_SEEDS = np.random.default_rng(7).integers(1, 1 << 63, (MINIMA, 2), np.uint64) | np.uint64(1)


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """MINIMA minima of each non-empty set."""
    flat = np.concatenate(sets)
    at = np.r_[0, np.cumsum([len(s) for s in sets])[:-1]]
    out, held = np.empty((len(sets), MINIMA), np.uint64), np.empty_like(flat)
    for k, (a, b) in enumerate(_SEEDS):
        np.multiply(flat, a, out=held)
        np.bitwise_xor(held, b, out=held)
        out[:, k] = np.minimum.reduceat(held, at)
    return mix64(out)


def packed(mins: np.ndarray) -> np.ndarray:
    """The low BITS bits of each minimum, LANES to a 64-bit word."""
    low = (mins & np.uint64((1 << BITS) - 1)).reshape(len(mins), -1, LANES)
    return np.bitwise_or.reduce(low << (np.arange(LANES, dtype=np.uint64) * np.uint64(BITS)), axis=2)


def band_keys(mins: np.ndarray) -> np.ndarray:
    parts = mins[:, : BANDS * ROWS].reshape(len(mins), BANDS, ROWS)
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), parts.shape[:2])
    for r in range(ROWS):
        key = mix64(key * BASE + parts[:, :, r])
    return key


SKETCH = "id string, n_shingles long, set_a long, set_b long, bands array<long>, signature array<long>"


def sketches(docs: DataFrame, words: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: size and digest of its set, band keys and packed signature."""

    def compute(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        powers = Powers()
        for pdf in batches:
            for a, b in slices(pdf.text.map(len).to_numpy(), SLICE_BYTES):
                sets = shingle_sets(list(pdf.text[a:b]), words, powers)
                full = [i for i, s in enumerate(sets) if len(s)]
                out = pd.DataFrame({"id": pdf.id[a:b].array, "n_shingles": [len(s) for s in sets]})
                out["set_a"], out["set_b"] = zip(*map(digests, sets), strict=True)
                keys, signature = [None] * len(sets), [None] * len(sets)
                if full:
                    mins = minima([sets[i] for i in full])
                    for i, k, s in zip(full, band_keys(mins).astype(np.int64), packed(mins).astype(np.int64), strict=True):
                        keys[i], signature[i] = k, s
                out["bands"], out["signature"] = keys, signature
                yield out

    rows = docs.select(F.col(id_col).cast("string").alias("id"), text_or_empty(text_col).cast("binary").alias("text"))  # a null among numbers would make pandas round them
    return rows.mapInPandas(compute, SKETCH).withColumn("id", F.col("id").cast("long"))


def digests(items: np.ndarray) -> tuple[int, int]:
    """Two numbers that name a set."""
    both = int(np.sum(items, dtype=np.uint64).astype(np.int64)), int(np.bitwise_xor.reduce(mix64(items + BASE)).astype(np.int64)) if len(items) else 0
    return both


def full_sets(docs: DataFrame, words: int) -> DataFrame:
    """(id, set_a, set_b, items): the sorted set of each row of (id, text) and what names it."""

    def compute(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        powers = Powers()
        for pdf in batches:
            for a, b in slices(pdf.text.map(len).to_numpy(), SLICE_BYTES):
                sets = shingle_sets(list(pdf.text[a:b]), words, powers)
                named = [digests(s) for s in sets]
                yield pd.DataFrame({"id": pdf.id[a:b].array, "set_a": [x for x, _ in named], "set_b": [y for _, y in named], "items": [s.astype(np.int64) for s in sets]})

    return docs.mapInPandas(compute, "id long, set_a long, set_b long, items array<long>")


def estimate(a: str, b: str) -> Column:
    """Similarity of two packed signatures: share of equal lanes, corrected for those equal by chance."""
    every = F.lit(sum(1 << (BITS * i) for i in range(LANES)))
    unequal = []
    for w in range(MINIMA // LANES):
        x = F.col(a)[w].bitwiseXOR(F.col(b)[w])
        folded = reduce(lambda y, s: y.bitwiseOR(F.shiftrightunsigned(x, s)), range(1, BITS), x)
        unequal.append(F.bit_count(folded.bitwiseAND(every)))
    share = (F.lit(MINIMA) - reduce(lambda p, q: p + q, unequal)) / F.lit(float(MINIMA))
    chance = 1.0 / (1 << BITS)
    return (share - chance) / (1 - chance)


def joining_links(left: pd.DataFrame, right: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Links (a, b) between the rows of each bucket's two sides that are confirmed on the full sets, as many as it takes to
    join the components they connect (a link between components that are joined already says nothing more)."""
    joined: dict[int, int] = {}

    def root(x: int) -> int:
        while x in joined:
            x = joined[x]
        return x

    def by_key(side: pd.DataFrame) -> dict[int, np.ndarray]:
        """Row numbers of each bucket."""
        if not len(side):
            return {}
        keys = np.concatenate([np.asarray(k, np.int64) for k in side["keys"]])
        rows = np.repeat(np.arange(len(side)), [len(k) for k in side["keys"]])
        order = np.argsort(keys, kind="stable")
        found, at = np.unique(keys[order], return_index=True)
        return dict(zip(found.tolist(), np.split(rows[order], at[1:]), strict=True))

    out = []
    columns = by_key(right)
    for key, rows in by_key(left).items():
        if key not in columns:
            continue
        a, b = left.iloc[rows], right.iloc[columns[key]]
        la, lb = a.label.to_numpy(), b.label.to_numpy()
        x, y = np.array(a.signature.tolist(), np.int64).view(np.uint64), np.array(b.signature.tolist(), np.int64).view(np.uint64)
        unequal = np.zeros((len(a), len(b)), np.int64)
        every = np.uint64(sum(1 << (BITS * i) for i in range(LANES)))
        for w in range(x.shape[1]):
            d = x[:, w, None] ^ y[None, :, w]
            folded = d.copy()
            for s in range(1, BITS):
                folded |= d >> np.uint64(s)
            unequal += np.bitwise_count(folded & every)
        chance = 1.0 / (1 << BITS)
        likely = ((1 - unequal / MINIMA) - chance) / (1 - chance) >= percent / 100 - MARGIN
        likely &= la[:, None] != lb[None, :]
        r, c = np.flatnonzero(likely.any(1)), np.flatnonzero(likely.any(0))
        if not len(r):
            continue
        # exact intersections of all these pairs: a product of incidence matrices over the items that both sides hold
        one, two = [np.asarray(v) for v in a["items"].iloc[r]], [np.asarray(v) for v in b["items"].iloc[c]]
        shared = np.intersect1d(np.concatenate(one), np.concatenate(two))
        met = np.zeros((len(r), len(c)), np.float32)
        for at in range(0, len(shared), ITEMS):
            part = shared[at : at + ITEMS]
            met += _incidence(one, part) @ _incidence(two, part).T
        union = np.array([len(v) for v in one])[:, None] + np.array([len(v) for v in two])[None, :] - met
        linked = (met * 100 >= union * percent) & likely[np.ix_(r, c)]
        for i, j in zip(*np.nonzero(linked), strict=True):
            p, q = root(int(la[r[i]])), root(int(lb[c[j]]))
            if p != q:
                joined[max(p, q)] = min(p, q)
                out.append((int(a.rep.iloc[r[i]]), int(b.rep.iloc[c[j]])))
    return pd.DataFrame(out, columns=["a", "b"], dtype="int64")


def _incidence(sets: list[np.ndarray], items: np.ndarray) -> np.ndarray:
    out = np.zeros((len(sets), len(items)), np.float32)
    for i, s in enumerate(sets):
        out[i, np.searchsorted(items, s[np.isin(s, items, assume_unique=True)])] = 1
    return out


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose full sets satisfy 100 * intersection >= percent * union."""
    first = pairs.join(sets.select(F.col("id").alias("a"), F.col("items").alias("items_a")), "a")
    second = first.join(sets.select(F.col("id").alias("b"), F.col("items").alias("items_b")), "b")
    shared = second.withColumn("shared", F.size(F.array_intersect("items_a", "items_b")))
    union = F.size("items_a") + F.size("items_b") - F.col("shared")
    return shared.where(F.col("shared") * 100 >= union * percent).select("a", "b")


def near_components(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_shingles, component (the smallest id reachable over confirmed links)."""
    scratch = Scratch(docs.sparkSession, "near")
    sketch = scratch.save(sketches(docs, words, id_col, text_col), "sketch")
    total = sketch.count()
    digest = ["n_shingles", "set_a", "set_b"]
    usable = sketch.where("n_shingles > 0 and id is not null")
    ends = usable.groupBy("id").agg(F.min(F.struct(*digest)).alias("low"), F.max(F.struct(*digest)).alias("high"))
    several = scratch.save(ends.where("low <> high").select("id"), "several")  # ids whose texts differ
    mixed = not several.isEmpty()
    classes = usable.groupBy(*digest).agg(F.min("id").alias("least"), F.count("*").alias("rows"), F.first("bands").alias("bands"), F.first("signature").alias("signature"))
    if mixed:
        known = several.select(F.col("id").alias("least"), F.lit(True).alias("_several"))
        classes = classes.join(known, "least", "left").withColumn("rep", F.when(F.col("_several"), F.xxhash64(*digest)).otherwise(F.col("least"))).drop("_several")
    else:
        classes = classes.withColumn("rep", F.col("least"))
    classes = scratch.save(classes, "classes")

    placed = classes.select("rep", F.explode("bands").alias("key"))
    mark = lambda salt: F.bit_xor(F.xxhash64("rep", F.lit(salt)))
    buckets = placed.groupBy("key").agg(F.min("rep").alias("pivot"), F.count("*").alias("members"), mark(1).alias("m1"), mark(2).alias("m2")).where("members > 1")
    # near copies fall together in most bands: of buckets with the same members one is looked at
    buckets = buckets.groupBy("pivot", "members", "m1", "m2").agg(F.min("key").alias("key")).drop("m1", "m2")
    members = scratch.save(placed.join(buckets, "key"), "members")
    needed = members.select("rep").distinct().join(classes.select("rep", F.col("least").alias("id"), "set_a", "set_b"), "rep") if mixed else members.select(F.col("rep").alias("id"))
    text = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).cast("binary").alias("text"))
    sets = full_sets(text.join(needed.select("id").distinct().hint("merge"), "id", "left_semi"), words)  # ids grow with the input: shuffled at every size
    if mixed:
        sets = sets.join(needed, ["id", "set_a", "set_b"]).groupBy("rep").agg(F.first("items").alias("items")).withColumnRenamed("rep", "id")
    else:
        sets = sets.groupBy("id").agg(F.first("items").alias("items"))
    sets = scratch.save(sets, "sets")
    signatures = classes.groupBy("rep").agg(F.first("signature").alias("signature"), F.first("n_shingles").alias("n"))
    sign = lambda side: signatures.select(F.col("rep").alias(side), F.col("signature").alias(f"sign_{side}"), F.col("n").alias(f"n_{side}"))
    # sets whose sizes differ too much can't reach the threshold
    sized = (F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent) & (estimate("sign_a", "sign_b") >= percent / 100 - MARGIN)

    def links_of(pairs: DataFrame, name: str) -> DataFrame:
        likely = scratch.save(pairs.join(sign("a"), "a").join(sign("b"), "b").where(sized).select("a", "b"), f"likely-{name}")
        return scratch.save(_confirmed(likely, sets, percent), f"links-{name}")

    star = members.where("rep <> pivot").select(F.col("pivot").alias("a"), F.col("rep").alias("b")).distinct()
    first_links = links_of(star, "star")
    if mixed:  # the classes of one id are one node
        own = usable.join(several, "id", "left_semi").select("id", *digest).distinct().join(classes.select(*digest, "rep"), digest).select("id", "rep")
        heads = own.groupBy("id").agg(F.min("rep").alias("a"))
        first_links = scratch.save(first_links.unionByName(own.join(heads, "id").where("rep <> a").select("a", F.col("rep").alias("b"))), "links-ids")
    labels = components(first_links, scratch, "star")

    def extended(labels: DataFrame, links: DataFrame, name: str) -> DataFrame:
        """Labels after further links; components so far are contracted, so only what is new is searched."""
        named = lambda side: labels.select(F.col("node").alias(side), F.col("label").alias(f"label_{side}"))
        upper = links.join(named("a"), "a", "left").join(named("b"), "b", "left")
        joined = components(upper.select(F.coalesce("label_a", "a").alias("a"), F.coalesce("label_b", "b").alias("b")), scratch, name)
        fresh = joined.join(labels.select("node"), "node", "left_anti").select("node", "label")
        moved = labels.join(joined.select(F.col("node").alias("label"), F.col("label").alias("final")), "label", "left")
        return scratch.save(moved.select("node", F.coalesce("final", "label").alias("label")).unionByName(fresh), f"{name}-labels")

    def still_open(labels: DataFrame, name: str) -> DataFrame:
        """Members of buckets of three and more that hold several components."""
        at = members.where("members > 2").join(labels.withColumnRenamed("node", "rep"), "rep", "left")
        at = at.select("key", "rep", "pivot", "members", F.coalesce("label", "rep").alias("label"))
        several = at.groupBy("key").agg(F.min("label").alias("l0"), F.max("label").alias("l1")).where("l0 <> l1")
        return scratch.save(at.join(several, "key", "left_semi"), f"open-{name}")

    # drawn pivots join what the smallest member does not: a few for each bucket and round, one pair for each member
    for turn in range(1, ROUNDS + 1):
        at = still_open(labels, str(turn))
        if at.isEmpty():
            break
        draw = F.xxhash64("rep", F.lit(turn))
        drawn = at.groupBy("key", F.pmod(draw, F.lit(PIVOTS)).alias("salt")).agg(F.min_by(F.struct("rep", "label"), draw).alias("p"))
        drawn = drawn.select("key", F.col("p.rep").alias("pivot"), F.col("p.label").alias("pivot_label"))
        pairs = at.drop("pivot").join(drawn, "key").where("label <> pivot_label")
        pairs = pairs.select(F.least("rep", "pivot").alias("a"), F.greatest("rep", "pivot").alias("b")).distinct()
        labels = extended(labels, links_of(pairs, str(turn)), f"round{turn}")

    # what is left: members outside the commonest component of their bucket, against the whole bucket. Large buckets are cut
    # into blocks; small ones share a group by their smallest member, so that a set travels once for all buckets it is in
    at = still_open(labels, "last")
    common = at.groupBy("key", "label").agg(F.count("*").alias("n")).groupBy("key").agg(F.max_by("label", F.struct("n", "label")).alias("common"), F.sum("n").alias("size"), F.max("n").alias("most"))
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    shape = common.select("key", "common", "size", blocks(F.col("size") - F.col("most")).alias("rows_in"), blocks(F.col("size")).alias("columns_in"))
    spread = at.join(shape, "key")
    stray, large = F.col("label") != F.col("common"), F.col("size") > BLOCK
    bins = max(1, at.count() // BLOCK)
    spot = lambda salt, n: F.pmod(F.xxhash64("rep", F.lit(salt)), F.col(n)).cast("int")
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    def side(rows: DataFrame, i: Column, j: Column) -> DataFrame:
        cut = rows.where(large).withColumn("i", i).withColumn("j", j).select(F.col("key").alias("group"), "i", "j", "rep", "label", F.array("key").alias("keys"))
        whole = rows.where(~large).groupBy(F.pmod(F.xxhash64("pivot"), F.lit(bins)).alias("group"), "rep").agg(F.first("label").alias("label"), F.collect_list("key").alias("keys"))
        every = cut.unionByName(whole.select("group", F.lit(0).alias("i"), F.lit(0).alias("j"), "rep", "label", "keys"))
        held = every.join(signatures.drop("n"), "rep").join(sets.withColumnRenamed("id", "rep"), "rep")
        return held.select(*[F.col(c).alias(c) for c in ("group", "i", "j", "rep", "label", "signature", "items", "keys")])  # columns of its own

    where = ["group", "i", "j"]
    left = side(spread.where(stray), spot(1, "rows_in"), upto("columns_in"))
    right = side(spread, upto("rows_in"), spot(2, "columns_in"))
    cross = left.groupBy(*where).cogroup(right.groupBy(*where)).applyInPandas(lambda x, y: joining_links(x, y, percent), "a long, b long")
    labels = extended(labels, scratch.save(cross, "links-cross"), "cross")
    scratch.drop("sets")

    reached = classes.select(*digest, "rep", "least", "rows").join(labels.withColumnRenamed("node", "rep"), "rep", "left")
    reached = reached.select(*digest, "least", "rows", F.coalesce("label", "rep").alias("component"))
    if mixed:
        named = reached.groupBy("component").agg(F.min("least").alias("smallest"), F.count("*").alias("_n"))
        named = scratch.save(named, "named")
        reached = join_groups(scratch.save(reached, "numbered"), named, ["component"], "_n", total).withColumn("component", F.col("smallest")).drop("smallest", "_n")
    reached = scratch.save(reached.select(*digest, "rows", "component"), "reached")
    linked = join_groups(usable.select("id", *digest), reached, digest, "rows", total)
    others = sketch.where("n_shingles = 0 or id is null").select("id", "n_shingles", F.col("id").alias("component"))
    return linked.select("id", "n_shingles", "component").unionByName(others)


def drop_near_copies(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` of which one per component stays, the smallest id (rows without words always stay)."""
    dropped = near_components(docs, words, percent, id_col, text_col).where("id <> component").select("id").distinct()
    return docs.alias("rows").join(dropped.alias("dropped"), F.col(f"rows.{id_col}").cast("long") == F.col("dropped.id"), "left_anti")
