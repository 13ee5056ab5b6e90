"""Approximate nearest neighbours by learned partitions.

On a bounded sample (``SAMPLE`` distinct vectors, in hash order) the neighbour graph is cut into parts of equal size:
parts grow breadth-first, then vertices move to the part that holds most of their neighbours while it has room. A
small network (one hidden layer) learns, for a vector, the parts its neighbours lie in. It places every row in its most
probable part and routes every query to several most probable parts, whose rows are all reranked by exact inner
products. How many parts a query visits is set on the sample, so that they hold ``COVER`` of the true neighbours.

Scale: the number of parts follows the root of the rows (up to ``MOST_PARTS``); a part's rows and queries are dealt into blocks of
bounded size, so no task holds a whole part. Equal vectors are one entry with its smallest ids (k + 1 of them can
appear in a result at most, so none is lost), and equal queries are searched once.

Edge cases: vectors that are null, empty, all zero or hold a null or non-finite component take no part, nor do rows
without id; vectors of different lengths are compared over the components that both have (the router sees the commonest length,
others cut or filled with zeros); repeated rows of one id and vector count once; a row is never its
own neighbour; ties go to the smaller id; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, hash_sample, join_groups

K = 20
SAMPLE = 6144
NEIGHBOURS = 10
#: Parts are the square root of the rows over this, up to a bound that the sample can still teach.
PARTS_UNDER_ROOT, MOST_PARTS = 8, 256
COVER = 0.95
HIDDEN = 128
STEPS = 300
BLOCK_ROWS, BLOCK_QUERIES = 4096, 1024


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """Indices of each vector's k nearest others by inner product."""
    out = np.empty((len(x), min(k, len(x) - 1)), np.int64)
    for a in range(0, len(x), 1024):
        s = x[a : a + 1024] @ x.T
        s[np.arange(len(s)), np.arange(a, a + len(s))] = -np.inf
        out[a : a + 1024] = np.argsort(-s, axis=1, kind="stable")[:, : out.shape[1]]
    return out


def balanced_parts(graph: np.ndarray, parts: int, slack: float = 1.1, passes: int = 12) -> np.ndarray:
    """Part of each vertex; none holds more than ``slack`` times the mean."""
    n = len(graph)
    near: list[set[int]] = [set(map(int, r)) for r in graph]
    for i, r in enumerate(graph):
        for j in r:
            near[int(j)].add(i)
    part, goal = np.full(n, -1), -(-n // parts)
    unseen, seed = n, 0
    for p in range(parts):
        frontier: list[int] = []
        for _ in range(min(goal, unseen)):
            while frontier and part[frontier[0]] >= 0:
                frontier.pop(0)
            if not frontier:
                while part[seed] >= 0:
                    seed += 1
                frontier.append(seed)
            v = frontier.pop(0)
            part[v] = p
            unseen -= 1
            frontier += [u for u in sorted(near[v]) if part[u] < 0]
    size, room = np.bincount(part, minlength=parts), int(np.ceil(slack * goal))
    for _ in range(passes):
        moved = 0
        for v in range(n):
            votes = np.bincount(part[list(near[v])], minlength=parts).astype(float)
            votes[(size >= room) & (np.arange(parts) != part[v])] = -1
            best = int(np.argmax(votes))
            if votes[best] > votes[part[v]]:
                size[part[v]] -= 1
                size[best] += 1
                part[v] = best
                moved += 1
        if not moved:
            break
    return part


@dataclass
class Router:
    """Logits of the parts for vectors, and how many parts a query visits."""

    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    probes: int = 1

    def logits(self, x: np.ndarray) -> np.ndarray:
        x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
        return np.maximum(x @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    def best(self, x: np.ndarray, n: int) -> np.ndarray:
        return np.argsort(-self.logits(x), axis=1, kind="stable")[:, :n]


def fit_router(x: np.ndarray, rows: int, seed: int = 5) -> Router:
    """x: the sampled vectors; rows: distinct vectors of the whole table."""
    parts = int(min(MOST_PARTS, max(1, round(rows**0.5 / PARTS_UNDER_ROOT)), max(1, len(x) // (2 * NEIGHBOURS))))
    rng, d = np.random.default_rng(seed), x.shape[1]
    if parts == 1:
        return Router(np.zeros((d, 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1))
    graph = neighbour_graph(x, NEIGHBOURS)
    part = balanced_parts(graph, parts)
    # a vector's target is where its neighbours and itself lie
    target = np.zeros((len(x), parts))
    np.add.at(target, (np.repeat(np.arange(len(x)), graph.shape[1]), part[graph].ravel()), 1.0)
    target[np.arange(len(x)), part] += 2.0
    target /= target.sum(1, keepdims=True)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    theta = [rng.normal(0, (2 / d) ** 0.5, (d, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, (2 / HIDDEN) ** 0.5, (HIDDEN, parts)), np.zeros(parts)]
    m, v = [np.zeros_like(t) for t in theta], [np.zeros_like(t) for t in theta]
    for t in range(1, STEPS + 1):
        own = rng.integers(0, len(x), min(len(x), 1024))
        a = unit[own]
        h = np.maximum(a @ theta[0] + theta[1], 0)
        z = h @ theta[2] + theta[3]
        p = np.exp(z - z.max(1, keepdims=True))
        p = (p / p.sum(1, keepdims=True) - target[own]) / len(own)
        dh = (p @ theta[2].T) * (h > 0)
        for i, g in enumerate((a.T @ dh, dh.sum(0), h.T @ p, p.sum(0))):
            m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.999 * v[i] + 0.001 * g * g
            theta[i] = theta[i] - 0.01 * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    router = Router(*theta)
    # probes: the least number of parts that holds COVER of the sample's true neighbours
    asked = rng.permutation(len(x))[:1024]
    scores = x[asked] @ x.T
    scores[np.arange(len(asked)), asked] = -np.inf
    true = np.argpartition(-scores, K, axis=1)[:, :K] if len(x) > K else np.argsort(-scores, axis=1)[:, : len(x) - 1]
    home = router.best(x, 1)[:, 0]
    place = np.argsort(np.argsort(-router.logits(x[asked]), axis=1, kind="stable"), axis=1, kind="stable")
    reached = np.bincount(np.take_along_axis(place, home[true], axis=1).ravel(), minlength=parts).cumsum() / true.size
    router.probes = int(np.searchsorted(reached, COVER) + 1)
    return router


def valid(rows: DataFrame) -> DataFrame:
    """rows (id, vec): those that take part."""
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return rows.where(F.col("id").isNotNull() & F.col("vec").isNotNull() & finite & F.exists("vec", lambda x: x != 0))


def commonest_length(rows: DataFrame) -> int:
    row = rows.groupBy(F.size("vec").alias("s")).agg(F.count("*").alias("n")).agg(F.max_by("s", F.struct("n", "s")).alias("s")).first()
    return int(row.s or 1)


def of_length(vectors: Iterable, d: int) -> np.ndarray:
    """Vectors as rows of d components, cut or filled with zeros."""
    vectors = list(vectors)
    if all(len(v) == d for v in vectors):
        return np.array([np.asarray(v, np.float64) for v in vectors]).reshape(len(vectors), d)
    out = np.zeros((len(vectors), d))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v[:d]
    return out


def by_length(vectors: pd.Series) -> list[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, matrix) of the vectors of each length."""
    lengths = vectors.map(len).to_numpy()
    groups = [np.flatnonzero(lengths == n) for n in np.unique(lengths)]
    return [(own, np.array([np.asarray(vectors.iloc[i], np.float64) for i in own])) for own in groups]


def block_search(rows: pd.DataFrame, queries: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k + 1 best (cost, id) of one block of rows for each query of a block; cost is the negated score."""
    out = []
    if len(rows) and len(queries):
        ids, asked, rows_by = rows.ids.tolist(), queries["query"].tolist(), by_length(rows.vec)
        n = min(len(rows), k + 1)
        longest = max(np.linalg.norm(x, axis=1).max() for _, x in rows_by)
        for numbers, q in by_length(queries.vec):
            rough = np.empty((len(q), len(rows)))
            for own, x in rows_by:
                both = min(x.shape[1], q.shape[1])
                rough[:, own] = q[:, :both] @ x[:, :both].T
            least = np.partition(rough, len(rows) - n, axis=1)[:, len(rows) - n]
            # a bound on how far two orders of summation differ, so that every vector that may be among the best is kept
            slack = 4 * q.shape[1] * np.finfo(np.float64).eps * np.linalg.norm(q, axis=1) * longest
            for i, number in enumerate(numbers):
                top = []
                for own, x in rows_by:
                    found = np.flatnonzero(rough[i, own] >= least[i] - slack[i])
                    both = min(x.shape[1], q.shape[1])
                    exact = (x[found, :both] * q[i, :both]).sum(axis=1)  # one order of summation for every row, so equal vectors tie
                    top += [(-s, int(v)) for s, j in zip(exact, own[found], strict=True) for v in ids[j]]
                out.append((asked[number], sorted(top)[: k + 1]))
    return pd.DataFrame(out, columns=["query", "found"])


def search(vectors: DataFrame, every: int = 20, k: int = K, id_col: str = "vec_id", vec_col: str = "embedding", sample: int = SAMPLE) -> DataFrame:
    """query_id, rank (from 1), id, score: the k nearest found of each row whose id ``every`` divides."""
    spark, scratch = vectors.sparkSession, Scratch(vectors.sparkSession, "ann")
    rows = valid(vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec")))
    d = commonest_length(rows)
    first = W.partitionBy("vec").orderBy("id")
    few = rows.distinct().withColumn("n", F.row_number().over(first)).where(F.col("n") <= k + 1)
    entries = scratch.save(few.groupBy("vec").agg(F.sort_array(F.collect_list("id")).alias("ids")), "entries")
    asked = rows.where(F.col("id") % every == 0).select("id", "vec").distinct()
    queries = scratch.save(asked.groupBy("vec").agg(F.count("*").alias("askers"), F.min("id").alias("query")), "queries")
    n_rows = entries.count()
    drawn = hash_sample(entries.withColumn("first", F.col("ids")[0]), "first", 0, sample).select("vec").collect()
    x = of_length((r.vec for r in drawn), d)
    x = x[np.linalg.norm(x, axis=1) > 0]
    router = fit_router(x, n_rows) if len(x) else Router(np.zeros((d, 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1))

    def place(batches):
        for pdf in batches:
            pdf["part"] = router.best(of_length(pdf.vec, d), 1)[:, 0] if len(pdf) else 0
            yield pdf

    def route(batches):
        for pdf in batches:
            pdf["parts"] = list(router.best(of_length(pdf.vec, d), router.probes)) if len(pdf) else []
            yield pdf

    kind = dict(entries.dtypes)["vec"]
    placed = scratch.save(entries.mapInPandas(place, f"vec {kind}, ids array<long>, part int"), "placed")
    routed = queries.select("vec", "query").mapInPandas(route, f"vec {kind}, query long, parts array<int>")
    routed = scratch.save(routed.select("vec", "query", F.explode("parts").alias("part")), "routed")
    blocks = lambda n: F.ceil(F.count("*") / n).cast("int")
    shape = placed.groupBy("part").agg(blocks(BLOCK_ROWS).alias("row_blocks")).join(routed.groupBy("part").agg(blocks(BLOCK_QUERIES).alias("query_blocks")), "part")
    shape = F.broadcast(shape)  # at most MOST_PARTS rows
    spot = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = placed.join(shape, "part").select("part", spot(F.col("ids")[0], "row_blocks").alias("i"), upto("query_blocks").alias("j"), "vec", "ids")
    right = routed.join(shape, "part").select("part", upto("row_blocks").alias("i"), spot(F.col("query"), "query_blocks").alias("j"), "vec", "query")
    key = ["part", "i", "j"]
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(lambda a, b: block_search(a, b, k), "query long, found array<struct<cost: double, id: long>>")
    # merged by groups of lists first, so that no list grows with the number of blocks
    best = lambda: F.slice(F.sort_array(F.flatten(F.collect_list("found"))), 1, k + 1).alias("found")
    some = found.groupBy("query", F.pmod(F.spark_partition_id(), F.lit(16)).alias("some")).agg(best())
    lists = some.groupBy("query").agg(best())
    lists = scratch.save(queries.join(lists, "query").select("vec", "askers", "found"), "lists")
    answered = join_groups(asked.select(F.col("id").alias("query_id"), "vec"), lists, ["vec"], "askers", asked.count())
    others = F.slice(F.filter("found", lambda f: f["id"] != F.col("query_id")), 1, k)
    ranked = answered.where("found is not null").select("query_id", F.posexplode(others).alias("pos", "f"))
    return ranked.select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("f.id").alias("id"), (F.lit(0.0) - F.col("f.cost")).alias("score"))
