import math
import random
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cairn.functions import text as T
from cairn.operators import rank, route
from cairn.operators.index import hashed_words, invariant_report, invert, require_valid
from cairn.operators.retrieve import planned, retrieve

TEXTS = ["dark energy equation of state", "exoplanet transit photometry", "hubble constant cepheid calibration"]


@pytest.fixture(scope="module")
def chunks(spark):
    return spark.createDataFrame([(i, f"p::{i}", f"p{i}", f"t{i}", "Results", t) for i, t in enumerate(TEXTS)], "chunk_idx long, chunk_id string, paper_id string, title string, section string, text string")


@pytest.fixture(scope="module")
def vectors(spark):
    return spark.createDataFrame([(i, [float(i == j) for j in range(3)]) for i in range(3)], "chunk_idx long, vec array<float>")


def test_dense_and_lexical(spark, chunks, vectors):
    q = spark.createDataFrame([(1, [0.0, 1.0, 0.0])], "query long, vec array<float>")
    assert rank.dense_top_k(vectors, q, 1).first().chunk_idx == 1
    asked = spark.createDataFrame([(1, "cepheid hubble")], "query long, text string")
    top = rank.bm25_top_k(invert(chunks), asked, chunks, 3).orderBy("rank").collect()
    assert [r.chunk_idx for r in top] == [2, 0, 1] and top[1].score == 0.0


def test_bm25_against_a_direct_count(spark):
    texts = ["a b a c", "b c d", "a a a", "e", ""]
    chunks = spark.createDataFrame(list(enumerate(texts)), "chunk_idx long, text string")
    docs = [t.split() for t in texts]
    n, avg = len(docs), sum(map(len, docs)) / len(docs)
    df = Counter(t for d in docs for t in set(d))
    raw = {t: math.log(n - f + 0.5) - math.log(f + 0.5) for t, f in df.items()}
    mean = sum(raw.values()) / len(raw)
    idf = {t: v if v >= 0 else 0.25 * mean for t, v in raw.items()}
    want = {}
    for i, d in enumerate(docs):
        s = sum(idf[t] * d.count(t) * 2.5 / (d.count(t) + 1.5 * (0.25 + 0.75 * len(d) / avg)) for t in ["a", "a", "d"] if t in d)
        if any(t in d for t in "ad"):
            want[i] = s
    got = rank.bm25_scores(invert(chunks), spark.createDataFrame([(7, "a A d zzz")], "query long, text string"))
    assert {r.chunk_idx: r.score for r in got.collect()} == pytest.approx(want)


@pytest.mark.parametrize("docs, asked_at_once", [(1024, 512), (3, 2)])
def test_scan_has_the_best_of_the_postings(spark, docs, asked_at_once):
    """In batches of any size, over copies and ties, and filled with chunks that share nothing, smallest first."""
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choices("abcdefgh", k=rng.randrange(7)))) for i in rng.sample(range(100), 60)]
    chunks, asked = spark.createDataFrame(rows, "chunk_idx long, text string").repartition(3), [(n, t) for n, t in enumerate(("a b", "A a c", "zz", "", "h g f"))]
    index = invert(chunks)
    want = {(r.query, r.chunk_idx): r.score for r in rank.bm25_scores(index, spark.createDataFrame(asked, "query long, text string")).collect()}
    idf = {r.term: r.idf for r in index.terms.collect()}
    named = [(str(q), {t: n * idf[t] for t, n in Counter(text.lower().split()).items() if t in idf}) for q, text in asked]
    rank_docs, rank_asked, rank._DOCS, rank._ASKED = rank._DOCS, rank._ASKED, docs, asked_at_once
    try:
        got = pd.concat(rank._best_of_scan(named, index.corpus.first().avgdl, 5)(iter([pd.DataFrame(rows[:20], columns=["chunk_idx", "words"]), pd.DataFrame(rows[20:], columns=["chunk_idx", "words"])])))
    finally:
        rank._DOCS, rank._ASKED = rank_docs, rank_asked
    plan = {(r.query, r.rank): (r.chunk_idx, r.score) for r in rank.bm25_top_k(index, spark.createDataFrame(asked, "query long, text string"), chunks, 5).collect()}
    for q, _ in asked:
        best = sorted((-round(want.get((q, i), 0.0), 9), i) for i, _ in rows)[:5]
        assert [(-s, i) for s, i in zip(got.score[got["query"] == str(q)], got.chunk_idx[got["query"] == str(q)])] == [pytest.approx(b) for b in best]
        assert [(-plan[q, r][1], plan[q, r][0]) for r in range(1, 6)] == [pytest.approx(b) for b in best]


def test_top_k_edges(spark):
    scores = spark.createDataFrame([(1, 0, 1.0), (1, 1, 2.0), (1, 2, 2.0)], "query long, chunk_idx long, score double")
    assert rank.top_k(scores, 0).count() == 0
    assert rank.top_k(scores.where("false"), 5).count() == 0
    assert [r.chunk_idx for r in rank.top_k(scores, 2).orderBy("rank").collect()] == [1, 2]


def test_fusion_keeps_first_appearance_on_ties(spark):
    rows = [(1, 0, d, r) for r, d in enumerate([1, 2, 3], 1)] + [(1, 1, d, r) for r, d in enumerate([3, 2, 9], 1)]
    got = rank.fuse(spark.createDataFrame(rows, "query long, list_no int, chunk_idx long, rank int")).orderBy("rank").collect()
    assert [r.chunk_idx for r in got] == [3, 2, 1, 9]
    assert got[0].score == pytest.approx(1 / 63 + 1 / 61)


def test_pool_order(spark):
    rows = [(1, 0, 5, 1), (1, 0, 6, 2), (1, 1, 7, 1), (1, 1, 5, 2)]
    pooled = rank.pool(spark.createDataFrame(rows, "query long, sub int, chunk_idx long, rank int")).orderBy("place").collect()
    assert [r.chunk_idx for r in pooled] == [5, 6, 7]


def test_retrieval_by_strategy(spark, chunks, vectors):
    routed = spark.createDataFrame([(1, "hubble constant"), (2, "transit photometry")], "query long, text string")
    routed = routed.withColumn("route", F.when(F.col("query") == 1, route.fixed("SIMPLE")).otherwise(route.fixed("MULTI_HOP")))
    q = spark.createDataFrame([(1, [1.0, 0.0, 0.0]), (2, [0.0, 0.0, 1.0])], "query long, vec array<float>")
    subs = spark.createDataFrame([(2, 0, "transit"), (2, 1, "photometry")], "query long, sub int, text string")
    got = retrieve(routed, subs, invert(chunks), chunks, vectors, q)
    best = {r.query: r.chunk_idx for r in got.where("rank = 1").collect()}
    assert best == {1: 0, 2: 1}  # dense alone for the simple route, reranked for the other
    cites = rank.citations(got, chunks).where("query = 2 and n = 1").first()
    assert (cites.chunk_id, cites.paper_id) == ("p::1", "p1")
    assert rank.context(got, chunks).where("query = 1").first().context.startswith("[1] (t0 - Results)\ndark energy")


def test_unknown_strategy_is_an_error(spark):
    routed = spark.createDataFrame([(1, "x")], "query long, text string").withColumn("route", route.fixed("NONE"))
    with pytest.raises(Exception, match="unknown strategy"):
        planned(routed).collect()


@pytest.mark.parametrize("text, label, confidence", [("What is H0?", "SIMPLE", 0.7), ("Compare A.", "MULTI_HOP", 0.55), ("Compare A versus B across C", "MULTI_HOP", 0.8), ("How does it evolve?", "SIMPLE", 0.7)])
def test_heuristic(spark, text, label, confidence):
    r = spark.range(1).select(route.heuristic(F.lit(text)).alias("r")).first().r
    assert (r.label, r.confidence) == (label, confidence)


def test_reply_and_escalation(spark):
    read = lambda t: spark.range(1).select(route.llm_reply(F.lit(t)).alias("r")).first().r
    assert (read('{"label": "SIMPLE", "confidence": 2}').confidence, read('{"label": "X"}').source) == (1.0, "llm:parse_fail")
    assert read('{"label": "SIMPLE", "confidence": "NaN"}').label == "UNCERTAIN"
    r = spark.range(1).select(route.escalating(route.heuristic(F.lit("Compare A.")), route.fixed("UNCERTAIN")).alias("r")).first().r
    assert (r.label, r.escalated, r.source) == ("UNCERTAIN", True, "fixed:UNCERTAIN (escalated from heuristic)")


def test_oracle_misses_are_errors(spark):
    asked, known = spark.createDataFrame([(1, "A  b")], "query long, text string"), spark.createDataFrame([("a B", "SIMPLE")], "question string, label string")
    assert route.oracle(asked, known).first().route.label == "SIMPLE"
    with pytest.raises(Exception, match="no oracle label"):
        route.oracle(asked, known.where("false")).collect()
    with pytest.raises(ValueError):
        route.routed(spark.createDataFrame([(1, "x")], "query long, text string"), "compass")


def test_index_invariants(spark, chunks, vectors):
    assert invariant_report(chunks, vectors).first().valid
    assert invariant_report(chunks, vectors.where("chunk_idx > 0")).first().n_misaligned == 1
    for bad in (chunks.where("false"), chunks.unionByName(chunks.limit(1))):
        with pytest.raises(ValueError):
            require_valid(bad, vectors)


def test_encoder_counts_tokens_and_leaves_nulls(spark):
    got = spark.createDataFrame([(0, "a b A"), (1, ""), (2, None)], "i int, t string").select("i", hashed_words(16)(F.col("t")).alias("v")).orderBy("i").collect()
    assert sum(got[0].v) == 3 and max(got[0].v) >= 2 and sum(got[1].v) == 0 and got[2].v is None


def test_terms_and_lengths_of_one_cut(spark, tmp_path):
    """Chunks without tokens and text in other scripts: terms and lengths as counted by hand, and the tokens of a written index are cut in one place."""
    texts = ["b a a", "", "  --  ", "A İstanbul naïve_1 ²x", "a\x1cb c", "你好 a", "straße ΣΑΣ ab"]
    rows = spark.createDataFrame(list(enumerate(texts)), "chunk_idx long, text string").repartition(2)
    cut = [r.ts for r in rows.select(T.tokens(F.col("text")).alias("ts")).collect()]
    for index in (invert(rows), invert(rows, f"file://{tmp_path}/index")):
        assert {r.term: r.df for r in index.terms.collect()} == Counter(t for ts in cut for t in set(ts))
        assert index.corpus.first().asDict() == {"n": len(texts), "avgdl": sum(map(len, cut)) / len(texts)}
    assert sum(r.own for r in spark.read.parquet(f"file://{tmp_path}/index/counted").collect()) == sum(map(len, cut))
    none = invert(rows.where("false")).corpus.first()
    assert (none.n, none.avgdl) == (0, None)


def test_summands_of_a_scan_in_pieces(monkeypatch):
    """Sums over shared terms equal the product of whole matrices, also where the summands are cut into pieces."""
    draw = np.random.default_rng(3)
    weight = draw.random((7, 5)) * (draw.random((7, 5)) < 0.6)
    part = draw.random((6, 7)) * (draw.random((6, 7)) < 0.5)
    doc, term = np.nonzero(part)
    t, q = np.nonzero(weight)
    for pairs in (1, 4, 1 << 20):
        monkeypatch.setattr(rank, "_PAIRS", pairs)
        got = rank._shared_terms(doc, term, part[doc, term], (6, 5), np.searchsorted(t, np.arange(8)), q, weight[t, q])
        assert np.allclose(got, part @ weight)
