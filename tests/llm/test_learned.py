"""Toxicity, class language model and quality: held-out accuracy, counts against brute force, edges."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest

from cairn.llm import class_lm, quality, queries, toxicity

from .conftest import pairs

LABELS = "doc_id long, quality int, toxic int, text string"


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0, "x"), (2, 1, 0, "x"), (4, 0, 1, "x"), (4, 1, 1, "x"), (10, None, None, "x"), (None, 1, 1, "x"), (99, 1, 1, "x")], LABELS)


def ranking(rows, label):
    """Area under the curve."""
    good, bad = [r.score for r in rows if label[r.doc_id]], [r.score for r in rows if not label[r.doc_id]]
    return np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    rows = queries.op9_quality_pu(spark, sf).collect()
    assert len(rows) == 1000 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [r for r in rows if r.held_out and r.doc_id in label]
    kept = [r.predicted for r in held if label[r.doc_id]]
    assert ranking(held, label) > 0.95 and np.mean(kept) > 0.9


def test_quality_edges(spark, edge_docs, no_docs, labels):
    rows = quality.quality_scores(edge_docs, labels).collect()
    assert len(rows) == edge_docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert quality.quality_scores(no_docs, labels).count() == 0 and quality.quality_filter(no_docs, labels).columns == no_docs.columns
    none = quality.quality_scores(edge_docs, labels.where("false")).collect()
    assert {round(r.score, 6) for r in none} == {0.5}
    assert quality.quality_filter(edge_docs, labels.where("false")).count() == edge_docs.count()


def test_the_filter_agrees_with_the_scores(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    kept = {r.doc_id for r in quality.quality_filter(docs, labels).select("doc_id").collect()}
    assert kept == {r.id for r in quality.quality_scores(docs, labels).where("predicted = 1").collect()}


def test_pu_risk_finds_negatives_without_labels():
    rng = np.random.default_rng(0)
    good, bad = rng.normal(0, 1, (3000, 2)), rng.normal(4, 1, (400, 2))
    model = quality.fit_pu(good[:1500], np.r_[good[1500:], bad], prior=1500 / 1900)
    assert (model.score(good[1500:]) >= 0.3).mean() > 0.95 and (model.score(bad) < 0.3).mean() > 0.8


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    rows = queries.op4_toxicity_severity(spark, sf).collect()
    label = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [r for r in rows if r.held_out and r.doc_id in label]
    caught = np.mean([r.predicted for r in held if label[r.doc_id]])
    wrong = np.mean([r.predicted for r in held if not label[r.doc_id]])
    assert len(rows) == 10_000 and caught > 0.9 and wrong < 0.01
    assert all(0 <= r.expected_severity <= 3 and r.predicted == (r.score >= 0.5) for r in rows)


def test_toxicity_edges(spark, edge_docs, no_docs, labels):
    rows = toxicity.severity(edge_docs, labels).collect()
    assert len(rows) == edge_docs.count()
    assert toxicity.severity(no_docs, labels).count() == 0
    assert not any(r.predicted for r in toxicity.severity(edge_docs, labels.where("false")).collect())


def test_ordinal_gradient_and_order():
    rng = np.random.default_rng(0)
    strength = rng.integers(0, 4, 600)
    rows, x = np.arange(600), strength + rng.normal(0, 0.2, 600)
    model = toxicity.fit_ordinal(rows, np.zeros(600, int), x, strength, 1, steps=600)
    above = model.above(rows, np.zeros(600, int), x, 600)
    assert (np.diff(model.thresholds) > 0).all() and (np.diff(above, axis=1) <= 1e-12).all()
    assert np.corrcoef(above.sum(1), strength)[0, 1] > 0.95


def base_scores(docs):
    held = {i: zlib.crc32(str(d if d is not None else "").encode()) % 7 == 2 for i, (d, _) in enumerate(docs)}
    lines = [t.encode().lower().split() for _, t in docs]
    c = Counter()
    for i, w in enumerate(lines):
        if not held[i]:
            c.update(w)
            c[None] += 1
    n, v = sum(c.values()), len(c)
    return [(d, held[i], len(lines[i]) + 1, sum(c[w] > 0 for w in [*lines[i], None]), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in [*lines[i], None])) for i, (d, _) in enumerate(docs)]


@pytest.mark.parametrize("head", [1 << 17, 8])
def test_lm_counts_against_brute_force(spark, edge_docs, monkeypatch, head):
    monkeypatch.setattr(class_lm, "HEAD_WORDS", head)
    got = sorted(((r.id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in class_lm.score_texts(edge_docs).collect()), key=repr)
    want = sorted(base_scores(pairs(edge_docs)), key=repr)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert [g[5] for g in got] == pytest.approx([w[5] for w in want])


def test_lm_beats_the_base_on_held_out_texts(spark):
    sf = "/root/testdata/sf0.01"
    rows = queries.op6_class_lm(spark, sf).collect()
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held) and all(r.score < 0 for r in rows)


def test_lm_is_a_distribution():
    """Transitions sum to one, and so do the emissions of a class with its unseen words as one event."""
    rng = np.random.default_rng(0)
    bigrams = rng.integers(0, 5, (40, 40))
    sizes = np.ones(40, np.int64)
    model = class_lm.ClassModel.fit(bigrams, sizes, classes=6, sweeps=3)
    assert np.allclose((10**model.transition).sum(1), 1) and model.own[39] == 0 and (model.own[:39] > 0).all()
    for k in range(6):
        own = model.own == k
        assert ((bigrams.sum(0)[own] + 1).sum() + 1) / 10 ** model.emission[k] == pytest.approx(1)


def test_exchange_raises_the_likelihood():
    rng = np.random.default_rng(1)
    kind = np.arange(60) % 3
    bigrams = np.where((kind[:, None] + 1) % 3 == kind[None, :], rng.integers(20, 40, (60, 60)), 0)
    own = class_lm.exchange_classes(bigrams, classes=4)
    assert all(len(set(own[:59][kind[:59] == k])) == 1 for k in range(3)) and len(set(own[:59])) == 3


def test_lm_empty(spark, no_docs):
    assert class_lm.score_texts(no_docs).count() == 0


@pytest.mark.parametrize("head", [1 << 17, 900])
def test_lm_clusters_every_frequent_word(spark, monkeypatch, head):
    """Words of two kinds that take turns, with endings that say nothing of the kind: all with a count over the limit are told apart, beyond the 768."""
    monkeypatch.setattr(class_lm, "HEAD_WORDS", head)
    rng = np.random.default_rng(0)
    words = [[f"{kind}{i}x" for i in range(600)] for kind in "ab"]
    # the first 300 of each kind are the more frequent ones
    share = np.where(np.arange(600) < 300, 2.0, 1.0) / 900
    docs = [(i, " ".join(words[k % 2][j] for k, j in enumerate(rng.choice(600, 400, p=share)))) for i in range(1400)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    rows = df.selectExpr("cast(text as binary) text")
    scratch = class_lm.Scratch(spark, "test")
    counts = class_lm.word_counts(rows, scratch)
    assert counts.clustered == 1200 and len(counts.tail) == (0 if head > 1200 else 1200 - counts.n_head)
    coder = spark.sparkContext.broadcast(class_lm.Coder(counts.head, counts.n_head, counts.tail))
    model = class_lm.cluster(rows, counts, coder, scratch, classes=3)
    of = [{int(model.own[coder.value([w.encode()])[1][0]]) for w in kind} for kind in words]
    assert len(of[0]) == len(of[1]) == 1 and of[0] != of[1]


def test_many_words_step_as_one():
    """The step of many words is that of the one-at-a-time exchange, by the likelihood itself."""
    rng = np.random.default_rng(2)
    b, classes = rng.integers(0, 9, (30, 30)), 5
    own = np.r_[rng.integers(1, classes, 29), 0]
    member = np.eye(classes)[own]
    got = class_lm.best_classes(member.T @ b @ member, (b @ member)[:29], (b.T @ member)[:29], np.diag(b)[:29], own[:29])
    for w in range(29):
        gains = []
        for k in range(1, classes):
            m = np.eye(classes)[np.r_[own[:w], k, own[w + 1 :]]]
            gains.append(class_lm.likelihood(m.T @ b @ m))
        assert gains[got[w] - 1] == pytest.approx(max(gains))


def test_whole_words_of_one_or_two_letters_are_met(spark):
    terms = ["ab ", "毒 ", "long"]
    counts, hits = toxicity.term_hits("AB abc 毒 b longer", {t: i for i, t in enumerate(terms)}, toxicity.openings_of(terms))
    assert counts == {0: 1, 1: 1, 2: 1} and hits == 3
    docs = spark.createDataFrame([(i, f"plain words{i % 7} {'zq' if i % 2 else 'no'} here") for i in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(200)], LABELS.replace(", text string", ""))
    rows = toxicity.severity(docs, labels).collect()
    assert all(r.predicted == r.id % 2 for r in rows)


def test_quality_and_toxicity_scores_by_hand(spark, sf, small_docs):
    """The distributed scores are those of the fitted models, recomputed one text at a time in plain Python."""
    given = spark.read.parquet(f"{sf}/labels.parquet")
    texts = dict(pairs(small_docs))
    model = quality.train(quality.inputs(small_docs, "doc_id", "text"), given)
    for r in quality.quality_scores(small_docs, given).limit(40).collect():
        t = texts[r.id].encode()
        z = model.bias + sum(model.weights[np.searchsorted(e, np.float32(x), "right") + j * (len(e) + 1)] for j, (e, x) in enumerate(zip(model.edges, quality.features(t), strict=True)))
        shares = Counter((((t[i] << 16) + (t[i + 1] << 8) + t[i + 2]) * 2654435761 % (1 << 32)) >> 22 for i in range(len(t) - 2))
        z += sum(math.sqrt(n / (len(t) - 2)) * quality.GRAM_SCALE * model.gram_weights[b] for b, n in shares.items())
        assert r.score == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-5)

    rows = small_docs.selectExpr("doc_id id", "coalesce(text, '') text", "crc32(cast(doc_id as string)) % 5 = 0 held_out")
    ordinal, vocabulary = toxicity.train(rows, given, toxicity.Scratch(spark, "test"))
    place = {t: i for i, t in enumerate(vocabulary)}
    for r in toxicity.severity(small_docs, given).limit(40).collect():
        counts = Counter(place[t] for w in toxicity.WORD.findall(texts[r.id].lower()) for t in toxicity.terms_of(w) if t in place)
        z = sum(ordinal.weights[i] * math.log1p(n) for i, n in counts.items())
        assert r.expected_severity == pytest.approx(sum(1 / (1 + math.exp(min(60, max(-60, k - z)))) for k in ordinal.thresholds))


def test_the_ordinal_fit_is_a_minimum():
    """No small change of a weight or threshold raises the likelihood, which is written out here case by case."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 3))
    grades = np.clip(np.round(x @ [1.0, -0.5, 0.2] + rng.normal(size=300) + 1), 0, 3).astype(int)
    rows, cols = np.repeat(np.arange(300), 3), np.tile(np.arange(3), 300)
    model = toxicity.fit_ordinal(rows, cols, x.ravel(), grades, 3, steps=4000, rate=0.02, decay=0.0)

    def likelihood(w, th):
        total = 0.0
        for xi, g in zip(x, grades, strict=True):
            below = [0.0, *(1 / (1 + math.exp(-(k - xi @ w))) for k in th), 1.0]
            total += math.log(below[g + 1] - below[g])
        return total

    best = likelihood(model.weights, model.thresholds)
    for i in range(6):
        for step in (-0.02, 0.02):
            theta = np.r_[model.weights, model.thresholds]
            theta[i] += step
            assert likelihood(theta[:3], theta[3:]) < best + 1e-3
