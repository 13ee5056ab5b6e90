"""Toxicity by cumulative-link ordinal regression on sparse text features.

Labels say toxic or not; grades refine them: 0 is clean, and toxic training texts are graded 1 to 3 by thirds of the share of
their words that hold a toxic term. Terms for grading are not the model's: the sample is cut into two folds, and each is graded
by terms chosen on the other alone. The model shares one weight vector across the ordered thresholds,

    P(grade <= k) = logistic(theta_k - w . x),   theta_1 < theta_2 < theta_3,

and gives the expected severity, the sum of P(grade >= k). Features are log counts of ``TERMS`` terms: words and word
beginnings of 3 to 6 letters (inflected and compounded forms share them), chosen by their log-likelihood ratio with
the label.

Scale: terms and weights are learned from at most ``SAMPLE`` labelled training rows (a documented parameter), taken in
hash order; scoring is one map over whole texts without a shuffle. Tasks that count terms hand them on once ``FLUSH`` are held.

Edge cases: null or empty text has no features; several labels of one id count as toxic if any is; without toxic
training rows nothing is flagged; repeated rows are scored alike, and of an id's texts the least one takes part in the fit; a
null id is held out; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, hash_sample, id_crc, text_or_empty

SAMPLE = 20_000
TERMS = 2048
LEAST_TEXTS = 4
FLUSH = 300_000
SHORTEST, LONGEST = 3, 6
GRADES = 3
STEPS = 800
THRESHOLD = 0.5
HELD_OUT_MOD = 5
WORD = re.compile(r"\w+")


def terms_of(word: str) -> list[str]:
    """The word (marked by a closing blank) and its beginnings."""
    return [word[:n] for n in range(SHORTEST, min(LONGEST, len(word)) + 1)] + [word + " "]


def openings_of(terms: list[str]) -> set[str]:
    """First letters of the words that may hold a term; words shorter than ``SHORTEST`` are whole."""
    return {t.rstrip()[:SHORTEST] for t in terms}


def hit_share(text: str, index: dict[str, int], openings: set[str]) -> float:
    """Share of a text's words that hold an indexed term."""
    return term_hits(text, index, openings)[1] / max(1, len(WORD.findall(text)))


def term_hits(text: str, index: dict[str, int], openings: set[str]) -> tuple[Counter, int]:
    """Counts of the indexed terms, and the number of words that hold any."""
    counts: Counter = Counter()
    hits = 0
    for word in WORD.findall(text.lower()):
        if word[:SHORTEST] in openings:
            found = [index[t] for t in terms_of(word) if t in index]
            counts.update(found)
            hits += bool(found)
    return counts, hits


def choose_terms(texts: DataFrame, n_toxic: int, n_clean: int, terms: int = TERMS) -> list[str]:
    """texts (text, toxic) -> the terms most associated with toxic texts, by log-likelihood ratio of text counts."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: tuple[Counter, Counter] = (Counter(), Counter())

        def handed(toxic: int) -> pd.DataFrame:
            counter = held[toxic]
            out = pd.DataFrame({"term": list(counter), "bad": [n * toxic for n in counter.values()], "good": [n * (1 - toxic) for n in counter.values()]})
            counter.clear()
            return out

        for pdf in batches:
            for text, toxic in zip(pdf.text, pdf.toxic, strict=True):
                held[bool(toxic)].update({t for w in set(WORD.findall(text.lower())) for t in terms_of(w)})
                if len(held[bool(toxic)]) > FLUSH:
                    yield handed(int(toxic))
        yield handed(0)
        yield handed(1)

    both = texts.mapInPandas(count, "term string, bad long, good long").groupBy("term").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    total = float(n_toxic + n_clean)
    seen = F.col("bad") + F.col("good")
    part = lambda n, expected: F.when(n > 0, n * F.log(n / expected)).otherwise(F.lit(0.0))
    ratio = (
        part(F.col("bad"), seen * (n_toxic / total)) + part(F.col("good"), seen * (n_clean / total))
        + part(n_toxic - F.col("bad"), (total - seen) * (n_toxic / total)) + part(n_clean - F.col("good"), (total - seen) * (n_clean / total))
    )
    associated = both.where((F.col("bad") >= LEAST_TEXTS) & (F.col("bad") * n_clean > 2 * F.col("good") * n_toxic))
    return [r.term for r in associated.orderBy(ratio.desc(), "term").limit(terms).select("term").collect()]


@dataclass
class OrdinalModel:
    """Shared weights and ordered thresholds."""

    weights: np.ndarray
    thresholds: np.ndarray

    def above(self, rows: np.ndarray, cols: np.ndarray, x: np.ndarray, n: int) -> np.ndarray:
        """P(grade >= k) for k = 1.. of n texts given as sparse triples."""
        z = np.bincount(rows, self.weights[cols] * x, n) if len(rows) else np.zeros(n)
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - z[:, None], -60, 60)))


def fit_ordinal(rows: np.ndarray, cols: np.ndarray, x: np.ndarray, grades: np.ndarray, width: int, steps: int = STEPS, rate: float = 0.05, decay: float = 1e-5) -> OrdinalModel:
    """Maximum likelihood by full-batch gradient descent; thresholds are a first one plus positive gaps."""
    n, k = len(grades), GRADES
    w, raw = np.zeros(width), np.r_[1.0, np.zeros(k - 1)]
    m, v = np.zeros(width + k), np.zeros(width + k)
    at = np.arange(n)
    for t in range(1, steps + 1):
        gaps = np.exp(raw[1:])
        theta = raw[0] + np.r_[0, np.cumsum(gaps)]
        z = np.bincount(rows, w[cols] * x, n)
        below = np.c_[np.zeros(n), 1 / (1 + np.exp(np.clip(z[:, None] - theta[None, :], -60, 60))), np.ones(n)]
        p = np.maximum(below[at, grades + 1] - below[at, grades], 1e-12)
        slope = below * (1 - below)  # of each cumulative probability by its threshold; 0 at both ends
        d_upper, d_lower = -slope[at, grades + 1] / p, slope[at, grades] / p
        d_theta = np.array([(d_upper[grades == j].sum() + d_lower[grades == j + 1].sum()) / n for j in range(k)])
        d_z = -(d_upper + d_lower) / n
        g_raw = np.r_[d_theta.sum(), [d_theta[j:].sum() * gaps[j - 1] for j in range(1, k)]]
        g = np.r_[np.bincount(cols, d_z[rows] * x, width) + decay * w, g_raw]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, raw = w - step[:width], raw - step[width:]
    return OrdinalModel(w, raw[0] + np.r_[0, np.cumsum(np.exp(raw[1:]))])


def sparse(found: list[tuple[list[int], list[int]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rows = np.repeat(np.arange(len(found)), [len(c) for c, _ in found])
    cols = np.array([i for c, _ in found for i in c], np.int64)
    return rows, cols, np.log1p(np.array([n for _, c in found for n in c], np.float64))


def train(docs: DataFrame, labels: DataFrame, scratch: Scratch, sample: int = SAMPLE, terms: int = TERMS) -> tuple[OrdinalModel, list[str]]:
    """docs (id, text, held_out); learns only from rows that are not held out."""
    votes = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg((F.max("toxic") > 0).alias("toxic"))
    chosen = hash_sample(votes.where(id_crc("doc_id") % HELD_OUT_MOD != 0), "doc_id", 0, sample)
    rows = docs.join(F.broadcast(chosen), docs.id == chosen.doc_id).where(~F.col("held_out"))  # at most `sample` rows
    fold = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(2)).cast("int")
    one = rows.groupBy("id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")).withColumn("fold", fold)
    texts = scratch.save(one.select("text", "toxic", "fold"), "sample")
    size = {(r.fold, bool(r.toxic)): int(r.n) for r in texts.groupBy("fold", "toxic").agg(F.count("*").alias("n")).collect()}
    count = lambda toxic, *folds: sum(size.get((f, toxic), 0) for f in folds)
    vocabulary = choose_terms(texts, count(True, 0, 1), count(False, 0, 1), terms) if count(True, 0, 1) else []
    if not vocabulary:
        return OrdinalModel(np.zeros(0), np.full(GRADES, 60.0)), []
    listed = lambda ts: ({t: i for i, t in enumerate(ts)}, openings_of(ts))
    index, openings = listed(vocabulary)
    others = [listed(choose_terms(texts.where(F.col("fold") == 1 - f), count(True, 1 - f), count(False, 1 - f), terms) if count(True, 1 - f) else []) for f in (0, 1)]

    def compute(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [term_hits(t, index, openings)[0] for t in pdf.text]
            shares = [hit_share(t, *others[f]) if toxic else 0.0 for t, toxic, f in zip(pdf.text, pdf.toxic, pdf.fold, strict=True)]
            yield pd.DataFrame({"toxic": pdf.toxic, "cols": [sorted(c) for c in found], "counts": [[c[i] for i in sorted(c)] for c in found], "share": shares})

    got = texts.mapInPandas(compute, "toxic boolean, cols array<int>, counts array<int>, share double").collect()
    got.sort(key=lambda r: (r.toxic, r.share, list(r.cols), list(r.counts)))
    toxic, shares = np.array([r.toxic for r in got]), np.array([r.share for r in got])
    cuts = np.quantile(shares[toxic], np.arange(1, GRADES) / GRADES)
    grades = np.where(toxic, 1 + np.searchsorted(cuts, shares, "left"), 0)
    triples = sparse([(r.cols, r.counts) for r in got])
    return fit_ordinal(*triples, grades, len(vocabulary)), vocabulary


def severity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE, terms: int = TERMS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, held_out, expected_severity (0 to 3), grade (likeliest), score (P(grade >= 1)), predicted."""
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"), (id_crc(id_col) % HELD_OUT_MOD == 0).alias("held_out"))
    model, vocabulary = train(rows, labels, Scratch(docs.sparkSession, "toxic"), sample, terms)
    index, openings = {t: i for i, t in enumerate(vocabulary)}, openings_of(vocabulary)

    def compute(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [term_hits(t, index, openings)[0] for t in pdf.text]
            above = model.above(*sparse([(list(c), list(c.values())) for c in found]), len(pdf))
            steps = np.c_[np.ones(len(pdf)), above, np.zeros(len(pdf))]
            yield pd.DataFrame({
                "id": pdf.id, "held_out": pdf.held_out, "expected_severity": above.sum(1), "grade": np.argmax(steps[:, :-1] - steps[:, 1:], 1).astype(np.int32),
                "score": above[:, 0], "predicted": (above[:, 0] >= threshold).astype(np.int32),
            })

    scored = rows.withColumn("id", F.col("id").cast("string")).mapInPandas(  # a null among numbers would make pandas round them
        compute, "id string, held_out boolean, expected_severity double, grade int, score double, predicted int"
    )
    return scored.withColumn("id", F.col("id").cast(dict(rows.dtypes)["id"]))
