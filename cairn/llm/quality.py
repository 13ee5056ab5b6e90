"""Quality classifier by positive-unlabelled learning with the non-negative unbiased risk estimator.

Trusted positives are labelled rows of quality 1, the unlabelled set is web text without its labels, and the class
prior is estimated from the labelled training rows. A logistic model over the shape of the whole text (shares of byte classes,
repetition of words and lines, word lengths; each cut into bins) and over its byte trigrams (roots of their shares, hashed
into ``GRAMS`` buckets) is fitted by full-batch gradient descent on

    prior * R_p(+) + max(0, R_u(-) - prior * R_p(-))

where the step is reversed while the second term is below zero by more than ``SLACK`` (the estimator's tolerance
for sampling noise).

Scale: the ids of the fit's bounded samples (``SAMPLE`` positives and ``SAMPLE`` unlabelled rows, by hash order, documented
parameters) are drawn first, from ids alone; only their texts are read for the fit, and then every text once to be scored.

Edge cases: null text counts as empty and is scored like any other; several labels of one id count as their mean,
1 from one half on; without positives every score is the prior (0.5 with no labels at all); repeated rows are
scored alike, and of an id's texts the least one takes part in the fit; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hash_sample, id_crc, small_batches, text_or_empty

#: Positives, and unlabelled rows, that the fit takes at most.
SAMPLE = 10_000
#: Quantiles that part the bins of a feature.
CUTS = np.r_[0, 0.005, 0.01, 0.02, 0.05, np.linspace(0.1, 0.9, 9), 0.95, 0.98, 0.99, 0.995]
STEPS = 800
#: Buckets of hashed byte trigrams (a power of two), the scale of their values beside the bins, and the decay of their weights.
GRAMS, GRAM_SCALE, GRAM_DECAY = 1 << 10, 4.0, 1e-3
#: How far below zero sampling noise may take the estimated risk of the negatives before the step is reversed.
SLACK = 0.005
THRESHOLD = 0.3
HELD_OUT_MOD = 5

#: Byte classes whose share of the text is a feature.
CLASSES = {
    "upper": bytes(range(65, 91)), "digit": b"0123456789", "space": b" \t\r\x0b\x0c", "line": b"\n", "mark": b"#$%&*@^~=+_",
    "cry": b"!?", "bar": b"|<>/\\", "bracket": b"()[]{}", "stop": b".,;:", "quote": b"\"'`-", "high": bytes(range(128, 256)),
}
N_FEATURES = len(CLASSES) + 8


def features(text: bytes) -> list[float]:
    """Shape of a whole text: shares of byte classes, then word and line statistics."""
    n = len(text)
    words, lines = text.split(), text.split(b"\n")
    n_words, size = len(words), max(n, 1)
    shares = [(n - len(text.translate(None, c))) / size for c in CLASSES.values()]
    distinct = len(set(words))
    capitals = sum(map(bytes.isupper, words))
    repeats = sum(a == b for a, b in zip(words, words[1:], strict=False))
    w = max(n_words, 1)
    return shares + [
        np.log1p(n), distinct / w, distinct / w**0.8, capitals / w, repeats / w,
        1 - len(set(lines)) / len(lines), sum(map(len, words)) / w, len(lines) / w,
    ]


def grams(text: bytes) -> np.ndarray:
    """Roots of the shares of a whole text's byte trigrams, by bucket."""
    b = np.frombuffer(text, np.uint8).astype(np.uint32)
    if len(b) < 3:
        return np.zeros(GRAMS, np.float32)
    code = (b[:-2] << np.uint32(16)) + (b[1:-1] << np.uint32(8)) + b[2:]
    bucket = (code * np.uint32(2654435761)) >> np.uint32(33 - GRAMS.bit_length())
    return np.sqrt(np.bincount(bucket, minlength=GRAMS) / len(code)).astype(np.float32)


def inputs(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id as text, held_out, text as bytes); as text, for a null among numbers would make pandas round them."""
    return docs.select(F.col(id_col).cast("string").alias("id"), (id_crc(id_col) % HELD_OUT_MOD == 0).alias("held_out"), text_or_empty(text_col).cast("binary").alias("text"))


def encoded(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Shape and trigram features of some texts."""
    x = np.array([features(t) for t in texts], np.float32).reshape(len(texts), N_FEATURES).astype(np.float64)
    return x, np.array([grams(t) for t in texts], np.float32).reshape(len(texts), GRAMS)


@dataclass
class PuModel:
    """Bin edges and weights; ``score`` is the probability of label 1."""

    edges: np.ndarray
    weights: np.ndarray
    bias: float
    gram_weights: np.ndarray | None = None

    def encode(self, x: np.ndarray) -> np.ndarray:
        """Index of each feature's weight: one bin of every feature is on."""
        return np.stack([np.searchsorted(e, x[:, j], "right") + j * (len(e) + 1) for j, e in enumerate(self.edges)], 1)

    def score(self, x: np.ndarray, g: np.ndarray | None = None) -> np.ndarray:
        z = self.bias + self.weights[self.encode(x)].sum(1) if len(self.weights) else np.full(len(x), self.bias)
        if g is not None and self.gram_weights is not None:
            z = z + g.astype(np.float64) @ (GRAM_SCALE * self.gram_weights)
        return 1 / (1 + np.exp(-z))

    def of_texts(self, texts: list[bytes]) -> np.ndarray:
        """Scores of whole texts, some at a time."""
        parts = [self.score(*encoded(texts[a : a + 512])) for a in range(0, len(texts), 512)]
        return np.concatenate(parts) if parts else np.zeros(0)


def bin_edges(values: np.ndarray) -> np.ndarray:
    """Quantiles, close together in the tails, of the values above the least: what most texts lack is no bin's bulk."""
    above = values[values > values.min()]
    if not len(above):
        return np.full(len(CUTS), values.min())
    return np.r_[(values.min() + above.min()) / 2, np.quantile(above, CUTS[1:])]


def fit_pu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, pos_grams: np.ndarray | None = None, unl_grams: np.ndarray | None = None,
           steps: int = STEPS, rate: float = 0.05, decay: float = 1e-5, slack: float = SLACK) -> PuModel:
    """Minimises the non-negative PU risk with the logistic loss (full batches, so the fit is deterministic)."""
    if not len(positive) or not len(unlabelled):
        p = min(max(prior, 1e-6), 1 - 1e-6)
        return PuModel(np.zeros((0, 0)), np.zeros(0), float(np.log(p / (1 - p))))
    edges = np.stack([bin_edges(unlabelled[:, j]) for j in range(unlabelled.shape[1])])
    model = PuModel(edges, np.zeros(edges.shape[0] * (edges.shape[1] + 1)), 0.0)
    width, some = len(model.weights), pos_grams is not None and unl_grams is not None
    n_grams = pos_grams.shape[1] if some else 0
    held = lambda g, n: g if some else np.zeros((n, 0), np.float32)
    pos, unl = (model.encode(positive), held(pos_grams, len(positive))), (model.encode(unlabelled), held(unl_grams, len(unlabelled)))
    theta, m, v = (np.zeros(width + 1 + n_grams) for _ in range(3))
    shrink = np.r_[np.full(width, decay), 0.0, np.full(n_grams, GRAM_DECAY)]
    sigmoid = lambda z: 1 / (1 + np.exp(-z))
    loss = lambda z: np.logaddexp(0, -z)
    value = lambda rows: theta[width] + theta[rows[0]].sum(1) + rows[1] @ (GRAM_SCALE * theta[width + 1 :]).astype(np.float32)

    def gradient(rows: tuple[np.ndarray, np.ndarray], slope: np.ndarray) -> np.ndarray:
        bins, g = rows
        own = np.bincount(bins.ravel(), np.repeat(slope, bins.shape[1]), width) / len(bins)
        return np.r_[own, slope.mean(), GRAM_SCALE * (slope.astype(np.float32) @ g) / len(bins)]

    for t in range(1, steps + 1):
        zp, zu = value(pos), value(unl)
        negative = loss(-zu).mean() - prior * loss(-zp).mean()
        g_neg = gradient(unl, sigmoid(zu)) - prior * gradient(pos, sigmoid(zp))
        g = -g_neg if negative < -slack else prior * gradient(pos, -sigmoid(-zp)) + g_neg
        g = g + shrink * theta
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return PuModel(edges, theta[:width], float(theta[width]), theta[width + 1 :] if some else None)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> PuModel:
    """docs (id, held_out, text); fits on training rows, held-out ones give neither labels nor text."""
    votes = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("string").alias("id")).agg((F.avg("quality") >= 0.5).alias("good"))
    ids = docs.where(~F.col("held_out")).select("id").distinct()
    marked = ids.join(votes, "id")
    known = marked.agg(F.avg(F.col("good").cast("double")).alias("prior"), F.count("*").alias("n")).first()
    prior = min(max(float(known.prior), 0.01), 0.99) if known.n else 0.5
    drawn = hash_sample(marked.where("good").select("id"), "id", 1, sample).withColumn("side", F.lit(1)).unionByName(hash_sample(ids, "id", 2, sample).withColumn("side", F.lit(0)))
    rows = docs.select("id", "text").join(F.broadcast(drawn), "id").groupBy("id", "side").agg(F.min("text").alias("text"))  # at most twice `sample` ids

    def compute(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x, g = encoded([bytes(t) for t in pdf.text])
            yield pd.DataFrame({"id": pdf.id, "side": pdf.side, "x": [r.astype(np.float32).tobytes() for r in x], "g": [r.astype(np.float16).tobytes() for r in g]})

    with small_batches(docs.sparkSession):
        got = rows.mapInPandas(compute, "id string, side int, x binary, g binary").collect()
    got.sort(key=lambda r: (r.side, r.id))
    of = lambda side, name, kind, width: np.frombuffer(b"".join(r[name] for r in got if r.side == side), kind).astype(np.float32).reshape(-1, width)
    x, g = [of(side, "x", np.float32, N_FEATURES).astype(np.float64) for side in (1, 0)], [of(side, "g", np.float16, GRAMS) for side in (1, 0)]
    del got
    return fit_pu(x[0], x[1], prior, g[0], g[1])


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, held_out, score (0 to 1, higher: likelier of label 1), predicted (1 from ``threshold`` on)."""
    rows = inputs(docs, id_col, text_col)
    model = train(rows, labels, sample)

    def compute(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            score = model.of_texts([bytes(t) for t in pdf.text])
            yield pd.DataFrame({"id": pdf.id, "held_out": pdf.held_out, "score": score, "predicted": (score >= threshold).astype(np.int32)})

    scored = rows.mapInPandas(compute, "id string, held_out boolean, score double, predicted int")
    return scored.withColumn("id", F.col("id").cast(dict(docs.dtypes)[id_col]))


def quality_filter(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the classifier accepts; each text is scored where it lies, so nothing is joined back."""
    model = train(inputs(docs, id_col, text_col), labels, sample)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(model.of_texts([bytes(t) for t in texts]))

    return docs.where(score(text_or_empty(text_col).cast("binary")) >= threshold)
