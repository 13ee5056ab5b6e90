"""Tokens cut by the table equal those cut by Spark."""

import random

import pandas as pd
from pyspark.sql import functions as F

from cairn.functions import cut
from cairn.functions import text as T
from cairn.operators import index
from cairn.operators.index import invert


def both(spark, texts):
    """(id, tokens by Spark, tokens by the table)"""
    c = cut.cutter(spark)
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t binary").select("i", F.col("t").cast("string").alias("t")).repartition(3)
    ours = rows.select("i", *c.columns(F.col("t"))).mapInPandas(lambda b: (p[["i", "words"]] for p in c.cut(b)), "i int, words string")
    return rows.select("i", T.tokens(F.col("t")).alias("ts")).join(ours, "i").orderBy("i").collect()


def test_every_code_point(spark):
    points = [chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    rng = random.Random(1)
    texts = [" ".join(points[lo : lo + 999]) for lo in range(0, len(points), 999)] + ["".join(rng.sample(points[:9000], 500)) for _ in range(99)]
    for r in both(spark, [t.encode() for t in texts]):
        assert r.words.split() == r.ts


def test_odd_texts_in_pieces(spark, monkeypatch):
    texts = ["", "\0", "a\0b", "ΣΑΣ ΟΔΟΣ.Σ", "İstanbul I İ", "﻿A﻿b", "ﬁ ǅ 𝐀𐐀 \U0001f600x", "a\x1cb c\nd", "straße STRASSE", " x" * 300]
    raw = [t.encode() for t in texts] + [b"a\xffB", b"\xe4\xbd", None]
    got = both(spark, raw)
    assert [(r.words.split()) for r in got] == [r.ts or [] for r in got] and len(got) == len(raw)
    c = cut.cutter(spark)
    monkeypatch.setattr(cut, "PIECE", 5)  # of one row, where it is longer
    pdf = pd.DataFrame({"raw": [t if t is None or not any(s.encode() in t for s in c.special) else None for t in raw], "words": None})
    parts = list(c.cut(iter([pdf, pdf.iloc[:0]])))
    assert len(parts) == 7 and all(sum(map(len, pdf.raw.loc[p.index].dropna())) <= 5 or len(p) == 1 for p in parts)
    assert [w.split() for p in parts for w in p.words] == [r.ts or [] if t is not None else [] for r, t in zip(got, pdf.raw, strict=True)]


def test_terms_handed_on_in_parts(spark, monkeypatch):
    """A worker that may hold two terms counts as one that holds all."""
    c = cut.cutter(spark)
    pdf = pd.DataFrame({"raw": [b"b a a", b"", b"a c d", b"d"], "words": None})
    monkeypatch.setattr(index, "COUNTED", 2)
    got = pd.concat(index._counts(c)(iter([pdf])))
    assert got.groupby("term").df.sum().to_dict() == {"a": 2, "b": 1, "c": 1, "d": 2} and got.own.sum() == 7


def test_no_text_in_an_index(spark):
    """Chunks without text count, and none of their tokens do; a plan of terms makes no row of a token."""
    rows = spark.createDataFrame([(0, None), (1, "a b")], "chunk_idx long, text string")
    made = invert(rows)
    assert made.corpus.first().asDict() == {"n": 2, "avgdl": 1.0} and {r.term for r in made.terms.collect()} == {"a", "b"}
    assert "Generate explode" not in made.terms._jdf.queryExecution().optimizedPlan().toString()
