from pyspark.sql import functions as F

import corpus_pipeline
from cairn.llm import quality

from .conftest import pairs
from .test_dedup import near, normal

SF = "/root/testdata/sf0.01"


def test_stages_keep_what_they_should(spark):
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "exact_dedup", "near_dedup", "mix", "pack"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    scores = quality.quality_scores(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    kept = stages["quality"](spark, docs, SF)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r.id for r in scores.where("predicted = 1").collect()}

    once = stages["exact_dedup"](spark, kept, SF)
    first = {}
    for d, t in pairs(kept):
        first[normal(t)] = min(d, first.get(normal(t), d))
    assert once.columns == docs.columns and sorted(r.doc_id for r in once.collect()) == sorted(first.values())

    apart = stages["near_dedup"](spark, once, SF)
    want = sorted(d for d, _, c in near(pairs(once), 5, 80) if c == d or c is None)
    assert apart.columns == docs.columns and sorted(r.doc_id for r in apart.collect()) == want

    mixed = stages["mix"](spark, apart, SF)
    assert mixed.columns == docs.columns and mixed.groupBy("doc_id").count().agg(F.max("count")).first()[0] == 2

    packed = stages["pack"](spark, mixed, SF)
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0
    assert packed.groupBy("doc_id").agg(F.count_if(F.col("start") == 0).alias("n")).agg(F.sum("n")).first()[0] == mixed.count()


def test_run_is_the_stages_in_order(spark):
    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert rows.count() > 0 and rows.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


def test_stages_take_edges(spark, edge_docs, no_docs):
    for docs in (edge_docs.select("doc_id", "text", "lang", "source", "n_chars"), no_docs.select("doc_id", "text", "lang", "source", "n_chars")):
        at = docs
        for _, stage in corpus_pipeline.STAGES:
            at = stage(spark, at, SF)
        assert (at.count() > 0) == (docs.count() > 0)
