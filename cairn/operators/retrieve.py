"""The retrieval plan: routes choose strategy rows, strategy rows choose which ranked lists are fused, reranked and cut."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import rank
from .index import InvertedFile
from .route import BM25_K, DENSE_K, strategies


def planned(routed: DataFrame) -> DataFrame:
    """routed (query, text, route) -> with the strategy's columns; an unknown label is an error when it is read."""
    table = F.broadcast(strategies(routed.sparkSession))  # a fixed table of six rows
    met = routed.join(table, routed["route.label"] == table.label, "left")
    checked = F.when(F.col("final_k").isNull(), F.raise_error(F.concat(F.lit("unknown strategy "), "route.label")).cast("int")).otherwise(F.col("final_k"))
    return met.withColumn("final_k", checked).drop("label")


def retrieve(routed: DataFrame, subqueries: DataFrame, index: InvertedFile, chunks: DataFrame, vectors: DataFrame, query_vectors: DataFrame) -> DataFrame:
    """(query, chunk_idx, rank): what each question's strategy retrieves.

    Undecomposed questions are their own only sub-query. Dense lists are taken alone or fused with BM25 by the hybrid
    flag; the pool keeps first-seen order; reranking is against the original question; the cut is the strategy's final k.
    """
    plan = planned(routed)
    own = plan.where(~F.col("decompose")).select("query", F.lit(0).alias("sub"), "text")
    parts = subqueries.join(plan.where("decompose").select("query"), "query", "left_semi").select("query", F.col("sub").cast("int").alias("sub"), "text")
    lone = plan.where("decompose").join(subqueries, "query", "left_anti").select("query", F.lit(0).alias("sub"), "text")  # nothing usable: the question itself
    asked = own.unionByName(parts).unionByName(lone)
    # one list per (query, sub): the pair is the query of the list operators
    key = F.struct(F.col("query").alias("q"), F.col("sub").alias("s"))
    dense = rank.dense_top_k(vectors, asked.join(query_vectors, "query").select(key.alias("query"), "vec"), DENSE_K)
    hybrid = asked.join(plan.where("use_hybrid").select("query"), "query", "left_semi").select(key.alias("query"), "text")
    lexical = rank.bm25_top_k(index, hybrid, chunks, BM25_K)
    both = dense.select("query", F.lit(0).alias("list_no"), "chunk_idx", "rank").unionByName(lexical.select("query", F.lit(1).alias("list_no"), "chunk_idx", "rank"))
    fused = rank.fuse(both).where(F.col("rank") <= DENSE_K)  # a single list keeps its order
    pooled = rank.pool(fused.select(F.col("query.q").alias("query"), F.col("query.s").alias("sub"), "chunk_idx", "rank"))
    ranked = rank.rerank(pooled.join(plan.where("rerank").select("query"), "query", "left_semi"), plan.select("query", "text"), chunks)
    plain = pooled.join(plan.where(~F.col("rerank")).select("query"), "query", "left_semi").select("query", "chunk_idx", F.col("place").alias("rank"))
    every = ranked.select("query", "chunk_idx", "rank").unionByName(plain)
    return every.join(plan.select("query", "final_k"), "query").where(F.col("rank") <= F.col("final_k")).drop("final_k")
