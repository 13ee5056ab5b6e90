"""Queries of tokenising, ranking, routing and retrieval, each with its DuckDB SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.vectors import cosine
from ..operators import evaluate, rank, route
from ..operators.index import Encoder, hashed_words, index_text, invariant_report, rebuilt
from ..operators.retrieve import retrieve
from . import views as V
from .registry import query, sql_list

R6 = lambda c: F.round(c, 6)


@query(r"""SELECT doc_id AS chunk_idx, len(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+')) AS n_tokens,
  len(list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+'))) AS n_distinct FROM documents""")
def tokenize_counts(spark: SparkSession, sf: str) -> DataFrame:
    ts = T.tokens(F.col("text"))
    return V.chunks(spark, sf).select("chunk_idx", F.size(ts).cast("long").alias("n_tokens"), F.size(F.array_distinct(ts)).cast("long").alias("n_distinct"))


@query(rf"""WITH {V.CHUNKS_SQL}, {V.INVERTED_SQL} SELECT term, df, round(idf, 6) AS idf FROM terms""")
def bm25_terms(spark: SparkSession, sf: str) -> DataFrame:
    return V.inverted(spark, sf).terms.select("term", "df", R6("idf").alias("idf"))


@query(rf"""WITH {V.CHUNKS_SQL}, {V.QUESTIONS_SQL}, {V.INVERTED_SQL}, {V.bm25_sql('questions', 'bm25')}
  SELECT query, rank, chunk_idx, round(score, 6) AS score FROM bm25""")
def bm25_topk(spark: SparkSession, sf: str) -> DataFrame:
    chunks = V.chunks(spark, sf)
    top = rank.bm25_top_k(V.inverted(spark, sf), V.questions(spark, sf).select("query", "text"), chunks, route.BM25_K)
    return top.select("query", F.col("rank").cast("long").alias("rank"), "chunk_idx", R6("score").alias("score"))


@query(rf"""WITH {V.CHUNKS_SQL}, {V.QUESTIONS_SQL}, {V.VECTORS_SQL}, {V.DENSE_SQL} SELECT query, rank, chunk_idx, round(score, 6) AS score FROM dense""")
def dense_topk(spark: SparkSession, sf: str) -> DataFrame:
    top = rank.dense_top_k(V.chunk_vectors(spark, sf), V.query_vectors(spark, sf), route.DENSE_K)
    return top.select("query", F.col("rank").cast("long").alias("rank"), "chunk_idx", R6("score").alias("score"))


@query(r"""WITH q AS (SELECT vec_id AS a, embedding::DOUBLE[] AS va FROM embeddings WHERE vec_id IN (SELECT item_id FROM benchmark)),
  s AS (SELECT a, e.vec_id AS b, coalesce(list_inner_product(va, e.embedding::DOUBLE[]) / nullif(sqrt(list_inner_product(va, va)) * sqrt(list_inner_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])), 0), 0) AS c,
    e.label AS lb FROM q, embeddings e)
  SELECT a AS query, lb AS label, count(*) AS n, round(avg(c), 6) AS mean_cosine, round(max(c), 6) AS max_cosine FROM s WHERE a <> b GROUP BY a, lb""")
def cosine_by_label(spark: SparkSession, sf: str) -> DataFrame:
    """Cosine with the zero-length guard, averaged by label."""
    e = V.table(spark, sf, "embeddings")
    s = e.join(V.query_vectors(spark, sf).withColumnRenamed("vec", "qv"), F.col("vec_id") != F.col("query")).withColumn("c", cosine(F.col("embedding"), F.col("qv")))
    return s.groupBy("query", "label").agg(F.count("*").alias("n"), R6(F.avg("c")).alias("mean_cosine"), R6(F.max("c")).alias("max_cosine"))


@query(rf"""WITH {V.CHUNKS_SQL}, {V.QUESTIONS_SQL}, {V.VECTORS_SQL}, {V.DENSE_SQL}, {V.INVERTED_SQL}, {V.bm25_sql('questions', 'bm25')},
  l AS (SELECT query, 0 AS list_no, chunk_idx, rank FROM dense UNION ALL SELECT query, 1, chunk_idx, rank FROM bm25),
  f AS (SELECT query, chunk_idx, sum(1.0::DOUBLE / (60 + rank)) AS score, min(list_no * 1000 + rank) AS first FROM l GROUP BY query, chunk_idx),
  r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, first) AS rank FROM f)
  SELECT query, rank, chunk_idx, round(score, 6) AS score FROM r WHERE rank <= 20""")
def rrf_hybrid(spark: SparkSession, sf: str) -> DataFrame:
    chunks, asked = V.chunks(spark, sf), V.questions(spark, sf).select("query", "text")
    dense = rank.dense_top_k(V.chunk_vectors(spark, sf), V.query_vectors(spark, sf), route.DENSE_K)
    lexical = rank.bm25_top_k(V.inverted(spark, sf), asked, chunks, route.BM25_K)
    lists = dense.select("query", F.lit(0).alias("list_no"), "chunk_idx", "rank").unionByName(lexical.select("query", F.lit(1).alias("list_no"), "chunk_idx", "rank"))
    fused = rank.fuse(lists).where(F.col("rank") <= route.DENSE_K)
    return fused.select("query", F.col("rank").cast("long").alias("rank"), "chunk_idx", R6("score").alias("score"))


_POOL = rf"""{V.SUBS_SQL}, {V.INVERTED_SQL}, {V.bm25_sql('subs', 'sublist', 'query, sub')},
  p AS (SELECT query, chunk_idx, min(sub * 1000 + rank) AS first FROM sublist GROUP BY query, chunk_idx),
  pool AS (SELECT query, chunk_idx, row_number() OVER (PARTITION BY query ORDER BY first) AS place FROM p)"""
_OVERLAP = r"""len(list_intersect(list_distinct(regexp_extract_all(lower(q.text), '[\p{L}\p{N}_]+')), list_distinct(regexp_extract_all(lower(c.title || chr(10) || c.text), '[\p{L}\p{N}_]+'))))::DOUBLE
    / greatest(len(list_distinct(regexp_extract_all(lower(q.text), '[\p{L}\p{N}_]+'))), 1)"""


def _pool(spark: SparkSession, sf: str) -> DataFrame:
    chunks = V.chunks(spark, sf)
    parts = V.subqueries(spark, sf).select(F.struct("query", "sub").alias("query"), "text")
    lists = rank.bm25_top_k(V.inverted(spark, sf), parts, chunks, route.BM25_K)
    return rank.pool(lists.select(F.col("query.query").alias("query"), F.col("query.sub").alias("sub"), "chunk_idx", "rank"))


@query(rf"""WITH {V.CHUNKS_SQL}, {V.QUESTIONS_SQL}, {_POOL} SELECT query, chunk_idx, place FROM pool""")
def multi_query_pool(spark: SparkSession, sf: str) -> DataFrame:
    return _pool(spark, sf).select("query", "chunk_idx", F.col("place").cast("long").alias("place"))


@query(rf"""WITH {V.CHUNKS_SQL}, {V.QUESTIONS_SQL}, {_POOL} SELECT query, chunk_idx, place FROM pool WHERE place <= 8""")
def no_rerank_cut(spark: SparkSession, sf: str) -> DataFrame:
    return _pool(spark, sf).where("place <= 8").select("query", "chunk_idx", F.col("place").cast("long").alias("place"))


@query(rf"""WITH {V.CHUNKS_SQL}, {V.QUESTIONS_SQL}, {_POOL},
  s AS (SELECT p.query, p.chunk_idx, p.place, {_OVERLAP} AS score FROM pool p JOIN questions q USING (query) JOIN chunks c USING (chunk_idx)),
  r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, place) AS rank FROM s)
  SELECT query, rank, chunk_idx, place, round(score, 6) AS score FROM r WHERE rank <= 8""")
def rerank_cut(spark: SparkSession, sf: str) -> DataFrame:
    ranked = rank.rerank(_pool(spark, sf), V.questions(spark, sf), V.chunks(spark, sf)).where("rank <= 8")
    return ranked.select("query", F.col("rank").cast("long").alias("rank"), "chunk_idx", F.col("place").cast("long").alias("place"), R6("score").alias("score"))


#: Retrieval by the strategy that goes round with the question's id, all four flags in play.
_ROUND = ("SIMPLE", "STATIC", "MULTI_HOP", "UNCERTAIN", "STATIC_K10")
_STRATEGY = rf"""{V.SUBS_SQL}, {V.VECTORS_SQL}, {V.INVERTED_SQL},
  routed AS (SELECT query, text, ['SIMPLE', 'STATIC', 'MULTI_HOP', 'UNCERTAIN', 'STATIC_K10'][query % 5 + 1] AS label FROM questions),
  plan AS (SELECT *, label <> 'SIMPLE' AS hybrid, label <> 'SIMPLE' AS rerank, label IN ('MULTI_HOP', 'UNCERTAIN') AS decompose,
    CASE label WHEN 'SIMPLE' THEN 5 WHEN 'STATIC' THEN 8 WHEN 'MULTI_HOP' THEN 8 ELSE 10 END AS final_k FROM routed),
  asked AS (SELECT query, 0 AS sub, text FROM plan WHERE NOT decompose UNION ALL SELECT s.query, s.sub, s.text FROM subs s JOIN plan USING (query) WHERE decompose),
  ds AS (SELECT a.query, a.sub, c.chunk_idx, list_inner_product(c.vec, q.vec) AS score FROM asked a JOIN query_vectors q USING (query), chunk_vectors c),
  dl AS (SELECT *, row_number() OVER (PARTITION BY query, sub ORDER BY round(score, 9) DESC, chunk_idx) AS rank FROM ds),
  hyb AS (SELECT a.* FROM asked a JOIN plan USING (query) WHERE hybrid), {V.bm25_sql('hyb', 'lex', 'query, sub')},
  l AS (SELECT query, sub, 0 AS list_no, chunk_idx, rank FROM dl WHERE rank <= 20 UNION ALL SELECT query, sub, 1, chunk_idx, rank FROM lex),
  f AS (SELECT query, sub, chunk_idx, sum(1.0::DOUBLE / (60 + rank)) AS score, min(list_no * 1000 + rank) AS first FROM l GROUP BY query, sub, chunk_idx),
  fr AS (SELECT *, row_number() OVER (PARTITION BY query, sub ORDER BY round(score, 9) DESC, first) AS rank FROM f),
  p AS (SELECT query, chunk_idx, min(sub * 1000 + rank) AS first FROM fr WHERE rank <= 20 GROUP BY query, chunk_idx),
  pool AS (SELECT query, chunk_idx, row_number() OVER (PARTITION BY query ORDER BY first) AS place FROM p),
  s AS (SELECT p.query, p.chunk_idx, p.place, CASE WHEN q.rerank THEN {_OVERLAP} ELSE 0 END AS score, q.final_k FROM pool p JOIN plan q USING (query) JOIN chunks c USING (chunk_idx)),
  retrieved AS (SELECT * FROM (SELECT query, chunk_idx, final_k, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, place) AS rank FROM s) WHERE rank <= final_k)"""


def _retrieved(spark: SparkSession, sf: str) -> DataFrame:
    chunks, asked = V.chunks(spark, sf), V.questions(spark, sf)
    label = F.element_at(F.array(*[F.lit(x) for x in _ROUND]), (F.col("query") % 5 + 1).cast("int"))
    routed = asked.withColumn("route", route.decision(label, F.lit(1.0), F.lit("round")))
    return retrieve(routed, V.subqueries(spark, sf), V.inverted(spark, sf), chunks, V.chunk_vectors(spark, sf), V.query_vectors(spark, sf))


@query(rf"""WITH {V.CHUNKS_SQL}, {V.QUESTIONS_SQL}, {_STRATEGY} SELECT query, rank, chunk_idx FROM retrieved""")
def strategy_retrieve(spark: SparkSession, sf: str) -> DataFrame:
    return _retrieved(spark, sf).select("query", F.col("rank").cast("long").alias("rank"), "chunk_idx")


@query(rf"""WITH {V.CHUNKS_SQL}, {V.QUESTIONS_SQL}, {_STRATEGY} SELECT query, rank AS n, chunk_id, paper_id FROM retrieved JOIN chunks USING (chunk_idx)""")
def citations(spark: SparkSession, sf: str) -> DataFrame:
    return rank.citations(_retrieved(spark, sf), V.chunks(spark, sf)).withColumn("n", F.col("n").cast("long"))


@query(rf"""WITH {V.CHUNKS_SQL}, {V.QUESTIONS_SQL}, {_STRATEGY},
  t AS (SELECT query, string_agg('[' || rank || '] (' || title || ' - ' || section || ')' || chr(10) || text, chr(10) || chr(10) ORDER BY rank) AS context FROM retrieved JOIN chunks USING (chunk_idx) GROUP BY query)
  SELECT query, length(context) AS chars, sha256(context) AS context_sha256 FROM t""")
def context_assembly(spark: SparkSession, sf: str) -> DataFrame:
    made = rank.context(_retrieved(spark, sf), V.chunks(spark, sf))
    return made.select("query", F.length("context").cast("long").alias("chars"), F.sha2(F.col("context").cast("binary"), 256).alias("context_sha256"))


def _recall_sql(item: str) -> str:
    return rf"""WITH {V.CHUNKS_SQL}, {V.QUESTIONS_SQL}, {V.GOLD_SQL}, {_STRATEGY},
  found AS (SELECT DISTINCT query, {item} AS item FROM retrieved JOIN chunks USING (chunk_idx)), wanted AS (SELECT DISTINCT query, {item} AS item FROM gold),
  h AS (SELECT w.query, count(*) AS n_gold, count(f.item) AS n_found FROM wanted w LEFT JOIN found f USING (query, item) GROUP BY w.query)
  SELECT q.query, coalesce(n_gold, 0) AS n_gold, coalesce(n_found, 0) AS n_found, round(n_found::DOUBLE / n_gold, 6) AS recall FROM questions q LEFT JOIN h USING (query)"""


def _recall(spark: SparkSession, sf: str, item: str) -> DataFrame:
    found = _retrieved(spark, sf).join(V.chunks(spark, sf).select("chunk_idx", "paper_id"), "chunk_idx")
    return evaluate.recall_of(found, V.gold(spark, sf), V.questions(spark, sf), item).withColumn("recall", R6("recall"))


@query(_recall_sql("chunk_idx"))
def evidence_recall(spark: SparkSession, sf: str) -> DataFrame:
    return _recall(spark, sf, "chunk_idx")


@query(_recall_sql("paper_id"))
def paper_recall(spark: SparkSession, sf: str) -> DataFrame:
    return _recall(spark, sf, "paper_id")


@query(rf"""WITH {V.CHUNKS_SQL}, {V.QUESTIONS_SQL}, {V.GOLD_SQL}, {V.INVERTED_SQL}, {V.bm25_sql('questions', 'bm25')},
  top AS (SELECT * FROM bm25 WHERE rank <= 8),
  r AS (SELECT q.query, q.qtype, count(g.chunk_idx) AS n_gold, count(t.chunk_idx) AS n_found FROM questions q LEFT JOIN gold g USING (query) LEFT JOIN top t ON t.query = g.query AND t.chunk_idx = g.chunk_idx GROUP BY q.query, q.qtype),
  v AS (SELECT *, n_found::DOUBLE / nullif(n_gold, 0) AS recall FROM r)
  SELECT coalesce(qtype, 'ALL') AS qtype, count(*) AS n, count(recall) AS n_scored, round(avg(recall), 6) AS recall FROM v GROUP BY GROUPING SETS ((), (qtype))""")
def retrieval_report(spark: SparkSession, sf: str) -> DataFrame:
    """The flagship: BM25 top 8 of every question against its gold, over ALL and each type."""
    chunks, asked = V.chunks(spark, sf), V.questions(spark, sf)
    top = rank.bm25_top_k(V.inverted(spark, sf), asked.select("query", "text"), chunks, 8)
    recall = evaluate.recall_of(top, V.gold(spark, sf), asked, "chunk_idx").join(asked.select("query", "qtype"), "query")
    report = recall.groupingSets([[], [F.col("qtype")]], "qtype").agg(F.count("*").alias("n"), F.count("recall").alias("n_scored"), R6(F.avg("recall")).alias("recall"))
    return report.withColumn("qtype", F.coalesce("qtype", F.lit("ALL")))


@query(rf"""WITH {V.CHUNKS_SQL}, {V.QUESTIONS_SQL}, {V.GOLD_SQL}, {_STRATEGY}
  SELECT g.query, g.chunk_idx, c.chunk_id, length(c.text) AS chars, CASE WHEN r.chunk_idx IS NULL THEN 'MISS' ELSE 'HIT' END AS outcome
  FROM gold g LEFT JOIN chunks c USING (chunk_idx) LEFT JOIN retrieved r ON r.query = g.query AND r.chunk_idx = g.chunk_idx""")
def gold_hydrate(spark: SparkSession, sf: str) -> DataFrame:
    """Every gold chunk with its text, marked as found or missed."""
    hit = _retrieved(spark, sf).select("query", "chunk_idx", F.lit("HIT").alias("outcome"))
    held = V.chunks(spark, sf).join(F.broadcast(V.gold(spark, sf).select("query", "chunk_idx")), "chunk_idx").join(hit, ["query", "chunk_idx"], "left")
    return held.select("query", "chunk_idx", "chunk_id", F.length("text").cast("long").alias("chars"), F.coalesce("outcome", F.lit("MISS")).alias("outcome"))


@query(rf"""WITH {V.CHUNKS_SQL}, n AS (SELECT max(vec_id) + 1 AS n FROM embeddings)
  SELECT count(*) AS n_chunks, count(*) - count(DISTINCT chunk_id) AS n_duplicate_ids, count(*) AS n_vectors, 64 AS dim_min, 64 AS dim_max, 0::BIGINT AS n_misaligned, true AS valid FROM chunks, n""")
def index_invariants(spark: SparkSession, sf: str) -> DataFrame:
    return invariant_report(V.chunks(spark, sf), V.chunk_vectors(spark, sf))


@query(r"""SELECT doc_id AS chunk_idx, sha256(source || ' - ' || lang || chr(10) || coalesce(text, '')) AS index_sha256 FROM documents""")
def index_texts(spark: SparkSession, sf: str) -> DataFrame:
    text = index_text(F.col("title"), F.col("section"), F.col("text"))
    return V.chunks(spark, sf).select("chunk_idx", F.sha2(text.cast("binary"), 256).alias("index_sha256"))


@query(r"""SELECT code, router, label FROM (VALUES ('A', 'vanilla', 'VANILLA'), ('B', 'static', 'STATIC'), ('F', 'strongest', 'UNCERTAIN'), ('G', 'multihop', 'MULTI_HOP'), ('K', 'static_k10', 'STATIC_K10')) t(code, router, label)""")
def router_fixed(spark: SparkSession, sf: str) -> DataFrame:
    return route.experiments(spark).where("fixed_label is not null").select("code", "router", F.col("fixed_label").alias("label"))


# Two surrogate questions in three are given hint words, as the tables' prose has none.
_ASK = r"""ask AS (SELECT item_id AS query, text || CASE item_id % 3 WHEN 1 THEN ' Which papers agree over time?' WHEN 2 THEN ' How do both evolve?' ELSE '' END AS text FROM benchmark)"""
_HITS = r"""len(regexp_extract_all(text, '(?i)\b(compare|contrast|versus|vs\.?|across|differ|disagree|conflict|consistent with|both|relationship between|agree|evolv|over time|which (?:paper|study)|papers|studies)\b'))"""


def _ask(spark: SparkSession, sf: str) -> DataFrame:
    tail = F.when(F.col("item_id") % 3 == 1, " Which papers agree over time?").when(F.col("item_id") % 3 == 2, " How do both evolve?").otherwise("")
    return V.table(spark, sf, "benchmark").select(F.col("item_id").alias("query"), F.concat("text", tail).alias("text"))


@query(rf"""WITH {_ASK}, h AS (SELECT query, {_HITS} AS hits FROM ask)
  SELECT query, CASE WHEN hits >= 1 THEN 'MULTI_HOP' ELSE 'SIMPLE' END AS label, CAST(CASE WHEN hits >= 2 THEN 0.8 WHEN hits = 1 THEN 0.55 ELSE 0.7 END AS DOUBLE) AS confidence FROM h""")
def router_heuristic(spark: SparkSession, sf: str) -> DataFrame:
    return _ask(spark, sf).select("query", route.heuristic(F.col("text")).alias("r")).select("query", "r.label", "r.confidence")


_REPLIES = (
    'Sure: {"label": "SIMPLE", "confidence": 0.9}', '{"label": "MULTI_HOP", "confidence": 1.7}', '{"label": "OTHER", "confidence": 0.5}', "no json here", '{"label": "UNCERTAIN", "confidence": -0.2}',
    '{"label": "SIMPLE"}', '{"label": "multi_hop", "confidence": "0.25"} so', '{"label": "SIMPLE", "confidence": null}', '{"label": "SIMPLE", "confidence": "high"}', '{"confidence": 0.5}', '{"label": "SIMPLE", ',
)
_READ = rf"""reply AS (SELECT event_id, {sql_list(_REPLIES)}[event_id % {len(_REPLIES)} + 1] AS reply FROM events), found AS (SELECT event_id, regexp_extract(reply, '(?s)\{{.*\}}') AS t FROM reply),
  j AS (SELECT event_id, CASE WHEN json_valid(t) THEN t::JSON END AS j FROM found),
  f AS (SELECT event_id, upper(json_extract_string(j, '$.label')) AS label, CASE WHEN NOT list_contains(json_keys(j), 'confidence') THEN 0 ELSE try_cast(json_extract_string(j, '$.confidence') AS DOUBLE) END AS confidence FROM j),
  read AS (SELECT event_id, coalesce(label IN ('SIMPLE', 'MULTI_HOP', 'UNCERTAIN') AND isfinite(confidence), false) AS good, label, confidence FROM f)"""


def _replies(spark: SparkSession, sf: str) -> DataFrame:
    kinds = F.array(*[F.lit(x) for x in _REPLIES])
    return V.table(spark, sf, "events").select("event_id", F.element_at(kinds, (F.col("event_id") % len(_REPLIES) + 1).cast("int")).alias("reply"))


@query(rf"""WITH {_READ} SELECT event_id, CASE WHEN good THEN label ELSE 'UNCERTAIN' END AS label, CASE WHEN good THEN greatest(least(confidence, 1), 0) ELSE 0 END AS confidence, CASE WHEN good THEN 'llm' ELSE 'llm:parse_fail' END AS source FROM read""")
def router_llm_parse(spark: SparkSession, sf: str) -> DataFrame:
    """Cached model replies of several shapes, read with the fallback to an uncertain parse failure."""
    return _replies(spark, sf).select("event_id", route.llm_reply(F.col("reply")).alias("r")).select("event_id", "r.label", "r.confidence", "r.source")


@query(rf"""WITH {_ASK}, {_READ}, h AS (SELECT query, {_HITS} AS hits FROM ask),
  r AS (SELECT query, CASE WHEN hits >= 1 THEN 'MULTI_HOP' ELSE 'SIMPLE' END AS label, CASE WHEN hits >= 2 THEN 0.8 WHEN hits = 1 THEN 0.55 ELSE 0.7 END AS confidence FROM h)
  SELECT 'A' AS code, query, 'VANILLA' AS label, 1.0::DOUBLE AS confidence, 'fixed:VANILLA' AS source FROM ask UNION ALL SELECT 'G', query, 'MULTI_HOP', 1.0, 'fixed:MULTI_HOP' FROM ask
  UNION ALL SELECT 'C', query, CASE WHEN good THEN label ELSE 'UNCERTAIN' END, CASE WHEN good THEN greatest(least(confidence, 1), 0) ELSE 0 END, CASE WHEN good THEN 'llm' ELSE 'llm:parse_fail' END FROM ask JOIN read ON event_id = query
  UNION ALL SELECT 'C', query, 'UNCERTAIN', 0.0, 'llm:parse_fail' FROM ask WHERE query NOT IN (SELECT event_id FROM read)
  UNION ALL SELECT 'E', query, ['SIMPLE', 'MULTI_HOP', 'UNCERTAIN'][query % 3 + 1], 1.0, 'oracle' FROM ask
  UNION ALL SELECT 'H', query, CASE WHEN confidence >= 0.7 THEN label ELSE 'UNCERTAIN' END, CASE WHEN confidence >= 0.7 THEN confidence ELSE 1.0 END, CASE WHEN confidence >= 0.7 THEN 'heuristic' ELSE 'fixed:UNCERTAIN (escalated from heuristic)' END FROM r""")
def router_by_name(spark: SparkSession, sf: str) -> DataFrame:
    """Every question under five experiments, their routers made by name: fixed, model, oracle, and one that escalates."""
    asked = _ask(spark, sf)
    label = F.element_at(F.array(*[F.lit(x) for x in route.LABELS]), (F.col("query") % 3 + 1).cast("int"))
    replies, known = _replies(spark, sf).withColumnRenamed("event_id", "query"), asked.select(F.col("text").alias("question"), label.alias("label"))
    part = lambda code: route.experiment(asked, code, replies, known).select(F.lit(code).alias("code"), "query", "route.label", "route.confidence", "route.source")
    return reduce(DataFrame.unionByName, map(part, "AGCEH"))


_ASKED_PARTS = ('Sure: ["first part?", " ", "second part?"]', '["one", "two", "three", "four"]', "no list", '["cut', "[1, null, {}]", '[2, "kept"]', "[]")


@query(rf"""WITH r AS (SELECT event_id, {sql_list(_ASKED_PARTS)}[event_id % {len(_ASKED_PARTS)} + 1] AS reply FROM events), t AS (SELECT event_id, regexp_extract(reply, '(?s)\[.*\]') AS t FROM r),
  j AS (SELECT event_id, CASE WHEN json_valid(t) THEN list_filter(from_json(t, '["JSON"]'), lambda x: json_type(x) = 'VARCHAR' AND trim(json_extract_string(x, '$')) <> '') END AS items FROM t),
  k AS (SELECT event_id, CASE WHEN len(coalesce(items, [])) > 0 THEN list_transform(items[1:3], lambda x: json_extract_string(x, '$')) ELSE ['Question ' || event_id] END AS parts FROM j)
  SELECT event_id, len(parts) AS n, array_to_string(parts, '|') AS parts FROM k""")
def query_decompose(spark: SparkSession, sf: str) -> DataFrame:
    """Replies of several shapes read as sub-questions, with the question itself where nothing is usable."""
    i = F.col("event_id")
    reply = F.element_at(F.array(*[F.lit(x) for x in _ASKED_PARTS]), (i % len(_ASKED_PARTS) + 1).cast("int"))
    parts = V.table(spark, sf, "events").select("event_id", route.decomposed(reply, F.concat(F.lit("Question "), i)).alias("p"))
    return parts.select("event_id", F.size("p").cast("long").alias("n"), F.array_join("p", "|").alias("parts"))


_DIM = 16
_ENCODED = lambda text: rf"""list_transform(range({_DIM}), lambda i: len(list_filter(regexp_extract_all(lower({text}), '[\p{{L}}\p{{N}}_]+'), lambda t: ('0x' || substr(md5(t), 1, 4))::INT % {_DIM} = i))::DOUBLE)"""


@query(rf"""WITH {V.CHUNKS_SQL}, t AS (SELECT 'document' AS kind, chunk_idx AS id, {_ENCODED("title || ' - ' || section || chr(10) || text")} AS v FROM chunks UNION ALL SELECT 'query', item_id, {_ENCODED("'Represent this: ' || text")} FROM benchmark),
  u AS (SELECT kind, id, v, sqrt(list_inner_product(v, v)) AS n FROM t) SELECT kind, id, unnest(range({_DIM})) AS i, round(unnest(v) / greatest(n, 1e-300), 6) AS x FROM u""")
def embed_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks and questions through the offline encoder, questions behind a prefix; the chunks' vectors are those of an index built anew."""
    encoder = Encoder(hashed_words(_DIM), "Represent this: ")
    docs = rebuilt(V.chunks(spark, sf), encoder).select(F.lit("document").alias("kind"), F.col("chunk_idx").alias("id"), "vec")
    asked = V.questions(spark, sf).select(F.lit("query").alias("kind"), F.col("query").alias("id"), encoder.queries(F.col("text")).alias("vec"))
    return docs.unionByName(asked).select("kind", "id", F.posexplode("vec").alias("i", "x")).select("kind", "id", F.col("i").cast("long").alias("i"), R6("x").alias("x"))


@query(r"""SELECT item_id AS query, ['SIMPLE', 'MULTI_HOP', 'UNCERTAIN'][item_id % 3 + 1] AS label, 'oracle' AS source FROM benchmark""")
def router_oracle_lookup(spark: SparkSession, sf: str) -> DataFrame:
    asked = V.questions(spark, sf).select("query", F.concat(F.lit("  "), F.replace("text", F.lit(" "), F.lit("\t ")), F.lit("\n")).alias("text"))
    label = F.element_at(F.array(*[F.lit(x) for x in route.LABELS]), (F.col("query") % 3 + 1).cast("int"))
    known = V.questions(spark, sf).select(F.col("text").alias("question"), label.alias("label"))
    return route.oracle(asked, known).select("query", "route.label", "route.source")


@query(rf"""WITH {_ASK}, h AS (SELECT query, {_HITS} AS hits FROM ask)
  SELECT query, CASE WHEN hits = 1 THEN 'UNCERTAIN' WHEN hits >= 2 THEN 'MULTI_HOP' ELSE 'SIMPLE' END AS label, hits = 1 AS escalated,
    CASE WHEN hits = 1 THEN 'fixed:UNCERTAIN (escalated from heuristic)' ELSE 'heuristic' END AS source FROM h""")
def router_escalating(spark: SparkSession, sf: str) -> DataFrame:
    r = route.escalating(route.heuristic(F.col("text")), route.fixed("UNCERTAIN"))
    return _ask(spark, sf).select("query", r.alias("r")).select("query", "r.label", "r.escalated", "r.source")
