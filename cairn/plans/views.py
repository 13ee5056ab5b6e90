"""Surrogates of the engine's entities over the driver's tables (documents, benchmark, embeddings, pages, events, labels,
conversations). Each view says what stands for what; the operators know nothing of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.contain import holders
from ..operators.index import InvertedFile, invert, load_inverted
from ..operators.route import decomposed
from ..sources.shared import shared_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document is a chunk; its source is the paper, its language the section."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("chunk_idx"), F.concat("source", F.lit("::"), "doc_id").alias("chunk_id"), F.col("source").alias("paper_id"),
        F.col("source").alias("title"), F.col("lang").alias("section"), F.coalesce("text", F.lit("")).alias("text"),
    )


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A benchmark passage is a question; its type goes round by id."""
    kinds = F.array(*[F.lit(k) for k in QTYPES])
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"), "text", F.element_at(kinds, (F.col("item_id") % 5 + 1).cast("int")).alias("qtype"))


QTYPES = ("simple", "multi_hop", "conflicting", "temporal", "chain")


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query, chunk_idx, paper_id): chunks that hold the passage."""
    return holders(chunks(spark, sf_dir), questions(spark, sf_dir).select("query", "text")).distinct()


_INVERTED: dict[tuple[str, str], str] = {}


def inverted(spark: SparkSession, sf_dir: str) -> InvertedFile:
    """The terms of the chunks, written once a session to the shared folder and read by every query that ranks."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _INVERTED:
        path = shared_folder(spark, "inverted")
        invert(chunks(spark, sf_dir), path)
        _INVERTED[key] = path
    return load_inverted(chunks(spark, sf_dir), _INVERTED[key])


def chunk_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(chunk_idx, vec): chunks take the given vectors in turn."""
    given = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vec"))
    size = given.agg((F.max("vec_id") + 1).alias("n"))
    own = chunks(spark, sf_dir).select("chunk_idx").crossJoin(F.broadcast(size)).select("chunk_idx", (F.col("chunk_idx") % F.col("n")).alias("vec_id"))
    return own.join(given, "vec_id").select("chunk_idx", "vec")


def query_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query, vec): question i takes vector i."""
    given = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query"), F.col("embedding").alias("vec"))
    return given.join(questions(spark, sf_dir).select("query"), "query", "left_semi")


def subqueries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query, sub, text): a cached reply that lists a question's sentences stands for the model's decomposition."""
    reply = F.concat(F.lit("Sub-questions: "), F.to_json(F.split("text", r"\. |\n")))
    return questions(spark, sf_dir).select("query", F.posexplode(decomposed(reply, F.col("text"))).alias("sub", "text"))


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as experiment rows: four experiments over the same questions; every 17th recall is missing."""
    e = table(spark, sf_dir, "events")
    labels = F.array(F.lit("SIMPLE"), F.lit("MULTI_HOP"), F.lit("UNCERTAIN"))
    missing = F.col("event_id") % 17 == 0
    return e.select(
        F.concat(F.lit("exp"), F.col("event_id") % 4).alias("experiment"), F.expr("event_id div 4").alias("id"), F.col("event_type").alias("qtype"),
        F.when(~missing, F.least(F.floor(F.col("value")), F.lit(4)) / 4.0).alias("recall"), F.col("user_id").alias("cluster"),
        (F.col("event_id") % 3).alias("llm_calls"), (F.col("event_id") % 101).alias("prompt_tokens"), (F.col("event_id") % 53).alias("completion_tokens"),
        F.col("value").alias("latency_s"), (F.col("event_id") % 7 == 0).alias("escalated"),
        F.element_at(labels, (F.col("event_id") % 3 + 1).cast("int")).alias("label"),
        F.when(F.col("event_id") % 4 == 0, "fixed:SIMPLE").otherwise("llm").alias("route_source"),
        F.when(F.col("event_id") % 5 != 0, F.element_at(labels, (F.expr("event_id div 4") % 3 + 1).cast("int"))).alias("gold_route"),
    )


#: The same views in DuckDB SQL, as common table expressions to start a query with.
CHUNKS_SQL = r"""chunks AS (
  SELECT doc_id AS chunk_idx, source || '::' || doc_id AS chunk_id, source AS paper_id, source AS title, lang AS section, coalesce(text, '') AS text FROM documents)"""
QUESTIONS_SQL = r"""questions AS (
  SELECT item_id AS query, text, ['simple', 'multi_hop', 'conflicting', 'temporal', 'chain'][item_id % 5 + 1] AS qtype FROM benchmark)"""
GOLD_SQL = r"""gold AS (SELECT q.query, c.chunk_idx, c.paper_id FROM questions q JOIN chunks c ON contains(c.text, q.text))"""
VECTORS_SQL = r"""n_vec AS (SELECT max(vec_id) + 1 AS n FROM embeddings),
chunk_vectors AS (SELECT c.chunk_idx, e.embedding::DOUBLE[] AS vec FROM chunks c, n_vec JOIN embeddings e ON e.vec_id = c.chunk_idx % n_vec.n),
query_vectors AS (SELECT q.query, e.embedding::DOUBLE[] AS vec FROM questions q JOIN embeddings e ON e.vec_id = q.query)"""
DENSE_SQL = r"""dense_scores AS (SELECT q.query, c.chunk_idx, list_inner_product(c.vec, q.vec) AS score FROM chunk_vectors c, query_vectors q),
dense AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, chunk_idx) AS rank FROM dense_scores) WHERE rank <= 20)"""
SUBS_SQL = r"""subs AS (
  SELECT query, unnest(range(len(p))) AS sub, unnest(p) AS text FROM (
    SELECT query, list_filter(regexp_split_to_array(text, '\. |\n'), lambda p: trim(p) <> '')[1:3] AS p FROM questions))"""
INVERTED_SQL = r"""toks AS (SELECT chunk_idx, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS term FROM chunks),
lengths AS (SELECT chunk_idx, len(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS dl FROM chunks),
postings AS MATERIALIZED (SELECT term, chunk_idx, count(*) AS tf FROM toks GROUP BY term, chunk_idx),
corpus AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM lengths),
dfs AS (SELECT term, count(*) AS df FROM postings GROUP BY term),
raws AS MATERIALIZED (SELECT term, df, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM dfs, corpus),
mean_raw AS (SELECT avg(raw) AS mean FROM raws),
terms AS (SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * mean ELSE raw END AS idf FROM raws, mean_raw)"""


def bm25_sql(queries: str, name: str, keys: str = "query") -> str:
    """CTEs for BM25 top 20 of ``queries`` (keys, text) under the given name; all chunks take part, with 0 if nothing is shared."""
    k = ", ".join(f"q.{x.strip()}" for x in keys.split(","))
    on = " AND ".join(f"s.{x.strip()} = q.{x.strip()}" for x in keys.split(","))
    return rf"""{name}_terms AS (
  SELECT {keys}, term, count(*) AS qtf FROM (SELECT {keys}, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+')) AS term FROM {queries}) GROUP BY {keys}, term),
{name}_hits AS (
  SELECT {k}, p.chunk_idx, sum(q.qtf * t.idf * (p.tf * 2.5) / (p.tf + 1.5 * (0.25 + 0.75 * l.dl / c.avgdl))) AS score
  FROM {name}_terms q JOIN terms t USING (term) JOIN postings p USING (term) JOIN lengths l USING (chunk_idx), corpus c GROUP BY {k}, p.chunk_idx),
{name}_scores AS (
  SELECT {k}, c.chunk_idx, coalesce(s.score, 0) AS score FROM {queries} q CROSS JOIN chunks c LEFT JOIN {name}_hits s ON {on} AND s.chunk_idx = c.chunk_idx),
{name} AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY round(score, 9) DESC, chunk_idx) AS rank FROM {name}_scores) WHERE rank <= 20)"""


RESULTS_SQL = r"""results AS (
  SELECT 'exp' || (event_id % 4) AS experiment, event_id // 4 AS id, event_type AS qtype,
    CASE WHEN event_id % 17 <> 0 THEN least(floor(value), 4) / 4.0 END AS recall, user_id AS cluster,
    event_id % 3 AS llm_calls, event_id % 101 AS prompt_tokens, event_id % 53 AS completion_tokens, value AS latency_s, event_id % 7 = 0 AS escalated,
    ['SIMPLE', 'MULTI_HOP', 'UNCERTAIN'][event_id % 3 + 1] AS label,
    CASE WHEN event_id % 4 = 0 THEN 'fixed:SIMPLE' ELSE 'llm' END AS route_source,
    CASE WHEN event_id % 5 <> 0 THEN ['SIMPLE', 'MULTI_HOP', 'UNCERTAIN'][(event_id // 4) % 3 + 1] END AS gold_route
  FROM events)"""
