"""Queries of sources and sinks (written to the shared folder and read again) and of fetch plans, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources import fetch, jsonl
from ..sources.shared import create_empty, shared_folder
from ..streaming import resume
from . import views as V
from .registry import query


def _questions(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("doc_id")
    d = V.table(spark, sf, "documents")
    return d.select(
        i.cast("string").alias("id"), F.coalesce("text", F.lit("")).alias("question"), F.when(i % 3 == 0, "accepted").when(i % 3 == 1, "candidate").alias("status"), F.when(i % 2 == 0, "train").alias("split"),
        F.array(F.col("source")).alias("gold_paper_ids"),
    )


@query(r"""SELECT doc_id::VARCHAR AS id, length(coalesce(text, '')) AS chars, md5(coalesce(text, '')) AS digest, 'accepted' AS status, 'test' AS split, '' AS notes FROM documents WHERE doc_id % 3 = 0 AND doc_id % 2 = 1""")
def jsonl_filter_status(spark: SparkSession, sf: str) -> DataFrame:
    """Questions written as JSON lines, read back with defaults for missing fields and a pushed-in predicate."""
    path = f"{shared_folder(spark, 'questions')}/q"
    jsonl.save_atomically(_questions(spark, sf), path)
    q = jsonl.load_questions(spark, path, status="accepted", split="test")
    return q.select("id", F.length("question").cast("long").alias("chars"), F.md5(F.col("question").cast("binary")).alias("digest"), "status", "split", "notes")


@query(r"""SELECT 'good' AS kind, count(*) AS n FROM documents WHERE doc_id % 4 NOT IN (0, 1) UNION ALL SELECT 'bad', count(*) FROM documents WHERE doc_id % 4 IN (0, 1)""")
def jsonl_tolerant(spark: SparkSession, sf: str) -> DataFrame:
    """A file with cut rows, bare values and blank lines."""
    path = f"{shared_folder(spark, 'tolerant')}/t"
    i = F.col("doc_id")
    line = F.when(i % 4 == 0, '{"id": "cut').when(i % 4 == 1, "[1, 2]").otherwise(F.to_json(F.struct(i.cast("string").alias("id"), "lang")))
    d = V.table(spark, sf, "documents")
    d.select(line.alias("value")).unionByName(d.select(F.lit("").alias("value"))).write.text(path)
    good, bad = jsonl.read_tolerant(spark, path, T._parse_datatype_string("id string, lang string"))
    return good.agg(F.lit("good").alias("kind"), F.count("*").alias("n")).unionByName(bad.agg(F.lit("bad").alias("kind"), F.count("*").alias("n")))


@query(r"""SELECT doc_id AS chunk_id, CASE WHEN doc_id % 2 = 0 THEN 'a' WHEN doc_id % 3 = 0 THEN 'b' ELSE 'c' END AS file FROM documents""")
def first_file_wins_union(spark: SparkSession, sf: str) -> DataFrame:
    d = V.table(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("doc_id").alias("line"))
    files = [d.where("chunk_id % 2 = 0").withColumn("file", F.lit("a")), d.where("chunk_id % 3 = 0").withColumn("file", F.lit("b")), d.withColumn("file", F.lit("c"))]
    return jsonl.first_wins(files, "chunk_id", "line").select("chunk_id", "file")


@query(r"""SELECT doc_id AS id, CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 2 END AS run FROM documents""")
def resume_anti_join(spark: SparkSession, sf: str) -> DataFrame:
    """A sink that a stopped run left, gone on with by a second run over everything."""
    path = f"{shared_folder(spark, 'resume')}/r"
    d = V.table(spark, sf, "documents").select(F.col("doc_id").alias("id"))
    jsonl.append_new(d.where("id % 3 = 0").withColumn("run", F.lit(1)), path)
    jsonl.append_new(d.withColumn("run", F.lit(2)), path)
    return jsonl.read_jsonl(spark, path, "id long, run int")


@query(r"""SELECT 'exp' || (event_id % 4) AS experiment, count(*) AS n, sum(event_id)::BIGINT AS ids FROM events GROUP BY 1""")
def experiment_directory(spark: SparkSession, sf: str) -> DataFrame:
    """Result files by experiment in one folder, an empty one of an aborted run among them; the file's name is the experiment."""
    path = f"{shared_folder(spark, 'experiments')}/results"
    rows = V.table(spark, sf, "events").select(F.concat(F.lit("exp"), F.col("event_id") % 4).alias("experiment"), F.col("event_id").alias("id"))
    jsonl.write_experiments(rows, path)
    create_empty(spark, f"{path}/aborted.jsonl")
    return jsonl.read_experiments(spark, path, "id long").groupBy("experiment").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


@query(r"""SELECT lang AS section, count(*) AS n, '' AS is_evidence FROM documents GROUP BY lang""")
def section_label_csv(spark: SparkSession, sf: str) -> DataFrame:
    path = f"{shared_folder(spark, 'sections')}/csv"
    jsonl.write_section_labels(V.chunks(spark, sf), path)
    return jsonl.read_section_labels(spark, path).select("section", "n", F.coalesce("is_evidence", F.lit("")).alias("is_evidence"))


@query(r"""WITH q AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'cat:a OR cat:b' ELSE '(cat:a OR cat:b) AND (all:"k' || (event_id % 5) || '")' END AS q FROM events)
  SELECT event_id, CASE event_id % 4 WHEN 0 THEN q WHEN 1 THEN '(' || q || ') AND submittedDate:[202001010000 TO 209912312359]' WHEN 2 THEN '(' || q || ') AND submittedDate:[199101010000 TO 202112312359]' ELSE '(' || q || ') AND submittedDate:[202001010000 TO 202112312359]' END AS query FROM q""")
def api_query_text(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("event_id")
    keys = F.when(i % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("k"), i % 5)))
    q = fetch.api_query(F.array(F.lit("a"), F.lit("b")), keys, F.when(i % 2 == 1, "2020-01-01"), F.when(i % 4 >= 2, "2021-12-31"))
    return V.table(spark, sf, "events").select("event_id", q.alias("query"))


@query(r"""WITH l AS (SELECT page_id AS id, row_number() OVER (ORDER BY page_id DESC) AS place, (2000 + page_id % 40)::VARCHAR || '-06-01' AS by_rank, strftime(DATE '2000-01-01' + (page_id * 10)::INT, '%Y-%m-%d') AS by_day FROM pages),
  d AS (SELECT 'date' AS sort, id FROM (SELECT *, max((by_day < '2001-06-01')::INT) OVER (ORDER BY place) AS ended FROM l) WHERE ended = 0 AND by_day <= '2006-01-01' AND id % 5 <> 0)
  SELECT * FROM d UNION ALL SELECT 'relevance', id FROM l WHERE by_rank >= '2001-06-01' AND by_rank <= '2006-01-01' AND id % 5 <> 0""")
def fetch_window(spark: SparkSession, sf: str) -> DataFrame:
    """What a listing by date and one by relevance leave to fetch, a fifth of the papers being there already."""
    from pyspark.sql import Window as W

    i = F.col("page_id")
    pages = V.table(spark, sf, "pages")
    ranked = pages.select(i.alias("id"), F.row_number().over(W.orderBy(i.desc())).alias("place"))
    seen = pages.where("page_id % 5 = 0").select(i.alias("id"))
    days = ranked.withColumn("published", F.date_format(F.date_add(F.lit("2000-01-01").cast("date"), (F.col("id") * 10).cast("int")), "yyyy-MM-dd"))
    relevance = ranked.withColumn("published", F.concat(F.col("id") % 40 + 2000, F.lit("-06-01")))
    most = 1 << 30
    out = fetch.wanted(days, seen, "2001-06-01", "2006-01-01", most).select(F.lit("date").alias("sort"), "id")
    return out.unionByName(fetch.wanted(relevance, seen, "2001-06-01", "2006-01-01", most, sort="relevance").select(F.lit("relevance").alias("sort"), "id"))


@query(r"""SELECT page_id % 3 <> 0 AS present, count(*) AS n FROM pages GROUP BY 1""")
def refetch_plan(spark: SparkSession, sf: str) -> DataFrame:
    p = V.table(spark, sf, "pages").select(F.col("page_id").alias("id"))
    return fetch.refetch_plan(p, p.where("id % 3 <> 0")).groupBy("present").agg(F.count("*").alias("n"))


@query(r"""WITH t AS (SELECT page_id AS id, row_number() OVER (ORDER BY page_id) AS i, CASE WHEN page_id % 5 = 0 THEN 503 ELSE 200 END AS status FROM pages WHERE page_id % 3 = 0), l AS (SELECT * FROM t WHERE i <= 20)
  SELECT 'limited' AS kind, (SELECT count(*) FROM pages WHERE page_id % 3 <> 0) AS present, count(*) AS to_download, count(*) FILTER (WHERE status = 200) AS downloaded, coalesce(string_agg(id || ':' || status, ' ' ORDER BY id) FILTER (WHERE status <> 200), '') AS failed FROM l
  UNION ALL SELECT 'dry', (SELECT count(*) FROM pages WHERE page_id % 3 <> 0), count(*), 0, '' FROM t""")
def refetch_outcome(spark: SparkSession, sf: str) -> DataFrame:
    """Missing files asked for again: the first twenty of them, with what the service refused, and all of them in a dry run."""
    i = F.col("id")
    p = V.table(spark, sf, "pages").select(F.col("page_id").alias("id"), F.col("page_id").alias("place"))
    answers = p.select("id", F.when(i % 5 == 0, 503).otherwise(200).alias("status"))
    run = lambda kind, **how: fetch.refetched(p, p.where("id % 3 <> 0"), answers, **how).select(
        F.lit(kind).alias("kind"), "present", "to_download", "downloaded", F.array_join(F.transform("failed", lambda f: F.concat(f["id"].cast("string"), F.lit(":"), f["status"].cast("string"))), " ").alias("failed"))
    return run("limited", limit=20).unionByName(run("dry", dry_run=True))


@query(r"""SELECT page_id AS id, CASE WHEN page_id % 3 = 0 THEN 'active/' || page_id WHEN page_id % 3 = 1 THEN 'stored/' || page_id END AS path FROM pages""")
def resolve_paths(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("id")
    p = V.table(spark, sf, "pages").select(F.col("page_id").alias("id")).withColumn("pdf_path", F.concat(F.lit("stored/"), i))
    active = p.where("id % 3 = 0").select("id", F.concat(F.lit("active/"), i).alias("path"))
    return fetch.resolved_paths(p, active, p.where("id % 3 < 2").select(F.col("pdf_path").alias("path")))


@query(r"""SELECT 'q' || doc_id || 'v' || (doc_id % 3) AS id FROM documents WHERE doc_id NOT IN (1, 2) UNION ALL SELECT 'new1v1'""")
def curated_corpus(spark: SparkSession, sf: str) -> DataFrame:
    base = V.table(spark, sf, "documents").select(F.concat(F.lit("q"), "doc_id", F.lit("v"), F.col("doc_id") % 3).alias("id"))
    return fetch.curated(base, ["q1", "q2"], spark.createDataFrame([("new1v1",)], "id string"))


@query(r"""SELECT event_id % 1000 AS id FROM events GROUP BY 1""")
def stream_resume(spark: SparkSession, sf: str) -> DataFrame:
    """An extension: a stream over the events that lets each id through once, run twice on one checkpoint."""
    path = shared_folder(spark, "stream")
    source = f"{sf}/events.parquet*"
    schema = V.table(spark, sf, "events").schema
    for _ in range(2):
        rows = resume.read_stream(spark, source, schema).select((F.col("event_id") % 1000).alias("id"))
        resume.run_once(resume.new_rows(rows, "id"), f"{path}/out", f"{path}/checkpoint")
    return spark.read.schema("id long").parquet(f"{path}/out")
