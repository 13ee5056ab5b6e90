"""JSON lines in and out: schema-bound scans, a scan that survives malformed rows, atomic and resumable sinks."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import exists, remove, replace

QUESTION = (
    "id string, question string, qtype string, reference_answer string, gold_chunk_ids array<string>, gold_paper_ids array<string>, split string, status string, "
    "gold_route string, oracle_sufficient boolean, notes string, gold_route_v2 string, ladder_recalls map<string,double>, validation string"
)
CHUNK = "chunk_id string, paper_id string, title string, section string, text string"


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Blank lines are skipped, missing fields are null; no pass over the data infers anything."""
    return spark.read.schema(schema).json(path)


def read_tolerant(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """(good rows, bad lines): lines that are no JSON object of the schema are set aside instead of failing the scan."""
    wide = T.StructType([*schema.fields, T.StructField("_bad", T.StringType())])
    parsed = F.from_json("value", wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    lines = spark.read.text(path).where(F.trim("value") != "").select("value", parsed.alias("row"))
    sound = F.col("row._bad").isNull() & F.startswith(F.ltrim("value"), F.lit("{"))
    return lines.where(sound).select(*[F.col("row").getField(f.name).alias(f.name) for f in schema.fields]), lines.where(~sound).select(F.col("value").alias("line"))


def load_questions(spark: SparkSession, path: str, status: str | None = None, split: str | None = None) -> DataFrame:
    """Questions with fields that older files lack as their defaults, filtered in the scan; a missing path is no questions."""
    if not exists(spark, path):
        return spark.createDataFrame([], QUESTION)
    rows = read_jsonl(spark, path, QUESTION).fillna({"split": "test", "status": "candidate", "notes": "", "validation": ""})
    rows = rows if status is None else rows.where(F.col("status") == status)
    return rows if split is None else rows.where(F.col("split") == split)


def save_atomically(df: DataFrame, path: str) -> None:
    """Writes beside the target and renames, so an interruption leaves what was there."""
    staged = f"{path}.staged-{uuid.uuid4().hex}"
    df.write.json(staged, ignoreNullFields=False)
    replace(df.sparkSession, staged, path)


def append_new(df: DataFrame, path: str, key: str = "id") -> DataFrame:
    """Appends rows whose key the sink does not hold yet and returns them: a run resumes where it stopped."""
    spark = df.sparkSession
    fresh = df
    if exists(spark, path):
        fresh = df.join(spark.read.schema(df.schema).json(path).select(key).distinct(), key, "left_anti")
    fresh.write.mode("append").json(path, ignoreNullFields=False)
    return fresh


def read_experiments(spark: SparkSession, folder: str, schema: T.StructType | str) -> DataFrame:
    """All *.jsonl of a folder with the file's stem as ``experiment``; empty files give no rows."""
    rows = spark.read.schema(schema).json(f"{folder}/*.jsonl")
    return rows.withColumn("experiment", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.jsonl(?:/[^/]*)?$", 1))


def write_experiments(rows: DataFrame, folder: str) -> None:
    """Result rows as one ``<experiment>.jsonl`` each, a folder of part files where an experiment has several."""
    spark, staged = rows.sparkSession, f"{folder}.staged-{uuid.uuid4().hex}"
    rows.write.partitionBy("experiment").json(staged, ignoreNullFields=False)
    for name in [r.experiment for r in rows.select("experiment").distinct().collect()]:  # a handful of experiments
        replace(spark, f"{staged}/experiment={name}", f"{folder}/{name}.jsonl")
    remove(spark, staged)


def first_wins(sources: Sequence[DataFrame], key: str, line: str) -> DataFrame:
    """Union in order of priority; of rows with one key the first source's first line stays."""
    marked = [df.withColumn("_priority", F.lit(i)) for i, df in enumerate(sources)]
    every = marked[0]
    for df in marked[1:]:
        every = every.unionByName(df)
    order = W.partitionBy(key).orderBy("_priority", line)
    return every.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n", "_priority")


def chunk_files(spark: SparkSession, index_dir: str, processed_dir: str, root: str) -> list[str]:
    """Paths that exist, in the order in which they win: active index, processed folder, then the others sorted, once each."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(f"{root}/data/processed*/chunks.jsonl")
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p) or []
    paths = [f"{index_dir}/chunks.jsonl", f"{processed_dir}/chunks.jsonl", *sorted(f.getPath().toString() for f in found)]
    return list({jvm.org.apache.hadoop.fs.Path(x).toUri().getPath(): x for x in reversed(paths) if exists(spark, x)}.values())[::-1]


def write_section_labels(sections: DataFrame, path: str) -> None:
    """CSV (section, n, sample, is_evidence) for a person to fill in."""
    dump = sections.groupBy("section").agg(F.count("*").alias("n"), F.min(F.regexp_replace(F.substring("text", 1, 200), r"\s+", " ")).alias("sample")).withColumn("is_evidence", F.lit(""))
    dump.write.mode("overwrite").option("header", True).option("quoteAll", True).csv(path)


def read_section_labels(spark: SparkSession, path: str) -> DataFrame:
    labels = spark.read.schema("section string, n long, sample string, is_evidence string").option("header", True).csv(path)
    return labels.withColumn("is_evidence", F.lower(F.trim("is_evidence")))


def save_index(chunks: DataFrame, vectors: DataFrame, path: str) -> None:
    """Checks the index, then publishes chunks and vectors as one folder of tables."""
    from ..operators.index import require_valid

    require_valid(chunks, vectors)
    staged = f"{path}.staged-{uuid.uuid4().hex}"
    chunks.write.parquet(f"{staged}/chunks")
    vectors.write.parquet(f"{staged}/vectors")
    replace(chunks.sparkSession, staged, path)


def load_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/chunks"), spark.read.parquet(f"{path}/vectors")


def publish_chunks(chunks: DataFrame, failures: DataFrame, path: str, allow_missing: bool = False) -> None:
    """Publishes a corpus only if every record could be parsed, or if the caller accepts the gaps."""
    if not allow_missing and not failures.isEmpty():
        raise ValueError("some records could not be parsed; nothing was published")
    save_atomically(chunks, path)
