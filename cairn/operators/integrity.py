"""Provenance: manifests of corpora and benchmarks, their checks, label sidecars, drift of frozen files.

Checks give rows (level, problem, n); a check that finds nothing gives none. ``require`` turns errors into an exception, so
that an experiment does not start on data it can't trust.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import sha256_lf
from .route import LABELS

#: Errors that a caller may choose to ignore.
OVERRIDABLE = ("hash_mismatch", "missing_manifest")


def chained_sha256(rows: DataFrame, line: Column, order: str) -> DataFrame:
    """One row: sha256 over the sorted sha256 of all lines (LF line ends), so that no task holds the file."""
    each = rows.select(F.col(order).alias("o"), sha256_lf(line).alias("h"))
    parts = each.groupBy(F.floor(F.col("o") / 1000).alias("p")).agg(F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("o", "h"))), lambda x: x["h"]), "\n").cast("binary"), 256).alias("h"))
    return parts.agg(F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("p", "h"))), lambda x: x["h"]), "\n").cast("binary"), 256).alias("sha256"))


def corpus_manifest(papers: DataFrame, chunks: DataFrame) -> DataFrame:
    """(paper_id, n_chunks, chars, text_sha256) for every paper, sorted by id when it is written."""
    text = F.transform(F.sort_array(F.collect_list(F.struct("chunk_idx", sha256_lf(F.col("text")).alias("h")))), lambda x: x["h"])
    own = chunks.groupBy("paper_id").agg(F.count("*").alias("n_chunks"), F.sum(F.length("text")).alias("chars"), F.sha2(F.array_join(text, "\n").cast("binary"), 256).alias("text_sha256"))
    return papers.select("paper_id").distinct().join(own, "paper_id", "left").na.fill(0, ["n_chunks", "chars"])


def manifest_drift(told: DataFrame, found: DataFrame) -> DataFrame:
    """Rows (level, problem, n): ids only told or only found and changed texts are errors."""
    both = told.select("paper_id", F.col("text_sha256").alias("told"), F.lit(1).alias("t")).join(found.select("paper_id", F.col("text_sha256").alias("found"), F.lit(1).alias("f")), "paper_id", "full_outer")
    problem = F.when(F.col("f").isNull(), "missing_paper").when(F.col("t").isNull(), "unlisted_paper").when(~F.col("told").eqNullSafe(F.col("found")), "text_drift")
    return both.select(problem.alias("problem")).where("problem is not null").groupBy("problem").agg(F.count("*").alias("n")).select(F.lit("error").alias("level"), "problem", "n")


def binary_drift(told: DataFrame, found: DataFrame) -> DataFrame:
    """Rows (level, problem, n): missing or different binaries are only warnings."""
    met = told.select("paper_id", F.col("binary_sha256").alias("told")).join(found.select("paper_id", F.col("binary_sha256").alias("found")), "paper_id", "left")
    problem = F.when(F.col("found").isNull(), "missing_binary").when(F.col("told") != F.col("found"), "different_binary")
    return met.select(problem.alias("problem")).where("problem is not null").groupBy("problem").agg(F.count("*").alias("n")).select(F.lit("warning").alias("level"), "problem", "n")


def sidecar_problems(labels: DataFrame, questions: DataFrame) -> DataFrame:
    """labels (id, label) against questions (id): missing and extra ids, blank ids, labels that are none of the known."""
    both = labels.select("id", "label", F.lit(1).alias("l")).join(questions.select("id", F.lit(1).alias("q")), "id", "full_outer")
    tests = F.array(
        F.when(F.col("l").isNull(), "missing_label"), F.when(F.col("q").isNull(), "extra_label"),
        F.when(F.col("l").isNotNull() & ~F.coalesce(F.col("label").isin(*LABELS), F.lit(False)), "unknown_label"), F.when(F.trim(F.col("id").cast("string")) == "", "blank_id"),
    )
    named = both.select(F.explode(F.filter(tests, lambda t: t.isNotNull())).alias("problem"))
    return named.groupBy("problem").agg(F.count("*").alias("n")).select(F.lit("error").alias("level"), "problem", "n")


def benchmark_problems(manifest: dict | None, questions: DataFrame | None, sha256: str | None) -> list[str]:
    """Fail-closed checks on the driver before any plan is built; only some may be overridden."""
    if questions is None:
        return ["missing_questions"]
    if manifest is None:
        return ["missing_manifest"]
    digest = manifest.get("questions_sha256")
    out = []
    if not isinstance(manifest.get("benchmark_id"), str) or not manifest["benchmark_id"]:
        out.append("invalid_id")
    if not isinstance(digest, str) or len(digest) != 64 or set(digest) - set("0123456789abcdef"):
        out.append("invalid_hash")
    elif digest != sha256:
        out.append("hash_mismatch")
    if questions.isEmpty():
        out.append("empty_questions")
    return out


def require(problems: list[str], override: bool = False) -> None:
    left = [p for p in problems if not (override and p in OVERRIDABLE)]
    if left:
        raise ValueError("the benchmark can't be trusted: " + ", ".join(left))


def refresh_problems(manifest: dict, finalised: DataFrame) -> list[str]:
    """What forbids rewriting a manifest's hash: missing keys, counts or types that moved, no history of rejections."""
    missing = [f"missing_{k}" for k in ("benchmark_id", "questions_sha256", "n_questions", "by_type", "rejected_by_reason") if k not in manifest]
    if missing:
        return missing
    types = {r.qtype: int(r.n) for r in finalised.groupBy("qtype").agg(F.count("*").alias("n")).collect()}  # five types
    out = [] if sum(types.values()) == manifest["n_questions"] else ["count_changed"]
    return out + ([] if types == manifest["by_type"] else ["types_changed"]) + ([] if manifest["rejected_by_reason"] else ["no_rejection_history"])


def frozen_drift(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, change) between two snapshots (path, digest) of frozen files; digests are 16 digits over LF line ends."""
    both = before.withColumnRenamed("digest", "was").join(after.withColumnRenamed("digest", "now"), "path", "full_outer")
    change = F.when(F.col("now").isNull(), "removed").when(F.col("was").isNull(), "added").when(F.col("was") != F.col("now"), "changed")
    return both.select("path", change.alias("change")).where("change is not null")


def snapshot(spark: SparkSession, path: str) -> DataFrame:
    """(path, digest) of text files under a folder or glob."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.substring(sha256_lf(F.decode("content", "UTF-8")), 1, 16).alias("digest"))


def identical_files(files: DataFrame, most_bytes: int) -> DataFrame:
    """binaryFile rows -> (problem, path): files that repeat another's bytes and files over a size."""
    digest = files.select("path", "length", F.sha2("content", 256).alias("h"))
    many = digest.groupBy("h").agg(F.count("*").alias("n"), F.min("path").alias("kept")).where("n > 1")
    repeated = digest.join(many, "h").where("path <> kept").select(F.lit("identical").alias("problem"), "path")
    return repeated.unionByName(digest.where(F.col("length") > most_bytes).select(F.lit("too_large").alias("problem"), "path"))
