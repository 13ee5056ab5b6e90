"""Shared plumbing of the training-data operators: scratch tables, table reading, byte-level helpers."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of bytes outside this class; it equals what ``bytes.split()`` splits on.
SPACE_CLASS = r"[\x20\x09-\x0D]+"
WORD_CLASS = r"[^\x20\x09-\x0D]+"


#: Python workers see batches of about so many bytes, whatever the length of texts.
BATCH_SETTING, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def id_crc(col: str = "doc_id") -> Column:
    """crc32 of the id written as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary"))


def checkpoint_root(spark: SparkSession) -> str:
    """The folder all executors share. Where the session names none, a local one is made for a session in one process, as in
    tests; on a cluster that is an error, as every executor would write to its own disk."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        root = f"file://{tempfile.mkdtemp(prefix='cairn-')}"
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Python workers of the jobs started inside see batches of BATCH_BYTES."""
    held = spark.conf.get(BATCH_SETTING, None)
    spark.conf.set(BATCH_SETTING, BATCH_BYTES)
    try:
        yield
    finally:
        spark.conf.unset(BATCH_SETTING) if held is None else spark.conf.set(BATCH_SETTING, held)


class Scratch:
    """Parquet tables in the shared folder: they cut lineage and survive the loss of any executor."""

    def __init__(self, spark: SparkSession, tag: str):
        self.spark, self.root = spark, f"{checkpoint_root(spark)}/cairn-{tag}-{uuid.uuid4().hex}"
        atexit.register(self.drop)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        with small_batches(self.spark):
            df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str = "") -> None:
        """Deletes one table, or all; only for tables that no returned DataFrame reads any more."""
        try:
            jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)
            path.getFileSystem(conf).delete(path, True)
        except Exception as error:  # the session may have ended before the exit hook runs
            if name:
                raise RuntimeError(f"could not drop scratch table {name}") from error


def slices(sizes: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Cuts rows into consecutive slices of at most ``limit`` bytes together (a longer row stands alone)."""
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > limit:
            yield start, i
            start, total = i, 0
        total += int(n)
    if start < len(sizes):
        yield start, len(sizes)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (wrapping multiply and shift)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


HEAVY_SHARE = 1000


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, total: int) -> DataFrame:
    """Left join of rows with one-per-key groups whose ``size`` is their number of rows, without hot tasks.

    Groups of over 1/HEAVY_SHARE of all rows are fewer than HEAVY_SHARE whatever the input, so they are broadcast;
    what they don't match is shuffled by key, where no key has more than that share.
    """
    heavy = F.broadcast(groups.where(F.col(size) * HEAVY_SHARE > total))
    light = groups.where(F.col(size) * HEAVY_SHARE <= total)
    met = rows.join(heavy, keys, "left")
    rest = met.where(F.col(size).isNull()).select(*rows.columns).join(light, keys, "left")
    return met.where(F.col(size).isNotNull()).unionByName(rest)


def hash_sample(df: DataFrame, key: str, salt: int, n: int) -> DataFrame:
    """The n rows that a hash of ``key`` draws first; the same rows however large the table's number of partitions.

    Rows that can't be among them (their draw is over twice the share that is wanted) are left out before the sort, so
    that no partition sends n rows of its own.
    """
    total, ends = df.count(), 1 << 40
    drawn = df.withColumn("_draw", F.pmod(F.xxhash64(key, F.lit(salt)), F.lit(ends)))
    if total > 2 * n:
        drawn = drawn.where(F.col("_draw") < ends * 2 * n // total)
    return drawn.orderBy("_draw", key).limit(n).drop("_draw")
