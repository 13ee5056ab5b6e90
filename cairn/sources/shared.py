"""The folder that driver and executors share, for what has to be written before it is read again."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession, tag: str) -> str:
    """A fresh folder under the session's checkpoint folder. Where the session names none, a local one will do for a session in
    one process; on a cluster that is an error, as executors would write each to its own disk. It goes when the driver ends."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        root = f"file://{tempfile.gettempdir()}"
    path = f"{root.rstrip('/')}/cairn-{tag}-{uuid.uuid4().hex}"
    atexit.register(remove, spark, path)
    return path


def _file_system(spark: SparkSession, path: str):
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    """Whether any file or folder matches; asks the store that holds it, not the driver's disk."""
    _, p, fs = _file_system(spark, path)
    found = fs.globStatus(p)
    return found is not None and len(found) > 0


def create_empty(spark: SparkSession, path: str) -> None:
    _, p, fs = _file_system(spark, path)
    fs.create(p).close()


def remove(spark: SparkSession, path: str) -> None:
    try:
        _, p, fs = _file_system(spark, path)
        fs.delete(p, True)
    except Exception as error:  # at exit the session may be gone
        if spark.sparkContext._jsc is not None and spark.sparkContext._jsc.sc() is not None and not spark.sparkContext._jsc.sc().isStopped():
            raise RuntimeError(f"could not remove {path}") from error


def replace(spark: SparkSession, staged: str, path: str) -> None:
    """Renames a finished folder into place; readers see the old or the new whole, never a part."""
    jvm, source, fs = _file_system(spark, staged)
    target = jvm.org.apache.hadoop.fs.Path(path)
    if fs.exists(target):
        aside = jvm.org.apache.hadoop.fs.Path(f"{path}.old-{uuid.uuid4().hex}")
        fs.rename(target, aside)
        fs.rename(source, target)
        fs.delete(aside, True)
    else:
        fs.mkdirs(target.getParent())
        fs.rename(source, target)
