"""Files in the folder that all executors share, by Hadoop's file system: whatever Spark can open.

Written tables cut lineage: what reads them has a scan's plan and a scan's size. (A checkpoint keeps
the size its plan was estimated at; joins multiply estimates, so a loop of joins over checkpoints
squares them each round until the numbers alone fill the driver.)
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder the session names in spark.checkpoint.dir; one of this machine only where that is
    unset, as in tests."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        at = spark.sparkContext.getCheckpointDir()
    return at


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _open(spark: SparkSession, path: str):  # noqa: ANN202
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def create(spark: SparkSession, path: str, text: str) -> bool:
    """Write a new small file whole: it is written aside and moved to its name, which fails where that name
    is taken. The file system decides between two writers, so one of them gets True; readers see all of
    the text or no file. (Spark's own logs of streams are written so.)"""
    jvm = spark._jvm
    aside, fs = _open(spark, f"{path.rpartition('/')[0]}/.{uuid.uuid4().hex}")
    out = fs.create(aside, False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(aside.toUri(), spark._jsc.hadoopConfiguration()) if aside.toUri().getScheme() else jvm.org.apache.hadoop.fs.FileContext.getFileContext(spark._jsc.hadoopConfiguration())
    kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    try:
        context.rename(aside, jvm.org.apache.hadoop.fs.Path(path), spark.sparkContext._gateway.new_array(kind, 0))
    except Exception as e:
        fs.delete(aside, False)
        if "AlreadyExists" in str(e):
            return False
        raise
    return True


def read(spark: SparkSession, path: str) -> str | None:
    """A small file's text; None where there is none."""
    at, fs = _open(spark, path)
    if not fs.exists(at):
        return None
    size = fs.getFileStatus(at).getLen()
    stream = fs.open(at)
    try:
        return bytes(stream.readNBytes(size)).decode()
    finally:
        stream.close()


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder, in order; none where it doesn't exist."""
    at, fs = _open(spark, folder)
    return sorted(n for s in fs.listStatus(at) if not (n := s.getPath().getName()).startswith(".")) if fs.exists(at) else []


def delete(spark: SparkSession, path: str) -> bool:
    at, fs = _open(spark, path)
    return fs.delete(at, True)


class Tables:
    """Tables written under one new folder, to be dropped by name when nothing reads them any more."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.folder, self.count = spark, new_folder(spark, name), 0

    def cut(self, df: DataFrame) -> DataFrame:
        """df run once, written and read again."""
        self.count += 1
        path = f"{self.folder}/{self.count:04}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop_before(self, number: int) -> None:
        """Drop the tables of lower numbers that are still there."""
        for name in names(self.spark, self.folder):
            if int(name) < number:
                delete(self.spark, f"{self.folder}/{name}")
