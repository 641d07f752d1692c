"""What the text operators share: reading tables, the shared folder, cut lineage."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, by any path that Spark's readers open."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see. The session names it in spark.checkpoint.dir;
    only where that is unset (tests on one machine) a fresh temporary one is made."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Run df once and read it back from the shared folder: a lost executor then
    costs only the tasks it was running. Spark removes the files once unused."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Let go of the shuffle files and checkpoints of jobs that are done. Spark removes them
    when the driver's references to them are collected, which may otherwise be much later."""
    gc.collect()
    for _ in range(2):  # what holds files goes in the first pass, the files in the second
        spark.sparkContext._jvm.System.gc()


@contextmanager
def shuffles_end(spark: SparkSession) -> Iterator[None]:
    """Here the shuffle files of a job go when it ends. Without it they go when the driver's
    references are collected, which a collection asked for (release) doesn't bring about in every case."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    old = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if old is None else spark.conf.set(name, old)


def _bytes(size: str) -> int:
    """A size as Spark's settings say it."""
    number = size.lower().rstrip("b")
    unit = number[-1] if number[-1] in "kmgt" else ""
    return int(number.removesuffix(unit)) << 10 * " kmgt".index(unit or " ")


@contextmanager
def dealt_by_size(docs: DataFrame, most: int = 16 << 20) -> Iterator[None]:
    """Here shuffles have a partition for each so many bytes of the files docs are read from, where the session
    has fewer. What a task of a large shuffle holds stays in memory then; adaptive execution merges small ones."""
    spark, name = docs.sparkSession, "spark.sql.shuffle.partitions"
    old = spark.conf.get(name)
    pieces = max(1, _bytes(spark.conf.get("spark.sql.files.maxPartitionBytes")) // most)
    spark.conf.set(name, str(max(int(old), docs.rdd.getNumPartitions() * pieces)))
    try:
        yield
    finally:
        spark.conf.set(name, old)


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def text_or_empty(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key and text alone (clashing extra columns go), null text as empty."""
    return df.select(F.col(key), F.coalesce(F.col(text).cast("string"), F.lit("")).alias(text))


def slices(batches: Iterable[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Small pieces of Arrow batches, so that few texts are Python objects at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def filesystem(uri: str):
    """A pyarrow file system and the path in it; a bare path is a local one."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if ":" in uri else f"file://{uri}")


def model_path() -> str:
    """The SentencePiece model among the public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def ranks_path() -> str:
    """The byte-level ranks among the public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")
