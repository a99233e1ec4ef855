"""What the corpus operators share: reading tables, scratch tables, and shipping code to executors."""

from __future__ import annotations

import atexit
import re
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Functions of this package travel by value, so executors need not have it installed.
cloudpickle.register_pickle_by_value(sys.modules["tidewater.llm"])

#: Bytes of text that a Python worker handles at once (a longer text is handled alone and whole).
CHUNK_BYTES = 1 << 20
#: The words that the contracts count: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: Spark's setting by which an execution deletes its shuffle files when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_own_dir: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir; a folder of our own only in local mode, where that is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not _own_dir:
        held = tempfile.TemporaryDirectory(prefix="tidewater-")
        atexit.register(held.cleanup)
        _own_dir.append(f"file://{held.name}")
    return _own_dir[0]


def delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


class Scratch:
    """Tables written to the shared folder to cut lineage. Each is whole once written, so a lost executor costs no recomputation of it.

    What a result is made of has to stay until it has been read, which only its reader knows; so the folder goes when
    the driver ends, and tables that nothing reads any more before (drop).
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, f"{scratch_dir(spark)}/tidewater-{uuid.uuid4().hex}"
        self.count = 0
        atexit.register(self.close)

    def close(self) -> None:
        try:
            delete(self.spark, self.root)
        except Exception:  # the JVM is gone already
            pass

    def cut(self, df: DataFrame) -> DataFrame:
        self.count += 1
        path = f"{self.root}/{self.count}"
        # once the table is whole, nobody needs the shuffles that made it
        was = self.spark.conf.get(CLEANUP, "false")
        self.spark.conf.set(CLEANUP, "true")
        try:
            df.write.parquet(path)
        finally:
            self.spark.conf.set(CLEANUP, was)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        """Deletes a table that nothing reads any more."""
        path = getattr(df, "_scratch_path", None)
        if path:
            delete(self.spark, path)


def small_batches(spark: SparkSession) -> None:
    """Bounds an Arrow batch by bytes and rows, so that a worker's memory does not follow the length of texts.

    The settings are read when a plan runs, so they stay; smaller ones that the caller has made are left as they are.
    """
    for name, most in (("maxRecordsPerBatch", 2000), ("maxBytesPerBatch", 8 << 20)):
        key = f"spark.sql.execution.arrow.{name}"
        now = re.fullmatch(r"(\d+)b?", spark.conf.get(key))
        if now is None or not 0 < int(now[1]) <= most:
            spark.conf.set(key, str(most))


def chunks(batch: pa.RecordBatch, text: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts a batch into runs of rows of at most about `limit` text bytes; each text stays whole."""
    sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    start, total = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if total and total + size > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield batch.slice(start)


def mapped(df: DataFrame, schema: str | StructType, per_chunk: Callable[[pa.RecordBatch], pa.RecordBatch], text: str = "text", limit: int = CHUNK_BYTES) -> DataFrame:
    """Applies `per_chunk` to the rows of df, a bounded number of text bytes at a time."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, text, limit):
                yield per_chunk(part)

    return df.mapInArrow(run, schema)


def text_bytes() -> "F.Column":
    return F.octet_length(F.coalesce(F.col("text"), F.lit("")))


def bucket_count(df: DataFrame, bytes_each: int, column: str = "text", least: int = 1) -> int:
    """How many buckets hold `bytes_each` of text each: the count grows with the table, the bucket doesn't."""
    total = df.agg(F.sum(F.octet_length(F.col(column)) + 64)).first()[0] or 0
    return max(least, -(-int(total) // bytes_each))
