"""Tables as versions: immutable segments of rows that carry a row id."""

from __future__ import annotations

import atexit
import itertools
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RID = "_rid"
#: Row ids of a segment lie this far from those of the next.
SEGMENT = 1 << 52
_own: list = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; one of our own only in local mode, where that is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not _own:
        held = tempfile.TemporaryDirectory(prefix="tidewater-tables-")
        atexit.register(held.cleanup)
        _own.append(f"file://{held.name}")
    return _own[0]


class Store:
    """Writes versions to the shared folder, which cuts their lineage and outlives a lost executor."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/tables-{uuid.uuid4().hex}"
        self.numbers = itertools.count(1)
        self.written: set[str] = set()

    def write(self, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{next(self.numbers)}"
        df.write.parquet(path)
        self.written.add(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def vacuum(self, live: list[DataFrame]) -> int:
        """Deletes the written segments that none of these tables reads; gives how many went."""
        files = [f for df in live for f in df.inputFiles()]
        gone = [p for p in self.written if not any(f"{p.split('://')[-1]}/" in f for f in files)]
        for path in gone:
            target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)
            self.written.discard(path)
        return len(gone)

    def segment(self, df: DataFrame) -> DataFrame:
        """df as written rows with ids that no other segment uses."""
        base = next(self.numbers) * SEGMENT
        return self.write(df.drop(RID).withColumn(RID, F.monotonically_increasing_id() + F.lit(base)))

    def numbered(self, df: DataFrame, first: int, step: int, column: str) -> DataFrame:
        """df with consecutive numbers in the order of its rows: places within partitions and partition offsets."""
        held = self.write(df.withColumn("_place", F.monotonically_increasing_id()))
        part = F.shiftrightunsigned("_place", 33)
        counts = held.groupBy(part.alias("p")).agg(F.count("*").alias("n")).orderBy("p").collect()
        offsets, total = {}, 0
        for row in counts:
            offsets[row.p], total = total, total + row.n
        # a row a partition, so it is broadcast
        starts = F.broadcast(self.spark.createDataFrame(list(offsets.items()), "_part long, _start long"))
        place = F.col("_place").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("_start")
        named = held.withColumn("_part", part).join(starts, "_part").withColumn(column, (F.lit(first) + F.lit(step) * place).cast("bigint"))
        return named.drop("_place", "_part", "_start"), total
