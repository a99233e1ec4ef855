"""Windowed aggregation over streams, an extension: the same DataFrame code for batch and stream."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.operators.versions import shared_dir


def windowed(events: DataFrame, time: str, width: str, late: str, key: str, value: str) -> DataFrame:
    """(start, key, n, total) for each tumbling window; rows later than `late` are dropped by a stream."""
    stamped = events.withColumn("_at", F.col(time).cast("timestamp"))
    if events.isStreaming:
        stamped = stamped.withWatermark("_at", late)
    out = stamped.groupBy(F.window("_at", width).alias("w"), key).agg(F.count("*").alias("n"), F.round(F.sum(value), 4).alias("total"))
    return out.select(F.col("w.start").cast("timestamp_ntz").alias("start"), key, "n", "total")


def drained(spark: SparkSession, path: str, plan: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Runs a plan as a stream over the files there are, to its end, and returns the last state of its result."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rpartition("/")
    source = spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder) if name.endswith(".parquet") else spark.readStream.schema(schema).parquet(path)
    root = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    held = plan(source)
    query = held.writeStream.outputMode("complete").option("checkpointLocation", f"{root}/state").foreachBatch(lambda df, epoch: df.write.mode("overwrite").parquet(f"{root}/out")).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(held.schema).parquet(f"{root}/out")
