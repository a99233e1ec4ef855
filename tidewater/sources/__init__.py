"""Reading tables from files and writing them."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

FORMATS = ("parquet", "orc", "csv", "json")


def read(spark: SparkSession, path: str, kind: str = "parquet", **options) -> DataFrame:
    """A file or folder of files as a lazy DataFrame; filters and columns reach the scan."""
    if kind not in FORMATS:
        raise ValueError(f"unknown format {kind}")
    return spark.read.format(kind).options(**options).load(path)


def read_delimited(spark: SparkSession, path: str, schema: str, options: dict) -> DataFrame:
    """What BULK INSERT reads: FIELDTERMINATOR, ROWTERMINATOR and FIRSTROW as Spark's options."""
    decode = lambda x: str(x).encode().decode("unicode_escape")
    reader = spark.read.schema(schema).option("sep", decode(options.get("fieldterminator", "\\t"))).option("mode", "FAILFAST")
    if "rowterminator" in options and decode(options["rowterminator"]) not in ("\n", "\r\n"):
        reader = reader.option("lineSep", decode(options["rowterminator"]))
    if str(options.get("format", "")).lower() == "csv":
        reader = reader.option("sep", decode(options.get("fieldterminator", ","))).option("quote", '"')
    return reader.option("header", str(options.get("firstrow", 1)) == "2").csv(path)


def write(df: DataFrame, path: str, kind: str = "parquet", partition_by: list[str] | None = None, mode: str = "overwrite") -> None:
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.format(kind).save(path)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file through Spark's file systems, so the path can be in any store."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    out.write(bytearray(text.encode()))
    out.close()


def read_text(spark: SparkSession, path: str) -> str:
    return "\n".join(r.value for r in spark.read.text(path).collect())


def snapshot(value) -> str:
    return json.dumps(value, indent=1, sort_keys=True)
