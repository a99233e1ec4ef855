"""The corpus pipeline: each stage calls one operator of tidewater.llm on all rows its predecessor kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
documents, the last adds shard and slot. Tables that a stage learns from or compares with (labels,
benchmark) are read from sf_dir.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewater.llm.common import Scratch, table
from tidewater.llm.decontaminate import without_contaminated
from tidewater.llm.mixing import mixed
from tidewater.llm.near_dups import without_near_dups
from tidewater.llm.sharding import sharded
from tidewater.llm.toxicity import without_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents whose toxicity score reaches 0.3."""
    return without_toxic(docs, table(spark, sf_dir, "labels"))


def near_dups(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of least doc_id of each group (five words, similarity of 0.8 or more)."""
    return without_near_dups(docs, words=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold an item of the benchmark."""
    return without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out or repeats documents so that sources come near their targets."""
    return mixed(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds each row's shard and its slot there."""
    return sharded(docs, shards=40)


STAGES = [("toxicity", toxicity), ("near_dups", near_dups), ("decontamination", decontamination), ("mixing", mixing), ("sharding", sharding)]

#: SQL has neither the trained classifier nor the seeded orders; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each is written and read again, as the next one's docs."""
    scratch, docs = Scratch(spark), table(spark, sf_dir, "documents")
    for at, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at < len(STAGES) - 1:
            docs = scratch.cut(docs)
    return docs
