"""Sharding by a hypergeometric communication matrix: a uniform shuffle with exact shard sizes.

1. Rows fall into parts by a hash. Only the parts' sizes reach the driver, and their number follows the
   table's size over PART_ROWS.
2. The driver draws the matrix of how many rows each part sends to each shard: for every shard a
   multivariate hypergeometric draw from what the parts have left. Its rows and columns have exact sums,
   and it has the distribution that a uniform permutation of all rows would give it. Populations beyond
   what numpy draws from are halved by single exact draws first. 10**11 rows make 10**5 parts, a matrix
   of 30 MB for 40 shards.
3. A part permutes its rows locally and deals them out by its row of the matrix.
4. After the exchange each shard permutes what it got: rows are ordered by a second seeded key. That
   order is made of key ranges, so a shard's slots need no single task either.

The same seed deals the same rows alike, however often a task is run again.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewater.llm.common import Scratch

#: Rows in a part, and the fewest parts.
SHARDS, PART_ROWS, LEAST_PARTS = 40, 1 << 20, 64
#: numpy draws from populations below this one.
LIMIT = 10**9


def matrix(parts: list[int], shards: int, seed: int) -> np.ndarray:
    """How many rows each part sends to each shard; shard sizes are at most one apart, the first ones larger."""
    rng = np.random.default_rng(seed)
    left, total = np.array(parts, np.int64), sum(parts)
    out = np.zeros((len(parts), shards), np.int64)
    for s in range(shards):
        out[:, s] = spread(rng, left, total // shards + (s < total % shards))
        left -= out[:, s]
    return out


def spread(rng: np.random.Generator, sizes: np.ndarray, n: int) -> np.ndarray:
    """How many of n rows that are drawn from all parts come from each: a multivariate hypergeometric draw."""
    if int(sizes.sum()) < LIMIT:
        return rng.multivariate_hypergeometric(sizes, n, method="marginals")
    if len(sizes) == 1:
        return np.array([n], np.int64)
    half = len(sizes) // 2
    first = draw(rng, int(sizes[:half].sum()), int(sizes[half:].sum()), n)
    return np.concatenate([spread(rng, sizes[:half], first), spread(rng, sizes[half:], n - first)])


def draw(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """One hypergeometric draw. numpy's takes populations below LIMIT; beyond, the law itself is inverted.

    Its weights follow from one another by exact ratios. Those beyond 40 spreads and 64 rows from the
    mean are below what a float can tell from nothing.
    """
    low, high = max(0, n - bad), min(n, good)
    if low == high:
        return low
    if good < LIMIT and bad < LIMIT:
        return int(rng.hypergeometric(good, bad, n))
    share = good / (good + bad)
    spread = np.sqrt(n * share * (1 - share) * (good + bad - n) / max(1, good + bad - 1))
    reach = 40 * spread + 64
    k = np.arange(max(low, int(n * share - reach)), min(high, int(n * share + reach)) + 1)
    ratios = np.log((good - k[:-1]) / k[1:]) + np.log((n - k[:-1]) / (bad - n + k[1:]))
    logs = np.concatenate([[0.0], np.cumsum(ratios)])
    sums = np.cumsum(np.exp(logs - logs.max()))
    return int(k[min(np.searchsorted(sums, rng.random() * sums[-1], side="right"), len(k) - 1)])


def assign(docs: DataFrame, shards: int = SHARDS, seed: int = 40) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot, _row, _other) for each row of docs (doc_id, text).

    Law `rows`: shard sizes are at most one apart. size is the text's UTF-8 bytes (null: none) plus 16,
    text_crc32 the checksum of those bytes. Equal rows, and rows without doc_id, are dealt one by one
    like any others; which of two equal rows gets which place is of no account. Slots are gapless from 0
    in each shard. Other columns are ignored; an empty table gives an empty one. No text moves.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    text = F.coalesce("text", F.lit(""))
    rows = scratch.cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), *row_key(seed)))
    total = rows.count()
    parts = max(LEAST_PARTS, -(-total // PART_ROWS))
    ranges = max(8, -(-total // (shards * PART_ROWS)))
    rows = rows.withColumn("_part", F.pmod(F.xxhash64(F.lit(1), "_row"), F.lit(parts)).cast("int"))
    sizes = dict(rows.groupBy("_part").agg(F.count("*")).collect())
    sent = matrix([sizes.get(p, 0) for p in range(parts)], shards, seed)
    bounds = spark.createDataFrame([(p, np.cumsum(sent[p]).tolist()) for p in range(parts)], "_part int, _bounds array<long>")
    local = Window.partitionBy("_part").orderBy(F.xxhash64(F.lit(2), "_row"), "_row", "_other", "doc_id")
    dealt = rows.withColumn("_place", F.row_number().over(local)).join(bounds, "_part")
    dealt = dealt.withColumn("shard", F.size(F.filter("_bounds", lambda b: b < F.col("_place"))).cast("int")).drop("_bounds", "_part")
    dealt = dealt.withColumn("_key", F.xxhash64(F.lit(3), "_row", "_other", "_place")).withColumn("_range", F.pmod(F.col("_key"), F.lit(ranges)).cast("int"))
    dealt = scratch.cut(dealt)
    counts = dealt.groupBy("shard", "_range").agg(F.count("*").alias("_n"))
    before = counts.select("shard", "_range", (F.sum("_n").over(Window.partitionBy("shard").orderBy("_range")) - F.col("_n")).alias("_before"))
    again = Window.partitionBy("shard", "_range").orderBy("_key", "_row", "_other", "doc_id")
    out = dealt.withColumn("_rank", F.row_number().over(again)).join(before, ["shard", "_range"])
    return out.select("doc_id", "size", "text_crc32", "shard", (F.col("_before") + F.col("_rank") - 1).cast("long").alias("slot"), "_row", "_other")


def row_key(seed: int) -> list:
    """Two 64-bit hashes that tell rows apart."""
    return [F.xxhash64(F.lit(seed), "doc_id", "text").alias("_row"), F.xxhash64("text", "doc_id", F.lit(seed)).alias("_other")]


def sharded(docs: DataFrame, shards: int = SHARDS, seed: int = 40) -> DataFrame:
    """docs with their shard and slot, which replace columns of these names; each text moves once.

    Rows are dealt as by assign(): nulls, empty and very long texts like any others, equal rows one by
    one (which of them gets which place is of no account). Other columns may have any names. An empty
    table gives an empty one.
    """
    document = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c not in ("shard", "slot"))).alias("_document")
    twin = F.row_number().over(Window.partitionBy("_row", "_other").orderBy("_row")).alias("_twin")
    rows = docs.select(document, *row_key(seed)).select("*", twin)
    places = assign(docs, shards, seed).select("shard", "slot", "_row", "_other")
    places = places.withColumn("_twin", F.row_number().over(Window.partitionBy("_row", "_other").orderBy("shard", "slot")))
    return rows.join(places, ["_row", "_other", "_twin"]).select("_document.*", "shard", "slot")
