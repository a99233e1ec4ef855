"""Connected components of links between integer ids, entirely in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import Scratch


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
    return tuple(row)


def components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """(node, component) for every id in edges (a, b): component is the least id that links reach.

    Alternates the two star contractions: every id sends its larger neighbours to its least
    neighbour, then its smaller ones. The number of edges never grows, rounds grow with the
    logarithm of the ids, and hot ids are pre-aggregated (least neighbour) before each shuffle.
    Self links and repeated links are allowed; an empty table gives an empty one.
    """
    now = scratch.cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = _mark(now)
    while mark[0]:
        both = now.unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionAll(low.select("a", F.col("m").alias("b")))
        new = scratch.cut(small.distinct())
        scratch.drop(now)
        was, mark, now = mark, _mark(new), new
        if mark == was:
            break
    roots = now.select(F.col("b").alias("node")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(roots.select("node", F.col("node").alias("component")))
