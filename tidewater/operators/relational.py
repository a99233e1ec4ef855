"""Relational operators that Spark's DataFrames lack or that T-SQL defines otherwise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def int_div(x: Column, y: Column) -> Column:
    """Integer division that truncates towards zero."""
    quotient = x.cast("decimal(38,0)") / y.cast("decimal(38,0)")
    return F.when(quotient < 0, F.ceil(quotient)).otherwise(F.floor(quotient)).cast("bigint")


def int_avg(x: Column) -> Column:
    """AVG of integers as T-SQL gives it: truncated."""
    return int_div(F.sum(x), F.count(x))


def pivot(df: DataFrame, keep: list[str], column: str, values: list[str], aggregate, value: str) -> DataFrame:
    """One output column a value (matched as text, ignoring case); groups that lack a value get NULL."""
    cells = [aggregate(F.when(F.lower(F.col(column).cast("string")) == v.lower(), F.col(value))).alias(v) for v in values]
    return df.groupBy(*keep).agg(*cells) if keep else df.agg(*cells)


def unpivot(df: DataFrame, columns: list[str], name: str, value: str) -> DataFrame:
    """Columns to rows; NULLs are left out."""
    fixed = [c for c in df.columns if c not in columns]
    return df.unpivot(fixed, columns, name, value).where(F.col(value).isNotNull())


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each group, which Spark limits in every task before it shuffles."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")


def groups_frame(df: DataFrame, keys: list[str], order: Column, low: int, high: int, aggregate: Column, alias: str) -> DataFrame:
    """A GROUPS frame: the dense rank of peers, then a RANGE frame over it."""
    ranked = df.withColumn("_peer", F.dense_rank().over(Window.partitionBy(*keys).orderBy(order)).cast("bigint"))
    frame = Window.partitionBy(*keys).orderBy("_peer").rangeBetween(low, high)
    return ranked.withColumn(alias, aggregate.over(frame)).drop("_peer")


def same_rows(left: DataFrame, right: DataFrame, every: bool = False) -> DataFrame:
    return left.intersectAll(right) if every else left.intersect(right)


def other_rows(left: DataFrame, right: DataFrame, every: bool = False) -> DataFrame:
    return left.exceptAll(right) if every else left.subtract(right)


def salted_join(big: DataFrame, small: DataFrame, keys: list[str], salts: int, how: str = "inner") -> DataFrame:
    """An equi-join whose hot keys are spread over `salts` tasks: rows of the small side are copied, once a salt."""
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError("a salted join keeps the big side")
    left = big.withColumn("_salt", F.pmod(F.xxhash64(*[F.col(c) for c in big.columns]), F.lit(salts)).cast("int"))
    right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*keys, "_salt"], how).drop("_salt")
