"""Running sums, numbers and ranks within groups, over range partitions.

Rows are dealt by ranges of (group, order), sorted, and settled once. A range's part of a group is summed up in one small row, and the running total of those rows tells each range
where its part begins. No task holds more than its range, so one group may hold all rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from agentframe.sources.shared import settled

#: Side tables are broadcast up to so many rows, and joined beyond.
BROADCAST_ROWS = 100_000


def sized(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df, marked for broadcast if it has limit rows at most."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def join_same(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join on keys where null equals null; keys once, from left."""
    named = right.select(*[F.col(f"`{k}`").alias(f"__k{i}") for i, k in enumerate(keys)], *[f"`{c}`" for c in right.columns if c not in keys])
    if not keys:
        return left.crossJoin(F.broadcast(named))
    same = reduce(lambda a, b: a & b, [F.col(f"`{k}`").eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)])
    return left.join(named, same, how).drop(*[f"__k{i}" for i in range(len(keys))])


def _ranged(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    keys = [F.col(f"`{c}`") for c in by]
    rows = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order).withColumn("__at", F.monotonically_increasing_id())
    return settled(rows).withColumn("__part", F.shiftright("__at", 33))


def _starts(parts: DataFrame, by: list[str], amount: str) -> DataFrame:
    """parts (__part, by, amount, ...) with __before: the sum of amount over the group's earlier parts. A group has one row a partition at most."""
    w = Window.partitionBy(*[f"`{c}`" for c in by]).orderBy("__part") if by else Window.partitionBy(F.lit(1)).orderBy("__part")
    return parts.withColumn("__before", F.sum(amount).over(w) - F.col(amount))


def numbered_within(df: DataFrame, by: list[str], order: list[Column], name: str) -> DataFrame:
    """df with its rows numbered from 1 within each group, by order. Ties of order get different numbers; nulls of by are a group."""
    rows = _ranged(df, by, order)
    parts = rows.groupBy("__part", *[f"`{c}`" for c in by]).agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    starts = sized(_starts(parts, by, "__n").drop("__n"))
    return join_same(rows, starts, ["__part", *by]).withColumn(name, F.col("__at") - F.col("__first") + F.col("__before") + 1).drop("__part", "__at", "__first", "__before")


def cumulative(df: DataFrame, by: list[str], order: list[Column], amount: str, name: str) -> DataFrame:
    """df with the sum of amount over the rows of the group up to each, itself included, by order (which should leave no ties)."""
    rows = _ranged(df, by, order)
    keys = [f"`{c}`" for c in by]
    parts = rows.groupBy("__part", *keys).agg(F.sum(amount).alias("__n"))
    within = F.sum(amount).over(Window.partitionBy("__part", *keys).orderBy("__at").rowsBetween(Window.unboundedPreceding, 0))
    out = join_same(rows.withColumn("__within", within), sized(_starts(parts, by, "__n").drop("__n")), ["__part", *by])
    return out.withColumn(name, F.col("__within") + F.col("__before")).drop("__part", "__at", "__within", "__before")


def tie_counts(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, value, n, upto): each different value of a group, its rows and those up to it. Rows are counted before anything is sorted."""
    counted = df.groupBy(*[f"`{c}`" for c in by], f"`{value}`").agg(F.count("*").alias("n"))
    return cumulative(counted, by, [F.col(f"`{value}`")], "n", "upto")


def mean_ranks(df: DataFrame, by: list[str], value: Column, name: str = "rank") -> DataFrame:
    """df with the ranks of value within each group, ties sharing their mean rank."""
    rows = df.withColumn("__v", value)
    ties = tie_counts(rows, by, "__v").select(*[f"`{c}`" for c in by], "__v", (F.col("upto") - (F.col("n") - 1) / 2.0).alias("__r"))
    return join_same(rows, ties, [*by, "__v"]).withColumnRenamed("__r", name).drop("__v")
