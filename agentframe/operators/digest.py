"""Digests of ordered state that do not depend on how it is dealt out: hash trees over runs of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agentframe.operators import ranks


def leaves(df: DataFrame, by: list[str], order: list[Column], line: Column, leaf: int = 1024) -> DataFrame:
    """(by, node, digest, rows): a digest of the lines of each leaf rows in a row of a group. Two states differ in the leaves whose digests differ. order leaves no ties."""
    rows = ranks.numbered_within(df.withColumn("__line", line), by, order, "__n")
    keys = [f"`{c}`" for c in by]
    runs = rows.groupBy(*keys, F.expr(f"(__n - 1) div {leaf}").alias("node")).agg(F.sort_array(F.collect_list(F.struct("__n", "__line"))).alias("r"))
    return runs.select(*keys, "node", F.md5(F.array_join(F.transform("r", lambda r: r["__line"]), ";")).alias("digest"), F.size("r").cast("long").alias("rows"))


def merkle(df: DataFrame, by: list[str], order: list[Column], line: Column, leaf: int = 1024, fan: int = 16, levels: int | None = None) -> DataFrame:
    """(by, digest, rows) of each group: the root over its leaves, or, of a tree cut off after levels, each node there. A node with one child has the child's digest, so a group's root depends on its own rows alone; no list has more than fan digests."""
    nodes = leaves(df, by, order, line, leaf)
    nodes = ranks.settled(nodes)
    keys = [f"`{c}`" for c in by]
    most = (nodes.agg(F.max("node")).first()[0] or 0) + 1
    while most > 1 and levels != 0:
        levels = None if levels is None else levels - 1
        children = F.sort_array(F.collect_list(F.struct("node", "digest")))
        grouped = nodes.groupBy(*keys, F.expr(f"node div {fan}").alias("up")).agg(children.alias("c"), F.sum("rows").alias("rows"))
        joined = F.md5(F.array_join(F.transform("c", lambda c: c["digest"]), ""))
        nodes = grouped.select(*keys, F.col("up").alias("node"), F.when(F.size("c") == 1, F.get("c", 0)["digest"]).otherwise(joined).alias("digest"), "rows")
        most = -(-most // fan)
    return nodes.select(*keys, "digest", "rows")
