"""Agent tables (idx, gen, ...): slots, generations, births and deaths as joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agentframe.operators import ranks


def lookup(agents: DataFrame, ids: DataFrame) -> DataFrame:
    """ids (idx, gen, ...) with the agents' columns; a stale generation finds nothing."""
    return ids.join(agents, ["idx", "gen"], "left")


def remove(agents: DataFrame, dead: DataFrame) -> DataFrame:
    """agents without those of dead (idx, gen); removing twice does no harm."""
    return agents.join(dead.select("idx", "gen"), ["idx", "gen"], "left_anti")


def freed(dead: DataFrame) -> DataFrame:
    """(idx, gen, freed_seq) of the slots that dead (idx, gen, seq) leaves: the generation goes up by one, the last freed is reused first."""
    return dead.groupBy("idx", "gen").agg(F.max("seq").alias("freed_seq")).select("idx", (F.col("gen") + 1).alias("gen"), "freed_seq")


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """df with its rows numbered from 1 by order, without bringing all rows into one task."""
    return ranks.numbered_within(df, [], order, name)


def insert(agents: DataFrame, free: DataFrame, newborn: DataFrame, top: int) -> DataFrame:
    """agents and newborn (seq, ...): births in order of seq take free slots (idx, gen, freed_seq), last freed first, then new ones above top."""
    born = numbered(newborn, [F.col("seq").asc()], "k")
    slots = numbered(free, [F.col("freed_seq").desc(), F.col("idx").asc()], "k").select("k", "idx", "gen")
    spare = free.count()
    placed = born.join(slots, "k", "left").withColumns({"idx": F.coalesce("idx", F.col("k") - spare + top), "gen": F.coalesce("gen", F.lit(0))})
    return agents.unionByName(placed.select(*agents.columns))


def demography(agents: DataFrame, dead: DataFrame, newborn: DataFrame, top: int) -> DataFrame:
    """One step's deaths, then its births, which may reuse the slots that the deaths freed."""
    return insert(remove(agents, dead), freed(dead), newborn, top)


def dispatch(kind: Column, rules: dict[str, Column], otherwise: Column) -> Column:
    """The rule of each kind of agent."""
    out = None
    for name, rule in rules.items():
        out = F.when(kind == name, rule) if out is None else out.when(kind == name, rule)
    return otherwise if out is None else out.otherwise(otherwise)
