"""Joins on time: the latest earlier row of a key, and the intervals that hold a moment."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from agentframe.operators import ranks


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], time: str, values: list[str], ties: list[str] | None = None, most: float | None = None, strictly: bool = False) -> DataFrame:
    """left with right's values and r_<time> of the latest row of right with the same keys that is not after it (strictly: before it); null where there is none within most.

    Both sides are sorted together over range partitions of (keys, time), and the last row of right is carried over the partitions' edges; so a key may hold all rows, and nothing is
    paired that is not a result. Of rows of right at one time the last by ties counts. Null keys are a key; rows without a time get nothing and are carried to nobody.
    """
    ties = ties or []
    named = [f"`{k}`" for k in keys]
    seen = F.struct(F.col(f"`{time}`").alias("t"), *[F.col(f"`{v}`").alias(v) for v in values])
    one = left.select(*named, F.col(f"`{time}`").alias("__t"), F.lit(0 if strictly else 1).alias("__side"), *[F.lit(None).cast(right.schema[t].dataType).alias(f"__tie{i}") for i, t in enumerate(ties)], F.struct(*[f"`{c}`" for c in left.columns]).alias("__row"))
    two = right.where(F.col(f"`{time}`").isNotNull()).select(*named, F.col(f"`{time}`").alias("__t"), F.lit(1 if strictly else 0).alias("__side"), *[F.col(f"`{t}`").alias(f"__tie{i}") for i, t in enumerate(ties)], seen.alias("__seen"))
    rows = ranks._ranged(one.unionByName(two, allowMissingColumns=True), keys, [F.col(c) for c in ("__t", "__side", *[f"__tie{i}" for i in range(len(ties))])])
    upto = Window.partitionBy("__part", *named).orderBy("__at").rowsBetween(Window.unboundedPreceding, 0)
    ends = rows.where("__seen is not null").groupBy("__part", *named).agg(F.max_by("__seen", "__at").alias("__end"))
    held = rows.groupBy("__part", *named).agg(F.lit(1).alias("__one")).drop("__one")
    earlier = Window.partitionBy(*named).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    carried = ranks.join_same(held, ends, ["__part", *keys], "left").withColumn("__carried", F.last("__end", ignorenulls=True).over(earlier)).drop("__end")
    found = rows.withColumn("__last", F.last("__seen", ignorenulls=True).over(upto)).where("__row is not null")
    out = ranks.join_same(found, ranks.sized(carried.where("__carried is not null")), ["__part", *keys], "left").withColumn("__last", F.coalesce("__last", "__carried"))
    fits = F.col("__t").isNotNull()
    if most is not None:
        fits = fits & (F.col("__t").cast("double") - F.col("__last.t").cast("double") <= most)
    last = F.when(fits, F.col("__last"))
    return out.select("__row.*", last["t"].alias(f"r_{time}"), *[last[v].alias(v) for v in values])


def interval_join(moments: DataFrame, intervals: DataFrame, keys: list[str], time: str, start: str, end: str) -> DataFrame:
    """moments with the columns of each of intervals, half open, that holds their time under the same keys; columns of intervals must have other names, but for keys.

    An interval lies in one or two cells of the least power of two that is no shorter than it, and a moment in one cell of each length that occurs: an equi-join whose candidates are
    within a small factor of the results, for long and short intervals alike. Times are numbers or timestamps; intervals that end before they start hold nothing.
    """
    number = lambda c: (F.unix_micros(F.col(f"`{c}`")) / 1e6 if dict(kinds)[c] == "timestamp" else F.col(f"`{c}`").cast("double"))
    kinds = intervals.dtypes
    a, b = number(start), number(end)
    level = F.greatest(F.ceil(F.log2(F.greatest(b - a, F.lit(2.0**-20)))), F.lit(-20)).cast("int")
    cells = intervals.withColumns({"__a": a, "__b": b}).where("__b > __a").withColumn("__level", level)
    first, last = (F.floor(F.col(c) / F.pow(F.lit(2.0), F.col("__level"))).cast("long") for c in ("__a", "__b"))
    cells = cells.withColumn("__cell", F.explode(F.sequence(first, last)))
    lengths = sorted(r[0] for r in cells.select("__level").distinct().collect())
    kinds = moments.dtypes
    t = number(time)
    spots = F.transform(F.array(*[F.lit(n) for n in lengths]).cast("array<int>"), lambda n: F.struct(n.alias("__level"), F.floor(F.col("__t") / F.pow(F.lit(2.0), n)).cast("long").alias("__cell")))
    there = moments.withColumn("__t", t).where("__t is not null").select("*", F.inline(spots))
    renamed = cells.select(*[F.col(f"`{k}`").alias(f"__k{i}") for i, k in enumerate(keys)], *[f"`{c}`" for c in intervals.columns if c not in keys], "__a", "__b", F.col("__level").alias("__l"), F.col("__cell").alias("__c"))
    same: Column = reduce(lambda x, y: x & y, [F.col(f"`{k}`").eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)], (F.col("__level") == F.col("__l")) & (F.col("__cell") == F.col("__c")))
    out = there.join(renamed, same).where("__t >= __a and __t < __b")
    return out.drop("__t", "__level", "__cell", "__a", "__b", "__l", "__c", *[f"__k{i}" for i in range(len(keys))])
