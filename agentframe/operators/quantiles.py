"""Exact quantiles of groups of any size, by sketches that close in on them.

Each pass reads the rows once: a mergeable sketch of the rows between two bounds gives the next bounds around each wanted rank, and exact counts below, at and between the last bounds
say where the rank lies. Bounds close in by a factor of about ``PARTS`` / 3 a pass, rows equal to a bound are counted and never gathered, and once at most ``FEW`` rows lie between
the bounds they are sorted. So the result is exact whatever the sketch's error, memory is bounded, and 10 ** 12 rows take five passes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agentframe.operators import ranks
from agentframe.operators.models import settled

FEW, PARTS, ACCURACY, PASSES = 4096, 500, 20_000, 12
#: The rows between the bounds; a bound that is null is none.
_OPEN = "(low is null or __v > low) and (high is null or __v < high)"


def _sketch(value: Column, parts: int) -> Column:
    return F.percentile_approx(value, [k / parts for k in range(parts + 1)], ACCURACY)


def _bounds(sketch: Column, n: Column, rank: Column, parts: int) -> tuple[Column, Column]:
    """The sketch's values one part before and one after the wanted rank of n."""
    at = F.floor(rank * parts / F.greatest(n - 1, F.lit(1))).cast("int")
    return F.get(sketch, F.greatest(at - 1, F.lit(0))), F.get(sketch, F.least(at + 2, F.lit(parts)))


def order_statistics(df: DataFrame, by: list[str], value: str, wanted: DataFrame, few: int = FEW, parts: int = PARTS) -> DataFrame:
    """(by, rank, value) for wanted (by, rank, 0 the least) of the rows whose value is not null and not NaN. Each rank is below its group's number of rows."""
    keys = [f"`{c}`" for c in by]
    rows = df.select(*keys, F.col(f"`{value}`").cast("double").alias("__v")).where("__v is not null and not isnan(__v)")
    start = wanted.groupBy(*keys).agg(F.count("*").alias("__c")).drop("__c")
    first = ranks.join_same(rows, ranks.sized(start), by, "leftsemi") if by else rows
    known = first.groupBy(*keys).agg(_sketch(F.col("__v"), parts).alias("sketch"), F.count("*").alias("inside"))
    open_ = ranks.join_same(wanted.select(*keys, "rank"), known, by)
    a, b = _bounds(F.col("sketch"), F.col("inside"), F.col("rank"), parts)
    # low and high are the exclusive bounds that hold so far, below the rows up to low, inside those between; a and b are the sketch's proposal.
    open_ = settled(open_.select(*keys, "rank", F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"), F.lit(0).cast("long").alias("below"), "inside", a.alias("a"), b.alias("b")))
    done = None
    for _ in range(PASSES):
        small = open_.where(F.col("inside") <= few)
        held = ranks.join_same(rows, ranks.sized(small.select(*keys, "rank", "low", "high", "below")), by).where(_OPEN)
        picked = held.groupBy(*keys, "rank", "below").agg(F.sort_array(F.collect_list("__v")).alias("vs")).select(*keys, "rank", F.get("vs", (F.col("rank") - F.col("below")).cast("int")).alias("value"))
        done = picked if done is None else done.unionByName(picked)
        large = open_.where(F.col("inside") > few)
        if large.isEmpty():
            return done
        v, seen = F.col("__v"), ranks.join_same(rows, ranks.sized(large), by).where(_OPEN)
        count = lambda c, n: F.count_if(c).alias(n)
        told = seen.groupBy(*keys, "rank", "low", "high", "below", "inside", "a", "b").agg(
            count(v < F.col("a"), "lt_a"), count(v == F.col("a"), "eq_a"), count((v > F.col("a")) & (v < F.col("b")), "mid"), count((v == F.col("b")) & (F.col("b") > F.col("a")), "eq_b"),
            _sketch(F.when((v > F.col("a")) & (v < F.col("b")), v), parts).alias("sketch"), _sketch(v, 2 * parts).alias("wide"))
        told = settled(told.withColumn("k", F.col("rank") - F.col("below")).withColumns({"p1": F.col("lt_a"), "p2": F.col("lt_a") + F.col("eq_a")}).withColumns({"p3": F.col("p2") + F.col("mid")}).withColumn("p4", F.col("p3") + F.col("eq_b")))
        exact = told.where("(k >= p1 and k < p2) or (k >= p3 and k < p4)").select(*keys, "rank", F.when(F.col("k") < F.col("p2"), F.col("a")).otherwise(F.col("b")).alias("value"))
        done = done.unionByName(exact)
        a, b = _bounds(F.col("sketch"), F.col("mid"), F.col("k") - F.col("p2"), parts)
        between = told.where("k >= p2 and k < p3").select(*keys, "rank", F.col("a").alias("low"), F.col("b").alias("high"), (F.col("below") + F.col("p2")).alias("below"), F.col("mid").alias("inside"), a.alias("a"), b.alias("b"))
        # A proposal that missed, as a sketch may: the side that the rank lies on is searched.
        side = F.col("k") < F.col("p1")
        rest = F.when(side, F.col("lt_a")).otherwise(F.col("inside") - F.col("p4"))
        wide = F.filter("wide", lambda w: F.when(side, w < F.col("a")).otherwise(w > F.col("b")))
        missed = told.where("k < p1 or k >= p4").select(*keys, "rank", F.when(side, F.col("low")).otherwise(F.col("b")).alias("low"), F.when(side, F.col("a")).otherwise(F.col("high")).alias("high"),
            (F.col("below") + F.when(side, 0).otherwise(F.col("p4"))).alias("below"), rest.alias("inside"), F.coalesce(F.array_min(wide), F.when(side, F.col("low")).otherwise(F.col("b")), F.lit(float("-inf"))).alias("a"), F.coalesce(F.array_max(wide), F.when(side, F.col("a")).otherwise(F.col("high")), F.lit(float("inf"))).alias("b"))
        open_ = settled(between.unionByName(missed))
    raise ValueError("the bounds did not close in")


def exact_quantiles(df: DataFrame, by: list[str], value: str, qs: list[float], few: int = FEW, parts: int = PARTS) -> DataFrame:
    """(by, q, value): quantiles with linear interpolation between ranks, as percentile() has them; groups without a value are left out."""
    if not all(0 <= q <= 1 for q in qs):
        raise ValueError("a quantile lies between 0 and 1")
    keys = [f"`{c}`" for c in by]
    v = F.col(f"`{value}`").cast("double")
    sizes = df.where(v.isNotNull() & ~F.isnan(v)).groupBy(*keys).agg(F.count("*").alias("n")).where("n > 0")
    spots = F.transform(F.array(*[F.lit(float(q)) for q in qs]), lambda q: F.struct(q.alias("q"), (q * (F.col("n") - 1)).alias("at")))
    spots = settled(sizes.select(*keys, F.inline(spots)).withColumn("lo", F.floor("at")).withColumn("hi", F.ceil("at")))
    wanted = spots.select(*keys, F.explode(F.array("lo", "hi")).alias("rank")).distinct()
    found = settled(order_statistics(df, by, value, wanted, few, parts))
    lo = ranks.join_same(spots, found.withColumnRenamed("value", "v_lo").withColumnRenamed("rank", "lo"), [*by, "lo"])
    both = ranks.join_same(lo, found.withColumnRenamed("value", "v_hi").withColumnRenamed("rank", "hi"), [*by, "hi"])
    return both.select(*keys, "q", F.when(F.col("v_lo") == F.col("v_hi"), F.col("v_lo")).otherwise(F.col("v_lo") + (F.col("at") - F.col("lo")) * (F.col("v_hi") - F.col("v_lo"))).alias("value"))
