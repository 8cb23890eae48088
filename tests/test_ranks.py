"""Numbers and ranks where one group lies in many partitions, against pandas."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from agentframe.operators import ranks


def frame():
    rng = np.random.default_rng(3)
    grp = np.where(rng.random(3000) < 0.8, "hot", rng.choice(["a", "b", "c"], 3000))
    df = pd.DataFrame({"id": rng.permutation(3000), "grp": grp, "v": rng.integers(0, 40, 3000)})
    df.loc[rng.random(3000) < 0.05, "grp"] = None
    return df


def spread(spark, df):
    return spark.createDataFrame(df.astype(object).where(df.notna(), None).values.tolist(), "id long, grp string, v long").repartition(7)


def test_numbers_within_groups(spark, monkeypatch):
    df = frame()
    want = df.sort_values(["v", "id"]).groupby("grp", dropna=False).cumcount() + 1
    want = dict(zip(df.id[want.index], want, strict=True))
    for limit in (ranks.BROADCAST_ROWS, 0):
        monkeypatch.setattr(ranks.sized, "__defaults__", (limit,))
        out = ranks.numbered_within(spread(spark, df), ["grp"], [F.col("v"), F.col("id")], "k")
        assert out.columns == ["id", "grp", "v", "k"] and {r.id: r.k for r in out.collect()} == want


def test_one_group_is_sorted_in_many_partitions(spark):
    hot = spark.range(10_000).select("id", F.lit("x").alias("grp"), (F.col("id") * 7919 % 10_007).alias("v"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    parts = ranks._ranged(hot, ["grp"], [F.col("v")]).groupBy("__part").count().collect()
    assert len(parts) == 8 and max(p["count"] for p in parts) < 2500
    assert ranks.numbered_within(hot, ["grp"], [F.col("v")], "k").agg(F.countDistinct("k"), F.max("k"), F.min("k")).first()[:] == (10_000, 10_000, 1)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_running_sums_and_mean_ranks(spark):
    df = frame()
    got = ranks.cumulative(spread(spark, df), ["grp"], [F.col("v"), F.col("id")], "v", "s")
    want = df.sort_values(["v", "id"])
    want["s"] = want.groupby("grp", dropna=False).v.cumsum()
    assert {r.id: r.s for r in got.collect()} == dict(zip(want.id, want.s, strict=True))
    got = ranks.mean_ranks(spread(spark, df), ["grp"], F.col("v"))
    df["r"] = df.groupby("grp", dropna=False).v.rank()
    assert {r.id: r["rank"] for r in got.collect()} == dict(zip(df.id, df.r, strict=True))
    df = df[["id", "grp", "v"]]
    whole = ranks.numbered_within(spread(spark, df), [], [F.col("id")], "k")
    assert all(r.k == r.id + 1 for r in whole.collect())
    assert ranks.mean_ranks(spread(spark, df.head(0)), ["grp"], F.col("v")).collect() == []
