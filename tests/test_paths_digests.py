"""Table functions over ordered partitions, and digests that no partitioning changes."""

import hashlib

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from agentframe.operators import digest, paths


def test_walks_stop_at_the_edges(spark):
    rows = [("a", k, d, 0.0) for k, d in enumerate([3.0, 9.0, -20.0, None, 4.0])] + [("b", 5, 0.0, -1.0), ("b", 2, 0.0, -100.0)]
    got = paths.follow(spark.createDataFrame(rows, "idx string, step int, dx double, dy double"), 10.0, 10.0)
    assert got.dtypes[:2] == [("idx", "string"), ("step", "int")]
    assert sorted((r.idx, r.step, r.px, r.py, r.way, r.hits) for r in got.collect()) == [
        ("a", 0, 8.0, 5.0, 3.0, 0), ("a", 1, 10.0, 5.0, 5.0, 1), ("a", 2, 0.0, 5.0, 15.0, 2), ("a", 3, 0.0, 5.0, 15.0, 2), ("a", 4, 4.0, 5.0, 19.0, 2), ("b", 2, 5.0, 0.0, 5.0, 1), ("b", 5, 5.0, 0.0, 5.0, 2),
    ]


def test_wrong_calls_are_errors_before_anything_runs(spark):
    paths.register(spark)
    spark.range(3).createOrReplaceTempView("no_moves")
    for call in ("follow_path(TABLE(SELECT id AS idx, id AS step FROM no_moves) PARTITION BY (idx) ORDER BY (step), 1, 1)", "follow_path(TABLE(SELECT id AS idx, id AS step, id AS dx, id AS dy FROM no_moves) PARTITION BY (idx) ORDER BY (step), 0, 1)", "follow_path(1, 2, 3)"):
        with pytest.raises(PySparkException):
            spark.sql(f"SELECT * FROM {call}")


def root(lines, leaf, fan):
    level = [hashlib.md5(";".join(lines[i : i + leaf]).encode()).hexdigest() for i in range(0, len(lines), leaf)]
    while len(level) > 1:
        level = [level[i] if i + 1 == len(level) else hashlib.md5("".join(level[i : i + fan]).encode()).hexdigest() for i in range(0, len(level), fan)]
    return level[0]


def test_digests_do_not_depend_on_the_partitioning(spark):
    rows = spark.range(1000).select("id", (F.col("id") * 7919 % 1009).alias("v"), F.when(F.col("id") % 10 < 8, "hot").when(F.col("id") % 10 < 9, "b").alias("g"))
    want = {}
    for g, members in (("hot", [i for i in range(1000) if i % 10 < 8]), ("b", [i for i in range(1000) if i % 10 == 8]), (None, [i for i in range(1000) if i % 10 == 9])):
        want[g] = (root([f"{i}:{i * 7919 % 1009}" for i in sorted(members, key=lambda i: i * 7919 % 1009)], 10, 3), len(members))
    for parts in (1, 7, 23):
        out = digest.merkle(rows.repartition(parts), ["g"], [F.col("v")], F.concat_ws(":", "id", "v"), leaf=10, fan=3)
        assert {r.g: (r.digest, r.rows) for r in out.collect()} == want
    before, after = (digest.leaves(d, ["g"], [F.col("v")], F.concat_ws(":", "id", "v"), 10) for d in (rows, rows.withColumn("id", F.when(F.col("id") == 500, -1).otherwise(F.col("id")))))
    assert before.join(after, ["node", "digest"], "left_anti").count() == 1
    assert digest.merkle(rows.limit(0), ["g"], [F.col("v")], F.col("g")).collect() == []


def test_a_tree_cut_off_after_levels_has_several_roots(spark):
    rows = spark.range(90).selectExpr("id % 1 as g", "id as v")
    out = digest.merkle(rows, ["g"], [F.col("v")], F.col("v").cast("string"), leaf=10, fan=3, levels=1).collect()
    assert [r.rows for r in out] == [30, 30, 30] and len({r.digest for r in out}) == 3
    whole = digest.merkle(rows, ["g"], [F.col("v")], F.col("v").cast("string"), leaf=10, fan=3).collect()
    assert whole == digest.merkle(rows, ["g"], [F.col("v")], F.col("v").cast("string"), leaf=10, fan=3, levels=2).collect() and len(whole) == 1
