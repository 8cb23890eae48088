"""Quantiles that are closed in on, against pandas, with bounds so small that several passes are needed."""

import numpy as np
import pandas as pd
import pytest

from agentframe.operators import quantiles

QS = [0.0, 0.02, 0.25, 0.5, 0.77, 0.98, 1.0]


def values(n=5000):
    rng = np.random.default_rng(5)
    return {
        "smooth": rng.normal(0, 1, n), "steep": np.exp(rng.normal(0, 60, n)), "ties": rng.choice([1.0, 2.0, 5.0], n, p=[0.3, 0.6, 0.1]), "mass": np.where(rng.random(n) < 0.5, 7.0, rng.random(n) * 14), "one": np.full(n, 3.0),
        "big": rng.integers(0, 9, n) + 1e15, "few": rng.random(7), None: rng.random(300), "none": np.full(5, np.nan),
    }


def test_quantiles_match_pandas(spark):
    rows = [(g, float(v)) for g, vs in values().items() for v in [*vs, np.nan]]
    table = spark.createDataFrame(rows, "grp string, v double").repartition(4)
    got = {(r.grp, r.q): r.value for r in quantiles.exact_quantiles(table, ["grp"], "v", QS, few=20, parts=12).collect()}
    for name, vs in values().items():
        for q in QS if name != "none" else ():
            assert got.pop((name, q)) == pytest.approx(pd.Series(vs).quantile(q), rel=1e-12)
    assert not got


def test_no_groups_few_rows_and_errors(spark):
    table = spark.createDataFrame([(1.0,), (4.0,), (None,), (float("nan"),)], "v double")
    assert [(r.q, r.value) for r in quantiles.exact_quantiles(table, [], "v", [0.5]).collect()] == [(0.5, 2.5)]
    assert quantiles.exact_quantiles(table.where("v > 9 and v < 10"), [], "v", [0.5]).collect() == []
    ends = spark.createDataFrame([(v,) for v in [float("-inf")] * 9 + [1.0] * 30 + [2.0, float("inf"), float("inf")]], "v double")
    assert [r.value for r in quantiles.exact_quantiles(ends, [], "v", [0.0, 0.5, 1.0], few=2, parts=4).orderBy("q").collect()] == [float("-inf"), 1.0, float("inf")]
    with pytest.raises(ValueError):
        quantiles.exact_quantiles(table, [], "v", [1.5])


def test_values_next_to_each_other_end_in_time(spark):
    n = 20_000
    table = spark.range(n).selectExpr("cast(id * 7919 % 20000 as double) as v")
    got = quantiles.exact_quantiles(table, [], "v", [0.123, 0.5, 0.999], few=5, parts=16).collect()
    assert all(r.value == pytest.approx(r.q * (n - 1)) for r in got) and len(got) == 3
