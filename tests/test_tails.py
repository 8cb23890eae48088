"""Tail chances as columns against the plain functions."""

import pytest
from pyspark.sql import functions as F

from agentframe.functions.statistics import chi2_tail, signed_rank_p
from agentframe.operators import evaluate


def test_chi_square_tails(spark):
    rows = [(d, x) for d in (1, 2, 3, 4, 5, 8, 9, 20, 51) for x in (0.0, 0.01, 0.5, 1.0, 2.9, 7.7, 20.0, 90.0)]
    got = spark.createDataFrame(rows, "d int, x double").select("d", "x", evaluate.chi2_tail(F.col("x"), F.col("d")).alias("p")).collect()
    for r in got:
        assert r.p == pytest.approx(chi2_tail(r.x, r.d), rel=1e-9, abs=1e-14)


def test_signed_rank_chances(spark):
    table = {r.n: r.chances for r in evaluate.signed_rank_table(spark, 25).collect()}
    assert sorted(table) == list(range(1, 26)) and all(len(table[n]) == n * (n + 1) // 2 + 1 for n in table)
    for n in (1, 2, 5, 10, 25):
        for w in range(0, n * (n + 1) // 4 + 1, 3):
            assert min(1.0, 2 * table[n][w]) == pytest.approx(signed_rank_p(w, n), rel=1e-12)
    tests = spark.createDataFrame([(3.0, 8, False), (3.0, 8, True), (200.0, 40, False)], "w double, n long, tied boolean")
    p = {(r.n, r.tied): r.p for r in evaluate.with_wilcoxon_p(tests).collect()}
    assert p[8, False] == pytest.approx(signed_rank_p(3, 8)) and p[8, True] != p[8, False] and 0 < p[40, False] < 1
    with pytest.raises(ValueError):
        evaluate.signed_rank_table(spark, 54)
