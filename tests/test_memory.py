"""Remembered zones: one batch or many, and state no larger than what is alive."""

import random

import pytest

from agentframe.streaming import memory

HOUR = 3_600_000_000


def test_zones_are_forgotten_by_age_and_number():
    rows = [(i * HOUR, i, 0.0, 0.0, True) for i in range(200)]
    zones, felt = memory.recall([], rows, 168 * HOUR, 64, 400.0)
    assert len(zones) == 64 and felt[10][1] == 10 and felt[199][1] == 64
    assert memory.recall(zones, [(500 * HOUR, 1, 0.0, 0.0, False)], 168 * HOUR, 64, 400.0) == ([], [(1, 0, 0.0)])
    assert memory.recall([(0.0, 0.0, 0)], [(84 * HOUR, 1, 200.0, 0.0, False)], 168 * HOUR, 64, 400.0)[1] == [(1, 1, pytest.approx(0.25))]


def test_rows_out_of_order_over_many_batches(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, i % 5, 1_700_000_000_000_000 + i * HOUR // 3 + rng.randrange(1000), rng.uniform(0, 900), rng.uniform(0, 900), rng.random() < 0.4) for i in range(900)]
    dealt = [rows[i : i + 150] for i in range(0, 900, 150)]
    for k, part in enumerate(dealt):
        rng.shuffle(part)
        frame = spark.createDataFrame([(f"k{u}", i, t, x, y, d) for i, u, t, x, y, d in part], "key string, id long, us long, x double, y double, danger boolean")
        frame.selectExpr("key", "id", "timestamp_micros(us) as ts", "x", "y", "danger").coalesce(1).write.parquet(f"{tmp_path}/part{k}")
    files = spark.read.parquet(*[f"{tmp_path}/part{k}" for k in range(6)]).repartition(6, "id")
    files.write.parquet(f"{tmp_path}/mixed")
    for folder, at_once in ((f"{tmp_path}/mixed", None), (f"{tmp_path}/mixed", 2)):
        late = "10 minutes" if at_once is None else "400 hours"
        got = memory.run_to_table(spark, folder, "*.parquet", lambda s: s, late, at_once).collect()
        last = max(t for *_, t, _, _, _ in [(r[0], r[2], 0, 0, 0) for r in rows]) // 1000 - (600_000 if at_once is None else 400 * 3_600_000)
        want = {}
        for key in range(5):
            mine = sorted((t, i, x, y, d) for i, u, t, x, y, d in rows if u == key and t // 1000 <= last)
            want |= {i: (n, r) for i, n, r in memory.recall([], mine, 168 * HOUR, 64, 400.0)[1]}
        assert {r.id: (r.zones, pytest.approx(r.risk)) for r in got} == want


def test_what_rows_feel_is_worked_out_for_many_pairs_at_once(monkeypatch):
    """As one row after another, whatever number of pairs is taken together; zones of before count, equal times too."""
    rng = random.Random(6)
    start = [(rng.uniform(0, 900), rng.uniform(0, 900), i * HOUR) for i in range(60)]
    rows = sorted((60 * HOUR + rng.randrange(300) * HOUR, i, rng.uniform(0, 900), rng.uniform(0, 900), rng.random() < 0.7) for i in range(400))
    zones, want = list(start), []
    for at, one, x, y, danger in rows:
        zones = [z for z in zones if at - z[2] < 168 * HOUR]
        near = [(((x - a) ** 2 + (y - b) ** 2) ** 0.5, t) for a, b, t in zones]
        want.append((one, len(zones), pytest.approx(sum((1 - (at - t) / (168 * HOUR)) * (1 - d / 400) for d, t in near if d < 400))))
        zones = [*zones, (x, y, at)][-64:] if danger else zones
    for pairs in (1, 100, 1 << 18):
        monkeypatch.setattr(memory, "_PAIRS", pairs)
        assert memory.recall(start, rows, 168 * HOUR, 64, 400.0) == (zones, want)
