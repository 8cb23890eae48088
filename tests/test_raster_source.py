"""Rasters read by byte ranges and written in bands, against numpy."""

import glob
import json

import numpy as np
import pyarrow as pa
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, LessThanOrEqual
from pyspark.sql.types import StructType

from agentframe.sources import raster_source as rs


@pytest.fixture
def stack(tmp_path):
    rng = np.random.default_rng(1)
    dem, mask = rng.random((37, 23)).astype("<f4"), rng.integers(0, 2, (37, 23)).astype("u1")
    dem[3, 4] = np.nan
    dem.tofile(tmp_path / "dem.f32")
    mask.tofile(tmp_path / "mask.u8")
    (tmp_path / "broken.f32").write_bytes(b"1234")
    (tmp_path / "meta.json").write_text(json.dumps({"width": 23, "height": 37}))
    return str(tmp_path), dem, mask


def test_many_tasks_read_one_file(spark, stack):
    path, dem, mask = stack
    df = rs.read_raster(spark, path, ["dem", "mask"], chunk=23 * 4 * 5)
    assert df.dtypes == [("x", "int"), ("y", "int"), ("dem", "float"), ("mask", "smallint")] and df.rdd.getNumPartitions() == 8
    got = {(r.x, r.y): (r.dem, r["mask"]) for r in df.collect()}
    assert len(got) == dem.size
    for (x, y), (d, m) in got.items():
        assert m == mask[y, x] and (d == dem[y, x] or np.isnan(dem[y, x]) and np.isnan(d))


@pytest.mark.parametrize("window", [(2, 5, 20, 30), (3, 0, 5, 37), (-4, 30, 99, 99), (5, 5, 5, 9)])
def test_windows(spark, stack, window):
    path, dem, _ = stack
    got = rs.read_raster(spark, path, ["dem"], window, chunk=23 * 4 * 6).where("not isnan(dem)").collect()
    x0, y0, x1, y1 = window
    want = {(x, y): dem[y, x] for y in range(max(0, y0), min(37, y1)) for x in range(max(0, x0), min(23, x1)) if not np.isnan(dem[y, x])}
    assert {(r.x, r.y): np.float32(r.dem) for r in got} == want


def test_filters_narrow_what_is_read(stack, monkeypatch):
    path, dem, _ = stack
    reader = rs.FilteredReader({"path": path, "layers": "dem", "chunk": str(23 * 4 * 4)})
    other = EqualTo(("dem",), 1.0)
    left = list(reader.pushFilters([GreaterThan(("y",), 9), LessThanOrEqual(("y",), 20), EqualTo(("x",), 7), other]))
    assert left == [other] and (reader.x0, reader.x1, reader.y0, reader.y1) == (7, 8, 10, 21)
    parts = reader.partitions()
    assert len(parts) == 3
    spans = []

    class Store:
        def open_input_file(self, name):
            f = open(name, "rb")
            f.read_at = lambda n, at: (spans.append((at, n)), f.seek(at), f.read(n))[2]
            return f

    monkeypatch.setattr(reader, "store", Store())
    values = np.concatenate([b.column("dem").to_numpy() for p in parts for b in reader.read(p)])
    assert np.array_equal(values, dem[10:21, 7]) and sum(n for _, n in spans) == 11 * 4


def test_pushed_filters_in_a_query(spark, stack):
    path, dem, _ = stack
    for pushed in ("true", "false"):
        spark.conf.set("spark.sql.python.filterPushdown.enabled", pushed)
        df = rs.read_raster(spark, path, ["dem"]).where("y >= 30 and x < 4 and dem > 0.5")
        assert df.count() == int((dem[30:, :4] > 0.5).sum())
    spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_wrong_sizes_and_layers(spark, stack):
    for layer in ("broken", "absent"):
        with pytest.raises((ValueError, PySparkException)):
            rs.read_raster(spark, stack[0], [layer]).count()


@pytest.mark.parametrize("band", [1, 4, 100])
def test_written_rasters_are_numpy_bytes(spark, tmp_path, band):
    rng = np.random.default_rng(2)
    a = np.where(rng.random((21, 13)) < 0.6, rng.random((21, 13)), np.nan).astype("<f4")
    a[8:12] = np.nan
    rows = [(int(x), int(y), float(a[y, x]), 1) for y in range(21) for x in range(13) if not np.isnan(a[y, x])] + [(50, 2, 1.0, 1), (2, -1, 1.0, 1)]
    cells = spark.createDataFrame(rows, "x int, y int, dem double, seen int").repartition(6)
    rs.write_raster(cells, f"{tmp_path}/one", 13, 21, ["dem"], band=band)
    joined = b"".join(open(f, "rb").read() for f in sorted(glob.glob(f"{tmp_path}/one/dem/*.f32")))
    assert joined == a.tobytes() and not glob.glob(f"{tmp_path}/one/_staged*")
    back = {(r.x, r.y): np.float32(r.dem) for r in rs.read_raster(spark, f"{tmp_path}/one", ["dem"], chunk=1).where("not isnan(dem)").collect()}
    assert back == {(x, y): np.float32(v) for x, y, v, _ in rows if 0 <= y and x < 13}
    rs.write_raster(cells, f"file://{tmp_path}/two", 13, 21, ["seen"], kind="u8", band=band)
    joined = b"".join(open(f, "rb").read() for f in sorted(glob.glob(f"{tmp_path}/two/seen/*.u8")))
    assert joined == (~np.isnan(a)).astype("u1").tobytes()


def batches(ys):
    return iter([pa.record_batch({"x": pa.array([0] * len(ys), pa.int32()), "y": pa.array(ys, pa.int32()), "v": pa.array([float(y) for y in ys])})])


def test_an_attempt_that_fails_is_done_again(tmp_path):
    writer = rs.RasterWriter({"path": str(tmp_path / "r"), "width": "1", "height": "6", "band": "2"}, StructType.fromDDL("x int, y int, v double"))

    def breaking():
        yield next(batches([0, 1, 2]))
        raise OSError("lost")

    with pytest.raises(OSError):
        writer.write(breaking())
    messages = [writer.write(batches([0, 1, 2, 3])), writer.write(batches([4, 5])), None]
    writer.commit(messages)
    assert np.array_equal(np.concatenate([np.fromfile(f, "<f4") for f in sorted(glob.glob(f"{tmp_path}/r/v/*.f32"))]), np.arange(6))
    assert sorted(p.name for p in (tmp_path / "r").iterdir()) == ["meta.json", "v"]
    other = rs.RasterWriter({"path": str(tmp_path / "s"), "width": "1", "height": "6", "band": "2"}, StructType.fromDDL("x int, y int, v double"))
    other.abort([other.write(batches([0]))])
    assert list((tmp_path / "s").iterdir()) == []
    with pytest.raises(ValueError):
        other.commit([other.write(batches([0]))])


def test_failed_jobs_leave_nothing(spark, tmp_path):
    cells = spark.range(20).select((F.col("id") % 4).cast("int").alias("x"), (F.col("id") / 4).cast("int").alias("y"), F.when(F.col("id") == 17, F.raise_error(F.lit("bad cell")).cast("double")).otherwise(1.0).alias("v"))
    with pytest.raises(PySparkException):
        rs.write_raster(cells, f"{tmp_path}/out", 4, 5, ["v"], band=1)
    assert not glob.glob(f"{tmp_path}/out/**", recursive=True) or not any(p.endswith((".f32", "meta.json")) for p in glob.glob(f"{tmp_path}/out/**", recursive=True))
