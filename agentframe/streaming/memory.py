"""Danger zones that animals remember, as keyed state of a stream: a list of zones in the order they were met, bounded in number and in age.

Rows wait in state until the watermark has passed them and are then taken in the order of their times, whatever order they came in. A zone is forgotten after ``ttl``
by event time, or when ``most`` newer ones have been met; a timer at the last zone's end clears the state of keys that no row comes for any more. Waiting rows lie in state
packed, a chunk a batch, and are read when the watermark reaches one of them; what rows feel is worked out for many pairs of row and zone at once.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from agentframe.sources.shared import shared_folder

# How long a zone is remembered, how many are, and how far one is felt.
TTL_HOURS, MOST, RADIUS = 168, 64, 400.0
_HOUR = 3_600_000_000


#: Pairs of a row and a zone that are looked at together.
_PAIRS = 1 << 18
_ROW = np.dtype([("at", "<i8"), ("id", "<i8"), ("x", "<f8"), ("y", "<f8"), ("danger", "?")])
_ZONE = np.dtype([("x", "<f8"), ("y", "<f8"), ("at", "<i8")])


def feel(zones: np.ndarray, rows: np.ndarray, ttl: int, most: int, radius: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(zones, number remembered by each row, risk of each row), zones and rows in the order of their times: a row's zones are then the last ones met before it, without a gap."""
    danger = rows[rows["danger"]]
    new = np.zeros(len(danger), _ZONE)
    for c in _ZONE.names:
        new[c] = danger[c]
    met = np.concatenate([zones, new])
    end = len(zones) + np.cumsum(rows["danger"]) - rows["danger"]
    alive = np.searchsorted(met["at"], rows["at"] - ttl, "right")
    start = np.minimum(np.maximum(alive, end - most), end)
    known, risk = end - start, np.zeros(len(rows))
    a, pairs = 0, np.cumsum(known)
    while a < len(rows):
        b = max(a + 1, int(np.searchsorted(pairs, (pairs[a - 1] if a else 0) + _PAIRS, "right")))
        n = known[a:b]
        row = np.repeat(np.arange(a, b), n)
        zone = met[np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start[a:b], n)]
        dist = np.hypot(rows["x"][row] - zone["x"], rows["y"][row] - zone["y"])
        share = np.where(dist < radius, (1 - (rows["at"][row] - zone["at"]) / ttl) * (1 - dist / radius), 0)
        risk[a:b] = np.bincount(row - a, share, b - a)
        a = b
    return met[max(alive[-1], len(met) - most) :] if len(rows) else zones, known, risk


def recall(zones: list[tuple[float, float, int]], rows: list[tuple[int, int, float, float, bool]], ttl: int, most: int, radius: float) -> tuple[list[tuple[float, float, int]], list[tuple[int, int, float]]]:
    """(zones, [(id, zones remembered, risk)]) after rows (time, id, x, y, danger) in order: each row feels the zones met before it, then a danger is remembered as one."""
    left, known, risk = feel(np.array(zones, _ZONE), np.array(rows, _ROW), ttl, most, radius)
    return left.tolist(), list(zip([r[1] for r in rows], known.tolist(), risk.tolist(), strict=True))


class DangerMemory(StatefulProcessor):
    def __init__(self, ttl: int, most: int, radius: float):
        self.ttl, self.most, self.radius = ttl, most, radius

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.zones = handle.getListState("zones", "packed binary")
        self.waiting = handle.getListState("waiting", "packed binary")

    def _advance(self, key: tuple, new: list[np.ndarray], now_ms: int) -> Iterator[pd.DataFrame]:
        """Takes the rows that the watermark has passed; the rest waits for a timer at the first of them."""
        waiting = np.concatenate([np.frombuffer(c[0], _ROW) for c in self.waiting.get()] + new + [np.zeros(0, _ROW)])
        waiting = waiting[np.lexsort((waiting["danger"], waiting["y"], waiting["x"], waiting["id"], waiting["at"]))]
        passed = waiting["at"] // 1000 <= now_ms
        ready, rest = waiting[passed], waiting[~passed]
        zones = np.concatenate([np.frombuffer(c[0], _ZONE) for c in self.zones.get()] + [np.zeros(0, _ZONE)])
        zones, known, risk = feel(zones, ready, self.ttl, self.most, self.radius)
        zones = zones[now_ms * 1000 - zones["at"] < self.ttl]
        for state, left in ((self.zones, zones), (self.waiting, rest)):
            state.put([(left.tobytes(),)]) if len(left) else state.clear()
        if len(rest) or len(zones):
            self.handle.registerTimer(int(rest["at"][0] // 1000 if len(rest) else zones["at"][-1] // 1000 + self.ttl // 1000 + 1))
        if len(ready):
            yield pd.DataFrame({"key": key[0], "id": ready["id"], "zones": known, "risk": risk})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = []
        for part in rows:
            packed = np.zeros(len(part), _ROW)
            for c, name in zip(_ROW.names, ("at_us", "id", "x", "y", "danger"), strict=True):
                packed[c] = part[name].to_numpy()
            new.append(packed)
        now_ms = timerValues.getCurrentWatermarkInMs()
        first = min(int(n["at"].min()) for n in new) // 1000
        if first > now_ms:
            self.waiting.appendList([(n.tobytes(),) for n in new])
            self.handle.registerTimer(first)
        else:
            yield from self._advance(key, new, now_ms)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._advance(key, [], timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


def remembered_risk(rows: DataFrame, late: str = "10 minutes", ttl_hours: int = TTL_HOURS, most: int = MOST, radius: float = RADIUS) -> DataFrame:
    """(key, id, zones, risk) of a stream of rows (key, id, ts, x, y, danger), in append mode; rows later than late behind the watermark may be felt out of order."""
    timed = rows.withColumn("at_us", F.unix_micros("ts")).withWatermark("ts", late)
    kind = rows.schema["key"].dataType.simpleString()
    return timed.groupBy("key").transformWithStateInPandas(DangerMemory(ttl_hours * _HOUR, most, radius), f"key {kind}, id long, zones long, risk double", "Append", "EventTime")


def run_to_table(spark: SparkSession, folder: str, files: str, prepare, late: str = "10 minutes", files_at_once: int | None = None) -> DataFrame:
    """Runs remembered_risk over the Parquet files of a folder as one stream that appends to a table in the shared folder; prepare makes its rows. The state store is set in a session of its own."""
    own = spark.newSession()
    own.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    place = f"{shared_folder(spark)}/agentframe/memory-{uuid.uuid4().hex}"
    schema = own.read.option("pathGlobFilter", files).parquet(folder).schema
    reader = own.readStream.schema(schema).option("pathGlobFilter", files)
    felt = remembered_risk(prepare((reader.option("maxFilesPerTrigger", files_at_once) if files_at_once else reader).parquet(folder)), late)
    felt.writeStream.outputMode("append").format("parquet").option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start(f"{place}/felt").awaitTermination()
    return spark.read.schema(felt.schema).parquet(f"{place}/felt")
