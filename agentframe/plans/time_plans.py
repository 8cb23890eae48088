"""Joins on time over orders and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from agentframe.operators import temporal
from agentframe.plans.declare import query
from agentframe.plans.fixtures import table

_MOMENTS = "(SELECT o_orderkey, o_custkey % 150 AS user_id, TIMESTAMP '2024-01-01' + to_seconds(CAST(o_orderkey * 7919 % 2592000 AS BIGINT)) AS ts FROM orders)"


def _moments(spark, sf_dir):
    """Orders as moments of January 2024, each of one of 150 users."""
    second = (F.col("o_orderkey") * 7919 % 2592000).cast("long") + 1704067200
    return table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 150).alias("user_id"), F.timestamp_seconds(second).alias("ts"))


def _events(spark, sf_dir, *columns):
    return table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), *columns)


@query(
    f"""WITH e AS (SELECT user_id, ts, event_id, value, row_number() OVER (PARTITION BY user_id, ts ORDER BY event_id DESC) AS k FROM events)
    SELECT o_orderkey, coalesce(e.event_id, -1) AS event_id, CAST(coalesce(epoch_us(e.ts), -1) AS BIGINT) AS at_us, coalesce(e.value, -1) AS value FROM {_MOMENTS} m ASOF LEFT JOIN (SELECT * FROM e WHERE k = 1) e ON m.user_id = e.user_id AND m.ts >= e.ts"""
)
def time_latest_event(spark, sf_dir):
    """Each order with the latest event of its user up to that moment."""
    out = temporal.asof_join(_moments(spark, sf_dir), _events(spark, sf_dir, "user_id", "event_id", "value"), ["user_id"], "ts", ["event_id", "value"], ties=["event_id"])
    return out.select("o_orderkey", F.coalesce("event_id", F.lit(-1)).alias("event_id"), F.coalesce(F.unix_micros("r_ts"), F.lit(-1)).alias("at_us"), F.coalesce("value", F.lit(-1.0)).alias("value"))


@query(
    f"""WITH e AS (SELECT ts, max(event_id) AS event_id FROM events GROUP BY ts)
    SELECT o_orderkey, CASE WHEN m.ts - e.ts <= INTERVAL 2 MINUTE THEN e.event_id ELSE -1 END AS event_id FROM {_MOMENTS} m ASOF LEFT JOIN e ON m.ts > e.ts"""
)
def time_latest_of_all(spark, sf_dir):
    """The last event of anybody before each order, if it is no older than two minutes: one key holds all rows."""
    left, right = _moments(spark, sf_dir).withColumn("one", F.lit(1)), _events(spark, sf_dir, "event_id").withColumn("one", F.lit(1))
    return temporal.asof_join(left, right, ["one"], "ts", ["event_id"], ties=["event_id"], most=120.0, strictly=True).select("o_orderkey", F.coalesce("event_id", F.lit(-1)).alias("event_id"))


@query(f"SELECT event_id, count(*) AS n, min(o_orderkey) AS first FROM {_MOMENTS} m JOIN events e ON m.user_id = e.user_id AND m.ts >= e.ts AND m.ts < e.ts + to_seconds(CAST(e.event_id % 7 * (e.event_id % 7) * 1800 AS BIGINT)) GROUP BY event_id")
def time_within_interval(spark, sf_dir):
    """Orders of a user in the hours after each event, up to eighteen of them."""
    spell = (F.col("event_id") % 7 * (F.col("event_id") % 7) * 1800).cast("long")
    spans = _events(spark, sf_dir, "user_id", "event_id").select("user_id", "event_id", F.col("ts").alias("since"), F.timestamp_micros(F.unix_micros("ts") + spell * 1000000).alias("until"))
    return temporal.interval_join(_moments(spark, sf_dir), spans, ["user_id"], "ts", "since", "until").groupBy("event_id").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first"))
