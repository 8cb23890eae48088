"""Structured Streaming over the events table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from agentframe.sources.shared import shared_folder


def windowed(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, event_type, n, cents) of tumbling windows; events later than late behind the watermark are dropped."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    totals = timed.groupBy(F.window("at", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents"))
    return totals.select(F.col("w.start").alias("start"), "event_type", "n", "cents")


def hourly_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs the windows over the whole table as one stream that appends finished windows, those the watermark has passed, to a Parquet table in the shared folder.

    State and driver hold open windows only, whatever the stream's length; windows still open when the input ends stay out.
    """
    root = shared_folder(spark)
    place = f"{root}/agentframe/stream-{uuid.uuid4().hex}"
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events*.parquet").parquet(sf_dir)
    totals = windowed(events)
    running = totals.writeStream.outputMode("append").format("parquet").option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start(f"{place}/totals")
    running.awaitTermination()
    done = spark.read.schema(totals.schema).parquet(f"{place}/totals")
    return done.select(F.unix_micros("start").alias("start_us"), "event_type", "n", "cents")
