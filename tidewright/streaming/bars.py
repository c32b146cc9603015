"""Bars of a stream of ticks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stream_bars(ticks: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Tumbling-window bars of streamed (event_type, ts, event_id, value); a window closes `late` after its end."""
    t = ticks.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    order = F.struct("ts", "event_id")
    g = t.groupBy(F.window("ts", width).alias("w"), F.col("event_type").alias("symbol")).agg(
        F.min_by("value", order).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", order).alias("close"), F.count("*").cast("double").alias("volume")
    )
    return g.select("symbol", F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume")


def read_ticks(spark: SparkSession, path: str, glob: str = "*.parquet") -> DataFrame:
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    return spark.readStream.schema(schema).option("pathGlobFilter", glob).parquet(path)
