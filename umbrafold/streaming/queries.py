"""The batch form of the streaming aggregation; the same function serves a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from umbrafold.streaming.journals import frames


def event_frames(spark, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    return frames(e).select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n", F.round("total", 3).alias("total"))


QUERIES = {"event_frames": (event_frames, "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS start, event_type, CAST(count(*) AS BIGINT) AS n, round(sum(value), 3) AS total FROM events GROUP BY 1, 2")}
