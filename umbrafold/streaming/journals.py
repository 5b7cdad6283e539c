"""Journals as streams: JSON lines followed as they arrive, applied once, and clips counted by frames of event time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from umbrafold.sources.files import JOURNAL


def follow(spark: SparkSession, folder: str) -> DataFrame:
    """Records of a folder of journal files, each file read once."""
    return spark.readStream.schema(JOURNAL).json(folder)


def append(records: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Records added to a Parquet log, once each however often the stream restarts."""
    return records.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").start()


def absorb(side: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """A side journal merged into a log by seq: a batch adds the records whose seq the log lacks, so a repeated batch adds none."""

    def merge(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        new = batch.dropDuplicates(["seq"])
        path = spark._jvm.org.apache.hadoop.fs.Path(target)
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            new = new.join(spark.read.schema(JOURNAL).parquet(target).select("seq"), "seq", "left_anti").select(*batch.columns)
        new.write.mode("append").parquet(target)

    return side.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).start()


def frames(events: DataFrame, length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums by frame of event time and kind; rows later than the watermark are left out."""
    own = events.withWatermark("ts", late).groupBy(F.window("ts", length), "event_type")
    return own.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")
