"""Raster tables over the embeddings: one 8 x 8 image of 8-bit codes per vector, as an array or one row per pixel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WIDTH = HEIGHT = 8

#: The same view in DuckDB, as the start of a WITH list.
PX_SQL = """px AS (
  SELECT vec_id, label, CAST(i - 1 AS INT) AS pos, CAST((i - 1) % 8 AS INT) AS x, CAST((i - 1) // 8 AS INT) AS y,
         CAST(least(greatest(floor((CAST(embedding[i] AS DOUBLE) + 0.6) / 1.2 * 256), 0), 255) AS INT) AS code
  FROM embeddings, range(1, 65) r(i))"""

#: Three channels in 0..1: the image, the image turned by half, the image with x and y exchanged.
RGB_SQL = (
    PX_SQL
    + """, rgb AS (
  SELECT a.vec_id, a.label, a.pos, a.x, a.y, a.code / 255.0::DOUBLE AS r, b.code / 255.0::DOUBLE AS g, c.code / 255.0::DOUBLE AS b
  FROM px a JOIN px b ON b.vec_id = a.vec_id AND b.pos = 63 - a.pos JOIN px c ON c.vec_id = a.vec_id AND c.x = a.y AND c.y = a.x)"""
)


def quantised(v: Column) -> Column:
    return F.least(F.greatest(F.floor((v.cast("double") + 0.6) / 1.2 * 256).cast("int"), F.lit(0)), F.lit(255))


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, label, codes): the pixels of an image in one array, row by row."""
    raw = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return raw.select("vec_id", "label", F.transform("embedding", quantised).alias("codes"))


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, label, pos, x, y, code)."""
    px = images(spark, sf_dir).select("vec_id", "label", F.posexplode("codes").alias("pos", "code"))
    return px.select("vec_id", "label", "pos", (F.col("pos") % WIDTH).alias("x"), F.floor(F.col("pos") / WIDTH).cast("int").alias("y"), "code")


def rgb_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, label, pos, x, y, r, g, b), each channel read from the array without a join."""
    px = images(spark, sf_dir).select("vec_id", "label", "codes", F.posexplode("codes").alias("pos", "code"))
    x, y = F.col("pos") % WIDTH, F.floor(F.col("pos") / WIDTH).cast("int")
    at = lambda k: F.get("codes", k) / F.lit(255.0)
    return px.select("vec_id", "label", "pos", x.alias("x"), y.alias("y"), at(F.col("pos")).alias("r"), at(63 - F.col("pos")).alias("g"), at((x * WIDTH + y).cast("int")).alias("b"))
