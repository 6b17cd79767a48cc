"""The driver's tables read as the engine's entities: descriptors, series, clouds, frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def descriptors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, vec, label): one descriptor an image."""
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label")


def views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(capture, view, vec): four views a capture."""
    return descriptors(spark, sf_dir).select(F.expr("id div 4").alias("capture"), (F.col("id") % 4).cast("int").alias("view"), "vec")


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, ts in microseconds, event_id, event_type, value): one series a user."""
    ts = F.unix_micros(F.col("ts").cast("timestamp")).alias("ts")
    return read(spark, sf_dir, "events").select("user_id", ts, "event_id", "event_type", "value")


def cloud(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(x, y, z in thousandths as longs, conf, side): a cloud of points; exact duplicates are interchangeable."""
    return read(spark, sf_dir, "lineitem").select(
        F.round(F.col("l_quantity") * 1000).cast("long").alias("x"), F.round("l_extendedprice").cast("long").alias("y"),
        F.round(F.col("l_discount") * 100_000).cast("long").alias("z"), F.col("l_tax").alias("conf"), F.col("l_linestatus").alias("side"),
    )


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(frame, total): frames numbered from 0 in the order of their keys, which are dense from 0."""
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("frame"), F.col("o_totalprice").alias("total"))
