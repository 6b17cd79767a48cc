"""Incremental job: recorded messages in, one report a day and rig out.

Whoever records for days needs to know, before reconstructing, which rig was
silent when and how many of its frames have a sensor message close enough.
Files of messages (event_id, ts, user_id as the rig, event_type as the topic,
value) arrive in one folder.  A file stream takes what is new since its
checkpoint and ends (``availableNow``); each batch

1. lands in ``<output>/messages``, partitioned by day and batch: a batch that
   is run again after a stop replaces its own partitions; messages without id,
   stamp or rig go to ``<output>/rejected``;
2. has its days worked out again from all messages of those days (late ones
   count) and replaces just those partitions of ``<output>/days``.

A message is (id, stamp, rig): if it was delivered twice it counts once.  A day's report
is the same whatever files and batches its messages came in.

    python -m jobs.sensor_days --input FOLDER --output FOLDER --checkpoint FOLDER [--config FILE]
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.cluster import store_of
from gridloom.operators import asof
from jobs.command import main, settings

log = logging.getLogger("jobs.sensor_days")

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double"
LANDED = "rig long, stamp long, id long, topic string, value double, batch int, day date"
REPORT = "rig long, n_messages long, n_topics long, first_us long, last_us long, longest_us long, n_silent long, n_frames long, n_matched long, offset_us long, day date"
SECOND = 1_000_000
DAY = 86_400 * SECOND


def messages(rows: DataFrame) -> DataFrame:
    """(day, rig, stamp in microseconds, id, topic, value): each message once, the least of those that share id, stamp and rig."""
    keys = ["day", "rig", "stamp", "id"]
    once = rows.groupBy(*keys).agg(F.min(F.struct("topic", "value")).alias("rest"))
    return once.select(*keys, "rest.*")


def reports(rows: DataFrame, days: list, config: dict) -> DataFrame:
    """(day, rig, counts, gaps, matched frames) of the given days; ``rows`` holds them and their neighbours.

    Series are cut into slices of time, so a rig with most of the messages is
    many tasks' work.  Frames are matched across midnight.
    """
    width, within = config["slice_seconds"] * SECOND, config["tolerance_seconds"] * SECOND
    own = rows.filter(F.col("day").isin(days))
    counted = own.groupBy("day", "rig").agg(F.count("*").alias("n_messages"), F.countDistinct("topic").alias("n_topics"), F.min("stamp").alias("first_us"), F.max("stamp").alias("last_us"))
    gaps = asof.silences(own, ["day", "rig"], ts="stamp", order="id", limit=config["silence_seconds"] * SECOND, width=max(width // 24, 1))
    frames = own.filter(F.col("topic") == config["frame_topic"]).select("rig", "stamp", "day", "id")
    sensor = rows.filter(F.col("topic") == config["sensor_topic"]).select("rig", "stamp", F.col("id").alias("sensor"), "value")
    near = asof.nearest_within(frames, sensor, ["rig"], ts="stamp", order="sensor", carry=["value"], within=within, width=width)
    off = F.abs(F.col("r_stamp") - F.col("stamp"))
    matched = near.groupBy("day", "rig").agg(F.count("*").alias("n_frames"), F.count("r_stamp").alias("n_matched"), F.sum(off).alias("offset_us"))
    out = counted.join(gaps, ["day", "rig"], "left").join(matched, ["day", "rig"], "left").fillna(0, ["n_frames", "n_matched"])
    return out.select("day", "rig", "n_messages", "n_topics", "first_us", "last_us", "longest_us", "n_silent", "n_frames", "n_matched", "offset_us")


def run(spark: SparkSession, source: str, output: str, checkpoint: str, *, config: dict | None = None) -> dict:
    """Take what is new in ``source``; returns and logs what was read and written."""
    c = settings(__file__, config)
    done = {"batches": 0, "read": 0, "landed": 0, "rejected": 0, "days": 0, "reports": 0}
    around = -(-c["tolerance_seconds"] * SECOND // DAY)

    def take(batch: DataFrame, number: int) -> None:
        held = batch.select(
            F.to_date("ts").alias("day"), F.col("user_id").alias("rig"), F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)").alias("stamp"),
            F.col("event_id").alias("id"), F.col("event_type").alias("topic"), "value",
        ).withColumn("batch", F.lit(number))
        whole = F.col("id").isNotNull() & F.col("stamp").isNotNull() & F.col("rig").isNotNull()
        put = lambda df, name, *by: df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(f"{output}/{name}")
        put(held.filter(whole), "messages", "batch", "day")
        put(held.filter(~whole).drop("day"), "rejected", "batch")
        landed = spark.read.schema(LANDED).parquet(f"{output}/messages")
        mine = landed.filter(F.col("batch") == number).groupBy("day").agg(F.count("*").alias("n")).collect()  # a row a day
        rejected = spark.read.schema("rig long, batch int").parquet(f"{output}/rejected").filter(F.col("batch") == number).count()
        n = sum(r["n"] for r in mine)
        days = sorted({r["day"].toordinal() + k for r in mine for k in range(-around, around + 1)})
        dates = [type(mine[0]["day"]).fromordinal(d) for d in days]
        wider = [type(mine[0]["day"]).fromordinal(d) for d in sorted({d + k for d in days for k in range(-around, around + 1)})] if days else []
        put(reports(messages(landed.filter(F.col("day").isin(wider))), dates, c), "days", "day")
        written = spark.read.schema(REPORT).parquet(f"{output}/days").filter(F.col("day").isin(dates)).count()
        for k, v in (("batches", 1), ("read", n + rejected), ("landed", n), ("rejected", rejected), ("days", len(mine)), ("reports", written)):
            done[k] += v
        log.info("batch %d: read %d messages, landed %d of %d days, rejected %d; wrote %d reports to %s/days", number, n + rejected, n, len(mine), rejected, written, output)

    at, store = store_of(spark, source)
    if store.getFileStatus(at).isFile():  # a file stream takes folders and patterns only
        source = f"{source[:-1]}[{source[-1]}]"
    arriving = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", c["files_per_batch"]).parquet(source)
    stream = arriving.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    stream.awaitTermination()
    if not done["batches"]:
        log.info("nothing new in %s", source)
    return done


if __name__ == "__main__":
    main(run, ["input", "output", "checkpoint"], "sensor_days")
