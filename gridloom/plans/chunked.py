"""A long sequence of overlapping chunks, placed in one frame batch by batch.

Each chunk sees its frames in coordinates of its own.  Neighbours are fitted on
the frames they share, the fits are chained, and every frame's points are kept
from the one chunk that owns it.  Only ``batch`` chunks are worked on at a
time; what crosses to the next batch is one row, the transform of the last
chunk.  A batch's record is written after its rows, so a run that was stopped
goes on with the first batch that has none, and the result is that of one pass.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.cluster import held, store_of
from gridloom.functions import pose
from gridloom.operators import align, pooling, windows

RECORD = "first long, last long, n_points long, s double, r array<double>, t array<double>, batch int"
PLACED = "chunk long, frame long, pixel long, x double, y double, z double, conf double, batch int"
CHAINED = "chunk long, n long, s double, r array<double>, t array<double>, batch int"


def shared_frames(points: DataFrame) -> DataFrame:
    """(chunk, sx..., tx..., weight): points of chunk (source) and of the one before it (target) with the same frame and pixel.

    The weight is the geometric mean of the confidences; null coordinates, and
    confidences that are null or not above 0, take no part.
    """
    own = points.filter("conf > 0 and x is not null and y is not null and z is not null")
    name = lambda cols, conf: [*(F.col(c).alias(n) for c, n in zip("xyz", cols, strict=True)), F.col("conf").alias(conf)]
    source = own.select("chunk", "frame", "pixel", *name(align.SOURCE, "cs"))
    target = own.select((F.col("chunk") + 1).alias("chunk"), "frame", "pixel", *name(align.TARGET, "ct"))
    return source.join(target, ["chunk", "frame", "pixel"]).withColumn("weight", F.sqrt(F.col("cs") * F.col("ct")))


def _records(spark: SparkSession, output: str) -> list:
    path, store = store_of(spark, f"{output}/records")
    return spark.read.schema(RECORD).parquet(f"{output}/records").orderBy("batch").collect() if store.exists(path) else []  # a row a batch


def run(spark: SparkSession, points: DataFrame, output: str, *, frames: int, size: int, overlap: int, batch: int = 32, delta: float | None = None, rounds: int = 1, most: int | None = None) -> list:
    """Work off the batches that have no record yet, ``most`` of them; returns the records.

    ``points`` has chunk, frame (of the sequence), pixel, x, y, z, conf;
    ``frames``, ``size`` and ``overlap`` are those of ``windows.chunk_windows``.
    A chunk without points in common with the one before it cannot be placed:
    an error.  ``<output>/placed`` has the owned points in the first chunk's
    coordinates, ``<output>/chained`` every chunk's transform to it.
    """
    if not 0 < overlap < size:
        raise ValueError("an overlap must be above 0 and below the size")
    chunks = windows.chunk_windows(spark, frames, size, overlap).count()
    done = _records(spark, output)
    start, left = len(done), -(-chunks // batch)
    for number in range(start, left if most is None else min(left, start + most)):
        first, last = number * batch, min((number + 1) * batch, chunks) - 1
        near = points.filter(F.col("chunk").between(first - 1, last))
        pairs = held(shared_frames(near).filter(F.col("chunk").between(max(first, 1), last)), "chunked-pairs")
        fits = align.irls_by(pairs, ["chunk"], delta=delta, rounds=rounds) if delta is not None else align.fit_by(pairs, ["chunk"], weight=F.col("weight"))
        steps = fits.select("chunk", "n", "s", "r", "t")
        if number == 0:
            base = pose.sim3(F.lit(1.0), F.array(*(F.lit(float(k % 4 == 0)) for k in range(9))), F.array(*(F.lit(0.0),) * 3))
            none = spark.range(1).select(F.col("id").alias("chunk"), F.lit(0.0).alias("n"), base["s"].alias("s"), base["r"].alias("r"), base["t"].alias("t"))
            steps = none.unionByName(steps)
        else:
            m = done[-1]
            base = pose.sim3(F.lit(m["s"]), F.array(*map(F.lit, m["r"])), F.array(*map(F.lit, m["t"])))
        steps = held(steps, "chunked-steps")
        if steps.count() != last - first + 1:
            raise ValueError(f"batch {number}: a chunk shares no points with the one before it")
        chain = pooling.chained(steps.withColumn("run", F.lit(0)), ["run"], "chunk")  # ``batch`` rows
        placed = pose.compose(base, pose.sim3(F.col("s"), F.col("r"), F.col("t")))
        chain = chain.select("chunk", placed.alias("m")).select("chunk", "m.*").join(steps.select("chunk", F.col("n").cast("long").alias("n")), "chunk")
        put = lambda df, name, number=number: df.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{output}/{name}")
        put(chain.select("chunk", "n", "s", "r", "t"), "chained")
        known = spark.read.schema(CHAINED).parquet(f"{output}/chained").filter(F.col("batch") == number)
        own = near.filter(F.col("chunk") == windows.owner(F.col("frame"), frames, size, overlap)).filter(F.col("chunk") >= first)
        moved = own.join(F.broadcast(known.select("chunk", pose.sim3(F.col("s"), F.col("r"), F.col("t")).alias("m"))), "chunk")  # ``batch`` rows
        moved = moved.withColumn("p", pose.apply(F.col("m"), F.array("x", "y", "z")))
        put(moved.select("chunk", "frame", "pixel", *(F.get("p", F.lit(k)).alias(c) for k, c in enumerate("xyz")), F.col("conf").cast("double").alias("conf")), "placed")
        n = spark.read.schema(PLACED).parquet(f"{output}/placed").filter(F.col("batch") == number).count()
        end = known.filter(F.col("chunk") == last).select(F.lit(first).cast("long").alias("first"), F.lit(last).cast("long").alias("last"), F.lit(n).cast("long").alias("n_points"), "s", "r", "t")
        put(end, "records")
        done = _records(spark, output)
    return done


def placed(spark: SparkSession, output: str) -> DataFrame:
    """The points of the batches that have a record."""
    return spark.read.schema(PLACED).parquet(f"{output}/placed").join(F.broadcast(spark.read.schema(RECORD).parquet(f"{output}/records").select("batch")), "batch")  # a row a batch
