"""Line formats read with Spark's text reader: trajectories, poses, loop pairs, run lists, camera models.

Lines keep their place through ``line`` (file name and offset order within a
single-file input) only where a format needs it; malformed lines raise in the
strict readers and are skipped in the tolerant ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NUMBER = r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?$"


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line, value): non-empty lines, numbered from 0 within their file."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.posexplode(F.split("value", "\r?\n")).alias("line", "value"))
    return whole.filter(F.trim("value") != "")


def fields(value: Column) -> Column:
    return F.split(F.trim(value), r"[\s,]+")


def _doubles(value: Column) -> Column:
    return F.transform(fields(value), lambda x: F.when(x.rlike(NUMBER), x.cast("double")))


def _uncommented(rows: DataFrame) -> DataFrame:
    return rows.filter(~F.ltrim("value").startswith("#"))


def tum(spark: SparkSession, path: str) -> DataFrame:
    """(path, ts, x, y, z, qx, qy, qz, qw) of ``ts tx ty tz qx qy qz qw`` lines; comments and short lines are skipped."""
    rows = _uncommented(lines(spark, path)).select("path", "line", _doubles(F.col("value")).alias("v")).filter((F.size("v") >= 8) & F.forall("v", lambda x: x.isNotNull()))
    return rows.select("path", "line", *(F.col("v")[k].alias(n) for k, n in enumerate(("ts", "x", "y", "z", "qx", "qy", "qz", "qw"))))


def tum_positions(spark: SparkSession, path: str) -> DataFrame:
    """(path, ts, x, y, z): the first four columns only."""
    rows = _uncommented(lines(spark, path)).select("path", "line", F.slice(_doubles(F.col("value")), 1, 4).alias("v")).filter((F.size("v") == 4) & F.forall("v", lambda x: x.isNotNull()))
    return rows.select("path", "line", *(F.col("v")[k].alias(n) for k, n in enumerate(("ts", "x", "y", "z"))))


def camera_poses(spark: SparkSession, path: str, *, strict: bool = True) -> DataFrame:
    """(path, line, pose): sixteen numbers a line, a 4 x 4 camera-to-world matrix in row order.

    Strict: any other line is an error.  Tolerant: it is skipped.
    """
    rows = lines(spark, path).select("path", "line", _doubles(F.col("value")).alias("pose"))
    ok = (F.size("pose") == 16) & F.forall("pose", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    if not strict:
        return rows.filter(ok)
    return rows.filter(F.when(ok, True).otherwise(F.raise_error(F.concat(F.lit("not a 4 x 4 pose, line "), F.col("line").cast("string"))).cast("boolean")))


def pose_centres(poses: DataFrame) -> DataFrame:
    """(path, line, x, y, z): elements 3, 7 and 11."""
    return poses.select("path", "line", *(F.col("pose")[k].alias(n) for k, n in ((3, "x"), (7, "y"), (11, "z"))))


def loop_pairs(spark: SparkSession, path: str, *, head: int | None = None) -> DataFrame:
    """(image_a, image_b, sim) of a CSV with ``image_index_a`` and ``image_index_b``; ``head`` first rows in file order."""
    rows = spark.read.csv(path, header=True)
    sim = F.col("sim").cast("double") if "sim" in rows.columns else F.lit(None).cast("double")
    out = rows.select(F.col("image_index_a").cast("long").alias("image_a"), F.col("image_index_b").cast("long").alias("image_b"), sim.alias("sim"))
    return out if head is None else out.limit(head)


def intrinsics(spark: SparkSession, path: str) -> DataFrame:
    """(path, line, fx, fy, cx, cy)."""
    rows = lines(spark, path).select("path", "line", _doubles(F.col("value")).alias("v")).filter(F.size("v") == 4)
    return rows.select("path", "line", *(F.col("v")[k].alias(n) for k, n in enumerate(("fx", "fy", "cx", "cy"))))


#: Header names under which a run list may give the run, and the bag.
RUN_NAMES, BAG_NAMES = ("#Sequence Name", "sequence", "run_name", "run"), ("bag", "bag_path", "#Bag")


def run_list(spark: SparkSession, path: str) -> DataFrame:
    """(run_name, bag) from a JSON file with ``runs`` or a CSV with one of the known headers."""
    if path.endswith(".json"):
        rows = spark.read.json(path, multiLine=True).select(F.explode("runs").alias("r")).select("r.*")
    else:
        rows = spark.read.csv(path, header=True)
    name = next(n for n in RUN_NAMES if n in rows.columns)
    bag = next((F.col(f"`{n}`") for n in BAG_NAMES if n in rows.columns), F.lit(None))
    return rows.select(F.trim(F.col(f"`{name}`")).alias("run_name"), bag.cast("string").alias("bag"))


def init_poses(spark: SparkSession, path: str) -> DataFrame:
    """(run, floor_plan, ts, x, y, z, qx, qy, qz, qw) of a ``#``-headed CSV; the last row of a run wins."""
    rows = _uncommented(lines(spark, path)).select("line", F.split("value", ",").alias("v")).filter(F.size("v") >= 10)
    names = ("x", "y", "z", "qx", "qy", "qz", "qw")
    parsed = rows.select("line", F.trim(F.col("v")[0]).alias("run"), F.trim(F.col("v")[1]).alias("floor_plan"), *(F.trim(F.col("v")[k]).cast("double").alias(n) for k, n in enumerate(("ts", *names), 2)))
    rest = ["floor_plan", "ts", *names]
    return parsed.groupBy("run").agg(F.max(F.struct("line", *rest)).alias("r")).select("run", *(f"r.{c}" for c in rest))


def colmap_cameras(spark: SparkSession, path: str) -> DataFrame:
    """(camera_id, model, width, height, params) of a cameras text file."""
    rows = _uncommented(lines(spark, path)).select(fields(F.col("value")).alias("v"))
    params = F.transform(F.slice(F.col("v"), F.lit(5), F.size("v") - 4), lambda x: x.cast("double"))
    return rows.select(F.col("v")[0].cast("int").alias("camera_id"), F.col("v")[1].alias("model"), F.col("v")[2].cast("int").alias("width"), F.col("v")[3].cast("int").alias("height"), params.alias("params"))


def colmap_images(spark: SparkSession, path: str) -> DataFrame:
    """(image_id, q, t, camera_id, name) of an images text file: every other line, as the next one lists points."""
    whole = spark.read.text(path, wholetext=True).select(F.split("value", "\r?\n").alias("all"))
    kept = whole.select(F.posexplode(F.filter("all", lambda x: ~F.ltrim(x).startswith("#"))).alias("n", "value")).filter((F.col("n") % 2 == 0) & (F.trim("value") != ""))
    v = kept.select(fields(F.col("value")).alias("v"))
    numbers = lambda a, n: F.transform(F.slice("v", a, n), lambda x: x.cast("double"))
    return v.select(F.col("v")[0].cast("int").alias("image_id"), numbers(2, 4).alias("q"), numbers(6, 3).alias("t"), F.col("v")[8].cast("int").alias("camera_id"), F.col("v")[9].alias("name"))


def colmap_points(spark: SparkSession, path: str) -> DataFrame:
    """(point_id, x, y, z, r, g, b, error, track) with track an array of (image_id, point2d)."""
    rows = _uncommented(lines(spark, path)).select(fields(F.col("value")).alias("v"))
    kinds = (("point_id", "long"), ("x", "double"), ("y", "double"), ("z", "double"), ("r", "short"), ("g", "short"), ("b", "short"), ("error", "double"))
    pairs = F.transform(F.sequence(F.lit(8), F.size("v") - 2, F.lit(2)), lambda k: F.struct(F.get("v", k).cast("int").alias("image_id"), F.get("v", k + 1).cast("int").alias("point2d")))
    return rows.select(*(F.col("v")[k].cast(t).alias(n) for k, (n, t) in enumerate(kinds)), F.when(F.size("v") > 9, pairs).otherwise(F.array().cast("array<struct<image_id:int,point2d:int>>")).alias("track"))
