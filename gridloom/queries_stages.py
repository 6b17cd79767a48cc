"""Queries over stages that are reused or resumed, live tables, layouts of runs, and what sinks take and give."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom import stand_ins as S
from gridloom.cluster import delete, scratch, ship, store_of
from gridloom.functions import camera, harmonics
from gridloom.operators import masks
from gridloom.plans import reuse
from gridloom.queries import query
from gridloom.sources import files, ply
from gridloom.streaming import live


def T(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return S.read(spark, sf_dir, name)


# Stages: what is whole and asked for again is read, all else is built.


@query(
    """
WITH s AS (SELECT count(*) AS n, sum(n)::BIGINT AS orders FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1)),
t AS (SELECT count(*) AS n, sum(n)::BIGINT AS orders FROM (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1))
SELECT 1 AS attempt, false AS reused, n, orders FROM s UNION ALL SELECT 2, true, n, orders FROM s UNION ALL SELECT 3, false, n, orders FROM t
UNION ALL SELECT 4, true, n, orders FROM t UNION ALL SELECT 5, false, n, orders FROM t UNION ALL SELECT 6, false, n, orders FROM t
"""
)
def stage_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stage asked for six times: new, the same, another request, the same, without its record, and with rows gone from its table."""
    root = scratch(spark, "stages")

    def build(status: str | None) -> DataFrame:
        rows = T(spark, sf_dir, "orders")
        return (rows if status is None else rows.filter(F.col("o_orderstatus") == status)).groupBy("o_custkey").agg(F.count("*").alias("n"))

    seen = []
    for attempt, status in enumerate((None, None, "F", "F", "F", "F"), 1):
        if attempt == 5:
            delete(spark, f"{root}/per_customer/record")
        if attempt == 6:
            few = T(spark, sf_dir, "orders").filter("o_orderstatus <> 'F'").groupBy("o_custkey").agg(F.count("*").alias("n"))
            few.write.mode("overwrite").parquet(f"{root}/per_customer/rows")
        table, reused = reuse.materialise(spark, root, "per_customer", {"status": status}, lambda status=status: build(status))
        seen.append((attempt, reused, *table.agg(F.count("*"), F.sum("n")).first()))
    return spark.createDataFrame(seen, "attempt int, reused boolean, n long, orders long")


@query(
    """
SELECT (c_nationkey % 5)::INTEGER AS part, c_nationkey % 5 < 3 AND c_nationkey % 5 <> 1 AS reused, count(*) AS n, sum(c_custkey)::BIGINT AS keys FROM customer GROUP BY ALL
"""
)
def window_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five windows of which three were done before a stop; the second of them lost rows, so the resumed pass does it and the last two."""
    root = scratch(spark, "windows")

    def members(part: int) -> DataFrame:
        return T(spark, sf_dir, "customer").filter(F.col("c_nationkey") % 5 == part).select("c_custkey", "c_nationkey")

    for part in range(3):
        reuse.materialise(spark, root, f"window_{part}", {"start": part, "stop": part + 1}, lambda part=part: members(part))
    members(1).filter("c_custkey % 2 = 0").write.mode("overwrite").parquet(f"{root}/window_1/rows")
    out = None
    for part in range(5):
        table, reused = reuse.materialise(spark, root, f"window_{part}", {"start": part, "stop": part + 1}, lambda part=part: members(part))
        one = table.select(F.lit(part).alias("part"), F.lit(reused).alias("reused"), "c_custkey")
        out = one if out is None else out.unionByName(one)
    return out.groupBy("part", "reused").agg(F.count("*").alias("n"), F.sum("c_custkey").alias("keys"))


# Live tables: an input that grows between runs.


def _grown(spark: SparkSession, sf_dir: str, name: str):
    """(the rows of the events table that come before and after its middle in time, a folder for them)."""
    rows = S.series(spark, sf_dir)
    low, high = rows.agg(F.min("ts"), F.max("ts")).first()
    middle = 0 if low is None else (low + high) // 2
    return rows.filter(F.col("ts") < middle), rows.filter(F.col("ts") >= middle), scratch(spark, name)


@query("SELECT event_id, user_id, event_type, value FROM events")
def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log that three runs append to: half of the events, the other half, nothing new."""
    first, second, at = _grown(spark, sf_dir, "log")
    for part in (first, second, None):
        if part is not None:
            part.write.mode("append").parquet(f"{at}/in")
        live.log_events(spark.readStream.schema(first.schema).parquet(f"{at}/in"), f"{at}/out", f"{at}/mark").awaitTermination()
    return spark.read.parquet(f"{at}/out").select("event_id", "user_id", "event_type", "value")


@query(
    """
WITH s AS (SELECT user_id, list({l: value::DOUBLE, t: epoch_us(ts)} ORDER BY ts, event_id) AS v FROM events WHERE value IS NOT NULL GROUP BY user_id)
SELECT user_id, round(list_reduce(v, lambda a, x: {l: a.l + (1 - exp(-greatest((x.t - a.t) / 1e6, 1e-6) / 86400.0)) * (x.l - a.l), t: x.t}).l, 6) AS level FROM s
"""
)
def live_smoothing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The level that each user's causal low-pass ends on, its state carried from the first run of the stream to the second."""
    ship(spark)
    first, second, at = _grown(spark, sf_dir, "smooth")
    for part in (first, second):
        part.write.mode("append").parquet(f"{at}/in")
        rows = spark.readStream.schema(first.schema).parquet(f"{at}/in").select("user_id", "ts", "event_id", "value")
        live.log_events(live.smooth(rows, ["user_id"], ts="ts", order="event_id", value="value", tau=86_400.0), f"{at}/out", f"{at}/mark").awaitTermination()
    last = F.max_by("smooth", F.struct("ts", "event_id"))
    return spark.read.parquet(f"{at}/out").groupBy("user_id").agg(F.round(last, 6).alias("level"))


# Layouts of runs and sinks.


@query(
    """
SELECT concat('floor_', s_nationkey % 3, '/', '2025-05-0', 1 + s_nationkey % 2, '/run_', s_nationkey) AS run, count(*) AS n, sum(s_suppkey)::BIGINT AS keys
FROM supplier WHERE s_nationkey % 4 <> 3 GROUP BY 1
"""
)
def prediction_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs found by the file that they must hold, and the rows of those files; runs without it are passed over."""
    at = scratch(spark, "runs")
    rows = T(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    for (nation,) in rows.select("s_nationkey").distinct().collect():  # at most 25
        folder = f"{at}/floor_{nation % 3}/2025-05-0{1 + nation % 2}/run_{nation}/reconstruction/predictions"
        rows.filter(F.col("s_nationkey") == nation).select("s_suppkey").coalesce(1).write.option("header", True).csv(folder)
        name = "aligned.csv" if nation % 4 != 3 else "raw.csv"
        _renamed(spark, folder, f"{folder}/{name}")
    found = files.runs(spark, at, "aligned.csv")
    paths = [r["path"] for r in found.select("path").collect()]  # a run each
    if not paths:
        return spark.createDataFrame([], "run string, n long, keys long")
    read = spark.read.option("header", True).schema("s_suppkey long").csv(paths)
    run = F.regexp_extract(F.input_file_name(), r"(floor_[^/]+/[^/]+/run_[^/]+)/", 1)
    return read.select(run.alias("run"), "s_suppkey").groupBy("run").agg(F.count("*").alias("n"), F.sum("s_suppkey").alias("keys"))


def _renamed(spark: SparkSession, folder: str, to: str) -> None:
    """Give the only part file of a written folder a name."""
    at, store = store_of(spark, folder)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    part = next(s.getPath() for s in store.listStatus(at) if s.getPath().getName().startswith("part-"))
    if not store.rename(part, path(to)):
        raise OSError(f"{to} could not be published")


@query("SELECT l_linestatus AS side, l_quantity::FLOAT::DOUBLE AS x, l_discount::FLOAT::DOUBLE AS y, l_tax::FLOAT::DOUBLE AS z FROM lineitem WHERE l_tax > (SELECT avg(l_tax) * 0.9 FROM lineitem)")
def confident_clouds_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder of files a side with the points above a share of the mean confidence, then all files read as one cloud."""
    rows = T(spark, sf_dir, "lineitem")
    least = rows.agg(F.avg("l_tax") * 0.9).first()[0]
    good = rows.filter(F.col("l_tax") > F.lit(least))
    points = good.select(F.col("l_linestatus").alias("side"), F.col("l_quantity").alias("x"), F.col("l_discount").alias("y"), F.col("l_tax").alias("z"), *(F.lit(k).alias(c) for k, c in enumerate(("red", "green", "blue"))))
    at = scratch(spark, "clouds")
    ply.write_clouds(points, "side", at)
    return ply.read_xyz(spark, at).select(F.regexp_extract("path", r"/side=([^/]+)/[^/]+$", 1).alias("side"), "x", "y", "z")


@query(
    """
WITH s AS (SELECT l_orderkey, l_linenumber, l_extendedprice / l_quantity AS f, l_extendedprice / (l_quantity + 1) AS b, l_tax * 12 AS qf, l_discount * 10 AS qb FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN qf > 0.7 AND qb > 0.7 THEN (f + b) / 2 WHEN qf >= qb THEN f ELSE b END AS scale FROM s
"""
)
def scale_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    price, n = F.col("l_extendedprice"), F.col("l_quantity")
    chosen = masks.choose_scale(price / n, price / (n + 1), F.col("l_tax") * 12, F.col("l_discount") * 10)
    return T(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", chosen.alias("scale"))


@query(
    """
WITH s AS (SELECT layer, 2 ** layer AS side, floor(512 / 1500 * 1000 * (2 / 2 ** layer)) AS lap FROM range(1, 3) t(layer)),
w AS (SELECT layer, side, lap, ceil((lap * (side - 1) + 1500) / side) AS w, ceil((lap * (side - 1) + 1000) / side) AS h FROM s),
b AS (SELECT 0 AS layer, 0 AS x0, 0 AS y0, 1500 AS x1, 1000 AS y1
      UNION ALL SELECT layer, floor((w - lap) * i), floor((h - lap) * j), least(floor((w - lap) * i) + w, 1500), least(floor((h - lap) * j) + h, 1000) FROM w, range(4) a(i), range(4) c(j) WHERE i < side AND j < side)
SELECT layer::INTEGER AS layer, x0::INTEGER AS x0, y0::INTEGER AS y0, x1::INTEGER AS x1, y1::INTEGER AS y1, count(*) AS n
FROM b JOIN part ON p_partkey * 7 % 1500 >= x0 AND p_partkey * 7 % 1500 < x1 AND p_partkey * 13 % 1000 >= y0 AND p_partkey * 13 % 1000 < y1 GROUP BY ALL
"""
)
def points_in_crops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many points each of 21 overlapping tiles holds; the tiles are few, so they go to the points."""
    boxes = camera.crop_boxes(spark, 1500, 1000, 2)
    points = T(spark, sf_dir, "part").select((F.col("p_partkey") * 7 % 1500).alias("x"), (F.col("p_partkey") * 13 % 1000).alias("y"))
    inside = (F.col("x") >= F.col("x0")) & (F.col("x") < F.col("x1")) & (F.col("y") >= F.col("y0")) & (F.col("y") < F.col("y1"))
    return points.join(F.broadcast(boxes), inside).groupBy("layer", "x0", "y0", "x1", "y1").agg(F.count("*").alias("n"))


_TURN = "c AS (SELECT vec_id, label, embedding::DOUBLE[] AS e, vec_id * 0.01 AS t FROM embeddings)"
#: About z only harmonics of m and -m mix: place n^2 + n + m, for m from 1 to n.
_PAIRS = [(n * n + n + m, n * n + n - m, m) for n in range(4) for m in range(1, n + 1)]


def _parts() -> str:
    at: dict[int, str] = {n * n + n: f"e[{n * n + n + 1}]" for n in range(4)}
    for plus, minus, m in _PAIRS:
        at[plus] = f"e[{plus + 1}] * cos({m} * t) - e[{minus + 1}] * sin({m} * t)"
        at[minus] = f"e[{plus + 1}] * sin({m} * t) + e[{minus + 1}] * cos({m} * t)"
    return ", ".join(f"round({at[k]}, 6) + 0.0 AS c{k}" for k in range(16))


@query(f"WITH {_TURN} SELECT vec_id, {_parts()} FROM c")
def harmonics_turned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixteen coefficients under a turn about z by an angle of each row's own."""
    ship(spark)
    t = F.col("vec_id") * 0.01
    r = F.array(F.cos(t), -F.sin(t), F.lit(0.0), F.sin(t), F.cos(t), F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0))
    rows = T(spark, sf_dir, "embeddings").select("vec_id", harmonics.rotated(F.transform(F.slice("embedding", 1, 16), lambda x: x.cast("double")), r).alias("c"))
    return rows.select("vec_id", *((F.round(F.col("c")[k], 6) + 0.0).alias(f"c{k}") for k in range(16)))
