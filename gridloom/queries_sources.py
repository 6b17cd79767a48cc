"""Queries over sources and sinks: rows are written to the shared folder in a format and read back by its reader.

The SQL is over the tables that the rows came from, so a query is right if
nothing is lost or changed on the way.  A bounded number of containers (one a
region or nation) is written; the rows in them are whole tables.
"""

from __future__ import annotations

import io
import struct
import tarfile

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom import stand_ins as S
from gridloom.cluster import put_files, scratch, store_of
from gridloom.queries import query
from gridloom.sources import files, glb, packed, ply, sinks, text


def T(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return S.read(spark, sf_dir, name)


def _lines(rows: DataFrame, name: str, *, n: int = 1) -> str:
    """The path of a text file made of the rows' only column, in its order."""
    at = scratch(rows.sparkSession, name)
    sinks.write_lines(rows, at, files=n)
    return at


def _text(spark: SparkSession, name: str, content: str, file: str = "a.txt") -> str:
    at = scratch(spark, name)
    path, store = store_of(spark, f"{at}/{file}")
    out = store.create(path, True)
    out.write(bytearray(content.encode()))
    out.close()
    return f"{at}/{file}"


def _written(rows: DataFrame, name: str) -> str:
    at = scratch(rows.sparkSession, name)
    packed.write_files(rows, at, name="name", content="content")
    return at


POSES = "e AS (SELECT vec_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z, embedding[4]::DOUBLE AS qx, embedding[5]::DOUBLE AS qy, embedding[6]::DOUBLE AS qz, embedding[7]::DOUBLE AS qw FROM embeddings)"


def _poses(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.transform("embedding", lambda x: x.cast("double"))
    return T(spark, sf_dir, "embeddings").select("vec_id", (F.col("vec_id") * 0.5).alias("ts"), *(e[k].alias(c) for k, c in enumerate(("x", "y", "z", "qx", "qy", "qz", "qw"))))


def _half_away(c: str, digits: int = 6):
    """Rounded as a double, half away from 0; ``round`` goes by the shortest decimal, so a number that was rounded before may differ."""
    return (F.signum(c) * F.floor(F.abs(c) * 10.0**digits + 0.5) / 10.0**digits + 0.0).alias(c)


@query(f"WITH {POSES} SELECT vec_id * 0.5::DOUBLE AS ts, " + ", ".join(f"round(round({c}, 9), 6) + 0.0 AS {c}" for c in ("x", "y", "z", "qx", "qy", "qz", "qw")) + " FROM e")
def tum_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = text.tum(spark, _lines(sinks.tum_lines(_poses(spark, sf_dir)), "tum"))
    return got.select("ts", *(_half_away(c) for c in ("x", "y", "z", "qx", "qy", "qz", "qw")))


@query(f"WITH {POSES} SELECT vec_id * 0.5::DOUBLE AS ts, round(round(x, 9), 6) + 0.0 AS x, round(round(y, 9), 6) + 0.0 AS y, round(round(z, 9), 6) + 0.0 AS z FROM e")
def tum_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = sinks.tum_lines(_poses(spark, sf_dir)).unionByName(spark.createDataFrame([("# a comment",), ("1 2",)], "value string"))
    return text.tum_positions(spark, _lines(lines, "tum-positions")).select("ts", *(_half_away(c) for c in "xyz"))


def _matrices(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.transform("embedding", lambda x: x.cast("double"))
    return T(spark, sf_dir, "embeddings").select("vec_id", F.slice(e, 1, 16).alias("pose"))


MATRIX = "SELECT vec_id, embedding[4]::DOUBLE AS x, embedding[8]::DOUBLE AS y, embedding[12]::DOUBLE AS z FROM embeddings"


@query("SELECT " + ", ".join(f"embedding[{k + 1}]::DOUBLE AS m{k}" for k in range(16)) + " FROM embeddings")
def camera_pose_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = text.camera_poses(spark, _lines(sinks.pose_lines(_matrices(spark, sf_dir)), "poses"))
    return got.select(*(F.col("pose")[k].alias(f"m{k}") for k in range(16)))


@query(f"SELECT x, y, z FROM ({MATRIX})")
def tolerant_pose_centres(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = sinks.pose_lines(_matrices(spark, sf_dir)).unionByName(spark.createDataFrame([("1 2 3",), ("a " * 16,)], "value string"))
    return text.pose_centres(text.camera_poses(spark, _lines(lines, "tolerant"), strict=False)).select("x", "y", "z")


@query("SELECT o_orderkey AS image_a, o_custkey AS image_b, round(o_totalprice, 4) AS sim FROM orders")
def loop_pair_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("a"), F.col("o_custkey").alias("b"), F.col("o_totalprice").alias("sim"))
    held = sinks.loop_lines(rows).select(F.split("value", ", ").alias("v")).select(F.col("v")[0].alias("image_index_a"), F.col("v")[1].alias("image_index_b"), F.col("v")[2].alias("sim"))
    at = scratch(spark, "loops")
    held.write.csv(at, header=True)
    return text.loop_pairs(spark, at)


@query("SELECT p_size + 300.0::DOUBLE AS fx, p_size + 301.0::DOUBLE AS fy, 320.5::DOUBLE AS cx, p_partkey::DOUBLE AS cy FROM part")
def intrinsics_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = T(spark, sf_dir, "part").select(F.concat_ws(" ", (F.col("p_size") + 300).cast("string"), (F.col("p_size") + 301).cast("string"), F.lit("320.5"), F.col("p_partkey").cast("string")).alias("value"))
    return text.intrinsics(spark, _lines(lines, "intrinsics")).select("fx", "fy", "cx", "cy")


@query("SELECT concat('floor_1_2025-05-05_run_', s_suppkey) AS run_name, concat('bag_', s_nationkey) AS bag FROM supplier UNION ALL SELECT n_name, NULL FROM nation")
def run_list_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = scratch(spark, "runs")
    T(spark, sf_dir, "supplier").select(F.concat(F.lit("floor_1_2025-05-05_run_"), F.col("s_suppkey").cast("string")).alias("#Sequence Name"), F.concat(F.lit("bag_"), F.col("s_nationkey").cast("string")).alias("bag")).write.csv(at, header=True)
    names = sorted(r["n_name"] for r in T(spark, sf_dir, "nation").collect())  # the 25 nations
    listed = _text(spark, "run-list", '{"runs": [' + ", ".join(f'{{"run_name": "{n}"}}' for n in names) + "]}", "runs.json")
    return text.run_list(spark, at).unionByName(text.run_list(spark, listed))


@query("SELECT concat('run_', n_nationkey) AS run, n_name AS floor_plan, n_regionkey + 0.25::DOUBLE AS ts, n_nationkey::DOUBLE AS x, 1.0::DOUBLE AS qw FROM nation")
def init_pose_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sorted((r["n_nationkey"], r["n_name"], r["n_regionkey"]) for r in T(spark, sf_dir, "nation").collect())
    body = "#run,plan,ts,x,y,z,qx,qy,qz,qw\n" + "".join(f"run_{k},{n},{g - 1},0,0,0,0,0,0,0\n" for k, n, g in rows) + "".join(f"run_{k},{n},{g + 0.25},{k},0,0,0,0,0,1\n" for k, n, g in rows)
    return text.init_poses(spark, _text(spark, "init", body, "init.csv")).select("run", "floor_plan", "ts", "x", "qw")


CAMERAS = "SELECT c_custkey::INTEGER AS camera_id, 'PINHOLE' AS model, 640::BIGINT AS width, 480 + c_nationkey AS height, c_acctbal AS fx FROM customer"


def _cameras(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.array("c_acctbal", F.lit(500.0), F.lit(320.0), F.lit(240.0))
    return T(spark, sf_dir, "customer").select(F.col("c_custkey").cast("int").alias("camera_id"), F.lit("PINHOLE").alias("model"), F.lit(640).cast("long").alias("width"), (F.col("c_nationkey") + 480).cast("long").alias("height"), p.alias("params"))


def _images(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.transform("embedding", lambda x: x.cast("double"))
    point = F.struct(e[9].alias("x"), e[10].alias("y"), (F.col("vec_id") - 1).alias("point3d_id"))
    return T(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("int").alias("image_id"), F.slice(e, 1, 4).alias("q"), F.slice(e, 5, 3).alias("t"), (F.col("vec_id") % 10).cast("int").alias("camera_id"), F.concat(F.lit("a/"), F.col("vec_id").cast("string"), F.lit(".jpg")).alias("name"), F.array_repeat(point, (F.col("vec_id") % 3).cast("int")).alias("points"))


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    track = F.transform(F.sequence(F.lit(1), F.col("p_size") % 4 + 1), lambda k: F.struct(k.alias("image_id"), (k * 2).alias("point2d")))
    c = lambda n, m: (F.col("p_size") % m).cast("short").alias(n)
    return T(spark, sf_dir, "part").select(F.col("p_partkey").alias("point_id"), F.col("p_retailprice").alias("x"), (F.col("p_retailprice") / 2).alias("y"), F.lit(1.5).alias("z"), c("r", 7), c("g", 11), c("b", 13), (F.col("p_size") / 10.0).alias("error"), track.alias("track"))


def _model(spark: SparkSession, sf_dir: str) -> str:
    at = scratch(spark, "model")
    packed.colmap_files(_cameras(spark, sf_dir), _images(spark, sf_dir), _points(spark, sf_dir), at)
    return at


@query(CAMERAS)
def colmap_cameras_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = packed.colmap_cameras_binary(spark, f"{_model(spark, sf_dir)}/cameras.bin")
    return got.select("camera_id", "model", "width", "height", F.col("params")[0].alias("fx"))


@query(
    """
SELECT vec_id::INTEGER AS image_id, embedding[1]::DOUBLE AS qw, embedding[7]::DOUBLE AS tz, (vec_id % 10)::INTEGER AS camera_id, concat('a/', vec_id, '.jpg') AS name, vec_id % 3 AS n_points,
       CASE WHEN vec_id % 3 > 0 THEN embedding[10]::DOUBLE END AS x, CASE WHEN vec_id % 3 > 0 THEN vec_id - 1 END AS point3d_id FROM embeddings
"""
)
def colmap_images_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = packed.colmap_images_binary(spark, f"{_model(spark, sf_dir)}/images.bin")
    first = F.get("points", F.lit(0))
    return got.select("image_id", F.col("q")[0].alias("qw"), F.col("t")[2].alias("tz"), "camera_id", "name", F.size("points").cast("long").alias("n_points"), first["x"].alias("x"), first["point3d_id"].alias("point3d_id"))


@query("SELECT p_partkey AS point_id, p_retailprice AS x, p_retailprice / 2 AS y, (p_size % 7)::SMALLINT AS r, (p_size % 13)::SMALLINT AS b, p_size / 10.0::DOUBLE AS error, (p_size % 4 + 1)::INTEGER AS n_track, ((p_size % 4 + 1) * 2)::INTEGER AS last FROM part")
def colmap_points_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = packed.colmap_points_binary(spark, f"{_model(spark, sf_dir)}/points3D.bin")
    return got.select("point_id", "x", "y", "r", "b", "error", F.size("track").alias("n_track"), F.element_at("track", -1)["point2d"].alias("last"))


@query(CAMERAS)
def colmap_cameras_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _cameras(spark, sf_dir)
    lines = rows.select(F.concat_ws(" ", F.col("camera_id").cast("string"), "model", F.col("width").cast("string"), F.col("height").cast("string"), F.array_join(F.transform("params", lambda x: x.cast("string")), " ")).alias("value"))
    got = text.colmap_cameras(spark, _lines(lines, "cameras"))
    return got.select("camera_id", "model", F.col("width").cast("long").alias("width"), F.col("height").cast("long").alias("height"), F.col("params")[0].alias("fx"))


@query("SELECT p_partkey AS point_id, p_retailprice AS x, (p_size % 4 + 1)::INTEGER AS n_track FROM part")
def colmap_points_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _points(spark, sf_dir)
    track = F.array_join(F.transform("track", lambda p: F.concat_ws(" ", p["image_id"].cast("string"), p["point2d"].cast("string"))), " ")
    lines = rows.select(F.concat_ws(" ", *(F.col(c).cast("string") for c in ("point_id", "x", "y", "z", "r", "g", "b", "error")), track).alias("value"))
    return text.colmap_points(spark, _lines(lines, "points")).select("point_id", "x", F.size("track").alias("n_track"))


@query("SELECT c_custkey::INTEGER AS camera_id, v.vec_id::INTEGER AS image_id, c_acctbal AS fx, 320.0::DOUBLE AS cx, true AS exact FROM embeddings v JOIN customer ON c_custkey = v.vec_id % 10 WHERE v.vec_id % 4 = 0")
def images_with_cameras(spark: SparkSession, sf_dir: str) -> DataFrame:
    there = _images(spark, sf_dir).filter("image_id % 4 = 0").select(F.concat(F.lit("/disk/"), F.element_at(F.split("name", "/"), -1)).alias("name"))
    got = packed.images_with_cameras(_images(spark, sf_dir), _cameras(spark, sf_dir), there)
    return got.select("camera_id", "image_id", "fx", "cx", "exact")


@query("SELECT l_quantity::FLOAT::DOUBLE AS x, l_discount::FLOAT::DOUBLE AS y, l_tax::FLOAT::DOUBLE AS z, (l_linenumber * 30)::SMALLINT AS red FROM lineitem")
def ply_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = T(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("x"), F.col("l_discount").alias("y"), F.col("l_tax").alias("z"), (F.col("l_linenumber") * 30).alias("red"), F.lit(1).alias("green"), F.lit(2).alias("blue"), F.lit("whole").alias("cloud"))
    at = scratch(spark, "cloud")
    ply.write_clouds(points, "cloud", at)
    return ply.read_xyz(spark, at).select("x", "y", "z", "red")


@query(f"WITH p AS ({MATRIX}), r AS (SELECT *, (row_number() OVER (ORDER BY vec_id) - 1) / (count(*) OVER () - 1) AS s FROM p) SELECT vec_id, x, y, z, round(255 * (1 - s))::SMALLINT AS green, round(255 * s)::SMALLINT AS blue FROM r")
def camera_centre_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed.centre_points(_matrices(spark, sf_dir), "vec_id").select("vec_id", "x", "y", "z", "green", "blue")


@query("SELECT c_nationkey AS frame, round(c_acctbal, 2) AS conf, c_custkey * 0.5::DOUBLE AS depth FROM customer")
def npz_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("frame"), "c_custkey", F.col("c_acctbal").alias("conf"), (F.col("c_custkey") * 0.5).alias("depth"))
    at = _written(packed.npz_files(rows, "frame", "c_custkey", {"depth": 6, "conf": 2}), "npz")
    return packed.npz_rows(spark, at, ["depth", "conf"]).select(F.col("frame").cast("int").alias("frame"), "conf", "depth")


@query("SELECT concat('c', c_nationkey) AS name, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS row, c_acctbal AS value FROM customer")
def npy_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T(spark, sf_dir, "customer").select(F.concat(F.lit("c"), F.col("c_nationkey").cast("string")).alias("name"), "c_custkey", "c_acctbal")
    got = packed.npy_rows(spark, _written(packed.npy_files(rows, "name", "c_custkey", "c_acctbal"), "npy"))
    return got.select(F.regexp_extract("path", r"/([^/]+)\.npy$", 1).alias("name"), "row", "value")


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    bag = F.concat(F.lit("bag"), (F.col("user_id") % 5).cast("string"))
    return S.series(spark, sf_dir).select(bag.alias("bag"), F.col("event_type").alias("topic"), F.concat(F.lit("msg/"), "event_type").alias("type"), "ts", F.col("event_id").cast("string").cast("binary").alias("data"))


def _bags(spark: SparkSession, sf_dir: str) -> str:
    return _written(packed.bag_files(_messages(spark, sf_dir), "bag"), "bags")


#: A bag's name in the path of one of its files.
BAG = r"/([^/]+)_\d+\.db3$"


@query("SELECT concat('bag', user_id % 5) AS bag, event_type AS topic, concat('msg/', event_type) AS type, epoch_us(ts) AS ts, event_id::VARCHAR AS data FROM events")
def bag_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = packed.bag_messages(spark, _bags(spark, sf_dir))
    return got.select(F.regexp_extract("path", BAG, 1).alias("bag"), "topic", "type", "ts", F.col("data").cast("string").alias("data"))


@query("SELECT concat('bag', user_id % 5) AS bag, string_agg(DISTINCT concat(event_type, '=msg/', event_type), ',' ORDER BY concat(event_type, '=msg/', event_type)) AS types FROM events GROUP BY 1")
def bag_topic_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = packed.bag_messages(spark, _bags(spark, sf_dir))
    got = packed.topic_types(messages.withColumn("path", F.regexp_extract("path", BAG, 1)))
    each = F.transform(F.map_entries("types"), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return got.select(F.col("path").alias("bag"), F.array_join(F.array_sort(each), ",").alias("types"))


@query("SELECT CASE WHEN event_type = 'view' THEN 'cam' ELSE 'imu' END AS sink, count(*) AS n, min(epoch_us(ts)) AS first FROM events WHERE event_type IN ('view', 'click', 'purchase') AND epoch_us(ts) BETWEEN 1704500000000000 AND 1705500000000000 GROUP BY 1")
def message_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = packed.routed(_messages(spark, sf_dir), {"cam": ["view"], "imu": ["click", "purchase"]}, start=1_704_500_000_000_000, end=1_705_500_000_000_000)
    return got.groupBy("sink").agg(F.count("*").alias("n"), F.min("ts").alias("first"))


@query("SELECT n_regionkey AS parent, 1700000000000 + n_nationkey AS stamp FROM nation WHERE n_regionkey = (SELECT min(n_regionkey) FROM (SELECT n_regionkey FROM nation GROUP BY 1 HAVING count(*) = 5))")
def archive_stamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = io.BytesIO()
    with tarfile.open(fileobj=held, mode="w") as tar:  # the 25 nations
        for r in T(spark, sf_dir, "nation").collect():
            for name in (f"{r['n_regionkey']}/{1700000000000 + r['n_nationkey']}.png", f"{r['n_regionkey']}/notes.txt"):
                tar.addfile(tarfile.TarInfo(name), io.BytesIO(b""))
    at = _written(spark.createDataFrame([("a.tar", bytearray(held.getvalue()))], "name string, content binary"), "tar")
    return packed.stamps_for(packed.archive_stamps(spark, at), 5).select(F.col("parent").cast("int").alias("parent"), "stamp")


@query("SELECT o_orderkey, concat(" + ", ".join(f"(o_custkey >> {k}) & 1" for k in range(15, 3, -1)) + ") AS bits FROM orders")
def packed_mask_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.unhex(F.lpad(F.hex(F.col("o_custkey").bitwiseAND(F.lit(65535))), 4, "0"))
    got = packed.packed_masks(T(spark, sf_dir, "orders").select("o_orderkey", raw.alias("mask")), "mask", 12)
    return got.select("o_orderkey", F.array_join(F.transform("mask", lambda b: b.cast("int").cast("string")), "").alias("bits"))


@query("SELECT n_nationkey, n_nationkey + 0.5::DOUBLE AS e0, 1.0::DOUBLE AS e15, n_regionkey * -1e2::DOUBLE AS k0 FROM nation")
def mvs_camera_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = scratch(spark, "mvs")
    nation = F.col("n_nationkey")
    rest = " 0 0 0\n0 1 0 0\n0 0 1 0\n0 0 0 1\n\nintrinsic\n"
    body = F.concat(F.lit("extrinsic\n"), (nation + 0.5).cast("string"), F.lit(rest), (F.col("n_regionkey") * -100).cast("string"), F.lit("e0 0 1\n0 5 1\n0 0 1\n"))
    rows = T(spark, sf_dir, "nation").select(F.concat(nation.cast("string"), F.lit("_cam.txt")).alias("name"), body.cast("binary").alias("content"))
    packed.write_files(rows, at, name="name", content="content")
    got = packed.mvs_camera(spark, at)
    return got.select(F.regexp_extract("path", r"/(\d+)_cam", 1).cast("int").alias("n_nationkey"), F.col("extrinsic")[0].alias("e0"), F.col("extrinsic")[15].alias("e15"), (F.col("intrinsic")[0] + 0.0).alias("k0"))


@query("SELECT concat('cam', n_nationkey) AS camera, 'intrinsics' AS key, 4::INTEGER AS n, n_regionkey + 100.0::DOUBLE AS first FROM nation UNION ALL SELECT concat('cam', n_nationkey), 'rate', 1, 20.0 FROM nation")
def camera_yaml_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sorted((r["n_nationkey"], r["n_regionkey"]) for r in T(spark, sf_dir, "nation").collect())
    body = "# rig\n" + "".join(f"cam{k}:\n  intrinsics: [{g + 100.0}, 2, 3e0, -4]\n  rate: 20\n" for k, g in rows)
    got = packed.camera_yaml(spark, _text(spark, "yaml", body, "cams.yaml"))
    return got.select("camera", "key", F.size("values").alias("n"), F.col("values")[0].alias("first"))


@query("SELECT n_name AS run, n_regionkey - 1.0::DOUBLE AS z_min, n_regionkey + 1.0::DOUBLE AS z_max, 9::INTEGER AS n, n_nationkey::DOUBLE AS corner FROM nation")
def roi_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sorted((r["n_name"], r["n_regionkey"], r["n_nationkey"]) for r in T(spark, sf_dir, "nation").collect())
    body = '{"_comment": "units are metres", ' + ", ".join(f'"{n}": {{"z_min": {g - 1}, "z_max": {g + 1}, "affine": [[1, 0, {k}], [0, 1, 0], [0, 0, 1]]}}' for n, g, k in rows) + "}"
    got = packed.roi_entries(spark, _text(spark, "roi", body, "roi.json"))
    return got.select("run", "z_min", "z_max", F.size("affine").alias("n"), F.col("affine")[2].alias("corner"))


@query("SELECT n_nationkey AS number, concat('chunk_', n_nationkey, '.bin') AS name, length(n_name) AS size, sha256(n_name) AS digest FROM nation")
def numbered_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lit("chunk_"), F.col("n_nationkey").cast("string"), F.lit(".bin"))
    at = _written(T(spark, sf_dir, "nation").select(name.alias("name"), F.col("n_name").cast("binary").alias("content")), "chunks")
    found = files.numbered(files.listing(spark, at), r"chunk_(\d+)\.bin")
    return found.join(packed.file_digests(spark, at).select("path", "digest"), "path").select(F.col("number").cast("int").alias("number"), "name", "size", "digest")


@query("SELECT row_number() OVER (ORDER BY concat('img_', lpad(n_nationkey::VARCHAR, 3, '0'), '.jpg')) - 1 AS image_index, concat('img_', lpad(n_nationkey::VARCHAR, 3, '0'), '.jpg') AS name, 'images' AS kind FROM nation WHERE n_regionkey < 3")
def image_directory_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    end = F.when(F.col("n_regionkey") < 3, ".jpg").otherwise(".txt")
    name = F.concat(F.lit("img_"), F.lpad(F.col("n_nationkey").cast("string"), 3, "0"), end)
    at = _written(T(spark, sf_dir, "nation").select(name.alias("name"), F.lit(b"x").alias("content")), "images")
    return files.image_directory(spark, at).select("image_index", "name", F.lit(files.kind_of(files.listing(spark, at))).alias("kind"))


@query("SELECT event_id, epoch_us(ts) * 1000 AS ts_ns, value AS gx, -value AS az FROM events")
def imu_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    @F.pandas_udf("binary")
    def packet(ns: pd.Series, v: pd.Series) -> pd.Series:
        rows = []
        for n, x in zip(ns, v, strict=True):
            body = struct.pack("<iII", n // 10**9, n % 10**9, 5) + b"imu0\x00"
            body += b"\x00" * (-len(body) % 8) + struct.pack("<28d", *([0.0] * 13), x, 0.0, 0.0, *([0.0] * 9), 0.0, 0.0, -x)
            rows.append(b"\x00\x01\x00\x00" + body)
        return pd.Series(rows)

    rows = S.series(spark, sf_dir).select("event_id", packet(F.col("ts") * 1000, F.col("value")).alias("data"))
    return ply.decode_imu(rows).select("event_id", F.col("imu.ts_ns").alias("ts_ns"), F.col("imu.gyro")[0].alias("gx"), F.col("imu.accel")[2].alias("az"))


@query("SELECT p_partkey, concat('FFD8FF', hex(encode(p_name))) AS payload FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT p_partkey, NULL FROM part WHERE p_partkey % 2 = 1")
def jpeg_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.hex(F.col("p_name").cast("binary"))
    data = F.unhex(F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("0011FFD8FF"), name)).otherwise(F.concat(F.lit("0011"), name)))
    return T(spark, sf_dir, "part").select("p_partkey", F.hex(ply.jpeg_payload(data)).alias("payload"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_totalprice END AS price, o_orderstatus AS status FROM orders")
def json_lines_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.when(F.col("o_orderkey") % 3 == 0, F.lit(float("nan"))).otherwise(F.col("o_totalprice"))
    at = _lines(sinks.json_lines(T(spark, sf_dir, "orders").select("o_orderkey", price.alias("price"), F.col("o_orderstatus").alias("status"))), "jsonl", n=4)
    return spark.read.schema("o_orderkey long, price double, status string").json(at)


@query("SELECT event_type, round(avg(value), 6) AS \"stats.mean\", max(value) AS \"stats.top.max\" FROM events GROUP BY event_type")
def metrics_flattened(spark: SparkSession, sf_dir: str) -> DataFrame:
    nested = S.series(spark, sf_dir).groupBy("event_type").agg(F.avg("value").alias("mean"), F.max("value").alias("max"))
    row = F.struct("event_type", F.struct(F.round("mean", 6).alias("mean"), F.struct("max").alias("top")).alias("stats"))
    return sinks.flat_metrics(nested.select(row.alias("r")), "r")


@query(
    """
SELECT count(*)::BIGINT AS n, count(*) * 62 * 4::BIGINT AS n_bytes, round(sum(embedding[1]::DOUBLE), 3) AS x, round(sum(embedding[3]::DOUBLE), 3) AS z FROM embeddings"""
)
def splat_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All splats of the table, and the sums of two of their coordinates as the packed bytes have them."""
    e = F.transform("embedding", lambda x: x.cast("double"))
    size = F.transform(F.slice(e, 4, 3), lambda x: F.abs(x) + 0.1)
    rows = T(spark, sf_dir, "embeddings").select(F.slice(e, 1, 3).alias("mean"), size.alias("scale"), F.slice(e, 7, 4).alias("rotation"), e[11].alias("opacity"), F.slice(e, 1, 48).alias("harmonics"))

    def read(frames):
        for f in frames:
            for n, content in zip(f["n"], f["content"], strict=True):
                v = np.frombuffer(content, "<f4").reshape(n, 62).astype(float)
                yield pd.DataFrame({"n": [n], "n_bytes": [len(content)], "x": [v[:, 0].sum()], "z": [v[:, 2].sum()]})

    parts = packed.gaussian_ply(rows, 3).mapInPandas(read, "n long, n_bytes long, x double, z double")
    return parts.agg(F.sum("n").alias("n"), F.sum("n_bytes").alias("n_bytes"), F.round(F.sum("x"), 3).alias("x"), F.round(F.sum("z"), 3).alias("z"))


@query("SELECT l_quantity::FLOAT::DOUBLE AS x, l_discount::FLOAT::DOUBLE AS y, (-l_tax)::FLOAT::DOUBLE AS z, (l_linenumber * 30)::SMALLINT AS red, 1::SMALLINT AS green FROM lineitem")
def glb_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = T(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("x"), F.col("l_discount").alias("y"), (-F.col("l_tax")).alias("z"), (F.col("l_linenumber") * 30).alias("red"), F.lit(1).alias("green"), F.lit(2).alias("blue"))
    at = scratch(spark, "scene")
    glb.write_scenes(points, at)
    return glb.read(spark, at).select("x", "y", "z", "red", "green")


@query(
    """
WITH s AS (SELECT s_suppkey AS k, (s_suppkey % 3 = 0) AS pre, (s_suppkey % 4 <> 1) AS fin, (s_suppkey % 5 = 0) AS outcome, s_acctbal > 0 AS accepted, 1 + s_suppkey % 3 AS n FROM supplier)
SELECT concat('floor_', k % 4, '/2025-05-05/run_', k) AS run, n AS n_chunks, CASE WHEN pre THEN 'before_loops' WHEN fin AND NOT outcome AND NOT accepted THEN 'final_without_loops' END AS kind,
       concat_ws(';', CASE WHEN NOT (pre OR (fin AND NOT outcome AND NOT accepted)) THEN 'no admissible poses' END, CASE WHEN k % 7 = 0 THEN 'chunks are not contiguous' END) AS problem FROM s
"""
)
def frozen_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run a supplier: its files are there or not by its key, its loops were accepted by its balance."""
    at, k = scratch(spark, "frozen"), F.col("s_suppkey")
    work = F.concat_ws("/", F.concat(F.lit("floor_"), k % 4), F.lit("2025-05-05"), F.concat(F.lit("run_"), k), F.lit("_work/a"))
    x, file = F.lit("x"), lambda name, content: F.struct(F.concat(work, F.lit("/"), name).alias("name"), content.alias("content"))
    chunk = lambda i: file(F.concat(F.lit(f"{files.CACHE}/chunk_"), i + (k % 7 == 0).cast("int"), F.lit(".npy")), x)
    report = F.concat(F.lit("chunk_a,accepted\n0,False\n1,"), F.when(F.col("s_acctbal") > 0, "True").otherwise("False"), F.lit("\n"))
    some = [F.when(there, file(F.lit(name), x)) for name, there in ((files.BEFORE_LOOPS, k % 3 == 0), (files.FINAL, k % 4 != 1), (files.OUTCOME, k % 5 == 0))]
    made = F.array_compact(F.concat(F.transform(F.sequence(F.lit(0), (k % 3).cast("int")), chunk), F.array(file(F.lit(files.LOOPS), report), *some)))
    rows = T(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal").repartition(4 * spark.sparkContext.defaultParallelism, "s_suppkey")
    put_files(rows.select(F.inline(made)), at)
    return files.frozen_runs(spark, at).select("run", "n_chunks", "kind", "problem")
