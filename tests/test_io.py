from __future__ import annotations

import json
import struct

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from gridloom.operators import asof
from gridloom.sources import ply, sinks, text
from gridloom.streaming import live


def put(path, content):
    path.write_text(content)
    return str(path)


def test_tum_round_trip(spark, tmp_path):
    at = put(tmp_path / "a.txt", "# c\n1.0 1 2 3 0 0 0 1\n\n2.0 1 2\n3.5 4 5 6 0 0 1 0\n")
    rows = text.tum(spark, at).orderBy("ts")
    assert [(r["ts"], r["x"], r["qw"]) for r in rows.collect()] == [(1.0, 1.0, 1.0), (3.5, 4.0, 0.0)]
    assert text.tum_positions(spark, at).count() == 2
    sinks.write_lines(sinks.tum_lines(rows), str(tmp_path / "out"))
    assert text.tum(spark, str(tmp_path / "out")).drop("path", "line").exceptAll(rows.drop("path", "line")).count() == 0


def test_camera_poses(spark, tmp_path):
    good, bad = " ".join(map(str, range(16))), "1 2 3"
    at = put(tmp_path / "p.txt", f"{good}\n{bad}\n{good}\n")
    tolerant = text.camera_poses(spark, at, strict=False)
    assert [tuple(r)[1:] for r in text.pose_centres(tolerant).orderBy("line").collect()] == [(0, 3.0, 7.0, 11.0), (2, 3.0, 7.0, 11.0)]
    with pytest.raises(PySparkException):
        text.camera_poses(spark, at).collect()
    assert sinks.pose_lines(tolerant).first()["value"].split()[5] == "5.0"


def test_lists_and_colmap(spark, tmp_path):
    j = put(tmp_path / "r.json", json.dumps({"runs": [{"run_name": "floor_1_2025-05-05_run_1", "bag": "x.db3"}]}))
    c = put(tmp_path / "r.csv", "#Sequence Name\nfloor_2_2025-05-06_run_2\n")
    assert text.run_list(spark, j).first()["bag"] == "x.db3"
    assert text.run_list(spark, c).first()["run_name"] == "floor_2_2025-05-06_run_2"
    i = put(tmp_path / "i.csv", "#h\nr1,p,1,0,0,0,0,0,0,1\nr1,q,2,9,0,0,0,0,0,1\n")
    assert tuple(text.init_poses(spark, i).first())[:4] == ("r1", "q", 2.0, 9.0)
    pairs = put(tmp_path / "l.csv", "image_index_a,image_index_b\n3,1\n4,2\n")
    assert [tuple(r) for r in text.loop_pairs(spark, pairs, head=1).collect()] == [(3, 1, None)]
    cams = put(tmp_path / "cameras.txt", "# c\n1 PINHOLE 640 480 500 501 320 240\n")
    assert text.colmap_cameras(spark, cams).first()["params"] == [500.0, 501.0, 320.0, 240.0]
    images = put(tmp_path / "images.txt", "# a\n# b\n1 1 0 0 0 1 2 3 1 a.jpg\n10 20 -1\n2 1 0 0 0 4 5 6 1 b.jpg\n\n")
    assert [(r["name"], r["t"]) for r in text.colmap_images(spark, images).orderBy("image_id").collect()] == [("a.jpg", [1.0, 2.0, 3.0]), ("b.jpg", [4.0, 5.0, 6.0])]
    points = put(tmp_path / "points.txt", "7 1 2 3 10 20 30 0.5 1 4 2 5\n8 1 2 3 10 20 30 0.5\n")
    assert [len(r["track"]) for r in text.colmap_points(spark, points).orderBy("point_id").collect()] == [2, 0]


def test_ply_round_trip(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = [(float(np.float32(a)), float(np.float32(b)), float(np.float32(c)), k % 256, 2, 3) for k, (a, b, c) in enumerate(rng.normal(size=(500, 3)))]
    points = spark.createDataFrame(rows, "x double, y double, z double, red int, green int, blue int").repartition(3)
    at = f"file://{tmp_path}/c.ply"
    assert ply.write(points, at) == 500
    back = ply.read_xyz(spark, at)
    assert sorted((r["x"], r["y"], r["z"], r["red"]) for r in back.collect()) == sorted((a, b, c, r) for a, b, c, r, _, _ in rows)
    with pytest.raises(ValueError):
        ply.parse_header((tmp_path / "c.ply").read_bytes()[:-1])
    with pytest.raises(ValueError):
        ply.parse_header(b"ply\nformat ascii 1.0\nelement vertex 0\nend_header\n")


def test_clouds_of_any_size_are_folders_that_no_driver_writes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ply, "PART", 100)
    rows = spark.range(1000).select(*((F.col("id") * k / 7).cast("float").cast("double").alias(c) for k, c in enumerate("xyz", 1)), *((F.col("id") % m).cast("int").alias(c) for m, c in ((256, "red"), (11, "green"), (10, "blue"))), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("side"))
    monkeypatch.setattr(type(rows), "toLocalIterator", lambda *_: pytest.fail("rows taken by the driver"))
    at = f"{tmp_path}/clouds"
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        ply.write_clouds(rows.filter("red < 0").unionByName(rows.repartition(4)), "side", f"file://{at}")
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    files = list((tmp_path / "clouds").glob("side=*/part-*"))
    assert len(files) > 10 and all(ply.parse_header(f.read_bytes())[1] <= 100 for f in files)
    back = ply.read_xyz(spark, f"file://{at}").select(F.regexp_extract("path", r"/side=([^/]+)/", 1).alias("side"), *"xyz", "red", "green", "blue")
    assert back.exceptAll(rows.select(*back.columns)).count() == 0 and back.count() == 1000
    with pytest.raises(ValueError):
        ply.parse_header(files[0].read_bytes() + b"\n")


def test_packets(spark):
    name = b"imu\0"
    head = struct.pack("<iII", 12, 34, len(name)) + name
    body = head + b"\0" * (-len(head) % 8) + struct.pack("<37d", *range(37))
    got = ply.decode_imu(spark.createDataFrame([(bytearray(b"\0\1\0\0" + body),)], "data binary")).select("imu.*").first()
    assert (got["ts_ns"], got["gyro"], got["accel"]) == (12_000_000_034, [13.0, 14.0, 15.0], [25.0, 26.0, 27.0])
    images = spark.createDataFrame([(bytearray(b"xx\xff\xd8\xffabc"),), (bytearray(b"none"),)], "data binary")
    assert [r[0] for r in images.select(ply.jpeg_payload(F.col("data"))).collect()] == [b"\xff\xd8\xffabc", None]


def test_reports(spark):
    row = spark.sql("select struct(1 as a, struct(2.5D as c, array(1) as l) as b) as m, double('NaN') as v")
    assert sinks.flat_metrics(row, "m").columns == ["a", "b.c"]
    assert json.loads(sinks.json_lines(row).first()["value"]).get("v") is None


def stream(spark, rows, at, batches=3):
    """A file stream of a table in a few batches, in order of its rows."""
    data = rows.orderBy("ts", "event_id").collect()
    for k in range(batches):
        part = data[k * len(data) // batches : (k + 1) * len(data) // batches]
        spark.createDataFrame(part, rows.schema).coalesce(1).write.parquet(f"{at}/{k}")
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(f"{at}/*")


def test_streamed_smoothing_is_the_batch_one(spark, tmp_path):
    rows = spark.createDataFrame([(k % 3, 1_000_000 * k + 7 * (k % 5), k, float((k * 37) % 11)) for k in range(60)], "user_id long, ts long, event_id long, value double")
    got = live.smooth(stream(spark, rows, tmp_path / "s"), ["user_id"], ts="ts", order="event_id", value="value", tau=5.0)
    q = got.writeStream.format("memory").queryName("smoothed").option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = {r["event_id"]: r["smooth"] for r in asof.ema(rows, ["user_id"], ts="ts", order="event_id", value="value", tau=5.0).collect()}
    have = {r["event_id"]: r["smooth"] for r in spark.table("smoothed").collect()}
    assert have.keys() == want.keys() and all(abs(have[k] - want[k]) < 1e-9 for k in want)


def test_streamed_pairs_and_log(spark, tmp_path):
    rows = spark.range(40).select(F.timestamp_seconds(1_700_000_000 + F.col("id") * 10).alias("ts"), F.col("id").alias("event_id"), F.lit(1).alias("topic"))
    source = stream(spark, rows, tmp_path / "e")
    other = source.filter("event_id % 2 = 0").select("ts", (F.col("event_id") * 100).alias("value"))
    pairs = live.exact_pairs(source, other, [], ts="ts", late="1 minute")
    q = pairs.writeStream.format("memory").queryName("pairs").option("checkpointLocation", str(tmp_path / "c1")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r["event_id"], r["r_value"]) for r in spark.table("pairs").collect()) == [(k, 100 * k) for k in range(0, 40, 2)]
    for _ in range(2):  # a restart adds nothing
        live.log_events(source, str(tmp_path / "log"), str(tmp_path / "c2")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "log")).count() == 40
