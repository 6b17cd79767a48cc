from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from gridloom.functions import camera
from gridloom.operators import asof
from gridloom.sources import files, packed


def test_listing_and_kinds(spark, tmp_path):
    for name in ("b.JPG", "a.png", "notes.txt"):
        (tmp_path / name).write_bytes(b"x")
    got = files.image_directory(spark, str(tmp_path)).collect()
    assert [(r["image_index"], r["name"]) for r in got] == [(0, "a.png"), (1, "b.JPG")]
    assert files.kind_of(files.listing(spark, str(tmp_path))) == "images"
    empty = tmp_path / "none"
    empty.mkdir()
    (empty / "x.txt").write_text("")
    with pytest.raises(FileNotFoundError):
        files.image_directory(spark, str(empty))
    with pytest.raises(ValueError):
        files.kind_of(files.listing(spark, str(empty)))


def test_numbered_chunks_and_runs(spark, tmp_path):
    for k in (0, 1, 2):
        (tmp_path / f"chunk_{k}.npy").write_bytes(b"x")
    assert files.numbered(files.listing(spark, str(tmp_path)), r"chunk_(\d+)\.npy").count() == 3
    (tmp_path / "chunk_4.npy").write_bytes(b"x")
    with pytest.raises(ValueError):
        files.numbered(files.listing(spark, str(tmp_path)), r"chunk_(\d+)\.npy")
    for run in ("floor_2/2025-05-06/run_1", "floor_1/2025-05-05/run_1"):
        at = tmp_path / "root" / run / "reconstruction"
        at.mkdir(parents=True)
        (at / "poses.txt").write_text("x")
    got = [r["run"] for r in files.runs(spark, str(tmp_path / "root"), "poses.txt").collect()]
    assert got == ["floor_1/2025-05-05/run_1", "floor_2/2025-05-06/run_1"]


def test_cameras(spark):
    k = F.struct(*(F.lit(float(v)).alias(n) for n, v in (("fx", 300), ("fy", 300), ("cx", 320), ("cy", 240), ("k1", 0.1), ("k2", 0.0), ("k3", 0.0), ("k4", 0.0))))
    ray = F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(1.0).alias("z"))
    row = spark.range(1).select(camera.fisheye_pixel(ray, k).alias("p"), camera.pinhole_ray(F.lit(320.0), F.lit(240.0), k).alias("r"), camera.blend_weights(F.lit(3.0), F.lit(1.0)).alias("w"), camera.blend_weights(F.lit(-1.0), F.lit(0.0)).alias("n")).first()
    assert tuple(row["p"]) == (320.0, 240.0) and tuple(row["r"]) == (0.0, 0.0, 1.0)
    assert tuple(row["w"]) == (0.75, 0.25) and tuple(row["n"]) == (0.0, 0.0)
    assert camera.crop_boxes(spark, 1500, 1000, 2).groupBy("layer").count().orderBy("layer").collect()[2][1] == 16


def test_slot_sync_can_differ_from_two_cursors(spark):
    rows = spark.createDataFrame([("s", t, k, a) for k, (t, a) in enumerate([(0, "a"), (3, "a"), (4, "b"), (20, "b")])], "run string, ts long, n long, topic string")
    options = {"ts": "ts", "order": "n", "topic": "topic", "first": "a", "second": "b", "tolerance": 5}
    assert [(r["a"], r["b"]) for r in asof.slot_sync(rows, ["run"], **options).collect()] == [(1, 2)]
    assert [(r["a"], r["b"]) for r in asof.greedy_sync(rows, ["run"], **options).collect()] == [(0, 2)]


def test_model_files_are_packed_where_the_rows_lie(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(packed, "PIECE", 300)
    k = F.col("id")
    cameras = spark.range(100, -1, -1, 5).select(k.cast("int").alias("camera_id"), F.lit("PINHOLE").alias("model"), (k + 640).alias("width"), (k * 10).alias("height"), F.array(k + 0.5, k + 10.0, F.lit(2.0), F.lit(3.0)).alias("params"))
    point = F.struct((k + 0.5).alias("x"), (k * 2.0).alias("y"), (k - 10).alias("point3d_id"))
    images = spark.range(40).select(k.cast("int").alias("image_id"), F.array(*(k + n / 4 for n in range(4))).alias("q"), F.array(*(k - n / 4 for n in range(3))).alias("t"), (k % 7).cast("int").alias("camera_id"), F.concat(F.lit("\u00fc\n"), k.cast("string")).alias("name"), F.array_repeat(point, (k % 3).cast("int")).alias("points"))
    track = F.transform(F.sequence(F.lit(1), k % 4), lambda j: F.struct(j.cast("int").alias("image_id"), (j + k).cast("int").alias("point2d")))
    points = spark.range(200).repartition(7).select(k.alias("point_id"), *((k * n / 3).alias(c) for n, c in enumerate("xyz", 1)), *((k % n).cast("short").alias(c) for n, c in ((256, "r"), (11, "g"), (10, "b"))), (k / 10).alias("error"), track.alias("track"))
    monkeypatch.setattr(type(cameras), "toLocalIterator", lambda *_: pytest.fail("rows taken by the driver"))
    at = f"file://{tmp_path}/model"
    packed.colmap_files(cameras, images, points, at)
    for file, read, want, key in (("cameras", packed.colmap_cameras_binary, cameras, "camera_id"), ("images", packed.colmap_images_binary, images, "image_id"), ("points3D", packed.colmap_points_binary, points, "point_id")):
        got = read(spark, f"{at}/{file}.bin").drop("path").collect()
        assert [r[key] for r in got] == sorted(r[key] for r in got)
        assert [tuple(r) for r in got] == [tuple(r) for r in want.orderBy(key).collect()]
    packed.colmap_files(cameras.limit(0), images, points, at)
    assert packed.colmap_cameras_binary(spark, f"{at}/cameras.bin").collect() == []
    assert sorted(f.name for f in (tmp_path / "model").iterdir() if f.suffix != ".crc") == ["cameras.bin", "images.bin", "points3D.bin"]
