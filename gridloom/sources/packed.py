"""Binary containers read through Spark's binary reader and decoded in the workers' memory: arrays, bags, archives, camera models.

One file is one row, as a file is what its format lets be read alone; what
comes out are rows.  A file that breaks its format is an error that names it.
"""

from __future__ import annotations

import io
import sqlite3
import struct
import tarfile
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.cluster import joined, put_files, ship
from gridloom.operators.numbering import numbered

#: Camera models of the binary format by their number, with how many parameters each has.
CAMERA_MODELS = {
    0: ("SIMPLE_PINHOLE", 3), 1: ("PINHOLE", 4), 2: ("SIMPLE_RADIAL", 4), 3: ("RADIAL", 5), 4: ("OPENCV", 8), 5: ("OPENCV_FISHEYE", 8),
    6: ("FULL_OPENCV", 12), 7: ("FOV", 5), 8: ("SIMPLE_RADIAL_FISHEYE", 4), 9: ("RADIAL_FISHEYE", 5), 10: ("THIN_PRISM_FISHEYE", 12),
}


def _decoded(spark: SparkSession, path: str, decode: Callable[[bytes], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    """The rows (path and ``schema``) that ``decode`` makes of every file under the path."""
    ship(spark)
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, data in zip(frame["path"], frame["content"], strict=True):
                try:
                    for out in decode(data):
                        out.insert(0, "path", name)
                        yield out
                except (ValueError, struct.error, KeyError, sqlite3.DatabaseError, tarfile.TarError) as e:
                    raise ValueError(f"{name}: {e}") from e

    return files.mapInPandas(run, f"path string, {schema}")


def write_files(rows: DataFrame, root: str, *, name: str, content: str) -> int:
    """One file a row under the root, written aside and published by a rename; how many there are."""
    return put_files(rows.select(F.col(name).alias("name"), F.col(content).alias("content")), root)


# Arrays.


def npz_rows(spark: SparkSession, path: str, fields: list[str]) -> DataFrame:
    """(path, frame, row, the fields): arrays of ``frame_<n>.npz`` files, element by element; all fields must be of one size."""

    def decode(data: bytes) -> Iterator[pd.DataFrame]:
        with np.load(io.BytesIO(data), allow_pickle=False) as held:
            flat = {f: np.asarray(held[f], dtype=np.float64).ravel() for f in fields}
        if len({len(v) for v in flat.values()}) != 1:
            raise ValueError("fields of different sizes")
        yield pd.DataFrame({"row": np.arange(len(flat[fields[0]]))} | flat)

    got = _decoded(spark, path, decode, "row long, " + ", ".join(f"`{f}` double" for f in fields))
    return got.withColumn("frame", F.regexp_extract("path", r"frame_(\d+)\.npz$", 1).try_cast("long"))


def npy_rows(spark: SparkSession, path: str) -> DataFrame:
    """(path, row, value) of ``.npy`` files, element by element."""

    def decode(data: bytes) -> Iterator[pd.DataFrame]:
        flat = np.asarray(np.load(io.BytesIO(data), allow_pickle=False), dtype=np.float64).ravel()
        yield pd.DataFrame({"row": np.arange(len(flat)), "value": flat})

    return _decoded(spark, path, decode, "row long, value double")


def npz_files(rows: DataFrame, frame: str, order: str, fields: dict[str, int | None]) -> DataFrame:
    """(name, content): ``frame_<n>.npz`` of each frame's rows in order; a number beside a field rounds it to so many digits."""
    ship(rows.sparkSession)

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        held = io.BytesIO()
        values = {f: pdf[f].to_numpy(np.float64) for f in fields}
        np.savez(held, **{f: v if fields[f] is None else np.round(v, fields[f]) for f, v in values.items()})
        return pd.DataFrame([{"name": f"frame_{int(pdf[frame].iloc[0])}.npz", "content": held.getvalue()}])

    return rows.groupBy(frame).applyInPandas(pack, "name string, content binary")


def npy_files(rows: DataFrame, name: str, order: str, value: str) -> DataFrame:
    """(name, content): ``<name>.npy`` of each group's values in order."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        held = io.BytesIO()
        np.save(held, pdf.sort_values(order)[value].to_numpy(np.float64))
        return pd.DataFrame([{"name": f"{pdf[name].iloc[0]}.npy", "content": held.getvalue()}])

    return rows.groupBy(name).applyInPandas(pack, "name string, content binary")


def packed_masks(rows: DataFrame, column: str, n: int) -> DataFrame:
    """The rows with ``column`` (bits packed eight to a byte, the highest first) as an array of n booleans; too few bytes give null."""
    hexed = F.hex(column)
    byte = lambda k: F.conv(F.substr(hexed, (2 * k + 1).cast("int"), F.lit(2)), 16, 10).cast("int")
    bit = lambda i: byte(F.floor(i / 8)).bitwiseAND(F.pow(F.lit(2.0), (7 - i % 8)).cast("int")) > 0
    unpacked = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), bit)
    return rows.withColumn(column, F.when(F.octet_length(column) * 8 >= n, unpacked))


# Bags and archives.

#: Messages of a file of a bag.
MESSAGES = 200_000


def bag_messages(spark: SparkSession, path: str, topics: list[str] | None = None) -> DataFrame:
    """(path, topic, type, ts, data): the messages of SQLite bags in time order; an unknown topic is an error."""

    def decode(data: bytes) -> Iterator[pd.DataFrame]:
        with sqlite3.connect(":memory:") as db:
            db.deserialize(bytes(data))
            known = {name: (i, kind) for i, name, kind in db.execute("SELECT id, name, type FROM topics")}
            wanted = sorted(known) if topics is None else topics
            if lacking := [t for t in wanted if t not in known]:
                raise ValueError(f"no topic {', '.join(lacking)}")
            for t in wanted:
                found = db.execute("SELECT timestamp, data FROM messages WHERE topic_id = ? ORDER BY timestamp, id", (known[t][0],))
                while rows := found.fetchmany(2000):
                    yield pd.DataFrame({"topic": t, "type": known[t][1], "ts": [r[0] for r in rows], "data": [r[1] for r in rows]})

    return _decoded(spark, path, decode, "topic string, type string, ts long, data binary")


def topic_types(messages: DataFrame) -> DataFrame:
    """(path, types): a map from topic to message type for every bag."""
    return messages.groupBy("path").agg(F.map_from_entries(F.sort_array(F.collect_set(F.struct("topic", "type")))).alias("types"))


def bag_files(messages: DataFrame, name: str) -> DataFrame:
    """(name, content): SQLite bags of each group's (topic, type, ts, data) rows, cut in the order of time into files ``<group>_<number>.db3`` of at most ``MESSAGES``; numbers ascend with gaps."""
    ship(messages.sparkSession)
    kinds = dict(messages.dtypes)
    for c, kind in (("ts", "bigint"), ("data", "binary")):
        if kinds[c] != kind:
            raise ValueError(f"{c} is not of type {kind}")

    def pack(pdf: pd.DataFrame) -> bytes:
        if pdf["ts"].isna().any():
            raise ValueError("a message without a stamp")
        with sqlite3.connect(":memory:") as db:
            db.execute("CREATE TABLE topics (id INTEGER PRIMARY KEY, name TEXT, type TEXT)")
            db.execute("CREATE TABLE messages (id INTEGER PRIMARY KEY, topic_id INTEGER, timestamp INTEGER, data BLOB)")
            topics = pdf.drop_duplicates("topic").set_index("topic")["type"]
            ids = {t: k for k, t in enumerate(sorted(topics.index), 1)}
            db.executemany("INSERT INTO topics VALUES (?, ?, ?)", [(k, t, topics[t]) for t, k in ids.items()])
            db.executemany("INSERT INTO messages (topic_id, timestamp, data) VALUES (?, ?, ?)", zip(pdf["topic"].map(ids).tolist(), pdf["ts"].tolist(), pdf["data"].tolist(), strict=True))
            db.commit()
            return db.serialize()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, made, group, waiting = TaskContext.get().partitionId(), 0, None, []

        def file() -> pd.DataFrame:
            return pd.DataFrame({"name": [f"{group}_{task * 1_000_000 + made}.db3"], "content": [pack(pd.concat(waiting))]})

        for frame in frames:
            for value, rows in frame.groupby("group", sort=False):
                while len(rows):
                    room = MESSAGES - sum(map(len, waiting))
                    if waiting and (value != group or room <= 0):
                        yield file()
                        made, waiting, room = made + 1, [], MESSAGES
                    group, waiting, rows = value, [*waiting, rows[:room]], rows[room:]
        if waiting:
            yield file()

    rows = messages.select(F.coalesce(F.col(name).cast("string"), F.lit("None")).alias("group"), "topic", "type", "ts", "data")
    ordered = rows.repartitionByRange("group", "ts", "topic", "data").sortWithinPartitions("group", "ts")
    return ordered.mapInPandas(run, "name string, content binary")


def routed(messages: DataFrame, routes: dict[str, list[str]], *, start: int | None = None, end: int | None = None) -> DataFrame:
    """The messages with ``sink``, the name of the route that has their topic; others, and those outside the time bounds (included), are left out."""
    sink = F.coalesce(*(F.when(F.col("topic").isin(topics), n) for n, topics in routes.items()))
    out = messages.withColumn("sink", sink).filter("sink is not null")
    if start is not None:
        out = out.filter(F.col("ts") >= start)
    return out if end is None else out.filter(F.col("ts") <= end)


def archive_stamps(spark: SparkSession, path: str) -> DataFrame:
    """(path, parent, stamp, name): the members of tar archives whose name holds a stamp of ten digits or more; contents are not unpacked."""

    def decode(data: bytes) -> Iterator[pd.DataFrame]:
        with tarfile.open(fileobj=io.BytesIO(data)) as held:
            yield pd.DataFrame({"member": [m.name for m in held.getmembers() if m.isfile()]}, dtype="object")

    got = _decoded(spark, path, decode, "member string")
    parent, name = F.regexp_extract("member", r"^(.*)/[^/]*$", 1), F.element_at(F.split("member", "/"), -1)
    return got.select("path", parent.alias("parent"), F.nullif(F.regexp_extract(name, r"(\d{10,})", 1), F.lit("")).cast("long").alias("stamp"), name.alias("name")).filter("stamp is not null")


def stamps_for(stamps: DataFrame, n_poses: int) -> DataFrame:
    """The stamps of the one parent whose rows, or else distinct stamps, are as many as the poses; of several the first by name.  Empty if none fits."""
    sizes = stamps.groupBy("path", "parent").agg(F.count("*").alias("n"), F.count_distinct("stamp").alias("d"))
    fit = sizes.withColumn("rank", F.when(F.col("n") == n_poses, 0).when(F.col("d") == n_poses, 1)).filter("rank is not null")
    best = fit.groupBy("path").agg(F.min(F.struct("rank", "parent")).alias("b")).select("path", F.col("b.parent").alias("parent"))
    return stamps.join(best, ["path", "parent"]).select("path", "parent", "stamp").distinct()


# Camera models.


def colmap_cameras_binary(spark: SparkSession, path: str) -> DataFrame:
    """(path, camera_id, model, width, height, params) of a binary cameras file."""

    def decode(data: bytes) -> Iterator[pd.DataFrame]:
        n, at, rows = struct.unpack_from("<Q", data)[0], 8, []
        columns = ["camera_id", "model", "width", "height", "params"]
        for _ in range(n):
            camera, model, width, height = struct.unpack_from("<iiQQ", data, at)
            name, many = CAMERA_MODELS[model]
            rows.append((camera, name, width, height, list(struct.unpack_from(f"<{many}d", data, at + 24))))
            at += 24 + 8 * many
            if len(rows) == 2000:
                yield pd.DataFrame(rows, columns=columns)
                rows = []
        yield pd.DataFrame(rows, columns=columns)

    return _decoded(spark, path, decode, "camera_id int, model string, width long, height long, params array<double>")


def colmap_images_binary(spark: SparkSession, path: str) -> DataFrame:
    """(path, image_id, q, t, camera_id, name, points) of a binary images file; points of (x, y, point3d_id), -1 for none."""

    def decode(data: bytes) -> Iterator[pd.DataFrame]:
        n, at = struct.unpack_from("<Q", data)[0], 8
        kind, rows = np.dtype([("x", "<f8"), ("y", "<f8"), ("point3d_id", "<i8")]), []
        for _ in range(n):
            image, *pose, camera = struct.unpack_from("<i7di", data, at)
            end = data.index(b"\x00", at + 64)
            many = struct.unpack_from("<Q", data, end + 1)[0]
            points = np.frombuffer(data, kind, many, end + 9)
            rows.append((image, pose[:4], pose[4:], camera, data[at + 64 : end].decode(), [{"x": float(x), "y": float(y), "point3d_id": int(p)} for x, y, p in points]))
            at = end + 9 + many * kind.itemsize
            if len(rows) == 200:
                yield pd.DataFrame(rows, columns=["image_id", "q", "t", "camera_id", "name", "points"])
                rows = []
        yield pd.DataFrame(rows, columns=["image_id", "q", "t", "camera_id", "name", "points"])

    return _decoded(spark, path, decode, "image_id int, q array<double>, t array<double>, camera_id int, name string, points array<struct<x:double,y:double,point3d_id:long>>")


def colmap_points_binary(spark: SparkSession, path: str) -> DataFrame:
    """(path, point_id, x, y, z, r, g, b, error, track) of a binary points file; track of (image_id, point2d)."""

    def decode(data: bytes) -> Iterator[pd.DataFrame]:
        n, at, rows = struct.unpack_from("<Q", data)[0], 8, []
        columns = ["point_id", "x", "y", "z", "r", "g", "b", "error", "track"]
        for _ in range(n):
            *head, many = struct.unpack_from("<QdddBBBdQ", data, at)
            track = struct.unpack_from(f"<{2 * many}i", data, at + 51)
            rows.append((*head, [{"image_id": track[k], "point2d": track[k + 1]} for k in range(0, 2 * many, 2)]))
            at += 51 + 8 * many
            if len(rows) == 2000:
                yield pd.DataFrame(rows, columns=columns)
                rows = []
        yield pd.DataFrame(rows, columns=columns)

    return _decoded(spark, path, decode, "point_id long, x double, y double, z double, r short, g short, b short, error double, track array<struct<image_id:int,point2d:int>>")


#: Bytes of packed rows that a task gathers before it hands them on.
PIECE = 8 << 20


def colmap_files(cameras: DataFrame, images: DataFrame, points: DataFrame, root: str) -> None:
    """The three binary files of a model under the root, each in the order of its ids: rows are packed where they lie, range by range of the ids."""
    number = {name: k for k, (name, _) in CAMERA_MODELS.items()}
    spot, step = np.dtype([("x", "<f8"), ("y", "<f8"), ("p", "<i8")]), "<i4"

    def camera(r) -> bytes:
        return struct.pack("<iiQQ", r.camera_id, number[r.model], r.width, r.height) + np.asarray(r.params, "<f8").tobytes()

    def image(r) -> bytes:
        seen = np.array([(p["x"], p["y"], p["point3d_id"]) for p in r.points], spot)
        return struct.pack("<i7di", r.image_id, *r.q, *r.t, r.camera_id) + r.name.encode() + b"\x00" + struct.pack("<Q", len(seen)) + seen.tobytes()

    def point(r) -> bytes:
        track = np.array([(p["image_id"], p["point2d"]) for p in r.track], step).reshape(-1, 2)
        return struct.pack("<QdddBBBdQ", r.point_id, r.x, r.y, r.z, r.r, r.g, r.b, r.error, len(track)) + track.tobytes()

    def packer(pack: Callable[..., bytes]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            waiting, size = [], 0
            for frame in frames:
                for r in frame.itertuples():
                    waiting.append(pack(r))
                    size += len(waiting[-1])
                    if size >= PIECE:
                        yield pd.DataFrame({"content": [b"".join(waiting)]})
                        waiting, size = [], 0
            if waiting:
                yield pd.DataFrame({"content": [b"".join(waiting)]})

        return run

    ship(cameras.sparkSession)
    for name, rows, key, pack in (("cameras.bin", cameras, "camera_id", camera), ("images.bin", images, "image_id", image), ("points3D.bin", points, "point_id", point)):
        ordered = rows.repartitionByRange(key).sortWithinPartitions(key)
        joined(ordered.mapInPandas(packer(pack), "content binary"), f"{root}/{name}", head=struct.pack("<Q", rows.count()))


def model_format(names: list[str]) -> str | None:
    """``bin`` or ``txt`` by which whole set of three files is there (binary first); None if neither is."""
    for end in ("bin", "txt"):
        if {f"cameras.{end}", f"images.{end}", f"points3D.{end}"} <= set(names):
            return end
    return None


def images_with_cameras(images: DataFrame, cameras: DataFrame, files: DataFrame) -> DataFrame:
    """Images whose file (by base name) is there, with intrinsics (fx, fy, cx, cy) of their camera.

    One-focal models use it for both axes, and distortion is left out, so other
    models than pinholes are approximations (``exact`` is false).
    """
    one = F.col("model").isin("SIMPLE_PINHOLE", "SIMPLE_RADIAL", "RADIAL", "SIMPLE_RADIAL_FISHEYE", "RADIAL_FISHEYE")
    p, at = F.col("params"), lambda a, b: F.when(one, F.col("params")[a]).otherwise(F.col("params")[b])
    k = cameras.select("camera_id", p[0].alias("fx"), at(0, 1).alias("fy"), at(1, 2).alias("cx"), at(2, 3).alias("cy"), F.col("model").isin("SIMPLE_PINHOLE", "PINHOLE").alias("exact"))
    base = lambda c: F.element_at(F.split(c, "/"), -1)
    there = files.select(base(F.col("name")).alias("__base")).distinct()
    return images.withColumn("__base", base(F.col("name"))).join(there, "__base", "left_semi").join(k, "camera_id").drop("__base")


# Small text formats.


def mvs_camera(spark: SparkSession, path: str) -> DataFrame:
    """(path, extrinsic of 16, intrinsic of 9) of files with an ``extrinsic`` and an ``intrinsic`` block."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    number = r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?"

    def block(name: str, n: int) -> Column:
        found = F.regexp_extract_all(F.regexp_extract("value", rf"(?s){name}\s+((?:{number}\s+){{{n - 1}}}{number})", 1), F.lit(number), F.lit(0))
        return F.when(F.size(found) == n, F.transform(found, lambda x: x.cast("double"))).otherwise(F.raise_error(F.concat(F.lit(f"no {name} in "), F.col("path"))).cast("array<double>"))

    return whole.select("path", block("extrinsic", 16).alias("extrinsic"), block("intrinsic", 9).alias("intrinsic"))


def camera_yaml(spark: SparkSession, path: str) -> DataFrame:
    """(path, camera, key, values): ``key: [numbers]`` and ``key: number`` lines under a camera's name, which begins its line."""
    lines = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.posexplode(F.split("value", "\r?\n")).alias("line", "value")).filter((F.trim("value") != "") & ~F.ltrim("value").startswith("#"))
    w = Window.partitionBy("path").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    named = lines.withColumn("camera", F.last(F.nullif(F.regexp_extract("value", r"^(\w+):\s*$", 1), F.lit("")), True).over(w))
    key, rest = F.regexp_extract("value", r"^\s+(\w+):\s*(.+)$", 1), F.regexp_extract("value", r"^\s+(\w+):\s*(.+)$", 2)
    values = F.filter(F.transform(F.split(F.regexp_replace(rest, r"[\[\]]", ""), ","), lambda x: F.trim(x).try_cast("double")), lambda x: x.isNotNull())
    return named.select("path", "camera", key.alias("key"), values.alias("values")).filter((F.col("key") != "") & F.col("camera").isNotNull())


def roi_entries(spark: SparkSession, path: str) -> DataFrame:
    """(run, z_min, z_max, affine of 9): entries of a JSON object keyed by run; keys that begin with an underscore are left out."""
    entry = "struct<z_min:double,z_max:double,affine:array<array<double>>>"
    held = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,string>").alias("m"))
    each = held.select(F.explode(F.map_filter("m", lambda k, _: ~k.startswith("_"))).alias("run", "e")).select("run", F.from_json("e", entry).alias("e"))
    return each.select("run", "e.z_min", "e.z_max", F.flatten("e.affine").alias("affine"))


def gaussian_ply(splats: DataFrame, degree: int) -> DataFrame:
    """(n, content): packed rows of a splat file for every batch: position, normal (0), colour coefficients, opacity, scales (log), rotation.

    ``splats`` has mean, scale, rotation, opacity and harmonics (3 x (degree + 1)^2 numbers, by colour).
    """
    many = (degree + 1) ** 2
    names = splat_columns(degree)

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            v = np.zeros((len(f), len(names)), "<f4")
            h = np.array(f["harmonics"].to_list(), float).reshape(len(f), 3, many)
            v[:, :3] = np.array(f["mean"].to_list())
            v[:, 6:9] = h[:, :, 0]
            v[:, 9 : 9 + 3 * (many - 1)] = h[:, :, 1:].reshape(len(f), -1)
            at = 9 + 3 * (many - 1)
            v[:, at] = f["opacity"]
            v[:, at + 1 : at + 4] = np.log(np.array(f["scale"].to_list()))
            v[:, at + 4 :] = np.array(f["rotation"].to_list())
            yield pd.DataFrame({"n": [len(f)], "content": [v.tobytes()]})

    return splats.select("mean", "scale", "rotation", "opacity", "harmonics").mapInPandas(pack, "n long, content binary")


def splat_columns(degree: int) -> list[str]:
    """The property names of a splat file, as many as the degree needs."""
    rest = 3 * ((degree + 1) ** 2 - 1)
    return ["x", "y", "z", "nx", "ny", "nz", *(f"f_dc_{k}" for k in range(3)), *(f"f_rest_{k}" for k in range(rest)), "opacity", *(f"scale_{k}" for k in range(3)), *(f"rot_{k}" for k in range(4))]


def centre_points(poses: DataFrame, order: str, pose: str = "pose") -> DataFrame:
    """(order, x, y, z, red, green, blue): the centres of sixteen-number poses, green at the first, blue at the last."""
    whole = numbered(poses.filter(F.size(pose) == 16).select(order, pose), [order], "__place")
    share = F.col("__place") / max(whole.count() - 1, 1)
    at = whole.select(order, *(F.col(pose)[k].alias(c) for k, c in ((3, "x"), (7, "y"), (11, "z"))), share.alias("s"))
    return at.select(order, "x", "y", "z", F.lit(0).cast("short").alias("red"), F.round(255 * (1 - F.col("s"))).cast("short").alias("green"), F.round(255 * F.col("s")).cast("short").alias("blue"))


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, size, digest): the SHA-256 of every file's bytes, hashed where they are read."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("digest"))
