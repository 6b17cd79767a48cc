"""Binary glTF: a cloud of coloured points in one container, or of any size in a folder of them.

The layout is a 12-byte header, a JSON chunk and one binary chunk with all
positions (three floats a point) and then all colours (four bytes a point);
chunks are padded to four bytes.  Every offset follows from the number of
points and the box around them, which is one aggregation.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.cluster import held, put_files, ship, store_of

#: Fixed values of the format: marks of the file and its two chunks, component types, buffer target, mode of points.
MAGIC, VERSION, JSON_CHUNK, BINARY_CHUNK = 0x46546C67, 2, 0x4E4F534A, 0x004E4942
FLOAT, UNSIGNED_BYTE, ARRAY_BUFFER, POINTS = 5126, 5121, 34962, 0
#: Points that are decoded together.
SLICE = 1_000_000
#: Points of a file of a folder of them.
PART = 250_000


def head(n: int, low: list[float], high: list[float]) -> bytes:
    """Everything before the positions."""
    document: dict = {"asset": {"version": "2.0"}, "scene": 0, "scenes": [{"nodes": []}]}
    if n:
        document |= {
            "scenes": [{"nodes": [0]}], "nodes": [{"mesh": 0}], "meshes": [{"primitives": [{"attributes": {"POSITION": 0, "COLOR_0": 1}, "mode": POINTS}]}],
            "buffers": [{"byteLength": 16 * n}],
            "bufferViews": [{"buffer": 0, "byteOffset": 0, "byteLength": 12 * n, "target": ARRAY_BUFFER}, {"buffer": 0, "byteOffset": 12 * n, "byteLength": 4 * n, "target": ARRAY_BUFFER}],
            "accessors": [
                {"bufferView": 0, "componentType": FLOAT, "count": n, "type": "VEC3", "min": low, "max": high},
                {"bufferView": 1, "componentType": UNSIGNED_BYTE, "normalized": True, "count": n, "type": "VEC4"},
            ],
        }
    text = json.dumps(document, separators=(",", ":")).encode()
    text += b" " * (-len(text) % 4)
    total = 12 + 8 + len(text) + (8 + 16 * n if n else 0)
    return struct.pack("<IIIII", MAGIC, VERSION, total, len(text), JSON_CHUNK) + text + (struct.pack("<II", 16 * n, BINARY_CHUNK) if n else b"")


def _packed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        if len(f):
            colour = np.full((len(f), 4), 255, np.uint8)
            colour[:, :3] = f[["red", "green", "blue"]].to_numpy(np.uint8)
            yield pd.DataFrame({"part": f["part"].iloc[:1], "positions": [f[["x", "y", "z"]].to_numpy("<f4").tobytes()], "colours": [colour.tobytes()]})


def _whole(frame: pd.DataFrame) -> bytes:
    """A file of the points."""
    xyz, colour = frame[["x", "y", "z"]].to_numpy("<f4"), np.full((len(frame), 4), 255, np.uint8)
    colour[:, :3] = frame[["red", "green", "blue"]].to_numpy(np.uint8)
    low, high = (f(xyz, axis=0).astype(float).tolist() for f in (np.min, np.max))
    return head(len(frame), low, high) + xyz.tobytes() + colour.tobytes()


def _there(points: DataFrame) -> DataFrame:
    """The points that are written, as the file has them."""
    good = points
    for c in "xyz":
        good = good.filter(F.col(c).isNotNull() & ~F.isnan(F.col(c)) & (F.abs(F.col(c)) < float("inf")))
    return good.select(*(F.col(c).cast("float").alias(c) for c in "xyz"), *(F.coalesce(F.col(c), F.lit(0)).cast("short").alias(c) for c in ("red", "green", "blue")))


def write_scenes(points: DataFrame, path: str) -> int:
    """A folder of files of at most ``PART`` points, each whole by itself and written by the tasks; how many files.

    For clouds of any size: one file ends at four gigabytes, and Spark's binary
    reader, which ``read`` goes by, at two.  Points as in ``write``.
    """
    ship(points.sparkSession)

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, made, waiting, size = TaskContext.get().partitionId(), 0, [], 0
        for frame in frames:
            while len(frame):
                waiting.append(frame[: PART - size])
                size, frame = size + len(waiting[-1]), frame[PART - size :]
                if size == PART:
                    yield pd.DataFrame({"name": [f"{task}-{made}.glb"], "content": [_whole(pd.concat(waiting))]})
                    made, waiting, size = made + 1, [], 0
        if waiting:
            yield pd.DataFrame({"name": [f"{task}-{made}.glb"], "content": [_whole(pd.concat(waiting))]})

    n = put_files(_there(points).mapInPandas(pack, "name string, content binary"), path)
    return n or put_files(points.sparkSession.createDataFrame([("0-0.glb", bytearray(head(0, [], [])))], "name string, content binary"), path)


def write(points: DataFrame, path: str) -> int:
    """One file of the points (x, y, z, red, green, blue; rows with a null or non-finite coordinate are left out); how many there are.

    Partitions are packed side by side into a table; their pieces are then
    appended in order, one at a time, and the file is renamed when it is whole.
    """
    spark = points.sparkSession
    ship(spark)
    rows = held(_there(points).withColumn("part", F.monotonically_increasing_id()), "glb-points")
    box = rows.agg(F.count("*").alias("n"), *(f(c).cast("double").alias(f"{f.__name__}_{c}") for c in "xyz" for f in (F.min, F.max))).first()
    pieces = held(rows.mapInPandas(_packed, "part long, positions binary, colours binary"), "glb-pieces")
    at, store = store_of(spark, path)
    aside, _ = store_of(spark, f"{path}.part")
    out = store.create(aside, True)
    try:
        out.write(bytearray(head(box["n"], [box[f"min_{c}"] for c in "xyz"], [box[f"max_{c}"] for c in "xyz"])))
        for column in ("positions", "colours"):
            for r in pieces.orderBy("part").select(column).toLocalIterator():
                out.write(bytearray(r[0]))
    finally:
        out.close()
    store.delete(at, False)
    if not store.rename(aside, at):
        raise OSError(f"{path} could not be published")
    return box["n"]


def _points_of(data: bytes) -> Iterator[pd.DataFrame]:
    """The points in slices, straight from the bytes."""
    magic, version, total, size, kind = struct.unpack_from("<IIIII", data)
    if magic != MAGIC or version != VERSION or kind != JSON_CHUNK or total != len(data):
        raise ValueError("no whole binary glTF")
    document, begin = json.loads(data[20 : 20 + size]), 28 + size
    if "meshes" not in document:
        return
    views = {}
    for name, at in document["meshes"][0]["primitives"][0]["attributes"].items():
        accessor = document["accessors"][at]
        view = document["bufferViews"][accessor["bufferView"]]
        kind = np.dtype({FLOAT: "<f4", UNSIGNED_BYTE: np.uint8}[accessor["componentType"]])
        views[name] = np.frombuffer(data, kind, view["byteLength"] // kind.itemsize, begin + view["byteOffset"]).reshape(accessor["count"], -1)
    for at in range(0, len(views["POSITION"]), SLICE):
        xyz, rgb = (views[name][at : at + SLICE] for name in ("POSITION", "COLOR_0"))
        yield pd.DataFrame({**{c: xyz[:, k].astype(float) for k, c in enumerate("xyz")}, **{c: rgb[:, k].astype(np.int16) for k, c in enumerate(("red", "green", "blue"))}})


def read(spark: SparkSession, path: str) -> DataFrame:
    """(path, x, y, z, red, green, blue) of the files under a path; a broken one is an error that names it."""
    ship(spark)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for name, data in zip(f["path"], f["content"], strict=True):
                try:
                    for got in _points_of(data):
                        got.insert(0, "path", name)
                        yield got
                except (ValueError, KeyError, struct.error) as e:
                    raise ValueError(f"{name}: {e}") from e

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, "path string, x double, y double, z double, red short, green short, blue short")
