"""What a cluster needs to know: the folder that all machines share, and this package on the workers."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
import zipfile
from collections.abc import Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from itertools import islice
from pathlib import Path

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_shipped: set[str] = set()
#: Paths in the shared folder that go when the interpreter ends.
_scratch: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, else one set up for this session (local tests only)."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at is None:
        hadoop = spark.sparkContext._jsc.sc().getCheckpointDir()
        if hadoop.isEmpty():
            if not spark.sparkContext.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
            at = f"file://{tempfile.mkdtemp(prefix='gridloom-')}"
            spark.sparkContext.setCheckpointDir(at)
        else:
            at = hadoop.get()
    return at.rstrip("/")


def scratch(spark: SparkSession, name: str, *, keep: bool = False) -> str:
    """A new path in the shared folder; what is written there goes when the interpreter ends, unless it is to be kept."""
    path = f"{shared_dir(spark)}/gridloom-scratch/{name}-{uuid.uuid4().hex}"
    if not keep:
        if not _scratch:
            atexit.register(_clean)
        _scratch.append((spark, path))
    return path


def _clean() -> None:
    for spark, path in _scratch:
        try:
            delete(spark, path)
        except Exception:  # the session is gone already
            return


def held(df: DataFrame, name: str) -> DataFrame:
    """The rows written once to the shared folder and read back: for what several steps read, or a step that is repeated."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def held_for(df: DataFrame, name: str) -> Iterator[DataFrame]:
    """``held``, for as long as the block lasts: for the rounds of a loop, whose rows would pile up."""
    path = f"{shared_dir(df.sparkSession)}/gridloom-scratch/{name}-{uuid.uuid4().hex}"
    try:
        df.write.parquet(path)
        yield df.sparkSession.read.schema(df.schema).parquet(path)
    finally:
        delete(df.sparkSession, path)


def store_of(spark: SparkSession, path: str):
    """(the path, its file system) for Hadoop's interface."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def write_small(spark: SparkSession, files: Iterable[tuple[str, bytes]], *, at_once: int = 32) -> None:
    """A file a pair (path, content), ``at_once`` of them side by side; pairs are taken as they are written."""

    def put(pair: tuple[str, bytes]) -> None:
        path, store = store_of(spark, pair[0])
        out = store.create(path, True)
        try:
            out.write(bytearray(pair[1]))
        finally:
            out.close()

    with ThreadPoolExecutor(at_once) as pool:
        todo = iter(files)
        while part := list(islice(todo, 64 * at_once)):
            list(pool.map(put, part))


def by_arrow(path: str):
    """(file system, path in it) of a qualified path for Arrow's interface, which tasks have too; None for a store that only Hadoop's knows."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    try:
        return fs.FileSystem.from_uri(path)
    except (OSError, ValueError, NotImplementedError):
        return None


def qualified(spark: SparkSession, path: str) -> str:
    at, store = store_of(spark, path)
    return store.makeQualified(at).toString()


def put(path: str, content: bytes) -> None:
    """One file by Arrow's interface, written aside and published by a rename, so that tasks may be repeated."""
    store, at = by_arrow(path)
    folder, _, name = at.rpartition("/")
    store.create_dir(folder, recursive=True)
    aside = f"{folder}/_{name}.{uuid.uuid4().hex}.part"
    with store.open_output_stream(aside, compression=None) as out:
        out.write(content)
    store.move(aside, at)
    checksum = f"{folder}/.{name}.crc"  # of a former file, by Hadoop's interface
    if path.startswith("file:") and store.get_file_info(checksum).is_file:
        store.delete_file(checksum)


def put_files(rows: DataFrame, root: str) -> int:
    """A file a row (name, content) under the root, by the tasks; how many there are.  Where only Hadoop's interface knows the store, the driver writes them, a row at a time."""
    spark = rows.sparkSession
    root, n = qualified(spark, root), 0
    if by_arrow(root) is None:
        for row in rows.select("name", "content").toLocalIterator():
            at, store = store_of(spark, f"{root}/{row['name']}")
            aside, _ = store_of(spark, f"{at.getParent()}/_{at.getName()}.part")
            out = store.create(aside, True)
            try:
                out.write(bytearray(row["content"]))
            finally:
                out.close()
            store.delete(at, False)
            if not store.rename(aside, at):
                raise OSError(f"{row['name']} could not be published")
            n += 1
        return n
    ship(spark)

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, content in zip(frame["name"], frame["content"], strict=True):
                put(f"{root}/{name}", content)
            yield pd.DataFrame({"n": [len(frame)]})

    return rows.select("name", F.col("content").cast("binary").alias("content")).mapInPandas(write, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def joined(pieces: DataFrame, path: str, *, head: bytes = b"") -> None:
    """One file of ``head`` and the bytes in the pieces' ``content``, in the order of partitions and rows.

    Tasks write the pieces by Spark's text writer, a file each.  As one file has
    one writer, the store's interface then copies them to its end by the buffer,
    but for the line end of each; no task's result holds them.  The file is
    written aside and renamed when it is whole.
    """
    spark = pieces.sparkSession
    parts = scratch(spark, "pieces")
    pieces.select(F.col("content").cast("string").alias("value")).write.option("maxRecordsPerFile", 1).option("lineSep", "\n").option("compression", "none").text(parts)
    folder, source = store_of(spark, parts)
    found = []
    for s in source.listStatus(folder):
        if (m := re.match(r"part-(\d+)-.*-c(\d+)\D*$", s.getPath().getName())) and s.getLen():
            found.append((int(m[1]), int(m[2]), s.getPath(), s.getLen() - 1))
    copy = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.copyLarge
    at, store = store_of(spark, path)
    aside, _ = store_of(spark, str(at.getParent().suffix(f"/_{at.getName()}.part")))
    out = store.create(aside, True)
    try:
        out.write(bytearray(head))
        for *_, part, n in sorted(found, key=lambda f: f[:2]):
            piece = source.open(part)
            try:
                if copy(piece, out, 0, n) != n:
                    raise OSError(f"{part} has lost bytes")
            finally:
                piece.close()
    finally:
        out.close()
    delete(spark, parts)
    store.delete(at, False)
    if not store.rename(aside, at):
        raise OSError(f"{path} could not be published")


def delete(spark: SparkSession, path: str) -> None:
    at, store = store_of(spark, path)
    store.delete(at, True)


def ship(spark: SparkSession) -> None:
    """Send this whole package along with the tasks, once a session: executors need not have it installed."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parent
    to = Path(tempfile.mkdtemp(prefix="gridloom-")) / "gridloom.zip"
    with zipfile.ZipFile(to, "w") as packed:
        for file in sorted(package.rglob("*.py")):
            packed.write(file, file.relative_to(package.parent))
    context.addPyFile(str(to))
    _shipped.add(context.applicationId)
