"""Shared-folder tables and reading helpers for the corpus operators."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

from gridloom import cluster
from gridloom.cluster import shared_dir

__all__ = ["free_name", "materialise", "read", "release", "remember", "shared_dir", "ship", "written"]

#: Tables in the shared folder that this process has yet to delete.
_written: list[tuple[SparkSession, str]] = []


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables; the path may be any that Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialise(df: DataFrame, name: str, *, small: bool = False) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage on storage that every executor sees, so a lost executor
    costs a re-read and not a recomputation.  ``release`` deletes the files
    that a result does not read; the others go when the interpreter ends.
    ``small``: a table much smaller than what it was made from is written by an
    eighth of the shuffle partitions (8 at least), as files cost more than rows
    there.
    """
    spark = df.sparkSession
    if small:
        df = df.coalesce(max(8, int(spark.conf.get("spark.sql.shuffle.partitions")) // 8))
    path = f"{shared_dir(spark)}/gridloom-tables/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    remember(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def remember(spark: SparkSession, path: str) -> None:
    """Delete the path when the interpreter ends, if nobody has before."""
    if not _written:
        atexit.register(_clean)
    _written.append((spark, path))


def written() -> int:
    """A mark for ``release``: how many tables there are now."""
    return len(_written)


def release(out: DataFrame | None, mark: int) -> DataFrame | None:
    """Delete the tables written since the mark that ``out`` does not read; gives ``out`` back."""
    held = {part for file in (out.inputFiles() if out is not None else ()) if "/gridloom-tables/" in file for part in file.split("/")}
    kept = []
    for spark, path in _written[mark:]:
        if path.rsplit("/", 1)[1] in held:
            kept.append((spark, path))
        else:
            cluster.delete(spark, path)
    _written[mark:] = kept
    return out


def _clean() -> None:
    for spark, path in _written:
        try:
            cluster.delete(spark, path)
        except Exception:  # the session is gone already
            return


def free_name(df: DataFrame, want: str) -> str:
    """``want``, or a variation of it that clashes with no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    name, n = want, 0
    while name.lower() in taken:
        n += 1
        name = f"{want}_{n}"
    return name


#: Bounds of a batch sent to Python, set where the session leaves Spark's defaults: texts may be long.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "2000"), "spark.sql.execution.arrow.maxBytesPerBatch": (None, "8388608")}


def ship(spark: SparkSession) -> None:
    """Send the package along with the tasks, and bound the batches of rows that go to Python.

    The bounds are session settings; one that the caller has set is left alone.
    """
    for key, (usual, bound) in BATCHES.items():
        if usual is None or spark.conf.get(key, usual) == usual:
            spark.conf.set(key, bound)
    cluster.ship(spark)
