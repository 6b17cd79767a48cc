"""Directory scans through Spark's own listing: names, sizes and times, without reading contents; empty files are not listed."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator
from fnmatch import fnmatchcase

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.cluster import by_arrow, held, qualified, ship, store_of
from gridloom.operators.numbering import numbered as in_order

IMAGES = r"(?i)\.(?:jpe?g|png)$"


def listing(spark: SparkSession, path: str, *, pattern: str = "", recursive: bool = False) -> DataFrame:
    """(path, name, size, modified) of the files whose name matches."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    rows = files.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    return rows.filter(F.col("name").rlike(pattern)) if pattern else rows


def image_directory(spark: SparkSession, path: str) -> DataFrame:
    """(image_index, path, name): images in path order; an empty directory is an error."""
    rows = listing(spark, path, pattern=IMAGES)
    if rows.isEmpty():
        raise FileNotFoundError(f"no images in {path}")
    return in_order(rows.select("path", "name"), ["path"], "image_index").select("image_index", "path", "name")


def numbered(rows: DataFrame, pattern: str) -> DataFrame:
    """Files with the number in their name; it must be unique and run from 0 without a gap."""
    got = rows.withColumn("number", F.regexp_extract("name", pattern, 1).cast("long")).filter("number is not null")
    n, distinct, low, high = got.agg(F.count("*"), F.count_distinct("number"), F.min("number"), F.max("number")).first()
    if n and (n != distinct or low != 0 or high != n - 1):
        raise ValueError(f"{n} files numbered {low} to {high}: not contiguous from 0")
    return got


def runs(spark: SparkSession, root: str, wanted: str) -> DataFrame:
    """(run, path): ``floor_*/<date>/run_*/**/<wanted>`` under the root, in path order of the runs."""
    rows = listing(spark, root, recursive=True)
    run = F.regexp_extract("path", r"(floor_[^/]+/[^/]+/run_[^/]+)/", 1)
    return rows.filter((F.col("name") == wanted) & (run != "")).select(run.alias("run"), "path").orderBy("run")


#: Names in a run's work folder, fixed values of the layout.
CACHE, BEFORE_LOOPS, FINAL, OUTCOME, LOOPS = "_tmp_results_unaligned", "camera_poses_pre_loop.txt", "camera_poses.txt", "sim3_optimizer_outcome.json", "loop_geometry_verification.csv"


def _layout(spark: SparkSession, root: str, work: str) -> DataFrame:
    """(path, name, report) of the files of all runs that ``frozen_runs`` looks at, with the text of a report of loops.

    The driver sees the folders of dates; tasks list the runs in them and then
    what is in each run, where Arrow's interface knows the store.  Elsewhere
    Spark globs them on the driver.
    """
    root = qualified(spark, root)
    if by_arrow(root) is None or set(work) & set("{}\\^!"):  # what only Hadoop's globs know
        names = ",".join((f"{CACHE}/chunk_*.npy", BEFORE_LOOPS, FINAL, OUTCOME, LOOPS))
        found = listing(spark, f"{root}/floor_*/*/run_*/{work}/{{{names}}}").select("path", "name")
        if found.filter(F.col("name") == LOOPS).isEmpty():
            return found.withColumn("report", F.lit(None).cast("string"))
        texts = spark.read.format("binaryFile").load(f"{root}/floor_*/*/run_*/{work}/{LOOPS}").select("path", F.decode("content", "utf-8").alias("report"))
        return found.join(texts, "path", "left")
    ship(spark)
    folder, store = store_of(spark, f"{root}/floor_*/*")
    dates = [s.getPath().toString() for s in (store.globStatus(folder) or []) if s.isDirectory()]
    many = 4 * spark.sparkContext.defaultParallelism

    def inside(path: str) -> list:
        """(the child's path, its information) of what is in a folder, by name."""
        store, at = by_arrow(path)
        return sorted((f"{path}/{f.base_name}", f) for f in store.get_file_info(fs.FileSelector(at, allow_not_found=True)))

    def runs_of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for date in frame["path"]:
                yield pd.DataFrame({"path": [p for p, f in inside(date) if f.type == fs.FileType.Directory and f.base_name.startswith("run_")]}, dtype=object)

    def files_of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for run in frame["path"]:
                folders = [run]
                for step in work.split("/"):
                    folders = [p for at in folders for p, f in inside(at) if f.type == fs.FileType.Directory and fnmatchcase(f.base_name, step)]
                for at in folders:
                    chunks = [(p, f) for p, f in inside(f"{at}/{CACHE}") if fnmatchcase(f.base_name, "chunk_*.npy")]
                    for p, f in [(p, f) for p, f in inside(at) if f.base_name in (BEFORE_LOOPS, FINAL, OUTCOME, LOOPS)] + chunks:
                        if f.type == fs.FileType.File and f.size:
                            rows.append((p, f.base_name, _text_of(p) if f.base_name == LOOPS else None))
            yield pd.DataFrame(rows, columns=["path", "name", "report"])

    found = spark.createDataFrame([(d,) for d in dates], "path string").repartition(many, "path").mapInPandas(runs_of, "path string")
    return found.repartition(many).mapInPandas(files_of, "path string, name string, report string")


def _text_of(path: str) -> str:
    store, at = by_arrow(path)
    with store.open_input_stream(at, compression=None) as f:
        return f.read().decode()


def _rejected(report: str) -> bool | None:
    """Whether all rows of a report of loops were rejected; None if it has no rows."""
    rows = list(csv.DictReader(io.StringIO(report)))
    if rows and "accepted" not in rows[0]:
        raise ValueError(f"{LOOPS} has no column accepted")
    return all((r["accepted"] or "").strip().lower() == "false" for r in rows) if rows else None


def frozen_runs(spark: SparkSession, root: str, *, work: str = "_work/*") -> DataFrame:
    """(run, work, n_chunks, poses, kind, problem) of every run with a cache of unaligned chunks.

    A run is ``floor_*/<date>/run_*`` under the root, and ``work`` a pattern for
    its work folder; Spark's own listing would pass over folders whose name
    begins with an underscore, so tasks list them.  Empty files are not there.

    The admissible poses are those from before the loops; else the final ones,
    but only if a report of loops is there, all its rows were rejected and no
    optimisation took place.  ``problem`` says what is wrong: no admissible
    poses, or chunks that are not numbered from 0 without gap or repetition.
    """
    judged = F.pandas_udf(lambda texts: texts.map(lambda t: None if t is None else _rejected(t)), "boolean")
    run = F.regexp_extract("path", r"(floor_[^/]+/[^/]+/run_[^/]+)/", 1)
    rows = held(_layout(spark, root, work).withColumns({"run": run, "folder": F.regexp_extract("path", r"^(.*)/[^/]*$", 1), "rejected": judged("report")}).drop("report").filter("run <> ''"), "frozen-listing")
    chunk = F.regexp_extract("name", r"^chunk_(.*)\.npy$", 1)
    cached = rows.filter(F.col("folder").endswith(f"/{CACHE}") & F.col("name").rlike(r"^chunk_.*\.npy$")).select("run", F.regexp_extract("folder", rf"^(.*)/{CACHE}$", 1).alias("work"), F.when(chunk.rlike(r"^\d+$"), chunk.cast("long")).alias("number"))
    chunks = cached.groupBy("run", "work").agg(F.count("*").alias("n_chunks"), ((F.count_distinct("number") == F.count("*")) & (F.min("number") == 0) & (F.max("number") == F.count("*") - 1)).alias("whole"))
    has = lambda name: F.bool_or(F.col("name") == name).alias(name.split(".")[0])
    there = rows.groupBy(F.col("folder").alias("work")).agg(*(has(x) for x in (BEFORE_LOOPS, FINAL, OUTCOME, LOOPS)))
    none = rows.filter(F.col("name") == LOOPS).select(F.col("folder").alias("work"), "rejected")
    short = lambda c: F.regexp_replace(c, "^file:/+", "/")
    one = chunks.withColumn("k", short("work")).join(there.select(short("work").alias("k"), *(x.split(".")[0] for x in (BEFORE_LOOPS, FINAL, OUTCOME))), "k", "left").join(none.select(short("work").alias("k"), "rejected"), "k", "left")
    yes = lambda x: F.coalesce(F.col(x.split(".")[0]), F.lit(False))
    kind = F.when(yes(BEFORE_LOOPS), "before_loops").when(yes(FINAL) & ~yes(OUTCOME) & F.coalesce("rejected", F.lit(False)), "final_without_loops")
    poses = F.when(kind == "before_loops", F.concat("work", F.lit(f"/{BEFORE_LOOPS}"))).when(kind.isNotNull(), F.concat("work", F.lit(f"/{FINAL}")))
    problem = F.concat_ws(";", F.when(kind.isNull(), "no admissible poses"), F.when(~F.coalesce("whole", F.lit(False)), "chunks are not contiguous"))
    return one.select("run", "work", "n_chunks", poses.alias("poses"), kind.alias("kind"), problem.alias("problem"))


def kind_of(rows: DataFrame) -> str:
    """``image``, ``images``, ``video`` or ``colmap`` by what a directory holds."""
    count = lambda p: F.count_if(F.col("name").rlike(p))
    images, videos, models = rows.agg(count(IMAGES), count(r"(?i)\.(?:mp4|mov|avi|mkv)$"), count(r"^(?:cameras|images)\.(?:txt|bin)$")).first()
    if models >= 2:
        return "colmap"
    if videos:
        return "video"
    if not images:
        raise ValueError("nothing that can be read")
    return "image" if images == 1 else "images"
