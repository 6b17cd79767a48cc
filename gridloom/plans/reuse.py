"""Content-addressed stages: a stage's table is reused if its request and its output's signature still hold."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def canonical(value: object) -> str:
    """JSON with sorted keys and no spaces; NaN and infinities are null."""

    def safe(x: object) -> object:
        if isinstance(x, dict):
            return {str(k): safe(v) for k, v in x.items()}
        if isinstance(x, (list, tuple)):
            return [safe(v) for v in x]
        if isinstance(x, float) and (x != x or x in (float("inf"), float("-inf"))):
            return None
        return x

    return json.dumps(safe(value), sort_keys=True, separators=(",", ":"))


def digest(value: object) -> str:
    return hashlib.sha256(canonical(value).encode()).hexdigest()


def merge(base: dict, over: dict) -> dict:
    """Recursive update; neither argument is changed."""
    out = dict(base)
    for k, v in over.items():
        out[k] = merge(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def signature(df: DataFrame) -> str:
    """Of a table's rows whatever their order: count and sums of row hashes, as one aggregation."""
    rows = df.select(F.sha2(F.to_json(F.struct(*(F.col(f"`{c}`") for c in df.columns))), 256).alias("h"))
    part = lambda k: F.sum(F.conv(F.substring("h", 1 + 15 * k, 15), 16, 10).cast("decimal(20,0)")).cast("string")
    row = rows.agg(F.count("*").alias("n"), *(part(k).alias(f"s{k}") for k in range(4))).first()
    return digest([df.schema.jsonValue(), *row])


def _store(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def materialise(spark: SparkSession, root: str, name: str, request: dict, build: Callable[[], DataFrame]) -> tuple[DataFrame, bool]:
    """(the stage's table, whether it was reused).

    Reused only if the stored request and the stored signature of the rows
    both match; a table without its record is partial and is built anew.  A
    new table is written aside, its record last, and published by a rename.
    """
    at, store = _store(spark, f"{root}/{name}")
    asked = digest(request)
    if store.exists(at) and store.exists(_store(spark, f"{root}/{name}/record")[0]):
        record = spark.read.json(f"{root}/{name}/record").first()
        table = spark.read.parquet(f"{root}/{name}/rows")
        if record["request"] == asked and record["signature"] == signature(table):
            return table, True
    aside, _ = _store(spark, f"{root}/.{name}-new")
    store.delete(aside, True)
    build().write.parquet(f"{root}/.{name}-new/rows")
    signed = signature(spark.read.parquet(f"{root}/.{name}-new/rows"))
    spark.createDataFrame([(asked, signed)], "request string, signature string").coalesce(1).write.json(f"{root}/.{name}-new/record")
    store.delete(at, True)
    if not store.rename(aside, at):
        raise OSError(f"{root}/{name} could not be published")
    return spark.read.parquet(f"{root}/{name}/rows"), False
