"""Content signatures, resumption by content, key parity and strict merges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tree_signature(files: DataFrame, by: list[str], name: str, size: str, digest: str) -> DataFrame:
    """Per group: files, bytes, and one SHA-256 over all (name, size, digest).

    The digest is over sums of slices of each file's SHA-256, so it does not
    depend on order and needs no group in one place; renaming a file, or
    changing a byte of one, changes it.
    """
    one = F.sha2(F.concat_ws("|", F.col(name).cast("string"), F.col(size).cast("string"), F.col(digest)), 256)
    part = lambda k: F.conv(F.substring("one", 1 + 15 * k, 15), 16, 10).cast("decimal(20,0)")
    sums = files.select(*by, size, one.alias("one")).groupBy(*by).agg(F.count("*").alias("n_files"), F.sum(size).alias("n_bytes"), *(F.sum(part(k)).alias(f"s{k}") for k in range(4)))
    text = F.concat_ws("|", "n_files", "n_bytes", *(F.col(f"s{k}").cast("string") for k in range(4)))
    return sums.select(*by, "n_files", "n_bytes", F.sha2(text, 256).alias("signature"))


def remaining(expected: DataFrame, done: DataFrame, keys: list[str], identity: list[str]) -> DataFrame:
    """Expected rows without a finished row of the same keys and identity; partial rows (null identity) count as missing."""
    whole = done.filter(reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in identity)))
    return expected.join(whole.select(*keys, *identity), [*keys, *identity], "left_anti")


def broken_links(stages: DataFrame, by: list[str], order: str, request: str, output: str) -> DataFrame:
    """Stages whose request is not the output of the stage before them in their chain."""
    nexts = stages.select(*by, (F.col(order) - 1).alias(order), F.col(request).alias("asked"))
    return stages.join(nexts, [*by, order]).filter(~F.col(output).eqNullSafe(F.col("asked"))).select(*by, (F.col(order) + 1).alias(order), "asked", output)


def parity(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """(key..., status) of the keys that are not in both: ``missing_left`` or ``missing_right``."""
    a, b = left.select(*keys).distinct().withColumn("l", F.lit(True)), right.select(*keys).distinct().withColumn("r", F.lit(True))
    return a.join(b, keys, "full").filter("l is null or r is null").select(*keys, F.when(F.col("l").isNull(), "missing_left").otherwise("missing_right").alias("status"))


def strict_merge(left: DataFrame, right: DataFrame, keys: list[str], merged: dict[str, Column]) -> DataFrame:
    """A 1:1 join of ``left`` (columns l_...) and ``right`` (r_...) on equal key sets; an error if a key has no partner."""
    rename = lambda df, s: df.select(*keys, F.lit(True).alias(f"{s}__there"), *(F.col(c).alias(f"{s}_{c}") for c in df.columns if c not in keys))
    both = rename(left, "l").join(rename(right, "r"), keys, "full")
    whole = F.col("l__there").isNotNull() & F.col("r__there").isNotNull()
    checked = both.filter(F.when(whole, True).otherwise(F.raise_error(F.concat(F.lit("no partner for key "), F.to_json(F.struct(*keys)))).cast("boolean")))
    return checked.select(*keys, *(c.alias(n) for n, c in merged.items()))
