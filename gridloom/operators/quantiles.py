"""Exact quantiles of groups of any size.

``percentile`` keeps a group's different values in one task.  That is fine up
to ``SMALL`` rows; larger groups are first bracketed by mergeable sketches
(``percentile_approx``, whose rank error is bounded), and only what lies within
a bracket, some ``6 / ACCURACY`` of the group, is counted value by value and
put in order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.cluster import held

#: Rows up to which a group is put in order as a whole, and the inverse of the sketches' rank error.
SMALL, ACCURACY = 100_000, 10_000


def quantiles(rows: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """(by..., one column a share): linear quantiles, as ``percentile`` has them.

    Nulls and NaN take no part; a group without other values has no row.
    """
    keys = [f"__k{k}" for k in range(len(by))] or ["__k0"]
    own = rows.select(*(F.col(c).alias(k) for c, k in zip(by, keys, strict=False)), *([] if by else [F.lit(0).alias("__k0")]), F.col(value).cast("double").alias("v")).filter("v is not null and not isnan(v)")
    plain = lambda df: df.groupBy(*keys).agg(*(F.percentile("v", p).alias(f"q{i}") for i, p in enumerate(shares.values())))
    counts = held(own.groupBy(*keys).agg(F.count("*").alias("n")).filter(F.col("n") > SMALL), "quantile-groups")
    if counts.isEmpty():
        found = plain(own)
    else:
        same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
        both = same[0]
        for c in same[1:]:
            both &= c
        small = own.alias("a").join(counts.alias("b"), both, "left_anti")
        large = own.alias("a").join(counts.alias("b"), both).select(*(f"a.{k}" for k in keys), "v", "n")
        found = plain(small).unionByName(_bracketed(large, keys, list(shares.values())))
    return found.select(*(F.col(k).alias(c) for c, k in zip(by, keys, strict=False)), *(F.col(f"q{i}").alias(name) for i, name in enumerate(shares)))


def _bracketed(large: DataFrame, keys: list[str], shares: list[float]) -> DataFrame:
    near = 3 / ACCURACY
    ends = [x for p in shares for x in (max(p - near, 0.0), min(p + near, 1.0))]
    sketch = large.groupBy(*keys).agg(F.first("n").alias("n"), F.percentile_approx("v", F.array(*map(F.lit, ends)), F.lit(ACCURACY)).alias("ends"))
    sketch = held(sketch, "quantile-brackets")  # a row a group
    on = lambda df, other: df.alias("a").join(other.alias("b"), [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys])
    placed = on(large.drop("n"), sketch).select(*(f"a.{k}" for k in keys), "v", "ends")
    low, high = (lambda i: F.get("ends", F.lit(2 * i))), (lambda i: F.get("ends", F.lit(2 * i + 1)))
    below = placed.groupBy(*keys).agg(F.array(*(F.count_if(F.col("v") < low(i)) for i in range(len(shares)))).alias("below"))
    inside = F.filter(F.array(*(F.when((F.col("v") >= low(i)) & (F.col("v") <= high(i)), i) for i in range(len(shares)))), lambda i: i.isNotNull())
    each = placed.select(*keys, "v", F.explode(inside).alias("i")).groupBy(*keys, "i", "v").agg(F.count("*").alias("c"))
    facts = on(below, sketch.select(*keys, "n")).select(*(f"a.{k}" for k in keys), "below", "n")
    seen = F.sum("c").over(Window.partitionBy(*keys, "i").orderBy("v"))
    ordered = on(each.withColumn("seen", seen), facts).select(*(f"a.{k}" for k in keys), "i", "v", (F.col("seen") + F.get("below", F.col("i"))).alias("upto"), F.get("below", F.col("i")).alias("under"), "n")
    at = F.col("n") - 1
    place = F.element_at(F.array(*(at * F.lit(float(p)) for p in shares)), F.col("i") + 1)
    ranked = ordered.withColumn("place", place)
    value_at = lambda rank: F.min(F.when(F.col("upto") > rank, F.col("v")))
    picked = ranked.groupBy(*keys, "i").agg(value_at(F.floor("place")).alias("lower"), value_at(F.ceil("place")).alias("upper"), F.first("place").alias("place"), F.max((F.col("under") > F.floor("place")).cast("int")).alias("missed"))
    part = F.col("place") - F.floor("place")
    outside = (F.col("missed") == 1) | F.col("upper").isNull()
    exact = F.when(outside, F.raise_error(F.lit("a quantile is outside its bracket")).cast("double")).when((part == 0) | (F.col("lower") == F.col("upper")), F.col("lower")).otherwise((1 - part) * F.col("lower") + part * F.col("upper"))
    solved = picked.select(*keys, "i", exact.alias("q"))
    return solved.groupBy(*keys).agg(*(F.max(F.when(F.col("i") == i, F.col("q"))).alias(f"q{i}") for i in range(len(shares))))


def with_quantiles(rows: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """The rows with their group's quantiles; rows of a group without values get nulls."""
    found = quantiles(rows, by, value, shares)
    return rows.join(found, by, "left") if by else rows.crossJoin(F.broadcast(found))  # one row
