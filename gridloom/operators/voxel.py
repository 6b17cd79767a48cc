"""Voxel operators: grouping of points by floor(coordinate / size).

Keys come from integer coordinates where exactness at cell edges matters.  All
of these are one aggregation (or one join on the key); partial sums go before
the shuffle, so a crowded voxel needs no care.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AXES = ("x", "y", "z")
KEY = ("vx", "vy", "vz")


def key(size: int | float) -> list[Column]:
    """The voxel of a point, one column an axis."""
    return [F.floor(F.col(c) / F.lit(size)).cast("long").alias(k) for c, k in zip(AXES, KEY, strict=True)]


def count(points: DataFrame, size: int | float) -> DataFrame:
    """(voxel, n)."""
    return points.groupBy(*key(size)).agg(F.count("*").alias("n"))


def centroid(points: DataFrame, size: int | float) -> DataFrame:
    """(voxel, mean position, n); the grid's origin is 0."""
    return points.groupBy(*key(size)).agg(*(F.avg(c).alias(c) for c in AXES), F.count("*").alias("n"))


def most_confident(points: DataFrame, size: int | float, *, conf: str = "conf", least: float | None = None, tie: list[str] | None = None) -> DataFrame:
    """The point of highest confidence in each voxel, the smallest by ``tie`` among equals; points under ``least`` are left out."""
    tie = list(tie or AXES)
    rows = points if least is None else points.filter(F.col(conf) >= least)
    best = F.max(F.struct(F.col(conf).alias("c"), *((-F.col(t)).alias(f"m{k}") for k, t in enumerate(tie)))).alias("best")
    got = rows.groupBy(*key(size)).agg(best)
    return got.select(*KEY, *((-F.col(f"best.m{k}")).alias(t) for k, t in enumerate(tie)), F.col("best.c").alias(conf))


def offsets(kind: int) -> list[tuple[int, int, int]]:
    """The 7, 19 or 27 cells around and with a voxel: those that differ in at most 1, 2 or 3 axes."""
    most = {7: 1, 19: 2, 27: 3}[kind]
    return [d for d in product((-1, 0, 1), repeat=3) if sum(map(abs, d)) <= most]


def support(points: DataFrame, size: int | float, kind: int = 27) -> DataFrame:
    """(voxel, n, support): how many of the cells around an occupied voxel, itself included, are occupied."""
    cells = count(points, size)
    shifts = F.array(*(F.struct(*(F.lit(v).alias(f"d{k}") for k, v in zip(KEY, d, strict=True))) for d in offsets(kind)))
    spread = cells.select(*KEY, F.explode(shifts).alias("d")).select(*((F.col(k) + F.col(f"d.d{k}")).alias(k) for k in KEY))
    near = spread.groupBy(*KEY).agg(F.count("*").alias("support"))
    return cells.join(near, list(KEY)).select(*KEY, "n", F.col("support"))


def clean(points: DataFrame, size: int | float, *, least_support: int, least_points: int = 1, kind: int = 27) -> DataFrame:
    """Points of voxels that have enough points and enough occupied neighbours."""
    good = support(points, size, kind).filter((F.col("support") >= least_support) & (F.col("n") >= least_points)).select(*KEY)
    keyed = points.select("*", *key(size))
    return keyed.join(good, list(KEY), "left_semi").select(*points.columns)
