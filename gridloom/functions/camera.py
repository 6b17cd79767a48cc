"""Pixels, rays and crops as column expressions and generated tables."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def pixel_grid(spark: SparkSession, width: int, height: int) -> DataFrame:
    """(u, v, nu, nv): pixels and their normalised centres."""
    k = F.col("id")
    grid = spark.range(width * height).select((k % width).cast("int").alias("u"), F.floor(k / width).cast("int").alias("v"))
    return grid.withColumns({"nu": (F.col("u") + 0.5) / width, "nv": (F.col("v") + 0.5) / height})


def equirect_ray(u: Column, v: Column, width: int, height: int) -> Column:
    """The unit direction of an equirectangular pixel's centre: x right, y down, z ahead at the middle."""
    lon = ((u + 0.5) / width - 0.5) * (2 * math.pi)
    lat = (0.5 - (v + 0.5) / height) * math.pi
    return F.struct((F.cos(lat) * F.sin(lon)).alias("x"), (-F.sin(lat)).alias("y"), (F.cos(lat) * F.cos(lon)).alias("z"))


def equirect_pixel(ray: Column, width: int, height: int) -> Column:
    """The (wrapped) pixel position of a direction; the inverse of ``equirect_ray``."""
    norm = F.sqrt(ray["x"] * ray["x"] + ray["y"] * ray["y"] + ray["z"] * ray["z"])
    u = F.pmod((F.atan2(ray["x"], ray["z"]) / (2 * math.pi) + 0.5) * width - 0.5, F.lit(float(width)))
    v = (0.5 - F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), -ray["y"] / norm))) / math.pi) * height - 0.5
    return F.struct(u.alias("u"), v.alias("v"))


def pinhole_ray(u: Column, v: Column, k: Column) -> Column:
    x, y = (u - k["cx"]) / k["fx"], (v - k["cy"]) / k["fy"]
    norm = F.sqrt(x * x + y * y + 1)
    return F.struct((x / norm).alias("x"), (y / norm).alias("y"), (1 / norm).alias("z"))


def fisheye_pixel(ray: Column, k: Column) -> Column:
    """Polynomial fisheye: theta (1 + k1 theta^2 + k2 theta^4 + k3 theta^6 + k4 theta^8) along the ray's azimuth."""
    r = F.sqrt(ray["x"] * ray["x"] + ray["y"] * ray["y"])
    theta = F.atan2(r, ray["z"])
    t2 = theta * theta
    d = theta * (1 + t2 * (k["k1"] + t2 * (k["k2"] + t2 * (k["k3"] + t2 * k["k4"]))))
    scale = F.when(r > 1e-12, d / r).otherwise(F.lit(1.0))
    return F.struct((k["fx"] * ray["x"] * scale + k["cx"]).alias("u"), (k["fy"] * ray["y"] * scale + k["cy"]).alias("v"))


def field_of_view(size: Column, focal: Column) -> Column:
    """Degrees between the rays of two opposite edges."""
    return F.degrees(2 * F.atan(size / (2 * focal)))


def metric_depth(depth: Column, focal: Column) -> Column:
    return depth * focal / 300


def blend_weights(border_a: Column, border_b: Column) -> Column:
    """(a, b): border distances over their sum, a distance of 0 or less counting as unseen; zero where neither camera sees the ray."""
    a, b = F.greatest(border_a, F.lit(0.0)), F.greatest(border_b, F.lit(0.0))
    total = a + b
    return F.struct(F.when(total > 0, a / total).otherwise(0.0).alias("a"), F.when(total > 0, b / total).otherwise(0.0).alias("b"))


def crop_boxes(spark: SparkSession, width: int, height: int, layers: int, overlap: float = 512 / 1500) -> DataFrame:
    """(layer, x0, y0, x1, y1): the image, then 4, 16, ... overlapping tiles a layer."""
    out = [(0, 0, 0, width, height)]
    short = min(width, height)
    for layer in range(1, layers + 1):
        side = 2**layer
        lap = int(overlap * short * (2 / side))
        w, h = (math.ceil((lap * (side - 1) + full) / side) for full in (width, height))
        out += [(layer, x, y, min(x + w, width), min(y + h, height)) for x in (int((w - lap) * i) for i in range(side)) for y in (int((h - lap) * i) for i in range(side))]
    return spark.createDataFrame(out, "layer int, x0 int, y0 int, x1 int, y1 int")


def turned_pixel(u: Column, v: Column, out: tuple[int, int], source: tuple[int, int], rotation: Column) -> Column:
    """Where in the source panorama (width, height) the centre of a pixel of the turned one comes from."""
    ray = equirect_ray(u, v, *out)
    at = lambda r: sum((F.get(rotation, F.lit(3 * r + k)) * ray[c] for k, c in enumerate("yz", 1)), F.get(rotation, F.lit(3 * r)) * ray["x"])
    return equirect_pixel(F.struct(at(0).alias("x"), at(1).alias("y"), at(2).alias("z")), *source)


def scatter(pixels: DataFrame, by: list[str], target: Column, value: str, width: int, height: int) -> DataFrame:
    """(by..., u, v, value): each pixel's value at the nearest pixel of its target place; the greatest of those that meet, columns wrap, rows do not."""
    placed = pixels.select(*by, F.pmod(F.round(target["u"]).cast("int"), F.lit(width)).alias("u"), F.round(target["v"]).cast("int").alias("v"), value)
    return placed.filter(F.col("v").between(0, height - 1)).groupBy(*by, "u", "v").agg(F.max(value).alias(value))
