"""Boxes (x0, y0, x1, y1) and masks as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def from_centre(cx: Column, cy: Column, w: Column, h: Column) -> Column:
    return F.struct((cx - w / 2).alias("x0"), (cy - h / 2).alias("y0"), (cx + w / 2).alias("x1"), (cy + h / 2).alias("y1"))


def area(b: Column) -> Column:
    return (b["x1"] - b["x0"]) * (b["y1"] - b["y0"])


def intersection(a: Column, b: Column) -> Column:
    w = F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"])
    h = F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"])
    return F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))


def iou(a: Column, b: Column) -> Column:
    both = intersection(a, b)
    return both / F.nullif(area(a) + area(b) - both, F.lit(0.0))


def giou(a: Column, b: Column) -> Column:
    both = intersection(a, b)
    union = area(a) + area(b) - both
    hull = (F.greatest(a["x1"], b["x1"]) - F.least(a["x0"], b["x0"])) * (F.greatest(a["y1"], b["y1"]) - F.least(a["y0"], b["y0"]))
    return both / union - (hull - union) / hull


def mask_iou(a: Column, b: Column) -> Column:
    """Of two arrays of booleans: sum(ab) / (sum(a) + sum(b) - sum(ab))."""
    on = lambda m: F.size(F.filter(m, lambda x: x))
    both = on(F.zip_with(a, b, lambda x, y: x & y))
    return both / F.nullif(on(a) + on(b) - both, F.lit(0))


def away_from_edge(b: Column, crop: Column, image: Column, margin: float = 20.0) -> Column:
    """False where a side of the box is near its crop's side but not near the image's."""
    near = lambda c, k, s: F.abs(c[s] - k[s]) <= margin
    ok = F.lit(True)
    for s in ("x0", "y0", "x1", "y1"):
        ok &= ~near(b, crop, s) | near(b, image, s)
    return ok
