"""Masks as sparse (image, instance, x, y) rows, and per-frame depth checks.

Every measure is a grouped aggregation; pairs of instances are joined on the
pixels they share, so instances that never meet are never paired.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PIXEL = ["x", "y"]
#: Pixels of a row of a mask that are packed into a number.
WORD = 63


def union(pixels: DataFrame, image: str) -> DataFrame:
    """(image, n_instances, n_pixels, n_overlaps): the union of an image's instances and the pixels that more than one has."""
    once = pixels.groupBy(image, *PIXEL).agg(F.count_distinct("instance").alias("k"))
    counts = once.groupBy(image).agg(F.count("*").alias("n_pixels"), F.count_if(F.col("k") > 1).alias("n_overlaps"))
    return counts.join(pixels.groupBy(image).agg(F.count_distinct("instance").alias("n_instances")), image)


def boxes(pixels: DataFrame, by: list[str]) -> DataFrame:
    """Bounding box and area of each mask."""
    return pixels.groupBy(*by).agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"), F.count_distinct(*PIXEL).alias("area"))


def overlaps(left: DataFrame, right: DataFrame, image: str) -> DataFrame:
    """(image, a, b, shared, iou) of every pair of instances that share a pixel."""
    a = left.select(image, F.col("instance").alias("a"), *PIXEL).distinct()
    b = right.select(image, F.col("instance").alias("b"), *PIXEL).distinct()
    shared = a.join(b, [image, *PIXEL]).groupBy(image, "a", "b").agg(F.count("*").alias("shared"))
    sized = shared.join(a.groupBy(image, "a").agg(F.count("*").alias("na")), [image, "a"]).join(b.groupBy(image, "b").agg(F.count("*").alias("nb")), [image, "b"])
    return sized.select(image, "a", "b", "shared", (F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared"))).alias("iou"))


def keep_ids(new: DataFrame, known: DataFrame, image: str, threshold: float) -> DataFrame:
    """(image, instance, id): each new mask takes the first known object with an IoU above the threshold, else null."""
    found = overlaps(new, known, image).filter(F.col("iou") > threshold).groupBy(image, F.col("a").alias("instance")).agg(F.min("b").alias("id"))
    return new.select(image, "instance").distinct().join(found, [image, "instance"], "left")


def combine(pixels: DataFrame, image: str) -> DataFrame:
    """(image, x, y, instance): one label a pixel, the smallest instance on top."""
    return pixels.filter(F.col("instance") > 0).groupBy(image, *PIXEL).agg(F.min("instance").alias("instance"))


def stability(values: DataFrame, by: list[str], value: str, threshold: float, offset: float) -> DataFrame:
    """Values above threshold + offset over those above threshold - offset; null if there are none of these."""
    high, low = F.count_if(F.col(value) > threshold + offset), F.count_if(F.col(value) > threshold - offset)
    return values.groupBy(*by).agg((high / F.nullif(low, F.lit(0))).alias("stability"))


def quality_filter(rows: DataFrame, *, iou: str, stability_col: str, least_iou: float, least_stability: float) -> DataFrame:
    """Predicted IoU strictly above, stability at or above; a filter with a threshold of 0 or less is off."""
    ok = F.lit(True)
    if least_iou > 0:
        ok &= F.col(iou) > least_iou
    if least_stability > 0:
        ok &= F.col(stability_col) >= least_stability
    return rows.filter(ok)


def rle(pixels: DataFrame, by: list[str], height: int) -> DataFrame:
    """(by..., starts, lengths): column-major run-length encoding of each mask."""
    at = pixels.select(*by, (F.col("x") * height + F.col("y")).alias("at")).distinct()
    w = Window.partitionBy(*by).orderBy("at")
    runs = at.withColumn("run", F.col("at") - F.row_number().over(w)).groupBy(*by, "run").agg(F.min("at").alias("start"), F.count("*").alias("length"))
    ordered = runs.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("start", "length"))).alias("r"))
    return ordered.select(*by, F.transform("r", lambda x: x["start"]).alias("starts"), F.transform("r", lambda x: x["length"]).alias("lengths"))


def unrle(encoded: DataFrame, by: list[str], height: int) -> DataFrame:
    """The pixels of run-length encoded masks."""
    runs = encoded.select(*by, F.explode(F.arrays_zip("starts", "lengths")).alias("r"))
    at = runs.select(*by, F.explode(F.sequence(F.col("r.starts"), F.col("r.starts") + F.col("r.lengths") - 1)).alias("at"))
    return at.select(*by, F.floor(F.col("at") / height).alias("x"), (F.col("at") % height).alias("y"))


def confident(conf: Column, threshold: Column | float) -> Column:
    """conf >= threshold and conf > 1e-5."""
    return (conf >= threshold) & (conf > 1e-5)


def depth_valid(conf_a: Column, conf_b: Column, depth_a: Column, depth_b: Column, threshold: float) -> Column:
    """Both confidences strictly above the threshold, both depths strictly between 1e-3 and 100."""
    ok = (conf_a > threshold) & (conf_b > threshold)
    for d in (depth_a, depth_b):
        ok &= (d > 1e-3) & (d < 100)
    return ok


def invalid_fraction(pixels: DataFrame, by: list[str], frame: str, invalid: Column) -> DataFrame:
    """(by..., n_frames, fraction): the share of invalid pixels of each frame, averaged over frames."""
    per = pixels.groupBy(*by, frame).agg(F.avg(invalid.cast("double")).alias("share"))
    return per.groupBy(*by).agg(F.count("*").alias("n_frames"), F.avg("share").alias("fraction"))


def consistent(votes: DataFrame, by: list[str], distance: str, limit: float, least: int, value: str) -> DataFrame:
    """Points that at least ``least`` views agree on (distance strictly under the limit), at the mean of these views."""
    good = votes.filter(F.col(distance) < limit).groupBy(*by).agg(F.count("*").alias("n_views"), F.avg(value).alias(value))
    return good.filter(F.col("n_views") >= least)


def choose_scale(forward: Column, backward: Column, quality_f: Column, quality_b: Column, least: float = 0.7) -> Column:
    """The mean of two scales if both are good, else the better one's."""
    return F.when((quality_f > least) & (quality_b > least), (forward + backward) / 2).when(quality_f >= quality_b, forward).otherwise(backward)


def _disc(radius: int) -> list[tuple[int, int]]:
    return [(x, y) for x in range(-radius, radius + 1) for y in range(-radius, radius + 1) if x * x + y * y <= radius * radius]


def dilate(pixels: DataFrame, by: list[str], radius: int, width: int, height: int) -> DataFrame:
    """Every pixel within ``radius`` of the mask (a disc), inside the image; duplicates go before the shuffle."""
    steps = F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in _disc(radius)))
    grown = pixels.select(*by, *PIXEL).distinct().select(*by, "x", "y", F.explode(steps).alias("s"))
    grown = grown.select(*by, (F.col("x") + F.col("s.x")).alias("x"), (F.col("y") + F.col("s.y")).alias("y"))
    return grown.filter(F.col("x").between(0, width - 1) & F.col("y").between(0, height - 1)).distinct()


def erode(pixels: DataFrame, by: list[str], radius: int, width: int, height: int) -> DataFrame:
    """Mask pixels whose whole disc, as far as it is inside the image, is in the mask."""
    once = pixels.select(*by, *PIXEL).distinct()
    steps = F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in _disc(radius)))
    votes = once.select(*by, "x", "y", F.explode(steps).alias("s")).select(*by, (F.col("x") + F.col("s.x")).alias("x"), (F.col("y") + F.col("s.y")).alias("y"))
    inside = lambda x, y: ((F.col("x") + x).between(0, width - 1) & (F.col("y") + y).between(0, height - 1)).cast("int")
    due = sum((inside(x, y) for x, y in _disc(radius)), F.lit(0))
    counted = votes.groupBy(*by, *PIXEL).agg(F.count("*").alias("n")).withColumn("due", due)
    return once.join(counted.filter("n = due").select(*by, *PIXEL), [*by, *PIXEL], "left_semi")


def refine(pixels: DataFrame, by: list[str], width: int, height: int, *, close: int = 0, grow: int = 0) -> DataFrame:
    """The mask closed (grown, then shrunk back) by a disc, then grown by another; 0 leaves a step out."""
    out = _closed(pixels, by, close, width, height) if close else pixels.select(*by, *PIXEL).distinct()
    return dilate(out, by, grow, width, height) if grow else out


def _closed(pixels: DataFrame, by: list[str], radius: int, width: int, height: int) -> DataFrame:
    """What ``dilate`` and then ``erode`` leave, one mask at a time: its rows of pixels are packed ``WORD`` to a number by Spark, so a mask is no larger than its image."""
    kinds, disc = dict(pixels.dtypes), _disc(radius)
    near = lambda c, n: F.col(c).between(-radius, n - 1 + radius)
    place = F.col("x").cast("long") + radius
    bit = F.expr(f"shiftleft(1L, cast((x + {radius}) % {WORD} as int))")
    words = pixels.filter(near("x", width) & near("y", height)).groupBy(*by, F.col("y").cast("long").alias("__y"), F.floor(place / WORD).alias("__word")).agg(F.bit_or(bit).alias("__bits"))

    def close(pdf: pd.DataFrame) -> pd.DataFrame:
        on = (pdf["__bits"].to_numpy()[:, None] >> np.arange(WORD)) & 1 == 1
        row, k = np.nonzero(on)
        x, y = pdf["__word"].to_numpy()[row] * WORD + k - radius, pdf["__y"].to_numpy()[row]
        left, top = x.min() - 2 * radius, y.min() - 2 * radius
        mask = np.zeros((y.max() + 2 * radius - top + 1, x.max() + 2 * radius - left + 1), bool)
        mask[y - top, x - left] = True
        inside = np.outer(*((np.arange(n) + at >= 0) & (np.arange(n) + at < most) for n, at, most in zip(mask.shape, (top, left), (height, width), strict=True)))
        high, wide = (n - 2 * radius for n in mask.shape)
        shifted = lambda m: [m[radius + dy : radius + dy + high, radius + dx : radius + dx + wide] for dx, dy in disc]
        grown = np.zeros_like(mask)
        grown[radius:-radius, radius:-radius] = np.logical_or.reduce(shifted(mask))
        kept = np.logical_and.reduce(shifted(grown & inside | ~inside)) & (grown & inside)[radius:-radius, radius:-radius]
        y, x = np.nonzero(kept)
        return pd.DataFrame({**{c: [pdf[c].iloc[0]] * len(x) for c in by}, "x": x + left + radius, "y": y + top + radius})

    return words.groupBy(*by).applyInPandas(close, ", ".join(f"{c} {kinds[c]}" for c in (*by, *PIXEL)))


def fill_holes(pixels: DataFrame, by: list[str], width: int, height: int) -> DataFrame:
    """The mask with all background that the image's edge does not reach (by sides); one image's mask at a time."""
    kinds = dict(pixels.dtypes)

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        mask = np.zeros((height, width), bool)
        mask[pdf["y"].to_numpy(), pdf["x"].to_numpy()] = True
        free = np.pad(~mask, 1, constant_values=True)
        reached = np.zeros_like(free)
        reached[0], reached[-1], reached[:, 0], reached[:, -1] = True, True, True, True
        while True:
            grown = reached.copy()
            grown[1:] |= reached[:-1]
            grown[:-1] |= reached[1:]
            grown[:, 1:] |= reached[:, :-1]
            grown[:, :-1] |= reached[:, 1:]
            grown &= free
            if (grown == reached).all():
                break
            reached = grown
        y, x = np.nonzero(~reached[1:-1, 1:-1])
        out = pd.DataFrame({"x": x, "y": y})
        for k, c in enumerate(by):
            out.insert(k, c, pdf[c].iloc[0])
        return out

    schema = ", ".join(f"{c} {kinds[c]}" for c in (*by, *PIXEL))
    return pixels.select(*by, *PIXEL).distinct().groupBy(*by).applyInPandas(fill, schema)


def mask_runs(pixels: DataFrame, by: list[str]) -> DataFrame:
    """(by..., y, x0, x1): the runs of neighbouring pixels in every row of a mask, both ends in them."""
    once = pixels.select(*by, *PIXEL).filter("x is not null and y is not null").distinct()
    island = F.col("x") - F.row_number().over(Window.partitionBy(*by, "y").orderBy("x"))
    return once.withColumn("__island", island).groupBy(*by, "y", "__island").agg(F.min("x").alias("x0"), F.max("x").alias("x1")).drop("__island")


def _merged_labels(y: np.ndarray, x0: np.ndarray, x1: np.ndarray, reach: int) -> np.ndarray:
    """For runs in raster order, the first run of each one's component; ``reach`` 1 counts corners as neighbours."""
    wide = int(x1.max() - x0.min()) + 4
    base = (y - y.min()) * wide - x0.min() + 1
    first, last = base + x0, base + x1
    # the runs of the row below that touch a run follow one another
    low = np.searchsorted(last, first + wide - reach)
    n = np.maximum(np.searchsorted(first, last + wide + reach, "right") - low, 0)
    a = np.repeat(np.arange(len(y)), n)
    b = np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
    root = np.arange(len(y))
    while True:
        ra, rb = root[a], root[b]
        open_ = ra != rb
        if not open_.any():
            return root
        np.minimum.at(root, np.maximum(ra, rb)[open_], np.minimum(ra, rb)[open_])
        while (root[root] != root).any():
            root = root[root]


def labelled_runs(pixels: DataFrame, by: list[str], *, corners: bool = True) -> DataFrame:
    """(by..., y, x0, x1, label): the connected components of every mask, numbered from 1 by their first pixel, row by row.

    Rows are cut into runs by Spark; one mask's runs (far fewer than its
    pixels) are merged in a task.  With ``corners``, diagonal pixels are
    neighbours.  Pixels count once, those without a place not at all.
    """
    runs = mask_runs(pixels, by)
    kinds = dict(runs.dtypes)

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["y", "x0"], ignore_index=True)
        root = _merged_labels(*(pdf[c].to_numpy(np.int64) for c in ("y", "x0", "x1")), int(corners))
        return pdf.assign(label=np.unique(root, return_inverse=True)[1].astype(np.int64) + 1)

    return runs.groupBy(*by).applyInPandas(merge, ", ".join(f"{c} {kinds[c]}" for c in runs.columns) + ", label long")


def components(pixels: DataFrame, by: list[str], *, corners: bool = True) -> DataFrame:
    """(by..., label, area, x0, y0, x1, y1) of every connected component of the masks."""
    runs = labelled_runs(pixels, by, corners=corners)
    return runs.groupBy(*by, "label").agg(F.sum(F.col("x1") - F.col("x0") + 1).alias("area"), F.min("x0").alias("x0"), F.min("y").alias("y0"), F.max("x1").alias("x1"), F.max("y").alias("y1"))


def labelled_pixels(pixels: DataFrame, by: list[str], *, corners: bool = True) -> DataFrame:
    """(by..., x, y, label, area): every pixel of a mask with its component and that one's area."""
    runs = labelled_runs(pixels, by, corners=corners)
    area = F.sum(F.col("x1") - F.col("x0") + 1).over(Window.partitionBy(*by, "label"))
    return runs.withColumn("area", area).select(*by, F.explode(F.sequence("x0", "x1")).alias("x"), "y", "label", "area")


def without_specks(pixels: DataFrame, by: list[str], least: int, *, corners: bool = True) -> DataFrame:
    """The masks without components of fewer than ``least`` pixels."""
    return labelled_pixels(pixels, by, corners=corners).filter(F.col("area") >= least).select(*by, *PIXEL)


def joint_confident(a: Column, b: Column, threshold: float) -> Column:
    """Both strictly above the threshold; null counts as below."""
    return F.coalesce((a > threshold) & (b > threshold), F.lit(False))


def zero_confidence(pixels: DataFrame, mask: DataFrame, images: DataFrame | None, image: str, conf: str, *, strict: bool = False) -> DataFrame:
    """Pixels with ``conf`` 0 where their image's mask holds them.

    ``images`` names those that have a mask file; strict: a pixel of another
    image is an error, else it passes through.
    """
    hit = mask.select(image, *PIXEL).distinct().withColumn("__hit", F.lit(True))
    out = pixels.join(hit, [image, *PIXEL], "left")
    if strict and images is not None:
        out = out.join(images.select(image).distinct().withColumn("__known", F.lit(True)), image, "left")
        out = out.filter(F.when(F.col("__known"), True).otherwise(F.raise_error(F.concat(F.lit("no mask for image "), F.col(image).cast("string"))).cast("boolean"))).drop("__known")
    return out.select(*(F.when(F.col("__hit"), 0.0).otherwise(F.col(c)).alias(c) if c == conf else F.col(c) for c in pixels.columns))


def roi_cells(pixels: DataFrame, margin: int, width: int, height: int) -> DataFrame:
    """(x, y): dark pixels (value < 128) and all within ``margin`` of one."""
    return dilate(pixels.filter("value < 128").withColumn("roi", F.lit(0)), ["roi"], margin, width, height).drop("roi")


def in_roi(points: DataFrame, cells: DataFrame, affine: tuple[float, ...], low: float, high: float) -> DataFrame:
    """Points with ``inside``: the 3 x 3 affine takes (x, y) to a pixel (cut towards 0) that is a cell, and z is from low to high, both included."""
    place = lambda r: (affine[3 * r] * F.col("x") + affine[3 * r + 1] * F.col("y") + affine[3 * r + 2])
    keyed = points.withColumns({"__x": place(0), "__y": place(1)})
    known = cells.select(F.col("x").cast("long").alias("__cx"), F.col("y").cast("long").alias("__cy")).distinct().withColumn("__in", F.lit(True))
    cut = lambda c: F.when(F.col(c).isNotNull() & (F.abs(F.col(c)) < 1e15), F.col(c).cast("long"))
    joined = keyed.withColumns({"__cx": cut("__x"), "__cy": cut("__y")}).join(known, ["__cx", "__cy"], "left")
    return joined.select(*points.columns, F.coalesce(F.col("__in") & F.col("z").between(low, high), F.lit(False)).alias("inside"))
