"""Greedy suppression.  Each decision depends on those before it, so a group is walked in order.

Groups are what a caller has already thresholded (pairs of a run, boxes of an
image); the walk is by descending score with explicit ties.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.cluster import held


#: Side of a tile of pairs; never less than four radii.
TILE = 512
#: Ends of the ranges that are settled where pairs are made are at most so far apart.
SPAN = 8192


def _walked(xs: np.ndarray, ys: np.ndarray, own: np.ndarray, sure: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """1 (kept), -1 (suppressed) or 0 (open) of each pair, best first, and whether it is kept and no pair near it is open anywhere.

    Of those not ``sure`` to be kept, only ``own`` ones may be, as all pairs
    near them are there; the others are settled elsewhere.
    """
    if not len(xs):
        return np.empty(0, np.int8), np.empty(0, bool)
    xs, ys = xs - xs.min(), ys - ys.min()
    shape = (int(xs.max()) + radius + 1, int(ys.max()) + radius + 1)
    kept, open_ = np.zeros(shape, bool), np.zeros(shape, bool)
    state = sure.astype(np.int8)
    for k, (x, y) in enumerate(zip(xs.tolist(), ys.tolist(), strict=True)):
        if kept[x, y] and state[k] != 1:
            state[k] = -1
            continue
        near = slice(max(x - radius, 0), x + radius + 1), slice(max(y - radius, 0), y + radius + 1)
        if state[k] == 1:
            kept[x, y] = True
        elif kept[near].any():
            state[k] = -1
        elif own[k] and not open_[near].any():
            state[k], kept[x, y] = 1, True
        else:
            open_[x, y] = True
    loose = (state == 0) | (~own & ~sure)
    open_[:] = False
    open_[xs[loose], ys[loose]] = True
    done = own & (state == 1)
    for k in np.flatnonzero(done).tolist():
        x, y = xs[k], ys[k]
        done[k] = not open_[max(x - radius, 0) : x + radius + 1, max(y - radius, 0) : y + radius + 1].any()
    return state, done


def settler(a: str, b: str, score: str, radius: int):
    """For what makes pairs range by range: those of two ranges of ends that are settled by them alone, so that what ``pair_nms`` then gets is the kept and the open ones.

    The ranges (first and last, both in them) hold all pairs whose ends are in
    them, so a pair ``radius`` or more inside of both has all its neighbours there.
    """

    def settle(pairs: pd.DataFrame, first: tuple[int, int], second: tuple[int, int]) -> pd.DataFrame:
        pairs = pairs.sort_values([score, a, b], ascending=[False, True, True])
        inside = lambda c, ends: ((pairs[c] >= ends[0] + radius) & (pairs[c] <= ends[1] - radius)).to_numpy()
        none = np.zeros(len(pairs), bool)
        state, done = np.zeros(len(pairs), np.int8), none
        if len(pairs) and max(first[1] - first[0], second[1] - second[0]) <= SPAN:  # else the walk's squares would be large: all stay open
            state, done = _walked(pairs[a].to_numpy(np.int64), pairs[b].to_numpy(np.int64), inside(a, first) & inside(b, second), none, radius)
        return pairs.assign(__kept=state == 1, __done=done)[state >= 0]

    return settle


def pair_nms(pairs: DataFrame, by: list[str], a: str, b: str, score: str, radius: int) -> DataFrame:
    """Keep pairs, best first, unless both ends lie within ``radius`` of a kept pair's; ties by (a, b).

    Ends are whole numbers; pairs with a null end are kept.  Pairs are walked in
    square tiles with a margin of ``radius``: one is settled where all better
    ones near it are.  Those left open, whose better neighbours are open in the
    margin, are walked again in tiles set off by half a side, until none is
    left; the best open pair is settled in every round.  Kept pairs that no open
    one is near go on to no further round.
    """
    kinds = dict(pairs.dtypes)
    for c in (a, b):
        if kinds[c] not in ("tinyint", "smallint", "int", "bigint"):
            raise ValueError(f"{c} is not of whole numbers")
    side, columns = max(TILE, 4 * radius), [c for c in pairs.columns if c not in ("__kept", "__done")]
    names = [*columns, "__kept", "__done"]
    there = F.col(a).isNotNull() & F.col(b).isNotNull()

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([score, a, b], ascending=[False, True, True])
        own = pdf["__own"].to_numpy()
        state, done = _walked(pdf[a].to_numpy(np.int64), pdf[b].to_numpy(np.int64), own, pdf["__kept"].to_numpy(), radius)
        return pdf.assign(__kept=state == 1, __done=done)[own & (state >= 0)][names]

    done, off = pairs.filter(~there).select(*columns), 0
    if "__done" in pairs.columns:
        left, done = held(pairs.select(*names), "pair-nms"), pairs.sparkSession.createDataFrame([], pairs.select(*columns).schema)  # such pairs have both ends
        done = done.unionByName(left.filter("__done").select(*columns))
    else:
        left = pairs.filter(there).select(*columns, F.lit(False).alias("__kept"), F.lit(False).alias("__done"))
    while True:
        tile = lambda c, far: F.floor((F.col(c) + far - off) / side)  # noqa: E731, B023
        spread = left.filter(~F.col("__done")).withColumn("__a", F.explode(F.sequence(tile(a, -radius), tile(a, radius)))).withColumn("__b", F.explode(F.sequence(tile(b, -radius), tile(b, radius))))
        spread = spread.withColumn("__own", (F.col("__a") == tile(a, 0)) & (F.col("__b") == tile(b, 0)))
        left = held(spread.groupBy(*by, "__a", "__b").applyInPandas(walk, left.schema), "pair-nms")
        if left.filter(~F.col("__kept")).isEmpty():
            return done.unionByName(left.select(*columns))
        done = done.unionByName(left.filter("__done").select(*columns))
        off = side // 2 - off


def index_nms(pairs: DataFrame, by: list[str], a: str, b: str, score: str, radius: int) -> DataFrame:
    """Keep pairs, best first; a kept pair suppresses every later one with an end within ``radius`` of either of its ends."""

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([score, a, b], ascending=[False, True, True])
        ends = pdf[[a, b]].to_numpy()
        taken, keep = np.empty(0, ends.dtype), []
        for k, pair in enumerate(ends):
            if not (np.abs(taken[:, None] - pair[None, :]) <= radius).any():
                taken = np.r_[taken, pair]
                keep.append(k)
        return pdf.iloc[keep]

    return pairs.groupBy(*by).applyInPandas(walk, pairs.schema)


def box_nms(boxes: DataFrame, by: list[str], score: str, limit: float, *, id_col: str = "id") -> DataFrame:
    """Keep boxes (x0, y0, x1, y1), best first, unless their IoU with a kept one is above ``limit``; ties by id."""

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([score, id_col], ascending=[False, True])
        box = pdf[["x0", "y0", "x1", "y1"]].to_numpy(np.float64)
        area = (box[:, 2] - box[:, 0]) * (box[:, 3] - box[:, 1])
        keep: list[int] = []
        for k in range(len(pdf)):
            kept = box[keep]
            w = np.minimum(kept[:, 2], box[k, 2]) - np.maximum(kept[:, 0], box[k, 0])
            h = np.minimum(kept[:, 3], box[k, 3]) - np.maximum(kept[:, 1], box[k, 1])
            both = np.clip(w, 0, None) * np.clip(h, 0, None)
            if not (both > limit * (area[keep] + area[k] - both)).any():
                keep.append(k)
        return pdf.iloc[keep]

    return boxes.groupBy(*by).applyInPandas(walk, boxes.schema)


def thin(points: DataFrame, by: list[str], dims: list[str], radius: float, *, id_col: str = "id", seed: int = 42) -> DataFrame:
    """Keep points, in the order of a seeded MD5 of their ids, unless one already kept is within ``radius``; ids are unique in a group."""

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(id_col)
        at = pdf[dims].to_numpy(np.float64)
        cells: dict[tuple, list[int]] = {}
        keep = []
        steps = np.stack(np.meshgrid(*[[-1, 0, 1]] * len(dims), indexing="ij"), -1).reshape(-1, len(dims))
        rank = [hashlib.md5(f"{seed}|{i}".encode()).hexdigest() for i in pdf[id_col]]
        for k in sorted(range(len(pdf)), key=rank.__getitem__):
            cell = np.floor(at[k] / radius).astype(int)
            near = [j for s in steps for j in cells.get(tuple(cell + s), ())]
            if not (np.linalg.norm(at[near] - at[k], axis=1) <= radius).any():
                cells.setdefault(tuple(cell), []).append(k)
                keep.append(k)
        return pdf.iloc[sorted(keep)]

    return points.groupBy(*by).applyInPandas(walk, points.schema)


def runs_apart(pairs: DataFrame, by: list[str], a: str, radius: int, *, name: str = "run") -> DataFrame:
    """The pairs with the number of their run: a new one begins where no pair's ``a`` is within ``radius`` of the one before.

    Pairs of different runs cannot suppress each other; pairs with a null ``a`` are dropped.  Only the
    distinct values of ``a`` are ordered: a group's by a window, those of the
    whole table (``by`` empty) in ranges, of which the driver sees both ends
    and the number of runs.
    """
    ends = pairs.filter(F.col(a).isNotNull()).select(*by, a).distinct()
    begins = lambda w: F.coalesce((F.col(a) - F.lag(a).over(w) > radius).cast("int"), F.lit(0))
    if by:
        w = Window.partitionBy(*by).orderBy(a)
        placed = ends.withColumn("__new", begins(w)).select(*by, a, F.sum("__new").over(w).alias(name))
        return pairs.join(placed, [*by, a])
    w = Window.partitionBy("__range").orderBy(a)
    cut = held(ends.repartitionByRange(a).withColumn("__range", F.spark_partition_id()), "runs").withColumn("__new", begins(w))
    offsets, run, last = [], 0, None
    for r in cut.groupBy("__range").agg(F.min(a).alias("low"), F.max(a).alias("high"), F.sum("__new").alias("n")).orderBy("low").collect():  # a row a range
        run += int(last is not None and r["low"] - last > radius)
        offsets.append((r["__range"], run))
        run, last = run + r["n"], r["high"]
    offset = F.create_map(*(F.lit(x) for pair in offsets for x in pair))[F.col("__range")] if offsets else F.lit(0)
    return pairs.join(cut.select(a, (offset + F.sum("__new").over(w)).alias(name)), a)


def event_nms(pairs: DataFrame, by: list[str], order: str, a: str, b: str, radius: int) -> DataFrame:
    """Keep chunk pairs in input order unless they are of one chunk, or both ends (as smaller and greater) lie within ``radius`` of a kept pair's.

    With a radius of 0 only repeats go; null ends are dropped.
    """
    kinds = pairs.schema

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.dropna(subset=[a, b]).sort_values(order)
        ends = np.sort(pdf[[a, b]].to_numpy(), axis=1)
        kept = np.empty((0, 2), ends.dtype)
        keep = []
        for k, pair in enumerate(ends):
            if pair[0] != pair[1] and not (np.abs(kept - pair) <= radius).all(1).any():
                kept = np.vstack([kept, pair])
                keep.append(k)
        return pdf.iloc[keep]

    return pairs.groupBy(*by).applyInPandas(walk, kinds)


def reduce_edges(edges: DataFrame, by: list[str], magnitude: str, i: str, j: str, *, most: int, gap: int = 30, radius: int = 2) -> DataFrame:
    """At most ``most`` edges of a group, smallest magnitude first, whose ends are ``gap`` or more apart.

    A kept edge takes out those whose ends are both within ``radius`` of its
    own.  Ties go by (i, j); null or non-finite magnitudes are dropped.
    """

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf[np.isfinite(pdf[magnitude].to_numpy(float)) & ((pdf[j] - pdf[i]).abs() >= gap)].sort_values([magnitude, i, j])
        ends = pdf[[i, j]].to_numpy()
        kept = np.empty((0, 2), ends.dtype)
        keep = []
        for k, pair in enumerate(ends):
            if len(keep) == most:
                break
            if not (np.abs(kept - pair) <= radius).all(1).any():
                kept = np.vstack([kept, pair])
                keep.append(k)
        return pdf.iloc[keep]

    return edges.groupBy(*by).applyInPandas(walk, edges.schema)
