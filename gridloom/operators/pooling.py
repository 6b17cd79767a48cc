"""Pooled descriptors, robust scales and relative pose errors."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.cluster import ship
from gridloom.functions import linalg, pose
from gridloom.operators import quantiles


def gem(rows: DataFrame, by: list[str], vec: str, *, p: float = 3.0, eps: float = 1e-6) -> DataFrame:
    """(by..., dim, value): the generalised mean (mean of max(x, eps) ** p) ** (1 / p) of each dimension, over its L2 norm."""
    each = rows.select(*by, F.posexplode(vec).alias("dim", "x"))
    pooled = each.groupBy(*by, "dim").agg(F.pow(F.avg(F.pow(F.greatest(F.col("x").cast("double"), F.lit(eps)), F.lit(p))), F.lit(1 / p)).alias("v"))
    norm = F.sqrt(F.sum(F.col("v") * F.col("v")).over(Window.partitionBy(*by)))
    return pooled.select(*by, "dim", (F.col("v") / norm).alias("value"))


def sinkhorn(scores: np.ndarray, *, rounds: int = 3, dust: float = 1.0) -> np.ndarray:
    """Log-domain assignment of features to clusters with a dust bin: cluster x feature shares without the bin's row."""
    k, n = scores.shape
    logs = np.vstack([scores, np.full((1, n), dust)])
    rows, cols = np.r_[np.zeros(k), np.log(max(n - k, 1))], np.zeros(n)
    total = np.log(n + k)
    rows, cols = rows - total, cols - total
    u, v = np.zeros(k + 1), np.zeros(n)
    fold = lambda m, axis: m.max(axis) + np.log(np.exp(m - m.max(axis, keepdims=True)).sum(axis))
    for _ in range(rounds):
        u = rows - fold(logs + v[None, :], 1)
        v = cols - fold(logs + u[:, None], 0)
    return np.exp(logs + u[:, None] + v[None, :] + total)[:-1]


def transport_pool(features: DataFrame, by: list[str], *, scores: str, vec: str, order: str, rounds: int = 3, dust: float = 1.0) -> DataFrame:
    """(by..., cluster, dim, value): features summed into clusters by optimal transport, each cluster and then the whole of unit length.

    ``scores`` has a number a cluster, ``vec`` the feature's own.  A group is an
    image: a bounded grid of features, walked in a task.  There must be more
    features than clusters for the dust bin to hold any.
    """
    ship(features.sparkSession)
    kinds = dict(features.dtypes)

    def pool(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        share = sinkhorn(np.array(pdf[scores].to_list(), float).T, rounds=rounds, dust=dust)
        sums = share @ np.array(pdf[vec].to_list(), float)
        sums = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
        sums = sums / max(np.linalg.norm(sums), 1e-12)
        k, d = sums.shape
        out = pd.DataFrame({"cluster": np.repeat(np.arange(k), d), "dim": np.tile(np.arange(d), k), "value": sums.ravel()})
        for j, c in enumerate(by):
            out.insert(j, c, pdf[c].iloc[0])
        return out

    return features.groupBy(*by).applyInPandas(pool, ", ".join(f"{c} {kinds[c]}" for c in by) + ", cluster int, dim int, value double")


def scene_scale(points: DataFrame, by: list[str], dims: list[str], low: float = 0.05, high: float = 0.95) -> DataFrame:
    """The diagonal of the box between two quantiles of every coordinate."""
    found = None
    for k, d in enumerate(dims):
        one = quantiles.quantiles(points, by, d, {f"__lo{k}": low, f"__hi{k}": high})
        found = one if found is None else found.join(one, by, "left") if by else found.join(F.broadcast(one), how="left")  # one row
    spans = [F.col(f"__hi{k}") - F.col(f"__lo{k}") for k in range(len(dims))]
    return found.select(*by, F.sqrt(sum((s * s for s in spans[1:]), spans[0] * spans[0])).alias("scale"))


def median_ratio_scale(poses: DataFrame, by: list[str], order: str, source: list[str], target: list[str], *, step: int, least: float = 1e-6) -> DataFrame:
    """The median of target over source distance for poses ``step`` apart; pairs that hardly move are left out."""
    w = Window.partitionBy(*by).orderBy(order)

    def gap(cols: list[str]) -> Column:
        d = [F.col(c) - F.lag(c, step).over(w) for c in cols]
        return F.sqrt(sum((x * x for x in d[1:]), d[0] * d[0]))

    moves = poses.select(*by, gap(source).alias("s"), gap(target).alias("t")).filter((F.col("s") > least) & (F.col("t") > least))
    return moves.groupBy(*by).agg(F.percentile(F.col("t") / F.col("s"), 0.5).alias("scale"), F.count("*").alias("n_pairs"))


def robust_scale(rows: DataFrame, by: list[str], a: str, b: str, *, inlier: float = 0.1, rounds: int = 10) -> DataFrame:
    """a = s b through the origin: the median ratio, then least squares over inliers until they no longer change."""
    start = rows.filter(F.abs(F.col(b)) > 1e-12).groupBy(*by).agg(F.percentile(F.col(a) / F.col(b), 0.5).alias("scale"))
    good = F.abs(F.col(a) - F.col("scale") * F.col(b)) <= inlier
    for _ in range(rounds):
        new = rows.join(start, by).groupBy(*by).agg(
            F.coalesce(F.sum(F.when(good, F.col(a) * F.col(b))) / F.nullif(F.sum(F.when(good, F.col(b) * F.col(b))), F.lit(0.0)), F.first("scale")).alias("scale"),
            F.count_if(good).alias("n_inliers"),
        )
        new = new.checkpoint() if rows.sparkSession.sparkContext._jsc.sc().getCheckpointDir().isDefined() else new
        if new.join(start.withColumnRenamed("scale", "old"), by).filter(F.abs(F.col("scale") - F.col("old")) > 1e-12).isEmpty():
            return new
        start = new.drop("n_inliers")
    return new


def _pair_errors(re, te, rg, tg, se, ue, sg, ug) -> tuple[np.ndarray, np.ndarray]:
    """(rotation, translation) angle errors in degrees of the relative poses from each first to each second pose."""
    # trace((Re' Se)(Rg' Sg)') = <Rg Re', Sg Se'>: one matrix product for all pairs, and no relative rotation is worked out
    flat = lambda g, e: (g @ e.transpose(0, 2, 1)).reshape(len(g), 9)
    cosine = (flat(rg, re) @ flat(sg, se).T - 1) / 2
    ta, tb = (ue[None] - te[:, None]) @ re, (ug[None] - tg[:, None]) @ rg
    norm = np.sqrt(np.einsum("ija,ija->ij", ta, ta) * np.einsum("ija,ija->ij", tb, tb))
    aligned = np.abs(np.einsum("ija,ija->ij", ta, tb)) / np.where(norm > 0, norm, np.nan)  # the sign of a direction is free
    return np.degrees(np.arccos(np.clip(cosine, -1, 1))), np.nan_to_num(np.degrees(np.arccos(np.clip(aligned, 0, 1))), nan=1e6)


def relative_pose_errors(poses: DataFrame, by: list[str], *, order: str = "frame", bins: int = 30, block: int = 256) -> DataFrame:
    """Per run over all pairs of its poses: pairs, mean rotation and translation angle error, and the AUC of the larger of the two.

    ``poses`` has est_r, gt_r (9 numbers) and est_t, gt_t (3), and ``order`` is
    an integer.  A run is cut into blocks of ``block`` numbers, and a task
    compares one block with itself or with a later one: half of the pairs of
    blocks, and never a whole run.  A histogram of whole degrees leaves it.
    """
    ship(poses.sparkSession)
    kinds = dict(poses.dtypes)
    own = poses.select(*by, F.col(order).cast("long").alias("__at"), "est_r", "est_t", "gt_r", "gt_t").withColumn("__block", F.floor(F.col("__at") / block))
    spread = own.groupBy(*by).agg(F.sort_array(F.collect_set("__block")).alias("__blocks"))  # a number a block
    near = own.join(spread, by)
    left = near.select("*", F.col("__block").alias("__p"), F.explode(F.filter("__blocks", lambda q: q >= F.col("__block"))).alias("__q")).drop("__blocks")
    right = near.select("*", F.col("__block").alias("__q"), F.explode(F.filter("__blocks", lambda p: p <= F.col("__block"))).alias("__p")).drop("__blocks")
    right = right.select(*(F.col(c).alias(c) for c in right.columns))  # columns of its own, for the cogroup

    def compare(a: pa.Table, b: pa.Table) -> pa.Table:
        lists = lambda f, c, *shape: f[c].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, *shape)
        both = lambda f: (lists(f, "est_r", 3, 3), lists(f, "est_t", 3), lists(f, "gt_r", 3, 3), lists(f, "gt_t", 3))
        rot, trans = _pair_errors(*both(a), *both(b))
        due = a["__at"].to_numpy()[:, None] < b["__at"].to_numpy()[None]
        rot, trans = rot[due], trans[due]
        counts = np.histogram(np.maximum(rot, trans), bins=bins, range=(0, bins))[0]
        out = a.select(by).take(pa.array(np.zeros(bins + 1, int)))
        sums = {"bin": np.arange(-1, bins, dtype=np.int32), "n": np.r_[len(rot), counts], "rotation": np.r_[rot.sum(), np.zeros(bins)], "translation": np.r_[trans.sum(), np.zeros(bins)]}
        for c, values in sums.items():
            out = out.append_column(c, pa.array(values))
        return out

    keys = [*by, "__p", "__q"]
    many = int(poses.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # as they are: few bytes are many pairs
    left, right = (df.repartition(many, *keys) for df in (left, right))
    parts = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(compare, ", ".join(f"{c} {kinds[c]}" for c in by) + ", bin int, n long, rotation double, translation double")
    all_, hit = F.col("bin") == -1, F.col("bin") >= 0
    sums = parts.groupBy(*by).agg(
        F.sum(F.when(all_, F.col("n"))).alias("n_pairs"), F.sum("rotation").alias("rotation"), F.sum("translation").alias("translation"),
        F.sum(F.when(hit, F.col("n") * (bins - F.col("bin")))).alias("cumulated"),  # a pair counts in its bin and all later ones
    )
    share = lambda c: F.coalesce(F.col(c) / F.nullif(F.col("n_pairs"), F.lit(0)), F.lit(0.0))
    return sums.select(*by, "n_pairs", share("rotation").alias("rotation"), share("translation").alias("translation"), (share("cumulated") / bins).alias("auc"))


def smooth_positions(poses: DataFrame, by: list[str], order: str, dims: list[str], *, sigma: float, reach: int) -> DataFrame:
    """Gaussian smoothing over the rows within ``reach`` of each; weights are of those that are there."""
    w = Window.partitionBy(*by).orderBy(order)
    weights = {k: float(np.exp(-(k * k) / (2 * sigma * sigma))) for k in range(-reach, reach + 1)}
    there = lambda k: F.lag(order, k).over(w).isNotNull().cast("double") * weights[k]
    total = sum((there(k) for k in weights), F.lit(0.0))
    return poses.select(*by, order, *((sum((F.coalesce(F.lag(d, k).over(w), F.lit(0.0)) * weights[k] for k in weights), F.lit(0.0)) / total).alias(d) for d in dims))


def steps_between(poses: DataFrame, by: list[str], order: str, pose_col: str = "pose") -> DataFrame:
    """(by..., order, step): what takes each pose (s, r, t) of a series to the next, in the frame of the first of the two; the last has none."""
    nexts = F.lead(pose_col).over(Window.partitionBy(*by).orderBy(order))
    both = poses.select(*by, order, pose_col, nexts.alias("__next")).filter("__next is not null")
    return both.select(*by, order, pose.compose(pose.inverse(F.col(pose_col)), F.col("__next")).alias("step"))


def chained(steps: DataFrame, by: list[str], order: str) -> DataFrame:
    """Prefix products of similarity steps (s, r of nine, t of three), one run at a time: a run is a sequence of chunks."""
    ship(steps.sparkSession)
    kinds = dict(steps.dtypes)

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        moves = [(s, np.array(r, float).reshape(3, 3), np.array(t, float)) for s, r, t in zip(pdf["s"], pdf["r"], pdf["t"], strict=True)]
        total = linalg.cumulative(moves)
        return pdf[[*by, order]].assign(s=[m[0] for m in total], r=[m[1].ravel().tolist() for m in total], t=[m[2].tolist() for m in total])

    schema = ", ".join(f"{c} {kinds[c]}" for c in (*by, order)) + ", s double, r array<double>, t array<double>"
    return steps.groupBy(*by).applyInPandas(walk, schema)


def principal_colours(rows: DataFrame, vec: str, *, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """The rows with ``rgb``: the first three principal components, each clipped to its two quantiles and scaled to 0 .. 1.

    The covariance is summed by Spark; a component's sign is that which makes its largest loading positive.
    """
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    v = rows.withColumn("__v", array_to_vector(F.transform(vec, lambda x: x.cast("double"))))
    model = PCA(k=3, inputCol="__v", outputCol="__p").fit(v)
    loads = model.pc.toArray()
    signs = [1.0 if loads[np.abs(loads[:, k]).argmax(), k] > 0 else -1.0 for k in range(3)]
    p = model.transform(v).withColumn("__a", vector_to_array("__p"))
    p = p.withColumn("__a", F.array(*(F.col("__a")[k] * signs[k] for k in range(3))))
    cuts = p.agg(*(F.percentile(F.col("__a")[k], q).alias(f"{n}{k}") for k in range(3) for n, q in (("lo", low), ("hi", high)))).first()

    def scaled(k: int) -> Column:
        lo, hi = cuts[f"lo{k}"] or 0.0, cuts[f"hi{k}"] or 0.0
        return F.least(F.greatest((F.col("__a")[k] - lo) / max(hi - lo, 1e-12), F.lit(0.0)), F.lit(1.0))

    return p.withColumn("rgb", F.array(*(scaled(k) for k in range(3)))).drop("__v", "__p", "__a")
