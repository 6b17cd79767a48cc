"""Alignment of point sets: fits from distributed sums, robust reweighting, closest-point iteration, rig consensus.

Whatever the number of points, a fit is two aggregations (means, then centred
moments) and a 3 x 3 decomposition on the driver; iterations repeat that.
Without pairs a fit is the identity.  Ties are settled by the order that each
function states; rows with a null coordinate take no part.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.cluster import held, held_for, ship
from gridloom.functions import linalg, pose
from gridloom.operators import nearest, quantiles

SOURCE, TARGET = ("sx", "sy", "sz"), ("tx", "ty", "tz")


def _mean(w: Column, x: Column) -> Column:
    return F.sum(w * x) / F.sum(w)


def moments_by(pairs: DataFrame, by: list[str], source: list[str], target: list[str], weight: Column | None = None) -> DataFrame:
    """(by..., n, m_<c>, v_source, v_target, x_<target>_<source>): means first, then means of centred products.

    Two aggregations, so that points far from the origin lose nothing.
    Rows with a null weight or coordinate are left out of the moments.
    """
    there = F.lit(True)
    for c in (*source, *target):
        there &= F.col(c).isNotNull()
    w = F.when(there, F.lit(1.0) if weight is None else weight)
    rows = pairs.withColumn("__w", w).filter("__w > 0")
    w = F.col("__w")
    means = rows.groupBy(*by).agg(F.sum(w).alias("n"), *(_mean(w, F.col(c)).alias(f"m_{c}") for c in (*source, *target)))
    off = lambda c: F.col(c) - F.col(f"m_{c}")
    square = lambda cols: sum((off(c) * off(c) for c in cols[1:]), off(cols[0]) * off(cols[0]))
    centred = rows.join(means, by) if by else rows.crossJoin(F.broadcast(means))  # one row
    second = centred.groupBy(*by).agg(
        _mean(w, square(source)).alias("v_source"), _mean(w, square(target)).alias("v_target"),
        *(_mean(w, off(t) * off(s)).alias(f"x_{t}_{s}") for t in target for s in source),
    )
    return means.join(second, by) if by else means.crossJoin(F.broadcast(second))


def moments(pairs: DataFrame, weight: Column | None = None):
    """(n, mean source, mean target, variances, cross) of (sx, sy, sz) against (tx, ty, tz); all 0 without pairs."""
    r = moments_by(pairs, [], list(SOURCE), list(TARGET), weight).first()
    value = lambda c: float((r[c] if r is not None else 0) or 0)
    cross = np.array([[value(f"x_{t}_{s}") for s in SOURCE] for t in TARGET])
    return value("n"), np.array([value(f"m_{c}") for c in SOURCE]), np.array([value(f"m_{c}") for c in TARGET]), value("v_source"), value("v_target"), cross


def fit(pairs: DataFrame, *, weight: Column | None = None, with_scale: bool = True, ratio_scale: bool = False):
    """(s, R, t) of the least-squares similarity (or rigid) transform from source to target."""
    return linalg.fit_from_moments(*moments(pairs, weight), with_scale=with_scale, ratio_scale=ratio_scale)


def moved(m, cols: tuple[str, ...] = SOURCE) -> list[Column]:
    """The coordinates of s R p + t."""
    s, r, t = m
    return [sum((float(s * r[k][j]) * F.col(cols[j]) for j in range(3)), F.lit(float(t[k]))) for k in range(3)]


def residual(m) -> Column:
    gaps = [a - F.col(t) for a, t in zip(moved(m), TARGET, strict=True)]
    return F.sqrt(sum((g * g for g in gaps[1:]), gaps[0] * gaps[0]))


def irls(pairs: DataFrame, *, delta: float, rounds: int = 20, tolerance: float = 1e-9, with_scale: bool = True, weight: str | None = None):
    """Huber-reweighted fit: (transform, rounds).  Stops when the transform no longer changes."""
    base = F.lit(1.0) if weight is None else F.col(weight)
    m = fit(pairs, weight=base, with_scale=with_scale)
    for n in range(1, rounds + 1):
        far = residual(m)
        w = base * F.when(far <= delta, 1.0).otherwise(delta / far)
        new = fit(pairs, weight=w, with_scale=with_scale)
        change = abs(new[0] - m[0]) + np.abs(new[1] - m[1]).max() + np.abs(new[2] - m[2]).max()
        m = new
        if change < tolerance:
            break
    return m, n


def icp(source: DataFrame, target: DataFrame, *, radii: tuple[float, ...], rounds: int = 12, keep: float = 0.8, with_scale: bool = False, least: int = 50, still: float = 1e-6, start=linalg.IDENTITY):
    """Closest-point iteration of (id, x, y, z) clouds from ``start``: (transform, rms of the last round, pairs of the last round).

    For each radius, coarse to fine: nearest targets within it, the nearer
    ``keep`` share of them, a fit; until the step is ``still`` or too few
    pairs are left.  The source and the target's lists are written once; what a
    round finds goes when it ends.
    """
    total, rms, n = start, float("nan"), 0
    axes = ["x", "y", "z"]
    source = held(source.select("id", *axes), "icp")
    for radius in radii:
        listed = nearest.lists(target, axes, radius)
        for _ in range(rounds):
            placed = source.select("id", *(c.alias(a) for a, c in zip(axes, moved(total, tuple(axes)), strict=True)))
            near = nearest.nearest_listed(placed, listed, axes, radius).select(*(F.col(a).alias(s) for a, s in zip(axes, SOURCE, strict=True)), *(F.col(f"r_{a}").alias(t) for a, t in zip(axes, TARGET, strict=True)), "distance")
            with held_for(near, "icp-pairs") as near:
                cut = near.agg(F.max("distance") if keep >= 1 else F.percentile("distance", keep)).first()[0]
                if cut is None:
                    break
                pairs = near.filter(F.col("distance") <= cut)
                n, far = pairs.agg(F.count("*"), F.sqrt(F.avg(F.col("distance") * F.col("distance")))).first()
                if n < least:
                    break
                step, rms = fit(pairs, with_scale=with_scale), far
            total = linalg.compose(step, total)
            if np.linalg.norm(step[2]) < still:
                break
    return total, rms, n


def ransac(pairs: DataFrame, *, trials: int, size: int, inlier: float, seed: int = 42, with_scale: bool = True):
    """Seeded consensus: (transform, inliers).

    Each trial's subset is the next ``size`` of all pairs in the order of a
    seeded hash, so it is drawn from the whole table; every trial's transform is
    judged by its inliers among all pairs in one pass, and the best (most, then
    nearest) is refitted on these.  Without pairs: the identity and 0.
    """
    few = pairs.orderBy(F.xxhash64(F.lit(seed), *SOURCE, *TARGET), *SOURCE, *TARGET).limit(trials * size).select(*SOURCE, *TARGET).toPandas()
    if few.empty:
        return linalg.IDENTITY, 0
    x, y = few[list(SOURCE)].to_numpy(float), few[list(TARGET)].to_numpy(float)
    drawn = [np.arange(k * size, (k + 1) * size) % len(few) for k in range(trials)]
    models = [linalg.fit(x[k], y[k], with_scale=with_scale) for k in drawn]
    judged = pairs.agg(*(F.count_if(residual(m) <= inlier).alias(f"n{k}") for k, m in enumerate(models)), *(F.avg(F.when(residual(m) <= inlier, residual(m))).alias(f"e{k}") for k, m in enumerate(models))).first()
    best = max(range(trials), key=lambda k: (judged[f"n{k}"], -(judged[f"e{k}"] or 0)))
    inside = pairs.filter(residual(models[best]) <= inlier)
    return fit(inside, with_scale=with_scale), judged[f"n{best}"]


def rig_consensus(poses: DataFrame, by: list[str], *, centre_limit: float, angle_limit: float, least: int = 3) -> DataFrame:
    """Per capture the largest subset of its views that agrees on one rig pose.

    ``poses`` has view, yaw (degrees), centre (3) and rotation (9, row order).
    A subset's pose is the mean centre and the mean of the rotations turned
    back by their yaw; all members must be within both limits.  Of equal sizes
    the least normalised residual wins, then the first subset.  ``rig_centre``
    and ``rig_rotation`` are that pose (yaw taken out), null if there is none.
    """
    ship(poses.sparkSession)
    kinds = dict(poses.dtypes)

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("view")
        views, centres = pdf["view"].to_numpy(), np.array(pdf["centre"].to_list(), float)
        turned = []
        for yaw, m in zip(np.radians(pdf["yaw"].to_numpy(float)), pdf["rotation"], strict=True):
            c, s = np.cos(yaw), np.sin(yaw)
            turned.append(np.array(m, float).reshape(3, 3) @ np.array([[c, 0, s], [0, 1, 0], [-s, 0, c]]).T)
        turned = np.array(turned)
        best = None
        for size in range(len(views), least - 1, -1):
            for subset in combinations(range(len(views)), size):
                pick = list(subset)
                middle, mean = centres[pick].mean(0), linalg.mean_rotation(turned[pick])
                far = np.linalg.norm(centres[pick] - middle, axis=1)
                angle = np.array([linalg.angle_degrees(mean, turned[k]) for k in pick])
                if (far <= centre_limit).all() and (angle <= angle_limit).all():
                    score = round(float((far / centre_limit + angle / angle_limit).mean()), 12)
                    if best is None or score < best[0]:
                        best = (score, [int(views[k]) for k in pick], middle, mean)
            if best:
                break
        row = {c: pdf[c].iloc[0] for c in by} | {"accepted": best is not None, "inliers": best[1] if best else [], "score": best[0] if best else float("nan")}
        row |= {"rig_centre": best[2].tolist() if best else None, "rig_rotation": best[3].ravel().tolist() if best else None}
        return pd.DataFrame([row])

    schema = ", ".join(f"{c} {kinds[c]}" for c in by) + ", accepted boolean, inliers array<int>, score double, rig_centre array<double>, rig_rotation array<double>"
    return poses.groupBy(*by).applyInPandas(solve, schema)


def apply_rig(poses: DataFrame, verdict: DataFrame, by: list[str], *, action: str, reject: bool = False, conf: str = "conf") -> DataFrame:
    """The frames of ``rig_consensus`` after its verdict, with ``status``.

    Of an accepted group, views that do not agree are outliers: ``repair`` puts
    them at the rig pose (turned by their yaw), ``remove`` sets their
    confidence to 0, ``detect`` only says so.  Groups without a rig are
    ``unrecoverable``; with ``reject`` their confidence is 0.  Groups that the
    verdict lacks are ``unchecked``.
    """
    if action not in ("repair", "remove", "detect"):
        raise ValueError(f"unknown action {action}")
    joined = poses.join(verdict.select(*by, "accepted", "inliers", "rig_centre", "rig_rotation"), by, "left")
    outlier = F.col("accepted") & ~F.array_contains("inliers", F.col("view"))
    status = F.when(F.col("accepted").isNull(), "unchecked").when(~F.col("accepted"), "unrecoverable").when(outlier, {"repair": "repaired", "remove": "removed", "detect": "outlier"}[action]).otherwise("inlier")
    moved = outlier & F.lit(action == "repair")
    turned = pose.multiply(F.col("rig_rotation"), pose.rotation_about_y(F.radians(F.col("yaw"))))
    gone = (outlier & F.lit(action == "remove")) | (~F.col("accepted") & F.lit(reject))
    change = {"centre": F.when(moved, F.col("rig_centre")).otherwise(F.col("centre")), "rotation": F.when(moved, turned).otherwise(F.col("rotation")), conf: F.when(gone, 0.0).otherwise(F.col(conf))}
    return joined.select(*(change.get(c, F.col(c)).alias(c) for c in poses.columns), status.alias("status"))


def repair_gain(rows: DataFrame, by: list[str], *, raw: Column, repaired: Column, depth: Column, least: float = 1e-6) -> DataFrame:
    """Per group median and 90th percentile of the distances over the depth, before and after a repair, and whether the median got smaller.

    Quantiles are exact for groups of any size.  NaN is above all numbers, as
    ``percentile`` has it: in a group that has one, an infinite quantile is NaN.
    """
    part = lambda c: (c / depth).cast("double")
    good = rows.filter((depth > least) & raw.isNotNull() & repaired.isNotNull()).select(*by, part(raw).alias("raw"), part(repaired).alias("repaired"))
    good = held(good, "repair-gain")  # read by both quantiles and the counts
    got = good.groupBy(*by).agg(F.count("*").alias("n"), *(F.bool_or(F.isnan(c)).alias(f"nan_{c}") for c in ("raw", "repaired")))
    for c in ("raw", "repaired"):
        names = [f"{c}_median", f"{c}_p90"]
        found = quantiles.quantiles(good.withColumn(c, F.when(F.isnan(c), float("inf")).otherwise(F.col(c))), by, c, dict(zip(names, (0.5, 0.9), strict=True)))
        same = F.lit(True)
        for k in by:
            same &= F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
        nan = lambda x: F.when(F.col(f"a.nan_{c}") & (F.col(f"b.{x}") == float("inf")), float("nan")).otherwise(F.col(f"b.{x}")).alias(x)  # noqa: E731, B023
        got = got.alias("a").join(found.alias("b"), same).select("a.*", *map(nan, names))
    return got.drop("nan_raw", "nan_repaired").withColumn("better", F.col("repaired_median") < F.col("raw_median"))


def fit_by(pairs: DataFrame, by: list[str], *, weight: Column | None = None, with_scale: bool = True) -> DataFrame:
    """(by..., n, s, r, t): a fit of every group from its moments; only a row a group is solved outside the JVM."""
    ship(pairs.sparkSession)
    rows = moments_by(pairs, by, list(SOURCE), list(TARGET), weight)
    kinds = dict(rows.dtypes)
    cross = [f"x_{t}_{s}" for t in TARGET for s in SOURCE]

    def solve(frames):
        for f in frames:
            out = f[[*by, "n"]].copy()
            if len(f):
                mx, my, v, x = (f[c].to_numpy(float) for c in ([f"m_{c}" for c in SOURCE], [f"m_{c}" for c in TARGET], "v_source", cross))
                s, r, t = linalg.fits_from_moments(mx, my, v, x.reshape(-1, 3, 3), with_scale=with_scale)
            else:
                s, r, t = np.empty(0), np.empty((0, 3, 3)), np.empty((0, 3))
            out["s"], out["r"], out["t"] = s, list(r.reshape(-1, 9)), list(t)
            yield out

    schema = ", ".join(f"{c} {kinds[c]}" for c in (*by, "n")) + ", s double, r array<double>, t array<double>"
    return rows.mapInPandas(solve, schema)


def with_far(pairs: DataFrame, fits: DataFrame, by: list[str], name: str) -> DataFrame:
    """The pairs with how far their group's fit (s, r, t) takes the source from the target; numbers, not arrays, so that nothing is worked out again for each use."""
    one = fits.select(*(c for c in fits.columns if c not in ("s", "r", "t")), F.col("s").alias("__s"), *(F.get("r", F.lit(k)).alias(f"__r{k}") for k in range(9)), *(F.get("t", F.lit(k)).alias(f"__t{k}") for k in range(3)))
    turned = lambda k: sum((F.col(f"__r{3 * k + j}") * F.col(SOURCE[j]) for j in (1, 2)), F.col(f"__r{3 * k}") * F.col(SOURCE[0]))
    gaps = pairs.join(one, by).withColumns({f"__g{k}": F.col("__s") * turned(k) + F.col(f"__t{k}") - F.col(t) for k, t in enumerate(TARGET)})
    far = F.sqrt(F.col("__g0") * F.col("__g0") + F.col("__g1") * F.col("__g1") + F.col("__g2") * F.col("__g2"))
    return gaps.withColumn(name, far).drop("__s", *(f"__r{k}" for k in range(9)), *(f"__t{k}" for k in range(3)), *(f"__g{k}" for k in range(3)))


def irls_by(pairs: DataFrame, by: list[str], *, delta: float, rounds: int, weight: str = "weight", with_scale: bool = True) -> DataFrame:
    """(by..., n, s, r, t): ``fit_by``, then ``rounds`` more with Huber weights of what is left beyond ``delta``.

    A round's fits, one row a group, are written to the shared folder, so the
    next round reads them and does not work them out again.
    """
    found = fit_by(pairs, by, weight=F.col(weight), with_scale=with_scale)
    for _ in range(rounds):
        judged = with_far(pairs, held(found, "irls").select(*by, "s", "r", "t"), by, "__far")
        huber = F.col(weight) * F.when(F.col("__far") <= delta, 1.0).otherwise(delta / F.col("__far"))
        found = fit_by(judged, by, weight=huber, with_scale=with_scale)
    return found


def overlap_pairs(points: DataFrame, chunk: str, keys: list[str]) -> DataFrame:
    """(chunk, sx..., tx...): the points of chunk + 1 (source) with those of ``chunk`` (target) that share all keys, as the overlap of two windows does."""
    target = points.select(F.col(chunk).alias("chunk"), *keys, *(F.col(a).alias(t) for a, t in zip("xyz", TARGET, strict=True)))
    source = points.select((F.col(chunk) - 1).alias("chunk"), *keys, *(F.col(a).alias(s) for a, s in zip("xyz", SOURCE, strict=True)))
    return target.join(source, ["chunk", *keys])


def pair_errors(pairs: DataFrame, by: list[str], *, valid: Column) -> DataFrame:
    """Per group mean, population deviation, median and maximum of the distances of valid pairs; nulls and 0 pairs where none is valid."""
    gaps = [F.col(a) - F.col(b) for a, b in zip(SOURCE, TARGET, strict=True)]
    far = F.when(valid, F.sqrt(sum((g * g for g in gaps[1:]), gaps[0] * gaps[0])))
    return pairs.groupBy(*by).agg(F.count(far).alias("n"), F.avg(far).alias("mean"), F.stddev_pop(far).alias("std"), F.median(far).alias("median"), F.max(far).alias("max"))


def medoid_by(rotations: DataFrame, by: list[str], order: str, *, limit: float = 5.0, rounds: int = 3) -> DataFrame:
    """(by..., rotation, inliers): the medoid of each group's rotations refitted on those within ``limit`` degrees; inliers are in order.

    Equal rotations of a group are counted first, so only its different ones
    meet in a task, a block of them at a time.
    """
    ship(rotations.sparkSession)
    kinds = dict(rotations.dtypes)
    own = F.col("rotation").cast("array<double>")
    counted = rotations.groupBy(*by, own.alias("own")).agg(F.count("*").alias("n"), F.min(order).alias("first"))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("first")
        mean, inside = linalg.medoid_rotation(np.array(pdf["own"].to_list(), float).reshape(-1, 3, 3), counts=pdf["n"].to_numpy(), rounds=rounds, limit=limit)
        return pdf[[*by, "own"]].assign(mean=[mean.ravel().tolist()] * len(pdf), inside=inside)

    keys = ", ".join(f"{c} {kinds[c]}" for c in by)
    solved = counted.groupBy(*by).applyInPandas(solve, f"{keys}, own array<double>, mean array<double>, inside boolean")
    a, b = rotations.select(*by, order, own.alias("own")).alias("a"), solved.alias("b")
    on = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in (*by, "own")]
    joined = a.join(b, on).select(*(F.col(f"a.{c}").alias(c) for c in by), order, "mean", "inside")
    return joined.groupBy(*by).agg(F.first("mean").alias("rotation"), F.sort_array(F.collect_list(F.when(F.col("inside"), F.col(order)))).alias("inliers"))


def projected(rows: DataFrame, matrix: str, *, flip: bool = False) -> DataFrame:
    """The rows with ``matrix`` (nine numbers) replaced by the nearest rotation."""
    ship(rows.sparkSession)
    solve = linalg.flipped_rotation if flip else linalg.nearest_rotation

    @F.pandas_udf("array<double>")
    def nearest_of(m: pd.Series) -> pd.Series:
        return m.map(lambda x: None if x is None else solve(np.array(x, float).reshape(3, 3)).ravel().tolist())

    return rows.withColumn(matrix, nearest_of(matrix))


def homography_by(pairs: DataFrame, by: list[str], weight: str | None = None) -> DataFrame:
    """(by..., h): nine numbers, the last 1, that take (sx, sy) to (tx, ty) up to scale in weighted least squares.

    From the 8 x 8 normal equations, which are summed in the JVM; null where they are singular.
    """
    w = F.lit(1.0) if weight is None else F.col(weight)
    x, y, u, v = (F.col(c) for c in ("sx", "sy", "tx", "ty"))
    zero, one = F.lit(0.0), F.lit(1.0)
    first, second = [x, y, one, zero, zero, zero, -u * x, -u * y], [zero, zero, zero, x, y, one, -v * x, -v * y]
    sums = [F.sum(w * (first[i] * first[j] + second[i] * second[j])).alias(f"a{i}{j}") for i in range(8) for j in range(i, 8)]
    rows = pairs.groupBy(*by).agg(*sums, *(F.sum(w * (first[i] * u + second[i] * v)).alias(f"b{i}") for i in range(8)))
    kinds = dict(rows.dtypes)

    def solve(frames):
        for f in frames:
            found = []
            for _, r in f.iterrows():
                a = np.array([[r[f"a{min(i, j)}{max(i, j)}"] for j in range(8)] for i in range(8)], float)
                try:
                    found.append([*np.linalg.solve(a, np.array([r[f"b{i}"] for i in range(8)], float)).tolist(), 1.0])
                except np.linalg.LinAlgError:
                    found.append(None)
            yield f[by].assign(h=found)

    return rows.mapInPandas(solve, ", ".join(f"{c} {kinds[c]}" for c in by) + ", h array<double>")


def projected_by(h: Column, x: Column, y: Column) -> tuple[Column, Column]:
    """Where a homography (nine numbers) takes a point."""
    at = lambda k: F.get(h, F.lit(k))
    w = at(6) * x + at(7) * y + at(8)
    return (at(0) * x + at(1) * y + at(2)) / w, (at(3) * x + at(4) * y + at(5)) / w


def homography_error(h: Column) -> Column:
    """The distance from where (sx, sy) is taken to (tx, ty)."""
    u, v = projected_by(h, F.col("sx"), F.col("sy"))
    return F.sqrt((u - F.col("tx")) * (u - F.col("tx")) + (v - F.col("ty")) * (v - F.col("ty")))


def homography_consensus(pairs: DataFrame, by: list[str], key: str, *, inlier: float, weight: str | None = None, trials: int = 32, size: int = 6, refits: int = 3, seed: int = 42) -> DataFrame:
    """(by..., h, n_inliers, score): a weighted homography by random consensus.

    A trial is ``size`` rows, drawn without replacement in the order of seeded
    exponentials over the weights (heavier rows come sooner), so at most
    ``trials * size`` rows of a group are ever in one task.  All of a group's
    rows judge all trials in one aggregation; that with the greatest weight of
    inliers (then the first) is fitted again ``refits`` times in least squares,
    each time on the inliers of the fit before, and ``n_inliers`` and ``score``
    are those of the final fit.  Rows with a null
    coordinate or without a positive weight take no part; groups of fewer than
    ``size`` rows are left out.
    """
    ship(pairs.sparkSession)
    kinds = dict(pairs.dtypes)
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    rows = pairs.select(*by, F.col(key).alias("key"), "sx", "sy", "tx", "ty", w.alias("weight")).filter("weight > 0 and sx is not null and sy is not null and tx is not null and ty is not null")
    uniform = (F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("key").cast("string"))), 1, 12), 16, 10).cast("double") + 0.5) / float(16**12)
    turn = F.row_number().over(Window.partitionBy(*by).orderBy(-F.log("u") / F.col("weight"), "key"))
    drawn = rows.withColumn("u", uniform).withColumn("turn", turn).filter(F.col("turn") <= trials * size)

    def models(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("turn")
        x, y, u, v = (pdf[c].to_numpy(float) for c in ("sx", "sy", "tx", "ty"))
        found = []
        for k in range(min(trials, len(x) // size) if len(x) >= size else 0):
            at = slice(k * size, (k + 1) * size)
            o, z = np.ones(size), np.zeros(size)
            a = np.vstack([np.column_stack([x[at], y[at], o, z, z, z, -u[at] * x[at], -u[at] * y[at]]), np.column_stack([z, z, z, x[at], y[at], o, -v[at] * x[at], -v[at] * y[at]])])
            h, _, rank, _ = np.linalg.lstsq(a, np.r_[u[at], v[at]], rcond=None)
            if rank == 8:
                found.append((k, [*h.tolist(), 1.0]))
        out = pd.DataFrame(found, columns=["trial", "h"])
        for k, c in enumerate(by):
            out.insert(k, c, pdf[c].iloc[0])
        return out

    keys = ", ".join(f"{c} {kinds[c]}" for c in by)
    tried = drawn.groupBy(*by).applyInPandas(models, f"{keys}, trial int, h array<double>")
    lists = tried.groupBy(*by).agg(F.collect_list(F.struct("trial", "h")).alias("models"))  # ``trials`` of them
    judged = rows.join(lists, by).select(*by, "sx", "sy", "tx", "ty", "weight", F.explode("models").alias("m"))
    votes = judged.groupBy(*by, F.col("m.trial").alias("trial")).agg(F.sum(F.when(homography_error(F.col("m.h")) <= inlier, F.col("weight"))).alias("votes"), F.first("m.h").alias("h"))
    best = votes.filter("votes is not null").groupBy(*by).agg(F.max_by("h", F.struct("votes", -F.col("trial"))).alias("first"))
    rows, fits = held(rows, "homography"), held(best.withColumnRenamed("first", "h"), "homography")
    for _ in range(refits):
        inside = rows.join(fits, by).filter(homography_error(F.col("h")) <= inlier)
        fits = held(homography_by(inside, by, "weight").filter("h is not null"), "homography")
    final = rows.join(fits, by).filter(homography_error(F.col("h")) <= inlier)
    return final.groupBy(*by).agg(F.first("h").alias("h"), F.count("*").alias("n_inliers"), F.sum("weight").alias("score"))
