"""Error statistics, thresholds, robust estimates and report shaping, as grouped aggregations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.operators import quantiles


def error_stats(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """n, mean, median, population deviation, percentiles (linear), max and rmse of a column."""
    v = F.col(value)
    sums = rows.groupBy(*by).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.max(v).alias("max"), F.sqrt(F.avg(v * v)).alias("rmse"))
    cuts = quantiles.quantiles(rows, by, value, {"median": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99})
    both = sums.join(cuts, by, "left") if by else sums.join(F.broadcast(cuts), how="left")  # one row
    return both.select(*by, "n", "mean", "median", "std", "p90", "p95", "p99", "max", "rmse")


def trimmed_rmse(rows: DataFrame, by: list[str], value: str, quantile: float) -> DataFrame:
    """Root mean square of the values at or below their group's linear quantile; null for none."""
    kept = quantiles.with_quantiles(rows, by, value, {"cut": quantile}).filter(F.col(value) <= F.col("cut"))
    return kept.groupBy(*by).agg(F.sqrt(F.avg(F.col(value) * F.col(value))).alias("trimmed_rmse"), F.count("*").alias("n_kept"))


def prf(rows: DataFrame, thresholds: list[float], *, side: str, value: str, found: str, truth: str) -> DataFrame:
    """Precision (of ``found`` distances), recall (of ``truth`` distances) and F score under each threshold, strictly."""
    flagged = rows.select(side, value, F.explode(F.array(*(F.lit(float(t)) for t in thresholds))).alias("threshold"))
    share = lambda s: F.avg(F.when(F.col(side) == s, (F.col(value) < F.col("threshold")).cast("double")))
    got = flagged.groupBy("threshold").agg(share(found).alias("precision"), share(truth).alias("recall"))
    both = F.col("precision") + F.col("recall")
    return got.withColumn("fscore", F.when(both > 0, 2 * F.col("precision") * F.col("recall") / both).otherwise(0.0))


def error_auc(rows: DataFrame, by: list[str], value: str, bins: int) -> DataFrame:
    """Mean over unit bins [0, 1), ..., the last closed, of the cumulative share of errors."""
    n = F.count("*")
    inside = [F.count_if((F.col(value) >= 0) & ((F.col(value) < k + 1) if k + 1 < bins else (F.col(value) <= bins))) / n for k in range(bins)]
    return rows.groupBy(*by).agg((reduce(lambda a, b: a + b, inside) / bins).alias("auc"), n.alias("n"))


def weighted_quantile(rows: DataFrame, by: list[str], value: str, weight: str, q: float, tie: list[str]) -> DataFrame:
    """The first value, in order, where the cumulative weight reaches q of the total."""
    w = Window.partitionBy(*by).orderBy(value, *tie)
    seen = rows.select(*by, value, F.sum(weight).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("seen"), F.sum(weight).over(Window.partitionBy(*by)).alias("total"))
    return seen.filter(F.col("seen") >= q * F.col("total")).groupBy(*by).agg(F.min(value).alias("quantile"))


def huber(residual: Column, delta: float) -> tuple[Column, Column]:
    """(weight, loss): quadratic up to delta, linear beyond."""
    a = F.abs(residual)
    return F.when(a <= delta, F.lit(1.0)).otherwise(F.lit(delta) / a), F.when(a <= delta, residual * residual / 2).otherwise(delta * (a - delta / 2))


def least_squares_scale(rows: DataFrame, by: list[str], a: str, b: str, eps: float = 1e-12) -> DataFrame:
    """The scalar s that minimises (a - s b) squared: sum(ab) / max(sum(bb), eps)."""
    return rows.groupBy(*by).agg((F.sum(F.col(a) * F.col(b)) / F.greatest(F.sum(F.col(b) * F.col(b)), F.lit(eps))).alias("scale"))


def min_max_choice(rows: DataFrame, by: list[str], item: str, measures: list[str]) -> DataFrame:
    """Per group the item whose min-max normalised measures lie nearest to 0.5 in sum, the smallest item on a tie."""
    over = Window.partitionBy(*by)
    far = lambda c: F.abs((F.col(c) - F.min(c).over(over)) / (F.max(c).over(over) - F.min(c).over(over) + 1e-8) - 0.5)
    scored = rows.select(*by, item, F.round(reduce(lambda a, b: a + b, [far(c) for c in measures]), 9).alias("score"))
    return scored.groupBy(*by).agg(F.min(F.struct("score", item)).alias("best")).select(*by, F.col(f"best.{item}").alias(item), F.col("best.score").alias("score"))


def median_reject(rows: DataFrame, group: list[str], block: list[str], value: str, limit: float) -> DataFrame:
    """Rows with their distance from the group's median, whether it is beyond the limit, and whether the block is rejected.

    A block is rejected if the median of its groups' greatest distances is beyond the limit.
    """
    centre = rows.groupBy(*block, *group).agg(F.percentile(value, 0.5).alias("centre"))
    far = rows.join(centre, [*block, *group]).withColumn("distance", F.abs(F.col(value) - F.col("centre")))
    worst = far.groupBy(*block, *group).agg(F.max("distance").alias("worst")).groupBy(*block).agg((F.percentile("worst", 0.5) > limit).alias("block_rejected"))
    return far.join(worst, block).withColumn("rejected", F.col("distance") > limit)


def gate(checks: dict[str, Column]) -> tuple[Column, Column]:
    """(accepted, reasons): all checks must hold; the names of those that don't, in order, joined by semicolons; null and NaN fail."""
    held = {name: F.coalesce(ok, F.lit(False)) for name, ok in checks.items()}
    reasons = F.concat_ws(";", *(F.when(~ok, F.lit(name)) for name, ok in held.items()))
    return reduce(lambda a, b: a & b, held.values()), reasons


def with_mean_row(rows: DataFrame, name: str, measures: list[str], label: str = "mean") -> DataFrame:
    """The rows and one more that holds the mean of every measure."""
    mean = rows.agg(*(F.avg(c).alias(c) for c in measures)).select(F.lit(label).alias(name), *measures)
    return rows.select(name, *measures).unionByName(mean)


def consensus_scale(rows: DataFrame, by: list[str], key: str, a: str, b: str, *, trials: int, inlier: float, seed: int = 42) -> DataFrame:
    """(by..., scale, n_inliers): a = s b through the origin by random consensus.

    The candidates of a group are the ratios of its first ``trials`` usable rows
    in the order of a seeded hash; that with the most inliers (|a - s b| <=
    inlier; then the smallest) is refitted by least squares on these.
    """
    usable = rows.filter(F.abs(F.col(b)) > 1e-12).select(*by, key, a, b)
    rank = F.struct(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string"))).alias("h"), (F.col(a) / F.col(b)).alias("s"))
    first = usable.withColumn("__k", F.row_number().over(Window.partitionBy(*by).orderBy(rank["h"], key))).filter(F.col("__k") <= trials)
    drawn = first.groupBy(*by).agg(F.collect_list(F.col(a) / F.col(b)).alias("candidates"))
    tried = usable.join(drawn, by).select(*by, a, b, F.explode("candidates").alias("s"))
    good = F.abs(F.col(a) - F.col("s") * F.col(b)) <= inlier
    counted = tried.groupBy(*by, "s").agg(F.count_if(good).alias("n"), F.sum(F.when(good, F.col(a) * F.col(b))).alias("ab"), F.sum(F.when(good, F.col(b) * F.col(b))).alias("bb"))
    best = counted.groupBy(*by).agg(F.max(F.struct("n", (-F.col("s")).alias("minus"), "ab", "bb")).alias("best"))
    return best.select(*by, F.coalesce(F.col("best.ab") / F.nullif(F.col("best.bb"), F.lit(0.0)), -F.col("best.minus")).alias("scale"), F.col("best.n").alias("n_inliers"))


def sampled_quantile(rows: DataFrame, by: list[str], key: str, value: str, q: float, *, share: float, seed: int) -> DataFrame:
    """A quantile over about that share of the rows; a row's fate depends on its key alone."""
    from gridloom.operators.sampling import ratio

    return ratio(rows, [key], share, seed=seed).groupBy(*by).agg(F.percentile(value, q).alias("quantile"), F.count(value).alias("n"))


def clean_report(before: DataFrame, after: DataFrame, dims: list[str]) -> DataFrame:
    """One row: points before and after a cleaning, the share kept, and the bounds of what is left."""
    left = after.agg(F.count("*").alias("n_after"), *(f(d).alias(f"{n}_{d}") for d in dims for n, f in (("lo", F.min), ("hi", F.max))))
    total = before.agg(F.count("*").alias("n_before"))
    return total.crossJoin(F.broadcast(left)).withColumn("kept", F.col("n_after") / F.nullif(F.col("n_before"), F.lit(0)))
