"""Summaries over runs and methods, pairs of frames, and ordered helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def capture_centres(rows: DataFrame, by: list[str], dims: list[str], *, view: str, primary: int) -> DataFrame:
    """Per capture the componentwise median centre, the largest distance from it, and the view that orients it.

    That is the primary view if it is there, else the first one.
    """
    middle = rows.groupBy(*by).agg(*(F.percentile(d, 0.5).alias(f"c_{d}") for d in dims), F.count("*").alias("n_views"), F.coalesce(F.max(F.when(F.col(view) == primary, F.col(view))), F.min(view)).alias("oriented_by"))
    squares = [(F.col(d) - F.col(f"c_{d}")) * (F.col(d) - F.col(f"c_{d}")) for d in dims]
    far = rows.join(middle, by).groupBy(*by).agg(F.max(F.sqrt(sum(squares[1:], squares[0]))).alias("spread"))
    return middle.join(far, by)


def paired(rows: DataFrame, key: str, method: str, value: str, first: str, second: str) -> DataFrame:
    """One row: runs where both methods have a value, means, and how often the first wins, ties and loses (less is better)."""
    pick = lambda m: F.max(F.when(F.col(method) == m, F.col(value)))
    both = rows.groupBy(key).agg(pick(first).alias("a"), pick(second).alias("b")).filter("a is not null and b is not null")
    return both.agg(
        F.count("*").alias("n"), F.avg("a").alias("mean_first"), F.avg("b").alias("mean_second"),
        F.count_if(F.col("a") < F.col("b")).alias("wins"), F.count_if(F.col("a") == F.col("b")).alias("ties"), F.count_if(F.col("a") > F.col("b")).alias("losses"),
    )


def selective_mean(rows: DataFrame, dataset: str, aliases: list[str], exclude: list[str] | None = None) -> DataFrame:
    """One row: the mean over datasets of the first of several columns that has a value; some datasets left out."""
    value = F.coalesce(*(F.col(a) for a in aliases))
    kept = rows.filter(~F.col(dataset).isin(exclude)) if exclude else rows
    return kept.agg(F.avg(value).alias("mean"), F.count(value).alias("n"))


def all_rejected(rows: DataFrame, by: list[str], accepted: str) -> DataFrame:
    """Per group whether none of its rows was accepted (null counts as rejected)."""
    return rows.groupBy(*by).agg((~F.max(F.coalesce(F.col(accepted), F.lit(False)))).alias("all_rejected"))


def neighbour_pairs(rows: DataFrame, by: list[str], index: str, reach: int, least: int = 1) -> DataFrame:
    """(by..., i, j): pairs of a group's frames with least <= j - i <= reach; each frame makes ``reach`` rows, none is paired with all."""
    ahead = rows.select(*by, F.col(index).alias("i"), F.explode(F.sequence(F.col(index) + least, F.col(index) + reach)).alias("j"))
    there = rows.select(*by, F.col(index).alias("j")).distinct()
    return ahead.join(there, [*by, "j"], "left_semi").select(*by, "i", "j")


def half_window(index: Column, half: int, total: int) -> Column:
    """struct(start, end) of a range of up to 2 * half around an index, moved inside 0 .. total."""
    start = F.greatest(F.lit(0), F.least(index - half, F.lit(total - 2 * half)))
    return F.struct(start.cast("long").alias("start"), F.least(start + 2 * half, F.lit(total)).cast("long").alias("end"))


def progress(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The rows with ``fraction``: rank / (n - 1) within their group, 0 for one row."""
    w = Window.partitionBy(*by).orderBy(*order)
    n = F.count("*").over(Window.partitionBy(*by))
    return rows.withColumn("fraction", F.when(n > 1, (F.row_number().over(w) - 1) / (n - 1)).otherwise(0.0))


def hold_last(rows: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """Values that are null, NaN or infinite take the last good one before them in their series."""
    good = F.when(~F.isnan(value) & (F.abs(F.col(value)) < float("inf")), F.col(value))
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(value, F.last(good, True).over(w))


def best_and_worst(rows: DataFrame, key: str, measures: dict[str, bool]) -> DataFrame:
    """(key, best, worst): names of a row's greatest and least measure; a measure that is better low counts negated."""
    signed = [F.struct((F.col(m) if high else -F.col(m)).cast("double").alias("v"), F.lit(m).alias("name")) for m, high in measures.items()]
    return rows.select(key, F.array_max(F.array(*signed))["name"].alias("best"), F.array_min(F.array(*signed))["name"].alias("worst"))


def by_dataset(rows: DataFrame, key: str, *, last: bool = False) -> DataFrame:
    """The rows with ``dataset`` and ``mode``: the key split at its first underscore, or at its last."""
    at = r"^(.*)_([^_]*)$" if last else r"^([^_]*)_(.*)$"
    return rows.select("*", F.regexp_extract(key, at, 1).alias("dataset"), F.regexp_extract(key, at, 2).alias("mode"))
