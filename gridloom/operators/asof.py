"""Joins and measures on time series.

The as-of joins are one union of both sides and windows over each series: one
shuffle on the series' keys, a sort, no range join.  Stamps are longs (any
unit); ``order`` breaks ties among equal stamps.  A series without rows on the
other side gets nulls, an empty table an empty result; rows with a null key
make a series of their own.
"""

from __future__ import annotations


import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions import pose


def _around(left: DataFrame, right: DataFrame, by: list[str], ts: str, order: str, carry: list[str]) -> DataFrame:
    """Left rows with structs ``prior`` (ts <= own) and ``later`` (ts >= own) of the right."""
    row = F.struct(ts, order, *carry)
    kept = [c for c in left.columns if c not in by and c != ts]
    ls = left.select(*by, F.col(ts), F.struct(*kept).alias("own"), F.lit(None).cast(right.select(row).schema[0].dataType).alias("theirs"))
    rs = right.select(*by, F.col(ts), F.lit(None).cast(left.select(F.struct(*kept)).schema[0].dataType).alias("own"), row.alias("theirs"))
    both = ls.unionByName(rs)
    is_left = F.col("theirs").isNull().cast("int")
    # rights come before a left of their stamp going forward, and after it going backward
    forward = Window.partitionBy(*by).orderBy(ts, is_left, F.col(f"theirs.{order}")).rowsBetween(Window.unboundedPreceding, 0)
    backward = Window.partitionBy(*by).orderBy(F.desc(ts), is_left, F.desc(f"theirs.{order}")).rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumns({"prior": F.last("theirs", True).over(forward), "later": F.last("theirs", True).over(backward)})
    return seen.filter("theirs is null").select(*by, ts, "own.*", "prior", "later")


def backward(left: DataFrame, right: DataFrame, by: list[str], *, ts: str = "ts", order: str, carry: list[str]) -> DataFrame:
    """Every left row with the last right row of its series at or before it (the greatest ``order`` among equals), or nulls."""
    seen = _around(left, right, by, ts, order, carry)
    return seen.select(*left.columns, F.col(f"prior.{ts}").alias(f"r_{ts}"), F.col(f"prior.{order}").alias(f"r_{order}"), *(F.col(f"prior.{c}").alias(f"r_{c}") for c in carry))


def nearest(left: DataFrame, right: DataFrame, by: list[str], *, ts: str = "ts", order: str, carry: list[str], within: int | None = None) -> DataFrame:
    """Every left row with the right row nearest in time; the earlier one on a tie; nulls beyond ``within``."""
    seen = _around(left, right, by, ts, order, carry)
    to_prior, to_later = F.col(ts) - F.col(f"prior.{ts}"), F.col(f"later.{ts}") - F.col(ts)
    pick = F.when(F.col("later").isNull() | (to_prior <= to_later), F.col("prior")).otherwise(F.col("later"))
    seen = seen.withColumn("near", pick)
    if within is not None:
        seen = seen.withColumn("near", F.when(F.abs(F.col(f"near.{ts}") - F.col(ts)) <= within, F.col("near")))
    return seen.select(*left.columns, F.col(f"near.{ts}").alias(f"r_{ts}"), F.col(f"near.{order}").alias(f"r_{order}"), *(F.col(f"near.{c}").alias(f"r_{c}") for c in carry))


def interpolate(left: DataFrame, right: DataFrame, by: list[str], *, ts: str = "ts", order: str, value: str, max_gap: int, clamp: bool = False) -> DataFrame:
    """Every left row with ``value`` of the right interpolated between its neighbours.

    An exact stamp gives its own value; else both neighbours must exist and be
    at most ``max_gap`` apart, or the result is null.  With ``clamp``, rows
    before the first or after the last stamp take that one's value.
    """
    seen = _around(left, right, by, ts, order, [value])
    span = F.col(f"later.{ts}") - F.col(f"prior.{ts}")
    part = (F.col(ts) - F.col(f"prior.{ts}")) / F.when(span > 0, span)
    a, b = F.col(f"prior.{value}"), F.col(f"later.{value}")
    got = F.when(F.col(f"prior.{ts}") == F.col(ts), a).when(span <= max_gap, a + part * (b - a))
    if clamp:
        got = got.when(F.col("later").isNull(), a).when(F.col("prior").isNull(), b)
    return seen.select(*left.columns, got.alias("interpolated"))


def interpolate_rotation(left: DataFrame, right: DataFrame, by: list[str], *, ts: str = "ts", order: str, rotation: str) -> DataFrame:
    """Every left row with the right's unit quaternions (w, x, y, z) interpolated by slerp between its neighbours; null where one is missing."""
    seen = _around(left, right, by, ts, order, [rotation])
    span = F.col(f"later.{ts}") - F.col(f"prior.{ts}")
    part = F.when(span > 0, (F.col(ts) - F.col(f"prior.{ts}")) / span).otherwise(0.0)
    got = F.when(F.col(f"prior.{ts}") == F.col(ts), F.col(f"prior.{rotation}")).when(F.col("prior").isNotNull() & F.col("later").isNotNull(), pose.slerp(F.col(f"prior.{rotation}"), F.col(f"later.{rotation}"), part))
    return seen.select(*left.columns, got.alias("interpolated"))


def coverage(matched: DataFrame, by: list[str], *, value: str, score: Column, least: float) -> DataFrame:
    """Per series: rows, matched rows, coverage, and the score, which is 0 where coverage is below ``least``."""
    sums = matched.groupBy(*by).agg(F.count("*").alias("n"), F.count(value).alias("n_matched"), score.alias("raw_score"))
    share = F.col("n_matched") / F.col("n")
    return sums.select(*by, "n", "n_matched", share.alias("coverage"), F.when(share >= least, F.col("raw_score")).otherwise(0.0).alias("score"))


def path_length(rows: DataFrame, by: list[str], *, order: list[str], at: list[str]) -> DataFrame:
    """Per series the number of points and the sum of distances between consecutive ones."""
    w = Window.partitionBy(*by).orderBy(*order)
    steps = [F.col(c) - F.lag(c).over(w) for c in at]
    step = F.sqrt(sum((s * s for s in steps[1:]), steps[0] * steps[0]))
    return rows.select(*by, step.alias("step")).groupBy(*by).agg(F.count("*").alias("n"), F.coalesce(F.sum("step"), F.lit(0.0)).alias("length"))


def pair_at_horizon(rows: DataFrame, by: list[str], *, ts: str, order: str, value: str, horizon: int, tolerance: int) -> DataFrame:
    """Every row with the one of its series nearest to ts + horizon: later than itself, within ``tolerance``, the earlier on a tie."""
    ahead = rows.select(*by, (F.col(ts) + horizon).alias(ts), F.col(order).alias("from_order"), F.col(ts).alias("from_ts"), F.col(value).alias("from_value"))
    got = nearest(ahead, rows, by, ts=ts, order=order, carry=[value], within=tolerance)
    return got.filter((F.col(f"r_{ts}") > F.col("from_ts"))).select(*by, "from_order", "from_ts", "from_value", f"r_{ts}", f"r_{order}", f"r_{value}")


def greedy_sync(rows: DataFrame, by: list[str], *, ts: str, order: str, topic: str, first: str, second: str, tolerance: int) -> DataFrame:
    """Two cursors over two topics of a series: match if at most ``tolerance`` apart, else advance the earlier one.

    A match depends on all before it, so a series is walked in order; it is
    streamed through ``applyInPandas`` one series at a time.
    """
    kinds = dict(rows.dtypes)
    keys = ", ".join(f"{c} {kinds[c]}" for c in by)

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = (pdf[pdf[topic] == t].sort_values([ts, order]) for t in (first, second))
        ta, tb, ia, ib = a[ts].to_numpy(), b[ts].to_numpy(), a[order].to_numpy(), b[order].to_numpy()
        i = j = 0
        out = []
        while i < len(ta) and j < len(tb):
            gap = int(ta[i]) - int(tb[j])
            if abs(gap) <= tolerance:
                out.append((ia[i], ib[j], gap))
                i, j = i + 1, j + 1
            elif gap < 0:
                i += 1
            else:
                j += 1
        got = pd.DataFrame(out, columns=["a", "b", "gap"])
        for k, c in enumerate(by):
            got.insert(k, c, pdf[c].iloc[0])
        return got

    return rows.groupBy(*by).applyInPandas(walk, f"{keys}, a {kinds[order]}, b {kinds[order]}, gap long")


def slot_sync(rows: DataFrame, by: list[str], *, ts: str, order: str, topic: str, first: str, second: str, tolerance: int) -> DataFrame:
    """One slot a topic: a newer message replaces an unpaired one, and both slots empty on a match.

    It can pair otherwise than ``greedy_sync``, which drops the earlier cursor.
    """
    kinds = dict(rows.dtypes)
    keys = ", ".join(f"{c} {kinds[c]}" for c in by)

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        slots: dict[str, tuple] = {}
        out = []
        for t, k, name in pdf.sort_values([ts, order])[[ts, order, topic]].itertuples(index=False):
            if name in (first, second):
                slots[name] = (t, k)
                if len(slots) == 2 and abs(slots[first][0] - slots[second][0]) <= tolerance:
                    out.append((slots[first][1], slots[second][1], int(slots[first][0] - slots[second][0])))
                    slots.clear()
        got = pd.DataFrame(out, columns=["a", "b", "gap"])
        for k, c in enumerate(by):
            got.insert(k, c, pdf[c].iloc[0])
        return got

    return rows.groupBy(*by).applyInPandas(walk, f"{keys}, a {kinds[order]}, b {kinds[order]}, gap long")


def ema(rows: DataFrame, by: list[str], *, ts: str, order: str, value: str, tau: float, unit: float = 1e6) -> DataFrame:
    """Causal low-pass with a variable step: alpha = 1 - exp(-dt / tau), dt in seconds and at least 1e-6.

    A sequential fold, so each series is walked in order (``unit`` stamps a
    second).  A null or NaN value changes nothing: its row holds the level
    before it, which is null at a series' begin.
    """
    import math

    kinds = dict(rows.dtypes)

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([ts, order])
        out, state, last = [], None, None
        for t, v in zip(pdf[ts], pdf[value], strict=True):
            if v is not None and v == v:
                if state is None:
                    state = v
                else:
                    state += (1 - math.exp(-max((t - last) / unit, 1e-6) / tau)) * (v - state)
                last = t
            out.append(state)
        return pdf[[*by, ts, order]].assign(smooth=pd.Series(out, index=pdf.index, dtype="float64"))

    schema = ", ".join(f"{c} {kinds[c]}" for c in (*by, ts, order)) + ", smooth double"
    return rows.select(*by, ts, order, value).groupBy(*by).applyInPandas(fold, schema)


def nearest_within(left: DataFrame, right: DataFrame, by: list[str], *, ts: str = "ts", order: str, carry: list[str], within: int, width: int) -> DataFrame:
    """``nearest`` with a bound, cut along time: a long series is many tasks' work.

    Series are cut into slices of ``width`` (at least ``within``) and right rows
    go to every slice that a left row within reach can be in, two at most; the
    result is that of ``nearest``.  Left rows without a stamp match nothing.
    """
    width, cut = max(width, within, 1), "__slice"
    of = lambda c: F.floor(c / F.lit(width))
    reach = F.array_distinct(F.array(of(F.col(ts) - within), of(F.col(ts)), of(F.col(ts) + within)))
    sliced = left.withColumn(cut, of(F.col(ts)))
    copied = right.filter(F.col(ts).isNotNull()).withColumn(cut, F.explode(reach))
    return nearest(sliced, copied, [*by, cut], ts=ts, order=order, carry=carry, within=within).drop(cut)


def silences(rows: DataFrame, by: list[str], *, ts: str, order: str, limit: int, width: int) -> DataFrame:
    """(by..., longest_us, n_silent): the longest gap between consecutive rows of a series, and how many exceed ``limit``.

    Gaps are taken within slices of ``width`` first and then between the slices
    that have rows, so no task sees a whole series row by row.  A series of one
    row has a null longest gap; rows without a stamp are left out.
    """
    cut = F.floor(F.col(ts) / F.lit(width)).alias("__slice")
    inner = Window.partitionBy(*by, "__slice").orderBy(ts, order)
    gap = F.col(ts) - F.lag(ts).over(inner)
    each = rows.filter(F.col(ts).isNotNull()).select(*by, ts, order, cut).withColumn("__gap", gap)
    part = each.groupBy(*by, "__slice").agg(F.min(ts).alias("__from"), F.max(ts).alias("__to"), F.max("__gap").alias("__gap"), F.count_if(F.col("__gap") > limit).alias("__n"))
    between = F.col("__from") - F.lag("__to").over(Window.partitionBy(*by).orderBy("__slice"))
    joined = part.withColumn("__between", between)
    return joined.groupBy(*by).agg(F.max(F.greatest("__gap", "__between")).alias("longest_us"), (F.sum("__n") + F.count_if(F.col("__between") > limit)).alias("n_silent"))
