"""Streaming twins: exact-stamp topic pairs, causal smoothing, the event log, and the watch for silence."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def exact_pairs(left: DataFrame, right: DataFrame, by: list[str], *, ts: str, late: str) -> DataFrame:
    """Rows of two topics with one stamp: a stream-stream join whose state the watermark bounds."""
    a = left.withWatermark(ts, late).alias("a")
    b = right.withWatermark(ts, late).alias("b")
    on = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in (*by, ts)]
    condition = on[0]
    for c in on[1:]:
        condition &= c
    rest = [c for c in right.columns if c not in (*by, ts)]
    return a.join(b, condition).select("a.*", *(F.col(f"b.{c}").alias(f"r_{c}") for c in rest))


def smooth(rows: DataFrame, by: list[str], *, ts: str, order: str, value: str, tau: float) -> DataFrame:
    """The causal low-pass with a variable step: its state is two numbers a series, kept from batch to batch.

    ``ts`` is in microseconds; rows of a batch are taken in (ts, order).
    """
    kinds = dict(rows.dtypes)
    keys = ", ".join(f"{c} {kinds[c]}" for c in by)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        level, last = state.get if state.exists else (None, None)
        pdf = pd.concat(list(frames), ignore_index=True).sort_values([ts, order])
        out = []
        for t, v in zip(pdf[ts], pdf[value], strict=True):
            if v is not None and v == v:  # others hold the level
                level = v if level is None else level + (1 - math.exp(-max((t - last) / 1e6, 1e-6) / tau)) * (v - level)
                last = t
            out.append(level)
        if level is not None:
            state.update((float(level), int(last)))
        yield pdf[[*by, ts, order]].assign(smooth=pd.Series(out, index=pdf.index, dtype="float64"))

    return rows.groupBy(*by).applyInPandasWithState(step, f"{keys}, {ts} {kinds[ts]}, {order} {kinds[order]}, smooth double", "level double, last long", "append", GroupStateTimeout.NoTimeout)


def silent_windows(rows: DataFrame, *, ts: str, window: str, late: str, least: int) -> DataFrame:
    """(start, end, n, silent): rows in each window once it is over; fewer than ``least`` is silence."""
    counted = rows.withWatermark(ts, late).groupBy(F.window(ts, window)).agg(F.count("*").alias("n"))
    return counted.select("window.start", "window.end", "n", (F.col("n") < least).alias("silent"))


def log_events(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append to a table of events, each once, whatever restarts there are."""
    return rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def distinct_events(rows: DataFrame, keys: list[str], *, ts: str, late: str) -> DataFrame:
    """The first event of each key within the watermark."""
    return rows.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)
