"""Row predicates: crops, half-spaces, ranges, lists, masks by quantile.  All are filters that Spark pushes down where it can."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.operators import quantiles


def finite(rows: DataFrame, cols: list[str]) -> DataFrame:
    """Rows whose coordinates are all there, numbers and finite."""
    ok = F.lit(True)
    for c in cols:
        ok &= F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf"))
    return rows.filter(ok)


def inside_box_of(rows: DataFrame, reference: DataFrame, dims: list[str], margin: float) -> DataFrame:
    """Rows inside the reference's bounding box, widened by the margin, edges included; the box is one row."""
    box = reference.agg(*(F.min(d).alias(f"lo_{d}") for d in dims), *(F.max(d).alias(f"hi_{d}") for d in dims)).first()
    ok = F.lit(True)
    for d in dims:
        ok &= F.col(d).between(box[f"lo_{d}"] - margin, box[f"hi_{d}"] + margin)
    return rows.filter(ok)


def half_space(rows: DataFrame, plane: tuple[float, float, float, float]) -> DataFrame:
    """Rows with plane . (x, y, z, 1) > 0."""
    a, b, c, d = plane
    return rows.filter(a * F.col("x") + b * F.col("y") + c * F.col("z") + d > 0)


def observed(rows: DataFrame, seen: DataFrame, dims: list[str], cell: float) -> DataFrame:
    """Rows whose cell is among the observed ones (columns v_<dim>)."""
    keyed = rows.select("*", *(F.floor(F.col(d) / cell).cast("long").alias(f"v_{d}") for d in dims))
    keys = [f"v_{d}" for d in dims]
    return keyed.join(seen.select(*keys).distinct(), keys, "left_semi").select(*rows.columns)


def time_range(rows: DataFrame, ts: str, start: int = 0, end: int = 0) -> DataFrame:
    """Stamps from start to end, both included; 0 leaves a side open."""
    ok = F.lit(True)
    if start:
        ok &= F.col(ts) >= start
    if end:
        ok &= F.col(ts) <= end
    return rows.filter(ok)


def listed(rows: DataFrame, column: str, include: list | None = None, exclude: list | None = None) -> DataFrame:
    """In the one list and not in the other; an empty or missing list is off.  Unknown names of ``include`` raise."""
    out = rows
    if include:
        known = {r[0] for r in rows.filter(F.col(column).isin(include)).select(column).distinct().collect()}
        if missing := sorted(set(include) - known, key=str):
            raise KeyError(f"not there: {missing}")
        out = out.filter(F.col(column).isin(include))
    return out.filter(~F.col(column).isin(exclude)) if exclude else out


def denied(name: Column, endings: list[str]) -> Column:
    """Whether a name ends with any of these."""
    bad = F.lit(False)
    for e in endings:
        bad |= name.endswith(e)
    return bad


def alignment_mask(rows: DataFrame, by: list[str], *, conf: str, sky: str, depth: str, metric: str, least: float = 1e-3) -> DataFrame:
    """Rows of at least their group's median confidence, not sky (sky < 0.3), with both depths above the least."""
    marked = quantiles.with_quantiles(rows, by, conf, {"__mid": 0.5})
    ok = (F.col(conf) >= F.col("__mid")) & (F.col(sky) < 0.3) & (F.col(depth) > least) & (F.col(metric) > least)
    return marked.filter(ok).select(*rows.columns)


def fill_sky(depth: Column, conf: Column, sky: Column, far: Column) -> Column:
    """struct(depth, conf): the farthest depth and confidence 1 where it is sky."""
    is_sky = sky >= 0.3
    return F.struct(F.when(is_sky, far).otherwise(depth).alias("depth"), F.when(is_sky, 1.0).otherwise(conf).alias("conf"))
