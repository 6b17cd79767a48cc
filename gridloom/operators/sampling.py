"""Deterministic sharding and sampling.  Where a limit is the feature, the order that decides is a hash of the key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.operators import quantiles


def modulo_shard(rows: DataFrame, index: str, workers: int, worker: int) -> DataFrame:
    return rows.filter(F.col(index) % workers == worker)


def stride(rows: DataFrame, index: Column, step: int) -> DataFrame:
    """Rows 0, step, 2 step, ..."""
    return rows.filter(index % step == 0)


def counted(rows: DataFrame, index: Column, step: int) -> DataFrame:
    """Rows step - 1, 2 step - 1, ...: every step-th where the first is counted as 1."""
    return rows.filter((index + 1) % step == 0)


def frame_rate(rows: DataFrame, index: str, fps_in: float, fps_out: float) -> DataFrame:
    """Every max(1, int(fps_in / fps_out))-th frame."""
    return rows.filter(F.col(index) % max(1, int(fps_in / fps_out)) == 0)


def order_key(keys: list[str], seed: int) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.col(k).cast("string") for k in keys)))


def exact(rows: DataFrame, keys: list[str], n: int, *, seed: int) -> DataFrame:
    """Exactly n rows (all if there are fewer), by hash order: a top-n, so each task keeps n rows."""
    return rows.orderBy(order_key(keys, seed), *keys).limit(n)


def exact_per_group(rows: DataFrame, by: list[str], keys: list[str], n: int, *, seed: int) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(order_key(keys, seed), *keys)
    return rows.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= n).drop("__n")


def share_per_group(rows: DataFrame, by: list[str], keys: list[str], share: float, *, seed: int) -> DataFrame:
    """floor(share * n) of each group's n rows, by hash order."""
    w, whole = Window.partitionBy(*by).orderBy(order_key(keys, seed), *keys), Window.partitionBy(*by)
    return rows.withColumns({"__n": F.row_number().over(w), "__of": F.count("*").over(whole)}).filter(F.col("__n") <= F.floor(F.col("__of") * share)).drop("__n", "__of")


def ratio(rows: DataFrame, keys: list[str], share: float, *, seed: int) -> DataFrame:
    """About that share of the rows; a row's fate depends on its key alone."""
    return rows.filter(F.conv(F.substring(order_key(keys, seed), 1, 12), 16, 10).cast("double") < share * 16.0**12)


def evenly_spaced(rows: DataFrame, index: str, total: int, limit: int) -> DataFrame:
    """Rows at (k * total) div limit for k = 0 .. limit - 1, of rows indexed 0 .. total - 1; all if there are no more than limit."""
    if total <= limit:
        return rows
    k = F.ceil(F.col(index) * limit / total)
    return rows.filter((F.floor(k * total / limit) == F.col(index)) & (k < limit))


def clamped_threshold(rows: DataFrame, value: str, wanted: float) -> DataFrame:
    """One row: the wanted threshold, held between the 10th and 90th percentile of the values."""
    cuts = quantiles.quantiles(rows, [], value, {"low": 0.1, "high": 0.9})
    return cuts.agg(F.first(F.greatest("low", F.least("high", F.lit(float(wanted))))).alias("threshold"))  # of one row, or null


def inner_quantiles(rows: DataFrame, by: list[str], value: str, low: float, high: float) -> DataFrame:
    """Rows whose value lies between two quantiles of their group, both included."""
    cut = quantiles.with_quantiles(rows, by, value, {"__lo": low, "__hi": high})
    return cut.filter(F.col(value).between(F.col("__lo"), F.col("__hi"))).drop("__lo", "__hi")


def coin(keys: list[Column], seed: int) -> Column:
    """A number from 0 to 1 (1 left out) that depends on the keys alone."""
    h = F.md5(F.concat_ws("|", F.lit(str(seed)), *(k.cast("string") for k in keys)))
    return F.conv(F.substring(h, 1, 12), 16, 10).cast("double") / 16.0**12


def mesh_points(triangles: DataFrame, key: str, n: int, *, seed: int = 42) -> DataFrame:
    """(key, k, x, y, z): points spread over triangles (a, b, c of three numbers) by area; n of them on average.

    A triangle of share p gives floor(n p) points and one more with the
    fraction's probability, so no running total over the mesh is needed.
    """
    side = lambda p, q: [F.get(q, F.lit(i)) - F.get(p, F.lit(i)) for i in range(3)]
    u, v = side(F.col("a"), F.col("b")), side(F.col("a"), F.col("c"))
    normal = [u[(i + 1) % 3] * v[(i + 2) % 3] - u[(i + 2) % 3] * v[(i + 1) % 3] for i in range(3)]
    sized = triangles.withColumn("area", F.sqrt(normal[0] * normal[0] + normal[1] * normal[1] + normal[2] * normal[2]) / 2)
    total = sized.agg(F.sum("area")).first()[0] or 0.0
    due = F.col("area") * (n / total if total else 0.0)
    many = F.floor(due) + (coin([F.col(key), F.lit("n")], seed) < due - F.floor(due)).cast("long")
    each = sized.withColumn("__many", many).filter("__many > 0").withColumn("k", F.explode(F.sequence(F.lit(0), (F.col("__many") - 1).cast("int"))))
    s, t = F.sqrt(coin([F.col(key), F.col("k"), F.lit("s")], seed)), coin([F.col(key), F.col("k"), F.lit("t")], seed)
    place = lambda i: (1 - s) * F.get("a", F.lit(i)) + s * (1 - t) * F.get("b", F.lit(i)) + s * t * F.get("c", F.lit(i))
    return each.select(key, "k", *(place(i).alias(c) for i, c in enumerate("xyz")))


def points_of_masks(pixels: DataFrame, by: list[str], n: int, *, seed: int = 42) -> DataFrame:
    """(by..., k, x, y): n points of every mask in hash order; a mask of fewer pixels gives them again and again."""
    once = pixels.select(*by, "x", "y").distinct()
    w = Window.partitionBy(*by).orderBy(order_key([*by, "x", "y"], seed), "x", "y")
    ranked = once.withColumns({"__r": F.row_number().over(w) - 1, "__n": F.count("*").over(Window.partitionBy(*by))}).filter(F.col("__r") < n)
    return ranked.select(*by, F.explode(F.sequence(F.col("__r"), F.lit(n - 1), F.least(F.col("__n"), F.lit(n)).cast("int"))).alias("k"), "x", "y")
