from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from gridloom.operators import filters, reports


def test_filters(spark):
    rows = spark.createDataFrame([(0, 0.0, 0.0, 0.0), (1, 2.0, 0.0, 0.0), (2, float("nan"), 0.0, 0.0), (3, None, 0.0, 0.0), (4, float("inf"), 0.0, 0.0)], "id int, x double, y double, z double")
    good = filters.finite(rows, ["x", "y", "z"])
    assert sorted(r["id"] for r in good.collect()) == [0, 1]
    assert [r["id"] for r in filters.half_space(good, (1.0, 0.0, 0.0, -1.0)).collect()] == [1]
    assert [r["id"] for r in filters.inside_box_of(good, good.filter("id = 0"), ["x"], 0.5).collect()] == [0]
    seen = spark.createDataFrame([(2,)], "v_x long")
    assert [r["id"] for r in filters.observed(good, seen, ["x"], 1.0).collect()] == [1]
    assert filters.time_range(rows, "id", start=1, end=3).count() == 3 and filters.time_range(rows, "id").count() == 5
    assert filters.listed(rows, "id", include=[0, 1], exclude=[1]).count() == 1
    with pytest.raises(KeyError):
        filters.listed(rows, "id", include=[0, 9])
    name = spark.sql("select 'scene/DSC_1.JPG' as n")
    assert name.select(filters.denied(F.col("n"), ["_1.JPG"]).alias("d")).first()["d"]
    sky = spark.sql("select 1.0D as d, 0.2D as c, 0.9D as s")
    assert tuple(sky.select(filters.fill_sky(F.col("d"), F.col("c"), F.col("s"), F.lit(99.0)).alias("f")).first()["f"]) == (99.0, 1.0)


def test_reports(spark):
    rows = spark.createDataFrame([("r1", "a", 1.0), ("r1", "b", 2.0), ("r2", "a", 3.0), ("r2", "b", 3.0), ("r3", "a", 1.0)], "run string, method string, err double")
    got = reports.paired(rows, "run", "method", "err", "a", "b").first()
    assert (got["n"], got["wins"], got["ties"], got["losses"]) == (2, 1, 1, 0)
    means = spark.createDataFrame([("x", None, 2.0), ("y", 4.0, 9.0), ("z", 100.0, None)], "d string, m1 double, m2 double")
    assert reports.selective_mean(means, "d", ["m1", "m2"], exclude=["z"]).first()["mean"] == 3.0
    best = reports.best_and_worst(means.filter("d = 'y'"), "d", {"m1": True, "m2": True}).first()
    assert (best["best"], best["worst"]) == ("m2", "m1")
    keys = spark.createDataFrame([("dtu_recon_unposed",)], "k string")
    assert tuple(reports.by_dataset(keys, "k").first())[1:] == ("dtu", "recon_unposed")
    assert tuple(reports.by_dataset(keys, "k", last=True).first())[1:] == ("dtu_recon", "unposed")
    window = lambda i: tuple(spark.range(1).select(reports.half_window(F.lit(i), 3, 10).alias("w")).first()["w"])
    assert [window(i) for i in (0, 5, 9)] == [(0, 6), (2, 8), (4, 10)]
    held = reports.hold_last(spark.createDataFrame([(0, float("nan")), (1, 2.0), (2, None), (3, float("inf"))], "k int, v double").withColumn("g", F.lit(0)), ["g"], ["k"], "v")
    assert [r["v"] for r in held.orderBy("k").collect()] == [None, 2.0, 2.0, 2.0]
    assert [r["all_rejected"] for r in reports.all_rejected(spark.sql("select 1 as g, cast(null as boolean) as a"), ["g"], "a").collect()] == [True]
