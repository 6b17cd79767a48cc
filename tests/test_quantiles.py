"""Exact quantiles by brackets, against numpy."""

from __future__ import annotations

import random

import numpy as np
import pytest

from gridloom.operators import metrics, quantiles

SHARES = {"a": 0.0, "b": 0.1, "c": 0.5, "d": 0.937, "e": 1.0}


@pytest.mark.parametrize("small", [50, 1_000_000])
def test_against_numpy(spark, monkeypatch, small):
    monkeypatch.setattr(quantiles, "SMALL", small)
    monkeypatch.setattr(quantiles, "ACCURACY", 50)
    rng = random.Random(4)
    groups = {
        "even": [float(k) for k in range(1000)], "ties": [1.0] * 700 + [rng.random() for _ in range(400)], "wild": [rng.gauss(0, 1) ** 5 for _ in range(777)] + [float("inf"), -float("inf")],
        "few": [3.0, 1.0, 2.0, 8.0], "one": [5.0], None: [rng.random() for _ in range(90)], "same": [2.0] * 300,
    }
    rows = [(g, v) for g, x in groups.items() for v in x] + [("even", None), ("one", float("nan")), ("none", None)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "grp string, v double").repartition(5)
    got = {r["grp"]: r for r in quantiles.quantiles(df, ["grp"], "v", SHARES).collect()}
    assert set(got) == set(groups)
    for g, x in groups.items():
        for name, p in SHARES.items():
            if g != "wild" or 0 < p < 1:
                assert got[g][name] == pytest.approx(np.percentile(x, 100 * p), abs=1e-12)
    whole = quantiles.quantiles(df.filter("grp = 'even'"), [], "v", {"m": 0.25}).collect()
    assert [r["m"] for r in whole] == [249.75]
    stats = metrics.error_stats(df.filter("grp in ('even', 'none')"), ["grp"], "v").collect()
    assert {r["grp"]: (r["n"], r["median"]) for r in stats} == {"even": (1000, 499.5), "none": (0, None)}
    assert quantiles.quantiles(df.limit(0), ["grp"], "v", SHARES).collect() == []
