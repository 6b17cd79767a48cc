from __future__ import annotations

import numpy as np
import pytest

from gridloom.functions import linalg
from gridloom.operators import pooling


def about_z(a):
    return np.array([[np.cos(a), -np.sin(a), 0], [np.sin(a), np.cos(a), 0], [0, 0, 1.0]])


def test_sinkhorn_shares_add_up():
    s = np.random.default_rng(1).normal(size=(4, 30))
    p = pooling.sinkhorn(s, rounds=200)
    assert p.shape == (4, 30) and np.allclose(p.sum(1), 1, atol=1e-6) and (p.sum(0) <= 1 + 1e-6).all()


def test_robust_scale_ignores_outliers(spark):
    rng = np.random.default_rng(2)
    b = rng.uniform(1, 5, 200)
    a = 2.5 * b + rng.normal(size=200) * 0.01
    a[:40] += 30
    rows = spark.createDataFrame([("g", float(x), float(y)) for x, y in zip(a, b, strict=True)], "g string, a double, b double")
    got = pooling.robust_scale(rows, ["g"], "a", "b").first()
    assert got["scale"] == pytest.approx(2.5, abs=0.01) and got["n_inliers"] == 160


def test_relative_errors(spark):
    rows = []
    for k in range(6):
        r, t = about_z(0.1 * k), np.array([k, 0.5 * k * k, 0.0])
        rows.append(("same", k, r.ravel().tolist(), r.ravel().tolist(), t.tolist(), t.tolist()))
        rows.append(("turned", k, about_z(0.1 * k + np.radians(5) * k).ravel().tolist(), r.ravel().tolist(), t.tolist(), t.tolist()))
    table = spark.createDataFrame(rows, "run string, frame int, est_r array<double>, gt_r array<double>, est_t array<double>, gt_t array<double>")
    got = {r["run"]: r for r in pooling.relative_pose_errors(table, ["run"]).collect()}
    assert got["same"]["n_pairs"] == 15 and got["same"]["rotation"] == pytest.approx(0, abs=1e-5) and got["same"]["auc"] == pytest.approx(1)
    assert got["turned"]["rotation"] == pytest.approx(np.mean([5 * (j - i) for i in range(6) for j in range(i + 1, 6)]), abs=1e-4)


def test_chained_transforms(spark):
    steps = [(1.1, about_z(0.2), np.array([1.0, 0, 0]))] * 4
    rows = [("r", k, s, m.ravel().tolist(), t.tolist()) for k, (s, m, t) in enumerate(steps)]
    got = pooling.chained(spark.createDataFrame(rows, "run string, k int, s double, r array<double>, t array<double>"), ["run"], "k").orderBy("k").collect()
    want = linalg.cumulative(steps)
    assert all(g["s"] == pytest.approx(w[0]) and np.allclose(g["t"], w[2]) for g, w in zip(got, want, strict=True))
    back = linalg.sequential([linalg.IDENTITY, *want])
    assert all(np.allclose(b[2], s[2]) for b, s in zip(back, steps, strict=True))
