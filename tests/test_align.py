from __future__ import annotations

import numpy as np
import pytest

from gridloom.functions import linalg
from gridloom.operators import align, graph


def rotation(angle, axis=(0.2, 0.5, 0.8)):
    k = np.array(axis) / np.linalg.norm(axis)
    x = np.array([[0, -k[2], k[1]], [k[2], 0, -k[0]], [-k[1], k[0], 0]])
    return np.eye(3) + np.sin(angle) * x + (1 - np.cos(angle)) * x @ x


TRUE = (1.4, rotation(np.radians(31)), np.array([2.0, -3.0, 0.7]))


def pair_table(spark, x, y):
    return spark.createDataFrame([(*map(float, a), *map(float, b)) for a, b in zip(x, y, strict=True)], "sx double, sy double, sz double, tx double, ty double, tz double")


def test_fit_recovers_a_similarity(spark):
    x = np.random.default_rng(1).normal(size=(40, 3))
    s, r, t = align.fit(pair_table(spark, x, linalg.apply(TRUE, x)))
    assert s == pytest.approx(1.4) and np.allclose(r, TRUE[1]) and np.allclose(t, TRUE[2])
    s, r, t = align.fit(pair_table(spark, x, linalg.apply((1.0, *TRUE[1:]), x)), with_scale=False)
    assert s == 1.0 and np.allclose(r, TRUE[1]) and np.allclose(t, TRUE[2])


def test_robust_fits_ignore_outliers(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 3))
    y = linalg.apply(TRUE, x)
    y[:30] += rng.normal(size=(30, 3)) * 20
    table = pair_table(spark, x, y)
    m, _ = align.irls(table, delta=0.01, rounds=60)
    assert np.abs(linalg.apply(m, x[30:]) - y[30:]).max() < 0.02
    m, n = align.ransac(table, trials=20, size=4, inlier=0.01)
    assert n >= 170 and np.allclose(m[1], TRUE[1], atol=1e-6)


def test_icp_moves_clouds_together(spark):
    rng = np.random.default_rng(7)
    x = rng.uniform(-1, 1, size=(400, 3))
    small = (1.0, rotation(0.03), np.array([0.02, -0.03, 0.01]))
    table = lambda p: spark.createDataFrame([(k, *map(float, a)) for k, a in enumerate(p)], "id long, x double, y double, z double")
    m, rms, n = align.icp(table(x), table(linalg.apply(small, x)), radii=(0.3, 0.1), rounds=6)
    assert n >= 300 and rms < 0.02
    assert np.abs(linalg.apply(m, x) - linalg.apply(small, x)).max() < 0.02


def test_rig_consensus(spark):
    yaw = [0, 90, 180, 270]
    about = lambda d: rotation(np.radians(d), (0, 1, 0))
    tilt = rotation(0.1, (1, 0, 0))
    rows = []
    for name, shift in (("good", 0.0), ("one", 3.0)):
        for v, d in enumerate(yaw):
            c = [0.01 * v + (shift if v == 3 else 0.0), 0.0, 0.0]
            rows.append((name, v, float(d), c, (tilt @ about(d)).ravel().tolist()))
    rows += [("split", v, float(d), [5.0 * (v // 2), 0.0, 0.0], (tilt @ about(d)).ravel().tolist()) for v, d in enumerate(yaw)]
    table = spark.createDataFrame(rows, "capture string, view int, yaw double, centre array<double>, rotation array<double>")
    got = {r["capture"]: r for r in align.rig_consensus(table, ["capture"], centre_limit=0.1, angle_limit=2.0).collect()}
    assert got["good"]["inliers"] == [0, 1, 2, 3]
    assert got["one"]["inliers"] == [0, 1, 2]
    assert not got["split"]["accepted"]


def test_pose_graph_closes_a_loop():
    rng = np.random.default_rng(3)
    steps = [(1.0 + 0.02 * k, rotation(0.2 * k), np.array([1.0, 0.1 * k, 0.0])) for k in range(5)]
    true = linalg.cumulative(steps, identity_first=True)
    edges = [(k, k + 1, m, 1.0) for k, m in enumerate(linalg.sequential(true))] + [(0, 5, linalg.compose(linalg.inverse(true[0]), true[5]), 1.0)]
    bent = [true[0], *((p[0] * 1.05, p[1] @ rotation(0.05), p[2] + rng.normal(size=3) * 0.1) for p in true[1:])]
    got = graph.optimise(bent, edges)
    assert (graph.residuals(got, edges) ** 2).sum() < 1e-8
    assert all(np.allclose(a[2], b[2], atol=1e-3) for a, b in zip(got, true, strict=True))
    assert max(graph.leave_one_out(bent, edges[:-1] + [edges[-1]])) < 1e-3


def test_slerp_and_level():
    p, q = np.array([1.0, 0, 0, 0]), np.array([np.cos(0.5), 0, np.sin(0.5), 0])
    assert np.allclose(linalg.slerp(p, q, 0.5), [np.cos(0.25), 0, np.sin(0.25), 0])
    r = linalg.level_rotation(np.array([0.1, 0.2, -9.8]))
    assert np.allclose(r @ r.T, np.eye(3)) and np.allclose(r @ np.array([0.1, 0.2, -9.8]), [0, 0, -np.linalg.norm([0.1, 0.2, -9.8])])
