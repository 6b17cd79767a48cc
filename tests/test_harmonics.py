"""Harmonics against their known polynomials, and turned coefficients against the turned function."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from gridloom.cluster import ship
from gridloom.functions import harmonics


def directions(n: int, seed: int) -> np.ndarray:
    v = np.random.default_rng(seed).normal(size=(n, 3))
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def rotations(n: int, seed: int) -> np.ndarray:
    q, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(n, 3, 3)))
    q[:, :, 0] *= np.linalg.det(q)[:, None]
    return q


def test_first_degrees():
    d = directions(50, 1)
    x, y, z = d.T
    a, b = np.sqrt(3 / (4 * np.pi)), np.sqrt(15 / (4 * np.pi))
    want = [np.full(50, np.sqrt(1 / (4 * np.pi))), -a * y, a * z, -a * x, b * x * y, -b * y * z, np.sqrt(5 / (16 * np.pi)) * (3 * z * z - 1), -b * x * z, b / 2 * (x * x - y * y)]
    assert np.allclose(harmonics.basis(d, 2), np.stack(want, 1))


def test_basis_is_orthonormal():
    rule, weight = np.polynomial.legendre.leggauss(12)
    lon = np.arange(24) * 2 * np.pi / 24
    z, t = (m.ravel() for m in np.meshgrid(rule, lon, indexing="ij"))
    at = np.stack([np.sqrt(1 - z * z) * np.cos(t), np.sqrt(1 - z * z) * np.sin(t), z], 1)
    values = harmonics.basis(at, 5)
    assert np.allclose(values.T @ (values * np.repeat(weight, 24)[:, None]) * 2 * np.pi / 24, np.eye(36))


def test_turned_function():
    for degree in range(6):
        c, r, d = np.random.default_rng(degree).normal(size=(7, (degree + 1) ** 2)), rotations(7, degree), directions(40, 9)
        got = harmonics.turned(c, r.reshape(7, 9))
        for k in range(7):  # at R d it is what the function was at d
            assert np.allclose(harmonics.basis(d @ r[k].T, degree) @ got[k], harmonics.basis(d, degree) @ c[k])
        assert np.allclose((got**2).sum(1), (c**2).sum(1))


def test_column(spark):
    ship(spark)
    c, r = np.random.default_rng(4).normal(size=(3, 9)), rotations(3, 5).reshape(3, 9)
    rows = [(k, c[k].tolist(), r[k].tolist()) for k in range(3)] + [
        (3, None, r[0].tolist()), (4, c[0].tolist(), None), (5, [1.0, 2.0], r[0].tolist()), (6, c[0].tolist(), [1.0] * 8),
        (7, [], r[0].tolist()), (8, [1.0, None, 0.0, 0.0], r[0].tolist()), (9, [float("nan")], r[0].tolist()), (10, [2.5], r[0].tolist()), (11, c[1].tolist(), (3 * r[1]).tolist()),
    ]
    table = spark.createDataFrame(rows, "k int, c array<double>, r array<double>")
    got = {x["k"]: x["o"] for x in table.select("k", harmonics.rotated(F.col("c"), F.col("r")).alias("o")).collect()}
    want = harmonics.turned(c, r)
    assert all(np.allclose(got[k], want[k]) for k in range(3))
    assert all(got[k] is None for k in range(3, 10))
    assert np.allclose(got[10], [2.5]) and np.allclose(got[11], want[1])  # a scaled rotation counts as the rotation
    assert table.limit(0).select(harmonics.rotated(F.col("c"), F.col("r"))).collect() == []
