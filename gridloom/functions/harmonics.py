"""Real spherical harmonics of colours: values at directions, and coefficients under a rotation.

Coefficients come by degree l and then m from -l to l, (L + 1)^2 in all; the
harmonic of m carries the sign (-1)^m, so those of degree 1 are multiples of
-y, z and -x.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def basis(directions: np.ndarray, degree: int) -> np.ndarray:
    """(..., (degree + 1)^2): the harmonics at unit directions (..., 3), polynomials in their coordinates."""
    x, y, z = np.moveaxis(np.asarray(directions, float), -1, 0)
    out = np.zeros((*x.shape, (degree + 1) ** 2))
    around = np.ones(x.shape, complex)  # (x + iy)^m, so that no angle is taken at the poles
    first = 1.0  # (2m - 1)!!
    for m in range(degree + 1):
        if m:
            around, first = around * (x + 1j * y), first * (2 * m - 1)
        before, now = np.zeros(x.shape), np.full(x.shape, first)
        for n in range(m, degree + 1):
            if n > m:
                before, now = now, ((2 * n - 1) * z * now - (n + m - 1) * before) / (n - m)
            scale = math.sqrt((2 * n + 1) / (4 * math.pi) * math.factorial(n - m) / math.factorial(n + m)) * (-1) ** m
            middle = n * n + n
            if not m:
                out[..., middle] = scale * now
            else:
                out[..., middle + m] = math.sqrt(2) * scale * now * around.real
                out[..., middle - m] = math.sqrt(2) * scale * now * around.imag
    return out


def turned(coefficients: np.ndarray, rotations: np.ndarray) -> np.ndarray:
    """Rows of coefficients for the function f(R^-1 d), given those of f(d) and a rotation R a row; what is no rotation is taken to the nearest one."""
    n, many = coefficients.shape
    degree = math.isqrt(many) - 1
    u, _, v = np.linalg.svd(rotations.reshape(n, 3, 3))
    u[:, :, 2] *= np.sign(np.linalg.det(u) * np.linalg.det(v))[:, None]
    k = np.arange(4 * many) + 0.5  # spread over the sphere: more places than harmonics
    lift, lon = 1 - k / (2 * many), math.pi * (1 + 5**0.5) * k
    at = np.stack([np.sqrt(1 - lift**2) * np.cos(lon), np.sqrt(1 - lift**2) * np.sin(lon), lift], 1)
    fixed, moved = basis(at, degree), basis(at @ (u @ v), degree)  # d R is R^-1 d, as rows
    out = np.empty_like(coefficients)
    for n_ in range(degree + 1):  # degrees do not mix
        part = slice(n_ * n_, (n_ + 1) ** 2)
        values = np.einsum("nkc,nc->nk", moved[:, :, part], coefficients[:, part])
        out[:, part] = values @ np.linalg.pinv(fixed[:, part]).T
    return out


def rotated(coefficients: Column, rotation: Column) -> Column:
    """Coefficients (one colour, at most degree 8) after a rotation of nine numbers by rows; an Arrow function over batches.

    Null where an argument is null, holds a null or a non-finite number, or has
    another length than a square or than nine.
    """

    @F.pandas_udf("array<double>")
    def turn(c: pd.Series, r: pd.Series) -> pd.Series:
        numbers = [(None, None) if a is None or b is None else (np.asarray(a, float), np.asarray(b, float)) for a, b in zip(c, r, strict=True)]
        good = [a is not None and 0 < len(a) <= 81 and math.isqrt(len(a)) ** 2 == len(a) and len(b) == 9 and bool(np.isfinite(a).all() and np.isfinite(b).all()) for a, b in numbers]
        out: list = [None] * len(numbers)
        for many in {len(a) for (a, _), ok in zip(numbers, good, strict=True) if ok}:
            rows = [k for k, ok in enumerate(good) if ok and len(numbers[k][0]) == many]
            got = turned(np.stack([numbers[k][0] for k in rows]), np.stack([numbers[k][1] for k in rows]))
            for k, row in zip(rows, got, strict=True):
                out[k] = row
        return pd.Series(out, dtype=object)

    return turn(coefficients, rotation)
