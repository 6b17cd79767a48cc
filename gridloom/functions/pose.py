"""Rotations, poses and similarity transforms as column expressions.

A 3 x 3 matrix is an array of nine doubles in row order, a vector an array of
three, a quaternion an array in (w, x, y, z) order unless said otherwise, a
similarity transform a struct (s, r, t).
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _at(a: Column, k: int) -> Column:
    return F.get(a, F.lit(k))


def normalise(v: Column, n: int, eps: float = 1e-12) -> Column:
    """The vector over its norm; as it is where the norm is below eps."""
    norm = F.sqrt(sum((_at(v, k) * _at(v, k) for k in range(1, n)), _at(v, 0) * _at(v, 0)))
    return F.when(norm < eps, v).otherwise(F.array(*(_at(v, k) / norm for k in range(n))))


def quaternion_to_matrix(q: Column) -> Column:
    w, x, y, z = (_at(q, k) for k in range(4))
    return F.array(
        1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y),
        2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x),
        2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y),
    )


def wxyz_to_xyzw(q: Column) -> Column:
    return F.array(*(_at(q, k) for k in (1, 2, 3, 0)))


def xyzw_to_wxyz(q: Column) -> Column:
    return F.array(*(_at(q, k) for k in (3, 0, 1, 2)))


def quaternion_to_euler(q: Column) -> Column:
    """(roll, pitch, yaw) in radians."""
    w, x, y, z = (_at(q, k) for k in range(4))
    pitch = F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), 2 * (w * y - z * x))))
    return F.array(F.atan2(2 * (w * x + y * z), 1 - 2 * (x * x + y * y)), pitch, F.atan2(2 * (w * z + x * y), 1 - 2 * (y * y + z * z)))


def transpose(m: Column) -> Column:
    return F.array(*(_at(m, 3 * c + r) for r in range(3) for c in range(3)))


def multiply(a: Column, b: Column) -> Column:
    return F.array(*(_at(a, 3 * r) * _at(b, c) + _at(a, 3 * r + 1) * _at(b, 3 + c) + _at(a, 3 * r + 2) * _at(b, 6 + c) for r in range(3) for c in range(3)))


def rotate(m: Column, v: Column) -> Column:
    return F.array(*(_at(m, 3 * r) * _at(v, 0) + _at(m, 3 * r + 1) * _at(v, 1) + _at(m, 3 * r + 2) * _at(v, 2) for r in range(3)))


def rotation_angle(m: Column) -> Column:
    """Degrees, the cosine clipped to [-1, 1]."""
    cosine = (_at(m, 0) + _at(m, 4) + _at(m, 8) - 1) / 2
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine))))


def rotation_about_y(angle: Column) -> Column:
    c, s, zero, one = F.cos(angle), F.sin(angle), F.lit(0.0), F.lit(1.0)
    return F.array(c, zero, s, zero, one, zero, -s, zero, c)


def quaternion_angle(p: Column, q: Column) -> Column:
    """Degrees between two unit quaternions, whatever their signs."""
    dot = sum((_at(p, k) * _at(q, k) for k in range(1, 4)), _at(p, 0) * _at(q, 0))
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), 2 * dot * dot - 1))))


def sim3(s: Column, r: Column, t: Column) -> Column:
    return F.struct(s.alias("s"), r.alias("r"), t.alias("t"))


def apply(m: Column, p: Column) -> Column:
    """s R p + t."""
    turned = rotate(m["r"], p)
    return F.array(*(m["s"] * _at(turned, k) + _at(m["t"], k) for k in range(3)))


def compose(outer: Column, inner: Column) -> Column:
    return sim3(outer["s"] * inner["s"], multiply(outer["r"], inner["r"]), apply(outer, inner["t"]))


def inverse(m: Column) -> Column:
    back = transpose(m["r"])
    moved = rotate(back, m["t"])
    return sim3(1 / m["s"], back, F.array(*(-_at(moved, k) / m["s"] for k in range(3))))


def relative(a: Column, b: Column) -> Column:
    """What takes a to b: b after the inverse of a."""
    return compose(b, inverse(a))


def back_project(u: Column, v: Column, depth: Column, k: Column, c2w: Column) -> Column:
    """The world point of a pixel at a depth, for intrinsics (fx, fy, cx, cy) and a camera pose (s, r, t)."""
    ray = F.array((u - k["cx"]) / k["fx"] * depth, (v - k["cy"]) / k["fy"] * depth, depth)
    return apply(c2w, ray)


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is written and evaluated once however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def dot(a: Column, b: Column, n: int) -> Column:
    return sum((_at(a, k) * _at(b, k) for k in range(1, n)), _at(a, 0) * _at(b, 0))


def matrix_to_quaternion(m: Column) -> Column:
    """(w, x, y, z) with w >= 0 of a rotation, from its largest component, so that no small number divides."""
    t = [_at(m, 0) + _at(m, 4) + _at(m, 8), _at(m, 0) - _at(m, 4) - _at(m, 8), _at(m, 4) - _at(m, 0) - _at(m, 8), _at(m, 8) - _at(m, 0) - _at(m, 4)]
    off = {"wx": _at(m, 7) - _at(m, 5), "wy": _at(m, 2) - _at(m, 6), "wz": _at(m, 3) - _at(m, 1), "xy": _at(m, 1) + _at(m, 3), "xz": _at(m, 2) + _at(m, 6), "yz": _at(m, 5) + _at(m, 7)}
    names = "wxyz"

    def from_component(k: int) -> Column:
        size = F.sqrt(1 + t[k]) * 2
        return F.array(*(size / 4 if j == k else off["".join(sorted(names[j] + names[k]))] / size for j in range(4)))

    most = F.greatest(*t)
    q = F.when(t[0] == most, from_component(0)).when(t[1] == most, from_component(1)).when(t[2] == most, from_component(2)).otherwise(from_component(3))
    return F.when(_at(q, 0) < 0, F.transform(q, lambda x: -x)).otherwise(q)


def euler_to_quaternion(e: Column) -> Column:
    """(w, x, y, z) of (roll, pitch, yaw) in radians; the inverse of ``quaternion_to_euler`` off its poles."""
    (cr, sr), (cp, sp), (cy, sy) = ((F.cos(_at(e, k) / 2), F.sin(_at(e, k) / 2)) for k in range(3))
    return F.array(cr * cp * cy + sr * sp * sy, sr * cp * cy - cr * sp * sy, cr * sp * cy + sr * cp * sy, cr * cp * sy - sr * sp * cy)


def slerp(p: Column, q: Column, t: Column) -> Column:
    """Between two unit quaternions by the shorter way; straight and normalised where they are within about two degrees."""
    def mixed(v: Column) -> Column:
        near = F.abs(v["cosine"])
        angle = F.acos(F.least(near, F.lit(1.0)))
        flat = near > 0.9995
        a = F.when(flat, 1 - v["t"]).otherwise(F.sin((1 - v["t"]) * angle) / F.sin(angle))
        b = F.when(flat, v["t"]).otherwise(F.sin(v["t"] * angle) / F.sin(angle)) * F.when(v["cosine"] < 0, -1.0).otherwise(1.0)
        return bound(F.struct(a.alias("a"), b.alias("b")), lambda w: F.zip_with(v["p"], v["q"], lambda x, y: w["a"] * x + w["b"] * y))

    whole = F.struct(p.alias("p"), q.alias("q"), t.alias("t"))
    cosined = bound(whole, lambda v: F.struct(v["p"].alias("p"), v["q"].alias("q"), v["t"].alias("t"), dot(v["p"], v["q"], 4).alias("cosine")))
    return bound(bound(cosined, mixed), lambda v: normalise(v, 4))


def circular(a: Column, b: Column, t: Column) -> Column:
    """From angle a towards b by the shorter way, in [0, 2 pi); half a turn goes forward."""
    turn = 2 * math.pi
    gap = F.pmod(b - a + math.pi, F.lit(turn)) - math.pi
    return F.pmod(a + t * F.when(gap == -math.pi, math.pi).otherwise(gap), F.lit(turn))


def cross(a: Column, b: Column) -> Column:
    return F.array(*(_at(a, (k + 1) % 3) * _at(b, (k + 2) % 3) - _at(a, (k + 2) % 3) * _at(b, (k + 1) % 3) for k in range(3)))


def ray_meeting(a: Column, da: Column, b: Column, db: Column, eps: float = 1e-9) -> Column:
    """The point midway between the closest points of two lines (origin, unit direction); null where they are parallel."""
    c = dot(da, db, 3)
    gap = F.array(*(_at(b, k) - _at(a, k) for k in range(3)))
    u, v = dot(gap, da, 3), dot(gap, db, 3)
    bottom = 1 - c * c
    s, t = (u - c * v) / bottom, (c * u - v) / bottom
    return F.when(bottom > eps, F.array(*((_at(a, k) + s * _at(da, k) + _at(b, k) + t * _at(db, k)) / 2 for k in range(3))))


def between(a: Column, b: Column, t: Column) -> Column:
    """The pose (s, r, t) part t of the way from a to b about the point that both look at (their third columns).

    The rotation goes by slerp; the distance to the focus, and the direction it
    is seen from, go straight.  Parallel views move their centres straight.
    """
    ahead = lambda m: F.array(*(_at(m, 3 * k + 2) for k in range(3)))
    focus = ray_meeting(a["t"], ahead(a["r"]), b["t"], ahead(b["r"]))
    straight = F.array(*(_at(a["t"], k) * (1 - t) + _at(b["t"], k) * t for k in range(3)))

    def far(c: Column, f: Column) -> Column:
        gap = F.zip_with(c, f, lambda p, q: p - q)
        return F.sqrt(F.aggregate(gap, F.lit(0.0), lambda s, x: s + x * x))

    def placed(v: Column) -> Column:
        r, f = quaternion_to_matrix(v["q"]), v["focus"]
        radius = far(a["t"], f) * (1 - t) + far(b["t"], f) * t
        seen = F.array(*(_at(f, k) - radius * _at(ahead(r), k) for k in range(3)))
        return sim3(a["s"] * (1 - t) + b["s"] * t, r, F.when(f.isNull(), straight).otherwise(seen))

    turned = bound(F.struct(matrix_to_quaternion(a["r"]).alias("a"), matrix_to_quaternion(b["r"]).alias("b")), lambda q: slerp(q["a"], q["b"], t))
    return bound(F.struct(turned.alias("q"), focus.alias("focus")), placed)


def world_ray(u: Column, v: Column, k: Column, c2w: Column) -> Column:
    """struct(origin, direction): the unit direction in the world of a pixel's ray, for intrinsics (fx, fy, cx, cy) and a camera pose."""
    ray = normalise(F.array((u - k["cx"]) / k["fx"], (v - k["cy"]) / k["fy"], F.lit(1.0)), 3)
    return F.struct(c2w["t"].alias("origin"), rotate(c2w["r"], ray).alias("direction"))


def translation_angle(a: Column, b: Column) -> Column:
    """Degrees between two directions whatever their signs; null where one has no length."""
    size = F.sqrt(dot(a, a, 3)) * F.sqrt(dot(b, b, 3))
    return F.when(size > 0, F.degrees(F.acos(F.least(F.abs(dot(a, b, 3)) / size, F.lit(1.0)))))


def level_rotation(gravity: Column) -> Column:
    """Rows x, y, z of a frame whose z axis is along -gravity, by Gram-Schmidt from x, or from y where x is nearly parallel to it."""
    def framed(z: Column) -> Column:
        upright = F.abs(_at(z, 0)) < 0.9
        along = F.when(upright, _at(z, 0)).otherwise(_at(z, 1))
        base = F.array(F.when(upright, 1.0).otherwise(0.0), F.when(upright, 0.0).otherwise(1.0), F.lit(0.0))
        flat = F.zip_with(base, z, lambda p, q: p - q * along)
        return bound(bound(flat, lambda v: normalise(v, 3)), lambda x: F.concat(x, cross(z, x), z))

    return bound(bound(gravity, lambda g: F.transform(normalise(g, 3), lambda c: -c)), framed)


def splat(m: Column, mean: Column, scale: Column, rotation: Column) -> Column:
    """struct(mean, scale, rotation) of a splat under a similarity: mean moved, scales multiplied, quaternion turned."""
    q, p = matrix_to_quaternion(m["r"]), rotation
    w, x, y, z = (_at(q, k) for k in range(4))
    a, b, c, d = (_at(p, k) for k in range(4))
    turned = F.array(w * a - x * b - y * c - z * d, w * b + x * a + y * d - z * c, w * c - x * d + y * a + z * b, w * d + x * c - y * b + z * a)
    return F.struct(apply(m, mean).alias("mean"), F.transform(scale, lambda s: s * m["s"]).alias("scale"), turned.alias("rotation"))


def bits(value: Column, n: int, *, high_first: bool = True) -> Column:
    """The lowest n bits of a whole number as booleans."""
    order = range(n - 1, -1, -1) if high_first else range(n)
    return F.array(*(F.getbit(value.cast("long"), F.lit(k)) == 1 for k in order))
