"""Queries over poses, rays, alignments, rigs, masks, samples and time series functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom import stand_ins as S
from gridloom.functions import boxes, camera, names, pose
from gridloom.operators import align, asof, filters, graph, masks, metrics, nearest, pooling, reports, sampling, voxel
from gridloom.queries import AROUND, CLOUD, KNOWN, PIXELS, PLANE, QUATERNION, SERIES, _clicks_and_views, _moved_pairs, _pixels, _plane, _quaternions, _transform_row, query
from gridloom.streaming import live


def T(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return S.read(spark, sf_dir, name)


def _r(c, digits: int = 6):
    return F.round(c, digits) + 0.0


def _numbers(c: str, n: int, digits: int = 6, prefix: str = "m") -> list:
    return [_r(F.col(c)[k], digits).alias(f"{prefix}{k}") for k in range(n)]


STILL = (1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0)


def _still():
    return F.array(*(F.lit(x) for x in STILL))


def _embedded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T(spark, sf_dir, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("e"))


# Rotations.

SIGNED = f"{QUATERNION}, g AS (SELECT vec_id, w * sign(w) AS w, x * sign(w) AS x, y * sign(w) AS y, z * sign(w) AS z FROM c WHERE abs(w) > 1e-6)"


@query(f"WITH {SIGNED} SELECT vec_id, round(w, 6) + 0.0 AS m0, round(x, 6) + 0.0 AS m1, round(y, 6) + 0.0 AS m2, round(z, 6) + 0.0 AS m3 FROM g")
def matrix_to_quat(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = _quaternions(spark, sf_dir).filter(F.abs(F.col("q")[0]) > 1e-6)
    return q.select("vec_id", pose.matrix_to_quaternion(pose.quaternion_to_matrix(F.col("q"))).alias("m")).select("vec_id", *_numbers("m", 4))


@query(
    """
WITH e AS (SELECT vec_id, embedding[1]::DOUBLE * 2 AS r, embedding[2]::DOUBLE AS p, embedding[3]::DOUBLE * 2 AS y FROM embeddings)
SELECT vec_id, round(cos(r / 2) * cos(p / 2) * cos(y / 2) + sin(r / 2) * sin(p / 2) * sin(y / 2), 6) + 0.0 AS m0, round(sin(r / 2) * cos(p / 2) * cos(y / 2) - cos(r / 2) * sin(p / 2) * sin(y / 2), 6) + 0.0 AS m1,
       round(cos(r / 2) * sin(p / 2) * cos(y / 2) + sin(r / 2) * cos(p / 2) * sin(y / 2), 6) + 0.0 AS m2, round(cos(r / 2) * cos(p / 2) * sin(y / 2) - sin(r / 2) * sin(p / 2) * cos(y / 2), 6) + 0.0 AS m3, true AS back FROM e
"""
)
def euler_to_quat(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _embedded(spark, sf_dir).select("vec_id", F.array(F.col("e")[0] * 2, F.col("e")[1], F.col("e")[2] * 2).alias("a"))
    e = e.withColumn("m", pose.euler_to_quaternion(F.col("a")))
    same = F.forall(F.zip_with("a", pose.quaternion_to_euler(F.col("m")), lambda x, y: F.abs(x - y) < 1e-9), lambda x: x)
    return e.select("vec_id", *_numbers("m", 4), same.alias("back"))


@query(f"WITH {QUATERNION} SELECT vec_id, round(x, 6) + 0.0 AS m0, round(y, 6) + 0.0 AS m1, round(z, 6) + 0.0 AS m2, round(w, 6) + 0.0 AS m3, true AS back FROM c")
def quat_order_swap(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = _quaternions(spark, sf_dir).withColumn("m", pose.wxyz_to_xyzw(F.col("q")))
    return q.select("vec_id", *_numbers("m", 4), (pose.xyzw_to_wxyz(F.col("m")) == F.col("q")).alias("back"))


NEXT = f"{QUATERNION}, n AS (SELECT a.vec_id, a.w AS aw, a.x AS ax, a.y AS ay, a.z AS az, b.w AS bw, b.x AS b1, b.y AS b2, b.z AS b3, a.w * b.w + a.x * b.x + a.y * b.y + a.z * b.z AS d FROM c a JOIN c b ON b.vec_id = a.vec_id + 1)"


def _next_quaternions(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = _quaternions(spark, sf_dir)
    return q.join(q.select((F.col("vec_id") - 1).alias("vec_id"), F.col("q").alias("p")), "vec_id")


@query(
    f"""
WITH {NEXT}
SELECT vec_id, round(degrees(acos(greatest(-1, least(1, 2 * d * d - 1)))), 4) + 0.0 AS angle,
       round(degrees(acos(least(1, abs(ax * b1 + ay * b2 + az * b3) / (sqrt(ax * ax + ay * ay + az * az) * sqrt(b1 * b1 + b2 * b2 + b3 * b3))))), 4) + 0.0 AS direction FROM n
"""
)
def quat_and_direction_angles(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = lambda c: F.slice(c, 2, 3)
    return _next_quaternions(spark, sf_dir).select("vec_id", _r(pose.quaternion_angle(F.col("q"), F.col("p")), 4).alias("angle"), _r(pose.translation_angle(part("q"), part("p")), 4).alias("direction"))


@query(
    f"""
WITH {NEXT},
f AS (SELECT *, CASE WHEN d < 0 THEN -1 ELSE 1 END AS s, acos(least(1, abs(d))) AS o FROM n),
k AS (SELECT *, CASE WHEN abs(d) > 0.9995 THEN 0.7 ELSE sin(0.7 * o) / sin(o) END AS p, s * CASE WHEN abs(d) > 0.9995 THEN 0.3 ELSE sin(0.3 * o) / sin(o) END AS q FROM f),
v AS (SELECT vec_id, p * aw + q * bw AS w, p * ax + q * b1 AS x, p * ay + q * b2 AS y, p * az + q * b3 AS z FROM k), u AS (SELECT *, sqrt(w * w + x * x + y * y + z * z) AS l FROM v)
SELECT vec_id, round(w / l, 6) + 0.0 AS m0, round(x / l, 6) + 0.0 AS m1, round(y / l, 6) + 0.0 AS m2, round(z / l, 6) + 0.0 AS m3 FROM u
"""
)
def quat_slerp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _next_quaternions(spark, sf_dir).select("vec_id", pose.slerp(F.col("q"), F.col("p"), F.lit(0.3)).alias("m")).select("vec_id", *_numbers("m", 4))


TURNED = f"""{QUATERNION}, m AS (SELECT vec_id, 1 - 2 * (y * y + z * z) AS m0, 2 * (x * y - w * z) AS m1, 2 * (x * z + w * y) AS m2, 2 * (x * y + w * z) AS m3, 1 - 2 * (x * x + z * z) AS m4, 2 * (y * z - w * x) AS m5, 2 * (x * z - w * y) AS m6, 2 * (y * z + w * x) AS m7, 1 - 2 * (x * x + y * y) AS m8 FROM c)"""


@query(f"WITH {TURNED} SELECT vec_id, " + ", ".join(f"round(m{k}, 6) + 0.0 AS m{k}" for k in range(9)) + " FROM m")
def rotation_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _quaternions(spark, sf_dir).select("vec_id", F.transform(pose.quaternion_to_matrix(F.col("q")), lambda x: x * 2.5).alias("m"))
    return align.projected(m, "m").select("vec_id", *_numbers("m", 9))


@query(
    f"""
WITH {TURNED}, p AS (SELECT a.vec_id, a.m0 * b.m0 + a.m1 * b.m3 + a.m2 * b.m6 AS m0, a.m3 * b.m0 + a.m4 * b.m3 + a.m5 * b.m6 AS m3, a.m6 * b.m1 + a.m7 * b.m4 + a.m8 * b.m7 AS m7, 3 * (a.m0 * 1 + a.m1 * 2 + a.m2 * 3) + 4 AS t0 FROM m a JOIN m b ON b.vec_id = a.vec_id + 1)
SELECT vec_id, 6.0::DOUBLE AS s, round(m0, 6) + 0.0 AS m0, round(m3, 6) + 0.0 AS m3, round(m7, 6) + 0.0 AS m7, round(t0, 6) + 0.0 AS t0, true AS back FROM p
"""
)
def sim3_compose_relative(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = _next_quaternions(spark, sf_dir)
    move = lambda s, c, t: pose.sim3(F.lit(float(s)), pose.quaternion_to_matrix(F.col(c)), F.array(*(F.lit(float(x)) for x in t)))
    q = q.withColumns({"a": move(3, "q", (4, 5, 6)), "b": move(2, "p", (1, 2, 3))})
    q = q.withColumn("ab", pose.compose(F.col("a"), F.col("b")))
    rel = pose.relative(F.col("b"), F.col("ab"))  # ab after the inverse of b is a
    same = F.forall(F.zip_with(rel["r"], F.col("a.r"), lambda x, y: F.abs(x - y) < 1e-9), lambda x: x) & (F.abs(rel["s"] - 3) < 1e-9)
    return q.select("vec_id", F.round("ab.s", 6).alias("s"), *(_r(F.col("ab.r")[k]).alias(f"m{k}") for k in (0, 3, 7)), _r(F.col("ab.t")[0]).alias("t0"), same.alias("back"))


@query(
    """
WITH g AS (SELECT vec_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings), n AS (SELECT vec_id, -x / sqrt(x * x + y * y + z * z) AS x, -y / sqrt(x * x + y * y + z * z) AS y, -z / sqrt(x * x + y * y + z * z) AS z FROM g),
b AS (SELECT *, CASE WHEN abs(x) < 0.9 THEN 1.0 ELSE 0.0 END AS bx, CASE WHEN abs(x) < 0.9 THEN 0.0 ELSE 1.0 END AS cy FROM n),
u AS (SELECT *, bx - x * (bx * x + cy * y) AS ux, cy - y * (bx * x + cy * y) AS uy, -z * (bx * x + cy * y) AS uz FROM b), l AS (SELECT *, sqrt(ux * ux + uy * uy + uz * uz) AS l FROM u), k AS (SELECT vec_id, x, y, z, ux / l AS ux, uy / l AS uy, uz / l AS uz FROM l)
SELECT vec_id, round(ux, 6) + 0.0 AS m0, round(uy, 6) + 0.0 AS m1, round(uz, 6) + 0.0 AS m2, round(y * uz - z * uy, 6) + 0.0 AS m3, round(z * ux - x * uz, 6) + 0.0 AS m4, round(x * uy - y * ux, 6) + 0.0 AS m5, round(x, 6) + 0.0 AS m6, round(y, 6) + 0.0 AS m7, round(z, 6) + 0.0 AS m8 FROM k
"""
)
def level_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _embedded(spark, sf_dir).select("vec_id", pose.level_rotation(F.slice("e", 1, 3)).alias("m")).select("vec_id", *_numbers("m", 9))


@query(
    """
WITH a AS (SELECT event_id, fmod(value, 6.0) AS a, fmod(value * 7, 6.0) AS b FROM events), g AS (SELECT *, (b - a + 3 * pi()) - floor((b - a + 3 * pi()) / (2 * pi())) * 2 * pi() - pi() AS g FROM a),
k AS (SELECT *, a + 0.25 * CASE WHEN g = -pi() THEN pi() ELSE g END AS c FROM g)
SELECT event_id, round(c - floor(c / (2 * pi())) * 2 * pi(), 6) + 0.0 AS angle FROM k
"""
)
def circular_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.series(spark, sf_dir).select("event_id", (F.col("value") % 6.0).alias("a"), ((F.col("value") * 7) % 6.0).alias("b"))
    return rows.select("event_id", _r(pose.circular(F.col("a"), F.col("b"), F.lit(0.25))).alias("angle"))


def _between_sql(t: str) -> str:
    return f"""
WITH a AS (SELECT p_partkey, p_size::DOUBLE AS d, radians(10.0 + p_size % 60) AS g FROM part)
SELECT p_partkey, round(d * sin({t} * g), 6) + 0.0 AS x, round(-d * cos({t} * g), 6) + 0.0 AS z, true AS meets FROM a
"""


@query(_between_sql("0.5"))
def pose_between(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two cameras on a circle about the origin, both looking at it; the one halfway is on the circle too."""
    d, g = F.col("p_size").cast("double"), F.radians(10.0 + F.col("p_size") % 60)
    at = lambda angle: pose.sim3(F.lit(1.0), pose.rotation_about_y(-angle), F.array(d * F.sin(angle), F.lit(0.0), -d * F.cos(angle)))
    rows = T(spark, sf_dir, "part").select("p_partkey", at(F.lit(0.0)).alias("a"), at(g).alias("b"))
    mid = pose.between(F.col("a"), F.col("b"), F.lit(0.5))
    ahead = lambda m: F.array(*(F.get(m["r"], F.lit(3 * k + 2)) for k in range(3)))
    meet = pose.ray_meeting(F.col("a.t"), ahead(F.col("a")), F.col("b.t"), ahead(F.col("b")))
    return rows.select("p_partkey", _r(mid["t"][0]).alias("x"), _r(mid["t"][2]).alias("z"), F.forall(meet, lambda c: F.abs(c) < 1e-6).alias("meets"))


@query(
    """
WITH p AS (SELECT p_partkey, (p_partkey % 640 - 320.0::DOUBLE) / (300 + p_size) AS x, (p_partkey % 480 - 240.0::DOUBLE) / (300 + p_size) AS y FROM part)
SELECT p_partkey, round(-y / sqrt(x * x + y * y + 1), 6) + 0.0 AS x, round(x / sqrt(x * x + y * y + 1), 6) + 0.0 AS y, round(1 / sqrt(x * x + y * y + 1), 6) + 0.0 AS z, 5.0::DOUBLE AS ox FROM p
"""
)
def world_rays(spark: SparkSession, sf_dir: str) -> DataFrame:
    focal = F.col("p_size") + 300.0
    k = F.struct(focal.alias("fx"), focal.alias("fy"), F.lit(320.0).alias("cx"), F.lit(240.0).alias("cy"))
    turned = F.array(*(F.lit(float(x)) for x in (0, -1, 0, 1, 0, 0, 0, 0, 1)))
    ray = pose.world_ray(F.col("p_partkey") % 640, F.col("p_partkey") % 480, k, pose.sim3(F.lit(1.0), turned, F.array(F.lit(5.0), F.lit(0.0), F.lit(0.0))))
    return T(spark, sf_dir, "part").select("p_partkey", ray.alias("r")).select("p_partkey", *(_r(F.col("r.direction")[i]).alias(c) for i, c in enumerate("xyz")), F.col("r.origin")[0].alias("ox"))


@query("SELECT o_orderkey, concat(" + ", ".join(f"(o_custkey >> {k}) & 1" for k in range(7, -1, -1)) + ") AS bits FROM orders")
def bit_unpack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T(spark, sf_dir, "orders").select("o_orderkey", F.array_join(F.transform(pose.bits(F.col("o_custkey"), 8), lambda b: b.cast("int").cast("string")), "").alias("bits"))


@query(
    f"""
WITH {QUATERNION}, s AS (SELECT vec_id, w, x, y, z, e.embedding[5]::DOUBLE AS a, e.embedding[6]::DOUBLE AS b, e.embedding[7]::DOUBLE AS c FROM c JOIN embeddings e USING (vec_id))
SELECT vec_id, round(-2 * b + 1, 6) + 0.0 AS x, round(2 * a + 2, 6) + 0.0 AS y, round(2 * c + 3, 6) + 0.0 AS z, round(2 * abs(a), 6) AS scale,
       round(sqrt(0.5) * (w - z), 6) + 0.0 AS m0, round(sqrt(0.5) * (x - y), 6) + 0.0 AS m1, round(sqrt(0.5) * (y + x), 6) + 0.0 AS m2, round(sqrt(0.5) * (z + w), 6) + 0.0 AS m3 FROM s
"""
)
def splat_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Splats under a quarter turn about z, twice the size, moved by (1, 2, 3)."""
    rows = _quaternions(spark, sf_dir).join(_embedded(spark, sf_dir).select("vec_id", F.slice("e", 5, 3).alias("mean")), "vec_id")
    m = pose.sim3(F.lit(2.0), F.array(*(F.lit(float(x)) for x in (0, -1, 0, 1, 0, 0, 0, 0, 1))), F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0)))
    got = rows.select("vec_id", pose.splat(m, F.col("mean"), F.transform("mean", lambda x: F.abs(x)), F.col("q")).alias("s"))
    return got.select("vec_id", *(_r(F.col("s.mean")[i]).alias(c) for i, c in enumerate("xyz")), F.round(F.col("s.scale")[0], 6).alias("scale"), *(_r(F.col("s.rotation")[i]).alias(f"m{i}") for i in range(4)))


@query(
    """
WITH g AS (SELECT k % 64 AS u, k // 64 AS v FROM range(2048) t(k)), a AS (SELECT u, v, ((u + 0.5::DOUBLE) / 64 - 0.5) * 2 * pi() AS lon, (0.5 - (v + 0.5::DOUBLE) / 32) * pi() AS lat FROM g),
r AS (SELECT u, v, sin(lat) AS rx, cos(lat) * sin(lon) AS ry, cos(lat) * cos(lon) AS rz FROM a), s AS (SELECT u, v, (atan2(rx, rz) / (2 * pi()) + 0.5) * 128 - 0.5 AS su, (0.5 - asin(greatest(-1, least(1, -ry))) / pi()) * 64 - 0.5 AS sv FROM r)
SELECT u::INTEGER AS u, v::INTEGER AS v, round(su - floor(su / 128) * 128, 5) + 0.0 AS su, round(sv, 5) + 0.0 AS sv FROM s
"""
)
def panorama_remap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quarter turn about z: x takes -y, y takes x."""
    turn = F.array(*(F.lit(float(x)) for x in (0, -1, 0, 1, 0, 0, 0, 0, 1)))
    grid = camera.pixel_grid(spark, 64, 32).withColumn("s", camera.turned_pixel(F.col("u"), F.col("v"), (64, 32), (128, 64), turn))
    return grid.select("u", "v", _r(F.col("s.u"), 5).alias("su"), _r(F.col("s.v"), 5).alias("sv"))


@query(f"WITH {PIXELS} SELECT image, (round(x * 0.26 + 0.1)::INTEGER % 16 + 16) % 16 AS u, round(y * 0.26 - 0.3)::INTEGER AS v, max(instance) AS instance FROM px WHERE round(y * 0.26 - 0.3) BETWEEN 0 AND 15 GROUP BY ALL")
def mask_scatter(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = F.struct((F.col("x") * 0.26 + 0.1).alias("u"), (F.col("y") * 0.26 - 0.3).alias("v"))
    return camera.scatter(_pixels(spark, sf_dir), ["image"], target, "instance", 16, 16)


@query(
    """
WITH p AS (SELECT p_partkey, (p_partkey % 21 - 10) / 10.0::DOUBLE AS x, (p_partkey % 17 - 8) / 8.0::DOUBLE AS y FROM part), q AS (SELECT *, sqrt(x * x + y * y) AS r, atan2(sqrt(x * x + y * y), 1.0) AS t FROM p),
d AS (SELECT *, t * (1 + 0.1 * t ** 2 - 0.02 * t ** 4 + 0.003 * t ** 6 + 0.001 * t ** 8) AS d FROM q)
SELECT p_partkey, round(250 * x * CASE WHEN r > 1e-12 THEN d / r ELSE 1 END + 320, 6) AS u, round(260 * y * CASE WHEN r > 1e-12 THEN d / r ELSE 1 END + 240, 6) AS v,
       round(CASE WHEN greatest(x, 0) + greatest(y, 0) > 0 THEN greatest(x, 0) / (greatest(x, 0) + greatest(y, 0)) ELSE 0 END, 6) AS share FROM d
"""
)
def fisheye_and_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = (F.col("p_partkey") % 21 - 10) / 10.0, (F.col("p_partkey") % 17 - 8) / 8.0
    k = F.struct(*(F.lit(float(v)).alias(n) for n, v in {"fx": 250, "fy": 260, "cx": 320, "cy": 240, "k1": 0.1, "k2": -0.02, "k3": 0.003, "k4": 0.001}.items()))
    p = camera.fisheye_pixel(F.struct(x.alias("x"), y.alias("y"), F.lit(1.0).alias("z")), k)
    return T(spark, sf_dir, "part").select("p_partkey", _r(p["u"]).alias("u"), _r(p["v"]).alias("v"), _r(camera.blend_weights(x, y)["a"]).alias("share"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_discount >= 0.3 / 10 THEN 99.0::DOUBLE ELSE l_quantity END AS depth, CASE WHEN l_discount >= 0.3 / 10 THEN 1.0::DOUBLE ELSE l_tax END AS conf FROM lineitem")
def sky_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    filled = filters.fill_sky(F.col("l_quantity"), F.col("l_tax"), F.round(F.col("l_discount") * 10, 6), F.lit(99.0))
    return T(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", filled.alias("f")).select("l_orderkey", "l_linenumber", "f.depth", "f.conf")


@query(
    """
WITH b AS (SELECT vec_id, embedding[1]::DOUBLE * 100 AS x, embedding[2]::DOUBLE * 100 AS y FROM embeddings)
SELECT vec_id, NOT ((abs(x - 0) <= 20 AND abs(x + 50) > 20) OR (abs(y - 0) <= 20 AND abs(y + 50) > 20) OR (abs(x + 10 - 40) <= 20 AND abs(x + 10 - 50) > 20) OR (abs(y + 10 - 40) <= 20 AND abs(y + 10 - 50) > 20)) AS kept FROM b
"""
)
def crop_edge_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = F.col("e")[0] * 100, F.col("e")[1] * 100
    box = lambda a, b, c, d: F.struct(a.alias("x0"), b.alias("y0"), c.alias("x1"), d.alias("y1"))
    l = lambda v: F.lit(float(v))  # noqa: E731, E741
    kept = boxes.away_from_edge(box(x, y, x + 10, y + 10), box(l(0), l(0), l(40), l(40)), box(l(-50), l(-50), l(50), l(50)))
    return _embedded(spark, sf_dir).select("vec_id", kept.alias("kept"))


# Alignment.


@query("SELECT vec_id // 50 AS grp, count(*)::DOUBLE AS n, 1.4::DOUBLE AS s, true AS turned, 2.0::DOUBLE AS t0, -3.0::DOUBLE AS t1, 0.7::DOUBLE AS t2 FROM embeddings GROUP BY 1 HAVING count(*) >= 4")
def sim3_fit_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = _moved_pairs(spark, sf_dir).withColumn("grp", F.expr("vec_id div 50"))
    got = align.fit_by(pairs, ["grp"]).filter("n >= 4")
    turned = F.forall(F.zip_with("r", F.array(*(F.lit(float(x)) for x in (0, -1, 0, 1, 0, 0, 0, 0, 1))), lambda a, b: F.abs(a - b) < 1e-6), lambda x: x)
    return got.select("grp", "n", _r(F.col("s")).alias("s"), turned.alias("turned"), *_numbers("t", 3, prefix="t"))


@query("WITH c AS (SELECT vec_id // 30 AS chunk, count(*) AS n FROM embeddings GROUP BY 1) SELECT a.chunk, 10.0::DOUBLE AS n, 2.0::DOUBLE AS s, 1.0::DOUBLE AS t0, 0.0::DOUBLE AS t1, -1.0::DOUBLE AS t2 FROM c a JOIN c b ON b.chunk = a.chunk + 1 WHERE a.n = 30 AND b.n >= 10")
def adjacent_overlap_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of 30 frames and the first 10 of the next one, each chunk half the size of, and set off from, the one before.

    A chunk's own size starts over after eight: it cancels out in the pairs, but 2 ** -chunk is soon lost beside the offsets, and then 0.
    """
    e = _embedded(spark, sf_dir).withColumn("chunk", F.expr("vec_id div 30"))
    at = lambda k: F.col("e")[k] * F.pow(F.lit(2.0), -(F.col("chunk") % 8))
    own = e.select("chunk", F.col("vec_id").alias("frame"), *(at(k).alias(c) for k, c in enumerate("xyz")))
    shared = own.filter("frame % 30 < 10").select((F.col("chunk") - 1).alias("chunk"), "frame", (F.col("x") * 2 + 1).alias("x"), (F.col("y") * 2).alias("y"), (F.col("z") * 2 - 1).alias("z"))
    whole = own.groupBy("chunk").agg(F.count("*").alias("n")).filter("n = 30").select("chunk")
    pairs = align.overlap_pairs(own.unionByName(shared.join(whole, "chunk", "left_semi").filter("chunk >= 0")), "chunk", ["frame"])
    got = align.fit_by(pairs, ["chunk"])
    return got.filter("n = 10").select("chunk", "n", _r(F.col("s")).alias("s"), *_numbers("t", 3, prefix="t"))


@query(
    """
WITH p AS (SELECT label, embedding[1]::DOUBLE AS a, embedding[4]::DOUBLE AS b, sqrt(power(embedding[1]::DOUBLE - embedding[4]::DOUBLE, 2) + power(embedding[2]::DOUBLE - embedding[5]::DOUBLE, 2) + power(embedding[3]::DOUBLE - embedding[6]::DOUBLE, 2)) AS d FROM embeddings),
v AS (SELECT label, CASE WHEN a > 0 AND b > 0 THEN d END AS d FROM p)
SELECT label, count(d) AS n, round(avg(d), 6) AS mean, round(stddev_pop(d), 6) AS std, round(median(d), 6) AS median, round(max(d), 6) AS max FROM v GROUP BY label
"""
)
def alignment_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = _embedded(spark, sf_dir).select("label", *(F.col("e")[k].alias(c) for k, c in enumerate(align.SOURCE + align.TARGET)))
    got = align.pair_errors(pairs, ["label"], valid=masks.joint_confident(F.col("sx"), F.col("tx"), 0.0))
    return got.withColumns({c: F.round(c, 6) for c in ("mean", "std", "median", "max")})


@query(
    """
WITH c AS (SELECT vec_id // 4 AS capture FROM embeddings GROUP BY 1 HAVING count(*) = 4)
SELECT capture, view::INTEGER AS view, CASE WHEN capture % 5 = 0 AND view = 3 THEN 'repaired' ELSE 'inlier' END AS status, 0.0::DOUBLE AS x, capture::DOUBLE AS z, 1.0::DOUBLE AS conf, true AS turned FROM c, range(4) t(view)
"""
)
def rig_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    yaw = F.col("view") * 90.0
    far = F.when((F.col("capture") % 5 == 0) & (F.col("view") == 3), 9.0).otherwise(0.0)
    rows = S.views(spark, sf_dir).select("capture", "view", yaw.alias("yaw"), F.array(far, F.lit(0.0), F.col("capture").cast("double")).alias("centre"), pose.rotation_about_y(F.radians(yaw)).alias("rotation"), F.lit(1.0).alias("conf"))
    verdict = align.rig_consensus(rows, ["capture"], centre_limit=0.1, angle_limit=1.0)
    got = align.apply_rig(rows.join(verdict.select("capture"), "capture", "left_semi"), verdict, ["capture"], action="repair")
    four = got.groupBy("capture").agg(F.count("*").alias("n")).filter("n = 4").select("capture")
    turned = F.forall(F.zip_with("rotation", pose.rotation_about_y(F.radians("yaw")), lambda a, b: F.abs(a - b) < 1e-6), lambda x: x)
    return got.join(four, "capture").select("capture", "view", "status", _r(F.col("centre")[0]).alias("x"), _r(F.col("centre")[2]).alias("z"), "conf", turned.alias("turned"))


@query(
    """
WITH r AS (SELECT l_returnflag, l_quantity AS raw, l_quantity * (1 - l_discount * 2) AS repaired, l_extendedprice AS depth FROM lineitem WHERE l_extendedprice > 1e-6)
SELECT l_returnflag, count(*) AS n, round(quantile_cont(raw / depth, 0.5), 9) AS raw_median, round(quantile_cont(raw / depth, 0.9), 9) AS raw_p90, round(quantile_cont(repaired / depth, 0.5), 9) AS repaired_median, round(quantile_cont(repaired / depth, 0.9), 9) AS repaired_p90,
       quantile_cont(repaired / depth, 0.5) < quantile_cont(raw / depth, 0.5) AS better FROM r GROUP BY l_returnflag
"""
)
def overlap_repair_gain(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("l_quantity")
    got = align.repair_gain(T(spark, sf_dir, "lineitem"), ["l_returnflag"], raw=q, repaired=q * (1 - F.col("l_discount") * 2), depth=F.col("l_extendedprice"))
    return got.withColumns({c: F.round(c, 9) for c in ("raw_median", "raw_p90", "repaired_median", "repaired_p90")})


@query("SELECT label, list_sort(list(vec_id) FILTER (WHERE vec_id % 7 <> 0))::VARCHAR AS inliers, 10.0::DOUBLE AS angle FROM embeddings GROUP BY label HAVING count(*) FILTER (WHERE vec_id % 7 <> 0) > 2 * count(*) FILTER (WHERE vec_id % 7 = 0)")
def medoid_rotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rotations about y by 10 degrees, every seventh one off by 60."""
    angle = F.radians(F.when(F.col("vec_id") % 7 == 0, 70.0).otherwise(10.0))
    rows = T(spark, sf_dir, "embeddings").select("label", "vec_id", pose.rotation_about_y(angle).alias("rotation"), (F.col("vec_id") % 7 == 0).alias("off"))
    enough = rows.groupBy("label").agg(F.count_if(~F.col("off")).alias("a"), F.count_if("off").alias("b")).filter("a > 2 * b").select("label")
    got = align.medoid_by(rows.join(enough, "label"), ["label"], "vec_id")
    return got.select("label", F.concat(F.lit("["), F.array_join(F.sort_array("inliers"), ", "), F.lit("]")).alias("inliers"), F.round(pose.rotation_angle(F.col("rotation")), 4).alias("angle"))


@query("SELECT DISTINCT label, 1.2::DOUBLE AS h0, 0.1::DOUBLE AS h1, 3.0::DOUBLE AS h2, -0.2::DOUBLE AS h3, 0.9::DOUBLE AS h4, -1.0::DOUBLE AS h5, 0.01::DOUBLE AS h6, 0.02::DOUBLE AS h7, 1.0::DOUBLE AS h8 FROM embeddings WHERE label IN (SELECT label FROM embeddings GROUP BY label HAVING count(*) >= 8)")
def homography_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = F.col("e")[0], F.col("e")[1]
    w = 0.01 * x + 0.02 * y + 1
    pairs = _embedded(spark, sf_dir).select("label", x.alias("sx"), y.alias("sy"), ((1.2 * x + 0.1 * y + 3) / w).alias("tx"), ((-0.2 * x + 0.9 * y - 1) / w).alias("ty"), (1.0 + F.col("vec_id") % 3).alias("weight"))
    enough = pairs.groupBy("label").count().filter("count >= 8").select("label")
    return align.homography_by(pairs.join(enough, "label"), ["label"], "weight").select("label", *_numbers("h", 9, 4, "h"))


GRAPH = "WITH n AS (SELECT DISTINCT r_regionkey AS grp, k AS node FROM region, range(6) t(k))"


def _graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Chains of six nodes a step of 1 apart (two where the group is even), with one loop; the first guess is off."""
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n).cast("long")))
    step = 1.0 + (F.col("r_regionkey") + 1) % 2
    nodes = T(spark, sf_dir, "region").select(F.col("r_regionkey").alias("grp"), step.alias("step"), each(5).alias("node"))
    vector = lambda x: F.array(x, F.lit(0.0), F.lit(0.0))
    poses = nodes.select("grp", "node", F.lit(1.0).alias("s"), _still().alias("r"), vector(F.col("node") * 0.9 * F.col("step")).alias("t"))
    chain = nodes.filter("node < 5").select("grp", F.col("node").alias("a"), (F.col("node") + 1).alias("b"), F.col("step").alias("far"))
    loop = nodes.filter("node = 0").select("grp", F.col("node").alias("a"), F.lit(5).cast("long").alias("b"), (F.col("step") * 5).alias("far"))
    edges = chain.unionByName(loop).select("grp", "a", "b", F.lit(1.0).alias("s"), _still().alias("r"), vector(F.col("far")).alias("t"), F.lit(1.0).alias("weight"))
    return poses, edges


@query(f"{GRAPH} SELECT grp, node, 1.0::DOUBLE AS s, node * (1.0::DOUBLE + (grp + 1) % 2) AS x FROM n")
def pose_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.solve(*_graph(spark, sf_dir), ["grp"]).select("grp", "node", _r(F.col("s"), 4).alias("s"), _r(F.col("t")[0], 4).alias("x"))


@query(f"{GRAPH} SELECT grp, node AS a, node + 1 AS b, 0.0::DOUBLE AS residual FROM n WHERE node < 5 UNION ALL SELECT grp, 0, 5, 0.0::DOUBLE FROM n WHERE node = 0")
def pose_graph_left_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.left_out(*_graph(spark, sf_dir), ["grp"]).withColumn("residual", _r(F.col("residual"), 3))


_STEPS = """s AS (SELECT user_id, event_id, 1 + (event_id % 3) * 0.1::DOUBLE AS s, value AS t, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events)"""


@query(
    f"""
WITH RECURSIVE {_STEPS}, w AS (SELECT user_id, event_id, i, s, t FROM s WHERE i = 1 UNION ALL SELECT s.user_id, s.event_id, s.i, w.s * s.s, w.s * s.t + w.t FROM w JOIN s ON s.user_id = w.user_id AND s.i = w.i + 1)
SELECT user_id, event_id, round(s, 6) AS s, round(t, 4) AS t FROM w
"""
)
def cumulative_poses(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.series(spark, sf_dir)
    steps = rows.select("user_id", "event_id", (1 + (F.col("event_id") % 3) * 0.1).alias("s"), _still().alias("r"), F.array(F.col("value"), F.lit(0.0), F.lit(0.0)).alias("t"))
    return pooling.chained(steps, ["user_id"], "event_id").select("user_id", "event_id", F.round("s", 6).alias("s"), F.round(F.col("t")[0], 4).alias("t"))


@query(f"WITH {_STEPS} SELECT a.user_id, a.event_id, round(b.s / a.s, 6) AS s, round((b.t - a.t) / a.s, 6) + 0.0 AS t FROM s a JOIN s b ON b.user_id = a.user_id AND b.i = a.i + 1")
def sequential_poses(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.series(spark, sf_dir)
    poses = rows.select("user_id", "event_id", pose.sim3(1 + (F.col("event_id") % 3) * 0.1, _still(), F.array(F.col("value"), F.lit(0.0), F.lit(0.0))).alias("pose"))
    return pooling.steps_between(poses, ["user_id"], "event_id").select("user_id", "event_id", F.round("step.s", 6).alias("s"), _r(F.col("step.t")[0]).alias("t"))


# Scales, errors and neighbours.


@query(
    """
WITH r AS (SELECT l_returnflag AS grp, l_orderkey * 10 + l_linenumber AS k, l_quantity * CASE WHEN l_orderkey % 4 = 0 THEN 9.0 ELSE 2.5 END AS a, l_quantity AS b FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey) = 1 AND count(*) OVER (PARTITION BY l_orderkey, l_linenumber) = 1),
c AS (SELECT grp, a / b AS s FROM r WHERE abs(b) > 1e-12 QUALIFY row_number() OVER (PARTITION BY grp ORDER BY md5(concat('42|', k)), k) <= 16), d AS (SELECT DISTINCT * FROM c),
n AS (SELECT r.grp, d.s, count(*) FILTER (WHERE abs(a - d.s * b) <= 0.01) AS n, sum(a * b) FILTER (WHERE abs(a - d.s * b) <= 0.01) AS ab, sum(b * b) FILTER (WHERE abs(a - d.s * b) <= 0.01) AS bb FROM r JOIN d ON d.grp = r.grp GROUP BY ALL)
SELECT grp, round(ab / bb, 6) AS scale, true AS most FROM n QUALIFY row_number() OVER (PARTITION BY grp ORDER BY n DESC, s) = 1
"""
)
def consensus_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T(spark, sf_dir, "lineitem")
    once = rows.groupBy("l_orderkey", "l_linenumber").count().filter("count = 1").drop("count")
    a = F.col("l_quantity") * F.when(F.col("l_orderkey") % 4 == 0, 9.0).otherwise(2.5)
    rows = rows.join(once, ["l_orderkey", "l_linenumber"]).select(F.col("l_returnflag").alias("grp"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("k"), a.alias("a"), F.col("l_quantity").alias("b"))
    got = metrics.consensus_scale(rows, ["grp"], "k", "a", "b", trials=16, inlier=0.01)
    return got.select("grp", F.round("scale", 6).alias("scale"), (F.col("n_inliers") > 0).alias("most"))


@query("SELECT event_type, round(quantile_cont(value, 0.75), 6) AS quantile, count(value) AS n FROM events WHERE ('0x' || substr(md5(concat('11|', event_id)), 1, 12))::BIGINT < 0.3 * 281474976710656 GROUP BY event_type")
def sampled_quantile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.sampled_quantile(S.series(spark, sf_dir), ["event_type"], "event_id", "value", 0.75, share=0.3, seed=11).withColumn("quantile", F.round("quantile", 6))


@query(f"WITH {CLOUD}, a AS (SELECT k.* FROM k JOIN u USING (vx, vy, vz) WHERE u.support >= 12 AND u.n >= 2) SELECT (SELECT count(*) FROM k) AS n_before, count(*) AS n_after, min(x) AS lo_x, max(x) AS hi_x, min(z) AS lo_z, max(z) AS hi_z, round(count(*) / (SELECT count(*) FROM k), 9) AS kept FROM a")
def clean_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    cloud = S.cloud(spark, sf_dir)
    return metrics.clean_report(cloud, voxel.clean(cloud, 5000, least_support=12, least_points=2), ["x", "z"]).withColumn("kept", F.round("kept", 9))


@query(
    f"""
WITH {PLANE}, s AS (SELECT 'a' AS side, distance FROM n UNION ALL SELECT 'b', distance FROM m), q AS (SELECT side, quantile_cont(distance, 0.8) AS cut FROM s GROUP BY side),
t AS (SELECT side, sqrt(avg(distance * distance)) AS r FROM s JOIN q USING (side) WHERE distance <= cut GROUP BY side) SELECT round(avg(r), 6) AS rmse FROM t
"""
)
def symmetric_trimmed_rmse(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _plane(spark, sf_dir)
    both = nearest.nearest(a, b, ["x", "y"], cell=100.0).select(F.lit("a").alias("side"), "distance").unionByName(nearest.nearest(b, a, ["x", "y"], cell=100.0).select(F.lit("b").alias("side"), "distance"))
    return metrics.trimmed_rmse(both, ["side"], "distance", 0.8).agg(F.round(F.avg("trimmed_rmse"), 6).alias("rmse"))


@query(
    f"""
WITH {PLANE}, w AS (SELECT * FROM p WHERE d <= 120), f AS (SELECT a, b, d FROM w QUALIFY row_number() OVER (PARTITION BY a ORDER BY d, b) = 1), g AS (SELECT a, b FROM w QUALIFY row_number() OVER (PARTITION BY b ORDER BY d, a) = 1)
SELECT f.a AS id, f.b AS target, d AS distance FROM f JOIN g USING (a, b)
"""
)
def mutual_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.mutual_within(*_plane(spark, sf_dir), ["x", "y"], 120.0)


# Masks and regions.


@query(
    f"""
WITH {PIXELS}, s AS (SELECT dx, dy FROM range(-1, 2) t(dx), range(-1, 2) u(dy) WHERE dx * dx + dy * dy <= 1)
SELECT DISTINCT image, instance, x + dx AS x, y + dy AS y FROM px, s WHERE x + dx BETWEEN 0 AND 63 AND y + dy BETWEEN 0 AND 63
"""
)
def mask_dilate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masks.dilate(_pixels(spark, sf_dir), ["image", "instance"], 1, 64, 64)


@query(
    f"""
WITH {PIXELS}, s AS (SELECT dx, dy FROM range(-1, 2) t(dx), range(-1, 2) u(dy) WHERE dx * dx + dy * dy <= 1),
g AS (SELECT DISTINCT image, x + dx AS x, y + dy AS y FROM px, s WHERE x + dx BETWEEN 0 AND 63 AND y + dy BETWEEN 0 AND 63),
e AS (SELECT image, x, y, x + dx AS ax, y + dy AS ay FROM g, s WHERE x + dx BETWEEN 0 AND 63 AND y + dy BETWEEN 0 AND 63),
m AS (SELECT DISTINCT e.image, e.x, e.y FROM e ANTI JOIN g ON e.image = g.image AND e.ax = g.x AND e.ay = g.y)
SELECT g.image, g.x, g.y FROM g ANTI JOIN m ON g.image = m.image AND g.x = m.x AND g.y = m.y
"""
)
def mask_close(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masks.refine(_pixels(spark, sf_dir), ["image"], 64, 64, close=1)


@query(f"WITH {PIXELS}, m AS (SELECT DISTINCT image, x, y FROM px WHERE instance = 1) SELECT p.image, p.x, p.y, p.instance, CASE WHEN m.image IS NULL THEN p.instance / 7.0::DOUBLE ELSE 0.0 END AS conf FROM dx p LEFT JOIN m USING (image, x, y)")
def confidence_zero_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _pixels(spark, sf_dir).distinct().withColumn("conf", F.col("instance") / 7.0)
    return masks.zero_confidence(p, p.filter("instance = 1"), None, "image", "conf")


@query("SELECT l_orderkey, l_linenumber, l_tax > 0.03 AND l_discount > 0.03 AS ok FROM lineitem")
def joint_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    ok = masks.joint_confident(F.col("l_tax"), F.col("l_discount"), 0.03)
    return T(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", ok.alias("ok"))


@query(
    f"""
WITH {PIXELS}, d AS (SELECT DISTINCT x, y FROM px WHERE image = 1 AND instance = 1), s AS (SELECT dx, dy FROM range(-2, 3) t(dx), range(-2, 3) u(dy) WHERE dx * dx + dy * dy <= 4), r AS (SELECT DISTINCT x + dx AS x, y + dy AS y FROM d, s WHERE x + dx BETWEEN 0 AND 63 AND y + dy BETWEEN 0 AND 63),
p AS (SELECT vec_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings)
SELECT vec_id, coalesce((SELECT true FROM r WHERE r.x = trunc(100 * p.x + 32) AND r.y = trunc(-90 * p.y + 30)) AND z BETWEEN -0.1 AND 0.2, false) AS inside FROM p
"""
)
def roi_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    dark = _pixels(spark, sf_dir).filter("image = 1 and instance = 1").select("x", "y", F.lit(0).alias("value"))
    points = _embedded(spark, sf_dir).select("vec_id", *(F.col("e")[k].alias(c) for k, c in enumerate("xyz")))
    got = masks.in_roi(points, masks.roi_cells(dark, 2, 64, 64), (100.0, 0.0, 32.0, 0.0, -90.0, 30.0, 0.0, 0.0, 1.0), -0.1, 0.2)
    return got.select("vec_id", "inside")


# Samples.


@query(
    """
WITH t AS (SELECT p_partkey AS id, p_size * 0.5::DOUBLE AS area FROM part), d AS (SELECT id, area * (500 / (SELECT sum(area) FROM t)) AS due FROM t),
m AS (SELECT id, floor(due)::BIGINT + (('0x' || substr(md5(concat('42|', id, '|n')), 1, 12))::BIGINT / 281474976710656.0::DOUBLE < due - floor(due))::BIGINT AS many FROM d), k AS (SELECT id, unnest(range(many)) AS k FROM m),
c AS (SELECT id, k, sqrt(('0x' || substr(md5(concat('42|', id, '|', k, '|s')), 1, 12))::BIGINT / 281474976710656.0::DOUBLE) AS s, ('0x' || substr(md5(concat('42|', id, '|', k, '|t')), 1, 12))::BIGINT / 281474976710656.0::DOUBLE AS t FROM k)
SELECT id, k::INTEGER AS k, round(s * (1 - t) * p_size, 6) AS x, round(s * t, 6) AS y, 7.0::DOUBLE AS z FROM c JOIN part ON p_partkey = id
"""
)
def mesh_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    corner = lambda x, y: F.array(x, F.lit(float(y)), F.lit(7.0))
    tri = T(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), corner(F.lit(0.0), 0).alias("a"), corner(F.col("p_size").cast("double"), 0).alias("b"), corner(F.lit(0.0), 1).alias("c"))
    return sampling.mesh_points(tri, "id", 500).select("id", "k", *(F.round(c, 6).alias(c) for c in "xyz"))


@query(
    f"""
WITH {PIXELS}, r AS (SELECT image, x, y, row_number() OVER (PARTITION BY image ORDER BY md5(concat('42|', image, '|', x, '|', y)), x, y) - 1 AS r, count(*) OVER (PARTITION BY image) AS n FROM (SELECT DISTINCT image, x, y FROM px))
SELECT image, k, x, y FROM r, range(70) t(k) WHERE k % least(n, 70) = r
"""
)
def mask_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.points_of_masks(_pixels(spark, sf_dir), ["image"], 70)


# Names, stamps, lists and filters.


@query(
    """
WITH e AS (SELECT event_id, epoch_us(ts) * 1000 + 7 AS ns, value FROM events)
SELECT event_id, ns // 1000000000 AS sec, ns % 1000000000 AS nsec, (round(value::DECIMAL(28, 12) * 1000000000))::BIGINT AS value_ns, ns + 5000000 AS later FROM e
"""
)
def stamp_arithmetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    ns = F.col("ts") * 1000 + 7
    return S.series(spark, sf_dir).select("event_id", names.split_stamp(ns).alias("s"), names.nanoseconds(F.col("value")).alias("value_ns"), (ns + 5_000_000).alias("later")).select("event_id", "s.sec", "s.nsec", "value_ns", "later")


@query(
    """
WITH p AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'True' WHEN 1 THEN ' 12' WHEN 2 THEN '1.5e2' WHEN 3 THEN p_name ELSE '-7' END AS t FROM part)
SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'bool' WHEN 1 THEN 'int' WHEN 2 THEN 'float' WHEN 3 THEN 'str' ELSE 'int' END AS kind, CASE p_partkey % 5 WHEN 1 THEN 12 WHEN 4 THEN -7 END::BIGINT AS i, CASE WHEN p_partkey % 5 = 2 THEN 150.0::DOUBLE END AS d,
       regexp_matches(t, '^[A-Za-z0-9][A-Za-z0-9._-]*$') AS safe FROM p
"""
)
def scalar_sniffing(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey") % 5
    t = F.when(k == 0, "True").when(k == 1, " 12").when(k == 2, "1.5e2").when(k == 3, F.col("p_name")).otherwise("-7")
    return T(spark, sf_dir, "part").select("p_partkey", names.sniffed(t).alias("s"), names.is_safe_label(t).alias("safe")).select("p_partkey", "s.kind", "s.i", "s.d", "safe")


@query("SELECT p_partkey, concat('[', array_to_string(list_filter(list_transform(string_split(concat(p_brand, ', ', p_type, ',, x=1'), ','), lambda x: trim(x)), lambda x: x <> ''), ', '), ']') AS parts, '1' AS x FROM part")
def list_and_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat("p_brand", F.lit(", "), "p_type", F.lit(",, x=1"))
    return T(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("["), F.array_join(names.split_list(text), ", "), F.lit("]")).alias("parts"), F.element_at(names.key_values(text), "x").alias("x"))


@query("SELECT vec_id FROM embeddings WHERE vec_id % 5 <> 0 AND vec_id % 7 <> 0 AND vec_id % 11 <> 0")
def finite_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("vec_id")
    x = F.when(k % 5 == 0, None).when(k % 7 == 0, float("nan")).when(k % 11 == 0, float("inf")).otherwise(1.0)
    return filters.finite(T(spark, sf_dir, "embeddings").select("vec_id", x.alias("x")), ["x"]).select("vec_id")


@query(f"WITH {CLOUD}, s AS (SELECT DISTINCT vx, vy, vz FROM k WHERE side = 'F') SELECT k.x, k.y, k.z, k.conf FROM k SEMI JOIN s USING (vx, vy, vz) WHERE side = 'O'")
def observed_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    cloud = S.cloud(spark, sf_dir)
    cell = lambda c: F.floor(F.col(c) / 5000).cast("long").alias(f"v_{c}")
    seen = cloud.filter("side = 'F'").select(*(cell(c) for c in "xyz"))
    return filters.observed(cloud.filter("side = 'O'"), seen, ["x", "y", "z"], 5000.0).select("x", "y", "z", "conf")


@query("SELECT p_partkey FROM part WHERE p_brand IN ('Brand#12', 'Brand#13') AND p_size NOT IN (1, 2) AND NOT p_type LIKE '%TIN'")
def listed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T(spark, sf_dir, "part")
    brands = [b for b in ("Brand#12", "Brand#13") if not rows.filter(F.col("p_brand") == b).isEmpty()]
    kept = filters.listed(rows, "p_brand", brands) if brands else rows.limit(0)
    return filters.listed(kept, "p_size", None, [1, 2]).filter(~filters.denied(F.col("p_type"), ["TIN"])).select("p_partkey")


RANGE = (1_704_500_000_000_000, 1_705_500_000_000_000)


@query(f"SELECT event_id FROM events WHERE epoch_us(ts) BETWEEN {RANGE[0]} AND {RANGE[1]}")
def time_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.time_range(S.series(spark, sf_dir), "ts", *RANGE).select("event_id")


@query(
    f"""
WITH {AROUND}, f AS (SELECT *, CASE WHEN p_ts = ts THEN 0.0 ELSE (ts - p_ts) / nullif(l_ts - p_ts, 0) END AS part FROM n WHERE p_ts IS NOT NULL AND l_ts IS NOT NULL),
h AS (SELECT *, radians(p_value / 8) AS a, radians(l_value / 8) AS b FROM f)
SELECT user_id, ts, event_id, round(degrees(2 * CASE WHEN cos(b - a) > 0.9995 THEN atan2((1 - part) * sin(a) + part * sin(b), (1 - part) * cos(a) + part * cos(b)) ELSE a + part * (b - a) END), 4) AS angle FROM h
"""
)
def rotation_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rotations about z by a quarter of the value in degrees, interpolated by slerp between a click's neighbouring views."""
    clicks, views = _clicks_and_views(spark, sf_dir)
    about_z = lambda v: F.array(F.cos(F.radians(v / 8)), F.lit(0.0), F.lit(0.0), F.sin(F.radians(v / 8)))
    turned = views.select("user_id", "ts", "event_id", about_z(F.col("value")).alias("rotation"))
    got = asof.interpolate_rotation(clicks.select("user_id", "ts", "event_id"), turned, ["user_id"], order="event_id", rotation="rotation")
    angle = F.degrees(2 * F.atan2(F.col("interpolated")[3], F.col("interpolated")[0]))
    return got.filter("interpolated is not null").select("user_id", "ts", "event_id", F.round(angle, 4).alias("angle"))


# The batch side of the streaming twins.


@query(f"WITH {SERIES}, a AS (SELECT * FROM s WHERE event_type = 'view'), b AS (SELECT user_id, ts + 0 AS ts, event_id AS r_event_id FROM s WHERE event_id % 2 = 0) SELECT a.user_id, make_timestamp(a.ts) AS at, a.event_id, b.r_event_id FROM a JOIN b ON a.user_id = b.user_id AND a.ts = b.ts")
def exact_stamp_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.series(spark, sf_dir).withColumn("at", F.timestamp_micros("ts"))
    left, right = rows.filter("event_type = 'view'").select("user_id", "at", "event_id"), rows.filter("event_id % 2 = 0").select("user_id", "at", "event_id")
    return live.exact_pairs(left, right, ["user_id"], ts="at", late="1 hour").select("user_id", F.col("at").cast("timestamp_ntz").alias("at"), "event_id", "r_event_id")


@query("SELECT time_bucket(INTERVAL 6 HOURS, ts::TIMESTAMP, TIMESTAMP '1970-01-01') AS start, count(*) AS n, count(*) < 20 AS silent FROM events GROUP BY 1")
def silent_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.series(spark, sf_dir).withColumn("at", F.timestamp_micros("ts"))
    return live.silent_windows(rows, ts="at", window="6 hours", late="1 hour", least=20).select(F.col("start").cast("timestamp_ntz").alias("start"), "n", "silent")
