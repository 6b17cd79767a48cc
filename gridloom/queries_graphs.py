"""Queries over loop closures, pose graphs, chunked passes, regions and robust fits; noisy data, worked out again in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom import stand_ins as S
from gridloom.cluster import held, scratch
from gridloom.functions import linalg
from gridloom.operators import align, graph, loops, masks, pooling, windows
from gridloom.plans import chunked
from gridloom.queries import PIXELS, _pixels, query

# Loop closures.  Every order is a frame of four pixels in a plane; chunks and
# predictions see them turned, scaled, moved and with noise.  What follows is
# plain arithmetic that both engines share.

CHUNK, OVERLAP = 120, 60
WORLD = {
    "wx": "CAST(cents % 997 AS DOUBLE) / 100 + CAST(pixel AS DOUBLE) * 5 / 2",
    "wy": "CAST((cust * 37 + pixel * 613) % 911 AS DOUBLE) / 100",
}


def _seen(angle: str, scale: str, dx: str, dy: str, nx: str, ny: str) -> dict[str, str]:
    return {"x": f"{scale} * (cos({angle}) * wx - sin({angle}) * wy) + {dx} + {nx}", "y": f"{scale} * (sin({angle}) * wx + cos({angle}) * wy) + {dy} + {ny}"}


IN_CHUNK = _seen("CAST(chunk AS DOUBLE) * 7 / 10", "(1 + CAST(chunk % 5 AS DOUBLE) / 10)", "chunk % 7", "- (chunk % 3)", "CAST((cents + 31 * pixel + 17 * chunk) % 13 - 6 AS DOUBLE) / 500", "CAST((cents + 29 * pixel + 11 * chunk) % 11 - 5 AS DOUBLE) / 500")
_LOUD = "(CASE WHEN loop % 5 = 0 THEN 30 ELSE 1 END)"
IN_LOOP = _seen("CAST(loop AS DOUBLE) * 3 / 10", "CAST(6 AS DOUBLE) / 5", "loop % 4", "loop % 9", f"{_LOUD} * CAST((cents + 23 * pixel + 7 * loop) % 17 - 8 AS DOUBLE) / 500", f"{_LOUD} * CAST((cents + 19 * pixel + 5 * loop) % 19 - 9 AS DOUBLE) / 500")
CONF = "1 + CAST((cents + pixel) % 10 AS DOUBLE) / 10"
CONF_LOOP = "CASE WHEN cust % 17 = 0 THEN CAST(1 AS DOUBLE) / 100 ELSE 1 + CAST((cust + pixel) % 10 AS DOUBLE) / 10 END"


def _loop_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(candidates, chunks, points, predicted)."""
    orders = S.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("frame"), F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"), F.col("o_custkey").alias("cust"))
    n = orders.count()
    chunks = windows.chunk_windows(spark, n, CHUNK, OVERLAP)
    pixels = orders.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))).alias("pixel")).withColumns({k: F.expr(v) for k, v in WORLD.items()})
    see = lambda df, where, conf: df.select("*", *(F.expr(v).alias(k) for k, v in where.items()), F.lit(0.0).alias("z"), F.expr(conf).alias("conf"))
    step = CHUNK - OVERLAP
    points = see(windows.members(pixels, "frame", n, CHUNK, OVERLAP), IN_CHUNK, CONF).select("chunk", (F.col("frame") - F.col("chunk") * step).alias("at"), "pixel", "x", "y", "z", "conf")
    last = chunks.agg(F.max("chunk")).first()[0]
    a, b = F.col("loop") * step, (F.col("loop") + 3) * step
    candidates = spark.range(max(last - 3, 0)).withColumnRenamed("id", "loop").select(
        "loop", F.col("loop").alias("chunk_a"), (a + 20).alias("from_a"), (a + 44).alias("to_a"), (F.col("loop") + 3).alias("chunk_b"), (b + 30).alias("from_b"), (b + 54).alias("to_b"),
        (1 - (F.col("loop") % 4).cast("double") / 10).alias("rig_a"), (1 - (F.col("loop") % 3).cast("double") / 10).alias("rig_b"),
    )
    frames = F.concat(*(F.sequence(F.col(f"from_{s}"), F.col(f"to_{s}") - 1) for s in "ab"))
    shown = candidates.select("loop", F.posexplode(frames).alias("at", "frame")).select("loop", F.col("at").cast("long").alias("at"), "frame")
    predicted = see(shown.join(pixels.hint("merge"), "frame"), IN_LOOP, CONF_LOOP).select("loop", "at", "pixel", "x", "y", "z", "conf")
    return candidates, chunks, points, predicted


def _planar_fit(name: str, rows: str, keys: str, weight: str) -> str:
    """CTEs whose last, ``name``, has the weighted similarity (s, c, d, tx0, ty0) of each group in the plane, from its moments."""
    return f"""
{name}_m AS (SELECT {keys}, sum({weight}) AS n, sum({weight} * sx) / sum({weight}) AS mx, sum({weight} * sy) / sum({weight}) AS my, sum({weight} * tx) / sum({weight}) AS ux, sum({weight} * ty) / sum({weight}) AS uy FROM {rows} GROUP BY ALL),
{name}_v AS (SELECT {keys}, sum({weight} * ((sx - mx) ** 2 + (sy - my) ** 2)) AS v, sum({weight} * ((tx - ux) * (sx - mx) + (ty - uy) * (sy - my))) AS p, sum({weight} * ((ty - uy) * (sx - mx) - (tx - ux) * (sy - my))) AS q FROM {rows} JOIN {name}_m USING ({keys}) GROUP BY ALL),
{name} AS (SELECT {keys}, n, s, c, d, ux - s * (c * mx - d * my) AS tx0, uy - s * (d * mx + c * my) AS ty0
           FROM (SELECT *, sqrt(p * p + q * q) / v AS s, p / sqrt(p * p + q * q) AS c, q / sqrt(p * p + q * q) AS d FROM {name}_v JOIN {name}_m USING ({keys})))"""


_FAR = "sqrt((s * (c * sx - d * sy) + tx0 - tx) ** 2 + (s * (d * sx + c * sy) + ty0 - ty) ** 2)"
_SEES = lambda where: ", ".join(f"{v} AS {k}" for k, v in where.items())
LOOPS = f"""
WITH o AS MATERIALIZED (SELECT o_orderkey AS frame, round(o_totalprice * 100)::BIGINT AS cents, o_custkey AS cust, pixel FROM orders, range(4) t(pixel)),
w AS MATERIALIZED (SELECT *, {_SEES(WORLD)} FROM o),
k AS (SELECT range AS chunk, range * 60 AS start FROM range((SELECT CASE WHEN count(*) <= {CHUNK} THEN 1 ELSE ((count(*) - {OVERLAP}) + 59) // 60 END FROM orders))),
p AS MATERIALIZED (SELECT chunk, frame - start AS at, pixel, {_SEES(IN_CHUNK)}, {CONF} AS conf FROM w JOIN k ON frame >= start AND frame < start + {CHUNK}),
l AS (SELECT chunk AS loop, start FROM k WHERE chunk < (SELECT max(chunk) - 3 FROM k)),
g AS (SELECT loop, 'a' AS side, loop AS chunk, 20 + range AS place, start + 20 + range AS frame FROM l, range(24) UNION ALL
      SELECT loop, 'b', loop + 3, 30 + range, start + 180 + 30 + range FROM l, range(24)),
e AS MATERIALIZED (SELECT loop, side, g.chunk, place, pixel, {_SEES(IN_LOOP)}, {CONF_LOOP} AS conf FROM g JOIN w USING (frame)),
j AS MATERIALIZED (SELECT loop, side, e.x AS sx, e.y AS sy, p.x AS tx, p.y AS ty, e.conf AS conf_s, p.conf AS conf_t FROM e JOIN p ON e.chunk = p.chunk AND e.place = p.at AND e.pixel = p.pixel),
i AS (SELECT loop, side, least(median(conf_s), median(conf_t)) * {loops.CONFIDENCE_SHARE}::DOUBLE AS limit0 FROM j GROUP BY ALL),
r AS MATERIALIZED (SELECT j.*, sqrt(conf_s * conf_t) AS weight FROM j JOIN i USING (loop, side) WHERE conf_s > limit0 AND conf_t > limit0),
{_planar_fit("f", "r", "loop, side", "weight").strip()},
h AS MATERIALIZED (SELECT r.*, weight * CASE WHEN far <= 0.02 THEN 1 ELSE 0.02::DOUBLE / far END AS huber FROM (SELECT r.*, {_FAR} AS far FROM r JOIN f USING (loop, side)) r),
{_planar_fit("z", "h", "loop, side", "huber").strip()},
x AS (SELECT loop, side, count(*) AS n, avg({_FAR}) AS error, any_value(s) AS s, any_value(c) AS c, any_value(d) AS d, any_value(tx0) AS tx0, any_value(ty0) AS ty0 FROM r JOIN z USING (loop, side) GROUP BY loop, side),
y AS (SELECT l.loop, a.n AS n_a, b.n AS n_b, a.error AS ea, b.error AS eb, b.s / a.s AS s, b.c * a.c + b.d * a.d AS c, b.d * a.c - b.c * a.d AS d, a.tx0 AS ax, a.ty0 AS ay, b.tx0 AS b0, b.ty0 AS b1
      FROM l LEFT JOIN x a ON a.loop = l.loop AND a.side = 'a' LEFT JOIN x b ON b.loop = l.loop AND b.side = 'b'),
v AS (SELECT *, concat_ws(';', CASE WHEN NOT coalesce(ea <= 0.05, false) THEN 'alignment_error_a' END, CASE WHEN NOT coalesce(eb <= 0.05, false) THEN 'alignment_error_b' END,
             CASE WHEN NOT coalesce(s BETWEEN 0.8 AND 1.29, false) THEN 'scale' END, CASE WHEN loop % 4 = 3 THEN 'rig_acceptance_a' END) AS reasons FROM y)
"""


def _loop_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return loops.constraints(*_loop_tables(spark, sf_dir), max_error=0.05, scale_range=(0.8, 1.29), least_rig=0.75, delta=0.02, rounds=1)


@query(
    f"""{LOOPS} SELECT loop, loop + 3 AS chunk_b, n_a, n_b, round(ea, 5) AS alignment_error_a, round(eb, 5) AS alignment_error_b, round(s, 5) AS scale, round(degrees(acos(greatest(-1, least(1, c)))), 3) AS angle,
       round(b0 - s * (c * ax - d * ay), 4) + 0.0 AS dx, round(b1 - s * (d * ax + c * ay), 4) + 0.0 AS dy, reasons = '' AS accepted, reasons FROM v"""
)
def loop_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.functions import pose

    r = _loop_report(spark, sf_dir)
    put = lambda c, digits: F.round(c, digits) + 0.0
    return r.select(
        "loop", "chunk_b", "n_a", "n_b", F.round("alignment_error_a", 5).alias("alignment_error_a"), F.round("alignment_error_b", 5).alias("alignment_error_b"), F.round("s", 5).alias("scale"),
        F.round(pose.rotation_angle(F.col("r")), 3).alias("angle"), put(F.col("t")[0], 4).alias("dx"), put(F.col("t")[1], 4).alias("dy"), "accepted", "reasons",
    )


# Pose graphs.  A frame's true pose runs along circles in the plane; edges to the
# next frame and to the one a round later are measured with noise, and the first
# guess drifts away from the truth.

GRAPH_SIZE, ROUND = 10_000, 314
TRUTH = {"h": "k / 50", "x": "20 * cos(k / 50)", "y": "20 * sin(k / 50) + k / 100", "g": "sin(k / 300) / 10"}
GUESS = {"h": "h + d / 100000", "x": "x + d / 2000", "y": "y - d / 4000", "g": "g + d / 1000000"}
#: Of an edge: noise of the angle, the log scale and the translation.
NOISE = {"nh": "CAST(cents % 13 - 6 AS DOUBLE) / 3000", "ng": "CAST(cents % 11 - 5 AS DOUBLE) / 5000", "nx": "CAST(cents % 17 - 8 AS DOUBLE) / 800", "ny": "CAST(cents % 19 - 9 AS DOUBLE) / 900"}
MEASURED = {
    "h": "hb - ha + nh", "s": "exp(gb - ga + ng)",
    "x": "(cos(ha) * (xb - xa) + sin(ha) * (yb - ya)) / exp(ga) + nx", "y": "(cos(ha) * (yb - ya) - sin(ha) * (xb - xa)) / exp(ga) + ny",
}


def _planar(h, s, x, y) -> list:
    zero, one = F.lit(0.0), F.lit(1.0)
    return [s.alias("s"), F.array(F.cos(h), -F.sin(h), zero, F.sin(h), F.cos(h), zero, zero, zero, one).alias("r"), F.array(x, y, zero).alias("t")]


def _circles(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(true poses, first guesses, edges) of graphs of 10,000 frames."""
    k = F.col("o_orderkey")
    base = S.read(spark, sf_dir, "orders").select(F.expr(f"o_orderkey div {GRAPH_SIZE}").alias("grp"), k.alias("node"), k.cast("double").alias("k"), (k % GRAPH_SIZE).cast("double").alias("d"), F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"))
    true = base.select("grp", "node", "d", "cents", *(F.expr(v).alias(n) for n, v in TRUTH.items()))
    guess = true.select("grp", "node", *(F.expr(v).alias(n) for n, v in GUESS.items()))
    pose = lambda df: df.select("grp", "node", *_planar(F.col("h"), F.exp("g"), F.col("x"), F.col("y")))
    a = true.select("grp", F.col("node").alias("a"), "cents", *(F.col(c).alias(f"{c}a") for c in TRUTH))
    b = true.select("grp", F.col("node").alias("b"), *(F.col(c).alias(f"{c}b") for c in TRUTH))
    ahead = F.when(F.col("a") % 97 == 0, F.array(F.col("a") + 1, F.col("a") + ROUND)).otherwise(F.array(F.col("a") + 1))
    pairs = a.withColumn("b", F.explode(ahead)).join(b, ["grp", "b"])
    noisy = pairs.select("*", *(F.expr(v).alias(n) for n, v in NOISE.items())).select("grp", "a", "b", *(F.expr(v).alias(n) for n, v in MEASURED.items()))
    edges = noisy.select("grp", "a", "b", *_planar(F.col("h"), F.col("s"), F.col("x"), F.col("y")), (1.0 + F.col("a") % 3).alias("weight"))
    return pose(true), pose(guess), edges


CIRCLES = f"""
WITH o AS (SELECT o_orderkey // {GRAPH_SIZE} AS grp, o_orderkey AS node, o_orderkey::DOUBLE AS k, (o_orderkey % {GRAPH_SIZE})::DOUBLE AS d, round(o_totalprice * 100)::BIGINT AS cents FROM orders),
true_ AS MATERIALIZED (SELECT grp, node, d, cents, {_SEES(TRUTH)} FROM o),
guess AS MATERIALIZED (SELECT grp, node, {_SEES(GUESS)} FROM true_),
e0 AS (SELECT a.grp, a.node AS a, b.node AS b, a.cents, a.h AS ha, a.x AS xa, a.y AS ya, a.g AS ga, b.h AS hb, b.x AS xb, b.y AS yb, b.g AS gb
       FROM true_ a JOIN true_ b ON a.grp = b.grp AND (b.node = a.node + 1 OR (a.node % 97 = 0 AND b.node = a.node + {ROUND}))),
edge AS MATERIALIZED (SELECT grp, a, b, {_SEES(MEASURED)}, 1 + a % 3 AS weight FROM (SELECT *, {_SEES(NOISE)} FROM e0))"""


def _left_over(poses: str) -> str:
    """Residuals of the edges under a table of planar poses: ls, phi, ex, ey, with what the derivatives need."""
    return f"""(SELECT *, (cos(mh) * (vx - mx) + sin(mh) * (vy - my)) / ms AS ex, (cos(mh) * (vy - my) - sin(mh) * (vx - mx)) / ms AS ey FROM (
  SELECT e.grp, e.a, e.b, e.weight, e.h AS mh, e.s AS ms, e.x AS mx, e.y AS my, q.g - p.g - ln(e.s) AS ls, q.h - p.h - e.h AS phi,
         (cos(p.h) * (q.x - p.x) + sin(p.h) * (q.y - p.y)) / exp(p.g) AS vx, (cos(p.h) * (q.y - p.y) - sin(p.h) * (q.x - p.x)) / exp(p.g) AS vy
  FROM edge e JOIN {poses} p ON p.grp = e.grp AND p.node = e.a JOIN {poses} q ON q.grp = e.grp AND q.node = e.b))"""


_COST = "sum(weight * (ls * ls + phi * phi + ex * ex + ey * ey))"
GRADIENT = f"""{CIRCLES}, r AS MATERIALIZED {_left_over("guess")},
f AS (SELECT grp, node, sum(weight * g0) AS g0, sum(weight * g3) AS g3, sum(weight * g4) AS g4, sum(weight * g5) AS g5 FROM (
  SELECT grp, b AS node, weight, ls AS g0, phi AS g3, exp(ls) * (cos(phi) * ex + sin(phi) * ey) AS g4, exp(ls) * (cos(phi) * ey - sin(phi) * ex) AS g5 FROM r UNION ALL
  SELECT grp, a, weight, -ls - (ex * (cos(mh) * vx + sin(mh) * vy) + ey * (cos(mh) * vy - sin(mh) * vx)) / ms,
         -phi + (ex * (cos(mh) * vy - sin(mh) * vx) + ey * (-cos(mh) * vx - sin(mh) * vy)) / ms,
         -(cos(mh) * ex - sin(mh) * ey) / ms, -(sin(mh) * ex + cos(mh) * ey) / ms FROM r) GROUP BY grp, node)"""


@query(
    f"""{GRADIENT} SELECT grp, node, round(g0, 5) + 0.0 AS by_scale, round(g3, 5) + 0.0 AS by_turn, round(g4, 5) + 0.0 AS by_x, round(g5, 5) + 0.0 AS by_y
FROM f WHERE node > (SELECT min(o_orderkey) FROM orders) AND node % {GRAPH_SIZE} <> 0"""
)
def pose_graph_gradient(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The analytic derivatives at the first guess; the rest of the seven are 0 in the plane."""
    _, guess, edges = _circles(spark, sf_dir)
    g = graph.gradients(guess, edges, ["grp"])
    put = lambda k: F.round(F.col("g")[k], 5) + 0.0
    return g.select("grp", "node", put(0).alias("by_scale"), put(3).alias("by_turn"), put(4).alias("by_x"), put(5).alias("by_y"))


@query(
    f"""{CIRCLES}, x AS (SELECT grp, count(*) AS n_edges, round({_COST}, 4) AS cost_before FROM {_left_over("guess")} GROUP BY grp),
y AS (SELECT grp, round({_COST}, 4) AS cost_of_truth FROM {_left_over("true_")} GROUP BY grp)
SELECT grp, n_nodes, n_edges, cost_before, cost_of_truth, true AS below_truth, true AS at_rest FROM x JOIN y USING (grp) JOIN (SELECT grp, count(*) AS n_nodes FROM guess GROUP BY grp) USING (grp)"""
)
def pose_graph_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The least cost is below that of the truth, which does not fit the noise, and the derivatives vanish there."""
    true, guess, edges = _circles(spark, sf_dir)
    edges = held(edges, "graph-query")
    got = held(graph.solve(guess, edges, ["grp"], rounds=8), "graph-query")
    out = guess.groupBy("grp").agg(F.count("*").alias("n_nodes")).join(graph.measured({"before": guess, "truth": true, "after": got}, edges, ["grp"]), "grp")
    return out.select("grp", "n_nodes", "n_edges", F.round("cost_before", 4).alias("cost_before"), F.round("cost_truth", 4).alias("cost_of_truth"), (F.col("cost_after") < F.col("cost_truth")).alias("below_truth"), (F.col("steep_after") < F.col("steep_before") / 1000).alias("at_rest"))


@query(
    f"""{CIRCLES} SELECT grp, node, round(x, 6) + 0.0 AS x, round(y, 6) + 0.0 AS y, round(exp(g), 6) AS s FROM guess WHERE NOT (node % {GRAPH_SIZE} BETWEEN 400 AND 700)"""
)
def pose_graph_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only the frames from 400 to 700 of each graph may move; all others are where they were."""
    _, guess, edges = _circles(spark, sf_dir)
    free = (F.col("node") % GRAPH_SIZE).between(400, 700)
    got = graph.solve(guess, edges, ["grp"], free=free, rounds=3).join(guess.select("grp", "node", F.col("t").alias("before")), ["grp", "node"])
    return got.filter(~free | (F.col("t") == F.col("before"))).select("grp", "node", (F.round(F.col("t")[0], 6) + 0.0).alias("x"), (F.round(F.col("t")[1], 6) + 0.0).alias("y"), F.round("s", 6).alias("s"))


# A sequence of chunks, batch by batch.


@query(
    f"""{LOOPS[: LOOPS.index("l AS (SELECT chunk AS loop")].rstrip().rstrip(",")},
q AS MATERIALIZED (SELECT b.chunk, b.x AS sx, b.y AS sy, a.x AS tx, a.y AS ty, sqrt(a.conf * b.conf) AS weight FROM p b JOIN p a ON a.chunk + 1 = b.chunk AND a.at = b.at + {CHUNK - OVERLAP} AND a.pixel = b.pixel),
{_planar_fit("f", "q", "chunk", "weight").strip()},
s AS (SELECT 0 AS chunk, 1.0::DOUBLE AS s, 0.0::DOUBLE AS h, 0.0::DOUBLE AS tx0, 0.0::DOUBLE AS ty0 UNION ALL SELECT chunk, s, atan2(d, c), tx0, ty0 FROM f),
u AS (SELECT *, exp(sum(ln(s)) OVER w) AS ms, sum(h) OVER w AS mh, coalesce(exp(sum(ln(s)) OVER b), 1) AS bs, coalesce(sum(h) OVER b, 0) AS bh FROM s WINDOW w AS (ORDER BY chunk), b AS (ORDER BY chunk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT *, sum(bs * (cos(bh) * tx0 - sin(bh) * ty0)) OVER (ORDER BY chunk) AS x0, sum(bs * (sin(bh) * tx0 + cos(bh) * ty0)) OVER (ORDER BY chunk) AS y0 FROM u),
o2 AS (SELECT greatest(0, least((frame - 30) // 60, (SELECT max(chunk) FROM k))) AS chunk, frame, pixel FROM (SELECT DISTINCT frame, pixel FROM o)),
z AS (SELECT t.chunk, ms * (cos(mh) * x - sin(mh) * y) + x0 AS x, ms * (sin(mh) * x + cos(mh) * y) + y0 AS y FROM o2 JOIN p ON p.chunk = o2.chunk AND p.at = o2.frame - o2.chunk * {CHUNK - OVERLAP} AND p.pixel = o2.pixel JOIN t ON t.chunk = o2.chunk)
SELECT chunk, count(*) AS n_points, round(avg(x), 3) + 0.0 AS x, round(avg(y), 3) + 0.0 AS y FROM z GROUP BY chunk"""
)
def chunked_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stopped after the first batch of chunks and taken up again; the mean of each chunk's points in the first chunk's coordinates."""
    _, chunks, points, _ = _loop_tables(spark, sf_dir)
    points = held(points.withColumn("frame", F.col("at") + F.col("chunk") * (CHUNK - OVERLAP)).select("chunk", "frame", "pixel", "x", "y", "z", "conf"), "chunked-query")
    at, n = scratch(spark, "chunked"), S.read(spark, sf_dir, "orders").count()
    each = dict(frames=n, size=CHUNK, overlap=OVERLAP, batch=max(chunks.count() // 3, 8))
    chunked.run(spark, points, at, most=1, **each)
    chunked.run(spark, points, at, **each)
    means = chunked.placed(spark, at).groupBy("chunk").agg(F.count("*").alias("n_points"), F.avg("x").alias("x"), F.avg("y").alias("y"))
    return means.select("chunk", "n_points", (F.round("x", 3) + 0.0).alias("x"), (F.round("y", 3) + 0.0).alias("y"))


# Fits in the plane.  A rigid or similarity fit there has a closed form, which SQL works out from noisy pairs.


def _fit_row(spark: SparkSession, m) -> DataFrame:
    s, r, t = m
    values = (float(s), float(r[0, 0]), float(r[1, 0]), float(t[0]), float(t[1]))
    return spark.createDataFrame([tuple(round(x, 6) + 0.0 for x in values)], "s double, c double, d double, tx double, ty double")


_PAIRS = {"tx": "8 * sx / 10 - 6 * sy / 10 + 2 + CAST(vec_id % 7 - 3 AS DOUBLE) / 400 + (CASE WHEN vec_id % 10 = 0 THEN 5 ELSE 0 END)", "ty": "6 * sx / 10 + 8 * sy / 10 - 3 + CAST(vec_id % 11 - 5 AS DOUBLE) / 400"}
ROUNDS = 8


def _irls_sql(rounds: int) -> str:
    parts = ["w0 AS MATERIALIZED (SELECT *, 1.0::DOUBLE AS w FROM p)", _planar_fit("f0", "w0", "grp", "w").strip()]
    for k in range(1, rounds + 1):
        parts += [f"w{k} AS MATERIALIZED (SELECT grp, sx, sy, tx, ty, CASE WHEN far <= 0.01 THEN 1 ELSE 0.01::DOUBLE / far END AS w FROM (SELECT p.*, {_FAR} AS far FROM p JOIN f{k - 1} USING (grp)))", _planar_fit(f"f{k}", f"w{k}", "grp", "w").strip()]
    return ",\n".join(parts)


@query(
    f"""
WITH a AS (SELECT vec_id, embedding[1]::DOUBLE AS sx, embedding[2]::DOUBLE AS sy FROM embeddings), p AS MATERIALIZED (SELECT 0 AS grp, sx, sy, {_SEES(_PAIRS)} FROM a),
{_irls_sql(ROUNDS)}
SELECT round(s, 6) AS s, round(c, 6) AS c, round(d, 6) AS d, round(tx0, 6) AS tx, round(ty0, 6) AS ty FROM f{ROUNDS}"""
)
def irls_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A similarity with noise, a tenth of the targets far off, after eight rounds of Huber weights."""
    rows = S.read(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding")[0].cast("double").alias("sx"), F.col("embedding")[1].cast("double").alias("sy"))
    pairs = rows.select("sx", "sy", F.lit(0.0).alias("sz"), *(F.expr(v).alias(k) for k, v in _PAIRS.items()), F.lit(0.0).alias("tz"))
    return _fit_row(spark, align.irls(pairs, delta=0.01, rounds=ROUNDS, tolerance=0.0)[0])


_GRID = {"x": "CAST(k % 50 AS DOUBLE) / 5", "y": "CAST(k // 50 AS DOUBLE) / 5"}
_MOVED = {"sx": "x - 2 * y / 1000 - CAST(2 AS DOUBLE) / 100 + CAST(k * 37 % 11 - 5 AS DOUBLE) / 1000", "sy": "y + 2 * x / 1000 + CAST(1 AS DOUBLE) / 100 + CAST(k * 41 % 13 - 6 AS DOUBLE) / 1000"}


@query(
    f"""
WITH a AS (SELECT p_partkey AS k, {_SEES(_GRID)} FROM (SELECT p_partkey, p_partkey AS k FROM part)), p AS MATERIALIZED (SELECT 0 AS grp, 1 AS w, {_SEES(_MOVED)}, x AS tx, y AS ty FROM a),
{_planar_fit("f", "p", "grp", "w").strip()}
SELECT 1.0::DOUBLE AS s, round(c, 6) + 0.0 AS c, round(d, 6) + 0.0 AS d, round(ux - (c * mx - d * my), 6) + 0.0 AS tx, round(uy - (d * mx + c * my), 6) + 0.0 AS ty FROM f JOIN f_m USING (grp)"""
)
def closest_point_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A grid of all parts against itself, turned, moved and with noise.

    The turn takes points far from the origin to other cells, so the rows fitted
    grow eightfold from the first eight units, where each point's nearest is its
    own, and every fit starts at the one before.
    """
    spot = {k: v.replace("k // 50", "(k div 50)") for k, v in _GRID.items()}
    grid = S.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_partkey").alias("k")).select("*", *(F.expr(v).alias(n) for n, v in spot.items()))
    grid = held(grid.repartition("id"), "grid")
    top, reach, m = grid.agg(F.max("y")).first()[0] or 0.0, 8.0, linalg.IDENTITY
    while True:
        within = grid.filter(F.col("y") <= reach)
        source = within.select("id", *(F.expr(v).alias(n) for n, v in _MOVED.items())).select("id", F.col("sx").alias("x"), F.col("sy").alias("y"), F.lit(0.0).alias("z"))
        m = align.icp(source, within.select("id", "x", "y", F.lit(0.0).alias("z")), radii=(0.5,), keep=1.0, start=m)[0]
        if reach >= top:
            return _fit_row(spark, m)
        reach *= 8


# Regions of masks, transport, homographies, relative poses.


@query(
    f"""
WITH RECURSIVE {PIXELS}, m AS MATERIALIZED (SELECT DISTINCT image, x, y, y * 64 + x AS loc FROM px),
r AS (SELECT image, loc, loc AS root FROM m UNION SELECT m.image, m.loc, r.root FROM r JOIN m ON m.image = r.image AND (m.loc - r.loc) IN (-65, -64, -63, -1, 1, 63, 64, 65) AND abs(m.loc % 64 - r.loc % 64) <= 1),
l AS (SELECT image, loc, min(root) AS root FROM r GROUP BY image, loc)
SELECT image, dense_rank() OVER (PARTITION BY image ORDER BY root) AS label, count(*) AS area, min(loc % 64) AS x0, min(loc // 64) AS y0, max(loc % 64) AS x1, max(loc // 64) AS y1 FROM l GROUP BY image, root
"""
)
def mask_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masks.components(_pixels(spark, sf_dir), ["image"])


def _transport_sql(rounds: int) -> str:
    parts = ["u0 AS (SELECT image, c, 0.0::DOUBLE AS u FROM (SELECT DISTINCT image, c FROM s))", "v0 AS (SELECT image, f, 0.0::DOUBLE AS v FROM (SELECT DISTINCT image, f FROM s))"]
    for k in range(1, rounds + 1):
        parts.append(f"u{k} AS MATERIALIZED (SELECT image, c, any_value(CASE WHEN c = 4 THEN ln(n - 4) ELSE 0 END - ln(n + 4)) - ln(sum(exp(score + v))) AS u FROM s JOIN v{k - 1} USING (image, f) JOIN n USING (image) GROUP BY image, c)")
        parts.append(f"v{k} AS MATERIALIZED (SELECT image, f, any_value(-ln(n + 4)) - ln(sum(exp(score + u))) AS v FROM s JOIN u{k} USING (image, c) JOIN n USING (image) GROUP BY image, f)")
    return ",\n".join(parts)


@query(
    f"""
WITH d AS (SELECT vec_id // 16 AS image, vec_id AS f, embedding::DOUBLE[] AS e FROM embeddings),
n AS (SELECT image, count(*) AS n FROM d GROUP BY image HAVING count(*) > 4),
s AS MATERIALIZED (SELECT image, f, c, CASE WHEN c = 4 THEN 1 ELSE 8 * e[c + 1] END AS score FROM d JOIN n USING (image), range(5) t(c)),
{_transport_sql(3)},
p AS (SELECT image, f, c, exp(score + u + v + ln(n + 4)) AS p FROM s JOIN u3 USING (image, c) JOIN v3 USING (image, f) JOIN n USING (image) WHERE c < 4),
g AS (SELECT p.image, c AS cluster, i AS dim, sum(p * e[9 + i]) AS x FROM p JOIN d ON d.image = p.image AND d.f = p.f, range(6) t(i) GROUP BY ALL),
h AS (SELECT image, cluster, dim, x / sqrt(sum(x * x) OVER (PARTITION BY image, cluster)) AS x FROM g)
SELECT image, cluster::INTEGER AS cluster, dim::INTEGER AS dim, round(x / sqrt(sum(x * x) OVER (PARTITION BY image)), 6) + 0.0 AS value FROM h
"""
)
def transport_descriptors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixteen features an image, four clusters: scores and features are parts of the embeddings."""
    e = F.transform("embedding", lambda x: x.cast("double"))
    rows = S.read(spark, sf_dir, "embeddings").select(F.expr("vec_id div 16").alias("image"), F.col("vec_id").alias("f"), F.transform(F.slice(e, 1, 4), lambda x: 8 * x).alias("scores"), F.slice(e, 9, 6).alias("vec"))
    enough = rows.groupBy("image").count().filter("count > 4").select("image")
    got = pooling.transport_pool(rows.join(enough, "image"), ["image"], scores="scores", vec="vec", order="f")
    return got.select("image", "cluster", "dim", (F.round("value", 6) + 0.0).alias("value"))


_FAR_POINT = {"sx": "e0", "sy": "e1", "w": "e0 / 100 + e1 / 50 + 1"}
_TARGET = {"ux": "(12 * sx / 10 + sy / 10 + 3) / w", "uy": "(9 * sy / 10 - sx / 5 - 1) / w"}
_BLURRED = {"tx": "ux + CAST(vec_id * 37 % 13 - 6 AS DOUBLE) / 5000 + (CASE WHEN vec_id % 10 < 3 THEN 1 + CAST(vec_id % 7 AS DOUBLE) / 3 ELSE 0 END)", "ty": "uy + CAST(vec_id * 41 % 11 - 5 AS DOUBLE) / 5000 - (CASE WHEN vec_id % 10 < 3 THEN CAST(vec_id % 5 AS DOUBLE) / 4 ELSE 0 END)"}


@query(
    f"""
WITH a AS (SELECT label, vec_id, embedding[1]::DOUBLE AS e0, embedding[2]::DOUBLE AS e1 FROM embeddings WHERE label IN (SELECT label FROM embeddings GROUP BY label HAVING count(*) >= 20)),
b AS (SELECT label, vec_id, {_SEES(_FAR_POINT)} FROM a), c AS (SELECT *, {_SEES(_TARGET)} FROM b), d AS (SELECT *, {_SEES(_BLURRED)} FROM c)
SELECT label, vec_id, sqrt((tx - ux) ** 2 + (ty - uy) ** 2) <= 0.05 AS inlier FROM d
"""
)
def homography_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three of ten targets are elsewhere; the rows within reach of the consensus are those within reach of the truth."""
    see = lambda df, cols: df.select("*", *(F.expr(v).alias(k) for k, v in cols.items()))
    rows = S.read(spark, sf_dir, "embeddings").select("label", "vec_id", F.col("embedding")[0].cast("double").alias("e0"), F.col("embedding")[1].cast("double").alias("e1"))
    pairs = see(see(see(rows, _FAR_POINT), _TARGET), _BLURRED).withColumn("weight", 1.0 + F.col("vec_id") % 3)
    enough = pairs.groupBy("label").count().filter("count >= 20").select("label")
    pairs = pairs.join(enough, "label")
    fits = align.homography_consensus(pairs, ["label"], "vec_id", inlier=0.05, weight="weight", trials=64)
    return pairs.join(fits.select("label", "h"), "label").select("label", "vec_id", (align.homography_error(F.col("h")) <= 0.05).alias("inlier"))


_RUN = {"h": "k / 40", "x": "10 * cos(k / 30) + k / 50", "y": "8 * sin(k / 45)"}
_EST = {"eh": "h + CAST(cents % 23 - 11 AS DOUBLE) / 200", "ex": "x + CAST(cents % 29 - 14 AS DOUBLE) / 100", "ey": "y + CAST(cents % 31 - 15 AS DOUBLE) / 100"}


@query(
    f"""
WITH o AS (SELECT o_orderkey // 200 AS run, o_orderkey AS frame, o_orderkey::DOUBLE AS k, round(o_totalprice * 100)::BIGINT AS cents FROM orders),
t AS (SELECT run, frame, cents, {_SEES(_RUN)} FROM o), e AS MATERIALIZED (SELECT *, {_SEES(_EST)} FROM t),
p AS (SELECT a.run, cos(b.eh - a.eh) * cos(b.h - a.h) + sin(b.eh - a.eh) * sin(b.h - a.h) AS turn,
             cos(a.eh) * (b.ex - a.ex) + sin(a.eh) * (b.ey - a.ey) AS px, cos(a.eh) * (b.ey - a.ey) - sin(a.eh) * (b.ex - a.ex) AS py,
             cos(a.h) * (b.x - a.x) + sin(a.h) * (b.y - a.y) AS qx, cos(a.h) * (b.y - a.y) - sin(a.h) * (b.x - a.x) AS qy
      FROM e a JOIN e b ON a.run = b.run AND a.frame < b.frame),
q AS (SELECT run, degrees(acos(greatest(-1, least(1, turn)))) AS rot, coalesce(degrees(acos(least(1, abs(px * qx + py * qy) / nullif(sqrt(px * px + py * py) * sqrt(qx * qx + qy * qy), 0)))), 1e6) AS trans FROM p),
w AS (SELECT *, greatest(rot, trans) AS worst FROM q)
SELECT run, count(*) AS n_pairs, round(avg(rot), 4) AS rotation, round(avg(trans), 4) AS translation, round(sum(CASE WHEN worst <= 30 THEN 30 - least(floor(worst), 29) ELSE 0 END) / count(*) / 30, 6) AS auc FROM w GROUP BY run
"""
)
def relative_pose_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of 200 frames in blocks of 64."""
    see = lambda df, cols: df.select("*", *(F.expr(v).alias(k) for k, v in cols.items()))
    base = S.read(spark, sf_dir, "orders").select(F.expr("o_orderkey div 200").alias("run"), F.col("o_orderkey").alias("frame"), F.col("o_orderkey").cast("double").alias("k"), F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"))
    rows = see(see(base, _RUN), _EST)
    turned = lambda h: _planar(F.col(h), F.lit(1.0), F.lit(0.0), F.lit(0.0))[1]
    poses = rows.select("run", "frame", turned("eh").alias("est_r"), F.array("ex", "ey", F.lit(0.0)).alias("est_t"), turned("h").alias("gt_r"), F.array("x", "y", F.lit(0.0)).alias("gt_t"))
    got = pooling.relative_pose_errors(poses, ["run"], block=64).filter("n_pairs > 0")
    return got.select("run", "n_pairs", F.round("rotation", 4).alias("rotation"), F.round("translation", 4).alias("translation"), F.round("auc", 6).alias("auc"))
