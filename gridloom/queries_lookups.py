"""Queries over named joins, unions, orderings and greedy walks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom import stand_ins as S
from gridloom.functions import pose
from gridloom.operators import lookups, masks, reports, sampling, suppress, windows
from gridloom.plans import registry
from gridloom.queries import ORACLE, PLANE, PIXELS, _pixels, _plane, _quaternions, cyclic_retrieval, query


def T(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return S.read(spark, sf_dir, name)


@query(
    """
WITH j AS (SELECT o.o_orderkey, o.o_custkey, c.c_acctbal, c.c_custkey AS cam, o.o_orderpriority LIKE '%LOW' AS denied, EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_quantity > 20) AS there
           FROM orders o LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) c ON c.c_custkey = o.o_custkey),
r AS (SELECT *, CASE WHEN denied THEN 'denied' WHEN NOT there THEN 'no_file' WHEN cam IS NULL THEN 'no_camera' END AS reason FROM j)
SELECT o_orderkey, o_custkey, CASE WHEN reason IS NULL THEN c_acctbal END AS c_acctbal, reason FROM r
"""
)
def pose_camera_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = T(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    cameras = T(spark, sf_dir, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), "c_acctbal")
    files = T(spark, sf_dir, "lineitem").filter("l_quantity > 20").select(F.col("l_orderkey").alias("o_orderkey"))
    got = lookups.frames_with_cameras(frames, cameras, files, key="o_orderkey", camera="o_custkey", denied=F.col("o_orderpriority").endswith("LOW"))
    return got.drop("o_orderpriority")


@query("SELECT p_partkey, p_name, s_suppkey AS camera, s_acctbal - 0.5 AS cx, s_nationkey - 0.5::DOUBLE AS cy FROM part JOIN supplier ON s_suppkey = p_partkey % 50 + 1 WHERE contains(p_type, 'ECONOMY')")
def device_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = T(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type", (F.col("p_partkey") % 50 + 1).alias("camera"))
    cameras = T(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("camera"), F.col("s_acctbal").alias("cx"), F.col("s_nationkey").cast("double").alias("cy"))
    return lookups.device_frames(frames, cameras, name="p_type", camera="camera", device="ECONOMY").drop("p_type")


@query(
    """
SELECT vec_id, round(-embedding[1]::DOUBLE / 2, 9) + 0.0 AS x, round(-embedding[2]::DOUBLE / 2, 9) + 0.0 AS y, round(-embedding[3]::DOUBLE / 2, 9) + 0.0 AS z
FROM embeddings WHERE vec_id % 3 <> 1 AND vec_id % 5 <> 2
"""
)
def existing_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T(spark, sf_dir, "embeddings")
    still = F.array(*(F.lit(float(x)) for x in (1, 0, 0, 0, 1, 0, 0, 0, 1)))
    poses = rows.filter("vec_id % 5 <> 2").select("vec_id", pose.sim3(F.lit(2.0), still, F.slice(F.transform("embedding", lambda x: x.cast("double")), 1, 3)).alias("pose"))
    got = lookups.existing_frames(rows.count(), rows.filter("vec_id % 3 <> 1"), poses, key="vec_id")
    return got.select("vec_id", *((F.round(F.col("pose.t")[k], 9) + 0.0).alias(c) for k, c in enumerate("xyz")))


@query("SELECT c.c_custkey, min(o.o_orderkey) AS at FROM customer c JOIN orders o ON o.o_custkey = c.c_custkey WHERE c.c_custkey % 7 = 0 GROUP BY c.c_custkey")
def sampled_metadata_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    sampled = T(spark, sf_dir, "customer").filter("c_custkey % 7 = 0").select("c_custkey")
    full = T(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderkey").alias("at"))
    return lookups.match_index(sampled, full, path="c_custkey", index="at")


@query("SELECT d.doc_id, l.quality, CASE WHEN l.doc_id IS NULL THEN 'missing_gt' ELSE 'ok' END AS status FROM documents d LEFT JOIN labels l USING (doc_id)")
def prediction_target_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups.with_targets(T(spark, sf_dir, "documents").select("doc_id"), T(spark, sf_dir, "labels").select("doc_id", "quality"), path="doc_id")


@query("SELECT p.place::INTEGER AS place, o_orderkey, o_totalprice FROM (SELECT unnest([7, 3, 7, 0, 100, 999999999]) AS k, unnest(range(6)) AS place) p JOIN orders ON o_orderkey = p.k")
def sampled_take(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups.take(T(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", [7, 3, 7, 0, 100, 999999999])


@query(
    """
WITH p AS (SELECT vec_id, 1 + vec_id % 3 AS s, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings),
e AS (SELECT a.vec_id AS a, b.vec_id AS b, b.s / a.s AS s, (b.x - a.x) / a.s AS x, (b.y - a.y) / a.s AS y, (b.z - a.z) / a.s AS z FROM p a JOIN p b ON b.vec_id = a.vec_id + 3)
SELECT a, b, round(s / 2, 9) AS s, round((x - 0.5) / 2, 9) + 0.0 AS x, round(y / 2, 9) + 0.0 AS y, round((z + 0.25) / 2, 9) + 0.0 AS z FROM e
"""
)
def edge_pose_residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T(spark, sf_dir, "embeddings")
    still = F.array(*(F.lit(float(x)) for x in (1, 0, 0, 0, 1, 0, 0, 0, 1)))
    poses = rows.select("vec_id", pose.sim3((1 + F.col("vec_id") % 3).cast("double"), still, F.slice(F.transform("embedding", lambda x: x.cast("double")), 1, 3)).alias("pose"))
    edges = rows.select(F.col("vec_id").alias("a"), (F.col("vec_id") + 3).alias("b"), pose.sim3(F.lit(2.0), still, F.array(F.lit(0.5), F.lit(0.0), F.lit(-0.25))).alias("edge"))
    got = lookups.edge_poses(edges, poses, a="a", b="b", node="vec_id")
    return got.select("a", "b", F.round("residual.s", 9).alias("s"), *((F.round(F.col("residual.t")[k], 9) + 0.0).alias(c) for k, c in enumerate("xyz")))


@query(f"WITH {PIXELS}, t AS (SELECT DISTINCT image, x * 64 + y AS position, min(instance) OVER (PARTITION BY image, x, y) AS track FROM px WHERE instance <= 3) SELECT DISTINCT dx.image, x * 64 + y AS position, track FROM dx LEFT JOIN t ON t.image = dx.image AND t.position = x * 64 + y")
def pixel_track_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = _pixels(spark, sf_dir).withColumn("position", F.col("x") * 64 + F.col("y"))
    tracks = px.filter("instance <= 3").groupBy("image", "position").agg(F.min("instance").alias("track"))
    return lookups.pixel_tracks(px.select("image", "position").distinct(), tracks, frame="image", position="position", track="track")


@query(
    """
WITH r AS (SELECT s_suppkey, concat('floor_', s_nationkey % 3, '/run_', lpad(s_suppkey::VARCHAR, 6, '0')) AS path, s_nationkey % 3 AS floor FROM supplier),
p AS (SELECT *, row_number() OVER (ORDER BY path) - 1 AS place FROM r WHERE floor IN (0, 2))
SELECT s_suppkey, path, floor::INTEGER AS floor, place FROM p WHERE place % 4 = 1 ORDER BY place LIMIT 12
"""
)
def run_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    floor = (F.col("s_nationkey") % 3).alias("floor")
    path = F.concat(F.lit("floor_"), (F.col("s_nationkey") % 3).cast("string"), F.lit("/run_"), F.lpad(F.col("s_suppkey").cast("string"), 6, "0")).alias("path")
    return lookups.select_runs(T(spark, sf_dir, "supplier").select("s_suppkey", path, floor), path="path", floor="floor", floors=[0, 2], workers=4, worker=1, limit=12)


_LOOPS = "l AS (SELECT o_orderkey AS image_a, o_custkey AS image_b, o_totalprice AS sim FROM orders)"


def _loops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("image_a"), F.col("o_custkey").alias("image_b"), F.col("o_totalprice").alias("sim"))


@query(f"WITH {_LOOPS} SELECT * FROM l")
def loops_by_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups.best_pairs(_loops(spark, sf_dir), "sim", ["image_a", "image_b"])


@query(f"WITH {_LOOPS} SELECT * FROM l ORDER BY sim DESC, image_a, image_b LIMIT 10")
def loops_top_ten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups.best_pairs(_loops(spark, sf_dir), "sim", ["image_a", "image_b"], 10)


@query(f"WITH {_LOOPS} SELECT * FROM l ORDER BY image_a LIMIT 25")
def external_pairs_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups.head(_loops(spark, sf_dir), "image_a", 25)


@query("SELECT vec_id // 4 AS capture, (vec_id % 4)::INTEGER AS view, label FROM embeddings")
def capture_view_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.views(spark, sf_dir).join(T(spark, sf_dir, "embeddings").select(F.expr("vec_id div 4").alias("capture"), (F.col("vec_id") % 4).cast("int").alias("view"), "label"), ["capture", "view"])
    return lookups.lexicographic(rows.select("capture", "view", "label"), ["capture", "view"])


@query("SELECT l_quantity AS x, l_tax AS conf, 0 AS part FROM lineitem WHERE l_linestatus = 'F' UNION ALL SELECT l_quantity, l_tax, 1 FROM lineitem WHERE l_linestatus = 'O' UNION ALL SELECT p_retailprice, NULL, 2 FROM part")
def cloud_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    side = lambda s: T(spark, sf_dir, "lineitem").filter(F.col("l_linestatus") == s).select(F.col("l_quantity").alias("x"), F.col("l_tax").alias("conf"))
    return lookups.concatenated([side("F"), side("O"), T(spark, sf_dir, "part").select(F.col("p_retailprice").alias("x"))], "part")


@query(
    """
WITH n AS (SELECT user_id, event_type, max(value) AS value FROM events WHERE event_id % 3 = 0 GROUP BY ALL), o AS (SELECT user_id, event_type, min(value) AS value FROM events GROUP BY ALL)
SELECT * FROM n UNION ALL SELECT * FROM o WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.user_id = o.user_id AND n.event_type = o.event_type)
"""
)
def object_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, keys = S.series(spark, sf_dir), ["user_id", "event_type"]
    return lookups.upsert(rows.groupBy(*keys).agg(F.min("value").alias("value")), rows.filter("event_id % 3 = 0").groupBy(*keys).agg(F.max("value").alias("value")), keys)


@query(f"WITH {_LOOPS} SELECT image_a, image_b, sim FROM l WHERE sim > 300000 UNION ALL SELECT n_nationkey, n_regionkey, NULL FROM nation")
def loops_appended(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = T(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("image_a"), F.col("n_regionkey").cast("long").alias("image_b"))
    return lookups.append_or_replace(_loops(spark, sf_dir).filter("sim > 300000"), given, replace=False)


@query("SELECT p_partkey, CASE WHEN p_size BETWEEN 10 AND 30 AND p_retailprice > 1000 THEN 'inside' ELSE 'outside' END AS part FROM part")
def inside_outside(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups.parted(T(spark, sf_dir, "part"), F.col("p_size").between(10, 30) & (F.col("p_retailprice") > 1000)).select("p_partkey", "part")


@query(
    """
WITH p AS (SELECT event_id AS i, value AS v FROM events)
SELECT a.i, b.i AS j, CASE WHEN abs(a.v - b.v) <= 5 THEN 1 ELSE 0 END AS label FROM p a JOIN p b ON b.i - a.i BETWEEN 3 AND 12 WHERE abs(a.v - b.v) <= 5 OR abs(a.v - b.v) >= 60
"""
)
def gap_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups.gap_labels(S.series(spark, sf_dir), "event_id", ["value"], reach=12, gap=3, positive=5.0, negative=60.0)


@query("SELECT user_id, max(value) FILTER (WHERE event_type = 'click') AS click, max(value) FILTER (WHERE event_type = 'view') AS view FROM events GROUP BY user_id")
def method_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups.compare_methods(S.series(spark, sf_dir), "user_id", "event_type", "value", ["click", "view"])


@query("SELECT o_orderkey, mode, CASE mode WHEN 'none' THEN o_totalprice WHEN 'rigid' THEN round(o_totalprice - 100, 6) ELSE round(o_totalprice * 0.5, 6) END AS value FROM orders, (SELECT unnest(['none', 'rigid', 'sim3']) AS mode)")
def evaluation_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("o_totalprice")
    return lookups.by_mode(T(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), {"none": x, "rigid": F.round(x - 100, 6), "sim3": F.round(x * 0.5, 6)}).drop("o_totalprice")


@query(
    """
WITH l AS (SELECT n_regionkey, n_nationkey, string_agg(concat('"', s_suppkey, '":', s_nationkey), ',' ORDER BY s_suppkey::VARCHAR) AS leaves FROM supplier JOIN nation ON n_nationkey = s_nationkey GROUP BY ALL)
SELECT n_regionkey, count(*) AS n_inner, string_agg(concat(n_nationkey, '={', leaves, '}'), ';' ORDER BY n_nationkey::VARCHAR) AS report FROM l GROUP BY n_regionkey
"""
)
def nested_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T(spark, sf_dir, "supplier").join(T(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_regionkey"), "s_nationkey")
    got = lookups.nested_reports(rows, "n_regionkey", "s_nationkey", "s_suppkey", "s_nationkey")
    each = F.transform(F.map_entries("report"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return got.select("n_regionkey", F.size("report").cast("long").alias("n_inner"), F.array_join(each, ";").alias("report"))


@query(
    "WITH s AS (SELECT x.vec_id // 4 AS a, x.vec_id % 4 AS va, y.vec_id % 4 AS vb, round(list_dot_product(x.embedding::DOUBLE[], y.embedding::DOUBLE[]), 6) + 0.0 AS s FROM embeddings x JOIN embeddings y ON y.vec_id // 4 = x.vec_id // 4 + 1) SELECT a, "
    + ", ".join(f"max(s) FILTER (WHERE va = {x} AND vb = {y}) AS score_v{x}_v{y}" for x in range(4) for y in range(4))
    + " FROM s GROUP BY a"
)
def capture_pair_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = S.views(spark, sf_dir)
    nexts = v.select((F.col("capture") - 1).alias("a"), F.col("view").alias("vb"), F.col("vec").alias("y"))
    dot = F.aggregate(F.zip_with("vec", "y", lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, x: s + x)
    scores = v.withColumnsRenamed({"capture": "a", "view": "va"}).join(nexts, "a").select("a", "va", "vb", (F.round(dot, 6) + 0.0).alias("s"))
    return lookups.wide_scores(scores, ["a"], "va", "vb", "s", 4)


@query("SELECT l_linestatus, count(l_orderkey) AS n_rows, count(DISTINCT l_orderkey) AS n_frames, count(l_orderkey) = count(DISTINCT l_orderkey) AS exactly_once FROM lineitem GROUP BY l_linestatus")
def frame_owner_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups.owner_counts(T(spark, sf_dir, "lineitem"), ["l_linestatus"], "l_orderkey")


@query(
    """
WITH t AS (SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_custkey END AS finished FROM orders)
SELECT * FROM t WHERE finished IS NULL UNION ALL (SELECT * FROM t WHERE 1000 - finished <= 600 ORDER BY finished DESC, o_orderkey DESC LIMIT 100)
"""
)
def task_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    tasks = T(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "F", F.col("o_custkey")).alias("finished"))
    return lookups.retained(tasks, finished="finished", now=1000, ttl=600, most=100, key="o_orderkey")


@query("SELECT mode, r_name AS dataset, n_name AS scene FROM nation JOIN region ON n_regionkey = r_regionkey, (SELECT unnest(['pose', 'recon']) AS mode) WHERE r_name IN ('ASIA', 'EUROPE')")
def evaluation_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    scenes = T(spark, sf_dir, "nation").join(T(spark, sf_dir, "region").select(F.col("r_regionkey").alias("n_regionkey"), "r_name"), "n_regionkey").select(F.col("r_name").alias("dataset"), F.col("n_name").alias("scene"))
    return lookups.evaluation_grid(spark, ["pose", "recon"], ["ASIA", "EUROPE"], scenes)


# Functions of other modules.


@query("SELECT o_orderkey, l_linenumber, l_quantity FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_discount > 0.03 AND l_tax >= 0.02")
def mask_quality_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T(spark, sf_dir, "lineitem").join(T(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey")
    return masks.quality_filter(rows, iou="l_discount", stability_col="l_tax", least_iou=0.03, least_stability=0.02).select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_quantity")


@query(f"WITH {PIXELS}, n AS (SELECT image, instance, count(*) AS n FROM dx GROUP BY ALL), s AS (SELECT a.image, a.instance AS a, b.instance AS b, count(*) AS shared FROM dx a JOIN dx b ON a.image = b.image AND a.x = b.x AND a.y = b.y AND a.instance >= 4 AND b.instance < 4 GROUP BY ALL), f AS (SELECT s.image, s.a AS instance, min(b) AS id FROM s JOIN n na ON na.image = s.image AND na.instance = a JOIN n nb ON nb.image = s.image AND nb.instance = b WHERE shared / (na.n + nb.n - shared) > 0.01 GROUP BY ALL) SELECT DISTINCT dx.image, dx.instance, f.id FROM dx LEFT JOIN f USING (image, instance) WHERE dx.instance >= 4")
def tracked_mask_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _pixels(spark, sf_dir)
    return masks.keep_ids(p.filter("instance >= 4"), p.filter("instance < 4"), "image", 0.01)


@query(
    """
SELECT l_orderkey, l_linenumber, l_tax >= 0.03 AND l_tax > 1e-5 AS confident, l_tax > 0.02 AND l_discount > 0.02 AND l_quantity > 1e-3 AND l_quantity < 100 AND l_discount > 1e-3 AND l_discount < 100 AS valid,
       CASE WHEN l_tax > 0.05 AND l_discount > 0.05 THEN round((l_quantity + l_extendedprice) / 2, 6) WHEN l_tax >= l_discount THEN l_quantity ELSE l_extendedprice END AS scale FROM lineitem
"""
)
def confidence_and_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, d, q, p = (F.col(x) for x in ("l_tax", "l_discount", "l_quantity", "l_extendedprice"))
    scale = F.round(masks.choose_scale(q, p, c, d, 0.05), 6)
    return T(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", masks.confident(c, 0.03).alias("confident"), masks.depth_valid(c, d, q, d, 0.02).alias("valid"), scale.alias("scale"))


@query(
    """
WITH p AS (SELECT event_id, value, user_id FROM events),
c AS (SELECT k AS chunk FROM range(0, (SELECT ceil(max(event_id) / 20.0)::BIGINT FROM events)) t(k))
SELECT user_id AS a, event_id AS b, x.chunk AS chunk_a, y.chunk AS chunk_b FROM p JOIN c x ON user_id >= x.chunk * 20 AND user_id < x.chunk * 20 + 30 JOIN c y ON event_id >= y.chunk * 20 AND event_id < y.chunk * 20 + 30
"""
)
def loop_chunk_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.series(spark, sf_dir)
    many = -(-(rows.agg(F.max("event_id")).first()[0] or 0) // 20)
    chunks = spark.range(many).withColumnRenamed("id", "chunk")
    return windows.range_pairs(rows.select(F.col("user_id").alias("a"), F.col("event_id").alias("b")), chunks, a="a", b="b", size_step=(30, 20))


@query("SELECT chunk, greatest(0, least(chunk * 100, n - 150)) AS start, least(greatest(0, least(chunk * 100, n - 150)) + 150, n) AS \"end\" FROM (SELECT count(*) AS n FROM orders), range(0, (SELECT ceil((count(*) - 150) / 100.0)::BIGINT + 1 FROM orders)) t(chunk)")
def anchored_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.anchored_windows(spark, T(spark, sf_dir, "orders").count(), 150, 100)


@query("SELECT o_orderkey, greatest(0, least(o_orderkey - 20, n - 40))::BIGINT AS start, least(greatest(0, least(o_orderkey - 20, n - 40)) + 40, n)::BIGINT AS \"end\" FROM orders, (SELECT count(*) AS n FROM orders)")
def half_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T(spark, sf_dir, "orders")
    return rows.select("o_orderkey", reports.half_window(F.col("o_orderkey"), 20, rows.count()).alias("w")).select("o_orderkey", "w.start", "w.end")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey % 4 = 0")
def video_frame_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.frame_rate(T(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 30.0, 7.0)


@query("SELECT o_orderkey FROM orders WHERE (o_orderkey + 1) % 5 = 0")
def counted_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.counted(T(spark, sf_dir, "orders").select("o_orderkey"), F.col("o_orderkey"), 5)


@query("SELECT event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY md5(concat('5|', event_id)), event_id) <= 40")
def sample_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.exact_per_group(S.series(spark, sf_dir).select("event_type", "event_id"), ["event_type"], ["event_id"], 40, seed=5)


@query("SELECT event_type, event_id FROM events WHERE value > 20 QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY md5(concat('5|', event_id)), event_id) <= floor(count(*) OVER (PARTITION BY event_type) * 0.1)")
def chunk_seeded_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.share_per_group(S.series(spark, sf_dir).filter("value > 20").select("event_type", "event_id"), ["event_type"], ["event_id"], 0.1, seed=5)


@query("SELECT round(avg(coalesce(CASE WHEN event_id % 3 = 0 THEN value END, CASE WHEN event_id % 2 = 0 THEN user_id::DOUBLE END)), 6) AS mean, count(coalesce(CASE WHEN event_id % 3 = 0 THEN value END, CASE WHEN event_id % 2 = 0 THEN user_id::DOUBLE END)) AS n FROM events WHERE event_type NOT IN ('click')")
def selective_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.series(spark, sf_dir).withColumns({"m1": F.when(F.col("event_id") % 3 == 0, F.col("value")), "m2": F.when(F.col("event_id") % 2 == 0, F.col("user_id").cast("double"))})
    return reports.selective_mean(rows, "event_type", ["m1", "m2"], ["click"]).withColumn("mean", F.round("mean", 6))


@query("SELECT p_partkey, CASE WHEN p_retailprice >= -p_size THEN 'price' ELSE 'size' END AS best, CASE WHEN -p_size <= p_retailprice THEN 'size' ELSE 'price' END AS worst FROM part")
def best_and_worst(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T(spark, sf_dir, "part").select("p_partkey", F.col("p_retailprice").alias("price"), F.col("p_size").alias("size"))
    return reports.best_and_worst(rows, "p_partkey", {"price": True, "size": False})


@query("SELECT conv_id, concat(role, '_', turn, '_x') AS key, role AS dataset, concat(turn, '_x') AS mode FROM conversations WHERE NOT contains(role, '_')")
def dataset_and_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T(spark, sf_dir, "conversations").filter(~F.col("role").contains("_")).select("conv_id", F.concat_ws("_", "role", F.col("turn").cast("string"), F.lit("x")).alias("key"))
    return reports.by_dataset(rows, "key")


@query("SELECT m AS method, s_suppkey::VARCHAR AS run, n AS name FROM supplier, (SELECT unnest(['a', 'b']) AS m), (SELECT unnest(['poses', 'cloud']) AS n) WHERE NOT (m = 'a' AND s_suppkey % 3 = 0) AND NOT (n = 'cloud' AND s_suppkey % 2 = 0)")
def missing_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("run"), "s_suppkey")
    each = lambda xs, c: F.explode(F.array(*(F.lit(x) for x in xs))).alias(c)
    grid = rows.select("*", each(["a", "b"], "method")).select("*", each(["poses", "cloud"], "name"))
    present = grid.filter("(method = 'a' and s_suppkey % 3 = 0) or (name = 'cloud' and s_suppkey % 2 = 0)")
    return registry.absent(["a", "b"], rows.select("run"), ["poses", "cloud"], present)


# Greedy walks: the oracle keeps, step by step, what the walk has kept so far.

_CYCLIC = ORACLE["cyclic_retrieval"].strip().removeprefix("WITH").strip()
_HEAD, _, _TAIL = _CYCLIC.rpartition("SELECT a, b, shift::INTEGER")
ORACLE["capture_nms"] = f"""
WITH RECURSIVE {_HEAD.strip()},
q AS (SELECT a, b, shift::INTEGER {_TAIL}),
o AS (SELECT *, row_number() OVER (ORDER BY mean DESC, a, b) AS i FROM q),
w(i, kept) AS (SELECT 0::BIGINT, []::STRUCT(a BIGINT, b BIGINT, i BIGINT)[]
  UNION ALL SELECT o.i, CASE WHEN len(list_filter(kept, lambda k: abs(k.a - o.a) <= 3 AND abs(k.b - o.b) <= 3)) = 0 THEN list_append(kept, {{'a': o.a, 'b': o.b, 'i': o.i}}) ELSE kept END FROM w JOIN o ON o.i = w.i + 1),
k AS (SELECT unnest(kept).i AS i FROM (SELECT kept FROM w ORDER BY i DESC LIMIT 1))
SELECT o.* EXCLUDE (i) FROM o JOIN k USING (i)
"""
ORACLE["box_nms"] = """
WITH RECURSIVE b AS (SELECT vec_id AS id, label, embedding[3]::DOUBLE AS score, embedding[1]::DOUBLE - 0.1::DOUBLE AS x0, embedding[2]::DOUBLE - 0.15::DOUBLE AS y0, embedding[1]::DOUBLE + 0.1::DOUBLE AS x1, embedding[2]::DOUBLE + 0.15::DOUBLE AS y1 FROM embeddings),
o AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, id) AS i FROM b),
w(label, i, kept) AS (SELECT DISTINCT label, 0::BIGINT, []::STRUCT(x0 DOUBLE, y0 DOUBLE, x1 DOUBLE, y1 DOUBLE, id BIGINT)[] FROM b
  UNION ALL SELECT o.label, o.i, CASE WHEN len(list_filter(list_transform(kept, lambda k: greatest(least(k.x1, o.x1) - greatest(k.x0, o.x0), 0) * greatest(least(k.y1, o.y1) - greatest(k.y0, o.y0), 0)
         - 0.3 * ((k.x1 - k.x0) * (k.y1 - k.y0) + (o.x1 - o.x0) * (o.y1 - o.y0) - greatest(least(k.x1, o.x1) - greatest(k.x0, o.x0), 0) * greatest(least(k.y1, o.y1) - greatest(k.y0, o.y0), 0))), lambda d: d > 0)) = 0
       THEN list_append(kept, {'x0': o.x0, 'y0': o.y0, 'x1': o.x1, 'y1': o.y1, 'id': o.id}) ELSE kept END FROM w JOIN o ON o.label = w.label AND o.i = w.i + 1),
k AS (SELECT unnest(kept).id AS id FROM (SELECT kept FROM w QUALIFY row_number() OVER (PARTITION BY label ORDER BY i DESC) = 1))
SELECT b.* FROM b JOIN k USING (id)
"""
ORACLE["radius_thinning"] = f"""
WITH RECURSIVE {PLANE.split('p AS (')[0].strip().rstrip(',')},
c AS (SELECT r.*, c_mktsegment FROM r JOIN customer ON c_custkey = r.id),
o AS (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY md5(concat('42|', id)), id) AS i FROM c),
w(seg, i, kept) AS (SELECT DISTINCT c_mktsegment, 0::BIGINT, []::STRUCT(x DOUBLE, y DOUBLE, id BIGINT)[] FROM c
  UNION ALL SELECT w.seg, o.i, CASE WHEN len(list_filter(kept, lambda k: sqrt((k.x - o.x) * (k.x - o.x) + (k.y - o.y) * (k.y - o.y)) <= 200)) = 0 THEN list_append(kept, {{'x': o.x, 'y': o.y, 'id': o.id}}) ELSE kept END
  FROM w JOIN o ON o.c_mktsegment = w.seg AND o.i = w.i + 1),
k AS (SELECT unnest(kept).id AS id FROM (SELECT kept FROM w QUALIFY row_number() OVER (PARTITION BY seg ORDER BY i DESC) = 1))
SELECT c.* REPLACE (y::DOUBLE AS y) FROM c JOIN k USING (id)
"""
_WALK = "s AS (SELECT user_id, epoch_us(ts) AS ts, event_id, event_type, value FROM events)"
ORACLE["greedy_sync"] = f"""
WITH RECURSIVE {_WALK},
l AS (SELECT user_id, list({{'t': ts, 'k': event_id}} ORDER BY ts, event_id) FILTER (WHERE event_type = 'view') AS a, list({{'t': ts, 'k': event_id}} ORDER BY ts, event_id) FILTER (WHERE event_type = 'click') AS b FROM s GROUP BY user_id),
w AS (SELECT user_id, a, b, 1 AS i, 1 AS j, NULL::BIGINT AS x, NULL::BIGINT AS y, NULL::BIGINT AS gap FROM l WHERE len(a) > 0 AND len(b) > 0
  UNION ALL SELECT user_id, a, b, CASE WHEN a[i].t - b[j].t <= 21600000000 THEN i + 1 ELSE i END, CASE WHEN a[i].t - b[j].t >= -21600000000 THEN j + 1 ELSE j END,
    CASE WHEN abs(a[i].t - b[j].t) <= 21600000000 THEN a[i].k END, CASE WHEN abs(a[i].t - b[j].t) <= 21600000000 THEN b[j].k END, CASE WHEN abs(a[i].t - b[j].t) <= 21600000000 THEN a[i].t - b[j].t END
  FROM w WHERE i <= len(a) AND j <= len(b))
SELECT user_id, x AS a, y AS b, gap FROM w WHERE x IS NOT NULL
"""
ORACLE["slot_sync"] = f"""
WITH RECURSIVE {_WALK},
o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM s WHERE event_type IN ('view', 'click')),
w AS (SELECT DISTINCT user_id, 0::BIGINT AS i, NULL::BIGINT AS vt, NULL::BIGINT AS vk, NULL::BIGINT AS ct, NULL::BIGINT AS ck, false AS hit FROM o
  UNION ALL SELECT user_id, i, vt, vk, ct, ck, coalesce(abs(vt - ct) <= 21600000000, false) FROM (
    SELECT o.user_id, o.i, CASE WHEN o.event_type = 'view' THEN o.ts WHEN NOT w.hit THEN w.vt END AS vt, CASE WHEN o.event_type = 'view' THEN o.event_id WHEN NOT w.hit THEN w.vk END AS vk,
           CASE WHEN o.event_type = 'click' THEN o.ts WHEN NOT w.hit THEN w.ct END AS ct, CASE WHEN o.event_type = 'click' THEN o.event_id WHEN NOT w.hit THEN w.ck END AS ck
    FROM w JOIN o ON o.user_id = w.user_id AND o.i = w.i + 1))
SELECT user_id, vk AS a, ck AS b, vt - ct AS gap FROM w WHERE hit
"""
ORACLE["ema_gravity"] = f"""
WITH RECURSIVE {_WALK},
o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM s),
w AS (SELECT user_id, ts, event_id, i, value AS smooth FROM o WHERE i = 1
  UNION ALL SELECT o.user_id, o.ts, o.event_id, o.i, w.smooth + (1 - exp(-greatest((o.ts - w.ts) / 1e6::DOUBLE, 1e-6::DOUBLE) / 86400.0::DOUBLE)) * (o.value - w.smooth) FROM w JOIN o ON o.user_id = w.user_id AND o.i = w.i + 1)
SELECT user_id, ts, event_id, round(smooth, 6) AS smooth FROM w
"""


@query(
    """
WITH RECURSIVE p AS (SELECT o_custkey % 20 AS grp, o_orderkey, o_orderkey % 40 AS x, o_custkey % 37 AS y FROM orders),
o AS (SELECT *, least(x, y) AS lo, greatest(x, y) AS hi, row_number() OVER (PARTITION BY grp ORDER BY o_orderkey) AS i FROM p),
w(grp, i, kept) AS (SELECT DISTINCT grp, 0::BIGINT, []::STRUCT(lo BIGINT, hi BIGINT, k BIGINT)[] FROM p
  UNION ALL SELECT w.grp, o.i, CASE WHEN lo <> hi AND len(list_filter(kept, lambda k: abs(k.lo - o.lo) <= 2 AND abs(k.hi - o.hi) <= 2)) = 0 THEN list_append(kept, {'lo': lo, 'hi': hi, 'k': o_orderkey}) ELSE kept END FROM w JOIN o ON o.grp = w.grp AND o.i = w.i + 1),
k AS (SELECT unnest(kept).k AS o_orderkey FROM (SELECT kept FROM w QUALIFY row_number() OVER (PARTITION BY grp ORDER BY i DESC) = 1))
SELECT p.* FROM p JOIN k USING (o_orderkey)
"""
)
def chunk_event_nms(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T(spark, sf_dir, "orders").select((F.col("o_custkey") % 20).alias("grp"), "o_orderkey", (F.col("o_orderkey") % 40).alias("x"), (F.col("o_custkey") % 37).alias("y"))
    return suppress.event_nms(rows, ["grp"], "o_orderkey", "x", "y", 2)


_EDGES = """p AS (SELECT o_custkey % 20 AS grp, o_orderkey % 90 AS x, o_custkey % 83 AS y, min(o_totalprice) AS mag FROM orders GROUP BY ALL)"""


@query(
    f"""
WITH RECURSIVE {_EDGES},
o AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY mag, x, y) AS i FROM p WHERE abs(x - y) >= 30),
w(grp, i, kept) AS (SELECT DISTINCT grp, 0::BIGINT, []::STRUCT(x BIGINT, y BIGINT)[] FROM p
  UNION ALL SELECT w.grp, o.i, CASE WHEN len(kept) < 25 AND len(list_filter(kept, lambda k: abs(k.x - o.x) <= 2 AND abs(k.y - o.y) <= 2)) = 0 THEN list_append(kept, {{'x': x, 'y': y}}) ELSE kept END FROM w JOIN o ON o.grp = w.grp AND o.i = w.i + 1),
k AS (SELECT grp, unnest(kept) AS e FROM (SELECT grp, kept FROM w QUALIFY row_number() OVER (PARTITION BY grp ORDER BY i DESC) = 1))
SELECT p.* FROM p JOIN k ON k.grp = p.grp AND k.e.x = p.x AND k.e.y = p.y
"""
)
def edge_reduction(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T(spark, sf_dir, "orders").groupBy((F.col("o_custkey") % 20).alias("grp"), (F.col("o_orderkey") % 90).alias("x"), (F.col("o_custkey") % 83).alias("y")).agg(F.min("o_totalprice").alias("mag"))
    return suppress.reduce_edges(rows, ["grp"], "mag", "x", "y", most=25)


@query(
    f"""
WITH RECURSIVE {_EDGES},
o AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY mag DESC, x, y) AS i FROM p),
w(grp, i, taken, kept) AS (SELECT DISTINCT grp, 0::BIGINT, []::BIGINT[], []::STRUCT(x BIGINT, y BIGINT)[] FROM p
  UNION ALL SELECT grp, i, CASE WHEN good THEN list_concat(taken, [x, y]) ELSE taken END, CASE WHEN good THEN list_append(kept, {{'x': x, 'y': y}}) ELSE kept END
    FROM (SELECT w.grp, o.i, taken, kept, x, y, len(list_filter(taken, lambda t: abs(t - o.x) <= 4 OR abs(t - o.y) <= 4)) = 0 AS good FROM w JOIN o ON o.grp = w.grp AND o.i = w.i + 1)),
k AS (SELECT grp, unnest(kept) AS e FROM (SELECT grp, kept FROM w QUALIFY row_number() OVER (PARTITION BY grp ORDER BY i DESC) = 1))
SELECT p.* FROM p JOIN k ON k.grp = p.grp AND k.e.x = p.x AND k.e.y = p.y
"""
)
def image_index_nms(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T(spark, sf_dir, "orders").groupBy((F.col("o_custkey") % 20).alias("grp"), (F.col("o_orderkey") % 90).alias("x"), (F.col("o_custkey") % 83).alias("y")).agg(F.min("o_totalprice").alias("mag"))
    return suppress.index_nms(rows, ["grp"], "x", "y", "mag", 4)
