from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from gridloom.functions import boxes, names, pose
from gridloom.operators import asof, masks, metrics, nearest, provenance, retrieval, sampling, suppress, voxel, windows
from gridloom.plans import registry, reuse


def test_cyclic_consensus_finds_the_shift(spark):
    eye = np.eye(4)
    rows = [(0, v, eye[v].tolist()) for v in range(4)] + [(9, v, (s * eye[(v - 2) % 4]).tolist()) for v, s in zip(range(4), (0.9, 0.8, 0.7, 0.68), strict=True)]
    options = {"min_gap": 3, "min_mean": 0.65, "min_score": 0.6, "support_at": 0.65, "min_support": 3}
    table = lambda r: spark.createDataFrame(r, "capture long, view int, vec array<double>")
    got = retrieval.cyclic_consensus(table(rows), **options).collect()
    assert [(r["a"], r["b"], r["shift"], r["support"]) for r in got] == [(0, 9, 2, 4)]
    assert got[0]["mean"] == pytest.approx(0.77)
    alias = rows[:4] + [(9, v, (0.99 * eye[2]).tolist() if v == 0 else [0.0] * 4) for v in range(4)]
    assert retrieval.cyclic_consensus(table(alias), **options).collect() == []
    assert retrieval.cyclic_consensus(table(rows[:7]), **options).collect() == []  # a view is missing


@pytest.mark.parametrize("block", [3, 2048])
def test_top_k_is_exact_in_any_blocks(spark, block, monkeypatch):
    from gridloom.operators import blocks

    monkeypatch.setattr(blocks.block_pairs, "__kwdefaults__", {**blocks.block_pairs.__kwdefaults__, "block": block})
    rng = np.random.default_rng(0)
    vec = rng.integers(-2, 3, size=(25, 4)).astype(float)
    table = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(vec)], "id long, vec array<double>")
    got = {}
    for r in retrieval.top_k(table, table, 4).collect():
        got.setdefault(r["query"], {})[r["rank"]] = r["item"]
    for q in range(25):
        order = sorted((k for k in range(25) if k != q), key=lambda k: (-vec[q] @ vec[k], k))[:4]
        assert [got[q][k] for k in (1, 2, 3, 4)] == order


def test_ranked_metrics_edges(spark):
    rows = spark.createDataFrame([("a", 1, 0.9, True), ("a", 2, 0.8, False), ("a", 3, 0.7, True), ("b", 1, 0.5, False)], "run string, item int, score double, positive boolean")
    ap = {r["run"]: r["ap"] for r in retrieval.average_precision(rows, ["run"]).collect()}
    assert ap["a"] == pytest.approx((1 + 2 / 3) / 2) and ap["b"] is None
    recall = {r["run"]: r["recall"] for r in retrieval.recall_at_precision(rows, ["run"], 0.9).collect()}
    assert recall == {"a": 0.5, "b": None}


def test_asof_ties_and_gaps(spark):
    left = spark.createDataFrame([(1, 10, 0), (1, 15, 1), (1, 100, 2), (2, 5, 3)], "k int, ts long, n long")
    right = spark.createDataFrame([(1, 10, 7, 1.0), (1, 20, 8, 3.0), (1, 10, 6, 0.5)], "k int, ts long, o long, v double")
    near = {r["n"]: (r["r_ts"], r["r_o"]) for r in asof.nearest(left, right, ["k"], order="o", carry=["v"]).collect()}
    assert near == {0: (10, 7), 1: (10, 7), 2: (20, 8), 3: (None, None)}
    assert {r["n"] for r in asof.nearest(left, right, ["k"], order="o", carry=["v"], within=20).filter("r_ts is null").collect()} == {2, 3}
    got = {r["n"]: r["interpolated"] for r in asof.interpolate(left, right, ["k"], order="o", value="v", max_gap=10).collect()}
    assert got == {0: 1.0, 1: 2.0, 2: None, 3: None}
    assert asof.interpolate(left, right, ["k"], order="o", value="v", max_gap=9).filter("n = 1").first()["interpolated"] is None


def test_greedy_sync(spark):
    rows = spark.createDataFrame([("s", t, k, a) for k, (t, a) in enumerate([(0, "a"), (4, "b"), (5, "a"), (6, "b"), (20, "a"), (30, "b")])], "run string, ts long, n long, topic string")
    got = asof.greedy_sync(rows, ["run"], ts="ts", order="n", topic="topic", first="a", second="b", tolerance=5).collect()
    assert [(r["a"], r["b"]) for r in got] == [(0, 1), (2, 3)]


def test_windows_own_every_frame_once(spark):
    for n, size, overlap in ((20, 8, 3), (11, 8, 3), (8, 8, 3), (5, 8, 2), (0, 8, 3), (100, 10, 9)):
        chunks = [tuple(r) for r in windows.chunk_windows(spark, n, size, overlap).orderBy("chunk").collect()]
        want, start = [], 0
        while n:
            want.append((len(want), start, min(start + size, n)))
            if start + size >= n:
                break
            start += size - overlap
        assert chunks == want
        frames = spark.range(n).withColumnRenamed("id", "frame")
        owned = frames.select("frame", windows.owner(F.col("frame"), n, size, overlap).alias("chunk")).collect() if n else []
        assert all(chunks[r["chunk"]][1] <= r["frame"] < chunks[r["chunk"]][2] for r in owned)
        inside = {tuple(r) for r in windows.members(frames, "frame", n, size, overlap).collect()} if n else set()
        assert inside == {(f, c) for c, a, b in want for f in range(a, b)}
    assert [tuple(r)[1:] for r in windows.anchored_windows(spark, 11, 4, 3).orderBy("chunk").collect()] == [(0, 4), (3, 7), (6, 10), (7, 11)]


@pytest.mark.parametrize("unit", [1, 10**9])
def test_latest_interval_over_ranges(spark, unit):
    rng = random.Random(3)
    spans = sorted({rng.randint(0, 20_000) for _ in range(60)})
    rows = [(s * unit, (s + rng.randint(0, 6000)) * unit, k) for k, s in enumerate(spans)]
    points = [rng.randint(0, 25_000) * unit for _ in range(300)] + [7 * unit] * 40
    intervals = spark.createDataFrame([*rows, (None, 99_000 * unit, -2)], "start long, end long, chunk long")
    got = windows.latest_interval(spark.createDataFrame([(p,) for p in [*points, None]], "at_frame long"), intervals, at="at_frame", start="start", end="end", carry=["chunk"])
    found = sorted((-1 if r["at_frame"] is None else r["at_frame"], -1 if r["chunk"] is None else r["chunk"]) for r in got.collect())
    want = [(-1, -1)]
    for p in points:
        last = max((r for r in rows if r[0] <= p), default=None)
        want.append((p, last[2] if last and last[1] >= p else -1))
    assert found == sorted(want)


def test_latest_interval_of_empty_tables(spark):
    points, intervals = spark.createDataFrame([(3,)], "at long"), spark.createDataFrame([(1, 5, 0)], "start long, end long, chunk long")
    ask = lambda p, i: [tuple(r) for r in windows.latest_interval(p, i, at="at", start="start", end="end", carry=["chunk"]).collect()]
    assert ask(points, intervals) == [(3, 1, 5, 0)]
    assert ask(points, intervals.limit(0)) == [(3, None, None, None)]
    assert ask(points.limit(0), intervals) == ask(points.limit(0), intervals.limit(0)) == []


def test_exact_members_rejects_further_ones(spark):
    rows = spark.createDataFrame([(c, t) for c, ts in (("a", (2, 0, 1)), ("b", (0, 1, 2, 3)), ("c", (0, 1)), ("d", (0, 1, 2, 2))) for t in ts], "conv string, turn int")
    assert [tuple(r) for r in windows.exact_members(rows, ["conv"], "turn", [0, 1, 2]).collect()] == [("a", 3)]


def test_neighbours_by_grid_are_exact(spark):
    rng = np.random.default_rng(5)
    a, b = rng.normal(size=(60, 2)) * 3, np.vstack([rng.normal(size=(40, 2)), [[50.0, 50.0]]])
    table = lambda p: spark.createDataFrame([(k, *map(float, x)) for k, x in enumerate(p)], "id long, x double, y double")
    d = np.linalg.norm(a[:, None] - b[None], axis=2).round(6)
    for cell in (0.2, 1.0, 30.0):
        got = {r["id"]: (r["target"], r["distance"]) for r in nearest.nearest(table(a), table(b), ["x", "y"], cell=cell).collect()}
        assert got == {k: (int(d[k].argmin()), d[k].min()) for k in range(60)}
    near = {(r["id"], r["target"]) for r in nearest.within(table(a), table(b), ["x", "y"], 0.7).collect()}
    assert near == {(int(i), int(j)) for i, j in zip(*np.where(d <= 0.7), strict=True)}
    same = nearest.cloud_metrics(table(b), table(b), ["x", "y"], cell=1.0, threshold=0.05).first()
    assert same["chamfer"] == 0 and same["fscore"] == 1


@pytest.mark.parametrize("brute", [0, 40, 10**9])
def test_neighbours_of_shared_places(spark, monkeypatch, brute):
    """Copies of a place are asked and found once, and few targets share a cell: pairs grow with the rows, not with their square."""
    monkeypatch.setattr(nearest, "BRUTE", brute)
    met, plain = [], nearest._in_ring
    monkeypatch.setattr(nearest, "_in_ring", lambda *a: met.append((df := plain(*a)).count()) or df)
    rng = np.random.default_rng(6)
    a, b = np.repeat(rng.normal(size=(20, 2)).round(2), 15, 0), np.repeat(np.vstack([rng.normal(size=(60, 2)).round(2), [[30.0, 0.0]]]), 10, 0)
    table = lambda p: spark.createDataFrame([(k, *map(float, x)) for k, x in enumerate(p)] + [(-1, None, 1.0), (-2, float("nan"), 1.0)], "id long, x double, y double")
    d = np.sqrt(((a[:, None] - b[None]) ** 2).sum(2)).round(6)
    best, back = d.argmin(1), d.argmin(0)
    got = {r["id"]: (r["target"], r["distance"]) for r in nearest.nearest(table(a), table(b), ["x", "y"], cell=8.0).collect()}
    assert got == {k: (int(best[k]), d[k].min()) for k in range(300)} | {-1: (None, None), -2: (None, None)}
    assert all(n <= 20 * 61 for n in met) and bool(met) == (brute < 10**9)
    near = {(r["id"], r["target"]) for r in nearest.mutual_within(table(a), table(b), ["x", "y"], 0.2).collect()}
    assert near == {(i, int(best[i])) for i in range(300) if back[best[i]] == i and d[i].min() <= 0.2}


def test_pairs_within_a_radius_in_slices(spark, monkeypatch):
    """A crowded cell is many tasks' work, and every pair comes once."""
    monkeypatch.setattr(nearest, "SLICE", 7)
    monkeypatch.setattr(nearest, "PAIRS", 100)
    rng = np.random.default_rng(7)
    a, b = rng.normal(size=(50, 2)) * 0.1, rng.normal(size=(90, 2))
    table = lambda p: spark.createDataFrame([(k, *map(float, x)) for k, x in enumerate(p)], "id long, x double, y double")
    d = np.sqrt(((a[:, None] - b[None]) ** 2).sum(2)).round(6)
    got = nearest.within(table(a), table(b), ["x", "y"], 0.7)
    assert "ls" in got._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r["id"], r["target"]) for r in got.collect()) == [(int(i), int(j)) for i, j in zip(*np.where(d <= 0.7), strict=True)]


def test_voxels(spark):
    cloud = spark.createDataFrame([(0.5, 0.5, 0.5, 0.9), (0.6, 0.5, 0.5, 0.9), (1.5, 0.5, 0.5, 0.1), (9.0, 9.0, 9.0, 1.0), (-0.1, 0.0, 0.0, 0.5)], "x double, y double, z double, conf double")
    support = {tuple(r)[:3]: r["support"] for r in voxel.support(cloud, 1, 7).collect()}
    assert support == {(0, 0, 0): 3, (1, 0, 0): 2, (9, 9, 9): 1, (-1, 0, 0): 2}
    assert voxel.clean(cloud, 1, least_support=2, kind=7).count() == 4
    best = {tuple(r)[:3]: r["x"] for r in voxel.most_confident(cloud, 1).collect()}
    assert best[(0, 0, 0)] == 0.5
    assert [len(voxel.offsets(k)) for k in (7, 19, 27)] == [7, 19, 27]


def test_metrics_edges(spark):
    v = np.random.default_rng(1).normal(size=200)
    rows = spark.createDataFrame([("g", float(x)) for x in v], "g string, v double")
    got = metrics.error_stats(rows, ["g"], "v").first()
    assert got["std"] == pytest.approx(v.std()) and got["p95"] == pytest.approx(np.quantile(v, 0.95)) and got["rmse"] == pytest.approx(np.sqrt((v**2).mean()))
    accepted, reasons = metrics.gate({"low": F.col("v") < 1, "number": ~F.isnan("v"), "known": F.col("w") > 0})
    odd = spark.createDataFrame([(0.5, 1), (float("nan"), None)], "v double, w int").select(accepted.alias("a"), reasons.alias("r"))
    assert [tuple(r) for r in odd.collect()] == [(True, ""), (False, "low;number;known")]


def test_suppression(spark):
    loops = spark.createDataFrame([(0, 2, 0, 0.95), (0, 3, 1, 0.90), (0, 5, 4, 0.80)], "run int, a long, b long, sim double")
    assert sorted(r["a"] for r in suppress.pair_nms(loops, ["run"], "a", "b", "sim", 1).collect()) == [2, 5]
    assert [r["a"] for r in suppress.index_nms(loops, ["run"], "a", "b", "sim", 2).collect()] == [2]
    b = spark.createDataFrame([(0, 1, 0.0, 0.0, 2.0, 2.0, 0.9), (0, 2, 0.1, 0.0, 2.0, 2.0, 0.8), (0, 3, 5.0, 5.0, 6.0, 6.0, 0.1)], "g int, id int, x0 double, y0 double, x1 double, y1 double, s double")
    assert sorted(r["id"] for r in suppress.box_nms(b, ["g"], "s", 0.5).collect()) == [1, 3]
    rng = np.random.default_rng(2)
    points = spark.createDataFrame([(0, k, *map(float, p)) for k, p in enumerate(rng.uniform(size=(150, 2)))], "g int, id int, x double, y double")
    kept = np.array([(r["x"], r["y"]) for r in suppress.thin(points, ["g"], ["x", "y"], 0.15).collect()])
    gaps = np.linalg.norm(kept[:, None] - kept[None], axis=2) + np.eye(len(kept))
    assert gaps.min() > 0.15
    every = np.array([(r["x"], r["y"]) for r in points.collect()])
    assert np.linalg.norm(every[:, None] - kept[None], axis=2).min(1).max() <= 0.15


def test_provenance(spark):
    files = lambda r: spark.createDataFrame(r, "run string, name string, size long, digest string")
    sign = lambda r: provenance.tree_signature(files(r), ["run"], "name", "size", "digest").first()["signature"]
    one = [("r", "a", 1, "x"), ("r", "b", 1, "y")]
    assert sign(one) == sign(one[::-1]) != sign([("r", "a", 1, "x"), ("r", "b", 1, "z")])
    a, b = spark.createDataFrame([(1, True), (2, False)], "k int, m boolean"), spark.createDataFrame([(1, False)], "k int, m boolean")
    with pytest.raises(PySparkException):
        provenance.strict_merge(a, b, ["k"], {"m": F.col("l_m") | F.col("r_m")}).collect()
    done = spark.createDataFrame([("p", "id1"), ("q", None)], "path string, identity string")
    due = spark.createDataFrame([("p", "id1"), ("q", "id2"), ("p", "id3")], "path string, identity string")
    assert sorted(map(tuple, provenance.remaining(due, done, ["path"], ["identity"]).collect())) == [("p", "id3"), ("q", "id2")]


def test_stages_are_reused_by_content(spark, tmp_path):
    built = []

    def build():
        built.append(1)
        return spark.range(5).toDF("n")

    root = f"file://{tmp_path}"
    for request, reused in (({"a": 1}, False), ({"a": 1}, True), ({"a": 2}, False)):
        table, was = reuse.materialise(spark, root, "t", request, build)
        assert was == reused and table.count() == 5
    spark.range(6).toDF("n").write.mode("overwrite").parquet(f"{root}/t/rows")
    assert not reuse.materialise(spark, root, "t", {"a": 2}, build)[1]
    assert len(built) == 3
    assert reuse.canonical({"b": float("nan"), "a": [1, {"d": 2, "c": 3}]}) == '{"a":[1,{"c":3,"d":2}],"b":null}'
    assert reuse.merge({"a": {"b": 1, "c": 2}}, {"a": {"c": 3}}) == {"a": {"b": 1, "c": 3}}


def test_names_and_boxes(spark):
    at = "00001_v02_frame_00001_1700000000123456789_yaw180.jpg"
    row = spark.sql(f"select '{at}' as n, 'floor_UG2_2025-12-02_run_1' as r, ' a, ,b' as l")
    n = F.col("n")
    got = row.select(names.frame_index(n), names.view_index(n), names.yaw(n), names.view_of_yaw(names.yaw(n), 4), names.stamp_seconds(n), names.capture_key(n), names.run_path(names.run_name(F.col("r"))), names.split_list(F.col("l"))).first()
    assert tuple(got)[:4] == (1, 2, 180, 2) and got[4] == pytest.approx(1700000000.1234567)
    assert tuple(got)[5:] == ("frame_00001_1700000000123456789", "floor_UG2/2025-12-02/run_1", ["a", "b"])
    box = lambda *v: boxes.from_centre(*(F.lit(float(x)) for x in v))
    assert spark.range(1).select(boxes.iou(box(1, 1, 2, 2), box(2, 1, 2, 2)).alias("i")).first()["i"] == pytest.approx(1 / 3)


def test_poses(spark):
    q = F.array(*(F.lit(x) for x in (0.5, 0.5, 0.5, 0.5)))
    m = pose.sim3(F.lit(2.0), pose.quaternion_to_matrix(q), F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0)))
    p = F.array(F.lit(1.0), F.lit(0.0), F.lit(0.0))
    row = spark.range(1).select(m.alias("m")).select(pose.apply(F.col("m"), p).alias("moved"), pose.compose(F.col("m"), pose.inverse(F.col("m"))).alias("one"), pose.rotation_angle(F.col("m.r")).alias("angle"), pose.quaternion_angle(q, q).alias("zero"))
    got = row.first()
    assert got["moved"] == [1.0, 4.0, 3.0] and got["angle"] == pytest.approx(120) and got["zero"] == pytest.approx(0)
    assert got["one"]["s"] == 1.0 and np.allclose(got["one"]["r"], np.eye(3).ravel()) and np.allclose(got["one"]["t"], 0)


def test_sampling_and_masks(spark):
    rows = spark.range(100).withColumnRenamed("id", "n")
    some = [r["n"] for r in sampling.exact(rows, ["n"], 10, seed=1).collect()]
    assert len(some) == 10 and sorted(some) == sorted(r["n"] for r in sampling.exact(rows.repartition(5), ["n"], 10, seed=1).collect())
    assert [r["n"] for r in sampling.evenly_spaced(rows, "n", 100, 7).orderBy("n").collect()] == [k * 100 // 7 for k in range(7)]
    assert 20 < sampling.ratio(rows, ["n"], 0.4, seed=3).count() < 60
    px = spark.createDataFrame([(0, 1, x, y) for x in (0, 1, 3) for y in (0, 1)] + [(0, 2, 3, 1)], "image int, instance int, x long, y long")
    encoded = masks.rle(px, ["image", "instance"], 2)
    assert {(r["instance"]): (r["starts"], r["lengths"]) for r in encoded.collect()} == {1: ([0, 6], [4, 2]), 2: ([7], [1])}
    assert masks.unrle(encoded, ["image", "instance"], 2).exceptAll(px.select("image", "instance", "x", "y")).count() == 0
    kept = {r["instance"]: r["id"] for r in masks.keep_ids(px.filter("instance = 2"), px.filter("instance = 1"), "image", 0.1).collect()}
    assert kept == {2: 1}


def test_registry():
    r = registry.Registry()
    r.add("one", lambda x: x + 1)
    r.add("json", "json:dumps")
    assert r.fan_out("one-json", 1) == {"one": 2, "json": "1"}
    with pytest.raises(KeyError):
        r.fan_out("one-two", 1)
    assert registry.missing_outputs(["m"], ["a", "b"], ["x"], {("m", "a", "x")}) == [("m", "b", "x")]
