"""Queries against their SQL on tables that are longer, or cut elsewhere, than the given ones."""

from __future__ import annotations

from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridloom import cluster, queries_graphs, stand_ins
from gridloom.catalog import ORACLE, QUERIES
from gridloom.functions import linalg
from gridloom.operators import align, blocks, loops, metrics, nearest, quantiles, retrieval, suppress
from gridloom.sources import glb, packed

SMALL = "/root/testdata/sf0.001"


def same(spark, at, name, *tables):
    db = duckdb.connect()
    for t in tables:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{at}/{t}.parquet/*.parquet')")
    want = db.execute(ORACLE[name])
    columns = [d[0] for d in want.description]
    got = sorted(tuple(r[c] for c in columns) for r in QUERIES[name](spark, at).collect())
    assert got == sorted(want.fetchall())


def vectors(spark, at, keep, rows):
    """The embeddings of the ids in ``keep``, repeated from the given ones; ``rows`` changes the numbers."""
    table = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    kinds = table.schema
    base = table.orderBy("vec_id").collect()
    spark.createDataFrame([(k, rows(k, list(base[k % len(base)]["embedding"])), base[k % len(base)]["label"]) for k in keep], kinds).write.parquet(f"{at}/embeddings.parquet")


def test_captures_of_fewer_views(spark, tmp_path):
    vectors(spark, str(tmp_path), range(43), lambda k, e: e)
    same(spark, str(tmp_path), "rig_consensus", "embeddings")


def test_many_chunks(spark, tmp_path):
    vectors(spark, str(tmp_path), [*range(1500, 1620), *range(60_000, 60_100)], lambda k, e: e)
    same(spark, str(tmp_path), "adjacent_overlap_fit", "embeddings")


@pytest.mark.parametrize("name", ["tum_round_trip", "tum_positions"])
def test_numbers_rounded_twice(spark, tmp_path, name):
    rng = np.random.default_rng(3)
    halves = (rng.integers(-400_000, 400_000, 30_000) * 1e-6 + 5e-7).astype(np.float32)
    rows = {k: [float(x) for x in halves[7 * k : 7 * k + 7]] for k in range(4000)}
    vectors(spark, str(tmp_path), range(4000), lambda k, e: rows[k] + e[7:])
    same(spark, str(tmp_path), name, "embeddings")


def test_a_long_grid(spark, tmp_path):
    part = spark.read.parquet(f"{SMALL}/part.parquet")
    first = part.first()
    at = part.columns.index("p_partkey")
    spark.createDataFrame([(*first[:at], k, *first[at + 1 :]) for k in range(1, 20_001, 1)], part.schema).write.parquet(f"{tmp_path}/part.parquet")
    same(spark, str(tmp_path), "closest_point_fit", "part")


def test_cut_between_equal_values(spark, monkeypatch):
    """A quantile between two equal values is that value, so ``<=`` keeps both."""
    monkeypatch.setattr(quantiles, "SMALL", 50)
    rows = [(k, k / 100) for k in range(1, 60) for _ in range(102)]
    df = spark.createDataFrame(rows, "grp long, v double")
    assert all(r["q"] == r["grp"] / 100 for r in quantiles.quantiles(df, ["grp"], "v", {"q": 0.8}).collect())
    assert {r["n_kept"] for r in metrics.trimmed_rmse(df, ["grp"], "v", 0.8).collect()} == {102}


def _about(axis, degrees):
    x, y, z = np.array(axis) / np.linalg.norm(axis)
    k, a = np.array([[0, -z, y], [z, 0, -x], [-y, x, 0]]), np.radians(degrees)
    return np.eye(3) + np.sin(a) * k + (1 - np.cos(a)) * k @ k


def test_medoid_of_counted_rotations(spark):
    """Only different rotations meet; the result is that of all rows, one by one."""
    rng = np.random.default_rng(5)
    some = [_about(rng.normal(size=3), rng.uniform(0, 12)) for _ in range(40)]
    rows = [(g, k, some[int(rng.integers(40))].ravel().tolist()) for g in range(2) for k in range(301)]
    got = {r["grp"]: r for r in align.medoid_by(spark.createDataFrame(rows, "grp long, k long, rotation array<double>"), ["grp"], "k").collect()}
    for g in range(2):
        every = np.array([r for h, _, r in rows if h == g]).reshape(-1, 3, 3)
        mean = every[np.argmin([np.median([linalg.angle_degrees(a, b) for b in every]) for a in every])]
        for _ in range(3):
            inside = np.array([linalg.angle_degrees(mean, b) for b in every]) <= 5
            mean = linalg.mean_rotation(every[inside])
        assert got[g]["inliers"] == np.nonzero(inside)[0].tolist()
        assert np.allclose(np.array(got[g]["rotation"]).reshape(3, 3), mean, atol=1e-9)


def test_medoid_of_many_equal_rotations(spark):
    """Half a million copies of two rotations are two rows to the solver (a row each took quadratic time)."""
    pick = lambda k: F.when(F.col("id") % 7 == 0, float(_about((0, 1, 0), 70).ravel()[k])).otherwise(float(_about((0, 1, 0), 10).ravel()[k]))
    rows = spark.range(500_000).select(F.lit(1).alias("grp"), "id", F.array(*(pick(k) for k in range(9))).alias("rotation"))
    got = align.medoid_by(rows, ["grp"], "id").selectExpr("size(inliers) AS n", "rotation").first()
    assert got["n"] == 500_000 - len(range(0, 500_000, 7))
    assert np.allclose(np.array(got["rotation"]).reshape(3, 3), _about((0, 1, 0), 10))


@pytest.mark.parametrize("levels", [1, 4, 10_000])
def test_suppression_in_tiles(spark, monkeypatch, levels):
    """One group of many near pairs is walked in tiles, with the result of one walk; with one level, by (a, b), chains are longest."""
    monkeypatch.setattr(suppress, "TILE", 16)
    rng = np.random.default_rng(levels)
    ends = {(int(x), int(y)) for x, y in rng.integers(-40, 60, (3000, 2))}
    rows = [(x, y, float(rng.integers(levels))) for x, y in ends]
    kept = []
    for x, y, s in sorted(rows, key=lambda r: (-r[2], r[0], r[1])):
        if not any(abs(x - u) <= 3 and abs(y - v) <= 3 for u, v, _ in kept):
            kept.append((x, y, s))
    walked = []
    plain = suppress.held
    monkeypatch.setattr(suppress, "held", lambda df, name: walked.append(name) or plain(df, name))
    got = suppress.pair_nms(spark.createDataFrame(rows, "a long, b long, s double"), [], "a", "b", "s", 3)
    assert sorted(map(tuple, got.collect())) == sorted(kept)
    assert walked
    odd = spark.createDataFrame([(None, 1, 1.0), (2, 1, 1.0), (3, 1, 0.5)], "a long, b long, s double")
    assert sorted(((r["a"] or 0) for r in suppress.pair_nms(odd, [], "a", "b", "s", 3).collect())) == [0, 2]
    assert suppress.pair_nms(odd.limit(0), [], "a", "b", "s", 3).collect() == []


def test_gain_of_large_groups(spark, monkeypatch):
    """No group's different values are kept in one ``percentile``; nulls are a group, and NaN is above all numbers."""
    monkeypatch.setattr(quantiles, "SMALL", 100)
    monkeypatch.setattr(quantiles, "ACCURACY", 50)
    calls = []
    bracketed = quantiles._bracketed
    monkeypatch.setattr(quantiles, "_bracketed", lambda *a: calls.append(1) or bracketed(*a))
    rng = np.random.default_rng(8)
    rows = [(g, float(rng.uniform(1, 9)), float(rng.uniform(0, 8)), float(rng.uniform(1, 3))) for g in ("a", None) for _ in range(700)] + [("nan", x, 1.0, 1.0) for x in (1.0, float("nan"), float("nan"))] + [("a", None, 1.0, 1.0), ("a", 1.0, 1.0, 0.0)]
    df = spark.createDataFrame(rows, "grp string, raw double, fixed double, depth double")
    got = {r["grp"]: r for r in align.repair_gain(df, ["grp"], raw=F.col("raw"), repaired=F.col("fixed"), depth=F.col("depth")).collect()}
    assert calls and set(got) == {"a", None, "nan"}
    for g in ("a", None):
        kept = np.array([r[1:] for r in rows if r[0] == g and r[1] is not None and r[3] > 0])
        assert got[g]["n"] == len(kept)
        for name, k in (("raw", 0), ("repaired", 1)):
            assert [got[g][f"{name}_median"], got[g][f"{name}_p90"]] == pytest.approx(np.percentile(kept[:, k] / kept[:, 2], [50, 90]), abs=1e-12)
        assert got[g]["better"] == (got[g]["repaired_median"] < got[g]["raw_median"])
    assert np.isnan(got["nan"]["raw_median"]) and got["nan"]["repaired_median"] == 1.0


def test_exploded_points_are_not_broadcast(spark):
    """Spark takes four pixels a frame for one row, so it broadcast some 300 MB of them."""
    plan = loops.matched_points(*queries_graphs._loop_tables(spark, SMALL))._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin [frame" in plan and "SortMergeJoin [chunk" in plan
    assert "BroadcastHashJoin [frame" not in plan


def test_small_files_side_by_side(spark, tmp_path):
    """More files than are written at once: each is there with its own content."""
    cluster.write_small(spark, ((f"file://{tmp_path}/d{k % 7}/f{k}", str(k).encode()) for k in range(300)), at_once=4)
    assert {p.name: p.read_text() for p in tmp_path.glob("d*/f*")} == {f"f{k}": str(k) for k in range(300)}
    with pytest.raises(Exception, match="Mkdirs|exists|directory"):
        cluster.write_small(spark, [(f"file://{tmp_path}/d0/f0/x", b"")])


def test_points_of_a_scene_in_slices(monkeypatch):
    """A file's points are never one frame."""
    monkeypatch.setattr(glb, "SLICE", 4, raising=False)
    xyz, rgba = np.arange(30, dtype="<f4").reshape(10, 3), np.arange(40, dtype=np.uint8).reshape(10, 4)
    parts = list(glb._points_of(glb.head(10, [0.0] * 3, [29.0] * 3) + xyz.tobytes() + rgba.tobytes()))
    assert [len(p) for p in parts] == [4, 4, 2]
    assert [v for p in parts for v in p[["x", "y", "z", "red", "green", "blue"]].to_numpy().tolist()] == np.hstack([xyz, rgba[:, :3]]).tolist()
    assert list(glb._points_of(glb.head(0, [], []))) == []


def test_nearest_of_lists(spark, monkeypatch):
    """Each row's nearest within reach, as all pairs have it; a cell of many places has several lists, and Spark broadcasts none of them."""
    monkeypatch.setattr(nearest, "LIST", 5)
    rng = np.random.default_rng(11)
    cloud = lambda n: [(k, *map(float, p)) for k, p in enumerate(np.round(rng.normal(0, 1, (n, 3)) * (1, 1, 0.2), 2))]
    left, right = cloud(300), cloud(200) + [(900, 0.0, 0.0, 0.0), (901, 0.0, 0.0, 0.0), (902, None, 0.0, 0.0), (903, float("nan"), 0.0, 0.0)]
    df = lambda rows: spark.createDataFrame(rows, "id long, x double, y double, z double")
    for radius in (0.05, 0.3, 2.0):
        found = nearest.nearest_listed(df(left), nearest.lists(df(right), ["x", "y", "z"], radius), ["x", "y", "z"], radius)
        assert "Broadcast" not in found._jdf.queryExecution().sparkPlan().toString()
        want = {}
        for i, *p in left:
            d, j = min((round(float(np.linalg.norm(np.subtract(p, q))), 6), j) for j, *q in right if j < 902)
            if d <= radius:
                want[i] = (j, d)
        assert {r["id"]: (r["target"], r["distance"]) for r in found.collect()} == want
        assert all([r["x"], r["y"], r["z"]] == list(left[r["id"]][1:]) and [r["r_x"], r["r_y"], r["r_z"]] == next(list(q) for j, *q in right if j == r["target"]) for r in found.collect())


def test_rounds_of_closest_points_are_not_broadcast(spark, monkeypatch):
    """Spark took a million parts for a few megabytes, as their file is small, and broadcast them in every round; what a round finds goes when it ends."""
    plans = []
    plain = align.held_for
    monkeypatch.setattr(align, "held_for", lambda df, name: plans.append(df._jdf.queryExecution().sparkPlan().toString()) or plain(df, name))
    QUERIES["closest_point_fit"](spark, SMALL).collect()
    assert plans and not any("Broadcast" in p for p in plans)
    with cluster.held_for(spark.range(3), "some") as rows:
        at = rows.inputFiles()[0]
        assert rows.count() == 3 and Path(at.removeprefix("file://")).exists()
    assert not Path(at.removeprefix("file://")).exists()


def test_bags_in_files(spark, tmp_path, monkeypatch):
    """A bag is as many files as it needs, in the order of time, and none of them passes through the driver."""
    monkeypatch.setattr(packed, "MESSAGES", 50)
    rows = [(f"bag{k % 3}" if k % 3 else None, f"t{k % 4}", f"m{k % 4}", 1_700_000_000_000_000_000 + (k * 7919) % 1000, str(k).encode()) for k in range(1000)]
    at = f"file://{tmp_path}/bags"
    made = packed.bag_files(spark.createDataFrame(rows, "bag string, topic string, type string, ts long, data binary"), "bag")
    with monkeypatch.context() as m:
        m.setattr(type(made), "toLocalIterator", lambda *a, **k: pytest.fail("files were sent to the driver"))
        assert packed.write_files(made, at, name="name", content="content") >= 20
    got = packed.bag_messages(spark, at).withColumn("file", F.regexp_extract("path", r"/([^/]+)_\d+\.db3$", 1)).collect()
    assert sorted((r["file"], r["topic"], r["type"], r["ts"], bytes(r["data"])) for r in got) == sorted((b or "None", *r) for b, *r in rows)
    files = {}
    for r in got:
        files.setdefault((r["file"], int(r["path"].split("_")[-1].removesuffix(".db3"))), []).append(r["ts"])
    assert max(map(len, files.values())) <= 50
    for bag in ("None", "bag1", "bag2"):
        parts = [t for (b, _), t in sorted(files.items()) if b == bag]
        assert all(max(a) <= min(b) for a, b in zip(parts, parts[1:]))


def test_scenes_of_any_size(spark, tmp_path, monkeypatch):
    """A cloud is as many whole files as it needs (one file of over two gigabytes could not be read), written by the tasks."""
    monkeypatch.setattr(glb, "PART", 30)
    rows = [(k / 2, -k / 4, float(k % 7), k % 256, 1, None) for k in range(500)] + [(None, 0.0, 0.0, 1, 1, 1), (float("nan"), 0.0, 0.0, 1, 1, 1), (float("inf"), 0.0, 0.0, 1, 1, 1)]
    points = spark.createDataFrame(rows, "x double, y double, z double, red int, green int, blue int")
    at = tmp_path / "scenes"
    assert glb.write_scenes(points.repartition(3), f"file://{at}") == len(list(at.glob("*.glb"))) >= 17
    for f in at.glob("*.glb"):
        data = f.read_bytes()
        (accessor, _), xyz = glb.json.loads(data[20 : 20 + int.from_bytes(data[12:16], "little")])["accessors"], np.concatenate([p[["x", "y", "z"]] for p in glb._points_of(data)])
        assert len(xyz) == accessor["count"] <= 30 and xyz.min(0).tolist() == accessor["min"] and xyz.max(0).tolist() == accessor["max"]
    got = glb.read(spark, f"file://{at}").collect()
    assert sorted(tuple(r)[1:] for r in got) == sorted((*r[:5], 0) for r in rows[:500])
    assert glb.write_scenes(points.limit(0), f"file://{tmp_path}/none") == 1
    assert glb.read(spark, f"file://{tmp_path}/none").collect() == []
    written = []
    monkeypatch.setattr(glb, "write", lambda *a: written.append(a))
    assert QUERIES["glb_round_trip"](spark, SMALL).count() == spark.read.parquet(f"{SMALL}/lineitem.parquet").count() and not written


def test_blocks_are_read_not_copied(spark, monkeypatch):
    """Beyond some copies of a row, blocks are written once and tasks read theirs: the pairs are the same and nothing is shuffled for them."""

    def pairs_of(a, b):
        x, y = np.meshgrid(a["id"].to_numpy(), b["id"].to_numpy(), indexing="ij")
        return pd.DataFrame({"a": x.ravel(), "b": y.ravel(), "v": np.add.outer(np.array([v.sum() for v in a["vec"]]), np.array([v.sum() for v in b["vec"]])).ravel()})

    table = lambda n: spark.range(n).select("id", F.array(F.col("id").cast("float"), F.lit(0.5).cast("float")).alias("vec"))
    schema, every = "a long, b long, v double", lambda df: sorted(map(tuple, df.collect()))
    for tiled in (True, False):
        made = {}
        for copies in (1, 1 << 19):
            monkeypatch.setattr(blocks, "COPIED", copies)
            monkeypatch.setattr(blocks, "PAIRS", 4)
            both = blocks.block_pairs(table(37), table(53), pairs_of, schema, left_key="id", right_key="id", block=5, wide=10, tiled=tiled)
            half = blocks.ordered_pairs(table(61), lambda a, b: pairs_of(a, b).query("a < b"), schema, key="id", block=5, wide=10)
            assert all(("CoGroups" in df._jdf.queryExecution().sparkPlan().toString()) is (copies > 1) for df in (both, half))
            made[copies] = every(both), every(half)
        assert made[1] == made[1 << 19] and len(made[1][0]) == 37 * 53 and len(made[1][1]) == 61 * 30
    monkeypatch.setattr(blocks, "COPIED", 1)
    assert every(blocks.block_pairs(table(20), table(0), lambda a, b: pd.DataFrame({"a": a["id"], "b": len(b), "v": 0.0}), schema, left_key="id", right_key="id", block=5)) == [(k, 0, 0.0) for k in range(20)]


def test_precision_of_items_in_spans(spark, monkeypatch):
    d = stand_ins.descriptors(spark, SMALL)
    want = sorted(map(tuple, retrieval.query_precision(d, d, 0.5).collect()))
    for module, name, value in ((retrieval, "SPAN", 70), (retrieval, "AT_ONCE", 900), (retrieval, "LEAST", 1), (blocks, "COPIED", 1)):
        monkeypatch.setattr(module, name, value)
    assert sorted(map(tuple, retrieval.query_precision(d, d, 0.5, block=40).collect())) == want


def test_pairs_settled_where_they_are_made(spark, tmp_path, monkeypatch):
    """What suppression gets is the kept and the open pairs only, and kept ones that no open pair is near take no part in its rounds."""
    vectors(spark, str(tmp_path), range(1200), lambda k, e: [x + (k * 37 % 101) / 1000 for x in e])
    plain = suppress.pair_nms(QUERIES["cyclic_retrieval"](spark, str(tmp_path)), [], "a", "b", "mean", 3)
    want = sorted((r["a"], r["b"], r["mean"]) for r in plain.collect())
    ordered = retrieval.ordered_pairs
    monkeypatch.setattr(retrieval, "ordered_pairs", lambda *a, **k: ordered(*a, **(k | {"block": 40, "wide": 80})))
    walked = []
    stored = suppress.held
    monkeypatch.setattr(suppress, "held", lambda df, name: walked.append(stored(df, name)) or walked[-1])
    got = QUERIES["capture_nms"](spark, str(tmp_path))
    assert sorted((r["a"], r["b"], r["mean"]) for r in got.collect()) == want
    sizes = [w.count() for w in walked]
    assert sizes[0] < QUERIES["cyclic_retrieval"](spark, str(tmp_path)).count() / 2 and sizes[1] < sizes[0]


def test_many_fits_at_once(spark, monkeypatch):
    """Groups are fitted together, as each alone is, mirrored and single points too."""
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(2, 50, 7, 3))
    y[:20] = x[:20] * (1, 1, -1)
    x[20] = 0.5
    rows = [(g, *map(float, (*a, *b))) for g in range(50) for a, b in zip(x[g], y[g], strict=True)]
    pairs = spark.createDataFrame(rows, "grp long, sx double, sy double, sz double, tx double, ty double, tz double")
    monkeypatch.setattr(linalg, "fit_from_moments", None)
    got = {r["grp"]: r for r in align.fit_by(pairs, ["grp"]).collect()}
    monkeypatch.undo()
    for g in range(50):
        s, r, t = linalg.fit(x[g], y[g])
        if g == 20:
            assert got[g]["s"] == 1.0
        else:
            assert got[g]["s"] == pytest.approx(s) and np.allclose(np.reshape(got[g]["r"], (3, 3)), r) and np.allclose(got[g]["t"], t)
    far = align.with_far(pairs, align.fit_by(pairs, ["grp"]), ["grp"], "far").filter("grp = 7")
    s, r, t = linalg.fit(x[7], y[7])
    assert sorted(v["far"] for v in far.select("far").collect()) == pytest.approx(sorted(np.linalg.norm(s * x[7] @ r.T + t - y[7], axis=1)))
