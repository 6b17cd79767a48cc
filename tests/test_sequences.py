"""Loop constraints, chunked passes, mask components, robust homographies, blocked pose errors: against plain numpy, with odd input."""

from __future__ import annotations

import random
import tracemalloc
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions import linalg
from gridloom.operators import align, graph, loops, masks, pooling
from gridloom.plans import chunked

POINTS = "chunk long, at long, pixel long, x double, y double, z double, conf double"


def similarity(rng, size=0.4):
    return float(np.exp(rng.normal() * 0.1)), graph._exp(np.r_[0.0, rng.normal(size=3) * size, 0, 0, 0])[1], rng.normal(size=3)


def scene(seed, frames=40, size=12, overlap=4, noise=1e-3):
    """(world by frame and pixel, chunk starts, what takes each chunk to the world, rows of points)."""
    rng = np.random.default_rng(seed)
    world = rng.normal(size=(frames, 5, 3)) * 3
    starts = list(range(0, frames - overlap, size - overlap))
    to_world = [similarity(rng) for _ in starts]
    rows = []
    for c, s in enumerate(starts):
        for f in range(s, min(s + size, frames)):
            seen = linalg.apply(linalg.inverse(to_world[c]), world[f]) + rng.normal(size=(5, 3)) * noise
            rows += [(c, f - s, p, *map(float, seen[p]), 1.0 + (f + p) % 3) for p in range(5)]
    return rng, world, starts, to_world, rows


def test_loop_constraints(spark):
    rng, world, starts, to_world, rows = scene(1)
    rows.append((0, 3, 9, None, 0.0, 0.0, 1.0))
    candidates, predicted = [], []
    for loop, (a, b, bad) in enumerate([(0, 3, False), (1, 4, True), (0, 2, False)]):
        ra, rb = (starts[a] + 2, starts[a] + 8), (starts[b] + 1, starts[b] + 6)
        candidates.append((loop, a, *ra, b, *rb, 0.9, 0.9 if loop < 2 else None))
        own = similarity(rng)
        for at, f in enumerate([*range(*ra), *range(*rb)]):
            seen = linalg.apply(linalg.inverse(own), world[f]) + rng.normal(size=(5, 3)) * (0.5 if bad and at >= 6 else 1e-3)
            predicted += [(loop, at, p, *map(float, seen[p]), 1.0 if p else 0.001) for p in range(5)]
        predicted.append((loop, 2, 3, 0.5, 0.5, 0.5, 1.0) if loop == 0 else (loop, 2, 77, float("nan"), 0.0, 0.0, 1.0))
    candidates.append((9, 0, 2, 8, 3, 99, 104, 1.0, 1.0))  # nothing was predicted
    c = spark.createDataFrame(candidates, "loop long, chunk_a long, from_a long, to_a long, chunk_b long, from_b long, to_b long, rig_a double, rig_b double")
    k = spark.createDataFrame(list(enumerate(starts)), "chunk long, start long")
    p, q = spark.createDataFrame(rows, POINTS), spark.createDataFrame(predicted, POINTS.replace("chunk", "loop"))
    matched = loops.matched_points(c, k, p, q)
    counts = {(r["loop"], r["side"]): r["n"] for r in matched.groupBy("loop", "side").agg(F.count("*").alias("n")).collect()}
    assert counts == {(0, "a"): 25, (0, "b"): 20, (1, "a"): 24, (1, "b"): 20, (2, "a"): 24, (2, "b"): 20}  # the unsure pixel 0 is out
    got = {r["loop"]: r for r in loops.constraints(c, k, p, q, max_error=0.05, scale_range=(0.1, 10.0), least_rig=0.8, delta=0.01, rounds=6).collect()}
    assert got[0]["reasons"] == "alignment_error_a" or got[0]["accepted"]  # one wild point of 25 raises the mean
    for loop, a, b in ((0, 0, 3), (2, 0, 2)):
        want = linalg.compose(linalg.inverse(to_world[b]), to_world[a])
        m = got[loop]
        assert m["s"] == pytest.approx(want[0], rel=4e-2) and np.allclose(np.array(m["r"]).reshape(3, 3), want[1], atol=4e-2) and np.allclose(m["t"], want[2], atol=0.2)
    assert got[1]["reasons"] == "alignment_error_b" and not got[1]["accepted"]
    assert got[2]["reasons"] == "rig_acceptance_b"
    assert got[9]["alignment_error_a"] is None and got[9]["n_b"] == 0 and "scale" in got[9]["reasons"]
    assert loops.accepted_edges(spark.createDataFrame([(0, 3, 1.0, [1.0] * 9, [0.0] * 3, True), (1, 2, 1.0, [1.0] * 9, [0.0] * 3, False)], "chunk_a long, chunk_b long, s double, r array<double>, t array<double>, accepted boolean")).collect()[0]["b"] == 3


def chunk_points(spark, seed):
    _, world, starts, to_world, rows = scene(seed)
    df = spark.createDataFrame([(c, starts[c] + at, *rest) for c, at, *rest in rows], "chunk long, frame long, pixel long, x double, y double, z double, conf double")
    return world, to_world, df


def rows_of(spark, out):
    return sorted((r["frame"], r["pixel"], r["chunk"], round(r["x"], 9), round(r["y"], 9), round(r["z"], 9)) for r in chunked.placed(spark, out).collect())


def test_chunked_pass_is_one_pass(spark, tmp_path, monkeypatch):
    world, to_world, points = chunk_points(spark, 3)
    each = dict(frames=40, size=12, overlap=4)
    whole, parts = f"file://{tmp_path}/whole", f"file://{tmp_path}/parts"
    assert len(chunked.run(spark, points, whole, batch=99, **each)) == 1
    want = rows_of(spark, whole)
    assert [(f, p) for f, p, *_ in want] == [(f, p) for f in range(40) for p in range(5)]
    for f, p, _, *at in want:
        assert np.allclose(linalg.apply(to_world[0], np.array(at)), world[f, p], atol=0.05)
    # stopped between batches, and then within one, after its rows and before its record
    assert len(chunked.run(spark, points, parts, batch=2, most=1, **each)) == 1
    write = chunked._records
    calls = []

    def lost(s, output):
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("lost")
        return write(s, output)

    monkeypatch.setattr(chunked, "_records", lost)
    with pytest.raises(RuntimeError, match="lost"):
        chunked.run(spark, points, parts, batch=2, **each)
    monkeypatch.undo()
    spark.createDataFrame([(0, 0, 0, 9.0, 9.0, 9.0, 1.0, 2)], chunked.PLACED).write.partitionBy("batch").mode("append").parquet(f"{parts}/placed")  # rows of a batch without a record
    done = chunked.run(spark, points, parts, batch=2, **each)
    assert [r["batch"] for r in done] == list(range(len(done))) and sum(r["n_points"] for r in done) == 200
    got = rows_of(spark, parts)
    assert [r[:3] for r in got] == [r[:3] for r in want] and np.allclose([r[3:] for r in got], [r[3:] for r in want], atol=1e-6)
    before = rows_of(spark, parts)
    assert chunked.run(spark, points, parts, batch=2, **each) == done and rows_of(spark, parts) == before


def test_chunks_that_share_nothing(spark, tmp_path):
    _, _, points = chunk_points(spark, 4)
    with pytest.raises(ValueError, match="shares no points"):
        chunked.run(spark, points.filter("chunk <> 2"), f"file://{tmp_path}/x", frames=40, size=12, overlap=4, batch=9)
    with pytest.raises(ValueError, match="overlap"):
        chunked.run(spark, points, f"file://{tmp_path}/y", frames=40, size=4, overlap=4)


def brute_components(pixels, corners):
    left, out = set(pixels), []
    while left:
        seed = min(left, key=lambda p: (p[1], p[0]))
        part, todo = set(), [seed]
        while todo:
            x, y = todo.pop()
            if (x, y) in left:
                left.discard((x, y))
                part.add((x, y))
                todo += [(x + i, y + j) for i in (-1, 0, 1) for j in (-1, 0, 1) if corners or not i or not j]
        out.append(part)
    return out


def test_components(spark):
    rng = random.Random(6)
    for density in (0.2, 0.45, 0.6):
        images = {k: {(x, y) for x in range(23) for y in range(17) if rng.random() < density} for k in range(4)} | {9: {(0, 0)}, 10: {(x, 3) for x in range(50)}}
        rows = [(k, x, y) for k, px in images.items() for x, y in px]
        df = spark.createDataFrame(rows + rows[:5] + [(77, None, 1)], "image int, x int, y int")
        for corners in (True, False):
            got = masks.labelled_pixels(df, ["image"], corners=corners).collect()
            for k, px in images.items():
                want = brute_components(px, corners)
                mine = {}
                for r in got:
                    if r["image"] == k:
                        mine.setdefault(r["label"], set()).add((r["x"], r["y"]))
                        assert r["area"] == len(want[r["label"] - 1])
                assert [mine[i + 1] for i in range(len(want))] == want
    boxes = {r["label"]: r for r in masks.components(df.filter("image = 10"), ["image"]).collect()}
    assert boxes[1]["area"] == 50 and (boxes[1]["x0"], boxes[1]["x1"], boxes[1]["y0"]) == (0, 49, 3)
    kept = masks.without_specks(df, ["image"], 10).groupBy("image").count().collect()
    assert {r["image"]: r["count"] for r in kept} == {k: n for k, px in images.items() if (n := sum(len(c) for c in brute_components(px, True) if len(c) >= 10))}
    assert masks.components(df.limit(0), ["image"]).collect() == []


def test_homography_among_outliers(spark):
    rng = np.random.default_rng(8)
    h = np.array([[1.2, 0.1, 3.0], [-0.2, 0.9, -1.0], [0.05, 0.1, 1.0]])
    rows = []
    for grp in ("a", "b"):
        for k in range(80):
            p = rng.uniform(-2, 2, 2)
            u = h @ np.r_[p, 1]
            off = rng.uniform(1, 4, 2) * (k % 10 < 3)
            rows.append((grp, k, *map(float, p), *map(float, u[:2] / u[2] + rng.normal(size=2) * 1e-3 + off), 0.0 if k == 79 else 1.0 + k % 2))
    rows += [("few", k, 0.0, 0.0, 0.0, 0.0, 1.0) for k in range(4)] + [("a", 200, None, 0.0, 0.0, 0.0, 1.0)]
    df = spark.createDataFrame(rows, "grp string, id long, sx double, sy double, tx double, ty double, weight double")
    got = {r["grp"]: r for r in align.homography_consensus(df, ["grp"], "id", inlier=0.02, weight="weight").collect()}
    assert sorted(got) == ["a", "b"]
    for r in got.values():
        assert np.allclose(np.array(r["h"]).reshape(3, 3), h, atol=2e-2) and r["n_inliers"] == 55


def test_pose_errors_in_blocks(spark):
    rng = np.random.default_rng(9)
    poses = [(run, f, similarity(rng, 1.0), similarity(rng, 1.0)) for run in "xy" for f in (range(23) if run == "x" else [5, 900])] + [("z", 1, linalg.IDENTITY, linalg.IDENTITY)]
    flat = lambda m: (m[1].ravel().tolist(), m[2].tolist())
    df = spark.createDataFrame([(r, f, *flat(e), *flat(g)) for r, f, e, g in poses], "run string, frame long, est_r array<double>, est_t array<double>, gt_r array<double>, gt_t array<double>")
    brute = {}
    for r, i, e, g in poses:
        for s, j, e2, g2 in poses:
            if r == s and i < j:
                a, b = ((m[1].T @ n[1], m[1].T @ (n[2] - m[2])) for m, n in ((e, e2), (g, g2)))
                rot = np.degrees(np.arccos(np.clip((np.trace(a[0].T @ b[0]) - 1) / 2, -1, 1)))
                trans = np.degrees(np.arccos(min(1, abs(a[1] @ b[1]) / np.linalg.norm(a[1]) / np.linalg.norm(b[1]))))
                brute.setdefault(r, []).append((rot, trans))
    for block in (4, 256):
        got = {r["run"]: r for r in pooling.relative_pose_errors(df, ["run"], bins=90, block=block).collect()}
        assert got["z"]["n_pairs"] == 0 and got["z"]["auc"] == 0.0
        for run, errors in brute.items():
            counts = np.histogram(np.max(errors, axis=1), bins=90, range=(0, 90))[0]
            assert got[run]["n_pairs"] == len(errors) and got[run]["rotation"] == pytest.approx(np.mean([x[0] for x in errors]))
            assert got[run]["translation"] == pytest.approx(np.mean([x[1] for x in errors])) and got[run]["auc"] == pytest.approx(np.cumsum(counts).mean() / len(errors))


def test_pair_errors_by_products():
    """All pairs' angles from products of blocks equal those of the relative poses, one by one, without a 3 x 3 matrix a pair."""
    rng = np.random.default_rng(9)
    turn = lambda n: np.linalg.qr(rng.normal(size=(n, 3, 3)))[0]
    n, m = 300, 400
    re, rg, se, sg = turn(n), turn(n), turn(m), turn(m)
    for a in (re, rg, se, sg):
        a *= np.sign(np.linalg.det(a))[:, None, None]
    te, tg, ue, ug = (rng.normal(size=(k, 3)) for k in (n, n, m, m))
    ue[0], te[0] = 1.0, 1.0  # the estimate does not move
    tracemalloc.start()
    rot, trans = pooling._pair_errors(re, te, rg, tg, se, ue, sg, ug)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 16 * 8 * n * m and trans[0, 0] == 1e6
    for i, j in zip(rng.integers(1, n, 200), rng.integers(1, m, 200), strict=True):
        a, b = re[i].T @ se[j], rg[i].T @ sg[j]
        assert rot[i, j] == pytest.approx(np.degrees(np.arccos(np.clip((np.trace(a.T @ b) - 1) / 2, -1, 1))), abs=1e-5)
        p, q = re[i].T @ (ue[j] - te[i]), rg[i].T @ (ug[j] - tg[i])
        assert trans[i, j] == pytest.approx(np.degrees(np.arccos(abs(p @ q) / np.linalg.norm(p) / np.linalg.norm(q))), abs=1e-5)


def test_masks_are_closed_without_a_row_a_neighbour(spark):
    rng = np.random.default_rng(5)
    rows = [(int(i), int(x), int(y)) for i, x, y in zip(rng.integers(0, 6, 900), rng.integers(-3, 74, 900), rng.integers(-3, 24, 900), strict=True)]
    df = spark.createDataFrame([*rows, *rows[:50], (7, 500, 3), (8, None, 3), (None, 4, 4)], "image int, x long, y long")
    for radius in (1, 3):
        want = masks.erode(masks.dilate(df, ["image"], radius, 70, 20), ["image"], radius, 70, 20)
        got = masks.refine(df, ["image"], 70, 20, close=radius)
        assert "Generate" not in got._jdf.queryExecution().toString()
        # a join on the keys drops a mask without a name, which a group keeps
        assert Counter(map(tuple, got.filter("image is not null").collect())) == Counter(map(tuple, want.collect()))
        assert (None, 4, 4) in set(map(tuple, got.collect()))
    assert masks.refine(df.limit(0), ["image"], 70, 20, close=1).collect() == []
