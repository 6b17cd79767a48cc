"""Binary glTF files and frozen-cache discovery: layout by hand, broken and empty input."""

from __future__ import annotations

import json
import struct

import pytest

from gridloom import cluster
from gridloom.sources import files, glb

POINTS = "x double, y double, z double, red int, green int, blue int"


def test_glb_layout(spark, tmp_path):
    rows = [(1.0, 2.0, 3.0, 10, 20, 30), (-1.5, 0.0, 9.0, 255, 0, 1), (None, 0.0, 0.0, 1, 1, 1), (float("nan"), 0.0, 0.0, 1, 1, 1), (0.25, 7.0, -2.0, None, 5, 6)]
    at = f"file://{tmp_path}/a.glb"
    assert glb.write(spark.createDataFrame(rows, POINTS).repartition(3), at) == 3
    data = (tmp_path / "a.glb").read_bytes()
    magic, version, total, size, kind = struct.unpack_from("<4sIII4s", data)
    assert (magic, version, total, kind) == (b"glTF", 2, len(data), b"JSON") and size % 4 == 0
    document = json.loads(data[20 : 20 + size])
    assert struct.unpack_from("<I4s", data, 20 + size) == (48, b"BIN\0") and document["buffers"][0]["byteLength"] == 48
    assert document["accessors"][0]["min"] == [-1.5, 0.0, -2.0] and document["accessors"][0]["max"] == [1.0, 7.0, 9.0]
    got = sorted((r["x"], r["y"], r["z"], r["red"], r["green"], r["blue"]) for r in glb.read(spark, at).collect())
    assert got == [(-1.5, 0.0, 9.0, 255, 0, 1), (0.25, 7.0, -2.0, 0, 5, 6), (1.0, 2.0, 3.0, 10, 20, 30)]
    assert glb.write(spark.createDataFrame([], POINTS), f"file://{tmp_path}/none.glb") == 0
    assert glb.read(spark, f"file://{tmp_path}/none.glb").collect() == []
    (tmp_path / "bad.glb").write_bytes(data[:-4])
    with pytest.raises(Exception, match="bad.glb"):
        glb.read(spark, f"file://{tmp_path}/bad.glb").collect()


def test_frozen_runs(spark, tmp_path):
    def run(name, chunks, **made):
        work = tmp_path / "floor_1/2025-05-05" / name / "_work/a"
        (work / files.CACHE).mkdir(parents=True)
        for c in chunks:
            (work / files.CACHE / f"chunk_{c}.npy").write_text("x")
        for file, text in made.items():
            (work / {"pre": files.BEFORE_LOOPS, "final": files.FINAL, "outcome": files.OUTCOME, "loops": files.LOOPS}[file]).write_text(text)

    no, yes = "chunk_a,accepted\n0, False \n1,false\n", "chunk_a,accepted\n0,False\n1,True\n"
    run("run_1", [0, 1, 2], pre="x", final="x", loops=yes)
    run("run_2", [1, 0], final="x", loops=no)
    run("run_3", [0], final="x", loops=yes)
    run("run_4", [0], final="x", loops=no, outcome="x")
    run("run_5", [0, 2], final="x")
    run("run_6", ["0", "00"], pre="x")
    run("run_7", ["a"], final="x", loops="chunk_a,accepted\n")
    got = {r["run"].split("/")[-1]: r for r in files.frozen_runs(spark, f"file://{tmp_path}").collect()}
    poor, gap = "no admissible poses", "chunks are not contiguous"
    assert {k: (r["n_chunks"], r["kind"], r["problem"]) for k, r in got.items()} == {
        "run_1": (3, "before_loops", ""), "run_2": (2, "final_without_loops", ""), "run_3": (1, None, poor), "run_4": (1, None, poor),
        "run_5": (2, None, f"{poor};{gap}"), "run_6": (2, "before_loops", gap), "run_7": (1, None, f"{poor};{gap}"),
    }
    assert got["run_1"]["poses"].endswith(files.BEFORE_LOOPS) and got["run_2"]["poses"].endswith(f"a/{files.FINAL}") and got["run_3"]["poses"] is None


@pytest.mark.parametrize("known", [True, False])
def test_files_by_the_tasks(spark, tmp_path, monkeypatch, known):
    """Tasks write the files of runs and list them, and the driver lists only the dates; a store that Arrow does not know gives the same."""
    listed = []
    plain = files.listing
    monkeypatch.setattr(files, "listing", lambda *a, **k: listed.append(a) or plain(*a, **k))
    if not known:
        for module in (cluster, files):
            monkeypatch.setattr(module, "by_arrow", lambda path: None)
    root = tmp_path / "a folder"
    rows = [(f"floor_{k % 2}/d/run_{k}/_work/{w}/{name}", text) for k in range(40) for w in "ab"[: 1 + k % 2] for name, text in ((f"{files.CACHE}/chunk_0.npy", "x"), (files.FINAL, "x"), (files.LOOPS, f"accepted,n\n{k % 3 == 0},1\n"), (files.OUTCOME, ""), ("other", "x"))]
    frame = spark.createDataFrame(rows, "name string, content string")
    for _ in range(2):  # a task may be repeated
        assert cluster.put_files(frame.selectExpr("name", "CAST(content AS BINARY) AS content"), f"file://{root}") == len(rows)
    assert {str(p.relative_to(root)): p.read_text() for p in root.rglob("*") if p.is_file() and not p.name.endswith(".crc")} == dict(rows)
    got = [(r["run"], r["work"].split("/")[-1], r["n_chunks"], r["kind"]) for r in files.frozen_runs(spark, f"file://{root}").collect()]
    assert sorted(got, key=str) == sorted([(f"floor_{k % 2}/d/run_{k}", w, 1, None if k % 3 == 0 else "final_without_loops") for k in range(40) for w in "ab"[: 1 + k % 2]], key=str)
    assert bool(listed) is not known
