"""The jobs: growing input, redelivery and late messages, restarts, changed and vanished assets, the command line."""

from __future__ import annotations

import datetime as dt
import json

import pytest

from gridloom.operators import asof
from jobs import sensor_days, text_ledger
from jobs.command import settings

START = dt.datetime(2024, 3, 1)


def message(k, hours, rig=1, topic="view", value=0.5):
    return (k, None if hours is None else START + dt.timedelta(hours=hours), rig, topic, value)


def deliver(spark, folder, rows):
    spark.createDataFrame(rows, sensor_days.SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def days(spark, out):
    return {(r["day"].isoformat(), r["rig"]): r.asDict() for r in spark.read.schema(sensor_days.REPORT).parquet(f"{out}/days").collect()}


@pytest.fixture
def at(tmp_path):
    return f"file://{tmp_path}"


def test_only_new_messages_are_taken(spark, at):
    paths = f"{at}/in", f"{at}/out", f"{at}/mark"
    first = [message(1, 1), message(2, 3, topic="click"), message(3, 23.5), message(4, 30), message(5, None), (None, START, 1, "view", 1.0), message(6, 2, rig=2), message(7, 4, rig=None)]
    deliver(spark, paths[0], first)
    done = sensor_days.run(spark, *paths)
    assert (done["read"], done["landed"], done["rejected"]) == (8, 5, 3)
    got = days(spark, paths[1])
    assert got["2024-03-01", 1]["n_messages"] == 3 and got["2024-03-01", 1]["longest_us"] == int(20.5 * 3600e6) and got["2024-03-01", 1]["n_silent"] == 1
    assert (got["2024-03-01", 1]["n_frames"], got["2024-03-01", 1]["n_matched"], got["2024-03-01", 1]["offset_us"]) == (2, 1, 2 * 3600_000_000)
    assert got["2024-03-01", 2]["longest_us"] is None and got["2024-03-01", 2]["n_silent"] == 0 and got["2024-03-01", 2]["offset_us"] is None
    assert sensor_days.run(spark, *paths)["batches"] == 0 and days(spark, paths[1]) == got
    # a message again, a late one, and one after midnight that the frame of the evening before matches
    deliver(spark, paths[0], [message(1, 1), message(8, 12, topic="click"), message(9, 25, topic="click")])
    done = sensor_days.run(spark, *paths)
    assert (done["batches"], done["read"]) == (1, 3)
    later = days(spark, paths[1])
    assert later["2024-03-01", 1]["n_messages"] == 4 and later["2024-03-01", 1]["n_matched"] == 2
    assert later["2024-03-01", 1]["offset_us"] == int((2 + 1.5) * 3600e6)
    assert later["2024-03-02", 1]["n_messages"] == 2 and later["2024-03-02", 1]["n_matched"] == 1
    assert later["2024-03-01", 2] == got["2024-03-01", 2]


def test_one_delivery_or_many(spark, at):
    rows = [message(k, (k * 7) % 90 / 1.7, rig=k % 3, topic=["view", "click", "error"][k % 3 if k % 5 else 1]) for k in range(120)]
    deliver(spark, f"{at}/a", rows)
    sensor_days.run(spark, f"{at}/a", f"{at}/oa", f"{at}/ma")
    for part in (rows[80:], rows[:50], rows[40:80]):
        deliver(spark, f"{at}/b", part)
        sensor_days.run(spark, f"{at}/b", f"{at}/ob", f"{at}/mb", config={"files_per_batch": 1})
    assert days(spark, f"{at}/oa") == days(spark, f"{at}/ob") and len(days(spark, f"{at}/oa")) > 3


def test_a_batch_that_stopped_half_way(spark, at, monkeypatch):
    paths = f"{at}/in", f"{at}/out", f"{at}/mark"
    deliver(spark, paths[0], [message(k, k) for k in range(1, 40)])
    whole = sensor_days.reports
    monkeypatch.setattr(sensor_days, "reports", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(Exception, match="lost"):
        sensor_days.run(spark, *paths)
    monkeypatch.setattr(sensor_days, "reports", whole)
    assert sensor_days.run(spark, *paths)["landed"] == 39
    assert sum(r["n_messages"] for r in days(spark, paths[1]).values()) == 39
    assert spark.read.parquet(f"{paths[1]}/messages").count() == 39


def test_no_messages(spark, at):
    deliver(spark, f"{at}/in", [])
    assert sensor_days.run(spark, f"{at}/in", f"{at}/out", f"{at}/mark")["read"] == 0
    assert days(spark, f"{at}/out") == {}


def brute_nearest(left, right, within):
    out = {}
    for i, t in left:
        near = min(((abs(u - t), u, j) for j, u in right if abs(u - t) <= within), default=None)
        out[i] = None if near is None else near[1]
    return out


def test_nearest_in_slices(spark):
    import random

    rng = random.Random(5)
    left = [(i, rng.randrange(-500, 3000)) for i in range(200)]
    right = [(j, rng.randrange(-500, 3000)) for j in range(60)] + [(99, 700), (98, 700)]
    ls, rs = spark.createDataFrame([(1, *x) for x in left], "k int, i long, ts long"), spark.createDataFrame([(1, *x) for x in right], "k int, j long, ts long")
    for within, width in ((30, 7), (30, 100), (5, 5), (400, 1000)):
        got = asof.nearest_within(ls, rs, ["k"], order="j", carry=[], within=within, width=width).collect()
        assert {r["i"]: r["r_ts"] for r in got} == brute_nearest(left, right, within) and len(got) == 200


def test_silences_in_slices(spark):
    rows = [(1, t, t) for t in (0, 5, 6, 99, 100, 450, 451)] + [(2, 7, 7), (3, None, 0)]
    df = spark.createDataFrame(rows, "k int, ts long, i long")
    for width in (1, 50, 10_000):
        got = {r["k"]: (r["longest_us"], r["n_silent"]) for r in asof.silences(df, ["k"], ts="ts", order="i", limit=90, width=width).collect()}
        assert got == {1: (350, 2), 2: (None, 0)}


TEXTS = {"documents": "doc_id long, text string, source string", "pages": "page_id long, url string, html string", "conversations": "conv_id long, turn long, role string, text string"}


def put(spark, folder, documents=(), pages=(), conversations=()):
    for name, rows in (("documents", documents), ("pages", pages), ("conversations", conversations)):
        spark.createDataFrame(list(rows), TEXTS[name]).write.mode("overwrite").parquet(f"{folder}/{name}.parquet")


def test_ledger_follows_the_tables(spark, at):
    docs = [(k, f"text {k}", "a" if k % 3 else None) for k in range(60)]
    pages = [(1, "http://h.example/x?1", "<p>"), (2, "no host", None), (3, None, "")]
    put(spark, f"{at}/in", docs + [(100, "text 7", "b"), (5, "text 5", "a")], pages, [(1, 0, "user", "hi"), (1, 1, "user", "text 7")])
    done = text_ledger.run(spark, f"{at}/in", f"{at}/out")
    assert done["assets"] == 66 and done["written"] == done["shelves"] > 16
    rows = {(r["kind"], r["name"]): r for r in text_ledger.ledger(spark, f"{at}/out").collect()}
    assert len(rows) == 66 and rows["documents", "5"]["n_rows"] == 2
    assert rows["documents", "7"]["copy_of"] == "100" and rows["conversations", "1/1"]["copy_of"] is None
    assert rows["pages", "no host"]["sha256"] is None and rows["pages", "http://h.example/x?1"]["grp"] == "h.example" and rows["pages", ""]["n_bytes"] == 0
    again = text_ledger.run(spark, f"{at}/in", f"{at}/out")
    assert again["written"] == again["gone"] == 0
    # same name, same size, another byte: its shelf only
    docs[9] = (9, "text_9", None)
    put(spark, f"{at}/in", docs + [(100, "text 7", "b"), (5, "text 5", "a")], pages, [])
    done = text_ledger.run(spark, f"{at}/in", f"{at}/out")
    assert done["written"] == 1 and done["gone"] > 0
    now = {(r["kind"], r["name"]): r for r in text_ledger.ledger(spark, f"{at}/out").collect()}
    assert len(now) == 64 and now["documents", "9"]["sha256"] != rows["documents", "9"]["sha256"]
    assert all(now[k] == rows[k] for k in now if k[1] != "9" and now[k]["signature"] == rows[k]["signature"])


def test_ledger_after_a_stop_before_the_marks(spark, at, monkeypatch):
    put(spark, f"{at}/in", [(k, f"t{k}", "a") for k in range(20)])
    text_ledger.run(spark, f"{at}/in", f"{at}/out")
    put(spark, f"{at}/in", [(k, f"u{k}", "a") for k in range(20)])
    create = type(spark).createDataFrame
    monkeypatch.setattr(type(spark), "createDataFrame", lambda self, rows, schema=None, *a, **b: (_ for _ in ()).throw(OSError("stopped")) if schema == text_ledger.SHELF else create(self, rows, schema, *a, **b))
    with pytest.raises(OSError, match="stopped"):
        text_ledger.run(spark, f"{at}/in", f"{at}/out")
    monkeypatch.undo()
    done = text_ledger.run(spark, f"{at}/in", f"{at}/out")
    assert done["written"] == done["shelves"]
    assert text_ledger.ledger(spark, f"{at}/out").count() == 20


def test_empty_ledger(spark, at):
    put(spark, f"{at}/in")
    assert text_ledger.run(spark, f"{at}/in", f"{at}/out") == {"assets": 0, "bytes": 0, "shelves": 0, "written": 0, "gone": 0}


def test_settings(tmp_path):
    assert settings(text_ledger.__file__, {"shelves": 4})["shelves"] == 4
    with pytest.raises(ValueError, match="shelfs"):
        settings(text_ledger.__file__, {"shelfs": 4})


def test_command_line(tmp_path):
    """In a process of its own, as the command makes and ends the session."""
    import subprocess
    import sys
    from pathlib import Path

    top = Path(__file__).resolve().parent.parent
    (tmp_path / "c.json").write_text(json.dumps({"tolerance_seconds": 60}))
    command = [sys.executable, "-m", "jobs.sensor_days", "--input", "/root/testdata/sf0.001/events.parquet", "--output", f"{tmp_path}/out", "--checkpoint", f"{tmp_path}/mark", "--config", f"{tmp_path}/c.json"]
    run = subprocess.run(command, cwd=top, capture_output=True, text=True, timeout=300)
    assert run.returncode == 0 and "read 1000 messages" in run.stderr
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["days", "messages", "rejected"]
