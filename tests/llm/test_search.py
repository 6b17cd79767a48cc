"""Importance resampling and exact top-k search: against plain Python, with odd rows, hot groups and what the method promises to skip."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.llm import importance, queries, topk


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_buckets(text, buckets):
    w = plain_words(text)
    return [zlib.crc32(" ".join(w[k : k + n]).encode()) % buckets for n in (1, 2, 3) for k in range(len(w) - n + 1)]


def plain_scores(docs, target, buckets=10_000):
    """(n_features, weight, score) of each (id, text)."""
    s, t = Counter(b for _, x in docs for b in plain_buckets(x, buckets)), Counter(b for x in target for b in plain_buckets(x, buckets))
    total, aimed = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (total + buckets) / ((s[b] + 1) * (aimed + buckets))))
    out = []
    for i, x in docs:
        found = plain_buckets(x, buckets)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, found))
        out.append((len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    return out


def test_resampling_against_plain_python(spark, odd, odd_rows):
    target = ["one two three", None, odd_rows[0][1], "Und KEIN id", ""]
    bench = spark.createDataFrame([(t,) for t in target], "text string")
    for percent, least in ((5, 20), (50, 2), (100, 0)):
        got = importance.resample(odd, bench, percent=percent, least_words=least).collect()
        docs = [(r[0], r[1]) for r in odd_rows]
        want = plain_scores(docs, target)
        assert Counter((r["id"], r["n_features"], r["weight"], r["score"]) for r in got) == Counter((i, *w) for (i, _), w in zip(docs, want, strict=True))
        able = sorted(((-w[2], i is None, i or 0) for (i, x), w in zip(docs, want, strict=True) if len(plain_words(x)) >= least))
        drawn = able[: percent * len(able) // 100]
        ranked = sorted((r["rank"], -r["score"], r["id"] is None, r["id"] or 0) for r in got if r["rank"] is not None)
        assert [r[0] for r in ranked] == list(range(1, len(drawn) + 1)) and [r[1:] for r in ranked] == drawn


def test_features_of_foreign_letters(spark):
    texts = ["ÄÖ Straße İstanbul ΣΑΣ'Σ", "ABC äbc ABC", "a-b_c d e", "ß", "Ⅷ ⅷ Ǆ ABC"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = importance.features(rows.select("id", importance.words(F.col("text")).alias("w")), ["id"]).filter("bucket is not null").groupBy("id").agg(F.sort_array(F.collect_list("bucket")).alias("b")).collect()
    assert {r["id"]: r["b"] for r in got} == {k: sorted(plain_buckets(t, 10_000)) for k, t in enumerate(texts)}


def test_a_third_of_all_rows_under_one_id(spark):
    """Ranks stay gapless and ordered when one id and text repeats, over more partitions than there are keys."""
    docs = spark.createDataFrame([(7 if k % 3 == 0 else k, "same words " * 15 if k % 3 == 0 else f"w{k} " * 25) for k in range(900)], "doc_id long, text string").repartition(7)
    got = importance.resample(docs, spark.createDataFrame([("same words",)], "text string"), percent=80).collect()
    ranked = sorted((r["rank"], r["score"]) for r in got if r["rank"] is not None)
    assert len(got) == 900 and [r[0] for r in ranked] == list(range(1, 721)) and all(a[1] >= b[1] for a, b in zip(ranked[:-1], ranked[1:], strict=True))
    assert sum(r["rank"] is not None for r in got if r["id"] == 7) == 121  # the frequent words weigh least, so what is left of the draw goes to their copies


def test_drawn_documents(spark, odd, empty):
    bench = spark.createDataFrame([("one two three",)], "text string")
    docs = odd.withColumn("row", F.lit(1)).withColumn("rank", F.lit("x"))
    got = importance.draw(docs, bench, percent=50, least_words=1)
    assert got.columns == [*docs.columns, "rank_1"]
    ids = importance.resample(docs, bench, percent=50, least_words=1).filter("rank is not null")
    assert Counter((r["doc_id"], r["rank_1"]) for r in got.collect()) == Counter((r["id"], r["rank"]) for r in ids.collect())
    assert importance.resample(empty, bench).collect() == [] and importance.draw(empty, bench).collect() == []
    none = importance.resample(odd, bench.limit(0)).collect()
    assert len(none) == odd.count()


def test_drawing_leans_to_the_target(spark):
    rng = random.Random(3)
    draw = lambda words: " ".join(rng.choice(words) for _ in range(40))
    near, far = ["apple", "pear", "plum"], ["iron", "zinc", "lead"]
    docs = spark.createDataFrame([(k, draw(near if k % 10 == 0 else far)) for k in range(1000)], "doc_id long, text string")
    got = importance.resample(docs, spark.createDataFrame([(draw(near),) for _ in range(20)], "text string"), percent=5).filter("rank is not null").collect()
    assert len(got) == 50 and all(r["id"] % 10 == 0 for r in got)


def plain_top(rows, asks, k):
    """The contract, row by row, in integers of any size."""
    held = [(n, i, [min(max(math.floor(256 * x), -topk.LIMIT), topk.LIMIT) for x in v]) for n, (i, v) in enumerate(rows) if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, i, q in held:
        if i is not None and asks(i):
            others = sorted((-sum(a * b for a, b in zip(q, x, strict=True)), j is None, j or 0) for m, j, x in held if m != n and len(x) == len(q))
            out += [(i, r, None if none else j, -s) for r, (s, none, j) in enumerate(others[:k], 1)]
    return Counter(out)


def vectors(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 1, 2) for i, v in rows], "vec_id long, embedding array<double>, row int, score int")


def found(df, asks, k=5):
    return Counter((r["query_id"], r["rank"], r["id"], r["score"]) for r in topk.top_k(df, asks, k=k).collect())


@pytest.mark.parametrize("shape", ["normal", "clustered", "ties", "integers"])
def test_search_against_plain_python(spark, monkeypatch, shape):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 20)) * np.linspace(2, 0.05, 20)
    if shape == "clustered":
        x = rng.normal(size=(8, 20))[np.arange(400) % 8] + 0.05 * x
    elif shape == "ties":
        x = np.round(x[np.arange(400) // 40] * 2) / 2
    elif shape == "integers":
        x = rng.integers(-3, 4, size=(400, 20)) * 5000.0
    rows = [(int(i), v.tolist()) for i, v in zip(rng.permutation(400), x, strict=True)]
    want = plain_top(rows, lambda i: i % 7 == 0, 5)
    for seeds, least, dense, columns in ((1024, 1024, 0.2, 8), (6, 30, 1.0, 3), (1, 50, 0.0, 20)):
        for name, value in (("SEEDS", seeds), ("LEAST_GROUP", least), ("DENSE", dense), ("COLUMNS", columns)):
            monkeypatch.setattr(topk, name, value)
        assert found(vectors(spark, rows), F.col("vec_id") % 7 == 0) == want


def test_search_with_many_groups(spark, monkeypatch):
    """Groups of candidates and of queries by their bounds, and fewer rows than asked for."""
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(150)]
    for name, value in (("CELLS", 60), ("QUERY_CELLS", 24), ("LEAST_GROUP", 5)):
        monkeypatch.setattr(topk, name, value)
    assert found(vectors(spark, rows), F.lit(True), 3) == plain_top(rows, lambda i: True, 3)
    few = rows[:3]
    assert found(vectors(spark, few), F.lit(True)) == plain_top(few, lambda i: True, 5)


def test_odd_vectors(spark):
    rows = [
        (1, [0.5, 1.0]), (2, None), (3, [1.0, None]), (4, [float("nan"), 1.0]), (5, [float("inf"), 0.0]), (6, [0.5, 1.0]), (6, [0.5, 1.0]), (None, [0.5, 1.0]), (7, []), (8, []),
        (9, [1.0, 2.0, 3.0]), (10, [-1.0, 2.0, 3.0]), (11, [1e30, -1e30]), (12, [0.001, -0.001]), (None, [9.0, 9.0]),
    ]
    got = topk.top_k(vectors(spark, rows), F.col("vec_id").isNotNull()).collect()
    assert Counter((r["query_id"], r["rank"], r["id"], r["score"]) for r in got) == plain_top(rows, lambda i: True, 5)
    assert {r["query_id"] for r in got}.isdisjoint({2, 3, 4, 5}) and {r["score"] for r in got if r["query_id"] == 7} == {0}
    assert topk.top_k(vectors(spark, rows[:0]), F.lit(True)).collect() == []
    assert topk.top_k(vectors(spark, rows), F.lit(False)).collect() == []
    named = topk.top_k(vectors(spark, rows).withColumn("vec_id", F.concat(F.lit("v"), F.col("vec_id").cast("string"))), F.col("vec_id") == "v1").collect()
    assert [(r["query_id"], r["id"]) for r in sorted(named, key=lambda r: r["rank"])][:3] == [("v1", None), ("v1", "v6"), ("v1", "v6")]


def test_copies_of_one_vector_leave_a_task_once(spark, monkeypatch):
    """A third of all rows are one vector: the k smallest ids, and at most k rows a query and group."""
    rng = np.random.default_rng(6)
    hot = rng.normal(size=8).tolist()
    rows = [(i, hot if i % 3 == 0 else rng.normal(size=8).tolist()) for i in range(600)]
    assert found(vectors(spark, rows), F.col("vec_id") % 50 == 0) == plain_top(rows, lambda i: i % 50 == 0, 5)
    x = np.array([v for _, v in rows])
    columns = topk.Columns(np.floor(256 * x).astype(np.int32))
    i, _, _ = topk.search(columns, np.floor(256 * x[:50]).astype(np.int32), np.full(50, topk.NONE), np.arange(50), np.arange(600), 5)
    assert np.bincount(i).max() == 5


def test_bounds_skip_work(spark):
    """With a floor, most candidates of heavy-headed vectors are gone before the last block of columns."""
    rng = np.random.default_rng(7)
    x = np.floor(256 * rng.normal(size=(3000, 32)) * np.r_[np.full(8, 2.0), np.full(24, 0.05)]).astype(np.int32)
    columns = topk.Columns(x)
    assert np.allclose(columns.rest[0], np.linalg.norm(x, axis=1)) and (np.diff(columns.rest, axis=0) <= 1e-9).all()
    q = x[:3]
    score = q.astype(np.int64) @ x.T.astype(np.int64)
    floors = np.sort(score, axis=1)[:, -6]
    left = q[:, columns.order[:8]] @ x[:, columns.order[:8]].T + np.outer(np.linalg.norm(q[:, columns.order[8:]], axis=1), columns.rest[1])
    assert (left >= floors[:, None]).mean() < 0.02
    i, j, s = topk.search(columns, q, floors, np.array([0, 1, 2]), np.arange(3000), 5)
    for k in range(3):
        best = [c for c in np.lexsort((np.arange(3000), -score[k])) if c != k][:5]
        assert j[i == k].tolist() == best and s[i == k].tolist() == score[k][best].tolist()


def test_sums_beyond_doubles():
    x = np.full((4, 40), topk.LIMIT, np.int32)
    x[1, 0] -= 1
    i, j, s = topk.search(topk.Columns(x), x, np.full(4, topk.NONE), np.arange(4), np.arange(4), 3)
    assert s[i == 0].tolist() == [40 * topk.LIMIT**2] * 2 + [40 * topk.LIMIT**2 - topk.LIMIT] and j[i == 0].tolist() == [2, 3, 1]


def test_search_query_on_the_whole_table(spark):
    got = queries.op12_exact_top_k(spark, "/root/testdata/sf0.01")
    assert dict(got.dtypes) == {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "bigint"} and got.count() == 50
