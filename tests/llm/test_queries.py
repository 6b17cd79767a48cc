"""The registered queries themselves: folds, columns, held-out figures, SQL, and one table of odd rows for all."""

from __future__ import annotations

import zlib
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from conftest import SCHEMA  # noqa: F401  (the odd rows' schema)

from gridloom.llm import queries, quality_classifier

SF = "/root/testdata/sf0.01"
FOLDS = {"op1_language_id": (5, 0), "op5_quality_classifier": (4, 2), "op9_toxicity": (3, 1)}
COLUMNS = {
    "op1_language_id": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op2_mixing": {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"},
    "op3_near_dedup": {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint", "kept": "boolean"},
    "op4_quality_rules": {"doc_id": "bigint", "n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint", "n_dup_lines": "bigint", "n_repeat_words": "bigint", "base_failed": "boolean", "kept": "boolean"},
    "op5_quality_classifier": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op6_token_counts": {"doc_id": "bigint", "n_bytes": "bigint", "n_tokens": "bigint", "over_limit": "boolean"},
    "op7_sharding": {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"},
    "op8_decontamination": {"doc_id": "bigint", "n_words": "bigint", "n_hit": "bigint", "n_items": "bigint", "items_sha256": "string", "contaminated": "boolean"},
    "op9_toxicity": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op11_resampling": {"doc_id": "bigint", "n_features": "bigint", "weight": "bigint", "score": "bigint", "rank": "bigint"},
    "op10_pii": {"doc_id": "bigint", "n_email": "bigint", "n_ip": "bigint", "n_card": "bigint", "n_phone": "bigint", "base_sha256": "string", "spans": "string", "scores": "string"},
}


@pytest.fixture(scope="module")
def results(spark):
    held = {}

    def of(name):
        if name not in held:
            got = queries.QUERIES[name](spark, SF)
            held[name] = (dict(got.dtypes), got.collect())
        return held[name]

    return of


@pytest.fixture(scope="module")
def tables():
    docs = {r["doc_id"]: r for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()}
    return docs, {r["doc_id"]: r for r in pq.read_table(f"{SF}/labels.parquet").to_pylist()}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns_rows_and_folds(results, tables, name):
    types, rows = results(name)
    assert {c: types.get(c) for c in COLUMNS[name]} == COLUMNS[name]
    assert sorted(r["doc_id"] for r in rows) == sorted(tables[0])
    if name in FOLDS:
        folds, held = FOLDS[name]
        assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % folds == held) for r in rows)
        assert all(0 <= r["score"] <= 1 for r in rows)
    if "predicted" in types:
        assert all(r["predicted"] == int(r["score"] >= 0.7) for r in rows)


def area(rows, marks, column):
    """The share of pairs of held-out documents that the scores put in the right order."""
    found = [(r["score"], marks[r["doc_id"]][column]) for r in rows if r["held_out"] and r["doc_id"] in marks]
    up, down = np.array([s for s, y in found if y]), np.array([s for s, y in found if not y])
    return ((up[:, None] > down[None, :]).mean() + (up[:, None] == down[None, :]).mean() / 2), len(found)


def test_held_out_figures(results, tables):
    docs, marks = tables
    rows = results("op1_language_id")[1]
    held = [r["lang_pred"] == docs[r["doc_id"]]["lang"] for r in rows if r["held_out"] and docs[r["doc_id"]]["lang"] is not None]
    assert np.mean(held) > 0.97
    assert area(results("op5_quality_classifier")[1], marks, "quality")[0] > 0.95
    assert area(results("op9_toxicity")[1], marks, "toxic")[0] > 0.9


def test_near_duplicates_of_the_whole_table(results, tables):
    """Recall against brute force over all documents of the table."""
    from test_models import brute_components

    docs = tables[0]
    ids = sorted(docs)
    roots, sizes = brute_components(ids, [docs[i]["text"] for i in ids], size=4)
    got = {r["doc_id"]: r for r in results("op3_near_dedup")[1]}
    assert [got[i]["component_id"] for i in ids] == roots
    assert [got[i]["n_shingles"] for i in ids] == sizes


def test_token_counts_of_the_whole_table(results, tables):
    import public_tokenizers
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    docs, rows = tables[0], results("op6_token_counts")[1]
    want = {i: len(library.encode(r["text"] or "")) for i, r in docs.items()}
    assert {r["doc_id"]: r["n_tokens"] for r in rows} == want
    assert all(r["n_bytes"] == len((docs[r["doc_id"]]["text"] or "").encode()) and r["over_limit"] == (r["n_tokens"] > 4096) for r in rows)


def test_shards_of_the_whole_table(results, tables):
    """Against the plain reading of the law: sizes, checksums, gapless slots, near equal bytes, equal texts together."""
    docs, rows = tables[0], results("op7_sharding")[1]
    by, texts = {}, {}
    for r in rows:
        raw = (docs[r["doc_id"]]["text"] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)
        by.setdefault(r["shard"], []).append(r)
        texts.setdefault(raw, set()).add(r["shard"])
    assert sorted(by) == list(range(8))
    assert all(sorted(r["slot"] for r in v) == list(range(len(v))) for v in by.values())
    sizes, due = [sum(r["size"] for r in v) for v in by.values()], sum(r["size"] for r in rows) / 8
    assert max(abs(s - due) for s in sizes) < 0.02 * due + max(r["size"] for r in rows)
    count = Counter((docs[r["doc_id"]]["text"] or "").encode() for r in rows)
    assert all(len(s) == 1 for t, s in texts.items() if count[t] * (len(t) + 1) < 0.5 * due)


def test_spans_of_personal_data(results, tables):
    import hashlib

    from test_native import CARD, EMAIL, IP, PHONE, luhn

    def base(text):
        out = []
        digits = lambda m: "".join(c for c in m if c.isdigit())
        for kind, pattern, good in (("email", EMAIL, lambda m: True), ("ip", IP, lambda m: all(int(x) <= 255 for x in m.split("."))), ("card", CARD, lambda m: 16 <= len(digits(m)) <= 19 and luhn(digits(m))), ("phone", PHONE, lambda m: 8 <= len(digits(m)) <= 15)):
            out += [f"{kind}:{m.start()}:{m.end()}" for m in pattern.finditer(text) if good(m[0])]
        return out

    for r in results("op10_pii")[1]:
        want = base(tables[0][r["doc_id"]]["text"] or "")
        assert r["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert set(want) <= set(r["spans"].split(",")) | {""}
        assert len(r["scores"].split(",")) == len(r["spans"].split(","))
        planted = [f"secret:{m.start(1)}:{m.end(1)}" for m in re.finditer(r'token = "([0-9a-f]{40})"', tables[0][r["doc_id"]]["text"] or "")]
        assert planted == [x for x in r["spans"].split(",") if x.startswith("secret")]


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_against_sql(results, name):
    db = duckdb.connect()
    for t in ("documents", "benchmark", "labels", "embeddings"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    want = db.execute(queries.ORACLE[name])
    names = [d[0] for d in want.description]
    types, rows = results(name)
    assert sorted(names) == sorted(types)
    value = lambda v: round(v, 6) if isinstance(v, float) else v
    assert Counter(tuple(value(r[c]) for c in names) for r in rows) == Counter(tuple(map(value, r)) for r in want.fetchall())


@pytest.fixture(scope="module")
def odd_folder(tmp_path_factory, odd_rows):
    """Documents with string ids, null and clashing ids, nulls and extra columns, and benchmark and labels to go with them."""
    at = tmp_path_factory.mktemp("odd")
    extra = ["its_id", "its_key", "bad_id", "bad_key", "hit_id", "__bad_id", "__dropped_id", "size", "shard", "slot", "key", "label", "copies"]
    ids = [None if r[0] is None else f"d{r[0]}" for r in odd_rows]
    columns = {"doc_id": ids, "text": [r[1] for r in odd_rows], "lang": [r[2] for r in odd_rows], "source": [r[3] for r in odd_rows]} | {c: [1] * len(ids) for c in extra}
    columns = {k: v + ["d1"] * (k == "doc_id") + ["another text of an id that is there already, of ten words and more"] * (k == "text") + [None] * (k in ("lang", "source")) + [1] * (k in extra) for k, v in columns.items()}
    kinds = {"doc_id": pa.string(), "text": pa.string(), "lang": pa.string(), "source": pa.string()}
    pq.write_table(pa.table({k: pa.array(v, kinds.get(k, pa.int64())) for k, v in columns.items()}), at / "documents.parquet")
    pq.write_table(pa.table({"item_id": pa.array([1, None, 3], pa.int64()), "text": pa.array([odd_rows[0][1], "one two three", None])}), at / "benchmark.parquet")
    pq.write_table(pa.table({"doc_id": pa.array(["d1", "d3", "d9", None]), "quality": pa.array([1, 0, 1, 1], pa.int32()), "toxic": pa.array([0, 1, 0, None], pa.int32())}), at / "labels.parquet")
    none = tmp_path_factory.mktemp("none")
    for t in ("documents", "benchmark", "labels"):
        pq.write_table(pq.read_table(at / f"{t}.parquet").slice(0, 0), none / f"{t}.parquet")
    return at, none, len(columns["doc_id"])


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_odd_tables(spark, odd_folder, name):
    at, none, n = odd_folder
    got = queries.QUERIES[name](spark, f"file://{at}").collect()
    assert len(got) == n
    assert queries.QUERIES[name](spark, f"file://{none}").collect() == []


def test_odd_pipeline(spark, odd_folder):
    import corpus_pipeline

    at, none, n = odd_folder
    docs = spark.read.parquet(f"file://{at}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, f"file://{at}")
        assert docs.columns == spark.read.parquet(f"file://{at}/documents.parquet").columns
        docs = spark.createDataFrame(docs.collect(), docs.schema)
    got = corpus_pipeline.run(spark, f"file://{at}").collect()
    texts = Counter(r["text"] for r in got)
    assert len(got) <= 3 * n and None not in texts
    assert corpus_pipeline.run(spark, f"file://{none}").collect() == []


def test_intermediate_tables_go(spark, odd_folder):
    import os

    from gridloom.llm.tables import shared_dir

    folder = shared_dir(spark).removeprefix("file://") + "/gridloom-tables"
    before = set(os.listdir(folder))
    queries.op3_near_dedup(spark, f"file://{odd_folder[0]}").collect()
    left = {x.rsplit("-", 1)[0] for x in set(os.listdir(folder)) - before}
    assert left <= {"sketches", "classes", "labels"}


def plain_forward(w, x):
    """One bag's attention pooling, written out."""
    h = np.tanh(x @ w["W"] + w["b"])
    energy = np.array([sum(w["a"][j] * np.tanh(r @ w["V"][:, j]) / (1 + np.exp(-(r @ w["U"][:, j]))) for j in range(len(w["a"]))) for r in h])
    attention = np.exp(energy - energy.max())
    attention /= attention.sum()
    return 1 / (1 + np.exp(-(attention @ h @ w["c"] + w["d"][0]))), attention.max()


def test_quality_scores_against_plain_attention(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = quality_classifier.train(docs, labels)
    some = docs.limit(60).collect()
    got = {r["id"]: r for r in quality_classifier.score(docs, model).collect()}
    for r in some:
        raw = np.frombuffer((r["text"] or "").encode(), np.uint8)
        x, begin = quality_classifier.encode(raw, np.array([0, len(raw)]))
        score, top = plain_forward(model.weights, (x - model.mean) / model.scale)
        assert got[r["doc_id"]]["score"] == pytest.approx(score, abs=1e-6)
        assert got[r["doc_id"]]["top_weight"] == pytest.approx(top, abs=1e-6) and got[r["doc_id"]]["n_passages"] == begin[-1]
