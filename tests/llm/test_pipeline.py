"""The pipeline, stage by stage against plain Python, and its place in the entry module."""

from __future__ import annotations

from collections import Counter

import corpus_pipeline
import pytest
from test_models import brute_components
from test_native import brute_hits

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        at = f"file://{tmp_path_factory.mktemp(name)}/t"
        got = stage(spark, docs, SF)
        got.write.parquet(at)
        out.append((name, docs, spark.read.parquet(at)))
        docs = out[-1][2]
    return out


def test_order_and_columns(spark, stages):
    assert [n for n, _, _ in stages] == ["language", "near_duplicates", "decontaminate", "mix", "shard"]
    names = spark.read.parquet(f"{SF}/documents.parquet").columns
    assert all(after.columns == names for _, _, after in stages[:-1])


def rows(df):
    return [tuple(r) for r in df.select("doc_id", "text").collect()]


def test_language_keeps_clean_documents(stages):
    _, before, after = stages[0]
    assert set(rows(after)) <= set(rows(before))
    assert after.count() >= 0.99 * before.count()


def test_near_duplicates_keep_one_of_each_group(stages):
    _, before, after = stages[1]
    table = rows(before)
    roots, _ = brute_components([i for i, _ in table], [t for _, t in table], size=5)
    assert sorted(i for i, _ in rows(after)) == sorted(set(roots))


def test_decontaminate_drops_the_contaminated(spark, stages):
    _, before, after = stages[2]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert sorted(i for i, _ in rows(after)) == sorted(i for i, t in rows(before) if not brute_hits(t, items)[3])


def test_mix_repeats_whole_documents(stages):
    _, before, after = stages[3]
    assert set(rows(after)) <= set(rows(before))
    assert max(Counter(rows(after)).values()) <= 3


def test_shards_hold_everything(stages):
    _, before, after = stages[4]
    assert Counter(rows(after)) == Counter(rows(before))
    slots = Counter((r["shard"], r["slot"]) for r in after.collect())
    assert set(slots.values()) == {1}
    for s in {k[0] for k in slots}:
        assert sorted(k[1] for k in slots if k[0] == s) == list(range(sum(k[0] == s for k in slots)))


def test_run_is_the_stages(spark, stages):
    assert Counter(rows(corpus_pipeline.run(spark, SF))) == Counter(rows(stages[4][2]))


def test_odd_rows_pass_through(spark, odd, empty):
    for table in (odd, empty):
        docs = table
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, SF)
            assert docs.columns[: len(table.columns)] == table.columns
            docs = spark.createDataFrame(docs.collect(), docs.schema)
        assert docs.count() <= 3 * table.count()


def test_registered():
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert {f"op{n}" for n in range(1, 11)} <= {x.split("_")[0] for x in names}
    assert "pipeline" in names
    assert set(entry.oracle_sql()) <= names
