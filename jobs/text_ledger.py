"""Batch job: a verified ledger of all text assets, of which only what changed is written.

Long runs may only be reused or resumed if the bytes they were made from are
the same; names and sizes do not prove that.  The job reads the text tables
(``documents``, ``pages``, ``conversations``), and keeps for every asset its
name, group, bytes, SHA-256 and, where the same text exists under a smaller
name, that name.  The ledger is cut into shelves by a hash of the name, so a
group with most of the assets is spread; each shelf has a signature over all
its rows.

``<output>/assets`` is partitioned by kind and shelf.  ``<output>/shelves``
holds the signatures and is written last: a shelf whose signature is there
already is left alone, and one of which the job was stopped half-way is
written again.  A second run over the same tables writes nothing.

    python -m jobs.text_ledger --input FOLDER --output FOLDER [--config FILE]
"""

from __future__ import annotations

import logging
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.cluster import store_of
from gridloom.operators import provenance
from jobs.command import main, settings

log = logging.getLogger("jobs.text_ledger")

ASSET = "name string, grp string, n_bytes long, sha256 string, n_rows long, copy_of string, kind string, shelf int"
SHELF = "n_assets long, n_bytes long, signature string, kind string, shelf int"


def kinds() -> dict[str, tuple[Column, Column, str]]:
    """Of each table: what names an asset, what groups it, and the column of its text."""
    return {
        "documents": (F.col("doc_id").cast("string"), F.col("source"), "text"),
        "pages": (F.col("url"), F.nullif(F.regexp_extract("url", r"^[a-z]+://([^/?#]+)", 1), F.lit("")), "html"),
        "conversations": (F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")), F.col("role"), "text"),
    }


def assets(spark: SparkSession, source: str, *, shelves: int, lanes: int) -> DataFrame:
    """(kind, shelf, name, grp, n_bytes, sha256, n_rows, copy_of), one row a name and content.

    A null text has no bytes and no digest, and is no copy; a null name is the
    empty one.  Equal rows are summed before they are shuffled, and the lookup
    of the smallest name is dealt over ``lanes``, so a text that repeats in most
    rows is not one task's work.
    """
    parts = []
    for kind, (name, group, text) in kinds().items():
        raw = F.col(text).cast("binary")
        parts.append(spark.read.parquet(f"{source}/{kind}.parquet").select(F.lit(kind).alias("kind"), F.coalesce(name, F.lit("")).alias("name"), group.alias("grp"), F.octet_length(raw).cast("long").alias("n_bytes"), F.sha2(raw, 256).alias("sha256")))
    rows = reduce(DataFrame.unionByName, parts)
    rows = rows.groupBy("kind", "name", "grp", "n_bytes", "sha256").agg(F.count("*").alias("n_rows"))
    first = rows.filter("sha256 is not null").groupBy("kind", "sha256").agg(F.min("name").alias("first"), F.count("*").alias("n"))
    first = first.filter("n > 1").select("kind", "sha256", "first", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))).alias("lane"))
    digits = lambda n: F.conv(F.substring(F.sha2(F.col("name").cast("binary"), 256), n, 8), 16, 10).cast("long")
    dealt = rows.withColumns({"lane": (digits(9) % lanes).cast("int"), "shelf": (digits(1) % shelves).cast("int")})
    out = dealt.join(first, ["kind", "sha256", "lane"], "left")
    return out.select("name", "grp", "n_bytes", "sha256", "n_rows", F.when(F.col("first") < F.col("name"), F.col("first")).alias("copy_of"), "kind", "shelf")


def signed(rows: DataFrame) -> DataFrame:
    """(kind, shelf, n_assets, n_bytes, signature): over every column of every row, whatever their order."""
    facts = F.to_json(F.struct("grp", "sha256", "n_rows", "copy_of"))
    sized = rows.select("kind", "shelf", "name", F.coalesce("n_bytes", F.lit(0)).alias("n_bytes"), facts.alias("facts"))
    return provenance.tree_signature(sized, ["kind", "shelf"], "name", "n_bytes", "facts").withColumnRenamed("n_files", "n_assets")


def ledger(spark: SparkSession, output: str) -> DataFrame:
    """The assets of the shelves that are signed."""
    rows, marks = spark.read.schema(ASSET).parquet(f"{output}/assets"), spark.read.schema(SHELF).parquet(f"{output}/shelves")
    return rows.join(marks.filter("n_assets > 0").select("kind", "shelf", "signature"), ["kind", "shelf"])


def run(spark: SparkSession, source: str, output: str, *, config: dict | None = None) -> dict:
    """Bring the ledger up to date; returns and logs what was read and written."""
    c = settings(__file__, config)
    rows = assets(spark, source, shelves=c["shelves"], lanes=c["lanes"])
    now = {(r["kind"], r["shelf"]): r.asDict() for r in signed(rows).collect()}  # a row a kind and shelf
    old = {}
    marks, store = store_of(spark, f"{output}/shelves")
    if store.exists(marks):
        old = {(r["kind"], r["shelf"]): r.asDict() for r in spark.read.schema(SHELF).parquet(f"{output}/shelves").collect()}
    gone = [{**old[k], "n_assets": 0, "n_bytes": 0, "signature": ""} for k in sorted(set(old) - set(now)) if old[k]["n_assets"]]
    changed = [now[k] for k in sorted(now) if old.get(k, {}).get("signature") != now[k]["signature"]]
    done = {"assets": sum(x["n_assets"] for x in now.values()), "bytes": sum(x["n_bytes"] for x in now.values()), "shelves": len(now), "written": len(changed), "gone": len(gone)}
    log.info("read %d assets of %d bytes on %d shelves from %s", done["assets"], done["bytes"], done["shelves"], source)
    put = lambda df, name: df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("kind", "shelf").parquet(f"{output}/{name}")
    if changed:
        due = spark.createDataFrame([(x["kind"], x["shelf"]) for x in changed], "kind string, shelf int")
        # a shelf's rows meet before they are written; one of many rows is split
        put(rows.join(F.broadcast(due), ["kind", "shelf"]).hint("rebalance", "kind", "shelf"), "assets")
    if changed or gone:
        put(spark.createDataFrame([tuple(x[n.split()[0]] for n in SHELF.split(", ")) for x in (*changed, *gone)], SHELF).coalesce(1), "shelves")
    log.info("wrote %d shelves to %s/assets, left %d alone, %d are gone", len(changed), output, len(now) - len(changed), len(gone))
    return done


if __name__ == "__main__":
    main(run, ["input", "output"], "text_ledger")
