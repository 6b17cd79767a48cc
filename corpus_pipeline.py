"""The corpus pipeline: five stages over ``documents``, each a Parquet table of what the next one reads.

1. language: drops documents without a recognisable language (``und``) or of
   which less than half of the letters are in one language;
2. near_duplicates: keeps one document of each group (five words a shingle,
   similarity 0.8);
3. decontaminate: drops documents contaminated with ``benchmark`` passages;
4. mix: repeats or drops documents to meet the sources' target weights;
5. shard: places every row in a shard and slot.

All stages but the last return the columns of ``documents``.  A stage reads
its whole input and its decision is what the next stage sees.

Defined cases: an empty table passes through as an empty table; null ids and
repeated rows are each stage's own (see the operators); extra columns ride
along.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import decontamination, language_id, mixing, near_dedup, sharding
from gridloom.cluster import delete
from gridloom.llm.tables import free_name, read, release, remember, shared_dir, written

#: Least share of a document's letters that must be in its main language.
LANGUAGE_SHARE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents with a main language; the model learns from the labelled rows of ``docs``."""
    model = language_id.train(docs)
    return language_id.select(docs, model, least=LANGUAGE_SHARE)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.deduplicate(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.remove_documents(docs, read(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(docs)
    return mixed.select(*(F.col(f"`{c}`") for c in docs.columns))


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    placed = sharding.shard(docs, keep=True)
    names = {c: free_name(docs, c) for c in ("size", "shard", "slot")}
    return placed.select("doc.*", *(F.col(c).alias(n) for c, n in names.items()))


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("mix", mix),
    ("shard", shard),
]

#: The language model and the sketches are beyond SQL; the tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again.

    A stage's table goes once the next one is written; the last one goes when the interpreter ends.
    """
    docs, before = read(spark, sf_dir, "documents"), None
    at = f"{shared_dir(spark)}/corpus-pipeline-{uuid.uuid4().hex}"
    remember(spark, at)
    for k, (name, stage) in enumerate(STAGES):
        out, mark = f"{at}/{k}-{name}", written()
        stage(spark, docs, sf_dir).write.parquet(out)
        release(None, mark)
        if before is not None:
            delete(spark, before)
        docs, before = spark.read.parquet(out), out
    return docs
