"""Mixing sources to target weights.

Tokens are aggregated per source, each source's target is a weighted share of
the total with at most ``max_repeats`` times its own size (the excess is
re-shared by weight until no source is above), and every document is emitted
``floor(rate)`` times plus one hash-seeded Bernoulli copy whose probability is
the fraction.  DataFrame functions only.

Hot sources: the totals are pre-aggregated on the map side, and the join that
brings the rates back is a broadcast only while the per-source table is at most
``BROADCAST_SOURCES`` rows; beyond that the documents are joined on
(source, salt) so that no source is held by one task.

Defined cases: null text has size 0; a null source is a source of its own and
comes last; sources of size 0 get target 0 and their documents no copies;
repeated rows are mixed one by one and share their coin, since the coin hashes
the id and the text; an empty table gives an empty plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.tables import free_name, materialise

WORD = r"[^\x20\x09-\x0D]+"
MAX_REPEATS = 3
WEIGHTS = (1, 2, 3)
SEED = "mix-1"
#: At most this many rows of (source, rate) are broadcast.
BROADCAST_SOURCES = 50_000
SALTS = 64
#: Source lists up to this long are ranked in one sort; longer ones are range-partitioned first.
RANK_PARTITIONS = 64


def word_count(text: Column) -> Column:
    """Words separated by ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def coin(*parts: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) from the MD5 of the seed and the parts: reruns agree."""
    text = F.concat_ws("|", F.lit(seed), *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("double") / F.lit(float(16**12))


def source_rates(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """(source, source_size, weight, target) from rows of (source, size).

    Ranking is by range-partitioned sort with one offset a partition, so the
    list of sources is never in one task.  The water level falls to a fixed
    point: each pass is one aggregation of which the driver sees four numbers.
    """
    spark = sizes.sparkSession
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranged = materialise(
        per.repartitionByRange(RANK_PARTITIONS, F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()),
        "mix-sources", small=True
    )
    counts = {r["part"]: r["n"] for r in ranged.groupBy("part").agg(F.count("*").alias("n")).collect()}  # one row a partition
    at, offsets = 0, []
    for part in sorted(counts):
        offsets.append((part, at))
        at += counts[part]
    if not offsets:
        return per.withColumns({"weight": F.lit(0).cast("long"), "target": F.lit(0.0)})
    begins = F.create_map(*(F.lit(x) for pair in offsets for x in pair))
    within = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last()))
    cycle = F.array(*(F.lit(w).cast("long") for w in weights))
    place = begins[F.col("part")] + within - 1
    per = materialise(
        ranged.withColumn("weight", F.get(cycle, (place % len(weights)).cast("int"))).drop("part"), "mix-ranked", small=True
    )
    total, all_weight = per.agg(F.sum("source_size"), F.sum("weight")).first()
    capped_size, capped_weight = 0, 0
    while True:
        # a source is capped where its share of what is left is above max_repeats times its size
        left, weight = total - max_repeats * capped_size, all_weight - capped_weight
        above = F.col("weight") * F.lit(left).cast("decimal(38,0)") > F.col("source_size") * F.lit(max_repeats * weight).cast("decimal(20,0)")
        size, w = per.filter(above).agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
        if w == capped_weight or w == all_weight:
            break
        capped_size, capped_weight = size, w
    share = F.col("weight").cast("double") * F.lit(float(left)) / F.lit(float(max(weight, 1)))
    cap = F.col("source_size").cast("double") * F.lit(float(max_repeats))
    return per.withColumn("target", F.when(above, cap).otherwise(F.least(share, cap)))


def plan_mix(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    max_repeats: int = MAX_REPEATS,
    seed: str = SEED,
    keep: bool = False,
) -> DataFrame:
    """One row a document: id, source, size, source_size, target, rate, copies.

    ``keep`` carries all of the documents' columns along (under ``doc``).
    """
    doc = [F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc")] if keep else []
    base = docs.select(
        F.col(id_col).alias("id"),
        F.col(source_col).alias("source"),
        word_count(F.col(text_col)).alias("size"),
        coin(F.col(id_col), F.md5(F.coalesce(F.col(text_col), F.lit(""))), seed=seed).alias("coin"),
        *doc,
    )
    if keep:
        slim = docs.select(F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"))
    else:
        base = slim = materialise(base, "mix-sizes")
    rates = source_rates(slim, weights, max_repeats)
    rates = rates.withColumn(
        "rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    )
    if rates.count() <= BROADCAST_SOURCES:
        right = F.broadcast(rates.withColumnRenamed("source", "of"))
        joined = base.join(right, F.col("source").eqNullSafe(F.col("of")), "left")
    else:
        right = rates.withColumnRenamed("source", "of").withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salted = base.withColumn("salt", F.pmod(F.xxhash64("id", "coin"), F.lit(SALTS)).cast("int"))
        joined = salted.join(right, F.col("source").eqNullSafe(F.col("of")) & (F.col("salt") == F.col("lane")), "left")
    copies = F.floor("rate") + (F.col("coin") < F.col("rate") - F.floor("rate")).cast("long")
    out = ["id", "source", "size", "source_size", "weight", "target", "rate", F.coalesce(copies, F.lit(0)).alias("copies")]
    return joined.select(*out, *(["doc"] if keep else []))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The documents as the mix takes them: each row ``copies`` times, with its columns and ``copy`` from 0."""
    copy = free_name(docs, "copy")
    plan = plan_mix(docs, keep=True, **options).filter("copies > 0")
    each = plan.withColumn("nth", F.explode(F.sequence(F.lit(0), (F.col("copies") - 1).cast("int"))))
    return each.select("doc.*", F.col("nth").alias(copy))
