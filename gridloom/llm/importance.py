"""Importance resampling towards a target distribution of hashed n-grams.

Features are all runs of 1 to ``MAX_RUN`` consecutive words; each falls into
the bucket that the CRC-32 of its bytes names.  Bucket counts of the corpus and
of the target give every bucket a gain, a log-ratio of smoothed shares in
thousandths; a document's weight is the sum of its features' gains, and its
score adds Gumbel noise seeded by its id, so that the highest scores are a
weighted draw without replacement.  DataFrame functions only.

Per feature nothing leaves the task: bucket counts and document sums are
combined before the shuffle, which then moves a row a bucket and task and a row
a document.  The gain table has one row a bucket (``BUCKETS``), which bounds its
broadcast.  Ranks come from a range-partitioned sort with one offset a
partition; rows of one score and id may still be split, by their row number.

Defined cases: null texts have no words and no features; a document without
features has weight 0 and is never drawn while ``least_words`` is above 0; null
ids hash like an empty string and come last among ties, repeated rows are
scored and ranked one by one; an empty target gives every document the gain of
the smoothing alone, an empty corpus an empty result; other columns are left
alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.tables import free_name, materialise, release, written

BUCKETS = 10_000
MAX_RUN = 3
#: Per cent of the eligible documents that are drawn, and the fewest words of an eligible one.
PERCENT = 5
LEAST_WORDS = 20
SEED = "42"
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: monotonically_increasing_id keeps the place within a partition in so many low bits.
PLACE_BITS = 33


def _folded(text: Column) -> Column:
    """The text with A-Z in lower case and nothing else changed.

    ``lower`` does that, and faster, for a text whose other letters it would leave alone.
    """
    others = F.regexp_replace(text, r"[\x00-\x7F]++", "")
    return F.when(F.lower(others) == others, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words(text: Column) -> Column:
    """Runs of ASCII digits and letters (in lower case) and of non-ASCII characters."""
    return F.array_remove(F.split(_folded(F.coalesce(text, F.lit(""))), BREAK, -1), "")


def features(rows: DataFrame, keep: list[str], buckets: int = BUCKETS) -> DataFrame:
    """(keep..., bucket): one row a feature of the word array ``w``, and rows with a null bucket that count for nothing."""
    ahead = {f"w{k}": F.slice("w", k + 1, F.greatest(F.size("w"), F.lit(1))) for k in range(1, MAX_RUN)}
    wide = rows.select(*keep, F.col("w").alias("w0"), *(a.alias(n) for n, a in ahead.items()))
    runs = wide.select(*keep, F.explode_outer(F.arrays_zip(*(f"w{k}" for k in range(MAX_RUN)))).alias("at"))
    run = F.col("at.w0")
    found = [run]
    for k in range(1, MAX_RUN):
        run = F.concat(run, F.lit(" "), F.col(f"at.w{k}"))  # null where the text ends before
        found.append(run)
    bucket = lambda x: F.pmod(F.crc32(x.cast("binary")), F.lit(buckets)).cast("int")
    return runs.select(*keep, F.explode(F.array(*(bucket(x) for x in found))).alias("bucket"))


def gains(docs: DataFrame, target: DataFrame, *, text_col: str = "text", target_text_col: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """(bucket, s, t, gain) of all buckets: counts in the corpus and the target, and the gain in thousandths of a nat."""
    spark = docs.sparkSession
    of = lambda df, col, mark: features(df.select(words(F.col(f"`{col}`").cast("string")).alias("w")), [], buckets).select("bucket", F.lit(mark).alias("mark"))
    both = of(docs, text_col, 0).unionByName(of(target, target_text_col, 1)).filter("bucket is not null")
    counted = materialise(both.groupBy("bucket").agg(F.count_if(F.col("mark") == 0).alias("s"), F.count_if(F.col("mark") == 1).alias("t")), "gain-counts", small=True)
    total = counted.agg(F.coalesce(F.sum("s"), F.lit(0)), F.coalesce(F.sum("t"), F.lit(0))).first()
    every = spark.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(F.broadcast(counted), "bucket", "left").fillna(0, ["s", "t"])
    double = lambda x: x.cast("double")
    ratio = (double(F.col("t") + 1) * F.lit(float(total[0] + buckets))) / (double(F.col("s") + 1) * F.lit(float(total[1] + buckets)))
    return every.withColumn("gain", F.floor(1000 * F.log(ratio)))


def noise(doc_id: Column, seed: str = SEED) -> Column:
    """Gumbel noise in thousandths, from the SHA-256 of the seed and the id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def _scored(docs: DataFrame, target: DataFrame, id_col: str, text_col: str, row_col: str, seed: str, buckets: int, **options) -> DataFrame:
    """(row, id, n_words, n_features, weight, score), one row a document."""
    table = gains(docs, target, text_col=text_col, buckets=buckets, **options)
    rows = docs.select(F.col(row_col).alias("row"), F.col(f"`{id_col}`").alias("id"), words(F.col(f"`{text_col}`").cast("string")).alias("w"))
    each = features(rows.withColumn("n_words", F.size("w").cast("long")), ["row", "id", "n_words"], buckets)
    summed = each.join(F.broadcast(table.select("bucket", "gain")), "bucket", "left").groupBy("row", "id", "n_words")
    weighed = summed.agg(F.count("bucket").alias("n_features"), F.coalesce(F.sum("gain"), F.lit(0)).alias("weight"))
    return weighed.withColumn("score", F.col("weight") + noise(F.col("id"), seed))


def _ranked(docs: DataFrame, target: DataFrame, row_col: str, *, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: str = SEED, buckets: int = BUCKETS, **options) -> DataFrame:
    spark = docs.sparkSession
    scored = materialise(_scored(docs, target, id_col, text_col, row_col, seed, buckets, **options), "resample-scores")
    eligible = F.col("n_words") >= least_words
    drawn = percent * scored.filter(eligible).count() // 100
    order = [eligible.desc(), F.col("score").desc(), F.col("id").asc_nulls_last(), F.col("row").asc()]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    place = F.monotonically_increasing_id()
    placed = materialise(scored.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("place", place), "resample-places")
    part = F.shiftright("place", PLACE_BITS)
    sizes = placed.groupBy(part.alias("part")).agg(F.count("*").alias("n"))  # a row a partition
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    rank = F.col("before") + F.col("place").bitwiseAND(F.lit((1 << PLACE_BITS) - 1)) + 1
    out = placed.withColumn("part", part).join(F.broadcast(before), "part")
    return out.select("row", "id", "n_words", "n_features", "weight", "score", F.when(eligible & (rank <= drawn), rank).alias("rank"))


def resample(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """One row a document: id, n_words, n_features, weight, score and rank (1 is the highest score drawn; null: not drawn).

    Of the N documents with at least ``least_words`` words, the
    floor(percent * N / 100) highest scores are drawn, ties to the smaller id.
    """
    mark, row = written(), free_name(docs, "row")
    numbered = docs.withColumn(row, F.monotonically_increasing_id())
    return release(_ranked(numbered, target, row, **options).drop("row"), mark)


def draw(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The drawn documents with all their columns and ``rank``.

    The documents are numbered in a table of their own first, so that rows
    which repeat an id can be told apart.
    """
    mark, row, rank = written(), free_name(docs, "row"), free_name(docs, "rank")
    numbered = materialise(docs.withColumn(row, F.monotonically_increasing_id()), "resample-documents")
    ranked = _ranked(numbered, target, row, **options).filter("rank is not null").select(F.col("row").alias(row), F.col("rank").alias(rank))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return release(numbered.join(ranked, row).select(*columns, rank), mark)
