"""Benchmark decontamination by a hash set of normalised test n-grams.

Every item gives windows of ``n`` consecutive words (an item of fewer words is
one window); their hashes are broadcast while there are at most
``BROADCAST_WINDOWS`` of them, beyond that the join is by shuffle.  Documents'
windows are scanned against the set, hits are verified on the words
themselves, and the words inside verified hits are counted, masked as spans or
lead to the document's removal.  DataFrame functions only.

Rows that share id and text are repeated rows: they are scanned like any
other, their hits are merged before the verification, and each of them gets
its own row of results.

Defined cases: null and empty texts have no words and no hits; an empty
benchmark hits nothing; items without words or with a null text give no
windows, and null item ids hit but are not listed; repeated items count once;
extra columns are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.expressions import let, upto
from gridloom.llm.tables import free_name, materialise, release, written

N = 13
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: At most this many distinct windows (24 bytes each) are broadcast.
BROADCAST_WINDOWS = 1_000_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(text: Column) -> Column:
    """Runs of digits, letters and non-ASCII characters of a text that is lower case already."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BREAK, -1), "")


def _exact(text: Column) -> Column:
    return _words(F.translate(text, UPPER, LOWER))


def _window_hashes(w: Column, n: int) -> Column:
    """The hashes of all windows of n words, in order."""

    def of(h: Column) -> Column:
        return F.transform(upto(F.size(h) - (n - 1)), lambda i: F.xxhash64(F.lit(n), *(F.get(h, i + k) for k in range(n))))

    return let(F.transform(w, lambda x: F.xxhash64(x)), of)


def benchmark_windows(bench: DataFrame, n: int, item_col: str, text_col: str) -> DataFrame:
    """(item, len, hash, window): distinct windows of every item; ``window`` is its words joined by spaces."""
    items = bench.select(F.col(item_col).cast("string").alias("item"), _exact(F.col(text_col)).alias("w")).filter(F.size("w") > 0)
    sized = items.withColumn("len", F.least(F.lit(n), F.size("w")))
    places = sized.select("item", "len", "w", F.explode(upto(F.size("w") - F.col("len") + 1)).alias("at"))
    cut = places.select("item", "len", F.array_join(F.slice("w", F.col("at") + 1, F.col("len")), " ").alias("window"))
    split = F.split("window", " ", -1)
    by_len = F.lit(None).cast("long")
    for k in range(1, n + 1):
        by_len = F.when(F.col("len") == k, F.get(_window_hashes(split, k), F.lit(0))).otherwise(by_len)
    return cut.select("item", "len", "window", by_len.alias("hash")).distinct()


def hits(docs: DataFrame, bench: DataFrame, *, n: int = N, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", bench_text_col: str = "text") -> DataFrame:
    """(id, key, at, len, item): verified occurrences of windows; ``key`` is a hash of the text, ``at`` the first word."""
    known = materialise(benchmark_windows(bench, n, item_col, bench_text_col), "bench-windows", small=True)
    lengths = sorted(r["len"] for r in known.select("len").distinct().collect())  # n of them at most
    hashes = known.select("hash").distinct()
    if hashes.count() <= BROADCAST_WINDOWS:
        hashes = F.broadcast(hashes)
    base = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("key"), F.col(text_col).alias("text"))
    by_len = lambda w: F.array(*(F.struct(F.lit(k).alias("len"), _window_hashes(w, k).alias("h")) for k in lengths))
    if not lengths:
        by_len = lambda w: F.expr("array()").cast("array<struct<len:int,h:array<bigint>>>")
    scanned = base.select("id", "key", F.explode(let(_exact(F.col("text")), by_len)).alias("x"))
    seen = scanned.select("id", "key", F.col("x.len").alias("len"), F.posexplode("x.h").alias("at", "hash"))
    found = seen.join(hashes, "hash").select("id", "key", "len", "at").distinct()
    found = materialise(
        found.groupBy("id", "key").agg(F.sort_array(F.collect_list(F.struct("at", "len"))).alias("places")), "bench-found", small=True
    )
    texts = base.join(found.select(F.col("id").alias("i"), F.col("key").alias("k"), "places"), F.col("id").eqNullSafe(F.col("i")) & (F.col("key") == F.col("k")))
    cut = let(_exact(F.col("text")), lambda w: F.transform("places", lambda p: F.struct(p["at"].alias("at"), p["len"].alias("len"), F.array_join(F.slice(w, p["at"] + 1, p["len"]), " ").alias("window"))))
    windows = texts.select("id", "key", F.explode(cut).alias("p")).select("id", "key", "p.*").distinct()
    return windows.join(known.select("window", "item").distinct(), "window").select("id", "key", "at", "len", "item").distinct()


def hit_documents(found: DataFrame) -> DataFrame:
    """(id, key, spans, n_hit, items): merged word spans [from, to) of each document that is hit."""
    grouped = found.groupBy("id", "key").agg(F.collect_set(F.struct("at", "len")).alias("places"), F.sort_array(F.collect_set("item")).alias("items"))
    covered = F.sort_array(F.array_distinct(F.flatten(F.transform("places", lambda p: F.sequence(p["at"], p["at"] + p["len"] - 1)))))

    def edges(c: Column) -> Column:
        begins = F.filter(c, lambda x, i: (i == 0) | (F.get(c, i - 1) != x - 1))
        ends = F.filter(c, lambda x, i: (i == F.size(c) - 1) | (F.get(c, i + 1) != x + 1))
        return F.struct(F.zip_with(begins, ends, lambda a, b: F.struct(a.alias("from"), (b + 1).alias("to"))).alias("spans"), F.size(c).cast("long").alias("n_hit"))

    return grouped.select("id", "key", let(covered, edges).alias("merged"), "items").select("id", "key", "merged.spans", "items", "merged.n_hit")


def scan(docs: DataFrame, bench: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row a document: id, n_words, n_hit, items, spans, contaminated."""
    hit = hit_documents(hits(docs, bench, id_col=id_col, text_col=text_col, **options))
    hit = hit.select(F.col("id").alias("i"), F.col("key").alias("k"), "spans", "items", "n_hit")
    own = docs.select(
        F.col(id_col).alias("id"),
        F.xxhash64(F.col(text_col)).alias("key"),
        F.size(_exact(F.col(text_col))).cast("long").alias("n_words"),
    )
    joined = own.join(hit, F.col("id").eqNullSafe(F.col("i")) & (F.col("key") == F.col("k")), "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return joined.select(
        "id", "key", "n_words", n_hit.alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        F.coalesce("spans", F.expr("cast(array() as array<struct<from:int,to:int>>)")).alias("spans"),
        is_contaminated(n_hit, F.col("n_words")).alias("contaminated"),
    )


def is_contaminated(n_hit: Column, n_words: Column) -> Column:
    return (n_hit > 0) & (20 * n_hit >= n_words)


def _of_row(docs: DataFrame, id_col: str, text_col: str, names: tuple[str, str]) -> Column:
    """Whether a row of ``docs`` has the id and text that the columns ``names`` tell."""
    return F.col(f"`{id_col}`").eqNullSafe(F.col(names[0])) & (F.xxhash64(F.col(f"`{text_col}`")) == F.col(names[1]))


def remove_documents(docs: DataFrame, bench: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents without the contaminated ones, all columns as they were."""
    mark = written()
    bad = scan(docs, bench, id_col=id_col, text_col=text_col, **options).filter("contaminated")
    names = free_name(docs, "bad_id"), free_name(docs, "bad_key")
    bad = materialise(bad.select(F.col("id").alias(names[0]), F.col("key").alias(names[1])).distinct(), "bench-bad", small=True)
    return release(docs.join(bad, _of_row(docs, id_col, text_col, names), "left_anti"), mark)


def remove_spans(docs: DataFrame, bench: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents with the hit words taken out of ``text_col``; what separates the words stays."""
    hit = hit_documents(hits(docs, bench, id_col=id_col, text_col=text_col, **options))
    names = free_name(docs, "hit_id"), free_name(docs, "hit_key")
    spans = free_name(docs, "hit_spans")
    joined = docs.join(hit.select(F.col("id").alias(names[0]), F.col("key").alias(names[1]), F.col("spans").alias(spans)), _of_row(docs, id_col, text_col, names), "left")
    text, s = F.col(f"`{text_col}`"), F.col(spans)
    word = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"  # before A-Z are folded
    parts = F.struct(F.split(text, word, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(word), F.lit(0)).alias("words"))

    def joined_up(p: Column) -> Column:
        """Stretch by stretch: what lies before a span as it was, of the span what separates its words."""
        gaps, w = p["gaps"], p["words"]
        both = F.zip_with(gaps, w, lambda g, x: F.concat(g, F.coalesce(x, F.lit(""))))

        def stretch(b: Column, i: Column) -> Column:
            begin = F.when(i > 0, F.get(s, i - 1)["to"]).otherwise(0)
            end = F.coalesce(F.get(s, i)["from"], F.size(gaps))
            until = F.coalesce(F.get(s, i)["to"], F.size(gaps))
            return F.concat(F.array_join(F.slice(b, begin + 1, end - begin), ""), F.array_join(F.slice(gaps, end + 1, until - end), ""))

        return let(both, lambda b: F.array_join(F.transform(F.sequence(F.lit(0), F.size(s)), lambda i: stretch(b, i)), ""))

    cleaned = F.when(s.isNull(), text).otherwise(let(parts, joined_up))
    return joined.select(*(cleaned.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns))
