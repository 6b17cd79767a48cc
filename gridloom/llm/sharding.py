"""Sharding by sampled splitters.

Records are ordered by a key (hash of the text, id, a tie-break), a
size-weighted sample of keys gives quantile splitters, records are
range-partitioned by them, and ranges that turn out overfull are subdivided by
the same means before anything needs a range in one task.  Exact sums per
range then place every record on one line of bytes, which is cut into shards
of near equal size.

Equal texts stay together.  Those that take more than ``LARGE`` of a shard
(a bounded number of groups) are placed first, greatest first, where there is
most room, and only what fits in no shard whole is subdivided by id.  The line
of all the rest is then cut where each shard is full, at the nearer edge of a
group of equal texts.

Defined cases: null text has size 0 plus 1; ids of any type order records of
one text (by number where they are numbers, else by a hash); records of equal id and text are
told apart by a tie-break and each gets a slot; with fewer records than shards
some shards stay empty; an empty table gives an empty result; extra columns
ride along untouched.
"""

from __future__ import annotations

import bisect

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.tables import materialise, release, written

SHARDS = 8
#: Ranges per shard, and expected sample keys per range: together they bound what the driver sees.
RANGES_PER_SHARD = 16
SAMPLES_PER_RANGE = 40
#: A range above this multiple of its due size is subdivided.
OVERFULL = 2.0
#: Share of a shard above which a group of equal texts is placed on its own, and by which a shard may then be overfull.
LARGE, SNAP = 0.01, 0.01
KEY = ["key_hash", "key_id", "key_tie"]


def _splitters(keyed: DataFrame, ranges: int, total: int) -> list[tuple]:
    """Quantile boundaries of a size-weighted sample; at most a few times ranges * SAMPLES_PER_RANGE keys are expected."""
    want = ranges * SAMPLES_PER_RANGE
    # a record of size s is drawn ceil(s * want / total) times at most, on average s * want / total times
    share = F.col("size") * F.lit(want / max(total, 1))
    draws = F.floor(share) + (F.rand(7) < share - F.floor(share)).cast("long")
    sample = keyed.withColumn("draws", draws).filter("draws > 0").select(*KEY, "draws").collect()
    keys = sorted((tuple(r[k] for k in KEY), r["draws"]) for r in sample)
    whole, seen, out = sum(n for _, n in keys), 0, []
    for key, n in keys:
        before, seen = seen, seen + n
        if before * ranges // max(whole, 1) != seen * ranges // max(whole, 1):
            out.append(key)
    return sorted(set(out))[: ranges - 1] if len(set(out)) >= ranges else sorted(set(out))


def _range_of(splitters: list[tuple]):
    """A pandas UDF: the number of splitters at or below a key."""
    columns = [np.array([s[i] for s in splitters], dtype=np.int64) for i in range(3)]

    @F.pandas_udf("int")
    def place(h: pd.Series, i: pd.Series, t: pd.Series) -> pd.Series:
        first = np.searchsorted(columns[0], h.to_numpy(), "left")
        last = np.searchsorted(columns[0], h.to_numpy(), "right")
        tied = np.flatnonzero(last > first)
        at = first.copy()
        if len(tied):
            rest = list(zip(columns[1].tolist(), columns[2].tolist(), strict=True))
            for k, a, b in zip(tied.tolist(), i.to_numpy()[tied].tolist(), t.to_numpy()[tied].tolist(), strict=True):
                at[k] = bisect.bisect_right(rest, (a, b), first[k], last[k])
        return pd.Series(at.astype(np.int32))

    return place


def _ranged(keyed: DataFrame, total: int, shards: int) -> tuple[DataFrame, list]:
    """Records with their range, and (range, bytes, rows) of each: overfull ranges get splitters of their own."""
    ranges = shards * RANGES_PER_SHARD
    splitters = _splitters(keyed, ranges, total)
    for _ in range(8):
        placed = keyed.withColumn("range", _range_of(splitters)(*KEY) if splitters else F.lit(0))
        sums = placed.groupBy("range").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).orderBy("range").collect()
        due = max(total / ranges, 1)
        over = [r for r in sums if r["bytes"] > OVERFULL * due and r["n"] > 1]
        if not over:
            break
        more = set(splitters)
        inside = placed.filter(F.col("range").isin([r["range"] for r in over]))
        more.update(_splitters(inside, 4 * sum(-(-r["bytes"] // int(due)) for r in over), sum(r["bytes"] for r in over)))
        if len(more) == len(splitters):
            break
        splitters = sorted(more)
    return placed, sums


def shard(
    docs: DataFrame,
    *,
    shards: int = SHARDS,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: bool = False,
) -> DataFrame:
    """One row a record: id, size, text_crc32, law, shard, slot, grown_shard (null), and ``doc`` if ``keep``."""
    mark = written()
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = materialise(
        docs.select(
            F.col(id_col).alias("id"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.xxhash64(text, F.crc32(text.cast("binary"))).alias("key_hash"),
            F.coalesce(F.col(id_col).cast("string").try_cast("long"), F.xxhash64(F.col(id_col).cast("string"))).alias("key_id"),
            F.monotonically_increasing_id().alias("key_tie"),
            *([F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc")] if keep else []),
        ),
        "shard-keys",
    )
    slim = keyed.select("size", *KEY)
    total = slim.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    groups = slim.groupBy("key_hash").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    large = groups.filter((F.col("bytes") > LARGE * total / shards) & (F.col("n") > 1)).collect()  # shards / LARGE at most
    pieces, load = _place(sorted((-r["bytes"], r["key_hash"]) for r in large), total / shards, shards)
    of_large = F.col("key_hash").isin([r["key_hash"] for r in large])
    line = _line(slim.filter(~of_large) if large else slim, shards, "shard-line")
    cuts = _cuts(line, load, total, shards)
    shard_of, first_row = F.lit(0), F.lit(0).cast("long")
    for k, cut in enumerate(cuts, 1):  # shards - 1 of them
        shard_of = F.when(F.col("row") >= cut, F.lit(k)).otherwise(shard_of)
        first_row = F.when(F.col("row") >= cut, F.lit(cut).cast("long")).otherwise(first_row)
    placed_line = line.select("key_tie", shard_of.cast("int").alias("shard"), (F.col("row") - first_row).alias("slot"))
    if large:
        rows = line.count()
        begins = [0, *cuts, rows]
        taken = {k: max(begins[k + 1] - begins[k], 0) for k in range(shards)}
        placed_line = placed_line.union(_pieces(_line(slim.filter(of_large), shards, "shard-groups"), pieces, taken))
    out = keyed.join(placed_line, "key_tie").select(
        "id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), *(["doc"] if keep else [])
    )
    return release(out, mark)


def _place(groups: list[tuple[int, int]], due: float, shards: int) -> tuple[list[tuple[int, int, int, int]], list[int]]:
    """((key, from, to, shard) pieces of the large groups, bytes by shard).

    Greatest first, each to the shard with the most room; only what does not
    fit there whole is subdivided.
    """
    load, pieces = [0] * shards, []
    for size, key in ((-minus, key) for minus, key in groups):
        at = 0
        while at < size:
            s = min(range(shards), key=lambda k: (load[k], k))
            room = int(due - load[s])
            take = size - at if size - at <= room * (1 + SNAP) or room < 1 else room
            pieces.append((key, at, at + take, s))
            load[s] += take
            at += take
    return pieces, load


def _line(keyed: DataFrame, shards: int, name: str) -> DataFrame:
    """(key_tie, key_hash, size, row, start): every record's place in key order, by rows and by bytes."""
    placed, sums = _ranged(keyed, keyed.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0], shards)
    rows_before, bytes_before, at, b = {}, {}, 0, 0
    for r in sums:
        rows_before[r["range"]], bytes_before[r["range"]] = at, b
        at, b = at + r["n"], b + r["bytes"]
    w = Window.partitionBy("range").orderBy(*KEY)

    def offset(table: dict):
        """Per-range offsets (a bounded list) as a map literal."""
        return F.create_map(*(F.lit(x) for pair in (table or {0: 0}).items() for x in pair))[F.col("range")]

    row = F.row_number().over(w) - 1 + offset(rows_before)
    start = F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size") + offset(bytes_before)
    return materialise(placed.withColumns({"row": row, "start": start}).select("key_tie", "key_hash", "size", F.col("row").cast("long"), F.col("start").cast("long")), name)


def _pieces(line: DataFrame, pieces: list[tuple[int, int, int, int]], taken: dict[int, int]) -> DataFrame:
    """(key_tie, shard, slot) of the large groups' records; their slots follow the ``taken`` ones of each shard.

    The pieces are as many as large groups and shards together at most, so they are broadcast.
    """
    spark = line.sparkSession
    low = {r["key_hash"]: r["low"] for r in line.groupBy("key_hash").agg(F.min("start").alias("low")).collect()}
    table = [(n, key, low[key] + a, low[key] + b, s) for n, (key, a, b, s) in enumerate(pieces)]
    cut = F.broadcast(spark.createDataFrame(table, "piece int, of_key long, a long, b long, shard int"))
    held = line.join(cut, (F.col("key_hash") == F.col("of_key")) & (F.col("start") >= F.col("a")) & (F.col("start") < F.col("b")))
    stats = {r["piece"]: (r["first"], r["n"]) for r in held.groupBy("piece").agg(F.min("row").alias("first"), F.count("*").alias("n")).collect()}
    base, moves = dict(taken), []
    for n, (_, _, _, s) in enumerate(pieces):
        if n in stats:
            moves.append((n, base[s] - stats[n][0]))
            base[s] += stats[n][1]
    shift = F.broadcast(spark.createDataFrame(moves, "piece int, shift long"))
    return held.join(shift, "piece").select("key_tie", "shard", (F.col("row") + F.col("shift")).alias("slot"))


def _cuts(line: DataFrame, load: list[int], total: int, shards: int) -> list[int]:
    """The first row of shards 1, 2, ... on the line of what is in no large group.

    Each shard gets the bytes that the large groups leave it; a cut inside a
    group of equal texts moves to the nearer edge of the group.
    """
    rest, rows = line.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    room = [max(total / shards - x, 0.0) for x in load]
    goals, seen = [], 0.0
    for k in range(shards - 1):
        seen += room[k]
        goals.append(int(rest * seen / max(sum(room), 1e-9)))
    holds = F.lit(False)
    for g in goals:
        holds |= (F.col("start") <= g) & (F.col("start") + F.col("size") > g)
    hit = line.filter(holds).collect()  # at most one record a cut
    groups = {
        r["key_hash"]: r
        for r in line.filter(F.col("key_hash").isin([r["key_hash"] for r in hit] or [0]))
        .groupBy("key_hash")
        .agg(F.min("start").alias("lo"), F.max(F.col("start") + F.col("size")).alias("hi"), F.min("row").alias("first"), F.max("row").alias("last"))
        .collect()
    }
    out = []
    for g in goals:
        r = next((r for r in hit if r["start"] <= g < r["start"] + r["size"]), None)
        if r is None:
            row = rows if g > 0 else 0
        else:
            group = groups[r["key_hash"]]
            row = min((abs(group["lo"] - g), group["first"]), (abs(group["hi"] - g), group["last"] + 1))[1]
        out.append(max(row, out[-1] if out else 0))
    return out
