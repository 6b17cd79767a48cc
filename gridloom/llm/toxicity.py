"""Toxicity by class-conditional Kneser-Ney models.

A text is its words, a word its bytes with a begin and an end.  For every run
of ``ORDER`` bytes within words, the toxic and the ordinary training texts'
different words that hold it are counted, over all texts (a word that a text
repeats is one sign of what the text is).  Each class predicts
a byte from the ones before it by its own counts, discounted by counts of
counts, and backs off to counts that both classes share: those of the same run
in both classes together, then Kneser-Ney continuation counts of shorter runs
(in how many different bytes' company they were seen; runs at a word's begin
keep their counts).  The shared prediction also weighs ``SHARED`` sightings
of every context, so a few sightings by chance make no class.  So a rare
expression is worth what its bytes' company in the two classes is worth, and
what neither class knows leans to neither.  Runs are exact (packed into integers, not
hashed), none is dropped, and their number grows with the corpus.

A text's score compares log-likelihoods normalised by length (in words): over
the whole text, over its most toxic stretch of any ``STRETCH`` neighbouring
words, over its ``TOP`` most toxic stretches that share no word, and over the
whole text if a share ``MIXED`` of its words is toxic and the rest ordinary
(over the square root of its words, by which chance grows); a logistic
calibration weighs the four, none of them below 0.

Where a run is unknown to both classes, the shared probability cancels out, so
a model is one number for each known run and each known context.  Up to
``BROADCAST`` of them (12 bytes each) are broadcast; beyond that, texts are
dealt into blocks of about ``BLOCK`` bytes, each block asks for the entries of
its own runs, and the model answers in slices of about ``SLICE`` entries.  Both
ways give the same scores.  Counts are summed per task before the shuffle, so
hot sources and copies need no care.

The calibration is fitted on at most ``CALIBRATION`` labelled texts, each
scored under a model of the half of the training rows that it is not in; each class may fill
half of these, and a text counts for as many as its class had for each one
drawn.  The final model counts both halves.  Everything else covers all rows.

Defined cases: null and empty texts score as a text with a ratio of 1; without
labels of both classes every score is the toxic share (0 if there are none); an
id labelled twice takes its higher label; a word of more than ``CHUNK`` bytes
is read as several, and longer texts in pieces cut between words; ids are only
passed on, so repeated rows are fine; extra columns are left alone.
"""

from __future__ import annotations

import hashlib
import pickle
import zlib
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.llm.labels import labelled, logistic, rates
from gridloom.llm.tables import materialise, release, ship, written
from gridloom.llm.wordhash import LETTERS, chunks, mix64

#: Bytes of a run, the last of which is predicted from the others; what stands for a word's begin and end.
ORDER, BEGIN, END = 5, 1, 2
#: Discount where it cannot be estimated.
DISCOUNT = 0.75
#: What the shared prediction weighs in every context of a class, in sightings.
SHARED = 100.0
#: Share of toxic words in the text that the mixed ratio supposes, and the ratio beyond which a word is toxic anyhow.
MIXED, SURE = 0.005, 50.0
#: Words of a stretch, and how many stretches speak for a text.
STRETCH = 3
TOP = 3
CALIBRATION = 20_000
THRESHOLD = 0.7
#: A text's half (0 or 1) and class (0 or 1) as one index.
PARTS = 4
FEATURES = ("ratio", "stretch_ratio", "top_ratio", "mixed_ratio")
#: Bytes of text that are read at once, and counted rows that a task holds before it hands them on.
CHUNK, HELD = 1_000_000, 1_500_000
#: Entries of a model that is broadcast, bytes of text in a block, entries of a slice.
BROADCAST, BLOCK, SLICE = 4_000_000, 8 << 20, 2_000_000
#: Tells the keys of runs from those of contexts.
RUN = 1 << (8 * ORDER)
_SCORED = "score double, " + ", ".join(f"{c} double" for c in FEATURES)
_FOLDED = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)


@dataclass
class Words:
    """Words of some texts: the text of each, where its runs begin (with the total at the end), and all runs."""

    doc: np.ndarray
    first: np.ndarray
    runs: np.ndarray


def read_words(raw: np.ndarray, offsets: np.ndarray) -> Words:
    """The runs of every word: one for each byte and one for the end."""
    inside = LETTERS[0][raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    begin = np.flatnonzero(inside & (edge[:-1] | ~np.r_[False, inside[:-1]]))
    end = np.flatnonzero(inside & (edge[1:] | ~np.r_[inside[1:], False])) + 1
    size = end - begin + 1
    first = np.r_[0, np.cumsum(size)]
    symbols = np.full(int(first[-1]), END, np.int64)
    is_end = np.zeros(len(symbols), bool)
    is_end[first[1:] - 1] = True
    symbols[~is_end] = _FOLDED[raw[inside]]
    place = np.arange(len(symbols)) - np.repeat(first[:-1], size)
    runs = symbols.copy()
    for k in range(1, ORDER):
        before = np.full(len(symbols), BEGIN, np.int64)
        before[k:] = np.where(place[k:] >= k, symbols[:-k], BEGIN)
        runs |= before << (8 * k)
    return Words(np.searchsorted(offsets, begin, "right") - 1, first, runs)


def _pieces(texts: pa.Array) -> Iterator[tuple[int, int, bool, Words]]:
    """(first row, rows, whether the last row goes on, words) of runs of texts; a long text comes in several pieces."""
    for row, raw, offsets in chunks(texts):
        if len(raw) <= 2 * CHUNK:
            yield row, len(offsets) - 1, False, read_words(raw, offsets)
            continue
        at = 0
        while at < len(raw):
            end = min(at + CHUNK, len(raw))
            if end < len(raw):
                gaps = np.flatnonzero(~LETTERS[0][raw[at:end]])
                end = at + int(gaps[-1]) + 1 if len(gaps) else end
            yield row, 1, end < len(raw), read_words(raw[at:end], np.array([0, end - at]))
            at = end


def _tally(w: Words, parts: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(runs, counts by part, hashes of the words): each text's different words count once; ``seen`` are the last text's from pieces before."""
    if not len(w.doc):
        return np.zeros(0, np.int64), np.zeros((0, PARTS), np.int32), seen
    size = np.diff(w.first)
    place = (np.arange(len(w.runs)) - np.repeat(w.first[:-1], size)).astype(np.uint64)
    words = mix64(np.add.reduceat(mix64(w.runs.astype(np.uint64) ^ (place << np.uint64(48))), w.first[:-1]))
    own, at = np.unique(mix64(words + w.doc.astype(np.uint64)), return_index=True)
    if len(seen):
        fresh = ~np.isin(own, seen)
        own, at = own[fresh], at[fresh]
    chosen = np.zeros(len(w.doc), bool)
    chosen[at] = True
    key = w.runs[np.repeat(chosen, size)] * PARTS + np.repeat(parts[w.doc[chosen]], size[chosen])
    key, n = np.unique(key, return_counts=True)
    runs, of = np.unique(key // PARTS, return_inverse=True)
    counts = np.zeros((len(runs), PARTS), np.int32)
    counts[of, key % PARTS] = n
    return runs, counts, own


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray]] = []
    for batch in batches:
        parts, seen = batch.column(0).to_numpy(), np.zeros(0, np.uint64)
        for row, _, more, w in _pieces(batch.column(1)):
            runs, counts, own = _tally(w, parts[row:].astype(np.int64), seen)
            seen = np.union1d(seen, own) if more else np.zeros(0, np.uint64)
            held.append((runs, counts))
            if sum(len(h[0]) for h in held) > HELD:
                held = [_merged(held)]
                if len(held[0][0]) > HELD // 2:
                    yield from _rows(*held.pop())
    if held:
        yield from _rows(*_merged(held))


def _merged(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    runs, n = (np.concatenate(x) for x in zip(*held, strict=True))
    order = np.argsort(runs, kind="stable")
    runs, n = runs[order], n[order]
    start = np.flatnonzero(np.r_[True, runs[1:] != runs[:-1]]) if len(runs) else np.zeros(0, np.int64)
    return runs[start], (np.add.reduceat(n, start, axis=0, dtype=np.int32) if len(start) else n)


def _rows(runs: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(runs), 1 << 16):
        part = slice(at, at + (1 << 16))
        yield pa.RecordBatch.from_arrays([pa.array(runs[part]), *(pa.array(np.ascontiguousarray(n[part, k])) for k in range(PARTS))], names=["run", *(f"n{k}" for k in range(PARTS))])


@dataclass
class Model:
    """Sorted keys and their log-likelihood ratios if it is small, else ``None`` and a table of (key, value)."""

    known: np.ndarray | None
    values: np.ndarray | None
    calibration: np.ndarray
    entries: int
    table: DataFrame | None = None


def pack(model: Model) -> bytes:
    """A small model for broadcasting."""
    return zlib.compress(pickle.dumps((model.known, model.values, model.calibration)), 1)


def unpack(packed: bytes) -> Model:
    """The last model unpacked stays with the worker for its next tasks."""
    key = hashlib.blake2b(packed, digest_size=16).digest()
    if key not in _unpacked:
        known, values, calibration = pickle.loads(zlib.decompress(packed))
        _unpacked.clear()
        _unpacked[key] = Model(known, values, calibration, len(known))
    return _unpacked[key]


_unpacked: dict[bytes, Model] = {}


def _keys(runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The model's keys of runs and of their contexts."""
    return mix64((runs | RUN).astype(np.uint64)), mix64((runs >> 8).astype(np.uint64))


def _find(m: Model, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(whether known, its value) of each key."""
    if not len(m.known):
        return np.zeros(len(keys), bool), np.zeros(len(keys))
    at = np.minimum(np.searchsorted(m.known, keys), len(m.known) - 1)
    found = m.known[at] == keys
    return found, np.where(found, m.values[at], 0.0)


def _ratios(m: Model, w: Words) -> np.ndarray:
    """Log-likelihood ratio of each word."""
    if not len(w.doc):
        return np.zeros(0)
    runs, of = np.unique(w.runs, return_inverse=True)
    own, context = _keys(runs)
    found, value = _find(m, own)
    value[~found] = _find(m, context[~found])[1]
    return np.add.reduceat(value[of], w.first[:-1])


def _features(ratio: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The FEATURES of each text: log-likelihood ratios of all words, of the most toxic stretch, of the TOP most toxic ones, and of a mixed text."""
    out, size = np.zeros((len(first) - 1, len(FEATURES))), np.diff(first)
    some = size > 0
    if some.any():
        begin = first[:-1][some]
        out[some, 0] = np.add.reduceat(ratio, begin) / size[some]
        out[:, 1:3] = _stretches(ratio, first)
        mixed = np.log1p(MIXED * np.expm1(np.minimum(ratio, SURE)))
        out[some, 3] = np.add.reduceat(mixed, begin) / np.sqrt(size[some])
    return out


def _stretches(ratio: np.ndarray, first: np.ndarray) -> np.ndarray:
    """(ratio of the most toxic stretch, mean ratio of the TOP most toxic ones that share no word) of each text.

    Every ``STRETCH`` neighbouring words are a stretch; a shorter text is one.
    """
    out = np.zeros((len(first) - 1, 2))
    some = np.flatnonzero(np.diff(first) > 0)
    if not len(some):
        return out
    begin, size = first[:-1][some], np.diff(first)[some]
    owner = np.repeat(np.arange(len(some)), size)
    left = np.repeat(begin + size, size) - np.arange(len(ratio))  # words from here to the text's end
    stretch = ratio.astype(np.float64)
    for k in range(1, STRETCH):
        stretch[:-k] += np.where(left[:-k] > k, ratio[k:], 0.0)
    stretch[(left < STRETCH) & (np.arange(len(ratio)) > begin[owner])] = -np.inf
    for k in range(TOP):
        best = np.maximum.reduceat(stretch, begin)
        found = np.isfinite(best)
        if k == 0:
            out[some, 0] = best / STRETCH
        out[some, 1] += np.where(found, best, 0.0) / (STRETCH * TOP)
        at = np.flatnonzero((stretch == best[owner]) & found[owner])
        text, where = np.unique(owner[at], return_index=True)
        for move in range(1 - STRETCH, STRETCH):
            taken = at[where] + move
            stretch[taken[(taken >= begin[text]) & (taken < begin[text] + size[text])]] = -np.inf
    return out


def _rated(m: Model, ids: pa.Array, texts: pa.Array) -> Iterator[pa.RecordBatch]:
    held: list[np.ndarray] = []
    for row, rows, more, w in _pieces(texts):
        ratio = _ratios(m, w)
        if more or held:  # a long text
            held.append(ratio)
            if more:
                continue
            ratio, held = np.concatenate(held), []
            first = np.array([0, len(ratio)])
        else:
            first = np.searchsorted(w.doc, np.arange(rows + 1))
        f = _features(ratio, first)
        z = f @ m.calibration[:-1] + m.calibration[-1]
        score = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        yield pa.RecordBatch.from_arrays([ids.slice(row, rows), pa.array(score), *(pa.array(f[:, k]) for k in range(len(FEATURES)))], names=["id", "score", *FEATURES])


def _scores(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = unpack(model.value)
        for batch in batches:
            yield from _rated(m, batch.column(0), batch.column(1))

    return run


def _slice_of(keys: np.ndarray, slices: int) -> np.ndarray:
    """Ascending with the keys."""
    return (((keys >> np.uint64(32)) * np.uint64(slices)) >> np.uint64(32)).astype(np.int32)


def _squeeze(values: np.ndarray) -> bytes:
    """Compressed byte by byte of equal rank: (rows, numbers) or (rows,)."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1).T
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def _unsqueeze(packed: bytes, rows: int, dtype: type, columns: int = 1) -> np.ndarray:
    width = np.dtype(dtype).itemsize * columns
    raw = np.frombuffer(pa.decompress(packed, rows * width, codec="zstd"), np.uint8)
    return np.ascontiguousarray(raw.reshape(width, rows).T).view(dtype).reshape((rows, columns) if columns > 1 else rows)


def _wanted(texts: pa.Array) -> np.ndarray:
    """All keys of the runs and contexts of a block, in order."""
    runs = [np.unique(w.runs) for _, _, _, w in _pieces(texts)]
    return np.unique(np.concatenate(_keys(np.unique(np.concatenate(runs))))) if runs else np.zeros(0, np.uint64)


def _table(columns: dict) -> pa.Table:
    return pa.table({k: pa.array(v, t) for k, (v, t) in columns.items()})


def _asks(slices: int):
    def run(key, block):
        keys = _wanted(block.column("text"))
        of = _slice_of(keys, slices)
        start = np.flatnonzero(np.r_[True, of[1:] != of[:-1]]) if len(of) else np.zeros(0, np.int64)
        parts = [keys[a:b] for a, b in zip(start, np.r_[start[1:], len(keys)], strict=True)] if len(of) else []
        steps = [_squeeze(np.diff(p, prepend=np.uint64(0))) for p in parts]
        return _table({"slice": (of[start], pa.int32()), "block": ([key[0].as_py()] * len(parts), pa.int32()), "size": ([len(p) for p in parts], pa.int32()), "keys": (steps, pa.binary())})

    return run


def _answers(key, asked, entries):
    """For each block that asks: which of its keys are known, and their values."""
    known = entries.column("key").to_numpy().view(np.uint64)
    order = np.argsort(known)
    m = Model(known[order], entries.column("value").to_numpy()[order], np.zeros(0), len(known))
    found, numbers, sizes = [], [], []
    for size, steps in zip(asked.column("size").to_pylist(), asked.column("keys"), strict=True):
        keys = np.cumsum(_unsqueeze(steps.as_buffer(), size, np.uint64), dtype=np.uint64)
        is_known, values = _find(m, keys)
        found.append(np.packbits(is_known).tobytes())
        numbers.append(_squeeze(values[is_known].astype(np.float32)) if is_known.any() else b"")
        sizes.append(size)
    return _table({"slice": ([key[0].as_py()] * len(sizes), pa.int32()), "block": (asked.column("block").to_pylist(), pa.int32()), "size": (sizes, pa.int32()), "found": (found, pa.binary()), "numbers": (numbers, pa.binary())})


def _block_scores(calibration: np.ndarray):
    def run(block, answers):
        keys = _wanted(block.column("text"))
        found, values = [], []
        for row in sorted(answers.to_pylist(), key=lambda r: r["slice"]):
            found.append(np.unpackbits(np.frombuffer(row["found"], np.uint8))[: row["size"]].astype(bool))
            if found[-1].any():
                values.append(_unsqueeze(row["numbers"], int(found[-1].sum()), np.float32))
        known = keys[np.concatenate(found)] if found else keys[:0]
        m = Model(known, np.concatenate(values) if values else np.zeros(0, np.float32), calibration, len(known))
        return pa.Table.from_batches(list(_rated(m, block.column("id").combine_chunks(), block.column("text"))))

    return run


def _keyed(slices: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = mix64(batch.column(0).to_numpy().astype(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(_slice_of(keys, slices)), pa.array(keys.view(np.int64)), batch.column(1)], names=["slice", "key", "value"])

    return run


_ENTRIES = "slice int, key bigint, value float"


def _small(model: Model) -> Model:
    """With its entries at the driver if they are few."""
    if model.known is not None or model.entries > BROADCAST:
        return model
    got = model.table.mapInArrow(_keyed(1), _ENTRIES).select("key", "value").toArrow()
    keys, values = got.column("key").to_numpy().view(np.uint64), got.column("value").to_numpy()
    del got
    pa.default_memory_pool().release_unused()
    order = np.argsort(keys)
    return Model(keys[order], values[order], model.calibration, model.entries)


def _apply(base: DataFrame, model: Model, sent: list | None = None) -> DataFrame:
    """(id, score, FEATURES) of rows (id, text); ``sent`` gets what was broadcast."""
    schema = f"id {base.schema['id'].dataType.simpleString()}, {_SCORED}"
    if model.known is not None:
        shared = base.sparkSession.sparkContext.broadcast(pack(model))
        if sent is not None:
            sent.append(shared)
        return base.mapInArrow(_scores(shared), schema)
    size = base.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    slices = model.entries // SLICE + 1
    dealt = base.withColumn("block", F.pmod(F.xxhash64(F.col("id").cast("string"), "text"), F.lit(size // BLOCK + 1)).cast("int"))
    asked = dealt.groupBy("block").applyInArrow(_asks(slices), "slice int, block int, size int, keys binary")
    entries = model.table.mapInArrow(_keyed(slices), _ENTRIES)
    answers = asked.groupBy("slice").cogroup(entries.groupBy("slice")).applyInArrow(_answers, "slice int, block int, size int, found binary, numbers binary")
    return dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_block_scores(model.calibration), schema)


def _discounts(once: int, twice: int, thrice: int, four: int) -> tuple[float, float, float]:
    """What a count of one, two, and three or more gives up, by how many items have counts of one to four.

    Chen and Goodman's estimates; where such counts are missing, ``DISCOUNT``.
    A count always keeps something.
    """
    if not (once and twice):
        return DISCOUNT, DISCOUNT, DISCOUNT
    d = once / (once + 2 * twice)
    two = 2 - 3 * d * thrice / twice if thrice else d
    three = 3 - 4 * d * four / thrice if thrice and four else two
    return min(d, 0.95), min(max(two, 0.05), 1.95), min(max(three, 0.05), 2.95)


def _kept(n: Column, discounts: tuple[float, float, float]) -> Column:
    return F.when(n >= 3, n - discounts[2]).when(n == 2, 2 - discounts[1]).when(n == 1, 1 - discounts[0]).otherwise(0.0)


def _tails(rows: DataFrame, size: int, n: Column) -> DataFrame:
    """(run, n): the shared counts of the last ``size`` bytes of runs of one more.

    How many different bytes stand before them; at a word's begin, where only the begin can, their own count.
    """
    second = F.shiftright("run", 8 * (size - 1)).bitwiseAND(F.lit(255))
    tail = F.col("run").bitwiseAND(F.lit((1 << 8 * size) - 1))
    return rows.groupBy(tail.alias("run")).agg(F.sum(F.when(second == BEGIN, n).otherwise(1)).cast("long").alias("n"))


def _told(n: Column, name: str) -> list[Column]:
    """How many counts of one, two, three and four there are."""
    return [F.count_if(n == k).alias(f"{name}{k}") for k in (1, 2, 3, 4)]


def _fit(counts: DataFrame, columns: tuple[Column, Column], calibration: np.ndarray) -> Model:
    """Kneser-Ney models of the two classes by their columns of counts."""
    rows = counts.select("run", *(c.alias(f"c{k}") for k, c in enumerate(columns))).filter("c0 + c1 > 0")
    levels, n = {}, F.col("c0") + F.col("c1")
    tails = rows
    for size in range(ORDER - 1, 0, -1):
        tails = _tails(tails, size, n)
        levels[size], n = tails, F.col("n")
    shared = None
    for size, level in levels.items():
        part = level.withColumn("size", F.lit(size))
        shared = part if shared is None else shared.unionByName(part)
    shared = materialise(shared, "toxic-shared", small=True)
    off = {r["size"]: _discounts(*(r[f"n{k}"] for k in (1, 2, 3, 4))) for r in shared.groupBy("size").agg(*_told(F.col("n"), "n")).collect()}
    told = rows.agg(*_told(F.col("c0"), "a"), *_told(F.col("c1"), "b"), *_told(F.col("c0") + F.col("c1"), "p")).first()
    if not off:
        return Model(np.zeros(0, np.uint64), np.zeros(0, np.float32), calibration, 0)
    *own, both = [_discounts(*(told[f"{x}{k}"] for k in (1, 2, 3, 4))) for x in "abp"]
    after = Window.partitionBy(F.shiftright("run", 8))  # the runs of one context, 256 of them at most
    tail = lambda size: F.col("run").bitwiseAND(F.lit((1 << 8 * size) - 1))
    lower = None
    for size in range(1, ORDER):
        kept, n = _kept(F.col("n"), off[size]), F.col("n")
        level = shared.filter(F.col("size") == size).select("run", kept.alias("kept"), F.sum(n).over(after).alias("total"), F.sum(n - kept).over(after).alias("freed"))
        if lower is None:
            level = level.withColumn("q", F.lit(1 / 256))
        else:
            level = level.withColumn("tail", tail(size - 1)).join(lower, "tail")
        lower = level.select(F.col("run").alias("tail"), ((F.col("kept") + F.col("freed") * F.col("q")) / F.col("total")).alias("q"))
    n = F.col("c0") + F.col("c1")
    kept = _kept(n, both)
    top = rows.withColumns({"kept": kept, "total": F.sum(n).over(after), "freed": F.sum(n - kept).over(after), "tail": tail(ORDER - 1)}).join(lower, "tail")
    top, share = top.withColumn("q", (F.col("kept") + F.col("freed") * F.col("q")) / F.col("total")), []
    for k in range(2):
        kept, n = _kept(F.col(f"c{k}"), own[k]), F.col(f"c{k}")
        top = top.withColumns({f"k{k}": kept, f"t{k}": F.sum(n).over(after), f"f{k}": F.sum(n - kept).over(after)})
        total = F.col(f"t{k}")
        # a class that does not know the context takes the shared probability as it is
        weight = total + F.lit(SHARED)
        top = top.withColumns({f"g{k}": F.when(total > 0, (F.col(f"f{k}") + SHARED) / weight).otherwise(1.0), f"x{k}": F.when(total > 0, F.col(f"k{k}") / weight).otherwise(0.0)})
        share.append(F.col(f"x{k}") + F.col(f"g{k}") * F.col("q"))
    context = top.groupBy(F.shiftright("run", 8).alias("key")).agg(F.first(F.log(F.col("g1") / F.col("g0"))).cast("float").alias("value"))
    table = top.select((F.col("run") + RUN).alias("key"), F.log(share[1] / share[0]).cast("float").alias("value")).unionByName(context)
    table = materialise(table, "toxic-model", small=True)
    return _small(Model(None, None, calibration, table.count(), table))


@contextmanager
def _no_leftovers(spark: SparkSession) -> Iterator[None]:
    """What is run inside gives its shuffle files back when it ends."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before) if before is not None else spark.conf.unset(name)


def _calibrated(x: np.ndarray, toxic: np.ndarray, weight: np.ndarray | None = None) -> np.ndarray:
    """Weights of the ratios and a bias; one that would count toxic company against toxicity is 0."""
    use = list(range(x.shape[1]))
    while True:
        w = logistic(x[:, use], toxic, weight=weight)
        if not use or w[:-1].min() >= 0:
            break
        use.pop(int(w[:-1].argmin()))
    out = np.zeros(x.shape[1] + 1)
    out[[*use, -1]] = w
    return out


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """One pass over all labelled rows; the counts stay in a table unless the model is small."""
    ship(docs.sparkSession)
    mark = written()
    rows, n_labels = labelled(docs, labels, label_col=label_col, id_col=id_col, text_col=text_col)
    half = F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(2)).cast("int")
    rows = rows.select("id", (half * 2 + (F.col("label") > 0).cast("int")).alias("part"), "text")
    n = [F.col(f"n{k}") for k in range(PARTS)]
    counts = rows.select("part", "text").mapInArrow(_counts, "run bigint, " + ", ".join(f"n{k} int" for k in range(PARTS)))
    with _no_leftovers(docs.sparkSession):
        counts = materialise(counts.groupBy("run").agg(*(F.sum(c).alias(f"n{k}") for k, c in enumerate(n))), "toxic-counts", small=True)
        # calibrate on each half under a model of the other one
        none, share = np.zeros(len(FEATURES) + 1), {}
        sample, label = rows, F.col("part") % 2
        if n_labels > CALIBRATION:
            share = rates({r["label"]: r["count"] for r in rows.groupBy(label.alias("label")).count().collect()}, CALIBRATION)
            drawn = F.pmod(F.xxhash64(F.lit("calibrate"), F.col("id").cast("string")), F.lit(1 << 20))
            sample = rows.filter(drawn < F.when(label == 1, int(share.get(1, 1.0) * (1 << 20))).otherwise(int(share.get(0, 1.0) * (1 << 20))))
        got, sent = [], []
        for theirs, mine in (((n[0], n[1]), F.col("part") >= 2), ((n[2], n[3]), F.col("part") < 2)):
            got.append(_apply(sample.filter(mine).select(label.alias("id"), "text"), _fit(counts, theirs, none), sent).select("id", *FEATURES).toArrow())
            while sent:  # a half's model is not needed any more
                sent.pop().destroy()
        got = pa.concat_tables(got)
        model = _fit(counts, (n[0] + n[2], n[1] + n[3]), none)
    toxic = got.column("id").to_numpy() == 1
    if 0 < toxic.sum() < len(toxic):
        x = np.column_stack([got.column(c).to_numpy() for c in FEATURES])
        model.calibration = _calibrated(x, toxic, np.where(toxic, 1 / share.get(1, 1.0), 1 / share.get(0, 1.0)))
    else:
        toxic_share = rows.agg(F.avg((F.col("part") % 2).cast("double"))).first()[0] or 0.0
        model.calibration = np.r_[np.zeros(len(FEATURES)), np.log((toxic_share + 1e-9) / (1 - toxic_share + 1e-9))]
    release(model.table if model.known is None else None, mark)
    return model


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: id, score, the FEATURES, predicted."""
    ship(docs.sparkSession)
    base = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return _apply(base, model).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
