"""Near-duplicate documents by HyperMinHash.

A document is its set of word shingles.  Documents of equal sets form a class
first (a 128-bit hash of the sorted set), and only classes are compared, so
copies are never expanded into pairs.  Per class:

1. A HyperMinHash sketch: 128 buckets, each register the leading-zero count of
   the smallest hash in the bucket plus 10 mantissa bits.
2. Bands of 4 compressed registers (empty ones are filled from others by a
   fixed random order) give 32 keys; at similarity 0.8 two sets share none of
   them with a probability of 5e-8.
3. In each band's group every class is paired with the group's smallest class.
   A pair goes on unless its collision-corrected Jaccard estimate is
   ``SIGMAS`` standard errors below the threshold.
4. What is left is verified on the full shingle sets, and the verified links
   give components.
5. In groups of three and more that are then not in one component, every class
   is also paired with the smallest of a few random parts of its group, where
   that one is in another component.  What is still open is finished exactly on
   the full sets, by rare-first prefixes with length and position bounds, which
   can miss no link: classes that meet at a shingle of at most ``LIGHT``
   prefixes are paired and verified; the others (families of sets that are
   alike throughout) are dealt into cells of bounded size, and each pair of
   cells is compared by matrix products that hand on a spanning forest of its
   links and no pairs.

So no group is expanded into its pairs, no candidate list is capped, and a link
that is not checked joins what is connected already.

Hot groups: classes come from map-side aggregation; joins are on class or
shingle keys and left to AQE's skew splitting; texts and sets are moved only
for classes that have candidates.

Defined cases: null, empty and blank texts have no shingles, link with nothing
and stand for themselves; a text of fewer words than a shingle is one shingle;
rows with a null id link like any other but never lend their component an id:
one of null ids alone has a null ``component_id`` and all its rows are
``kept``.  ``deduplicate`` keeps one row of each component, whatever its id;
rows without shingles all stay.  An id that occurs with several texts is judged
text by text.  An empty table gives an empty result; extra columns are left
alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.components import components
from gridloom.llm.tables import free_name, materialise, release, ship, written
from gridloom.llm.wordhash import SPACED, chunks, hash_words, mix64, windows

SHINGLE = 5
#: Similarity in hundredths: link if 100 * intersection >= THRESHOLD * union.
THRESHOLD = 80
REGISTERS, INDEX_BITS, MANTISSA_BITS = 128, 7, 10
BAND = 4
SIGMAS = 5.0
#: A shingle of more prefixes than this is compared in cells of about so many shingles (a set counts for ``LEAST`` at least).
LIGHT, CELL, LEAST = 64, 1 << 18, 512
#: Sets and shingles of one matrix product.
SIDE, WIDE = 256, 8192
#: At most this many dropped rows (an id and 8 bytes each) are broadcast; beyond that the documents are shuffled to them.
BROADCAST_DROPPED = 2_000_000
#: Random divisions of an open group, and parts of each.
SEEDS, PARTS = 4, 8
_VALUE_BITS = 64 - INDEX_BITS
_FILL = np.random.default_rng(20240601).integers(0, REGISTERS, size=(64, REGISTERS))


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """The sorted distinct shingle hashes of one text."""
    return np.unique(windows(words, size))


def registers(smallest: np.ndarray) -> np.ndarray:
    """16-bit registers from each bucket's smallest hash plus one (0: the bucket is empty)."""
    value = np.maximum(smallest, np.uint64(1)) - np.uint64(1)
    bits = np.frexp(value.astype(np.float64))[1].astype(np.int64)
    shift = bits - (MANTISSA_BITS + 1)
    up, down = np.maximum(-shift, 0).astype(np.uint64), np.maximum(shift, 0).astype(np.uint64)
    mantissa = ((value << up) >> down) & np.uint64((1 << MANTISSA_BITS) - 1)
    zeros = (_VALUE_BITS - np.minimum(bits, _VALUE_BITS)).astype(np.uint64) + np.uint64(1)
    return np.where(smallest > 0, (zeros << np.uint64(MANTISSA_BITS)) | mantissa, np.uint64(0)).astype(np.uint16)


def band_keys(regs: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of each row of registers, none of the rows being all empty."""
    full, rows = regs.copy(), np.arange(len(regs))[:, None]
    for order in _FILL:
        if not (empty := full == 0).any():
            break
        full = np.where(empty, regs[rows, order[None, :]], full)
    if (empty := full == 0).any():
        first = (regs != 0).argmax(1)
        full = np.where(empty, regs[np.arange(len(regs)), first][:, None], full)
    parts = full.reshape(len(regs), -1, BAND).astype(np.uint64)
    key = np.broadcast_to(np.arange(parts.shape[1], dtype=np.uint64) + np.uint64(1), parts.shape[:2]).copy()
    for k in range(BAND):
        key = mix64((key << np.uint64(16)) ^ (key >> np.uint64(48)) ^ parts[:, :, k])
    return key.view(np.int64)


def jaccard(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(collision-corrected estimate, its number of used buckets) for rows of registers."""
    used = (a != 0) | (b != 0)
    n = np.maximum(used.sum(1), 1)
    equal = ((a == b) & used).sum(1)
    za, zb = a >> MANTISSA_BITS, b >> MANTISSA_BITS
    chance = np.zeros(len(a))
    for z in range(1, 24):  # registers of unrelated sets agree if their zeros and then their mantissas do
        chance += (za == z).mean(1) * (zb == z).mean(1)
    expected = n * chance / (1 << MANTISSA_BITS)
    return np.clip((equal - expected) / np.maximum(n - expected, 1), 0, 1), n


def _sketches(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, raw, offsets in chunks(batch.column(1)):
                words, first = hash_words(raw, offsets, SPACED)
                docs = len(offsets) - 1
                smallest = np.zeros((docs, REGISTERS), np.uint64)
                n, cls = np.zeros(docs, np.int64), []
                for k in range(docs):
                    s = shingles(words[first[k] : first[k + 1]], size)
                    n[k] = len(s)
                    cls.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                    if len(s):
                        bucket = (s >> np.uint64(_VALUE_BITS)).astype(np.int64)
                        at = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
                        smallest[k, bucket[at]] = (s[at] & np.uint64((1 << _VALUE_BITS) - 1)) + np.uint64(1)
                regs = registers(smallest)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(row, docs), batch.column(2).slice(row, docs), pa.array(n), pa.array(cls, pa.binary()), pa.array([r.tobytes() for r in regs], pa.binary())],
                    names=["id", "key", "n", "cls", "regs"],
                )

    return run


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, raw, offsets in chunks(batch.column(0)):
                words, first = hash_words(raw, offsets, SPACED)
                sets = [shingles(words[first[k] : first[k + 1]], size) for k in range(len(offsets) - 1)]
                ends = np.cumsum([0] + [len(s) for s in sets])
                values = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                        pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values)),
                    ],
                    names=["cls", "set"],
                )

    return run


def _registers_of(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint16).reshape(-1, REGISTERS)


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            keys = band_keys(_registers_of(batch.column(1)))
            nodes = np.repeat(batch.column(0).to_numpy(), keys.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1)), pa.array(nodes)], names=["band", "node"])


def _near(threshold: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                estimate, n = jaccard(_registers_of(batch.column("ra")), _registers_of(batch.column("rb")))
                t = threshold / 100
                keep = estimate >= t - SIGMAS * np.sqrt(t * (1 - t) / n)
                yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(keep)) for c in ("a", "b")], names=["a", "b"])

    return run


def _verified(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """The pairs whose full sets are similar enough."""
    left = sets.select(F.col("node").alias("a"), F.col("set").alias("sa"))
    right = sets.select(F.col("node").alias("b"), F.col("set").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    return pairs.join(left, "a").join(right, "b").filter(100 * both >= threshold * (F.size("sa") + F.size("sb") - both)).select("a", "b")


def _part_pairs(left: DataFrame) -> DataFrame:
    """Each class with the smallest of its part of the group, for a few random divisions into parts."""
    seeded = left.withColumn("seed", F.explode(F.sequence(F.lit(1), F.lit(SEEDS))))
    seeded = seeded.withColumn("part", F.pmod(F.xxhash64("seed", "band", "node"), F.lit(PARTS)))
    leads = seeded.groupBy("band", "seed", "part").agg(F.min("node").alias("lead"))
    leads = leads.join(left.select(F.col("node").alias("lead"), F.col("label").alias("lead_label")).distinct(), "lead")
    pairs = seeded.join(leads, ["band", "seed", "part"]).filter("label <> lead_label")
    return pairs.select(F.col("lead").alias("a"), F.col("node").alias("b")).distinct()


def _rest_links(left: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """Links between different components that join what can be joined; it misses no such link."""
    labels = left.select("node", "label").distinct()
    sets = sets.join(labels.select("node"), "node")
    posted = materialise(_prefixes(sets, labels, threshold), "prefixes")
    met = posted.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.min("node").alias("lead"), F.count("*").alias("held")).filter("lo <> hi")
    met = materialise(met.select("token", "lead", "held"), "prefix-tokens")
    light = _verified(materialise(_light_pairs(posted.join(met.filter(F.col("held") <= LIGHT).select("token"), "token"), threshold), "light-pairs"), sets, threshold)
    hot = met.filter(F.col("held") > LIGHT).select("token", "lead")
    if hot.isEmpty():
        return light
    families = components(posted.join(hot, "token").select(F.col("lead").alias("a"), F.col("node").alias("b")).distinct())
    return light.union(_family_links(families.select("node", F.col("label").alias("family")), labels, sets, threshold))


def _prefixes(sets: DataFrame, labels: DataFrame, threshold: int) -> DataFrame:
    """(node, n, at, token, label): the rarest shingles of every set, so many that two sets which link have one in common.

    With t = threshold / 100 a pair needs an overlap of t / (1 + t) * (n1 + n2).
    Shingles are ordered by how many of the sets hold them, rare ones first;
    n - overlap + 1 of them hold a common one.
    """
    tokens = sets.select("node", F.size("set").alias("n"), F.explode("set").alias("token"))
    often = tokens.groupBy("token").agg(F.count("*").alias("df"))
    ranked = tokens.join(often, "token").groupBy("node", "n").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("order"))
    length = F.col("n") - F.ceil(F.lit(threshold) * F.col("n") / 100).cast("int") + 1
    prefix = ranked.select("node", "n", F.posexplode(F.slice("order", F.lit(1), length)).alias("at", "x"))
    return prefix.select("node", "n", "at", F.col("x.token").alias("token")).join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))


def _light_pairs(posted: DataFrame, threshold: int) -> DataFrame:
    """Pairs of different components that meet at a token and may be similar; a token gives each of its sets ``LIGHT`` partners at most.

    A common shingle at places p1 and p2 which is the first common one leaves at most min(n1 - p1, n2 - p2).
    """
    t, x, y = threshold, posted.alias("x"), posted.alias("y")
    on = (
        (F.col("x.token") == F.col("y.token"))
        & (F.col("x.label") != F.col("y.label"))
        & (F.struct("x.n", "x.node") < F.struct("y.n", "y.node"))
        & (100 * F.col("x.n") >= t * F.col("y.n"))
        & ((100 + t) * F.least(F.col("x.n") - F.col("x.at"), F.col("y.n") - F.col("y.at")) >= t * (F.col("x.n") + F.col("y.n")))
    )
    return x.join(y, on).select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()


def _family_links(families: DataFrame, labels: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """Links between different components inside families, a spanning forest of each pair of cells."""
    step = float(np.log(100 / threshold) * 1.01)  # sets that link are in one or in neighbouring classes of length
    placed = families.join(labels, "node").join(sets, "node").withColumn("n", F.size("set"))
    placed = placed.withColumn("len", F.floor(F.log("n") / step).cast("int"))
    parts = placed.groupBy("family", "len").agg(F.ceil(F.sum(F.greatest("n", F.lit(LEAST))) / CELL).cast("int").alias("parts"))
    parts = materialise(parts, "family-cells", small=True)
    beside = lambda k: parts.select("family", (F.col("len") - k).alias("len"), F.col("parts").alias(f"parts{k + 1}"))
    for k in (-1, 0, 1):
        placed = placed.join(beside(k), ["family", "len"], "left")
    placed = placed.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts1")).cast("int"))
    at, part = F.col("len"), F.col("part")
    cell = lambda low, p, high, q, side: F.struct(low.alias("low"), p.alias("p"), high.alias("high"), q.alias("q"), side.alias("side"))
    over = lambda n, f: F.when(F.col(n).isNull(), F.array()).otherwise(F.transform(F.sequence(F.lit(0), F.coalesce(n, F.lit(1)) - 1), f))
    cells = F.concat(
        over("parts1", lambda q: cell(at, F.least(part, q), at, F.greatest(part, q), (part > q).cast("int"))),
        over("parts2", lambda q: cell(at, part, at + 1, q, F.lit(0))),
        over("parts0", lambda q: cell(at - 1, q, at, part, F.lit(1))),
    )
    dealt = placed.select("family", "node", "label", "set", F.explode(cells).alias("c")).select("family", "node", "label", "set", "c.*")
    return dealt.groupBy("family", "low", "p", "high", "q").applyInArrow(_cell_links(threshold), "a bigint, b bigint")


def _cell_links(threshold: int):
    def run(key: tuple, cell: pa.Table) -> pa.Table:
        _, low, p, high, q = (k.as_py() for k in key)
        side = cell.column("side").to_numpy()
        sets = cell.column("set").combine_chunks()
        offsets, values = sets.offsets.to_numpy(), sets.values.to_numpy()
        own, other = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        if (low, p) == (high, q):
            other = own
        a, b = spanning_links(offsets, values, own, other, cell.column("label").to_numpy(), threshold)
        nodes = cell.column("node").to_numpy()
        return pa.table({"a": pa.array(nodes[a], pa.int64()), "b": pa.array(nodes[b], pa.int64())})

    return run


def spanning_links(offsets: np.ndarray, values: np.ndarray, own: np.ndarray, other: np.ndarray, labels: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between sets of the two sides that join different labels, without those that join what earlier ones do.

    Set k holds ``values[offsets[k] : offsets[k + 1]]``; overlaps are counted
    by products of 0/1 matrices of ``SIDE`` sets and ``WIDE`` shingles.
    """
    size = np.diff(offsets)
    _, token, held = np.unique(values[offsets[0] : offsets[-1]], return_inverse=True, return_counts=True)
    number = np.where(held > 1, np.cumsum(held > 1) - 1, -1)  # a shingle of one set is in no overlap
    token, owner = number[token], np.repeat(np.arange(len(size)), size)
    owner, token = owner[token >= 0], token[token >= 0]
    begin = np.searchsorted(owner, np.arange(len(size) + 1))
    root = {int(x): int(x) for x in np.unique(labels)}

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    found: list[tuple[int, int]] = []
    for i in range(0, len(own), SIDE):
        left = own[i : i + SIDE]
        for j in range(i if other is own else 0, len(other), SIDE):
            right = other[j : j + SIDE]
            both = np.zeros((len(left), len(right)), np.float32)
            sides = []
            for rows in (left, right):
                entries = np.concatenate([np.arange(begin[k], begin[k + 1]) for k in rows]) if len(rows) else np.zeros(0, np.int64)
                row, col = np.repeat(np.arange(len(rows)), begin[rows + 1] - begin[rows]), token[entries]
                order = np.argsort(col, kind="stable")
                sides.append((row[order], col[order]))
            for at in range(0, int((held > 1).sum()), WIDE):
                dense = []
                for rows, (row, col) in zip((left, right), sides, strict=True):
                    lo, hi = np.searchsorted(col, [at, at + WIDE])
                    m = np.zeros((len(rows), WIDE), np.float32)
                    m[row[lo:hi], col[lo:hi] - at] = 1
                    dense.append(m)
                both += dense[0] @ dense[1].T
            union = size[left][:, None] + size[right][None, :] - both
            linked = (100 * both >= threshold * union) & (labels[left][:, None] != labels[right][None, :])
            for x, y in np.argwhere(linked):
                u, v = find(int(labels[left[x]])), find(int(labels[right[y]]))
                if u != v:
                    root[u] = v
                    found.append((int(left[x]), int(right[y])))
    pairs = np.array(found, np.int64).reshape(-1, 2)
    return pairs[:, 0], pairs[:, 1]


def _grouped(docs: DataFrame, id_col: str, text_col: str, shingle: int, threshold: int) -> DataFrame:
    """One row a document: id, key (a hash of the text), n_shingles, component_id, label (of the component; null without shingles)."""
    ship(docs.sparkSession)
    mark = written()
    ids = docs.schema[id_col].dataType
    base = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")).withColumn("key", F.xxhash64("text"))
    kind = ids.simpleString()
    seen = materialise(base.mapInArrow(_sketches(shingle), f"id {kind}, key bigint, n bigint, cls binary, regs binary"), "sketches")
    classes = materialise(
        seen.filter("n > 0").groupBy("cls").agg(F.min("id").alias("first_id"), F.first("n").alias("n"), F.first("regs").alias("regs"))
        .withColumn("node", F.monotonically_increasing_id()),
        "classes"
    )
    bands = classes.select("node", "regs").mapInArrow(_bands, "band bigint, node bigint")
    groups = materialise(
        bands.groupBy("band").agg(F.min("node").alias("lead"), F.max("node").alias("last"), F.count("*").alias("size")).filter("size > 1"), "bands"
    )
    larger = groups.filter("size > 2").select("band", "lead")
    members = materialise(bands.join(larger, "band"), "members")
    pairs = (
        groups.filter("size = 2").select(F.col("lead").alias("a"), F.col("last").alias("b"))
        .union(members.filter("node <> lead").select(F.col("lead").alias("a"), F.col("node").alias("b")))
        .distinct()
    )
    sketch = lambda c: classes.select(F.col("node").alias(c), F.col("n").alias(f"n{c}"), F.col("regs").alias(f"r{c}"))
    sized = pairs.join(sketch("a"), "a").join(sketch("b"), "b").filter(100 * F.least("na", "nb") >= threshold * F.greatest("na", "nb"))
    near = materialise(sized.select("a", "b", "ra", "rb").mapInArrow(_near(threshold), "a bigint, b bigint"), "near-pairs")
    wanted = near.select(F.col("a").alias("node")).union(near.select("b")).union(members.select("node")).distinct()
    wanted = wanted.join(classes.select("node", "cls", "first_id"), "node")
    first = wanted.select("first_id").distinct()
    texts = base.join(first, F.col("id").eqNullSafe(F.col("first_id")), "left_semi").select("text")
    sets = materialise(
        texts.mapInArrow(_sets(shingle), "cls binary, set array<bigint>").join(wanted.select("cls", "node"), "cls").select("node", "set").dropDuplicates(["node"]),
        "shingle-sets"
    )
    edges = materialise(_verified(near, sets, threshold), "near-links")
    labels = components(edges)
    for further in (lambda left: _verified(materialise(_part_pairs(left), "more-pairs", small=True), sets, threshold), lambda left: _rest_links(left, sets, threshold)):
        parts = members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        open_bands = parts.groupBy("band").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi").select("band")
        left = materialise(parts.join(open_bands, "band").select("band", "node", "label"), "open-groups", small=True)
        if left.isEmpty():
            break
        more = materialise(further(left), "more-links", small=True)
        if not more.isEmpty():
            edges = materialise(edges.union(more), "near-links")
            labels = components(edges)
    named = labels.join(classes.select("node", "first_id"), "node")
    roots = named.groupBy("label").agg(F.min("first_id").alias("root"))
    rooted = named.join(roots, "label").select("node", "label", "root")
    of_class = classes.select("cls", "node", "first_id").join(rooted, "node", "left")
    of_class = of_class.select("cls", F.coalesce("root", "first_id").alias("root"), F.coalesce("label", "node").alias("label"))
    out = seen.select("id", "key", "n", "cls").join(of_class, "cls", "left")
    return release(out.select("id", "key", F.col("n").alias("n_shingles"), F.coalesce("root", "id").alias("component_id"), "label"), mark)


def group(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, threshold: int = THRESHOLD) -> DataFrame:
    """One row a document: id, n_shingles, component_id, kept."""
    out = _grouped(docs, id_col, text_col, shingle, threshold)
    return out.select("id", "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def deduplicate(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, threshold: int = THRESHOLD) -> DataFrame:
    """One document of each component (the smallest id, null last; then by text) and all without shingles; columns as they were."""
    mark = written()
    found = _grouped(docs, id_col, text_col, shingle, threshold).filter("label is not null")
    rows = materialise(found.groupBy("label", "id", "key").agg(F.count("*").alias("n")), "dedup-rows")
    keep = rows.groupBy("label").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key")).alias("keep"))
    stays = F.col("id").eqNullSafe(F.col("keep.id")) & (F.col("key") == F.col("keep.key"))
    names = free_name(docs, "its_id"), free_name(docs, "its_key")
    judged = rows.join(keep, "label").select(F.col("id").alias(names[0]), F.col("key").alias(names[1]), stays.alias("stays"), "n")
    on = F.col(f"`{id_col}`").eqNullSafe(F.col(names[0])) & (F.xxhash64(F.col(f"`{text_col}`").cast("string")) == F.col(names[1]))
    dropped = materialise(judged.filter("not stays").select(*names), "dropped", small=True)
    if dropped.count() <= BROADCAST_DROPPED:
        dropped = F.broadcast(dropped)
    out = docs.join(dropped, on, "left_anti")
    repeated = materialise(judged.filter("stays and n > 1").select(*names), "repeated", small=True)
    if not repeated.isEmpty():
        out = out.join(repeated, on, "left_anti").unionByName(out.join(repeated, on, "left_semi").dropDuplicates([id_col, text_col]))
    return release(out, mark)
