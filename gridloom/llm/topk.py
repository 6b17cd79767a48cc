"""Exact top-k search by inner product: branch and bound over columns.

Components become integers, floor(``SCALE`` * x).  Every row has a number; the
rows are dealt by its hash into groups of candidates and of queries whose size
is bounded by ``CELLS`` numbers, and a task searches one group of candidates
for one group of queries (a stated query set against all rows, in blocks).
There the candidates lie column by column, heaviest columns first.  Inner
products are accumulated block of columns by block of columns; after each one
what the rest can add is bounded by the product of the remaining norms, and
candidates that cannot reach the query's floor are compacted away.  A query's
floor is the k-th best product with a sample of ``SEEDS`` rows at first, and
rises with what the task finds; floors only skip work, results are exact.  At
most k rows a query leave a task, so copies of one vector do not add up.

Defined cases: rows whose vector is null, or has a null or non-finite
component, take no part; vectors are compared with vectors of their own length
only (empty ones with empty ones: score 0); components are held to +-``LIMIT``
after scaling, so that sums stay exact; repeated rows are rows of their own,
and only a query's own row is no candidate of it; null ids are candidates and
come last among ties (ties of id: the smaller row number); an empty table, or
one without queries, gives an empty result; other columns are left alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.tables import materialise, release, ship, written

SCALE = 256
K = 5
LIMIT = 1 << 24
#: Columns that are accumulated between two looks at the bounds.
COLUMNS = 8
#: Queries that are multiplied at once while few candidates are out, and the share of live ones below which they are compacted.
TOGETHER, DENSE = 64, 0.2
#: Numbers that a group of candidates may hold, and a group of queries.
CELLS, QUERY_CELLS = 1 << 22, 1 << 18
LEAST_GROUP = 1024
#: Rows that give a query its first floor; they only skip work.
SEEDS = 1024
NONE = -(1 << 62)


def quantised(vectors: DataFrame, query: Column, *, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(row, id, asks, dims, v): the rows that take part, with integer components."""
    raw = F.col(f"`{vec_col}`").cast("array<double>")
    rows = vectors.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").alias("id"), F.coalesce(query, F.lit(False)).alias("asks"), raw.alias("x"))
    whole = F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    ints = F.transform("x", lambda x: F.floor(F.greatest(F.least(x * scale, F.lit(float(LIMIT))), F.lit(-float(LIMIT)))).cast("int"))
    return rows.filter(F.col("x").isNotNull() & whole).select("row", "id", "asks", F.size("x").alias("dims"), ints.alias("v"))


def _matrix(column, dims: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dims)


def _best(score: np.ndarray, order: np.ndarray, k: int) -> np.ndarray:
    """Places of the k greatest scores, ties to the lesser order."""
    if len(score) > 4 * k:
        least = np.partition(score, len(score) - k)[len(score) - k]
        inside = np.flatnonzero(score >= least)
        return inside[np.lexsort((order[inside], -score[inside]))[:k]]
    return np.lexsort((order, -score))[:k]


class Columns:
    """Candidates column by column, heaviest first, with the norms of what is left after each block."""

    def __init__(self, x: np.ndarray):
        mass = (x.astype(np.float64) ** 2).sum(0)
        self.order = np.argsort(-mass, kind="stable")
        laid = np.ascontiguousarray(x[:, self.order].T)
        most = float(np.abs(x.astype(np.int64)).max(initial=0))
        self.kind = np.float64 if most * most * x.shape[1] < 2**53 else np.int64
        self.begins = list(range(0, x.shape[1], COLUMNS)) or [0]
        self.blocks = [laid[b : b + COLUMNS].astype(self.kind) for b in self.begins]
        self.rest = _rest(laid.T, self.begins)
        self.n = len(x)


def _rest(x: np.ndarray, begins: list[int]) -> np.ndarray:
    """By block, then row: the norm of the columns from the block's first one on."""
    square = x.astype(np.float64) ** 2
    per = np.add.reduceat(square, begins, axis=1) if x.shape[1] else np.zeros((len(x), 1))
    return np.sqrt(np.cumsum(per[:, ::-1], axis=1)[:, ::-1].T)


def search(columns: Columns, q: np.ndarray, floors: np.ndarray, own: np.ndarray, order: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, candidate, score) of each query's k best candidates that reach its floor.

    ``own`` is the place of a query's own row among the candidates, or -1;
    ``order`` settles ties between candidates.
    """
    found: list[tuple[int, np.ndarray, np.ndarray]] = []
    laid = q[:, columns.order]
    kind = columns.kind
    if float(np.abs(q.astype(np.int64)).max(initial=0)) * (columns.rest[0].max(initial=0.0) + 1) * q.shape[1] >= 2**53:
        kind = np.int64  # doubles would round
    many = len(columns.begins)
    for at in range(0, len(q), TOGETHER):
        mine = laid[at : at + TOGETHER].astype(kind)
        rest = _rest(laid[at : at + TOGETHER], columns.begins)
        floor = floors[at : at + TOGETHER]
        total = np.zeros((len(mine), columns.n), dtype=kind)
        done, alive = 0, np.ones(total.shape, dtype=bool)
        while done < many:
            b = columns.begins[done]
            total += mine[:, b : b + COLUMNS] @ columns.blocks[done].astype(kind, copy=False)
            done += 1
            if done < many:
                # a rounding error of the norms must not drop a tie: scores are integers
                alive = total + np.outer(rest[done], columns.rest[done]) * (1 + 1e-9) + 0.5 >= floor[:, None]
                if alive.mean() <= DENSE:
                    break
        if done == many:
            alive = total >= floor[:, None]
        for i in range(len(mine)):
            if own[at + i] >= 0:
                alive[i, own[at + i]] = False
            live = np.flatnonzero(alive[i])
            score, least, block = total[i, live], floor[i], done
            while block < many and len(live):
                b = columns.begins[block]
                score = score + mine[i, b : b + COLUMNS] @ columns.blocks[block][:, live].astype(kind, copy=False)
                block += 1
                if block < many:
                    slack = rest[block, i] * columns.rest[block, live] * (1 + 1e-9) + 0.5
                    if len(live) > k:
                        sure = np.partition(score - slack, len(live) - k)[len(live) - k]
                        least = max(least, sure)
                    stay = score + slack >= least
                    live, score = live[stay], score[stay]
            stay = score >= least - 0.5
            live, score = live[stay], score[stay]
            if len(live):
                best = _best(score, order[live], k)
                found.append((at + i, live[best], score[best]))
    if not found:
        none = np.zeros(0, np.int64)
        return none, none, none
    return np.repeat([f[0] for f in found], [len(f[1]) for f in found]), np.concatenate([f[1] for f in found]), np.concatenate([f[2] for f in found]).astype(np.int64)


def _places(rows: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Where each of ``rows`` is among the numbers ``among``, or -1."""
    if not len(among):
        return np.full(len(rows), -1)
    order = np.argsort(among)
    at = np.minimum(np.searchsorted(among[order], rows), len(among) - 1)
    return np.where(among[order][at] == rows, order[at], -1)


def _floors(seeds, k: int):
    """Adds to batches of (row, id, dims, v) the k-th best score with the seeds of their length, or NONE."""

    def run(batches):
        known = {d: (r, Columns(x), x) for d, (r, x) in seeds.value.items()}
        for batch in batches:
            rows, dims = batch.column("row").to_numpy(), batch.column("dims").to_numpy()
            floors = np.full(len(rows), NONE, dtype=np.int64)
            for d in np.unique(dims):
                if int(d) not in known:
                    continue
                seed_rows, columns, _ = known[int(d)]
                here = np.flatnonzero(dims == d)
                q = _matrix(batch.column("v").take(pa.array(here)), int(d))
                i, _, score = search(columns, q, floors[here], _places(rows[here], seed_rows), seed_rows, k)
                full = np.bincount(i, minlength=len(here)) >= k
                worst = np.full(len(here), np.iinfo(np.int64).max)
                np.minimum.at(worst, i, score)
                floors[here[full]] = worst[full]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("row", "id", "dims", "v")), pa.array(floors)], names=["row", "id", "dims", "v", "floor"])

    return run


def _searched(k: int):
    def run(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        names = ["query_row", "query_id", "row", "id", "score"]
        if not queries.num_rows or not candidates.num_rows:
            of = {"query_row": queries["row"], "query_id": queries["id"], "row": candidates["row"], "id": candidates["id"], "score": pa.array([], pa.int64())}
            return pa.table({n: of[n].slice(0, 0) for n in names})
        dims = queries["dims"][0].as_py()
        ids = candidates["id"].combine_chunks()
        rows = candidates["row"].to_numpy()
        order = np.empty(len(rows), dtype=np.int64)
        by = pc.sort_indices(pa.table({"id": ids, "row": candidates["row"]}), sort_keys=[("id", "ascending"), ("row", "ascending")], null_placement="at_end")
        order[by.to_numpy()] = np.arange(len(rows))
        columns = Columns(_matrix(candidates["v"], dims))
        own = _places(queries["row"].to_numpy(), rows)
        i, j, score = search(columns, _matrix(queries["v"], dims), queries["floor"].to_numpy(), own, order, k)
        i, j = pa.array(i), pa.array(j)
        return pa.table([queries["row"].take(i), queries["id"].take(i), candidates["row"].take(j), candidates["id"].take(j), pa.array(score)], names=names)

    return run


def top_k(vectors: DataFrame, query: Column, *, k: int = K, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(query_id, rank, id, score): the k rows with the greatest inner product for each row that ``query`` holds for.

    Ranks count from 1; ties go to the smaller id.
    """
    spark, mark = vectors.sparkSession, written()
    ship(spark)
    rows = materialise(quantised(vectors, query, id_col=id_col, vec_col=vec_col, scale=scale), "topk-vectors")
    n, asked, widest = rows.agg(F.count("*"), F.count_if("asks"), F.coalesce(F.max("dims"), F.lit(0))).first()
    kind = dict(rows.dtypes)["id"]
    width = max(widest, 1)
    parallel = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    size = max(min(-(-n // parallel), CELLS // width), min(LEAST_GROUP, CELLS // width), 1)
    groups = max(-(-n // size), 1)
    askers = max(-(-asked // max(QUERY_CELLS // width, 1)), 1)
    few = rows.orderBy(F.xxhash64("row"), "row").limit(max(min(SEEDS, CELLS // width), 1)).select("row", "dims", "v").toArrow()  # SEEDS rows
    seeds = {}
    for d in np.unique(few["dims"].to_numpy()):
        part = few.filter(pc.equal(few["dims"], int(d)))
        seeds[int(d)] = part["row"].to_numpy(), _matrix(part["v"], int(d))
    shared = spark.sparkContext.broadcast(seeds)
    dealt = lambda c, many: F.pmod(F.xxhash64("row"), F.lit(many)).cast("int").alias(c)
    every = lambda c, many: F.explode(F.sequence(F.lit(0), F.lit(many - 1))).alias(c)
    asking = rows.filter("asks").select("row", "id", "dims", "v").mapInArrow(_floors(shared, k), f"row bigint, id {kind}, dims int, v array<int>, floor bigint")
    asking = asking.select("*", dealt("asker", askers)).select("*", every("part", groups))
    offered = rows.select("row", "id", "dims", "v", dealt("part", groups)).select("*", every("asker", askers))
    keys = ["dims", "part", "asker"]
    near = asking.groupBy(*keys).cogroup(offered.groupBy(*keys)).applyInArrow(_searched(k), f"query_row bigint, query_id {kind}, row bigint, id {kind}, score bigint")
    w = Window.partitionBy("query_row").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last(), "row")
    ranked = near.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return release(ranked.select("query_id", "rank", "id", "score"), mark)
