"""Named joins, unions and orderings of frames, cameras, files, predictions and clouds.

Equi-joins on declared keys, left to Spark to broadcast or shuffle by size; a
table is only forced to be broadcast where its caller passes a list.  Null
keys match nothing; repeated keys on a lookup side are an error of the caller
unless a function says what it does with them; empty tables give empty
results.  Orders are total: each function states its tie-break.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions import pose
from gridloom.operators.numbering import numbered


def frames_with_cameras(frames: DataFrame, cameras: DataFrame, files: DataFrame, *, key: str, camera: str, denied: Column) -> DataFrame:
    """Every frame with its camera's columns and ``reason``: why it is dropped (``denied``, ``no_file``, ``no_camera``), or null.

    ``files`` has the keys that exist, ``cameras`` one row a ``camera``.  The
    camera's columns are null on dropped rows.
    """
    rest = [c for c in cameras.columns if c != camera]
    seen = frames.join(files.select(key).distinct().withColumn("__file", F.lit(True)), key, "left").join(cameras.withColumn("__camera", F.lit(True)), camera, "left")
    reason = F.when(denied, "denied").when(F.col("__file").isNull(), "no_file").when(F.col("__camera").isNull(), "no_camera")
    return seen.select(*frames.columns, *(F.when(reason.isNull(), F.col(c)).alias(c) for c in rest), reason.alias("reason"))


def device_frames(frames: DataFrame, cameras: DataFrame, *, name: str, camera: str, device: str, shift: float = 0.5) -> DataFrame:
    """Frames whose name contains the device, with their camera, whose principal point (cx, cy) is moved by -shift."""
    rest = [c for c in cameras.columns if c not in (camera, "cx", "cy")]
    kept = frames.filter(F.col(name).contains(device)).join(cameras, camera)
    return kept.select(*frames.columns, *rest, (F.col("cx") - shift).alias("cx"), (F.col("cy") - shift).alias("cy"))


def existing_frames(total: int, images: DataFrame, poses: DataFrame, *, key: str, pose_col: str = "pose") -> DataFrame:
    """(key, pose): of the frames 0 .. total - 1 those with an image and a pose, the pose (s, r, t) inverted."""
    frames = images.sparkSession.range(total).withColumnRenamed("id", key)
    kept = frames.join(images.select(key).distinct(), key, "left_semi").join(poses.select(key, pose_col), key)
    return kept.select(key, pose.inverse(F.col(pose_col)).alias(pose_col))


def match_index(sampled: DataFrame, full: DataFrame, *, path: str, index: str) -> DataFrame:
    """Sampled rows with the place of their path in the full list (the first, if it is there more than once); others are dropped."""
    first = full.groupBy(path).agg(F.min(index).alias(index))
    return sampled.join(first, path)


def with_targets(predictions: DataFrame, targets: DataFrame, *, path: str, found: str = "ok", missing: str = "missing_gt") -> DataFrame:
    """Every prediction with its target's columns and ``status``."""
    marked = targets.withColumn("__there", F.lit(True))
    joined = predictions.join(marked, path, "left")
    return joined.select(*(c for c in joined.columns if c != "__there"), F.when(F.col("__there"), found).otherwise(missing).alias("status"))


def take(rows: DataFrame, index: str, wanted: list[int]) -> DataFrame:
    """The rows at the wanted places, in the list's order (``place``); a place listed twice comes twice."""
    few = rows.sparkSession.createDataFrame(list(enumerate(wanted)), f"place int, `{index}` long")
    return rows.join(F.broadcast(few), index)


def edge_poses(edges: DataFrame, poses: DataFrame, *, a: str, b: str, node: str, pose_col: str = "pose") -> DataFrame:
    """Edges with both ends' poses and ``residual``: what is left of the measured step ``edge`` after the poses' own step.

    All are similarity transforms (s, r, t); edges without both poses are dropped.
    """
    end = lambda c, n: poses.select(F.col(node).alias(c), F.col(pose_col).alias(n))
    both = edges.join(end(a, "pose_a"), a).join(end(b, "pose_b"), b)
    own = pose.compose(pose.inverse(F.col("pose_a")), F.col("pose_b"))
    return both.withColumn("own", own).withColumn("residual", pose.compose(pose.inverse(F.col("edge")), F.col("own"))).drop("own")


def pixel_tracks(pixels: DataFrame, tracks: DataFrame, *, frame: str, position: str, track: str) -> DataFrame:
    """Pixels with the track that holds their frame and position, null if none does."""
    return pixels.join(tracks.select(frame, position, track), [frame, position], "left")


def select_runs(runs: DataFrame, *, path: str, floor: str, floors: list | None = None, workers: int = 1, worker: int = 0, limit: int | None = None) -> DataFrame:
    """Runs of the wanted floors in path order, every ``workers``-th from ``worker`` on, the first ``limit`` of them; with ``place`` from 0."""
    kept = runs.filter(F.col(floor).isin(floors)) if floors else runs
    placed = numbered(kept, [path], "place").filter(F.col("place") % workers == worker)
    return placed if limit is None else placed.orderBy("place").limit(limit)


def best_pairs(pairs: DataFrame, score: str, tie: list[str], k: int | None = None) -> DataFrame:
    """Pairs in descending order of score, ties by the columns named; the first k if k is given (a top-k: each task keeps k rows)."""
    ordered = pairs.orderBy(F.desc_nulls_last(score), *tie)
    return ordered if k is None else ordered.limit(k)


def head(rows: DataFrame, order: str, n: int) -> DataFrame:
    """The first n rows in file order."""
    return rows.orderBy(order).limit(n)


def lexicographic(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The rows sorted by the keys, in turn (a range-partitioned sort)."""
    return rows.orderBy(*keys)


def concatenated(parts: list[DataFrame], source: str | None = None) -> DataFrame:
    """All rows of all parts by column name; columns that a part lacks are null; ``source`` tells the part by its place."""
    out = None
    for k, part in enumerate(parts):
        one = part if source is None else part.withColumn(source, F.lit(k))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The new rows, and the old ones of keys that the new table does not have."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def append_or_replace(found: DataFrame, given: DataFrame, *, replace: bool) -> DataFrame:
    """The given pairs alone, or after the found ones; repeated rows stay."""
    return given if replace else found.unionByName(given, allowMissingColumns=True)


def parted(rows: DataFrame, inside: Column) -> DataFrame:
    """All rows with ``part``: ``inside`` or ``outside`` (null counts as outside), so the two always add up."""
    return rows.withColumn("part", F.when(F.coalesce(inside, F.lit(False)), "inside").otherwise("outside"))


def gap_labels(points: DataFrame, index: str, dims: list[str], *, reach: int, gap: int, positive: float, negative: float, by: list[str] = ()) -> DataFrame:
    """(by..., i, j, label): pairs with gap <= j - i <= reach, 1 within ``positive`` of each other, 0 at ``negative`` or farther; those between are dropped.

    Rows with a null coordinate are left out.  A row makes reach - gap + 1 candidates.
    """
    ok = F.lit(True)
    for d in dims:
        ok &= F.col(d).isNotNull()
    there = points.filter(ok).select(*by, F.col(index).alias("i"), *(F.col(d).alias(f"a_{d}") for d in dims))
    ahead = there.withColumn("j", F.explode(F.sequence(F.col("i") + gap, F.col("i") + reach)))
    other = points.filter(ok).select(*by, F.col(index).alias("j"), *(F.col(d).alias(f"b_{d}") for d in dims))
    squares = [(F.col(f"a_{d}") - F.col(f"b_{d}")) * (F.col(f"a_{d}") - F.col(f"b_{d}")) for d in dims]
    far = F.sqrt(sum(squares[1:], squares[0]))
    label = F.when(far <= positive, 1).when(far >= negative, 0)
    return ahead.join(other, [*by, "j"]).select(*by, "i", "j", label.alias("label")).filter("label is not null")


def compare_methods(rows: DataFrame, key: str, method: str, value: str, methods: list[str]) -> DataFrame:
    """One row a key with a column a method (the greatest value, if there are several)."""
    return rows.groupBy(key).pivot(method, methods).agg(F.max(value))


def by_mode(rows: DataFrame, modes: dict[str, Column]) -> DataFrame:
    """Every row once a mode, with ``mode`` and that mode's ``value``."""
    each = F.array(*(F.struct(F.lit(n).alias("mode"), c.alias("value")) for n, c in modes.items()))
    return rows.select("*", F.explode(each).alias("m")).select(*rows.columns, "m.mode", "m.value")


def nested_reports(rows: DataFrame, outer: str, inner: str, leaf: str, value: str) -> DataFrame:
    """(outer, report): a map from ``inner`` to a map from ``leaf`` to the value; one row a run of the hierarchy, of which a group is small."""
    low = rows.groupBy(outer, inner).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col(leaf).cast("string"), value)))).alias("leaves"))
    return low.groupBy(outer).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col(inner).cast("string").alias("k"), F.to_json("leaves").alias("v"))))).alias("report"))


def wide_scores(scores: DataFrame, by: list[str], a: str, b: str, score: str, views: int) -> DataFrame:
    """One row a capture pair with a column ``score_v<a>_v<b>`` for every pair of views; null where there is none."""
    pick = [F.max(F.when((F.col(a) == x) & (F.col(b) == y), F.col(score))).alias(f"score_v{x}_v{y}") for x in range(views) for y in range(views)]
    return scores.groupBy(*by).agg(*pick)


def owner_counts(owned: DataFrame, by: list[str], frame: str) -> DataFrame:
    """Per group how many rows and distinct frames there are, and whether each frame is owned once."""
    return owned.groupBy(*by).agg(F.count(frame).alias("n_rows"), F.count_distinct(frame).alias("n_frames")).withColumn("exactly_once", F.col("n_rows") == F.col("n_frames"))


def retained(tasks: DataFrame, *, finished: str, now: int, ttl: int, most: int, key: str) -> DataFrame:
    """Tasks that are not done, and of the done ones at most ``ttl`` old the ``most`` latest (ties by key, greater first)."""
    done = tasks.filter(F.col(finished).isNotNull() & (now - F.col(finished) <= ttl)).orderBy(F.desc(finished), F.desc(key)).limit(most)
    return tasks.filter(F.col(finished).isNull()).unionByName(done)


def evaluation_grid(spark, modes: list[str], datasets: list[str], scenes: DataFrame) -> DataFrame:
    """(mode, dataset, scene): all modes for the scenes of the wanted datasets; as many rows as modes and scenes, no join."""
    return scenes.filter(F.col("dataset").isin(datasets)).select(F.explode(F.array(*(F.lit(m) for m in modes))).alias("mode"), "dataset", "scene")
