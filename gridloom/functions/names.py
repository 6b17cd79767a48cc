"""What file, run and frame names hold, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _number(text: Column, pattern: str, kind: str = "int") -> Column:
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")).cast(kind)


def frame_index(name: Column) -> Column:
    return _number(name, r"frame_(\d+)", "long")


def view_index(name: Column) -> Column:
    """v<digits>, or null."""
    return _number(name, r"(?:^|_)v(\d+)(?:_|\.|$)")


def yaw(name: Column) -> Column:
    return _number(name, r"yaw(\d+)")


def view_of_yaw(degrees: Column, views: int) -> Column:
    """round(yaw / step) mod views, halves to even."""
    return (F.bround(degrees / (360.0 / views)) % views).cast("int")


def capture_key(name: Column) -> Column:
    """What stands before the yaw, from the last ``frame_`` on."""
    return F.nullif(F.regexp_extract(name, r".*(frame_.*?)_yaw", 1), F.lit(""))


def stamp_seconds(name: Column) -> Column:
    """The longest run of at least ten digits as nanoseconds, in seconds; the first of equals; null if there is none."""
    runs = F.regexp_extract_all(name, F.lit(r"\d{10,}"), F.lit(0))
    best = F.aggregate(runs, F.lit(""), lambda s, x: F.when(F.length(x) > F.length(s), x).otherwise(s))
    return F.nullif(best, F.lit("")).cast("double") * 1e-9


def frame_name(frame: Column, view: Column, stamp: Column, degrees: Column) -> Column:
    return F.format_string("%05d_v%02d_frame_%05d_%d_yaw%03d.jpg", frame, view, frame, stamp, degrees)


def run_name(name: Column) -> Column:
    """struct(floor, date, run) of names like floor_1_2025-05-05_run_1; nulls if it is none."""
    part = lambda k: F.nullif(F.regexp_extract(name, r"^floor_(.+)_(\d{4}-\d{2}-\d{2})_run_(\d+)$", k), F.lit(""))
    return F.struct(part(1).alias("floor"), part(2).alias("date"), part(3).cast("int").alias("run"))


def run_path(run: Column) -> Column:
    return F.concat(F.lit("floor_"), run["floor"], F.lit("/"), run["date"], F.lit("/run_"), run["run"].cast("string"))


def is_safe_label(text: Column) -> Column:
    return text.rlike(r"^[A-Za-z0-9][A-Za-z0-9._-]*$")


def split_list(text: Column) -> Column:
    """Comma-separated parts, trimmed, empty ones dropped."""
    return F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")


def canonical_json_digest(row: Column) -> Column:
    """SHA-256 of a struct's JSON; declare its fields in sorted order."""
    return F.sha2(F.to_json(row), 256)


def split_stamp(ns: Column) -> Column:
    """struct(sec, nsec) of nanoseconds; structs of it compare as the stamps do."""
    rest = F.pmod(ns, F.lit(1_000_000_000))
    return F.struct(((ns - rest) / 1_000_000_000).cast("long").alias("sec"), rest.cast("long").alias("nsec"))


def nanoseconds(seconds: Column) -> Column:
    """Whole nanoseconds of decimal seconds, rounded; exact, as it goes by decimals and not by doubles."""
    return F.round(seconds.cast("decimal(28,12)") * 1_000_000_000).cast("long")


def sniffed(text: Column) -> Column:
    """struct(kind, b, i, d): what a text reads as, tried in turn: a boolean, a whole number, a number, else a string."""
    low = F.lower(F.trim(text))
    whole, real = F.trim(text).try_cast("bigint"), F.trim(text).try_cast("double")
    is_bool = low.isin("true", "false")
    is_whole = F.trim(text).rlike(r"^[+-]?[0-9]+$") & whole.isNotNull()
    kind = F.when(is_bool, "bool").when(is_whole, "int").when(real.isNotNull(), "float").otherwise("str")
    return F.struct(kind.alias("kind"), F.when(is_bool, low == "true").alias("b"), F.when(is_whole, whole).alias("i"), F.when(~is_bool & ~is_whole, real).alias("d"))


def key_values(text: Column) -> Column:
    """A map of ``k=v`` parts separated by commas; the last of a key wins, parts without an = are left out."""
    parts = F.filter(F.transform(F.split(text, ","), lambda x: F.split(F.trim(x), "=", 2)), lambda p: F.size(p) == 2)
    return F.aggregate(parts, F.expr("cast(map() as map<string,string>)"), lambda m, p: F.map_concat(F.map_filter(m, lambda k, _: k != p[0]), F.create_map(p[0], p[1])))
