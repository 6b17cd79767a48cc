"""Text sinks: every one is a projection to lines and Spark's own committed write."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _line(*parts: Column, sep: str = " ") -> Column:
    return F.concat_ws(sep, *parts)


def number(c: Column, digits: int) -> Column:
    return F.format_string(f"%.{digits}f", c.cast("double"))


def tum_lines(rows: DataFrame) -> DataFrame:
    """``ts tx ty tz qx qy qz qw`` at nine decimals."""
    return rows.select(_line(*(number(F.col(c), 9) for c in ("ts", "x", "y", "z", "qx", "qy", "qz", "qw"))).alias("value"))


def pose_lines(rows: DataFrame, pose: str = "pose") -> DataFrame:
    """Sixteen numbers a line, as short as reads back the same."""
    return rows.select(F.array_join(F.transform(pose, lambda x: x.cast("string")), " ").alias("value"))


def loop_lines(rows: DataFrame) -> DataFrame:
    """``i, j, sim`` at four decimals."""
    return rows.select(_line(F.col("a").cast("string"), F.col("b").cast("string"), number(F.col("sim"), 4), sep=", ").alias("value"))


def json_lines(rows: DataFrame) -> DataFrame:
    """One object a row; NaN and infinities are null."""
    kinds = dict(rows.dtypes)
    safe = [F.when(F.isnan(c) | (F.abs(F.col(c)) == float("inf")), None).otherwise(F.col(c)).alias(c) if kinds[c] in ("double", "float") else F.col(c) for c in rows.columns]
    return rows.select(F.to_json(F.struct(*safe)).alias("value"))


def write_lines(rows: DataFrame, path: str, *, append: bool = False, files: int | None = None) -> None:
    """Committed as a whole or not at all; ``append`` adds files to those there are."""
    out = rows if files is None else rows.coalesce(files)
    out.write.mode("append" if append else "overwrite").text(path)


def flat_metrics(rows: DataFrame, column: str) -> DataFrame:
    """A nested struct as dotted columns; arrays are dropped."""
    from pyspark.sql.types import ArrayType, StructType

    def walk(kind: StructType, path: list[str]) -> list[Column]:
        out = []
        for f in kind.fields:
            here = [*path, f.name]
            if isinstance(f.dataType, StructType):
                out += walk(f.dataType, here)
            elif not isinstance(f.dataType, ArrayType):
                out.append(F.col(".".join(f"`{p}`" for p in here)).alias(".".join(here[1:])))
        return out

    return rows.select(*walk(rows.schema[column].dataType, [column]))
