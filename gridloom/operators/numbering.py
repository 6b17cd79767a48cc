"""Places in a global order without one task for all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.cluster import held


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """The rows with ``name``: their place from 0 in the order of the columns (ascending, nulls first).

    Rows are cut into ranges by samples of the order (as many as a shuffle has
    partitions; adaptive execution joins small ones), written once, and counted
    a range; a place is the range's offset and the rank inside it.  Rows that
    are equal in all of ``order`` fall into one range and take its places in
    any order, so name columns that tell rows apart.  An empty table stays empty.
    """
    keys = [F.col(c).asc_nulls_first() for c in order]
    cut = held(rows.repartitionByRange(*keys).withColumn("__range", F.spark_partition_id()), "numbered")
    begins, at = [], 0
    for r in cut.groupBy("__range").count().orderBy("__range").collect():  # a row a range
        begins.append((r["__range"], at))
        at += r["count"]
    offset = F.create_map(*(F.lit(x) for pair in begins for x in pair))[F.col("__range")] if begins else F.lit(0)
    within = F.row_number().over(Window.partitionBy("__range").orderBy(*keys)) - 1
    return cut.withColumn(name, (offset + within).cast("long")).drop("__range")
