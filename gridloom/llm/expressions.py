"""Column helpers shared by the corpus operators; built-in functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
BLOCK = 64


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, with ``value`` evaluated once a row.

    Inside a lambda a plain expression would be evaluated again for every
    element; as the variable of an outer lambda it is bound once.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def upto(n: Column) -> Column:
    """The array 0 .. n-1; empty if n < 1."""
    return F.when(n > 0, F.sequence(F.lit(0), n.cast("int") - 1)).otherwise(F.array().cast("array<int>"))


def words(text: Column) -> Column:
    """Words separated by ASCII white space; null and blank texts have none."""
    trimmed = F.regexp_replace(F.coalesce(text, F.lit("")), r"^[\x20\x09-\x0D]++", "")
    return let(F.split(trimmed, SPACE, -1), lambda w: F.when(F.element_at(w, -1) == "", F.slice(w, 1, F.size(w) - 1)).otherwise(w))


def running_before(values: Column) -> Column:
    """For each element of an array of numbers, the sum of those before it.

    By blocks: sums of whole blocks first, then within a block, so that long
    arrays take about n ** 1.5 / 8 additions and not n ** 2.
    """

    def total(a: Column) -> Column:
        return F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x)

    def blocks(a: Column) -> Column:
        n = F.floor((F.size(a) + (BLOCK - 1)) / BLOCK)
        return F.transform(upto(n), lambda b: total(F.slice(a, b * BLOCK + 1, BLOCK)))

    def within(a: Column, before: Column) -> Column:
        def at(_: Column, i: Column) -> Column:
            block = F.floor(i / BLOCK).cast("int")
            return F.get(before, block) + total(F.slice(a, block * BLOCK + 1, i - block * BLOCK))

        return F.transform(a, at)

    return let(
        values,
        lambda a: let(
            let(blocks(a), lambda s: F.transform(s, lambda _, i: total(F.slice(s, 1, i)))), lambda before: within(a, before)
        ),
    )
