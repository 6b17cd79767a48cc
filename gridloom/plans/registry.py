"""Named factories: datasets, evaluators and export formats are looked up by name."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module
from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Registry:
    def __init__(self) -> None:
        self._known: dict[str, Callable | str] = {}

    def add(self, name: str, target: Callable | str | None = None):
        """Register a callable, or ``module:attribute`` to be imported at first use; usable as a decorator."""
        if target is None:
            return lambda f: self.add(name, f) or f
        if name in self._known:
            raise KeyError(f"{name} is registered already")
        self._known[name] = target
        return None

    def get(self, name: str) -> Callable:
        found = self._known[name]
        if isinstance(found, str):
            module, _, attribute = found.partition(":")
            found = self._known[name] = getattr(import_module(module), attribute)
        return found

    def __contains__(self, name: str) -> bool:
        return name in self._known

    def all(self) -> list[str]:
        return sorted(self._known)

    def fan_out(self, names: str, *args, **kwargs) -> dict:
        """Call every target of an ``a-b-c`` list; an unknown name is an error before any is called."""
        wanted = names.split("-")
        if unknown := [n for n in wanted if n not in self]:
            raise KeyError(f"unknown: {', '.join(unknown)}")
        return {n: self.get(n)(*args, **kwargs) for n in wanted}


def absent(methods: list[str], runs: DataFrame, names: list[str], present: DataFrame) -> DataFrame:
    """(method, run, name): expected outputs that ``present`` lacks; the expected ones are made by exploding two short lists."""
    each = lambda xs, c: F.explode(F.array(*(F.lit(x) for x in xs))).alias(c)
    grid = runs.select("run", each(methods, "method")).select("method", "run", each(names, "name"))
    return grid.join(present.select("method", "run", "name"), ["method", "run", "name"], "left_anti")


def missing_outputs(methods: list[str], runs: list[str], names: list[str], present: set[tuple[str, str, str]]) -> list[tuple[str, str, str]]:
    """Expected outputs (methods x runs x names) that are not there."""
    return [x for x in product(methods, runs, names) if x not in present]
