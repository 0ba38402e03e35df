"""Grouping. Rows with a null in any key are left out; keys are always columns of the result."""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import KeyColumnNotFound, UnknownOperation, need
from ..functions.exprs import nan_if_null, numeric_columns, zero_if_null
from . import stats

if TYPE_CHECKING:
    from .frame import Frame

#: Functions of the agg verb.
FUNCTIONS = ("sum", "mean", "count", "min", "max", "std", "median")


def aggregate(name: str, c: Column) -> Column:
    """One aggregate of a group as a double: an empty sum is 0; mean, min, max and std of nothing are NaN. Medians are no
    aggregates of Spark's here: see GroupBy._aggregated."""
    x = stats.REDUCTIONS[name](c)
    return zero_if_null(x) if name in ("sum", "count") else nan_if_null(x)


class GroupBy:
    def __init__(self, frame: Frame, keys: tuple[str, ...]):
        need(frame.columns, *keys, kind=KeyColumnNotFound)
        self.frame, self.keys = frame, keys

    def _grouped(self):
        return self.frame.df.dropna(subset=list(self.keys)).groupBy(*[f"`{k}`" for k in self.keys])

    def _aggregated(self, wanted: list[tuple[str, str, str]]) -> DataFrame:
        """keys and (function, column, name of the result) in one aggregation, the medians by rank beside it: the memory of
        none grows with a group."""
        for name, _, _ in wanted:
            if name not in FUNCTIONS:
                raise UnknownOperation(f"no aggregate named {name!r}; there are: {', '.join(FUNCTIONS)}")
        medians = [(F.col(f"`{c}`"), alias) for name, c, alias in wanted if name == "median"]
        others = [aggregate(name, F.col(f"`{c}`")).alias(f"__r{k}") for k, (name, c, _) in enumerate(wanted) if name != "median"]
        keys = [f"__g{k}" for k in range(len(self.keys))]
        named = [F.col(g).alias(k) for g, k in zip(keys, self.keys, strict=True)]
        if not medians:
            return self._grouped().agg(*others).toDF(*self.keys, *[alias for _, _, alias in wanted])
        rows = self.frame.df.dropna(subset=list(self.keys))
        places = [k for k, (name, _, _) in enumerate(wanted) if name == "median"]
        found = stats.quantiles(rows, {f"__r{k}": (c, [0.5]) for k, (c, _) in zip(places, medians, strict=True)}, self.keys).toDF(*keys, *[f"__r{k}" for k in places])
        if others:
            found = self._grouped().agg(*others).withColumnsRenamed(dict(zip(self.keys, keys, strict=True))).join(found, on=keys)
        results = [(nan_if_null(F.col(f"__r{k}")[0]) if name == "median" else F.col(f"__r{k}")).alias(alias) for k, (name, _, alias) in enumerate(wanted)]
        return found.select(*named, *results)

    def _all(self, name: str) -> Frame:
        values = numeric_columns(self.frame.df, *self.keys)
        df = self.frame.df.select(*self.keys).dropna().distinct() if not values else self._aggregated([(name, c, c) for c in values])
        return type(self.frame)(df, order=self.keys)

    def sum(self) -> Frame:
        return self._all("sum")

    def mean(self) -> Frame:
        return self._all("mean")

    def count(self) -> Frame:
        """Values that aren't missing, of each numeric column."""
        return self._all("count")

    def min(self) -> Frame:
        return self._all("min")

    def max(self) -> Frame:
        return self._all("max")

    def std(self) -> Frame:
        return self._all("std")

    def median(self) -> Frame:
        return self._all("median")

    def agg(self, *pairs: tuple[str, str]) -> Frame:
        """(function, column) pairs in one aggregation. Results have the column's name; a column that is aggregated again
        has the function's name before it."""
        out, used = [], set(self.keys)
        for name, column in pairs:
            need(self.frame.columns, column)
            alias = column if column not in used else f"{name}_{column}"
            used.add(alias)
            out.append((name, column, alias))
        return type(self.frame)(self._aggregated(out), order=self.keys)

    def groups(self) -> Frame:
        """keys and ``positions``, the row positions of each group. One array per group: for groups that fit a row."""
        placed = self.frame.with_position().df.dropna(subset=list(self.keys))
        return type(self.frame)(placed.groupBy(*self.keys).agg(F.array_sort(F.collect_list("__pos__")).alias("positions")), order=self.keys)
