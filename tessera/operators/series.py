"""A series: one expression over a frame. Nothing runs until a value is asked for."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from typing import TYPE_CHECKING, Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import IndexOutOfRange, LengthMismatch, TypeMismatch
from ..functions.exprs import as_bool_mask, fill_na, half_away_round, ieee_div, is_numeric, map_values, plain_double
from . import ordered, stats

if TYPE_CHECKING:
    from .frame import Frame


class Series:
    __hash__ = None  # type: ignore[assignment]

    def __init__(self, frame: Frame, expr: Column, name: str | None = None):
        self.frame, self.expr, self.name = frame, expr, name

    def _like(self, expr: Column) -> Series:
        return Series(self.frame, expr, self.name)

    @property
    def df(self) -> DataFrame:
        """The values as ``value``, with the frame's order columns."""
        return self.frame.df.select(self.expr.alias("value"), *[F.col(ordered.name(c)).alias(f"__o{k}") for k, c in enumerate(self.frame.order)])

    @property
    def kind(self) -> T.DataType:
        return self.df.schema["value"].dataType

    @property
    def order(self) -> list[str]:
        if not self.frame.order:
            raise TypeMismatch("this needs a row order: Frame(df, order=[...])")
        return [ordered.Desc(f"__o{k}") if isinstance(c, ordered.Desc) else f"__o{k}" for k, c in enumerate(self.frame.order)]

    # arithmetic, in doubles

    def _other(self, other: Any) -> Column:
        if isinstance(other, Series):
            if other.frame.df is not self.frame.df:
                raise LengthMismatch("series of different frames; join the frames first")
            return plain_double(other.expr)
        return F.lit(float(other))

    def __add__(self, other: Any) -> Series:
        return self._like(plain_double(self.expr) + self._other(other))

    def __sub__(self, other: Any) -> Series:
        return self._like(plain_double(self.expr) - self._other(other))

    def __mul__(self, other: Any) -> Series:
        return self._like(plain_double(self.expr) * self._other(other))

    def __truediv__(self, other: Any) -> Series:
        return self._like(ieee_div(self.expr, self._other(other)))

    # comparison: missing (and NaN, but for !=) compares false

    def _mask(self, op: str, other: Any) -> Series:
        from ..plans.predicate import Leaf

        return self._like(as_bool_mask(Leaf("value", op, other).over(self.expr, self.kind)))

    def __gt__(self, other: Any) -> Series:
        return self._mask(">", other)

    def __ge__(self, other: Any) -> Series:
        return self._mask(">=", other)

    def __lt__(self, other: Any) -> Series:
        return self._mask("<", other)

    def __le__(self, other: Any) -> Series:
        return self._mask("<=", other)

    def __eq__(self, other: Any) -> Series:  # type: ignore[override]
        return self._mask("==", other)

    def __ne__(self, other: Any) -> Series:  # type: ignore[override]
        return self._mask("!=", other)

    def contains(self, part: str) -> Series:
        return self._like(as_bool_mask(self.expr.contains(part)))

    def __and__(self, other: Series) -> Series:
        return self._like(self.expr & other.expr)

    def __or__(self, other: Series) -> Series:
        return self._like(self.expr | other.expr)

    def __invert__(self) -> Series:
        return self._like(~self.expr)

    # missing values

    def is_na(self) -> Series:
        return self._like(self.expr.isNull())

    def not_na(self) -> Series:
        return self._like(self.expr.isNotNull())

    def fill_na(self, value: float | str) -> Series:
        """Missing values replaced where the kinds agree; otherwise the series is unchanged."""
        fits = is_numeric(self.kind) if not isinstance(value, str) else isinstance(self.kind, T.StringType)
        return self._like(fill_na(self.expr, value)) if fits else self

    def drop_na(self) -> Series:
        kept = self.frame.filter(self.expr.isNotNull())
        return Series(kept, self.expr, self.name)

    # values

    def map(self, mapping: Mapping) -> Series:
        return self._like(map_values(self.expr, mapping))

    def apply(self, f: Callable[[Column], Column] | Callable[[float], float], vectorised: bool = True) -> Series:
        """f over doubles, missing values left out. A function from Column to Column stays in the plan; with
        vectorised=False f takes and gives a float and runs in Arrow batches."""
        if vectorised:
            return self._like(F.when(self.expr.isNotNull(), f(plain_double(self.expr))))

        @F.pandas_udf("double")
        def each(x: pd.Series) -> pd.Series:
            return x.map(f, na_action="ignore").astype("float64")

        return self._like(each(plain_double(self.expr)))

    def round(self, digits: int) -> Series:
        return self._like(half_away_round(self.expr, digits))

    # reductions

    def _reduced(self, f: Callable[[Column], Column]) -> float | None:
        return stats.reduce_one(self.df, "value", f)

    def sum(self) -> float | None:
        return self._reduced(stats.REDUCTIONS["sum"])

    def mean(self) -> float | None:
        return self._reduced(stats.REDUCTIONS["mean"])

    def min(self) -> float | None:
        return self._reduced(stats.REDUCTIONS["min"])

    def max(self) -> float | None:
        return self._reduced(stats.REDUCTIONS["max"])

    def std(self, ddof: int = 1) -> float | None:
        return self._reduced(lambda c: stats.std(c, ddof))

    def variance(self, ddof: int = 1) -> float | None:
        return self._reduced(lambda c: stats.variance(c, ddof))

    def median(self) -> float | None:
        return self.quantile(0.5)

    def quantile(self, q: float) -> float | None:
        """Exact, interpolated; found by rank, so no task holds all values."""
        if not is_numeric(self.kind):
            raise TypeMismatch("quantiles are of numbers")
        return stats.quantiles_by_rank(self.df, "value", [q])[0]

    def count(self) -> int:
        return self.df.agg(F.count("value")).first()[0]

    def describe(self) -> dict[str, float]:
        """Eight statistics of numbers; of other values, count and non_null."""
        if is_numeric(self.kind):
            return {r["statistic"]: r["value"] for r in stats.describe(self.df, ["value"]).collect()}
        n, some = self.df.agg(F.count(F.lit(1)), F.count("value")).first()
        return {"count": n, "non_null": some}

    def value_counts(self) -> DataFrame:
        return stats.value_counts(self.df, "value")

    def unique(self) -> DataFrame:
        return stats.unique(self.df, "value")

    @property
    def nunique(self) -> int:
        return self.df.agg(F.count_distinct("value")).first()[0]

    # order

    def sort(self, ascending: bool = True) -> DataFrame:
        return self.df.orderBy(F.col("value").asc_nulls_last() if ascending else F.col("value").desc_nulls_last()).select("value")

    def argsort(self, ascending: bool = True) -> DataFrame:
        return ordered.argsort(self.df, "value", self.order, ascending)

    def cumsum(self) -> DataFrame:
        return ordered.cumsum(self.df, "value", self.order, "cumsum")

    def duplicated(self) -> DataFrame:
        """Flags of values seen earlier; a missing value is none."""
        return ordered.duplicated(self.df, ["value"], self.order, nulls_equal=False)

    def drop_duplicates(self) -> DataFrame:
        return ordered.drop_duplicates(self.df, ["value"], self.order, nulls_equal=False)

    def factorize(self) -> DataFrame:
        return ordered.factorize(self.df, "value", self.order)

    def head(self, n: int = 5) -> list:
        return [r["value"] for r in self.df.orderBy(*ordered.ordering(self.order)).limit(n).collect()]

    def tail(self, n: int = 5) -> list:
        return [r["value"] for r in self.df.orderBy(*ordered.ordering(self.order, backwards=True)).limit(n).collect()][::-1]

    def iloc(self, at: int | slice) -> Any:
        placed = ordered.with_position(self.df, self.order)
        if isinstance(at, int):
            row = placed.filter(F.col(ordered.POSITION) == at).first()
            if row is None:
                raise IndexOutOfRange(f"no element {at}")
            return row["value"]
        d = placed.filter(F.col(ordered.POSITION) >= (at.start or 0))
        d = d if at.stop is None else d.filter(F.col(ordered.POSITION) < at.stop)
        return [r["value"] for r in d.orderBy(ordered.POSITION).collect()]

    __getitem__ = iloc

    def loc(self, label: str) -> Any:
        """The first value with a label of the frame's index."""
        name = self.name if self.name in self.frame.columns else None
        if name is None:
            raise TypeMismatch("a computed series has no labels; add it to the frame first")
        return self.frame.loc(label)[name]

    def locate(self, value: Any) -> int | None:
        """The first position of a value, or None."""
        placed = ordered.with_position(self.df, self.order).filter(F.col("value") == value)
        return placed.agg(F.min(ordered.POSITION)).first()[0]

    @property
    def is_unique(self) -> bool:
        n, some = self.df.agg(F.count("value"), F.count_distinct("value")).first()
        return n == some

    def collect(self) -> list:
        d = self.df.orderBy(*ordered.ordering(self.order)) if self.frame.order else self.df
        return [r["value"] for r in d.collect()]
