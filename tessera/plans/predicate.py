"""Predicates with two-valued logic: missing compares false, and NOT flips that.

A predicate is a small tree. It compiles to a bare filter condition (null counts as false there, so comparisons reach the
scan) or to a mask column without nulls. NOT is pushed down to the leaves, where it turns into the opposite comparison or
null, which the scan understands as well.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import need
from ..functions.exprs import as_bool_mask, is_numeric

OPERATORS = (">", ">=", "<", "<=", "==", "!=", "contains")
_OPPOSITE = {">": "<=", ">=": "<", "<": ">=", "<=": ">", "==": "!=", "!=": "=="}


class Predicate:
    def __and__(self, other: Predicate) -> Predicate:
        return Both("&", self, other)

    def __or__(self, other: Predicate) -> Predicate:
        return Both("|", self, other)

    def __invert__(self) -> Predicate:
        return Not(self)

    def condition(self, df: DataFrame, negated: bool = False) -> Column:
        raise NotImplementedError

    def mask(self, df: DataFrame) -> Column:
        return as_bool_mask(self.condition(df))

    def columns(self) -> set[str]:
        raise NotImplementedError


@dataclass(frozen=True)
class Leaf(Predicate):
    name: str
    op: str
    value: Any

    def columns(self) -> set[str]:
        return {self.name}

    def __str__(self) -> str:
        value = f'"{self.value}"' if isinstance(self.value, str) else str(self.value)
        return f"{self.name}.contains({value})" if self.op == "contains" else f"({self.name} {self.op} {value})"

    def condition(self, df: DataFrame, negated: bool = False) -> Column:
        need(df.columns, self.name)
        return self.over(F.col(f"`{self.name}`"), df.schema[self.name].dataType, negated)

    def over(self, c: Column, kind: T.DataType, negated: bool = False) -> Column:
        """The comparison of an expression of a given type."""
        value = self._value(kind)
        if value is None:  # values of another kind: never true
            return F.lit(negated)
        if self.op == "contains":
            return ~c.contains(value) | c.isNull() if negated else c.contains(value)
        real = isinstance(kind, (T.DoubleType, T.FloatType))
        if negated:
            out = _compare(c, _OPPOSITE[self.op], value) | c.isNull()
            return out | F.isnan(c) if real and self.op not in ("==", "!=") else out
        out = _compare(c, self.op, value)
        return out & ~F.isnan(c) if real and self.op in (">", ">=") else out  # NaN is no number here, and the largest in Spark

    def _value(self, kind: T.DataType) -> Any:
        v = self.value
        if self.op == "contains":
            return v if isinstance(kind, T.StringType) and isinstance(v, str) else None
        if isinstance(kind, T.BooleanType):
            return {"true": True, "false": False}.get(str(v).lower())
        if is_numeric(kind):
            if isinstance(v, bool):
                return None
            try:
                return v if isinstance(v, (int, float)) else float(v)
            except ValueError:
                return None
        if isinstance(kind, T.StringType):
            return v if isinstance(v, str) else None
        return v  # dates and the like: as Spark compares them


def _compare(c: Column, op: str, value: Any) -> Column:
    return {">": c > value, ">=": c >= value, "<": c < value, "<=": c <= value, "==": c == value, "!=": c != value}[op]


@dataclass(frozen=True)
class Missing(Predicate):
    name: str
    missing: bool = True

    def columns(self) -> set[str]:
        return {self.name}

    def __str__(self) -> str:
        return f"{self.name}.{'is_na' if self.missing else 'not_na'}()"

    def condition(self, df: DataFrame, negated: bool = False) -> Column:
        need(df.columns, self.name)
        c = F.col(f"`{self.name}`")
        return c.isNull() if self.missing != negated else c.isNotNull()


@dataclass(frozen=True)
class Both(Predicate):
    sign: str
    left: Predicate
    right: Predicate

    def columns(self) -> set[str]:
        return self.left.columns() | self.right.columns()

    def __str__(self) -> str:
        return f"({self.left} {self.sign} {self.right})"

    def condition(self, df: DataFrame, negated: bool = False) -> Column:
        x, y = self.left.condition(df, negated), self.right.condition(df, negated)
        return x & y if (self.sign == "&") != negated else x | y


@dataclass(frozen=True)
class Not(Predicate):
    inner: Predicate

    def columns(self) -> set[str]:
        return self.inner.columns()

    def __str__(self) -> str:
        return f"!{self.inner}"

    def condition(self, df: DataFrame, negated: bool = False) -> Column:
        return self.inner.condition(df, not negated)


class col:  # noqa: N801  reads like a function
    """A column in a predicate: ``col("x") > 5``, ``col("s").contains("a")``."""

    __hash__ = None  # type: ignore[assignment]

    def __init__(self, name: str):
        self.name = name

    def __gt__(self, value: Any) -> Predicate:
        return Leaf(self.name, ">", value)

    def __ge__(self, value: Any) -> Predicate:
        return Leaf(self.name, ">=", value)

    def __lt__(self, value: Any) -> Predicate:
        return Leaf(self.name, "<", value)

    def __le__(self, value: Any) -> Predicate:
        return Leaf(self.name, "<=", value)

    def __eq__(self, value: Any) -> Predicate:  # type: ignore[override]
        return Leaf(self.name, "==", value)

    def __ne__(self, value: Any) -> Predicate:  # type: ignore[override]
        return Leaf(self.name, "!=", value)

    def contains(self, part: str) -> Predicate:
        return Leaf(self.name, "contains", part)

    def is_na(self) -> Predicate:
        return Missing(self.name)

    def not_na(self) -> Predicate:
        return Missing(self.name, False)
