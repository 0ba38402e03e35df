"""Lazy chains. Spark frames are lazy already, so a chain is a frame with a plan that can be looked at."""

from __future__ import annotations

from typing import TYPE_CHECKING, Any

if TYPE_CHECKING:
    from ..operators.frame import Frame
    from .predicate import Predicate


class LazyFrame:
    def __init__(self, frame: Frame):
        self._frame = frame

    def filter(self, predicate: Predicate) -> LazyFrame:
        return LazyFrame(self._frame.filter(predicate))

    def select(self, *columns: Any) -> LazyFrame:
        names = [c for x in columns for c in ([x] if isinstance(x, str) else x)]
        return LazyFrame(self._frame.select(*names))

    def drop(self, *columns: str) -> LazyFrame:
        return LazyFrame(self._frame.drop(*columns))

    def sort(self, *by: str, ascending: bool | list[bool] = True) -> LazyFrame:
        return LazyFrame(self._frame.sort(*by, ascending=ascending))

    def head(self, n: int = 5) -> LazyFrame:
        return LazyFrame(self._frame.head(n))

    limit = head

    def group_by(self, *keys: str) -> LazyGroup:
        return LazyGroup(self._frame, keys)

    def merge(self, right: Frame | LazyFrame, on: str, how: str = "inner") -> LazyFrame:
        other = right._frame if isinstance(right, LazyFrame) else right
        return LazyFrame(self._frame.merge(other, on=on, how=how))

    def collect(self) -> Frame:
        """The frame; nothing has run yet, and an action on it runs the whole chain as one plan."""
        return self._frame

    def explain(self) -> str:
        """The optimized plan."""
        return self._frame.df._jdf.queryExecution().optimizedPlan().toString()

    def explain_raw(self) -> str:
        """The plan as written."""
        return self._frame.df._jdf.queryExecution().logical().toString()


class LazyGroup:
    def __init__(self, frame: Frame, keys: tuple[str, ...]):
        self._group = frame.group_by(*keys)

    def _of(self, name: str) -> LazyFrame:
        return LazyFrame(getattr(self._group, name)())

    def sum(self) -> LazyFrame:
        return self._of("sum")

    def mean(self) -> LazyFrame:
        return self._of("mean")

    def count(self) -> LazyFrame:
        return self._of("count")

    def min(self) -> LazyFrame:
        return self._of("min")

    def max(self) -> LazyFrame:
        return self._of("max")
