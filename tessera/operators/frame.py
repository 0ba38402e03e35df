"""The frame: a Spark DataFrame with a pandas-like interface and, where one is declared, a row order."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ColumnNotFound, IndexOutOfRange, KeyColumnNotFound, LengthMismatch, TypeMismatch, need
from ..functions.exprs import numeric_columns
from ..plans.lazy import LazyFrame
from ..plans.predicate import Predicate
from . import ordered, stats
from .groupby import GroupBy
from .series import Series

HOW = {"inner": "inner", "left": "left", "right": "right", "outer": "full"}
_KINDS = ((bool, T.BooleanType()), (int, T.LongType()), (float, T.DoubleType()), (str, T.StringType()))


class Frame:
    """df: the data, lazy. order: the columns that put rows in order, for what depends on it (head without a sort, tail,
    positions, running sums, keeping first rows). index: a column with row labels. rows: the data without the sort that df
    may end with, for what puts rows in order itself."""

    def __init__(self, df: DataFrame, order: Sequence[str] = (), index: str | None = None):
        self.df, self.index = df, index
        self.rows = df
        self.order = tuple(order) if set(order) <= set(df.columns) else ()

    def _with(self, df: DataFrame, order: Sequence[str] | None = None) -> Frame:
        return type(self)(df, self.order if order is None else order, self.index if self.index in df.columns else None)

    # construction

    @classmethod
    def from_columns(cls, spark: SparkSession, columns: Mapping[str, Sequence[Any]], index: Sequence[str] | None = None) -> Frame:
        """Columns of plain values (None is missing), all of one length. Rows are in order of ``__pos__``, a column of
        positions, unless labels are given: then ``__idx__`` has those as well."""
        if len({len(v) for v in columns.values()} | ({len(index)} if index is not None else set())) > 1:
            raise LengthMismatch("columns differ in length")
        data = dict(columns)
        fields = [T.StructField(k, _kind_of(k, v), True) for k, v in data.items()]
        if index is not None:
            fields.append(T.StructField("__idx__", T.StringType(), True))
            data["__idx__"] = list(index)
        n = len(next(iter(data.values()), ()))
        fields.append(T.StructField(ordered.POSITION, T.LongType(), False))
        values = [[float(x) if isinstance(f.dataType, T.DoubleType) and x is not None else x for x in v] for f, v in zip(fields, data.values(), strict=False)]
        rows = list(zip(*values, range(n), strict=True)) if values else []
        return cls(spark.createDataFrame(rows, T.StructType(fields)), [ordered.POSITION], "__idx__" if index is not None else None)

    @classmethod
    def from_records(cls, spark: SparkSession, records: Sequence[Mapping[str, Any]]) -> Frame:
        """Rows as mappings: the union of their keys, sorted; absent values are missing."""
        names = sorted({k for r in records for k in r})
        return cls.from_columns(spark, {n: [r.get(n) for r in records] for n in names})

    # schema

    @property
    def columns(self) -> list[str]:
        return self.df.columns

    @property
    def data_columns(self) -> list[str]:
        """The columns without those that only say where a row stands or what it is called."""
        return [c for c in self.columns if c not in ordered.HIDDEN]

    @property
    def dtypes(self) -> dict[str, str]:
        return dict(self.df.dtypes)

    @property
    def shape(self) -> tuple[int, int]:
        return self.df.count(), len(self.columns)

    @property
    def is_empty(self) -> bool:
        return self.df.isEmpty()

    def estimated_bytes(self) -> int:
        """The optimizer's estimate of the plan's size."""
        return int(str(self.df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))

    # columns

    def __getitem__(self, key: str | Predicate | Column) -> Any:
        if isinstance(key, str):
            return self.column(key)
        return self.filter(key)

    def column(self, name: str) -> Series:
        need(self.columns, name)
        return Series(self, F.col(f"`{name}`"), name)

    def select(self, *names: str) -> Frame:
        need(self.columns, *names)
        return self._with(self.df.select(*[ordered.name(n) for n in names]))

    def drop(self, *names: str) -> Frame:
        """Without the named columns; names that are no columns are passed over."""
        return self._with(self.df.drop(*names))

    def rename(self, names: Mapping[str, str]) -> Frame:
        need(self.columns, *names)
        return self._with(self.df.withColumnsRenamed(dict(names)), [type(c)(names.get(c, c)) for c in self.order])

    def with_column(self, name: str, value: Column | Series | Any) -> Frame:
        """The frame with a column set or added: an expression, a series of this frame, or a constant. Changing a key of the
        row order ends that order; rows that are sorted stay so."""
        if isinstance(value, Series):
            if value.frame.df is not self.df:
                raise LengthMismatch("the series belongs to another frame; join on a key instead")
            value = value.expr
        return self._with(self.df.withColumn(name, value if isinstance(value, Column) else F.lit(value)), () if name in self.order else None)

    def apply(self, f: Callable[[Column], Column], columns: Sequence[str] | None = None) -> Frame:
        """f, from Column to Column, on every numeric column or those named."""
        names = numeric_columns(self.df) if columns is None else columns
        need(self.columns, *names)
        return self._with(self.df.withColumns({n: f(F.col(f"`{n}`")) for n in names}), () if set(names) & set(self.order) else None)

    # rows

    def filter(self, condition: Predicate | Column | Series) -> Frame:
        """Rows for which the condition holds; where it is null, it doesn't."""
        if isinstance(condition, Predicate):
            condition = condition.condition(self.df)
        elif isinstance(condition, Series):
            condition = condition.expr
        return self._with(self.df.filter(condition))

    def head(self, n: int = 5) -> Frame:
        d = self.df.orderBy(*ordered.ordering(self.order)) if self.order and not self._sorted() else self.df
        return self._with(d.limit(max(0, n)))

    def _sorted(self) -> bool:
        return self.df._jdf.queryExecution().analyzed().getClass().getSimpleName() == "Sort"

    def tail(self, n: int = 5) -> Frame:
        """The last n rows by the frame's order; two top-n steps, no full sort."""
        last = self.df.orderBy(*ordered.ordering(self._need_order(), backwards=True)).limit(max(0, n))
        return self._with(last.orderBy(*ordered.ordering(self.order)))

    def _need_order(self) -> list[str]:
        if not self.order:
            raise TypeMismatch("this needs a row order: Frame(df, order=[...])")
        return list(self.order)

    def with_position(self) -> Frame:
        if ordered.POSITION in self.columns:
            return self
        return self._with(ordered.with_position(self.rows, self._need_order()))

    def iloc(self, at: int | slice | Sequence[int]) -> Any:
        """A row by position (a dict), a range of rows, or rows at the given positions in that order (beyond the end: rows
        of missing values)."""
        placed = self.with_position().df
        pos = F.col(ordered.POSITION)
        if isinstance(at, slice):
            d = placed.filter(pos >= (at.start or 0))
            return self._with((d if at.stop is None else d.filter(pos < at.stop)).drop(*([ordered.POSITION] if ordered.POSITION not in self.columns else [])))
        if isinstance(at, int):
            row = placed.filter(pos == at).first()
            if row is None:
                raise IndexOutOfRange(f"no row {at}")
            return {c: row[c] for c in self.columns}
        wanted = self.df.sparkSession.createDataFrame([(k, p) for k, p in enumerate(at)], "__k long, __p long")
        taken = F.broadcast(wanted).join(placed, F.col("__p") == pos, "left").orderBy("__k")
        return type(self)(taken.select(*self.columns, "__k"), ["__k"], self.index).drop("__p")

    take = iloc

    def loc(self, label: str | Sequence[str]) -> Any:
        """The first row with a label (a dict), or the first rows with each of the labels, in that order; labels that
        aren't there are passed over."""
        if self.index is None:
            raise KeyColumnNotFound("__idx__", self.columns)
        labels = [label] if isinstance(label, str) else list(label)
        placed = self.with_position().df.filter(F.col(self.index).isin(labels))
        first = placed.groupBy(self.index).agg(F.min_by(F.struct(*self.columns), ordered.POSITION).alias("row")).select("row.*")
        if isinstance(label, str):
            row = first.first()
            if row is None:
                raise IndexOutOfRange(f"no label {label!r}")
            return row.asDict()
        wanted = self.df.sparkSession.createDataFrame(list(enumerate(labels)), "__k long, __label string")
        return type(self)(first.join(F.broadcast(wanted), F.col(self.index) == F.col("__label")).drop("__label"), ["__k"], self.index)

    def __iter__(self) -> Iterator[dict[str, Any]]:
        d = self.df.orderBy(*ordered.ordering(self.order)) if self.order and not self._sorted() else self.df
        return (r.asDict() for r in d.toLocalIterator())

    def equals(self, other: Frame) -> bool:
        """The same columns with the same rows: in the same order where both have one, else in whatever order."""
        a, b = (f.with_position() if self.order and other.order else f for f in (self, other))
        place = [ordered.POSITION] if self.order and other.order else []
        a, b = (f.df.select(*[ordered.name(c) for c in [*f.data_columns, *place]]) for f in (a, b))
        if a.dtypes != b.dtypes:
            return False
        return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()

    # order

    def sort(self, *by: str, ascending: bool | Sequence[bool] = True) -> Frame:
        """Sorted rows, missing values last either way. The keys are the order from then on; ties keep the order before."""
        need(self.columns, *by)
        flags = [ascending] * len(by) if isinstance(ascending, bool) else list(ascending)
        if len(flags) != len(by):
            raise LengthMismatch("as many directions as columns are needed")
        keys = [c if up else ordered.Desc(c) for c, up in zip(by, flags, strict=True)]
        keys += [c for c in self.order if c not in keys]
        out = self._with(self.df.orderBy(*ordered.ordering(keys)), keys)
        out.rows = self.rows
        return out

    def top_k(self, k: int, *by: str, ascending: bool = False) -> Frame:
        return self.sort(*by, ascending=ascending).head(k)

    def cumsum(self, column: str, out: str | None = None, kind: str = "double") -> Frame:
        return self._with(ordered.cumsum(self.df, column, self._need_order(), out or column, kind))

    def duplicated(self, subset: Sequence[str] | None = None, out: str = "duplicated") -> Frame:
        return self._with(ordered.duplicated(self.df, list(subset or self.data_columns), self._need_order(), out))

    def drop_duplicates(self, subset: Sequence[str] | None = None) -> Frame:
        return self._with(ordered.drop_duplicates(self.df, list(subset or self.columns), self._need_order()))

    # combination

    def merge(self, right: Frame, on: str | Sequence[str], how: str = "inner") -> Frame:
        """An equi-join on columns of the same name. Left columns come first, right columns of the same name get
        ``_right``. Keys of different kinds are compared as doubles or text; a null key matches nothing."""
        keys = [on] if isinstance(on, str) else list(on)
        need(self.columns, *keys, kind=KeyColumnNotFound)
        need(right.columns, *keys, kind=KeyColumnNotFound)
        if how not in HOW:
            raise TypeMismatch(f"how is one of {', '.join(HOW)}")
        left_df, right_df = self.df, right.df
        for k in keys:
            a, b = left_df.schema[k].dataType, right_df.schema[k].dataType
            if a != b:
                common = "double" if isinstance(a, T.NumericType) and isinstance(b, T.NumericType) else "string"
                left_df, right_df = left_df.withColumn(k, F.col(k).cast(common)), right_df.withColumn(k, F.col(k).cast(common))
        right_df = right_df.withColumnsRenamed({c: f"{c}_right" for c in right.columns if c in self.columns and c not in keys})
        joined = left_df.join(right_df, on=keys, how=HOW[how])
        return self._with(joined.select(*[f"`{c}`" for c in [*self.columns, *[c for c in right_df.columns if c not in keys]]]))

    def group_by(self, *keys: str) -> GroupBy:
        return GroupBy(self, keys)

    # statistics

    def reduce(self, what: str, ddof: int = 1) -> Frame:
        return type(self)(stats.reduce_columns(self.df, what, ddof))

    def sum(self) -> Frame:
        return self.reduce("sum")

    def mean(self) -> Frame:
        return self.reduce("mean")

    def std(self, ddof: int = 1) -> Frame:
        return self.reduce("std", ddof)

    def min(self) -> Frame:
        return self.reduce("min")

    def max(self) -> Frame:
        return self.reduce("max")

    def median(self) -> Frame:
        return self.reduce("median")

    def describe(self) -> Frame:
        return type(self)(stats.describe(self.df))

    def lazy(self) -> LazyFrame:
        return LazyFrame(self)

    # output

    def to_csv(self, path: str | None = None, **options: Any) -> str | None:
        from ..sources.csv import to_csv

        return to_csv(self, path, **options)

    def to_json(self, path: str | None = None) -> str | None:
        from ..sources.json import to_json

        return to_json(self, path)

    def show(self, n: int = 20) -> str:
        from ..sources.display import box

        return box(self, n)


def _kind_of(name: str, values: Sequence[Any]) -> T.DataType:
    found = {type(v) for v in values if v is not None}
    if found <= {int, float} and float in found:
        return T.DoubleType()
    for kind, spark_kind in _KINDS:
        if found == {kind}:
            return spark_kind
    if not found:
        return T.DoubleType()
    raise TypeMismatch(f"values of {name!r} are of several kinds: {', '.join(sorted(k.__name__ for k in found))}")


def concat(frames: Sequence[Frame], spark: SparkSession | None = None) -> Frame:
    """All rows, with the first frame's columns by name: absent ones are missing values, further ones are left out. The
    same name with another type is an error."""
    if not frames:
        session = spark or SparkSession.getActiveSession()
        return Frame(session.createDataFrame([], T.StructType([])))
    first = frames[0]
    kinds = dict(first.df.dtypes)
    chosen = []
    for f in frames:
        for c, k in f.df.dtypes:
            if c in kinds and kinds[c] != k:
                raise TypeMismatch(f"{c!r} is {kinds[c]} in the first frame and {k} in another")
        chosen.append(f.df.select(*[f"`{c}`" for c in f.columns if c in kinds]))
    return first._with(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), chosen).select(*first.columns))


__all__ = ["ColumnNotFound", "Frame", "concat"]
