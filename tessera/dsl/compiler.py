"""Operations to one lazy plan over a frame."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import TypeMismatch, need
from ..functions.exprs import cast_to, half_away_round, ieee_div, is_numeric, plain_double
from ..operators.frame import Frame
from ..operators.ordered import HIDDEN
from ..plans.predicate import Leaf
from .json_parser import parse_json
from .ops import Binary, Const, Name, Operation
from .parser import parse


def run_text(frame: Frame, chain: str) -> Frame:
    return compile_operations(frame, parse(chain))


def run_json(frame: Frame, text: str) -> Frame:
    return compile_operations(frame, parse_json(text))


def compile_operations(frame: Frame, operations: Sequence[Operation]) -> Frame:
    """The frame after all operations. Nothing runs here, so the optimizer sees the chain as a whole."""
    group = None
    for k, op in enumerate(operations):
        a = op.args
        if op.verb == "groupby":
            group = frame.group_by(*a)
        elif op.verb == "agg":
            frame, group = group.agg(*a), None
        elif op.verb == "filter":
            frame = frame.filter(Leaf(*a))
        elif op.verb == "sort":
            frame = frame.sort(*[c for c, _ in a], ascending=[up for _, up in a])
        elif op.verb == "select":
            later = {o.verb for o in operations[k + 1:]}
            place = [c for c in frame.order if c in HIDDEN and c not in a] if "tail" in later and "groupby" not in later else []
            frame = frame.select(*a, *place)  # where the last rows are asked for, the order goes along
        elif op.verb == "drop":
            need(frame.columns, *a)
            frame = frame.drop(*a)
        elif op.verb == "rename":
            frame = frame.rename({a[0]: a[1]})
        elif op.verb == "head":
            frame = frame.head(a[0])
        elif op.verb == "tail":
            frame = frame.tail(a[0])
        elif op.verb == "round":
            need(frame.columns, a[0])
            if isinstance(frame.df.schema[a[0]].dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
                frame = frame.with_column(a[0], half_away_round(F.col(f"`{a[0]}`"), a[1]))
        elif op.verb == "derive":
            frame = frame.with_column(a[0], to_column(frame, a[1]))
        elif op.verb == "cast":
            need(frame.columns, a[0])
            frame = frame.with_column(a[0], cast_to(F.col(f"`{a[0]}`"), a[1], frame.df.schema[a[0]].dataType))
    return frame if group is None else group.count()  # a chain that ends in groupby counts


def to_column(frame: Frame, e: Name | Const | Binary) -> Column:
    """An expression as a column; arithmetic is in doubles, division by IEEE rules."""
    if isinstance(e, Const):
        return F.lit(e.value)
    if isinstance(e, Name):
        need(frame.columns, e.name)
        return F.col(f"`{e.name}`")
    for side in (e.left, e.right):
        kind = frame.df.schema[side.name].dataType if isinstance(side, Name) and side.name in frame.columns else None
        if isinstance(side, Const) and isinstance(side.value, str) or kind is not None and not is_numeric(kind):
            raise TypeMismatch(f"{e.op} needs numbers, not {getattr(side, 'name', None) or repr(side.value)}")
    x, y = plain_double(to_column(frame, e.left)), plain_double(to_column(frame, e.right))
    return {"+": x + y, "-": x - y, "*": x * y, "/": ieee_div(x, y)}[e.op]
