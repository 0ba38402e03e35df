"""Operations of the pipe language and expressions in them."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

#: Verbs with their syntax, for help and error messages.
HELP = {
    "filter": 'filter(column op value)   op: > >= < <= == != contains',
    "sort": "sort(a) or sort(a, desc) or sort(a asc, b desc)",
    "groupby": "groupby(a, b)   followed by agg(...); at the end of a chain it counts",
    "agg": "agg(sum:a, mean:b, ...)   sum mean count min max std median",
    "select": "select(a, b)",
    "drop": "drop(a, b)",
    "rename": "rename(old -> new)",
    "head": "head(n)",
    "tail": "tail(n)",
    "round": "round(column, digits)",
    "derive": "derive(new = expression)   + - * / ( ) numbers, columns, \"text\"",
    "cast": "cast(column, Int | Double | Float | String)",
}


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Const:
    value: float | str


@dataclass(frozen=True)
class Binary:
    op: str
    left: Name | Const | Binary
    right: Name | Const | Binary


@dataclass(frozen=True)
class Operation:
    verb: str
    args: tuple[Any, ...]
