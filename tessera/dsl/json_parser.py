"""The JSON form: {"operations": [{"op": "filter", "args": {...}}, ...]}."""

from __future__ import annotations

import json
from typing import Any

from ..errors import InvalidJSON, ParseError, UnknownOperation
from ..functions.exprs import CASTS
from ..operators.groupby import FUNCTIONS
from ..plans.predicate import OPERATORS
from .ops import HELP, Operation
from .parser import checked, parse_expression

#: Arguments of each operation, for messages.
SHAPES = {
    "filter": '{"column": name, "operator": op, "value": value}',
    "sort": '{"columns": [name or {"column": name, "descending": bool}]} or {"column": name, "descending": bool}',
    "groupby": '{"columns": [name, ...]}',
    "agg": '{"aggregations": [{"function": name, "column": name}, ...]} or {function: column, ...}',
    "select": '{"columns": [name, ...]}',
    "drop": '{"columns": [name, ...]}',
    "rename": '{"from": name, "to": name}',
    "head": '{"n": number}',
    "tail": '{"n": number}',
    "round": '{"column": name, "digits": number}',
    "derive": '{"column": name, "expression": text}',
    "cast": '{"column": name, "type": type}',
}


def parse_json(text: str) -> list[Operation]:
    try:
        data = json.loads(text)
    except ValueError as e:
        raise InvalidJSON(str(e)) from e
    steps = data.get("operations") if isinstance(data, dict) else None
    if not isinstance(steps, list):
        raise InvalidJSON('an object with a list "operations" is needed')
    out = []
    for k, step in enumerate(steps):
        verb = step.get("op") if isinstance(step, dict) else None
        if verb not in HELP:
            raise UnknownOperation(f"operation {k + 1}: no operation named {verb!r}; there are: {', '.join(HELP)}")
        try:
            out.append(Operation(verb, _ARGS[verb](step.get("args", {k: v for k, v in step.items() if k != "op"}))))
        except (KeyError, TypeError, AttributeError, IndexError) as e:
            raise ParseError(f"operation {k + 1}, {verb}: args should be {SHAPES[verb]}") from e
    return checked(out)


def _one(args: Any, *names: str) -> Any:
    for n in names:
        if n in args:
            return args[n]
    raise KeyError(names[0])


def _list(args: Any) -> tuple[str, ...]:
    found = args if isinstance(args, list) else _one(args, "columns", "column", "by")
    found = [found] if isinstance(found, str) else found
    if not found or not all(isinstance(x, str) for x in found):
        raise TypeError
    return tuple(found)


def _filter(args: Any) -> tuple:
    op, value = _one(args, "operator", "op"), _one(args, "value")
    if op not in OPERATORS:
        raise ParseError(f"filter: no operator {op!r}; there are: {' '.join(OPERATORS)}")
    if isinstance(value, bool):
        value = str(value).lower()
    elif isinstance(value, float) and value == int(value):
        value = int(value)
    return _one(args, "column"), op, value


def _sort(args: Any) -> tuple:
    found = args if isinstance(args, list) else args["columns"] if "columns" in args else [args]
    up = lambda x: not x.get("descending", x.get("order", "asc") == "desc" or not x.get("ascending", True))
    whole = up(args) if isinstance(args, dict) else True
    return tuple((x, whole) if isinstance(x, str) else (x["column"], up(x)) for x in found)


def _agg(args: Any) -> tuple:
    found = args.get("aggregations", args) if isinstance(args, dict) else args
    if isinstance(found, dict):
        pairs = [(f, c) for f, cs in found.items() for c in ([cs] if isinstance(cs, str) else cs)]
    else:
        pairs = [(_one(x, "function", "fn", "func"), x["column"]) for x in found]
    for f, _ in pairs:
        if f not in FUNCTIONS:
            raise UnknownOperation(f"agg: no function named {f!r}; there are: {', '.join(FUNCTIONS)}")
    return tuple(pairs)


def _whole(x: Any) -> int:
    if isinstance(x, bool) or x != int(x):
        raise TypeError
    return int(x)


def _cast(args: Any) -> tuple:
    kind = _one(args, "type", "to", "dtype")
    if kind.lower() not in CASTS:
        raise ParseError(f"cast: no type {kind!r}; there are: Int, Double, Float, String")
    return _one(args, "column"), kind


_ARGS = {
    "filter": _filter, "sort": _sort, "groupby": _list, "agg": _agg, "select": _list, "drop": _list,
    "rename": lambda a: (_one(a, "from", "old"), _one(a, "to", "new")),
    "head": lambda a: (_whole(_one(a, "n", "count")),), "tail": lambda a: (_whole(_one(a, "n", "count")),),
    "round": lambda a: (_one(a, "column"), _whole(_one(a, "digits", "decimals"))),
    "derive": lambda a: (_one(a, "column", "name"), parse_expression(_one(a, "expression"))),
    "cast": _cast,
}
