"""Typed errors of the engine. Misuse raises; nothing is silently skipped."""

from __future__ import annotations


class EngineError(Exception):
    """Base of all errors. ``code`` is stable and goes over the wire; ``exit_code`` is the command line's."""

    code, exit_code = "internal", 1


class ColumnNotFound(EngineError):
    code, exit_code = "unknown_column", 5

    def __init__(self, name: str, have: list[str] | None = None):
        super().__init__(f"no column named {name!r}" + (f"; there are: {', '.join(have)}" if have else ""))


class TypeMismatch(EngineError):
    code, exit_code = "type_mismatch", 5


class LengthMismatch(EngineError):
    code = "length_mismatch"


class IndexOutOfRange(EngineError):
    code = "index_out_of_range"


class KeyColumnNotFound(ColumnNotFound):
    code = "unknown_key_column"


class InvalidJSON(EngineError):
    code, exit_code = "invalid_json", 4


class ParseError(EngineError):
    code, exit_code = "parse_error", 4


class UnknownOperation(ParseError):
    code = "unknown_operation"


class AggWithoutGroupBy(ParseError):
    code = "agg_without_groupby"


class FrameNotFound(EngineError):
    code, exit_code = "unknown_dataframe", 6


class FileProblem(EngineError):
    code, exit_code = "file_error", 3


class ProtocolError(EngineError):
    code, exit_code = "protocol", 2


def need(columns: list[str], *names: str, kind: type[ColumnNotFound] = ColumnNotFound) -> None:
    """Raises for the first of ``names`` that is no column."""
    for n in names:
        if n not in columns:
            raise kind(n, list(columns))
