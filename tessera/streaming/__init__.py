"""The verbs that keep no state, on streams: a chain is a function of frames, so it runs on ``readStream`` unchanged."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..dsl.compiler import compile_operations
from ..dsl.parser import parse
from ..errors import TypeMismatch
from ..operators.frame import Frame

STATELESS = frozenset({"filter", "select", "drop", "rename", "derive", "round", "cast"})


def pipe_stream(stream: DataFrame, chain: str) -> DataFrame:
    """A streaming frame after a chain of verbs that look at one row at a time."""
    found = parse(chain)
    for op in found:
        if op.verb not in STATELESS:
            raise TypeMismatch(f"{op.verb} needs all rows; a stream has no end")
    return compile_operations(Frame(stream), found).df


__all__ = ["STATELESS", "pipe_stream"]
