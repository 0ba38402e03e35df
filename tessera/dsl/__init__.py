"""The pipe language: filter(...) | groupby(...) | agg(...) | sort(...), as text or JSON."""

from .compiler import compile_operations, run_json, run_text
from .json_parser import parse_json
from .parser import parse

__all__ = ["compile_operations", "parse", "parse_json", "run_json", "run_text"]
