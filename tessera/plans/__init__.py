"""Predicates and lazy chains."""

from .lazy import LazyFrame
from .predicate import Predicate, col

__all__ = ["LazyFrame", "Predicate", "col"]
