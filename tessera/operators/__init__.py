"""Frames, series, grouping, joins, statistics and ordered operations."""

from .frame import Frame, concat
from .groupby import GroupBy
from .index import Index
from .series import Series

__all__ = ["Frame", "GroupBy", "Index", "Series", "concat"]
