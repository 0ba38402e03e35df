"""Indexes of their own: labels with positions, looked up without a frame."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import IndexOutOfRange, TypeMismatch


class Index:
    """df has ``label`` and ``pos`` (0, 1, ...). A range is a plan without data."""

    def __init__(self, df: DataFrame):
        self.df = df

    @classmethod
    def range(cls, spark: SparkSession, start: int, stop: int, step: int = 1) -> Index:
        if step == 0:
            raise TypeMismatch("the step of a range isn't 0")
        n = max(0, -(-(stop - start) // step))
        return cls(spark.range(n).select((F.col("id") * step + start).alias("label"), F.col("id").alias("pos")))

    @classmethod
    def of(cls, spark: SparkSession, labels: Sequence[str] | Sequence[int]) -> Index:
        kinds = {type(x) for x in labels}
        if len(kinds) > 1 or not kinds <= {int, str}:
            raise TypeMismatch("labels are all text or all integers")
        return cls(spark.createDataFrame([(x, k) for k, x in enumerate(labels)], f"label {'long' if kinds == {int} else 'string'}, pos long"))

    @property
    def values(self) -> list[Any]:
        return [r["label"] for r in self.df.orderBy("pos").collect()]

    @property
    def count(self) -> int:
        return self.df.count()

    def get_location(self, label: Any) -> int | None:
        """The first position of a label, or None."""
        return self.df.filter(F.col("label") == label).agg(F.min("pos")).first()[0]

    def contains(self, label: Any) -> bool:
        return not self.df.filter(F.col("label") == label).isEmpty()

    def __getitem__(self, pos: int) -> Any:
        row = self.df.filter(F.col("pos") == pos).first()
        if row is None:
            raise IndexOutOfRange(f"no position {pos}")
        return row["label"]

    @property
    def is_unique(self) -> bool:
        return self.df.groupBy("label").count().filter("count > 1").isEmpty()
