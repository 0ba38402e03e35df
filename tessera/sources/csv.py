"""CSV. Reading: every column is a number or text, decided by all of its values; several tokens mean missing."""

from __future__ import annotations

import csv as _csv
import io
import os
from collections.abc import Sequence
from dataclasses import dataclass
from typing import TYPE_CHECKING, Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import FileProblem
from ..functions.exprs import csv_text
from ..operators.ordered import HIDDEN, PLACE, name, ordering

if TYPE_CHECKING:
    from ..operators.frame import Frame

#: Fields that mean missing.
NA_VALUES = ("", "NA", "N/A", "NaN", "nan", "null", "NULL", "None", "none", ".")
#: What counts as a number. Spark's cast takes more (a trailing d or f).
NUMBER = r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|inf|Inf|INF|infinity|Infinity|INFINITY)\s*$"


@dataclass
class CSVReader:
    """separator, whether the first line names the columns (else col_0, col_1, ...), the fields that mean missing, and whether
    quoted fields may hold line ends: such a file is read by one task. None: looked up in a first pass, as a field that runs
    over a line end leaves that line with an odd number of quotes."""

    separator: str = ","
    header: bool = True
    na_values: Sequence[str] = NA_VALUES
    multi_line: bool | None = None

    def _options(self, reader: Any, multi_line: bool) -> Any:
        # empty fields, quoted or not, arrive as empty text and are judged below
        return reader.option("sep", self.separator).option("header", self.header).option("multiLine", multi_line).option("quote", '"').option("escape", '"').option("mode", "PERMISSIVE").option("emptyValue", "").option("nullValue", "").option("inferSchema", False)

    def read(self, spark: SparkSession, path: str) -> Frame:
        """From files in any file system Spark reads. Rows are in the order of the files and of their lines, by the column
        PLACE, which is worked out only where an order is needed."""
        try:
            many = self.multi_line
            if many is None:
                many = not spark.read.text(path).filter("(length(value) - length(replace(value, '\"', ''))) % 2 = 1").isEmpty()
            raw = self._options(spark.read, many).csv(path)
            place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("row"))
            names = raw.columns if self.header else [f"col_{k}" for k in range(len(raw.columns))]
            placed = raw.select(*[F.col(name(c)).alias(n) for c, n in zip(raw.columns, names, strict=True)], place.alias(PLACE))
            return self.typed(placed, [PLACE])
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                raise FileProblem(f"no file {path}") from e
            raise

    def read_text(self, spark: SparkSession, text: str) -> Frame:
        """From a string. Lines are split with quotes in mind, in the driver, which holds the string already."""
        from ..operators.frame import Frame

        rows = [r for r in _csv.reader(io.StringIO(text), delimiter=self.separator) if r]
        names = rows.pop(0) if self.header and rows else [f"col_{k}" for k in range(max(map(len, rows), default=0))]
        if not names:
            return Frame(spark.createDataFrame([], T.StructType([])))
        rows = [[*r[:len(names)], *[None] * (len(names) - len(r)), k] for k, r in enumerate(rows)]
        schema = T.StructType([*(T.StructField(n, T.StringType()) for n in names), T.StructField("__pos__", T.LongType())])
        d = self.typed(spark.createDataFrame(rows, schema)).df
        return Frame(d, ["__pos__"])

    def typed(self, df: DataFrame, order: Sequence[str] = ()) -> Frame:
        """Text columns with missing values made null, and those that hold numbers only as doubles: one pass over all
        columns decides. A column of nothing but missing values is a column of doubles."""
        from ..operators.frame import Frame

        names = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
        na = list(self.na_values)
        known = {n: F.when(~F.col(f"`{n}`").isin(na), F.col(f"`{n}`")) for n in names}
        if not names:
            return Frame(df, order)
        row = df.agg(*[F.coalesce(F.bool_and(F.coalesce(c.rlike(NUMBER), F.lit(True))), F.lit(True)).alias(f"_{k}") for k, c in enumerate(known.values())]).first()
        cols = {n: F.trim(c).try_cast("double") if row[k] else c for k, (n, c) in enumerate(known.items())}
        return Frame(df.select(*[cols[n].alias(n) if n in cols else F.col(f"`{n}`") for n in df.columns]), order)


def read_csv(spark: SparkSession, path: str, separator: str = ",", header: bool = True, na_values: Sequence[str] = NA_VALUES) -> Frame:
    return CSVReader(separator, header, na_values).read(spark, path)


def read_csv_text(spark: SparkSession, text: str, separator: str = ",", header: bool = True, na_values: Sequence[str] = NA_VALUES) -> Frame:
    return CSVReader(separator, header, na_values).read_text(spark, text)


def _texts(df: DataFrame) -> list[Column]:
    return [csv_text(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema]


def _number(x: Any) -> str:
    """A double that isn't whole, in the shortest digits that read back."""
    return repr(x)


def to_csv(frame: Frame, path: str | None = None, separator: str = ",", header: bool = True, index: bool = False, na: str = "", distributed: bool = False) -> str | None:
    """CSV text, or a file at ``path``. Whole numbers have no point, booleans are True and False, fields are quoted where
    they must be. index: a first column, without a name, of labels (or row numbers). With distributed=True ``path`` becomes
    a folder of part files, written by the executors; else rows stream through the driver."""
    order = [c for c in frame.order]
    hidden = [c for c in frame.columns if c in HIDDEN]
    df = frame.df.orderBy(*ordering(order)) if order and not frame._sorted() else frame.df
    shown = [c for c in df.columns if c not in hidden]
    if distributed:
        df.select(*[F.coalesce(c, F.lit(na)).alias(n) for c, n in zip(_texts(df.select(*shown)), shown, strict=True)]).write.option("sep", separator).option("header", header).option("quote", '"').option("escape", '"').option("emptyValue", na).csv(path)
        return None
    labels = index and "__idx__" in df.columns
    kinds = [df.schema[c].dataType for c in shown]
    rows = df.select(*[f"`{c}`" for c in [*shown, *(["__idx__"] if labels else [])]])

    def write(out: Any) -> None:
        writer = _csv.writer(out, delimiter=separator, lineterminator="\n", quoting=_csv.QUOTE_MINIMAL)
        if header:
            writer.writerow([*([""] if index else []), *shown])
        for k, r in enumerate(rows.toLocalIterator()):
            writer.writerow([*([r["__idx__"] if labels else k] if index else []), *(_field(r[j], kind, na) for j, kind in enumerate(kinds))])

    if path is None:
        out = io.StringIO()
        write(out)
        return out.getvalue()
    try:
        os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
        with open(path, "w", encoding="utf-8", newline="") as f:
            write(f)
    except OSError as e:
        raise FileProblem(str(e)) from e
    return None


def _field(v: Any, kind: T.DataType, na: str) -> str:
    if v is None:
        return na
    if isinstance(v, bool):
        return "True" if v else "False"
    if isinstance(v, float):
        return str(int(v)) if v == v and abs(v) < 1e15 and v == int(v) else _number(v)
    return str(v)
