"""JSON records: an array of objects."""

from __future__ import annotations

import json as _json
from typing import TYPE_CHECKING

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import FileProblem, InvalidJSON
from ..operators.ordered import HIDDEN, PLACE, ordering

if TYPE_CHECKING:
    from ..operators.frame import Frame


def read_json(spark: SparkSession, path: str) -> Frame:
    """From a file or folder in any file system Spark reads. Anything but arrays of objects raises InvalidJSON."""
    from ..operators.frame import Frame

    try:
        raw = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("file"))
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            raise FileProblem(f"no file {path}") from e
        raise
    maps = raw.select(F.from_json("value", "array<map<string,string>>", {"mode": "PERMISSIVE"}).alias("x"), "value", "file")
    bad = maps.filter(F.col("x").isNull() | ~F.col("value").rlike(r"(?s)^\s*\["))
    if not bad.isEmpty():
        raise InvalidJSON("an array of objects is needed")
    records = maps.select("file", F.posexplode("x").alias("row", "x"))
    keys = sorted(r[0] for r in records.select(F.explode(F.map_keys("x"))).distinct().collect())  # column names
    place = F.struct("file", F.lit(0).cast("long").alias("start"), F.col("row").cast("long").alias("row"))
    flat = records.select(*[F.try_element_at("x", F.lit(k)).alias(k) for k in keys], place.alias(PLACE))
    kinds = _kinds(spark, path, keys)
    return Frame(flat.select(*[_typed(k, kinds[k]) for k in keys], PLACE), [PLACE]) if keys else Frame(spark.createDataFrame([], T.StructType([])))


def _kinds(spark: SparkSession, path: str, keys: list[str]) -> dict[str, str]:
    """number, bool or text by all values of a key: text in quotes stays text even if it looks like a number."""
    fields = {f.name: f.dataType for f in spark.read.option("multiLine", True).json(path).schema} if keys else {}
    return {k: "number" if isinstance(fields.get(k), T.NumericType) else "bool" if isinstance(fields.get(k), T.BooleanType) else "text" for k in keys}


def _typed(name: str, kind: str):
    c = F.col(f"`{name}`")
    return (c.try_cast("double") if kind == "number" else c.try_cast("boolean") if kind == "bool" else c).alias(name)


def read_json_text(spark: SparkSession, text: str) -> Frame:
    """From a string."""
    from ..operators.frame import Frame

    try:
        records = _json.loads(text)
    except ValueError as e:
        raise InvalidJSON(str(e)) from e
    if not isinstance(records, list) or not all(isinstance(r, dict) for r in records):
        raise InvalidJSON("an array of objects is needed")
    if not records:
        return Frame(spark.createDataFrame([], T.StructType([])))
    names = sorted({k for r in records for k in r})
    columns = {n: [r.get(n) for r in records] for n in names}
    for n, values in columns.items():
        kinds = {type(v) for v in values if v is not None}
        if kinds and kinds <= {int, float}:
            columns[n] = [None if v is None else float(v) for v in values]
        elif kinds != {bool}:
            columns[n] = [None if v is None else v if isinstance(v, str) else _json.dumps(v) for v in values]
    return Frame.from_columns(spark, columns)


def to_json(frame: Frame, path: str | None = None) -> str | None:
    """Records with sorted keys, missing values as null, indented; text or a file at ``path``. Rows stream through the
    driver."""
    shown = sorted(c for c in frame.columns if c not in HIDDEN)
    df = frame.df.orderBy(*ordering(frame.order)) if frame.order and not frame._sorted() else frame.df
    rows = df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in shown]), {"ignoreNullFields": "false"}).alias("j")).toLocalIterator() if shown else []
    text = _json.dumps([_plain(_json.loads(r["j"])) for r in rows], indent=2, sort_keys=True, ensure_ascii=False)
    if path is None:
        return text
    try:
        with open(path, "w", encoding="utf-8") as f:
            f.write(text)
    except OSError as e:
        raise FileProblem(str(e)) from e
    return None


def _plain(record: dict) -> dict:
    """Whole doubles as integers."""
    return {k: int(v) if isinstance(v, float) and v == v and abs(v) < 1e15 and v == int(v) else v for k, v in record.items()}
