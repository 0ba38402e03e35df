"""Operations that need a row order. The order is always named; it never is the order of a scan.

Positions and running sums are found per range of the order keys together, so that ties of the first key, missing values too,
are told apart by the next: the ranges' bounds (fewer than BUCKETS, literals in the plan) are drawn from random rows, every row
is ranked inside its range, and the ranges' totals, a few rows, are added. So no task sorts all rows, and the bounds decide
only which task ranks a row. Rows that tie in all keys are dealt by a hash of their other columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import need

POSITION = "__pos__"
#: A row's place in the files it was read from: file, start of the block, number in the block.
PLACE = "__at__"
#: Columns that say where a row stands or what it is called; no part of the data.
HIDDEN = (POSITION, PLACE, "__idx__", "__k")
BUCKETS = 64
#: Rows drawn for each bound.
DRAWN = 64
#: Types whose values can stand in a plan.
LITERAL = (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType, T.StringType, T.BooleanType)


class Desc(str):
    """The name of an order key whose largest value comes first."""


def name(column: str) -> str:
    """A column name quoted, as it may hold points."""
    return f"`{column.replace('`', '``')}`"


def ordering(keys: list[str], backwards: bool = False) -> list[Column]:
    """Order by keys, missing values last either way; ``backwards`` the exact reverse."""
    out = []
    for k in keys:
        down = isinstance(k, Desc)
        c = F.col(name(k))
        out.append((c.asc_nulls_first() if down else c.desc_nulls_first()) if backwards else c.desc_nulls_last() if down else c.asc_nulls_last())
    return out


def _placed(df: DataFrame, order: list[str]) -> tuple[DataFrame, list[str]]:
    """df and ascending order keys: with a key that goes down, positions."""
    return (with_position(df, order, "__place"), ["__place"]) if any(isinstance(k, Desc) for k in order) else (df, order)


def _parts(df: DataFrame, order: list[str]) -> list[tuple[str, str, bool]]:
    """What the order keys compare by, as far as it can stand in a plan: SQL text, type, whether the largest comes first. A
    row's place has its fields."""
    out = []
    for k in order:
        kind = df.schema[k].dataType
        fields = [(f"{name(k)}.{name(f.name)}", f.dataType) for f in kind.fields] if k == PLACE else [(name(k), kind)]
        for c, t in fields:
            if not isinstance(t, LITERAL):
                return out
            out.append((c, t.simpleString(), isinstance(k, Desc)))
    return out


def _is_after(row: list[tuple[str, str, bool]], bound: list[str | None]) -> str:
    """The row comes after a bound (values as text) in order, missing values last."""
    out = ""
    for (c, kind, down), v in reversed(list(zip(row, bound, strict=True))):
        at = "NULL" if v is None else f"CAST(CAST(X'{v.encode().hex()}' AS STRING) AS {kind})"
        tied = f"{c} <=> {at} AND ({out})" if out else ""
        beyond = "" if v is None else f"{c} IS NULL OR {c} {'<' if down else '>'} {at}"
        out = " OR ".join(x for x in (beyond, tied) if x) or "false"
    return out


def _bucket(df: DataFrame, order: list[str], buckets: int) -> Column:
    """The number of a row's range of the keys; ranges are in order. Rows of files: the block."""
    if order[0] == PLACE:
        return F.struct(F.col(PLACE)["file"], F.col(PLACE)["start"])
    parts = _parts(df, order)
    if buckets < 2 or not parts:
        return F.lit(0)
    others = [name(f.name) for f in df.schema if f.name not in order and isinstance(f.dataType, LITERAL)]
    if len(parts) >= len(order) and others:
        parts.append((f"xxhash64({', '.join(others)})", "bigint", False))
    keys = [F.expr(c).alias(f"_{k}") for k, (c, _, _) in enumerate(parts)]
    by = ordering([Desc(f"_{k}") if down else f"_{k}" for k, (_, _, down) in enumerate(parts)])
    share = min(1.0, DRAWN * buckets / max(1, df.count()))
    # long text is cut: whatever bounds ranges, they are in order
    drawn = df.select(*keys, F.rand(7).alias("__r")).filter(F.col("__r") < share).orderBy(*by)
    rows = [list(r) for r in drawn.select(*[F.substring(F.col(f"_{k}").cast("string"), 1, 100) for k in range(len(parts))]).collect()]
    bounds = [rows[k * len(rows) // buckets] for k in range(1, buckets)] if rows else []
    bounds = [b for k, b in enumerate(bounds) if not k or b != bounds[k - 1]]

    def shortest(k: int) -> list[str | None]:
        """The first keys of a bound that tell it from its neighbours."""
        near = bounds[max(0, k - 1):k] + bounds[k + 1:k + 2]
        return bounds[k][:next((n for n in range(1, len(parts)) if all(b[:n] != bounds[k][:n] for b in near)), len(parts))]

    def below(first: int, last: int) -> str:
        """first + the number of bounds[first:last] that a row comes after, by halves."""
        if first == last:
            return str(first)
        k = (first + last) // 2
        bound = shortest(k)
        return f"CASE WHEN {_is_after(parts[:len(bound)], bound)} THEN {below(k + 1, last)} ELSE {below(first, k)} END"

    return F.expr(below(0, len(bounds)))


def _accumulated(df: DataFrame, order: list[str], inside: Column, total: Column, out: str, buckets: int) -> DataFrame:
    need(df.columns, *order)
    d = df.withColumn("__bucket", _bucket(df, order, buckets))
    sums = d.groupBy("__bucket").agg(total.alias("__total"))
    before = F.coalesce(F.sum("__total").over(Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select("__bucket", before.alias("__before"))
    if order[0] != PLACE:
        sums = F.broadcast(sums)  # BUCKETS + 1 rows at most
    return d.withColumn("__inside", inside).join(sums, "__bucket").withColumn(out, F.col("__before") + F.col("__inside")).drop("__bucket", "__before", "__inside")


def with_position(df: DataFrame, order: list[str], out: str = POSITION, buckets: int = BUCKETS) -> DataFrame:
    """df with positions from 0 by ``order``."""
    w = Window.partitionBy("__bucket").orderBy(*ordering(order))
    return _accumulated(df, order, F.row_number().over(w) - 1, F.count(F.lit(1)), out, buckets).withColumn(out, F.col(out).cast("bigint"))


def cumsum(df: DataFrame, value: str, order: list[str], out: str, kind: str = "double", buckets: int = BUCKETS) -> DataFrame:
    """df with the running sum of ``value``: null where the value is null, which adds nothing. ``kind`` is the type summed
    in; a decimal makes the result independent of the order of additions."""
    need(df.columns, value)
    w = Window.partitionBy("__bucket").orderBy(*ordering(order)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    x = F.col(name(value)).cast(kind)
    summed = _accumulated(df, order, F.coalesce(F.sum(x).over(w), F.lit(0).cast(kind)), F.coalesce(F.sum(x), F.lit(0).cast(kind)), "__sum", buckets)
    return summed.withColumn(out, F.when(F.col(name(value)).isNotNull(), F.col("__sum").cast("double"))).drop("__sum")


def duplicated(df: DataFrame, subset: list[str], order: list[str], out: str = "duplicated", nulls_equal: bool = True) -> DataFrame:
    """df with a flag: an earlier row has the same values in ``subset``. With nulls_equal=False (a single column's rule) a
    missing value never is a duplicate."""
    need(df.columns, *subset, *order)
    seen = F.row_number().over(Window.partitionBy(*map(name, subset)).orderBy(*ordering(order))) > 1
    for c in [] if nulls_equal else subset:
        seen = seen & F.col(name(c)).isNotNull()
    return df.withColumn(out, seen)


def drop_duplicates(df: DataFrame, subset: list[str], order: list[str], nulls_equal: bool = True) -> DataFrame:
    """The first row by ``order`` of each combination of ``subset``. Partial minima are kept before rows move, so a value
    that most rows share does not gather them in one task."""
    need(df.columns, *subset, *order)
    if not nulls_equal:
        missing = F.lit(False)
        for c in subset:
            missing = missing | F.col(name(c)).isNull()
        return drop_duplicates(df.filter(~missing), subset, order).unionByName(df.filter(missing))
    columns = [name(c) for c in df.columns]
    df, order = _placed(df, order)
    place = F.struct(*[F.col(name(c)).isNull().alias(f"n{k}") if j == 0 else F.col(name(c)).alias(f"v{k}") for k, c in enumerate(order) for j in (0, 1)])
    first = df.groupBy(*map(name, subset)).agg(F.min_by(F.struct(*columns), place).alias("__row"))
    return first.select("__row.*").select(*columns)


def factorize(df: DataFrame, value: str, order: list[str], out: str = "code") -> DataFrame:
    """df with codes 0, 1, ... of the values by first appearance; -1 for null."""
    need(df.columns, value, *order)
    df, order = _placed(df, order)
    place = F.struct(*[F.col(name(c)) for c in order])
    v = F.col(name(value))
    firsts = df.filter(v.isNotNull()).groupBy(v.alias("__value")).agg(F.min(place).alias("__first"))
    coded = firsts.select("__value", (F.row_number().over(Window.orderBy("__first")) - 1).alias(out))
    return df.drop("__place").join(coded, v == F.col("__value"), "left").withColumn(out, F.coalesce(F.col(out), F.lit(-1))).drop("__value")


def argsort(df: DataFrame, value: str, order: list[str], ascending: bool = True) -> DataFrame:
    """rank, position: for each rank by value the position of its row by ``order``; nulls last, ties by position. Both are
    found per range, so no task sorts all rows."""
    columns = list(dict.fromkeys([value, *order]))
    placed = with_position(df.select(*map(name, columns)), order)
    ranked = with_position(placed, [value if ascending else Desc(value), POSITION], "rank")
    return ranked.select("rank", F.col(POSITION).alias("position"))
