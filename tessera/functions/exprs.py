"""Expressions over built-in functions only, so plans stay inside generated code."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NAN = float("nan")


def is_numeric(kind: T.DataType) -> bool:
    """Numbers; booleans are none."""
    return isinstance(kind, T.NumericType)


def numeric_columns(df: DataFrame, *without: str) -> list[str]:
    return [f.name for f in df.schema if is_numeric(f.dataType) and f.name not in without]


def plain_double(c: Column) -> Column:
    return c.cast("double")


def ieee_div(a: Column, b: Column) -> Column:
    """Division of doubles by IEEE rules: by zero gives an infinity or NaN instead of an error; null stays null."""
    a, b = plain_double(a), plain_double(b)
    return F.when(b == 0, a * F.pow(b, F.lit(-1.0))).otherwise(a / b)


def half_away_round(c: Column, digits: int) -> Column:
    """Rounds halves away from zero on the double times a power of ten; negative digits round before the point. NaN and
    infinities stay."""
    m = F.lit(float(10.0 ** digits))
    x = plain_double(c)
    scaled = F.abs(x) * m
    # adding a half to a value of 2 ** 52 or more, which has no fraction, could change it
    whole = F.when(scaled < 4503599627370496.0, F.floor(scaled + F.lit(0.5)).cast("double")).otherwise(scaled)
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), x).otherwise(F.signum(x) * whole / m)


def zero_if_null(c: Column) -> Column:
    return F.coalesce(plain_double(c), F.lit(0.0))


def nan_if_null(c: Column) -> Column:
    return F.coalesce(plain_double(c), F.lit(NAN))


def fill_na(c: Column, value: float | str) -> Column:
    return F.coalesce(c, F.lit(value))


def as_bool_mask(c: Column) -> Column:
    """A comparison as a mask that is never null: missing compares false."""
    return F.coalesce(c, F.lit(False))


def map_values(c: Column, mapping: Mapping) -> Column:
    """Values by a small mapping; anything unmapped, and null, is null. For large mappings join a table."""
    if not mapping:
        return F.lit(None)
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), c)


#: Names of types in casts, in lower case.
CASTS = {"int": "bigint", "double": "double", "float": "double", "string": "string"}


def cast_to(c: Column, kind: str, source: T.DataType) -> Column:
    """int (cuts the fraction off), double, float or string; what can't be converted is null."""
    target = CASTS[kind.lower()]
    if target == "bigint":
        if isinstance(source, T.IntegralType):
            return c.cast("bigint")
        if isinstance(source, T.BooleanType):
            return c.cast("int").cast("bigint")
        x = c.try_cast("double")
        fits = (x > -9.3e18) & (x < 9.3e18)
        return F.when(fits, F.when(x >= 0, F.floor(x)).otherwise(F.ceil(x)).try_cast("bigint"))
    if target == "double" and isinstance(source, T.BooleanType):
        return c.cast("int").cast("double")
    return c.try_cast(target)


def csv_text(c: Column, kind: T.DataType) -> Column:
    """A value as text for CSV: whole doubles below 1e15 without a point, booleans as True and False. Null stays null."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        whole = (c == F.floor(c)) & (F.abs(c) < 1e15)
        return F.when(whole, c.cast("bigint").cast("string")).otherwise(c.cast("string"))
    if isinstance(kind, T.BooleanType):
        return F.when(c, "True").when(~c, "False")
    return c.cast("string")
