"""Column expressions with the engine's arithmetic and missing-value rules."""

from .exprs import (
    as_bool_mask, cast_to, csv_text, fill_na, half_away_round, ieee_div, is_numeric, map_values, nan_if_null, numeric_columns, plain_double, zero_if_null,
)

__all__ = [
    "as_bool_mask", "cast_to", "csv_text", "fill_na", "half_away_round", "ieee_div", "is_numeric", "map_values", "nan_if_null", "numeric_columns", "plain_double", "zero_if_null",
]
