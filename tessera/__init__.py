"""A dataframe analytics engine on Spark: frames, series, lazy predicates, a pipe language, a catalog of named frames."""

__version__ = "0.1.0"
