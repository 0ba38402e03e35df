"""Reductions over columns: one aggregation for all columns and statistics, turned around afterwards."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import TypeMismatch, need
from ..functions.exprs import is_numeric, nan_if_null, numeric_columns, plain_double

QUARTILES = (0.25, 0.5, 0.75)
#: Of more values, quantiles are bracketed first; the summary that brackets them is wrong by n / ACCURACY ranks at most.
MANY, ACCURACY = 100_000, 1000
DESCRIBED = ("count", "mean", "std", "min", "25%", "50%", "75%", "max")


def std(c: Column, ddof: int = 1) -> Column:
    """Standard deviation with ``ddof`` degrees of freedom less; null for that many values or fewer."""
    x = plain_double(c)
    if ddof == 1:
        return F.stddev_samp(x)
    if ddof == 0:
        return F.stddev_pop(x)
    n = F.count(x)
    return F.when(n > ddof, F.sqrt(F.var_pop(x) * n / (n - ddof)))


def variance(c: Column, ddof: int = 1) -> Column:
    x, n = plain_double(c), F.count(c)
    return F.var_samp(x) if ddof == 1 else F.when(n > ddof, F.var_pop(x) * n / (n - ddof))


def quantiles(df: DataFrame, wanted: dict[str, tuple[Column, Sequence[float]]], keys: Sequence[str] = ()) -> DataFrame:
    """keys, and for each name its column's exact quantiles as an array, interpolated between neighbours at q * (n - 1), null
    without values; per group of the keys, which may not be missing. One row without keys.

    No task holds all values: of more than MANY values, approximate quantiles bracket each wanted rank; equal values are
    counted inside the brackets and all others between them, and the counts are added up. The approximation is wrong by n /
    ACCURACY ranks at most and brackets are three times as wide; a rank that is in none would be an error, not a result."""
    k = [f"__k{j}" for j in range(len(keys))]
    xs = [f"__x{i}" for i in range(len(wanted))]
    base = df.select(*[F.col(f"`{c}`").alias(a) for c, a in zip(keys, k, strict=True)], *[plain_double(c).alias(x) for x, (c, _) in zip(xs, wanted.values(), strict=True)])
    margin = 3 / ACCURACY
    near, many = [], []
    for x, (_, qs) in zip(xs, wanted.values(), strict=True):
        ends = [min(1.0, max(0.0, e)) for q in qs for e in (q - margin, q + margin)]
        finite = F.when(F.isnan(x), float("inf")).otherwise(F.col(x))  # NaN is the largest number; the summary can't place it
        near.append(F.when(F.count(x) > MANY, F.percentile_approx(finite, ends, ACCURACY)).alias(f"{x}_ends"))
        many.append(F.count(x).alias(f"{x}_n"))
    if keys:  # as many rows as there are groups of more than MANY values
        ends = base.groupBy(*k).agg(*near, *many).filter(F.greatest(*[F.col(f"{x}_n") for x in xs], F.lit(0)) > MANY)
        held = base.join(F.broadcast(ends), on=k, how="left")
    else:
        held = base.crossJoin(F.broadcast(base.agg(*near)))
    slots = []
    for i, (x, (_, qs)) in enumerate(zip(xs, wanted.values(), strict=True)):
        inside, beyond = F.lit(False), F.lit(0)
        for j in range(len(qs)):
            low, high = F.col(f"{x}_ends")[2 * j], F.col(f"{x}_ends")[2 * j + 1]
            past = (F.col(x) > high) & (high < float("inf"))
            inside, beyond = inside | ((F.col(x) >= low) & ~past), beyond + past.cast("int")
        inside = F.coalesce(inside, F.lit(True))
        slots.append(F.struct(F.lit(i).alias("__i"), F.when(~inside, beyond).alias("__gap"), F.when(inside, F.col(x)).alias("__v"), F.col(x).alias("__x")))
    each = held.select(*k, F.inline(F.array(*slots))).groupBy(*k, "__i", "__gap", "__v")
    counted = each.agg(F.count("__x").alias("__c"), F.min("__x").alias("__first"), F.max("__x").alias("__last"))
    w = Window.partitionBy(*k, "__i")
    counted = counted.withColumn("__upto", F.sum("__c").over(w.orderBy("__first"))).withColumn("__n", F.sum("__c").over(w))
    found, out = [], []
    for i, (name, (_, qs)) in enumerate(wanted.items()):
        found.append(F.max(F.when(F.col("__i") == i, F.col("__n"))).alias(f"__n{i}"))
        made = []
        for j, q in enumerate(qs):
            place = F.lit(float(q)) * (F.col("__n") - 1)
            for end, at in (("a", F.floor(place)), ("b", F.ceil(place))):
                holds = (F.col("__i") == i) & (at >= F.col("__upto") - F.col("__c")) & (at < F.col("__upto"))
                lost = F.raise_error(F.lit("a wanted rank is in no bracket")).cast("double")
                x = F.when((F.col("__first") == F.col("__last")) | (at == F.col("__upto") - F.col("__c")), F.col("__first")).when(at == F.col("__upto") - 1, F.col("__last")).otherwise(lost)
                found.append(F.max(F.when(holds, x)).alias(f"__{end}{i}_{j}"))
            place, a, b = F.lit(float(q)) * (F.col(f"__n{i}") - 1), F.col(f"__a{i}_{j}"), F.col(f"__b{i}_{j}")
            made.append(F.when(a == b, a).otherwise((F.ceil(place) - place) * a + (place - F.floor(place)) * b))
        out.append(F.array(*made).alias(name))
    rows = counted.groupBy(*k).agg(*found) if keys else counted.agg(*found)
    return rows.select(*[F.col(a).alias(c) for c, a in zip(keys, k, strict=True)], *out)


def quantiles_by_rank(df: DataFrame, column: str, qs: list[float], buckets: int | None = None) -> list[float | None]:
    """Exact quantiles of one column without holding its values in one task: ranges of values are counted first (see
    ``ordered``); in the ranges that hold a wanted rank, equal values are counted and the counts added up."""
    from . import ordered

    need(df.columns, column)
    x = plain_double(F.col(f"`{column}`"))
    known = df.select(x.alias("x")).filter(F.col("x").isNotNull())
    placed = known.withColumn("b", ordered._bucket(known, ["x"], ordered.BUCKETS if buckets is None else buckets))
    counts = sorted((r["b"], r["count"]) for r in placed.groupBy("b").count().collect())  # one more than ranges at most
    n = sum(c for _, c in counts)
    if not n:
        return [None] * len(qs)
    places = sorted({k for q in qs for k in (math.floor(q * (n - 1)), math.ceil(q * (n - 1)))})
    first, wanted = 0, {}
    for b, c in counts:
        if inside := [k for k in places if first <= k < first + c]:
            wanted[b] = (first, inside)
        first += c
    upto = F.sum("c").over(Window.partitionBy("b").orderBy("x"))
    each = placed.filter(F.col("b").isin(list(wanted))).groupBy("b", "x").agg(F.count(F.lit(1)).alias("c")).withColumn("upto", upto)
    holds = reduce(lambda a, c: a | c, [(F.col("b") == b) & (F.col("upto") > k - at) & (F.col("upto") - F.col("c") <= k - at) for b, (at, ks) in wanted.items() for k in ks])
    found = each.filter(holds).select("b", "x", "c", "upto").collect()  # a row for each wanted rank at most
    at = {k: r["x"] for r in found for k in wanted[r["b"]][1] if r["upto"] - r["c"] <= k - wanted[r["b"]][0] < r["upto"]}
    out = []
    for q in qs:
        place = q * (n - 1)
        a, b = at[math.floor(place)], at[math.ceil(place)]
        out.append(a if a == b else a + (b - a) * (place - math.floor(place)))
    return out


REDUCTIONS: dict[str, Callable[[Column], Column]] = {
    "sum": lambda c: F.sum(plain_double(c)), "mean": lambda c: F.avg(plain_double(c)), "min": lambda c: F.min(plain_double(c)), "max": lambda c: F.max(plain_double(c)),
    "std": std, "count": lambda c: F.count(c).cast("double"), "nunique": lambda c: F.count_distinct(c).cast("double"),
}


def reduce_columns(df: DataFrame, what: str, ddof: int = 1) -> DataFrame:
    """column, value: the reduction of every numeric column; NaN where there is none."""
    names = numeric_columns(df)
    if not names:
        return df.sparkSession.createDataFrame([], "column string, value double")
    if what == "median":
        found = quantiles(df, {f"_{k}": (F.col(f"`{n}`"), [0.5]) for k, n in enumerate(names)})
        return _turned(found.select(*[nan_if_null(F.col(f"_{k}")[0]).alias(f"_{k}") for k in range(len(names))]), names)
    f = (lambda c: std(c, ddof)) if what == "std" else REDUCTIONS[what]
    return _turned(df.agg(*[nan_if_null(f(F.col(f"`{n}`"))).alias(f"_{k}") for k, n in enumerate(names)]), names)


def _turned(one_row: DataFrame, names: list[str]) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(n).alias("column"), F.col(f"_{k}").alias("value")) for k, n in enumerate(names)])
    return one_row.select(F.explode(pairs).alias("x")).select("x.column", "x.value")


def reduce_one(df: DataFrame, column: str, f: Callable[[Column], Column]) -> float | None:
    need(df.columns, column)
    if not is_numeric(df.schema[column].dataType):
        raise TypeMismatch(f"{column!r} isn't numeric")
    return df.agg(f(F.col(f"`{column}`"))).first()[0]


def describe(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """statistic and a column per numeric column, eight rows in the order of DESCRIBED; exact quartiles, found by rank."""
    names = columns if columns is not None else numeric_columns(df)
    if not names:
        return df.sparkSession.createDataFrame([(s,) for s in DESCRIBED], "statistic string")
    aggs, aligned = [], []
    for k, n in enumerate(names):
        x = plain_double(F.col(f"`{n}`"))
        aggs.append(F.array(F.count(x).cast("double"), F.avg(x), F.stddev_samp(x), F.min(x), F.max(x)).alias(f"__a{k}"))
        a, five = F.col(f"__a{k}"), F.col(f"__q{k}")
        aligned.append(F.array(a[0], a[1], a[2], a[3], five[0], five[1], five[2], a[4]).alias(f"_{k}"))
    row = df.agg(*aggs).crossJoin(quantiles(df, {f"__q{k}": (F.col(f"`{n}`"), QUARTILES) for k, n in enumerate(names)})).select(*aligned)
    stats = F.posexplode(F.array(*map(F.lit, DESCRIBED)))
    turned = row.select("*", stats.alias("__k", "statistic"))
    return turned.select("statistic", *[nan_if_null(F.get(f"_{k}", "__k")).alias(n) for k, n in enumerate(names)])


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """value, count, most frequent first (ties by value); nulls don't count."""
    need(df.columns, column)
    c = F.col(f"`{column}`")
    return df.filter(c.isNotNull()).groupBy(c.alias("value")).agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "value")


def unique(df: DataFrame, column: str) -> DataFrame:
    need(df.columns, column)
    return df.select(column).distinct()
