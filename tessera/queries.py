"""One query per operator over the shared tables, each with the SQL that gives the same rows.

Floating-point results that depend on the order of additions are rounded on both sides.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .dsl import run_json, run_text
from .functions.exprs import half_away_round, ieee_div
from .operators.frame import Frame, concat
from .plans.predicate import Predicate, col
from .sources import csv as csv_source
from .sources import json as json_source

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str, *order: str) -> Frame:
    return Frame(spark.read.parquet(f"{sf_dir}/{name}.parquet"), order)


def rounded(df: DataFrame, digits: int = 4, *names: str) -> DataFrame:
    chosen = names or [c for c, t in df.dtypes if t == "double"]
    return df.withColumns({c: half_away_round(F.col(c), digits) for c in chosen})


#: Orders with missing values planted: every seventh price, every fifth priority.
NULLED = "(SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS price, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderpriority END AS priority FROM orders)"


def nulled(spark: SparkSession, sf_dir: str) -> Frame:
    o = table(spark, sf_dir, "orders").df
    k = F.col("o_orderkey")
    return Frame(o.select(k, "o_custkey", F.when(k % 7 != 0, F.col("o_totalprice")).alias("price"), F.when(k % 5 != 0, F.col("o_orderpriority")).alias("priority")), ["o_orderkey"])


FLAGSHIP = (
    'filter(l_returnflag == "R") | filter(l_quantity > 10) | derive(revenue = l_extendedprice * (1 - l_discount))'
    " | groupby(l_linestatus) | agg(sum:revenue, mean:l_tax, count:l_orderkey) | sort(revenue, desc) | round(l_tax, 3) | round(revenue, 2)"
)
_FLAGSHIP_SQL = """
SELECT l_linestatus, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_tax), 3) AS l_tax, CAST(count(l_orderkey) AS DOUBLE) AS l_orderkey
FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 10 AND l_linestatus IS NOT NULL GROUP BY l_linestatus
"""


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_text(table(spark, sf_dir, "lineitem"), FLAGSHIP).df


@query(_FLAGSHIP_SQL)
def dsl_pipeline(spark, d):
    return flagship(spark, d)


_JSON = """{"operations": [
 {"op": "filter", "args": {"column": "l_returnflag", "operator": "==", "value": "R"}}, {"op": "filter", "args": {"column": "l_quantity", "operator": ">", "value": 10}},
 {"op": "derive", "args": {"column": "revenue", "expression": "l_extendedprice * (1 - l_discount)"}}, {"op": "groupby", "args": {"columns": ["l_linestatus"]}},
 {"op": "agg", "args": {"aggregations": [{"function": "sum", "column": "revenue"}, {"function": "mean", "column": "l_tax"}, {"function": "count", "column": "l_orderkey"}]}},
 {"op": "sort", "args": {"column": "revenue", "descending": true}}, {"op": "round", "args": {"column": "l_tax", "digits": 3}}, {"op": "round", "args": {"column": "revenue", "digits": 2}}]}"""


@query(_FLAGSHIP_SQL)
def json_pipeline(spark, d):
    return run_json(table(spark, d, "lineitem"), _JSON).df


# columns


@query("SELECT c_custkey, c_name FROM customer")
def select(spark, d):
    return table(spark, d, "customer").select("c_custkey", "c_name").df


@query("SELECT c_custkey, c_nationkey, c_mktsegment FROM customer")
def drop(spark, d):
    return table(spark, d, "customer").drop("c_name", "c_acctbal", "no_such_column").df


@query("SELECT n_nationkey AS nation_id, n_name AS nation, n_regionkey FROM nation")
def rename(spark, d):
    return table(spark, d, "nation").rename({"n_nationkey": "nation_id", "n_name": "nation"}).df


@query("SELECT p_partkey, p_retailprice * 2 AS doubled FROM part")
def set_column(spark, d):
    f = table(spark, d, "part")
    return f.with_column("doubled", f["p_retailprice"] * 2).select("p_partkey", "doubled").df


# filters

_COMPARED = {"gt": (">", 150000.0), "ge": (">=", 150000.0), "lt": ("<", 50000.0), "le": ("<=", 50000.0), "eq": ("==", 7), "ne": ("!=", 7)}


def _compared(op: str, value: float):
    name = "o_totalprice" if isinstance(value, float) else "o_custkey"
    make = {">": lambda c: c > value, ">=": lambda c: c >= value, "<": lambda c: c < value, "<=": lambda c: c <= value, "==": lambda c: c == value, "!=": lambda c: c != value}[op]

    def f(spark, d):
        return table(spark, d, "orders").filter(make(col(name))).select("o_orderkey", name).df

    return f, f"SELECT o_orderkey, {name} FROM orders WHERE {name} {op.replace('==', '=')} {value}"


for _name, (_op, _value) in _COMPARED.items():
    QUERIES[f"filter_{_name}"], ORACLES[f"filter_{_name}"] = _compared(_op, _value)


def _filtered(sql: str, predicate: Predicate, name: str) -> None:
    def f(spark, d):
        return nulled(spark, d).filter(predicate).df

    QUERIES[name], ORACLES[name] = f, f"SELECT * FROM {NULLED} WHERE {sql}"


_filtered("priority = '1-URGENT'", col("priority") == "1-URGENT", "filter_str_eq")
_filtered("priority <> '1-URGENT'", col("priority") != "1-URGENT", "filter_str_ne")
_filtered("priority > '3'", col("priority") > "3", "filter_str_gt")
_filtered("contains(priority, 'I')", col("priority").contains("I"), "filter_contains")
_filtered("price > 100000 AND priority = '2-HIGH'", (col("price") > 100000) & (col("priority") == "2-HIGH"), "filter_and")
_filtered("price > 300000 OR priority = '2-HIGH'", (col("price") > 300000) | (col("priority") == "2-HIGH"), "filter_or")
_filtered("NOT coalesce(price > 100000, false)", ~(col("price") > 100000), "filter_not_null_included")
_filtered("NOT (coalesce(price > 100000, false) AND coalesce(contains(priority, 'I'), false))", ~((col("price") > 100000) & col("priority").contains("I")), "filter_not_and")
_filtered("price IS NULL", col("price").is_na(), "filter_is_na")


@query(f"SELECT o_orderkey, price IS NULL AS missing, coalesce(price > 100000, false) AS dear, coalesce(price <> 1, false) AS other FROM {NULLED}")
def mask_columns(spark, d):
    f = nulled(spark, d)
    p = f["price"]
    return f.with_column("missing", p.is_na()).with_column("dear", Frame(f.df)["price"].expr > 100000).df.select("o_orderkey", "missing", F.coalesce("dear", F.lit(False)).alias("dear"), (p != 1).expr.alias("other"))


# missing values and arithmetic


@query(f"SELECT o_orderkey, price IS NULL AS missing FROM {NULLED}")
def is_na(spark, d):
    f = nulled(spark, d)
    return f.with_column("missing", f["price"].is_na()).select("o_orderkey", "missing").df


@query(f"SELECT o_orderkey, price FROM {NULLED} WHERE price IS NOT NULL")
def drop_na(spark, d):
    return nulled(spark, d)["price"].drop_na().frame.select("o_orderkey", "price").df


@query(f"SELECT o_orderkey, coalesce(price, 0) AS price, coalesce(priority, 'none') AS priority FROM {NULLED}")
def fill_na(spark, d):
    f = nulled(spark, d)
    f = f.with_column("price", f["price"].fill_na(0.0))
    return f.with_column("priority", f["priority"].fill_na("none")).select("o_orderkey", "price", "priority").df


@query("SELECT l_orderkey, l_linenumber, l_extendedprice + l_tax AS a, l_extendedprice - l_quantity AS b, l_quantity * l_discount AS c, l_extendedprice / l_quantity AS d FROM lineitem")
def arith_series(spark, d):
    f = table(spark, d, "lineitem")
    p, q, t, s = (f[c] for c in ("l_extendedprice", "l_quantity", "l_tax", "l_discount"))
    return f.df.select("l_orderkey", "l_linenumber", (p + t).expr.alias("a"), (p - q).expr.alias("b"), (q * s).expr.alias("c"), (p / q).expr.alias("d"))


@query("SELECT l_orderkey, l_linenumber, l_quantity + 1.5 AS a, l_quantity - 2 AS b, CAST(l_linenumber * 3 AS DOUBLE) AS c, l_quantity / 4 AS d FROM lineitem")
def arith_scalar(spark, d):
    f = table(spark, d, "lineitem")
    q, n = f["l_quantity"], f["l_linenumber"]
    return f.df.select("l_orderkey", "l_linenumber", (q + 1.5).expr.alias("a"), (q - 2).expr.alias("b"), (n * 3).expr.alias("c"), (q / 4).expr.alias("d"))


@query("SELECT l_orderkey, l_linenumber, (l_extendedprice - 10) / (2 * l_quantity + 1) AS x FROM lineitem")
def derive_expr(spark, d):
    return run_text(table(spark, d, "lineitem"), "derive(x = (l_extendedprice - 10) / (2 * l_quantity + 1)) | select(l_orderkey, l_linenumber, x)").df


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN CASE WHEN o_totalprice > 0 THEN 'inf' ELSE '-inf' END ELSE 'finite' END AS kind FROM orders")
def div_ieee(spark, d):
    o = table(spark, d, "orders").df
    x = ieee_div(F.col("o_totalprice"), (F.col("o_orderkey") % 3).cast("double"))
    return o.select("o_orderkey", F.when(x == float("inf"), "inf").when(x == float("-inf"), "-inf").otherwise("finite").alias("kind"))


@query("SELECT l_orderkey, l_linenumber, round(l_extendedprice * l_discount, 2) AS x, round(l_extendedprice, -2) AS y FROM lineitem")
def round_half_away(spark, d):
    return run_text(table(spark, d, "lineitem"), "derive(x = l_extendedprice * l_discount) | round(x, 2) | derive(y = l_extendedprice) | round(y, -2) | select(l_orderkey, l_linenumber, x, y)").df


@query("SELECT o_orderkey, CAST(trunc(o_totalprice) AS BIGINT) AS o_totalprice FROM orders")
def cast_int(spark, d):
    return run_text(table(spark, d, "orders"), "select(o_orderkey, o_totalprice) | cast(o_totalprice, Int)").df


@query("SELECT CAST(o_orderkey AS DOUBLE) AS o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey FROM orders")
def cast_double(spark, d):
    return run_text(table(spark, d, "orders"), "select(o_orderkey, o_custkey) | cast(o_orderkey, Double) | cast(o_custkey, String)").df


@query("SELECT o_orderkey, TRY_CAST(substr(o_orderpriority, 1, CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 3 END) AS BIGINT) AS x FROM orders")
def cast_string_int(spark, d):
    f = table(spark, d, "orders")
    f = f.with_column("x", F.substring("o_orderpriority", F.lit(1), F.when(F.col("o_orderkey") % 2 == 0, 1).otherwise(3)))
    return run_text(f, "cast(x, Int) | select(o_orderkey, x)").df


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'filled' WHEN 'O' THEN 'open' END AS status FROM orders")
def map_values(spark, d):
    f = table(spark, d, "orders")
    return f.with_column("status", f["o_orderstatus"].map({"F": "filled", "O": "open"})).select("o_orderkey", "status").df


@query(f"SELECT o_orderkey, price * price AS price FROM {NULLED}")
def apply_function(spark, d):
    f = nulled(spark, d)
    return f.with_column("price", f["price"].apply(lambda c: c * c)).select("o_orderkey", "price").df


@query("SELECT CAST(n_nationkey + 1 AS INT) AS n_nationkey, n_name, CAST(n_regionkey + 1 AS INT) AS n_regionkey FROM nation")
def apply_columns(spark, d):
    return table(spark, d, "nation").apply(lambda c: c + 1).df


# order

def _ranked(f: Frame) -> DataFrame:
    """A sorted frame with the rank of each row, from 1."""
    return f.with_position().df.withColumn("rn", F.col("__pos__") + 1).drop("__pos__")


@query("SELECT s_suppkey, s_acctbal, row_number() OVER (ORDER BY s_acctbal DESC, s_suppkey) AS rn FROM supplier")
def sort_single_desc(spark, d):
    return _ranked(table(spark, d, "supplier").select("s_suppkey", "s_acctbal").sort("s_acctbal", "s_suppkey", ascending=[False, True]))


@query("SELECT c_custkey, c_mktsegment, c_acctbal, row_number() OVER (ORDER BY c_mktsegment, c_acctbal DESC, c_custkey) AS rn FROM customer")
def sort_multi(spark, d):
    f = run_text(table(spark, d, "customer"), "select(c_custkey, c_mktsegment, c_acctbal) | sort(c_mktsegment asc, c_acctbal desc, c_custkey)")
    return _ranked(f)


@query(f"SELECT o_orderkey, price, row_number() OVER (ORDER BY price DESC NULLS LAST, o_orderkey) AS rn FROM {NULLED}")
def sort_nulls_last(spark, d):
    return _ranked(nulled(spark, d).select("o_orderkey", "price").sort("price", "o_orderkey", ascending=[False, True]))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def top_k(spark, d):
    return run_text(table(spark, d, "orders"), "select(o_orderkey, o_totalprice) | sort(o_totalprice desc, o_orderkey asc) | head(10)").df


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 7")
def head(spark, d):
    return table(spark, d, "orders", "o_orderkey").select("o_orderkey", "o_totalprice").head(7).df


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey DESC LIMIT 7")
def tail(spark, d):
    return run_text(table(spark, d, "orders", "o_orderkey"), "select(o_orderkey, o_totalprice) | tail(7)").df


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 20 OFFSET 100")
def iloc_range(spark, d):
    return table(spark, d, "orders", "o_orderkey").select("o_orderkey", "o_totalprice").iloc(slice(100, 120)).df


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS pos FROM orders")
def positions(spark, d):
    return table(spark, d, "orders", "o_orderkey").select("o_orderkey").with_position().df.withColumnRenamed("__pos__", "pos")


@query("SELECT event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS r FROM events) WHERE r = 1 AND event_type IN ('click', 'view', 'purchase')")
def loc_label(spark, d):
    f = Frame(table(spark, d, "events").df.select("event_type", "event_id"), ["event_id"], "event_type")
    return f.loc(["purchase", "click", "no such label", "view"]).df.select("event_type", "event_id")


@query("SELECT o_orderkey, round(CAST(sum(CAST(o_totalprice AS DECIMAL(18, 2))) OVER (ORDER BY o_orderkey) AS DOUBLE), 2) AS total FROM orders")
def cumsum(spark, d):
    f = table(spark, d, "orders", "o_orderkey").cumsum("o_totalprice", "total", kind="decimal(18,2)")
    return rounded(f.df.select("o_orderkey", "total"), 2)


@query(f"SELECT o_orderkey, CASE WHEN price IS NOT NULL THEN round(CAST(sum(CAST(price AS DECIMAL(18, 2))) OVER (ORDER BY o_orderkey) AS DOUBLE), 2) END AS total FROM {NULLED}")
def cumsum_null(spark, d):
    return rounded(nulled(spark, d).cumsum("price", "total", kind="decimal(18,2)").df.select("o_orderkey", "total"), 2)


@query(f"SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey, priority ORDER BY o_orderkey) > 1 AS seen FROM {NULLED}")
def duplicated(spark, d):
    return nulled(spark, d).duplicated(["o_custkey", "priority"], "seen").df.select("o_orderkey", "seen")


@query(f"SELECT o_orderkey, priority IS NOT NULL AND row_number() OVER (PARTITION BY priority ORDER BY o_orderkey) > 1 AS seen FROM {NULLED}")
def duplicated_series(spark, d):
    return nulled(spark, d)["priority"].duplicated().select(F.col("__o0").alias("o_orderkey"), F.col("duplicated").alias("seen"))


@query(f"SELECT o_orderkey, o_custkey, price, priority FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, priority ORDER BY o_orderkey) AS r FROM {NULLED}) WHERE r = 1")
def drop_duplicates(spark, d):
    return nulled(spark, d).drop_duplicates(["o_custkey", "priority"]).df


@query(f"""SELECT o_orderkey, coalesce(code, -1) AS code FROM {NULLED} LEFT JOIN
    (SELECT priority AS p, CAST(row_number() OVER (ORDER BY min(o_orderkey)) - 1 AS INT) AS code FROM {NULLED} WHERE priority IS NOT NULL GROUP BY priority) ON priority = p""")
def factorize(spark, d):
    return nulled(spark, d)["priority"].factorize().select(F.col("__o0").alias("o_orderkey"), "code")


@query("SELECT CAST(row_number() OVER (ORDER BY s_acctbal, s_suppkey) - 1 AS INT) AS rank, pos AS position FROM (SELECT *, row_number() OVER (ORDER BY s_suppkey) - 1 AS pos FROM supplier)")
def argsort(spark, d):
    return table(spark, d, "supplier", "s_suppkey")["s_acctbal"].argsort()


# statistics

_STATS = {"sum": "sum", "mean": "avg", "std": "stddev_samp", "min": "min", "max": "max", "median": "median"}


def _reduced(name: str, sql: str):
    def f(spark, d):
        found = rounded(getattr(table(spark, d, "lineitem").select("l_quantity", "l_extendedprice", "l_discount", "l_tax"), name)().df)
        return found.withColumn("value", F.when(F.col("value") == 0, 0.0).otherwise(F.col("value")))  # the data hold -0.0 as well

    each = [f"SELECT '{c}' AS \"column\", round(CAST({sql}({c}) AS DOUBLE), 4) AS value FROM lineitem" for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")]
    return f, f"SELECT \"column\", CASE WHEN value = 0 THEN 0.0 ELSE value END AS value FROM ({' UNION ALL '.join(each)})"


for _name, _sql in _STATS.items():
    QUERIES[f"frame_{_name}"], ORACLES[f"frame_{_name}"] = _reduced(_name, _sql)

_EIGHT = {"count": "CAST(count({0}) AS DOUBLE)", "mean": "avg({0})", "std": "stddev_samp({0})", "min": "min({0})", "25%": "quantile_cont({0}, 0.25)", "50%": "quantile_cont({0}, 0.5)", "75%": "quantile_cont({0}, 0.75)", "max": "max({0})"}


@query(" UNION ALL ".join(f"SELECT '{k}' AS statistic, round({s.format('price')}, 4) AS price, round({s.format('CAST(o_custkey AS DOUBLE)')}, 4) AS o_custkey FROM {NULLED}" for k, s in _EIGHT.items()))
def describe(spark, d):
    return rounded(nulled(spark, d).select("price", "o_custkey").describe().df)


@query(f"SELECT round(quantile_cont(price, 0.1), 4) AS a, round(quantile_cont(price, 0.9), 4) AS b, round(stddev_pop(price), 4) AS c FROM {NULLED}")
def quantile(spark, d):
    from .operators import stats

    p = F.col("price")
    o = nulled(spark, d).df
    both = stats.quantiles(o, {"q": (p, [0.1, 0.9])}).crossJoin(o.agg(stats.std(p, 0).alias("c")))
    return rounded(both.select(F.col("q")[0].alias("a"), F.col("q")[1].alias("b"), "c"))


@query(f"SELECT priority AS value, count(*) AS count FROM {NULLED} WHERE priority IS NOT NULL GROUP BY priority")
def value_counts(spark, d):
    return nulled(spark, d)["priority"].value_counts()


@query(f"SELECT DISTINCT priority AS value FROM {NULLED}")
def unique(spark, d):
    return nulled(spark, d)["priority"].unique()


@query(f"SELECT count(DISTINCT priority) AS n FROM {NULLED}")
def nunique(spark, d):
    return nulled(spark, d).df.agg(F.count_distinct("priority").alias("n"))


# groups


def _grouped(name: str, sql: str):
    def f(spark, d):
        g = table(spark, d, "lineitem").select("l_returnflag", "l_quantity", "l_extendedprice", "l_tax").group_by("l_returnflag")
        return rounded(getattr(g, name)().df)

    return f, f"SELECT l_returnflag, {', '.join(f'round(CAST({sql}({c}) AS DOUBLE), 4) AS {c}' for c in ('l_quantity', 'l_extendedprice', 'l_tax'))} FROM lineitem GROUP BY l_returnflag"


for _name, _sql in (_STATS | {"count": "count"}).items():
    QUERIES[f"groupby_{_name}"], ORACLES[f"groupby_{_name}"] = _grouped(_name, _sql)


@query("SELECT l_returnflag, l_linestatus, round(avg(l_quantity), 4) AS l_quantity FROM lineitem GROUP BY ALL")
def groupby_multi(spark, d):
    return rounded(table(spark, d, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity").group_by("l_returnflag", "l_linestatus").mean().df)


@query(f"SELECT priority, round(sum(price), 2) AS price FROM {NULLED} WHERE priority IS NOT NULL GROUP BY priority")
def groupby_null_keys_dropped(spark, d):
    return rounded(nulled(spark, d).select("priority", "price").group_by("priority").sum().df, 2)


@query("SELECT k, round(coalesce(sum(v), 0), 2) AS s, round(coalesce(avg(v), 'NaN'), 2) AS mean_v, coalesce(max(v), 'NaN') AS max_v FROM (SELECT o_orderkey % 7 AS k, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS v FROM orders) GROUP BY k")
def groupby_null_values(spark, d):
    o = nulled(spark, d).df.select((F.col("o_orderkey") % 7).alias("k"), F.col("price").alias("v"))
    g = Frame(o).group_by("k").agg(("sum", "v"), ("mean", "v"), ("max", "v")).df
    return rounded(g.withColumnRenamed("v", "s"), 2, "s", "mean_v")


@query("SELECT CAST(g AS BOOLEAN) AS g, CAST(count(v) AS DOUBLE) AS v FROM (SELECT o_totalprice > 100000 AS g, o_custkey AS v FROM orders) GROUP BY g")
def groupby_bool_key(spark, d):
    o = table(spark, d, "orders").df.select((F.col("o_totalprice") > 100000).alias("g"), F.col("o_custkey").alias("v"))
    return Frame(o).group_by("g").count().df


@query("SELECT l_shipmode, round(s, 2) AS l_extendedprice, round(sd, 4) AS std_l_extendedprice, round(md, 4) AS l_quantity, n AS l_orderkey FROM (SELECT l_linestatus AS l_shipmode, sum(l_extendedprice) s, stddev_samp(l_extendedprice) sd, median(l_quantity) md, CAST(count(l_orderkey) AS DOUBLE) n FROM lineitem GROUP BY 1)".replace("l_shipmode", "l_linestatus"))
def agg_list(spark, d):
    f = run_text(table(spark, d, "lineitem"), "groupby(l_linestatus) | agg(sum:l_extendedprice, std:l_extendedprice, median:l_quantity, count:l_orderkey) | round(l_extendedprice, 2) | round(std_l_extendedprice, 4)")
    return f.df


@query("SELECT l_linestatus, CAST(count(*) AS DOUBLE) AS l_quantity FROM lineitem GROUP BY l_linestatus")
def groupby_default_count(spark, d):
    return run_text(table(spark, d, "lineitem"), "select(l_linestatus, l_quantity) | groupby(l_linestatus)").df


@query("SELECT s_nationkey, list(p ORDER BY p) AS positions FROM (SELECT *, row_number() OVER (ORDER BY s_suppkey) - 1 AS p FROM supplier) GROUP BY s_nationkey".replace("list(p ORDER BY p)", "string_agg(CAST(p AS VARCHAR), ',' ORDER BY p)"))
def group_positions(spark, d):
    g = table(spark, d, "supplier", "s_suppkey").group_by("s_nationkey").groups().df
    return g.select("s_nationkey", F.concat_ws(",", F.col("positions").cast("array<string>")).alias("positions"))


# joins and concatenation


def _sides(spark, d):
    docs = table(spark, d, "documents").df.select("doc_id", "lang").filter(F.col("doc_id") % 3 != 0)
    return Frame(docs), Frame(table(spark, d, "labels").df.select("doc_id", "quality"))


for _name, _how, _sql in (("inner", "inner", "JOIN"), ("left", "left", "LEFT JOIN"), ("right", "right", "RIGHT JOIN"), ("outer", "outer", "FULL JOIN")):

    def _merged(spark, d, how=_how):
        left, right = _sides(spark, d)
        return left.merge(right, on="doc_id", how=how).df

    QUERIES[f"merge_{_name}"] = _merged
    ORACLES[f"merge_{_name}"] = f"SELECT doc_id, lang, quality FROM (SELECT doc_id, lang FROM documents WHERE doc_id % 3 <> 0) {_sql} (SELECT doc_id, quality FROM labels) USING (doc_id)"


@query("SELECT n_regionkey AS k, a.n_name AS v, b.r_name AS v_right FROM nation a JOIN region b ON n_regionkey = r_regionkey")
def merge_suffix(spark, d):
    n = table(spark, d, "nation").rename({"n_regionkey": "k", "n_name": "v"}).select("k", "v")
    return n.merge(table(spark, d, "region").rename({"r_regionkey": "k", "r_name": "v"}), on="k").df


@query(f"SELECT priority, o_orderkey, n FROM {NULLED} LEFT JOIN (SELECT priority, count(*) AS n FROM {NULLED} GROUP BY priority) USING (priority)")
def merge_null_keys(spark, d):
    f = nulled(spark, d)
    counts = Frame(f.df.groupBy("priority").agg(F.count(F.lit(1)).alias("n")))
    return f.select("priority", "o_orderkey").merge(counts, on="priority", how="left").df


@query("SELECT c_custkey AS id, c_acctbal AS balance FROM customer UNION ALL SELECT s_suppkey, s_acctbal FROM supplier")
def concat_rows(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_acctbal").rename({"c_custkey": "id", "c_acctbal": "balance"})
    return concat([c, table(spark, d, "supplier").select("s_acctbal", "s_suppkey").rename({"s_suppkey": "id", "s_acctbal": "balance"})]).df


@query("SELECT c_custkey AS id, c_name AS name FROM customer UNION ALL SELECT s_suppkey, NULL FROM supplier")
def concat_missing_cols(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_name").rename({"c_custkey": "id", "c_name": "name"})
    return concat([c, table(spark, d, "supplier").select("s_suppkey", "s_acctbal").rename({"s_suppkey": "id"})]).df


# lazy chains


@query("SELECT o_orderstatus, round(sum(o_totalprice), 2) AS o_totalprice FROM orders WHERE o_totalprice > 100000 GROUP BY o_orderstatus")
def lazy_filter_select_groupby(spark, d):
    f = table(spark, d, "orders").lazy().filter(col("o_totalprice") > 100000).select("o_orderstatus", "o_totalprice").group_by("o_orderstatus").sum().collect()
    return rounded(f.df, 2)


@query("SELECT o_custkey, round(sum(o_totalprice), 2) AS o_totalprice FROM orders GROUP BY o_custkey HAVING sum(o_totalprice) > 1000000")
def having_like(spark, d):
    return rounded(table(spark, d, "orders").lazy().select("o_custkey", "o_totalprice").group_by("o_custkey").sum().filter(col("o_totalprice") > 1000000).collect().df, 2)


@query("SELECT o_custkey, o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 5000")
def lazy_join_filter(spark, d):
    c = table(spark, d, "customer").rename({"c_custkey": "o_custkey"}).lazy()
    return table(spark, d, "orders").lazy().merge(c, on="o_custkey").filter(col("c_acctbal") > 5000).select("o_custkey", "o_orderkey", "c_name").collect().df


@query("SELECT o_orderkey FROM orders WHERE o_totalprice > 300000")
def lazy_select_drops_predicate_column(spark, d):
    return table(spark, d, "orders").lazy().filter(col("o_totalprice") > 300000).select("o_orderkey").collect().df


# sources and sinks


def _scratch(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder; a local one only with a local master, whose executors share the machine's disk."""
    import tempfile

    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    shared = shared or tempfile.mkdtemp(prefix="tessera-")
    return f"{shared.rstrip('/')}/{what}-{uuid.uuid4().hex}"


@query("SELECT CAST(s_suppkey AS DOUBLE) AS s_suppkey, s_name, CAST(s_nationkey AS DOUBLE) AS s_nationkey, s_acctbal FROM supplier")
def csv_roundtrip(spark, d):
    path = _scratch(spark, "csv")
    table(spark, d, "supplier").to_csv(path, distributed=True)
    return csv_source.read_csv(spark, path).drop("__at__").df


@query("SELECT n_name, CAST(n_nationkey AS DOUBLE) AS n_nationkey, CAST(n_regionkey AS DOUBLE) AS n_regionkey FROM nation")
def json_roundtrip(spark, d):
    text = json_source.to_json(table(spark, d, "nation", "n_nationkey"))
    return json_source.read_json_text(spark, text).drop("__pos__").df


# each remaining verb through the language


@query("SELECT o_orderkey AS id, o_totalprice AS price FROM orders WHERE contains(o_orderpriority, 'HIGH') AND o_totalprice <= 50000")
def dsl_select_rename(spark, d):
    return run_text(table(spark, d, "orders"), 'filter(o_orderpriority contains "HIGH") | filter(o_totalprice <= 50000) | select(o_orderkey, o_totalprice) | rename(o_orderkey -> id) | rename(o_totalprice -> price)').df


@query("SELECT p_partkey, p_size FROM part ORDER BY p_size DESC, p_partkey LIMIT 5")
def dsl_drop_sort_head(spark, d):
    return run_text(table(spark, d, "part"), "drop(p_name, p_brand, p_type, p_retailprice) | sort(p_size desc, p_partkey asc) | head(5)").df
