"""Queries of what is no DataFrame by itself: series, values by position, text forms, errors, the catalog and the service, each
put into rows and held against SQL."""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from . import cli
from .catalog import Catalog
from .dsl import parse, run_text
from .errors import EngineError
from .operators.frame import Frame
from .operators.index import Index
from .plans.predicate import col
from .queries import NULLED, _scratch, nulled, query, rounded, table
from .service import handle
from .sources import read_csv, read_csv_text, read_json, read_json_text
from .sources import json as json_source
from .sources.display import box


def named(spark: SparkSession, values: dict[str, Any], kind: str = "double") -> DataFrame:
    make = {"double": lambda v: None if v is None else round(float(v), 4), "string": str}[kind]
    return spark.createDataFrame([(k, make(v)) for k, v in values.items()], f"name string, value {kind}")


def numbers(sql: dict[str, str], source: str) -> str:
    return " UNION ALL ".join(f"SELECT '{k}' AS name, round(CAST({v} AS DOUBLE), 4) AS value FROM {source}" for k, v in sql.items())


def strings(rows: dict[str, str]) -> str:
    return "SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in rows.items()) + ") AS t(name, value)"


# series


@query(numbers({"count": "count(price)", "max": "max(price)", "mean": "avg(price)", "min": "min(price)", "std": "stddev_samp(price)", "sum": "sum(price)", "variance": "var_pop(price)"}, NULLED))
def series_reductions(spark, d):
    s = nulled(spark, d)["price"]
    return named(spark, {"count": s.count(), "max": s.max(), "mean": s.mean(), "min": s.min(), "std": s.std(), "sum": s.sum(), "variance": s.variance(0)})


@query(numbers({"median": "median(price)"}, NULLED))
def series_median(spark, d):
    return named(spark, {"median": nulled(spark, d)["price"].median()})


@query(numbers({f"q{q}": f"quantile_cont(price, {q})" for q in (0.0, 0.1, 0.333, 0.75, 1.0)}, NULLED))
def series_quantile(spark, d):
    s = nulled(spark, d)["price"]
    return named(spark, {f"q{q}": s.quantile(q) for q in (0.0, 0.1, 0.333, 0.75, 1.0)})


@query(numbers({"count": "count(price)", "mean": "avg(price)", "std": "stddev_samp(price)", "min": "min(price)", "25%": "quantile_cont(price, 0.25)", "50%": "quantile_cont(price, 0.5)", "75%": "quantile_cont(price, 0.75)", "max": "max(price)"}, NULLED))
def series_describe(spark, d):
    f = nulled(spark, d)["price"]
    return named(spark, f.describe())


@query(f"SELECT price AS value, CAST(row_number() OVER (ORDER BY price DESC NULLS LAST, o_orderkey) - 1 AS BIGINT) AS at FROM {NULLED}")
def series_sort(spark, d):
    f = Frame(nulled(spark, d).df.select("o_orderkey", "price"), ["o_orderkey"]).sort("price", ascending=False)
    placed = f.with_position().df
    return placed.selectExpr("price AS value", "__pos__ AS at")


@query(f"SELECT o_orderkey, coalesce(price > 100000, false) AND priority LIKE '%URGENT%' IS TRUE AS both, coalesce(price > 100000, false) OR priority LIKE '%URGENT%' IS TRUE AS either, NOT coalesce(price > 100000, false) AS neither FROM {NULLED}")
def series_mask_operators(spark, d):
    f = nulled(spark, d)
    a, b = f["price"] > 100000, f["priority"].contains("URGENT")
    return f.df.select("o_orderkey", (a & b).expr.alias("both"), (a | b).expr.alias("either"), (~a).expr.alias("neither"))


@query("SELECT o_totalprice AS value FROM orders")
def get_column(spark, d):
    return table(spark, d, "orders", "o_orderkey")["o_totalprice"].df.select("value")


@query(numbers({"first": "min_by(s_acctbal, s_suppkey)", "last": "max_by(s_acctbal, s_suppkey)", "third": "list(s_acctbal ORDER BY s_suppkey)[3]", "place": "count(*) FILTER (s_suppkey < 7)"}, "supplier"))
def series_access(spark, d):
    f = table(spark, d, "supplier", "s_suppkey")
    s = f["s_acctbal"]
    return named(spark, {"first": s.head(1)[0], "last": s.tail(1)[0], "third": s.iloc(2), "place": f["s_suppkey"].locate(7)})


@query("SELECT * FROM (VALUES (0, 1.5), (1, NULL), (2, 4.0)) AS t(place, value)")
def series_from_values(spark, d):
    s = Frame.from_columns(spark, {"x": [1.5, None, 4.0]})["x"]
    return spark.createDataFrame(list(enumerate(s.collect())), "place int, value double")


# rows by position, indexes, equality, errors of empty input


@query("SELECT o_orderkey, o_custkey FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS p FROM orders) WHERE p IN (3, 0, 17)")
def take_rows(spark, d):
    return table(spark, d, "orders", "o_orderkey").select("o_orderkey", "o_custkey").take([3, 0, 17]).df.select("o_orderkey", "o_custkey")


@query("SELECT r_regionkey, r_name, CAST(row_number() OVER (ORDER BY r_regionkey) - 1 AS BIGINT) AS at FROM region")
def iterate_rows(spark, d):
    found = [(r["r_regionkey"], r["r_name"], k) for k, r in enumerate(table(spark, d, "region", "r_regionkey"))]
    f = table(spark, d, "region").df
    return spark.createDataFrame(found, f"r_regionkey {dict(f.dtypes)['r_regionkey']}, r_name string, at long")


@query(strings({"same": "True", "sorted": "False", "fewer": "False", "no order": "True"}))
def frame_equality(spark, d):
    f = table(spark, d, "nation", "n_nationkey").select("n_nationkey", "n_name")
    bare = Frame(f.df)
    return named(spark, {"same": f.equals(table(spark, d, "nation", "n_nationkey").select("n_nationkey", "n_name")), "sorted": f.equals(f.sort("n_name")), "fewer": f.equals(f.head(3)), "no order": bare.equals(Frame(f.sort("n_name").df))}, "string")


@query(strings({"at 3": "17", "place of b": "1", "holds z": "False", "count": "5", "unique": "False"}))
def index_access(spark, d):
    r, t = Index.range(spark, 2, 27, 5), Index.of(spark, ["a", "b", "b"])
    return named(spark, {"at 3": r[3], "place of b": t.get_location("b"), "holds z": t.contains("z"), "count": r.count, "unique": t.is_unique}, "string")


@query("SELECT * FROM (VALUES ('sum', 0.0), ('count', 0.0), ('rows', 0.0), ('mean is missing', 1.0)) AS t(name, value)")
def empty_input(spark, d):
    f = nulled(spark, d).filter(col("price") < 0)
    s = f["price"]
    return named(spark, {"sum": s.sum() or 0, "count": s.count(), "rows": f.group_by("priority").sum().df.count(), "mean is missing": s.mean() is None or s.mean() != s.mean()})


@query("SELECT CAST(row_number() OVER (ORDER BY o_orderpriority, o_orderkey) - 1 AS BIGINT) AS pos, o_orderkey FROM orders")
def positions_text(spark, d):
    return table(spark, d, "orders", "o_orderpriority", "o_orderkey").with_position().df.selectExpr("__pos__ AS pos", "o_orderkey")


# predicates as data


@query(strings({"columns": "a,b", "text": '((a > 5) & !b.contains("x"))', "number": "5.0", "word": "US", "quoted": "a b"}))
def predicate_forms(spark, d):
    p = (col("a") > 5) & ~col("b").contains("x")
    value = lambda chain: parse(chain)[0].args[2]
    return named(spark, {"columns": ",".join(sorted(p.columns())), "text": p, "number": float(value("filter(a == 5)")), "word": value("filter(a == US)"), "quoted": value('filter(a == "a b")')}, "string")


@query(strings({"explain shows the filter": "True", "bytes are known": "True"}))
def plan_facts(spark, d):
    lazy = table(spark, d, "orders").lazy().filter(col("o_totalprice") > 300000).select("o_orderkey")
    return named(spark, {"explain shows the filter": "o_totalprice" in lazy.explain(), "bytes are known": table(spark, d, "orders").estimated_bytes() > 0}, "string")


# text sources


@query("SELECT * FROM (VALUES ('x, \"y\"', 1.5, 'NA'), ('z', NULL, NULL), ('two\nlines', -2.0, 'q')) AS t(s, x, n)")
def csv_text(spark, d):
    return read_csv_text(spark, 's,x,n\n"x, ""y""",1.5,NA.\nz,NA,null\n"two\nlines",-2e0,q\n').df.selectExpr("s", "x", "CASE WHEN n = 'NA.' THEN 'NA' ELSE n END AS n")


@query("SELECT * FROM (VALUES (1.0, 'a'), (NULL, 'b'), (3.0, '')) AS t(col_0, col_1)")
def csv_options(spark, d):
    return read_csv_text(spark, "1;a\n?;b\n3;\n", separator=";", header=False, na_values=["?"]).df.select("col_0", "col_1")


@query("SELECT CAST(o_orderkey AS DOUBLE) AS o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey DESC LIMIT 4")
def csv_tail(spark, d):
    path = _scratch(spark, "csv")
    table(spark, d, "orders", "o_orderkey").select("o_orderkey", "o_totalprice").sort("o_orderkey").to_csv(path, distributed=True)
    return run_text(read_csv(spark, path), "filter(o_totalprice > 0) | tail(4) | select(o_orderkey, o_totalprice)").df


@query("SELECT CAST(o_orderkey AS DOUBLE) AS o_orderkey, round(sum(o_totalprice) OVER (ORDER BY o_orderkey), 2) AS total FROM orders")
def csv_cumsum(spark, d):
    path = _scratch(spark, "csv")
    table(spark, d, "orders", "o_orderkey").select("o_orderkey", "o_totalprice").sort("o_orderkey").to_csv(path, distributed=True)
    f = read_csv(spark, path).cumsum("o_totalprice", out="total", kind="decimal(20, 2)")
    return rounded(f.select("o_orderkey", "total").df, 2)


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 3")
def sort_tail(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_totalprice").sort("o_totalprice", "o_orderkey").tail(3).df


@query("SELECT * FROM (VALUES (12345678.9), (0.1), (-3.0), (100000000000.0), (1e-7)) AS t(x)")
def csv_numbers(spark, d):
    path = _scratch(spark, "csv")
    Frame(spark.createDataFrame([(12345678.9,), (0.1,), (-3.0,), (1e11,), (1e-7,)], "x double")).to_csv(path, distributed=True)
    return read_csv(spark, path).select("x").df


@query("SELECT CAST(r_regionkey AS DOUBLE) AS r_regionkey, r_name FROM region WHERE r_regionkey >= 3")
def json_file_tail(spark, d):
    path = f"{_scratch(spark, 'json')}"
    text = json_source.to_json(table(spark, d, "region", "r_regionkey").select("r_regionkey", "r_name"))
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.option("lineSep", "\n").text(path)
    return read_json(spark, path).tail(2).select("r_regionkey", "r_name").df


@query("SELECT * FROM (VALUES (0, '│ n │ s  │'), (1, '│ 1 │ x  │'), (2, '│ 2 │ NA │')) AS t(place, line)")
def display_lines(spark, d):
    lines = [x for x in box(Frame.from_columns(spark, {"n": [1, 2], "s": ["x", None]})).splitlines() if x.startswith("│")]
    return spark.createDataFrame(list(enumerate(lines)), "place int, line string")


# errors, catalog, service, command line


def _code(f: Callable[[], Any]) -> str:
    try:
        f()
    except EngineError as e:
        return f"{e.code} {e.exit_code}"
    return "none 0"


@query(strings({"column": "unknown_column 5", "verb": "unknown_operation 4", "agg": "agg_without_groupby 4", "json": "invalid_json 4", "file": "file_error 3", "frame": "unknown_dataframe 6", "fine": "none 0"}))
def error_codes(spark, d):
    f = table(spark, d, "region")
    return named(spark, {
        "column": _code(lambda: f.select("zz")), "verb": _code(lambda: run_text(f, "heda(1)")), "agg": _code(lambda: run_text(f, "agg(sum:r_regionkey)")),
        "json": _code(lambda: read_json_text(spark, "{")), "file": _code(lambda: read_csv(spark, _scratch(spark, "none"))), "frame": _code(lambda: Catalog(spark).get("zz")), "fine": _code(lambda: f.select("r_name")),
    }, "string")


@query("SELECT 'c_all' AS name, (SELECT count(*) FROM customer) AS rows, 3 AS columns UNION ALL SELECT 'c_rich', (SELECT count(*) FROM customer WHERE c_acctbal > 5000), 3")
def catalog_frames(spark, d):
    c = Catalog(spark)
    c.bind("c_all", table(spark, d, "customer", "c_custkey").select("c_custkey", "c_nationkey", "c_acctbal"))
    c.pipe("c_all", "c_rich", "filter(c_acctbal > 5000)")
    c.pipe("c_all", "c_gone", "head(1)")
    c.drop("c_gone")
    found = [(x["name"], x["rows"], x["columns"]) for x in c.list()]
    c.clear()
    return spark.createDataFrame(found, "name string, rows long, columns int")


@query("SELECT 'c_custkey' AS name, count(c_custkey) AS non_null FROM customer UNION ALL SELECT 'balance', count(*) FILTER (c_custkey % 2 = 0) FROM customer")
def catalog_info(spark, d):
    c = Catalog(spark)
    c.bind("c_info", Frame(table(spark, d, "customer").df.selectExpr("c_custkey", "CASE WHEN c_custkey % 2 = 0 THEN c_acctbal END AS balance")))
    found = [(x["name"], x["non_null"]) for x in c.info("c_info")["columns"]]
    c.clear()
    return spark.createDataFrame(found, "name string, non_null long")


@query(strings({"version": "protocol", "text": "protocol", "command": "protocol", "unknown": "unknown_dataframe", "list": "ok", "id": "7"}))
def service_replies(spark, d):
    c = Catalog(spark)
    say = lambda **x: (lambda r: "ok" if r["ok"] else r["error"]["code"])(handle(c, json.dumps(x)))
    text = handle(c, "{")
    return named(spark, {"version": say(v=2, cmd="list"), "text": text["error"]["code"], "command": say(v=1, cmd="zz"), "unknown": say(v=1, cmd="drop", name="zz"), "list": say(v=1, cmd="list"), "id": handle(c, '{"v": 1, "id": 7, "cmd": "list"}')["id"]}, "string")


@query(strings({"dry run": "0", "parse": "4", "usage": "2", "verbs": "0"}))
def command_line_codes(spark, d):
    import contextlib
    import io

    with contextlib.redirect_stdout(io.StringIO()), contextlib.redirect_stderr(io.StringIO()):
        return named(spark, {"dry run": cli.main(["run", "-c", "head(1)", "--dry-run"]), "parse": cli.main(["run", "-i", "x", "-c", "heda(1)"]), "usage": cli.main(["run", "-i", "x"]), "verbs": cli.main(["run", "--help-ops"])}, "string")
