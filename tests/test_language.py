"""The pipe language, its JSON form, CSV and JSON, the catalog, the service and the command line."""

import json
import threading

import pytest

from tessera import cli
from tessera.catalog import Catalog
from tessera.dsl import parse, parse_json, run_json, run_text
from tessera.dsl.ops import Binary, Const, Name
from tessera.errors import AggWithoutGroupBy, ColumnNotFound, FileProblem, FrameNotFound, InvalidJSON, ParseError, TypeMismatch, UnknownOperation
from tessera.operators.frame import Frame
from tessera.service import Server, handle, request
from tessera.sources import box, read_csv, read_csv_text, read_json, read_json_text
from tessera.streaming import pipe_stream

MILLS = """mill,season,flour,bran,state
Oak,spring,1240,310,open
Ash,spring,560,140,open
Oak,autumn,980,245,open
NA,spring,90,60,shut
Elm,autumn,700,350,open
Elm,spring,130,26,shut
Ash,autumn,640,160,open
"""


@pytest.fixture(scope="module")
def mills(spark):
    return read_csv_text(spark, MILLS)


def rows(f, *names):
    return [tuple(r[n] for n in names) for r in f.df.collect()]


def test_pipeline(mills):
    f = run_text(mills, """filter(state == "open")  # only those
        | derive(margin = (flour - bran) / flour) | groupby(mill) | agg(sum:flour, mean:margin, count:state)
        | sort(flour, desc) | round(margin, 2) | rename(flour -> total) | head(2)""")
    assert rows(f, "mill", "total", "margin", "state") == [("Oak", 2220.0, 0.75, 2.0), ("Ash", 1200.0, 0.75, 2.0)]


def test_each_verb(mills):
    assert rows(run_text(mills, "sort(flour asc, bran desc) | head(1)"), "flour") == [(90.0,)]
    assert rows(run_text(mills, "tail(2)"), "season", "flour") == [("spring", 130.0), ("autumn", 640.0)]
    assert run_text(mills, "drop(bran) | select(mill, flour)").columns == ["mill", "flour"]
    assert rows(run_text(mills, "cast(flour, Int) | head(1)"), "flour") == [(1240,)]
    assert rows(run_text(mills, "cast(flour, String) | head(1)"), "flour") == [("1240.0",)]
    assert rows(run_text(mills, "cast(mill, Int) | head(1)"), "mill") == [(None,)]
    assert rows(run_text(mills, 'filter(mill contains "s") | select(mill) | head(1)'), "mill") == [("Ash",)]
    assert rows(run_text(mills, "filter(mill == Oak) | derive(x = flour / 0) | head(1)"), "x") == [(float("inf"),)]
    assert rows(run_text(mills, "derive(x = flour -1 - 2 * 3) | head(1)"), "x") == [(1233.0,)]
    assert {r["state"]: r["flour"] for r in run_text(mills, "groupby(state)").df.collect()} == {"open": 5.0, "shut": 2.0}
    assert rows(run_text(mills, "groupby(state) | agg(std:flour, median:flour) | sort(state)"), "median_flour")[0] == (700.0,)
    assert run_text(mills, "filter(flour > 1e9)").df.count() == 0 and run_text(mills, "").df.count() == 7


def test_parsing():
    assert parse("derive(a = 1 + b * 2)")[0].args == ("a", Binary("+", Const(1.0), Binary("*", Name("b"), Const(2.0))))
    assert parse("filter(x > -5)")[0].args == ("x", ">", -5) and parse("sort(a, desc)")[0].args == (("a", False),)
    assert parse(r'filter(s == "a \"b\" | c")')[0].args[2] == 'a "b" | c' and [o.verb for o in parse("| head(1) || tail(1) |")] == ["head", "tail"]


@pytest.mark.parametrize(
    ("chain", "error"),
    [
        ("frobnicate(x)", UnknownOperation), ("agg(sum:x)", AggWithoutGroupBy), ("groupby(a) | head(3)", AggWithoutGroupBy), ("groupby(a) | agg(mode:x)", UnknownOperation), ("head(x)", ParseError),
        ("filter(x ~ 3)", ParseError), ('filter(x == "a)', ParseError), ("filter(x >)", ParseError), ("select(a b)", ParseError), ("cast(a, Blob)", ParseError), ("rename(a b)", ParseError), ("head(3", ParseError), ("derive(a = (1 + 2)", ParseError),
    ],
)
def test_errors(chain, error):
    with pytest.raises(error):
        parse(chain)


def test_unknown_columns_and_types(mills):
    for chain in ("filter(zz > 1)", "sort(zz)", "select(zz)", "drop(zz)", "rename(zz -> a)", "round(zz, 1)", "cast(zz, Int)", "derive(a = zz + 1)", "groupby(zz)", "groupby(mill) | agg(sum:zz)"):
        with pytest.raises(ColumnNotFound):
            run_text(mills, chain)
    with pytest.raises(TypeMismatch):
        run_text(mills, "derive(a = mill + 1)")


def test_json_form(mills):
    ops = [{"op": "filter", "args": {"column": "flour", "operator": ">", "value": 500.0}}, {"op": "groupby", "args": {"columns": ["mill"]}}, {"op": "agg", "args": {"aggregations": [{"function": "sum", "column": "flour"}]}}, {"op": "sort", "args": {"column": "flour", "descending": True}}, {"op": "head", "args": {"n": 1}}]
    assert rows(run_json(mills, json.dumps({"operations": ops})), "mill", "flour") == [("Oak", 2220.0)]
    assert parse_json('{"operations": [{"op": "derive", "args": {"column": "a", "expression": "b + 1"}}]}')[0].args[0] == "a"
    for text, error in (("{", InvalidJSON), ("[]", InvalidJSON), ('{"operations": [{"op": "x"}]}', UnknownOperation), ('{"operations": [{"op": "head", "args": {}}]}', ParseError), ('{"operations": [{"op": "head", "args": {"n": 1.5}}]}', ParseError)):
        with pytest.raises(error):
            parse_json(text)


def test_csv(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_bytes('a,b,c,d\r\n1,"x, ""y""\nz",NA,1e3\r\n2.5,,"NA",-4\r\n3\r\n'.encode())
    for f in (read_csv(spark, str(path)), read_csv_text(spark, path.read_text().replace("\r", ""))):
        got = sorted(((r["a"], r["b"], r["c"], r["d"]) for r in f.df.collect()), key=repr)
        assert got == [(1.0, 'x, "y"\nz', None, 1000.0), (2.5, None, None, -4.0), (3.0, None, None, None)] and f.dtypes["c"] == "double"
    assert read_csv_text(spark, "1;2d\n3;0x1", separator=";", header=False).dtypes == {"col_0": "double", "col_1": "string", "__pos__": "bigint"}
    assert read_csv_text(spark, "a,b\n").df.count() == 0 and read_csv_text(spark, "a\n-\n", na_values=["-"]).dtypes["a"] == "double"
    with pytest.raises(FileProblem):
        read_csv(spark, str(tmp_path / "none.csv"))


def test_csv_text(spark):
    f = Frame.from_columns(spark, {"x": [1.0, 0.1, None, 12345678.9, 2e15], "s": ["a,b", 'q"', None, "line\nend", "z"], "b": [True, False, None, True, False]})
    assert f.to_csv() == 'x,s,b\n1,"a,b",True\n0.1,"q""",False\n,,\n12345678.9,"line\nend",True\n2000000000000000.0,z,False\n'
    assert f.head(1).to_csv(index=True, separator=";", na="-") == ";x;s;b\n0;1;a,b;True\n"
    again = read_csv_text(spark, f.to_csv())
    assert [r["x"] for r in again.df.orderBy("__pos__").collect()] == [1.0, 0.1, None, 12345678.9, 2e15]


def test_json_records(spark, tmp_path):
    f = read_json_text(spark, '[{"name": "A", "age": 30, "ok": true}, {"name": "B", "age": 2.5, "tags": [1]}]')
    assert f.dtypes["age"] == "double" and f.dtypes["ok"] == "boolean" and f.to_json() == json.dumps([{"age": 30, "name": "A", "ok": True, "tags": None}, {"age": 2.5, "name": "B", "ok": None, "tags": "[1]"}], indent=2)
    assert read_json_text(spark, "[]").columns == []
    for bad in ("not json", '{"key": "value"}', "[1]"):
        with pytest.raises(InvalidJSON):
            read_json_text(spark, bad)
    f.to_json(str(tmp_path / "x.json"))
    g = read_json(spark, str(tmp_path / "x.json"))
    assert sorted(map(tuple, g.select("age", "name", "ok").df.collect()), key=repr) == [(2.5, "B", None), (30.0, "A", True)]
    (tmp_path / "bad.json").write_text('{"key": 1}')
    with pytest.raises(InvalidJSON):
        read_json(spark, str(tmp_path / "bad.json"))


def test_display(spark):
    text = box(Frame.from_columns(spark, {"x": [1.0, 2.123456, None], "s": ["a", "bb", None]}))
    assert text.splitlines()[1] == "│      x │ s  │" and "│ 2.1235 │ bb │" in text and "│     NA │ NA │" in text


def test_catalog_and_service(spark, tmp_path):
    path = tmp_path / "mills.csv"
    path.write_text(MILLS)
    c = Catalog(spark)
    assert c.load("s", str(path))["rows"] == 7 and c.load("s", str(path))["overwritten"]
    assert c.pipe("s", "t", "filter(flour > 500)")["rows"] == 5 and spark.sql("SELECT count(*) FROM t").first()[0] == 5
    info = {x["name"]: x for x in c.info("s")["columns"]}
    assert info["mill"]["non_null"] == 6 and info["flour"]["dtype"] == "double" and c.show("t", 1)["csv"].count("\n") == 2
    c.save("t", str(tmp_path / "out" / "t.csv"))
    assert (tmp_path / "out" / "t.csv").read_text().startswith("mill,")
    assert [x["name"] for x in c.list()] == ["s", "t"] and c.status()["frames"] == 2
    c.drop("t")
    with pytest.raises(FrameNotFound):
        c.get("t")
    assert handle(c, '{"v": 2, "cmd": "list"}')["error"]["code"] == "protocol" and handle(c, "{")["error"]["code"] == "protocol"
    assert handle(c, '{"v": 1, "cmd": "drop", "name": "zz"}')["error"]["code"] == "unknown_dataframe"
    sock = str(tmp_path / "sock")
    with Server(sock, c) as server:
        threading.Thread(target=server.serve_forever, daemon=True).start()
        assert request(sock, "pipe", source="s", target="u", chain="head(2)")["data"]["rows"] == 2
        assert cli.main(["show", "u", "--socket", sock]) == 0 and cli.main(["info", "zz", "--socket", sock]) == 6
        assert request(sock, "shutdown")["ok"]
    assert cli.main(["list", "--socket", str(tmp_path / "none")]) == 2


def test_command_line(spark, tmp_path, capsys):
    path = tmp_path / "mills.csv"
    path.write_text(MILLS)
    assert cli.main(["run", "-i", str(path), "-c", "sort(flour desc) | select(mill, flour) | head(1)"]) == 0
    assert capsys.readouterr().out == "mill,flour\nOak,1240\n"
    assert cli.main(["run", "-c", "head(1)", "--dry-run"]) == 0 and cli.main(["run", "--help-ops"]) == 0
    assert cli.main(["run", "-i", str(path), "-c", "heda(1)"]) == 4 and cli.main(["run", "-i", str(path), "-c", "select(zz)"]) == 5
    assert cli.main(["run", "-i", str(tmp_path / "none"), "-c", "head(1)"]) == 3 and cli.main(["run", "-i", str(path)]) == 2
    chain = tmp_path / "c.json"
    chain.write_text('{"operations": [{"op": "head", "args": {"n": 2}}]}')
    assert cli.main(["run", "-i", str(path), "-f", str(chain), "-o", str(tmp_path / "o.csv")]) == 0 and (tmp_path / "o.csv").read_text().count("\n") == 3


def test_stream(spark, tmp_path):
    spark.createDataFrame([(1, "a"), (5, "b")], "x long, s string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("x long, s string").parquet(str(tmp_path / "in"))
    q = pipe_stream(stream, "filter(x > 2) | derive(y = x * 2)").writeStream.format("memory").queryName("piped").start()
    q.processAllAvailable()
    q.stop()
    assert [tuple(r) for r in spark.sql("SELECT * FROM piped").collect()] == [(5, "b", 10.0)]
    with pytest.raises(TypeMismatch):
        pipe_stream(stream, "sort(x)")
