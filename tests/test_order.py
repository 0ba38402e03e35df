"""Row order of files, after sorts, and of columns with odd names."""

import pytest
from pyspark.sql import functions as F

import tessera.object_queries  # noqa: F401  adds its queries
from tessera.dsl import run_text
from tessera.errors import TypeMismatch
from tessera.operators.frame import Frame
from tessera.operators.ordered import Desc, with_position
from tessera.queries import QUERIES
from tessera.sources import read_csv, read_json
from tessera.sources.csv import CSVReader, to_csv

LINES = [(f"p{k % 7}", k * 3 % 101, f"note {k}") for k in range(60)]


@pytest.fixture(scope="module")
def path(tmp_path_factory):
    p = tmp_path_factory.mktemp("csv") / "x.csv"
    p.write_text("part,size,note\n" + "".join(f"{a},{b},{c}\n" for a, b, c in LINES))
    return str(p)


def notes(f):
    return [r["note"] for r in f.df.collect()]


def test_order_of_a_file(spark, path):
    f = read_csv(spark, path)
    assert notes(run_text(f, "head(5) | tail(2)")) == ["note 3", "note 4"]
    assert notes(f.tail(3)) == ["note 57", "note 58", "note 59"]
    assert notes(run_text(f, "select(note) | tail(1)")) == ["note 59"]
    assert [r["size"] for r in f.cumsum("size").df.orderBy("__at__").collect()] == [sum(x[1] for x in LINES[:k + 1]) for k in range(60)]
    assert f.iloc(7)["note"] == "note 7" and notes(f.iloc(slice(10, 12))) == ["note 10", "note 11"]
    assert sorted(notes(f.drop_duplicates(["part"]))) == [f"note {k}" for k in range(7)]
    assert to_csv(f).splitlines()[1:4] == ["p0,0,note 0", "p1,3,note 1", "p2,6,note 2"]


def test_order_of_many_splits(spark, tmp_path):
    big = tmp_path / "big.csv"
    big.write_text("k,note\n" + "".join(f"{k},note {k}\n" for k in range(20_000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "32k")
    try:
        f = read_csv(spark, str(big))
        assert f.df.rdd.getNumPartitions() > 3
        assert notes(f.tail(2)) == ["note 19998", "note 19999"] and f.iloc(12_345)["k"] == 12_345
        assert [r["k"] for r in f.head(3).df.collect()] == [0, 1, 2]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_quoted_line_ends_are_found(spark, tmp_path):
    p = tmp_path / "q.csv"
    p.write_text('a,b\n1,"x\ny"\n2,"say ""hi"""\n')
    assert [(r["a"], r["b"]) for r in read_csv(spark, str(p)).df.collect()] == [(1.0, "x\ny"), (2.0, 'say "hi"')]
    assert CSVReader(multi_line=True).read(spark, str(p)).df.count() == 2


def test_order_after_sort(spark, path):
    f = read_csv(spark, path)
    want = sorted(range(60), key=lambda k: (LINES[k][1], k))
    assert notes(f.sort("size").tail(2)) == [f"note {k}" for k in want[-2:]]
    want = sorted(range(60), key=lambda k: (-LINES[k][1], k))
    assert notes(f.sort("size", ascending=False).tail(2)) == [f"note {k}" for k in want[-2:]]
    assert notes(run_text(f, "sort(size desc) | head(4) | tail(1)")) == [f"note {want[3]}"]
    assert f.sort("size", ascending=False).iloc(2)["note"] == f"note {want[2]}"
    first = {}
    for k in want:
        first.setdefault(LINES[k][0], k)
    assert sorted(notes(f.sort("size", ascending=False).drop_duplicates(["part"]))) == sorted(f"note {k}" for k in first.values())
    assert f.sort("size").sort("part").equals(f.sort("part", "size")) and not f.sort("size").equals(f)
    with pytest.raises(TypeMismatch):
        f.sort("size").drop("size", "__at__").tail(1)


def test_json_order(spark, tmp_path):
    p = tmp_path / "x.json"
    p.write_text("[" + ",".join(f'{{"k": {k}}}' for k in range(30)) + "]")
    assert [r["k"] for r in read_json(spark, str(p)).tail(2).df.collect()] == [28, 29]


def test_names_with_points(spark):
    f = Frame.from_columns(spark, {"a.b": [3, 1, 1, None], "c d": ["x", "y", "y", "z"]})
    g = Frame(f.df, ["a.b", "__pos__"])
    assert [r["c d"] for r in g.head(2).df.collect()] == ["y", "y"] and [r["c d"] for r in g.tail(2).df.collect()] == ["x", "z"]
    assert g.drop_duplicates(["a.b", "c d"]).df.count() == 3 and f.sort("a.b", ascending=False).iloc(0)["c d"] == "x"
    assert sum(r["d"] for r in f.duplicated(["a.b"], out="d").df.collect()) == 1
    assert [r["a.b"] for r in f.cumsum("a.b").df.orderBy("__pos__").collect()] == [3.0, 4.0, 5.0, None]


def largest_share(spark, df):
    """The share of the rows that the largest of 64 partitions has, with none put together."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sizes = [r["n"] for r in df.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n"), F.max(F.hash(*df.columns))).collect()]
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    return max(sizes) / sum(sizes)


def test_no_task_ranks_all_rows(spark):
    for q in ("sort_nulls_last", "positions_text"):
        assert largest_share(spark, QUERIES[q](spark, "/root/testdata/sf0.01")) < 0.2
    d = spark.range(8000).selectExpr("id", "CASE WHEN id % 2 = 0 THEN id % 3 END AS few", "concat('t', id % 5) AS text", "CAST(id % 900 AS DECIMAL(9, 2)) AS exact", "1 AS same")
    for keys in (["few", "id"], [Desc("few"), "id"], ["text", "id"], ["exact"], ["same"], ["few", Desc("text"), "exact"]):
        assert largest_share(spark, with_position(d, keys)) < 0.2, keys


def test_positions_of_odd_values(spark):
    numbers = [3.0, None, float("nan"), -0.0, 0.0, float("inf"), -float("inf"), 1e300, None, 2.5]
    words = ["", None, "a'b", "a\\b", "ä", "z" * 150 + "1", "z" * 150 + "0", "\U0001f600", "￮", "a"]
    rows = [(k, numbers[k % 10], words[k // 10 % 10], k % 3 == 0) for k in range(600)]
    d = spark.createDataFrame(rows, "k long, x double, w string, b boolean").repartition(6)
    keyed = {"x": lambda r: (r[1] is None, r[1] != r[1] if r[1] is not None else 0, r[1] if r[1] == r[1] and r[1] is not None else 0), "w": lambda r: (r[2] is None, (r[2] or "").encode()), "b": lambda r: r[3]}
    for first, second in (("x", "w"), ("w", "b"), ("b", "x")):
        want = sorted(rows, key=lambda r: (keyed[first](r), keyed[second](r), r[0]))
        assert [r["k"] for r in with_position(d, [first, second, "k"]).orderBy("__pos__").collect()] == [r[0] for r in want]
    want = sorted(sorted(rows, key=lambda r: r[0], reverse=True), key=lambda r: (r[1] is not None and r[1] == r[1], -r[1] if r[1] is not None and r[1] == r[1] else 0))
    want = [r for r in want if r[1] is not None] + [r for r in want if r[1] is None]
    assert [r["k"] for r in with_position(d, [Desc("x"), Desc("k")]).orderBy("__pos__").collect()] == [r[0] for r in want]


def test_ties_keep_the_order_of_the_file(spark, path):
    f = read_csv(spark, path).sort("part")
    want = [r["note"] for r in f.with_position().df.orderBy("__pos__").collect()]
    assert want == [f"note {k}" for k in sorted(range(60), key=lambda k: (k % 7, k))] and f.iloc(9)["note"] == want[9]
