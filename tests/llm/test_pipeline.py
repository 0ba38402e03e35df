import collections

import pytest

import corpus_pipeline
from tessera.llm.common import kept
from tessera.llm.secrets import scan

from .test_operators import brute_components, brute_spans

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(kept(stage(spark, out[-1], DIR), name))
    return [{r["doc_id"]: r for r in d.collect()} for d in out[:-1]] + [out[-1].collect()]


def test_stages(spark, stages):
    docs, language, exact, near, clean, packed = stages
    assert set(language) == {k for k, r in docs.items() if any(c.isalpha() for c in r["text"] or "")}
    by = collections.defaultdict(list)
    for k, r in language.items():
        by[r["text"]].append(k)
    assert set(exact) == {max(x) for x in by.values()}
    assert set(near) == {c for *_, c in brute_components([(k, r["text"]) for k, r in exact.items()], 5, 80, 100)}
    assert set(clean) == set(near)
    for k, r in clean.items():
        assert brute_spans(r["text"]) == "" and r["n_chars"] == len(r["text"])
        if "[SECRET]" not in r["text"]:
            assert r["text"] == near[k]["text"]
    assert {r["doc_id"] for r in packed} == set(clean)
    assert all(set(r.asDict()) == set(corpus_pipeline.COLUMNS) for s in stages[:-1] for r in s.values())


def test_masked_documents_are_those_with_spans(spark, stages):
    near, clean = stages[3], stages[4]
    d = spark.createDataFrame([(k, r["text"]) for k, r in near.items()], "doc_id long, text string")
    with_spans = {r["doc_id"] for r in scan(d).filter("size(spans) > 0").select("doc_id").collect()}
    assert {k for k in clean if clean[k]["text"] != near[k]["text"]} == with_spans


def test_odd_rows(spark):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "!!", "en", "s", 2), (4, "a b c", None, "s", 5), (4, "a b c", "en", "s", 5), (None, "no id", "en", "s", 5)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        d = kept(stage(spark, d, DIR), "odd")
    assert {r["doc_id"] for r in d.collect()} <= {4, None} and d.filter("doc_id = 4").count() >= 1
    empty = spark.createDataFrame([], d.schema)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, DIR).collect() == []


LONG = " ".join(f"word{k}" for k in range(20))


def test_repeated_and_null_ids(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(4, "x"), (4, "y"), (5, "x"), (6, "z"), (6, "z"), (None, "no id"), (None, "no id"), (None, "other"), (None, "y"), (8, ""), (7, None), (3, LONG), (9, LONG + " more"), (None, "!")]
    d = spark.createDataFrame([(k, t, "en", "s", 1) for k, t in rows], schema).repartition(3)
    exact = kept(corpus_pipeline.exact_copies(spark, d, DIR), "odd")
    want = [(4, "y"), (5, "x"), (6, "z"), (None, "no id"), (None, "other"), (8, ""), (3, LONG), (9, LONG + " more"), (None, "!")]
    assert collections.Counter((r["doc_id"], r["text"]) for r in exact.collect()) == collections.Counter(want)
    near = corpus_pipeline.near_copies(spark, exact, DIR)
    want.remove((9, LONG + " more"))
    assert collections.Counter((r["doc_id"], r["text"]) for r in near.collect()) == collections.Counter(want)


def test_executors_give_heap_back_before_packing(spark):
    beans = spark.sparkContext._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans
    # with a local master the executor is this JVM; the last bean is the one of full collections
    full = lambda: list(beans())[-1].getCollectionCount()
    d = spark.createDataFrame([(1, "some text", "en", "s", 9)], "doc_id long, text string, lang string, source string, n_chars long")
    before = full()
    assert [(r["doc_id"], r["offset"]) for r in corpus_pipeline.packing(spark, d, DIR).collect()] == [(1, 0)]
    assert full() > before
