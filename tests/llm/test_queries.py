"""The registered queries on whole tables and on empty ones, and the fingerprints against a slow version."""

import hashlib
import re

import pytest

import corpus_pipeline
from tessera.llm import spotsigs
from tessera.llm.common import clear, shared_dir
from tessera.llm.queries import QUERIES

DIR = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_toxicity": ["doc_id", "held_out", "score", "predicted"],
    "op2_document_fingerprints": ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    "op3_token_store": ["doc_id", "start", "n_tokens", "ids_crc32"],
    "op4_ngram_jaccard": ["doc_id", "n_shingles", "component_id"],
    "op5_exact_dedup": ["doc_id", "keep_id", "group_size", "kept", "text_sha256"],
    "op6_language_id": ["doc_id", "held_out", "lang_pred", "score"],
    "op7_bpe_round_trip": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    "op8_suffix_dedup": ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
    "op9_best_fit_packing": ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
    "op10_secret_scans": ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
}


@pytest.fixture(scope="module")
def empty_dir(spark, tmp_path_factory):
    out = tmp_path_factory.mktemp("empty")
    for name in ("documents", "labels"):
        spark.read.parquet(f"{DIR}/{name}.parquet").limit(0).write.parquet(str(out / f"{name}.parquet"))
    return str(out)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, empty_dir, name):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    got = QUERIES[name](spark, DIR)
    assert got.columns[:len(COLUMNS[name])] == COLUMNS[name]
    ids = [r["doc_id"] for r in got.select("doc_id").collect()]
    assert set(ids) == {r["doc_id"] for r in docs.collect()} and (name == "op9_best_fit_packing" or len(ids) == docs.count())
    assert QUERIES[name](spark, empty_dir).collect() == []
    clear(spark)


def test_pipeline_run_leaves_nothing_behind(spark, empty_dir):
    import os

    shared = shared_dir(spark).removeprefix("file://")
    clear(spark)
    before = set(os.listdir(shared))
    got = corpus_pipeline.run(spark, DIR)
    assert got.columns == COLUMNS["op9_best_fit_packing"] and got.count() > 100
    assert len(set(os.listdir(shared)) - before) <= 2  # what the last stage reads
    clear(spark)
    assert set(os.listdir(shared)) == before
    assert corpus_pipeline.run(spark, empty_dir).collect() == []


def slow_words(text):
    """Words and whether they are anchors."""
    words = "".join(c if c.isalpha() or c.isspace() or re.match(r"\d", c) else "" for c in text.lower()).split()
    return [(w, w in spotsigs.ANCHORS.split()) for w in words]


def slow_chains(text):
    words = slow_words(text)
    found = set()
    for i, (w, anchor) in enumerate(words):
        if anchor:
            found.add((w, *[x for x, common in words[i + 1:i + 1 + spotsigs.REACH] if not common][:spotsigs.CHAIN]))
    return found or {("words", *[w for w, _ in words]) if words else ("text", text)}


def likeness(a, b):
    return len(a & b) / len(a | b)


def test_fingerprints_against_slow(spark):
    rows = sorted((r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{DIR}/documents.parquet").collect())
    got = {r["doc_id"]: r for r in QUERIES["op2_document_fingerprints"](spark, DIR).collect()}
    prints = {}
    for k, (d, text) in enumerate(rows):
        follower = rows[(k + 1) % len(rows)][1]
        half = len(text) // 2
        edited = text[:len(text) - half] + follower[:half]
        r = got[d]
        a, b, c = map(slow_chains, (text, edited, follower))
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert len(r["fingerprint"]) == 8 * len(a) and len(r["edited_fingerprint"]) == 8 * len(b)
        assert r["near_edited"] == pytest.approx(likeness(a, b)) and r["near_next"] == pytest.approx(likeness(a, c))
        assert prints.setdefault(frozenset(a), r["fingerprint"]) == r["fingerprint"]
    assert len(set(prints.values())) == len(prints)
    clear(spark)


def test_no_break_spaces_part_words(spark):
    text = "the cat and the dog were in the house of a friend"
    d = spark.createDataFrame([(1, text), (2, text.replace(" ", "\u00a0")), (3, text.replace(" ", "\u2003"))], "doc_id long, text string")
    got = {tuple(r["signatures"]) for r in spotsigs.fingerprints(d).collect()}
    assert len(got) == 1 and len(next(iter(got))) == len(slow_chains(text))
