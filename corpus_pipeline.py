"""The training-data pipeline over ``documents``: language, exact copies, near copies, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import documents, forget, kept, make_room, settled
from tessera.llm.dedup import deduplicated
from tessera.llm.jaccard import jaccard_components
from tessera.llm.langid import UNKNOWN, predict, train
from tessera.llm.packing import encode_pieces, pack
from tessera.llm.secrets import masked, scan
from tessera.llm.tokens import default_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language is recognised: null texts and texts without a letter go. lang is left as it was given.

    The models are learnt from the labelled part of the whole table, not from what a stage before kept."""
    found = predict(docs, train(documents(spark, sf_dir)), "text", "lang", "source", "n_chars")
    return found.filter(F.col("lang_pred") != UNKNOWN).select(*COLUMNS)


def identity(text_sha256: str | Column) -> Column:
    """Names a row by its doc_id, null or not, and its text."""
    return F.sha2(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), text_sha256), 256)


def own_identity() -> Column:
    return identity(F.sha2(F.coalesce("text", F.lit("")), 256))


def only(docs: DataFrame, stays: DataFrame) -> DataFrame:
    """One row of docs for each ``row`` of stays. Repeats of a row are folded before they move, so they do not crowd a task;
    of repeats the one with the largest lang, source and n_chars stays (nulls last, a text before a null)."""
    one = docs.groupBy(own_identity().alias("row")).agg(F.max(F.struct("doc_id", "text", "lang", "source", "n_chars")).alias("r"))
    return one.join(stays.select("row"), "row", "left_semi").select(*[F.col(f"r.{c}") for c in COLUMNS])


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, a null one counting as empty, exactly one row stays: one with the largest doc_id, null being the
    smallest; of several with that doc_id, one with the largest lang, source and n_chars, a text before a null."""
    return deduplicated(docs, ("lang", "source", "n_chars")).select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles with a Jaccard likeness of 0.8 or more, directly or over others, the one
    with the smallest doc_id stays, null being the largest; of several with that doc_id exactly one. Documents with fewer
    words, or with none, stay unless linked. Rows with the same doc_id and text are one row."""
    found = jaccard_components(docs.withColumn("row", own_identity()), 5, 80, 100, carry=("row",))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    stays = found.groupBy(F.coalesce(F.col("component").cast("string"), "row").alias("component")).agg(first["row"].alias("row"))
    return only(docs, stays)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; each run of text found to be secret is replaced by a mask, and n_chars follows."""
    found = scan(docs, "lang", "source").withColumn("text", masked())
    return found.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 1024 tokens: doc_id, piece, start, length, ids_crc32,
    sequence_id, offset."""
    make_room(spark)
    return pack(kept(encode_pieces(docs, default_path()), "pieces"))


STAGES = [
    ("language_id", language),
    ("exact_dedup", exact_copies),
    ("ngram_jaccard", near_copies),
    ("secret_scans", secrets),
    ("best_fit_packing", packing),
]

#: Language models, masks by statistics and packing have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written to the shared folder and read again. What a stage wrote on its way is deleted when its result
    is there, and a result when the next one is; ``common.clear`` deletes what the last one reads."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        before, docs = docs, settled(spark, lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), name)
        forget(before)
    return STAGES[-1][1](spark, docs, sf_dir)
