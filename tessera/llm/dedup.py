"""Exact deduplication by an extendible-hash index. DataFrame functions only."""

from __future__ import annotations

from math import ceil, log2

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, kept

#: Bits of the slots that are counted: 2 ** SLOT_BITS slots of some 20 bytes each, so the directory may be broadcast.
SLOT_BITS = 16
#: A bucket or a class with more than one in MOST_HOT rows is hot; there are at most so many, so they may be broadcast.
MOST_HOT = 20_000


def split_buckets(counts: dict[int, int], capacity: int, bits: int = SLOT_BITS) -> list[tuple[int, int]]:
    """The buckets (depth, prefix) of an extendible-hash directory, from rows per slot of ``bits`` bits.

    One bucket at first; a bucket of more than ``capacity`` rows is split by its next bit, which doubles the directory
    when that bucket is as deep as the directory. It ends when all fit or ``bits`` are used up.
    """
    done, open_ = [], [(0, 0, sorted(counts))]
    while open_:
        depth, prefix, slots = open_.pop()
        if depth == bits or sum(counts[s] for s in slots) <= capacity:
            done.append((depth, prefix))
            continue
        bit = bits - depth - 1
        open_ += [(depth + 1, prefix << 1 | side, [s for s in slots if s >> bit & 1 == side]) for side in (0, 1)]
    return sorted(done)


def depths(counts: dict[int, int], capacity: int, bits: int = SLOT_BITS) -> dict[int, int]:
    """The depth of the bucket (or buckets) that each slot in use belongs to. A slot that alone is over capacity goes on
    being split, by as many further bits of the key as spread its rows over buckets of that capacity, up to all 64."""
    buckets = set(split_buckets(counts, capacity, bits))
    found = {s: next(d for d in range(bits + 1) if (d, s >> (bits - d)) in buckets) for s in counts}
    return {s: min(64, d + ceil(log2(counts[s] / capacity))) if d == bits and counts[s] > capacity else d for s, d in found.items()}


def _slot() -> Column:
    return F.shiftrightunsigned("key", 64 - SLOT_BITS)


def _placed(data: DataFrame, capacity: int) -> tuple[DataFrame, int]:
    """data with depth and bucket, the first key of the bucket's range, and the number of rows. Rows are counted per slot
    before anything moves; the counts of at most 2 ** SLOT_BITS slots reach the driver, whatever the input."""
    counts = {r["slot"]: r["n"] for r in data.select("key").groupBy(_slot().alias("slot")).agg(F.count(F.lit(1)).alias("n")).collect()}
    slots = data.sparkSession.createDataFrame(list(depths(counts, capacity).items()), "slot long, depth int")
    bucket = F.expr("CASE WHEN depth = 0 THEN 0L ELSE shiftleft(shiftrightunsigned(key, 64 - depth), 64 - depth) END")
    return data.join(F.broadcast(slots), _slot() == F.col("slot")).drop("slot").withColumn("bucket", bucket), sum(counts.values())


def index(docs: DataFrame, capacity: int = 4096, carry: tuple[str, ...] = ()) -> DataFrame:
    """The index: one entry for each distinct text: bucket, depth, key, chain, text, keep, group_size. keep is a struct of the
    row that stays: doc_id, void (whether its text is null), ``carry``.

    A row goes to the owner task of its bucket, a range of keys. The owner puts its rows in chains by comparing texts byte by
    byte, so texts that share a 64-bit key get entries of their own (chain 0, 1, ...), and takes the row to be kept and the
    size of the class from there. A bucket over capacity is split by further bits of the key. One that stays hot, as its rows
    have one text, has its rows dealt over overflow pages, each with an owner, whose entries, one for each page and text,
    are merged.

    Of equal texts the row with the largest doc_id is kept, null being the smallest; of those the largest by void and carry.
    Null text counts as empty; repeated rows count each; an empty table gives an empty index.
    """
    data = docs.select(F.coalesce("text", F.lit("")).alias("text"), F.struct("doc_id", F.col("text").isNull().alias("void"), *carry).alias("row") if carry else F.col("doc_id"))
    placed, total = _placed(data.withColumn("key", F.xxhash64("text")), capacity)
    most = max(2 * capacity, total / MOST_HOT)
    hot = placed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most).collect()
    pages = docs.sparkSession.createDataFrame([(r["bucket"], ceil(r["n"] / max(capacity, total / MOST_HOT))) for r in hot], "bucket long, pages int")
    page = F.when(F.col("pages").isNull(), 0).otherwise(1 + F.pmod(F.monotonically_increasing_id(), F.col("pages")))
    paged = placed.join(F.broadcast(pages), "bucket", "left").withColumn("page", page).drop("pages")
    largest = F.max("row" if carry else "doc_id").alias("row")
    owned = paged.repartition("bucket", "page").groupBy("bucket", "page", "depth", "key", "text").agg(largest, F.count(F.lit(1)).alias("group_size"))
    in_page = Window.partitionBy("bucket", "page", "key").orderBy("text")
    whole = owned.filter("page = 0").withColumn("chain", F.row_number().over(in_page) - 1).drop("page")
    merged = owned.filter("page > 0").groupBy("bucket", "depth", "key", "text").agg(F.max("row").alias("row"), F.sum("group_size").alias("group_size"))
    merged = merged.withColumn("chain", F.row_number().over(Window.partitionBy("bucket", "key").orderBy("text")) - 1)
    return whole.unionByName(merged.select(*whole.columns)).withColumnRenamed("row", "keep")


def exact_dedup(docs: DataFrame, capacity: int = 4096) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, bucket, chain for every row of ``docs``, found in the index, which is
    written to shared files: by key and digest, the entries of hot classes by broadcast.

    Of equal texts the largest doc_id is kept. Rows with the same text and doc_id are all marked kept. Null text counts as
    empty; a null doc_id is smaller than any other.
    """
    entries = index(docs, capacity).select("bucket", "depth", "key", "chain", F.sha2("text", 256).alias("text_sha256"), F.col("keep").alias("keep_id"), "group_size")
    entries = kept(entries, "exact-index")
    data = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("key", F.xxhash64("text"))
    placed = data.select("doc_id", "key", F.sha2("text", 256).alias("text_sha256"))
    total = entries.agg(F.sum("group_size").alias("n")).first()["n"] or 0
    is_hot = F.col("group_size") * MOST_HOT > total
    on, found = ["key", "text_sha256"], ["keep_id", "group_size", "bucket", "chain"]
    first = placed.join(F.broadcast(entries.filter(is_hot).select(*on, *found)), on, "left")
    cold = first.filter("group_size IS NULL").select("doc_id", *on).join(entries.filter(~is_hot).select(*on, *found), on)
    all_ = first.filter("group_size IS NOT NULL").unionByName(cold)
    return all_.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256", "bucket", "chain")


def deduplicated(docs: DataFrame, carry: tuple[str, ...], capacity: int = 4096) -> DataFrame:
    """Of each class of equal texts the row that stays, as the index has it: doc_id, text, ``carry``."""
    text = F.when(~F.col("keep.void"), F.col("text")).alias("text")
    return index(docs, capacity, carry).select("keep.doc_id", text, *(f"keep.{c}" for c in carry))


def op5_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


ORACLE = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
