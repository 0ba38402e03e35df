"""A content-addressed store of token ids: chunks cut by rolling hashes, recipes, Merkle manifests."""

from __future__ import annotations

import hashlib
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import PIECE, BLOCK, documents, map_batches, new_path, parts, running_start, texts, with_block
from .tokens import default_path, encoder

#: Ids that a rolling hash sees, its zero bits at a cut (512 ids on average), and the longest chunk.
WINDOW, CUT_BITS, LONGEST = 8, 9, 4096
KEY_BYTES = 16


def cut_points(ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Ends of chunks in the ids of many documents (``ends``: where each ends, ascending, no document empty).

    A chunk ends after an id if the hash of the WINDOW ids up to it has CUT_BITS zero bits, after LONGEST ids, and at the
    end of a document. Within a document cuts depend on the ids nearby alone, so equal passages get equal chunks.
    """
    g = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    g ^= g >> np.uint64(31)
    h = g.copy()
    for k in range(1, WINDOW):
        h[k:] += g[:-k] << np.uint64(k)
    h *= np.uint64(0xD6E8FEB86659FD93)
    cuts = np.union1d(np.flatnonzero(h >> np.uint64(64 - CUT_BITS) == 0) + 1, ends)
    gaps = np.diff(np.concatenate([[0], cuts]))
    wide = np.flatnonzero(gaps > LONGEST)
    extra = [np.arange(cuts[k] - gaps[k] + LONGEST, cuts[k], LONGEST) for k in wide]
    return np.union1d(cuts, np.concatenate(extra)) if extra else cuts


def packed(ids: np.ndarray, squeeze) -> bytes:
    """A chunk's bytes in the store: b"2" or b"4", bytes of an id, then the compressed little-endian ids."""
    width = "<u2" if not len(ids) or ids.max() < 1 << 16 else "<u4"
    return width[-1].encode() + squeeze(ids.astype(width).tobytes())


def unpacked(data: bytes, stretch) -> np.ndarray:
    return np.frombuffer(stretch(data[1:]), f"<u{data[:1].decode()}").astype(np.uint32)


def chunk_key(ids: np.ndarray) -> bytes:
    return hashlib.blake2b(ids.astype("<u4").tobytes(), digest_size=KEY_BYTES).digest()


_ROWS = "kind string, key binary, doc_id long, n_tokens long, data binary"


def _encode(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """Rows of two kinds: "recipes" (doc_id, n_tokens, data: its chunks' keys in a row) and "chunks" (key, n_tokens, data).
    A task gives each chunk once as long as it remembers the key."""

    def make():
        enc, seen, squeeze = encoder(path), set(), zstandard.ZstdCompressor(level=1).compress

        def one(batch: pa.RecordBatch):
            doc_ids, text = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for part in parts(text, 4_000_000):
                plain, at = enc.encode(text[part])
                n_docs = len(at) - 1
                ids = np.insert(plain, at[1:], np.uint32(end_id))
                ends = at[1:] + np.arange(1, n_docs + 1)
                cuts = cut_points(ids, ends)
                short = ids.astype("<u2") if not len(ids) or ids.max() < 1 << 16 else None
                raw = memoryview(ids.tobytes())
                keys, a = [], 0
                kind, key, doc, count, data = [], [], [], [], []
                for b in cuts.tolist():
                    k = hashlib.blake2b(raw[4 * a:4 * b], digest_size=KEY_BYTES).digest()
                    keys.append(k)
                    if k not in seen:
                        if len(seen) > 500_000:
                            seen.clear()
                        seen.add(k)
                        kind.append("chunks")
                        key.append(k)
                        doc.append(None)
                        count.append(b - a)
                        data.append(b"2" + squeeze(short[a:b].tobytes()) if short is not None else packed(ids[a:b], squeeze))
                    a = b
                upto = np.searchsorted(cuts, ends, "right").tolist()
                a = 0
                begins = np.concatenate([[0], ends[:-1]]).tolist()
                for k, d in enumerate(doc_ids[part]):
                    own = b"".join(keys[a:upto[k]])
                    kind.append("recipes")
                    key.append(hashlib.blake2b(own, digest_size=KEY_BYTES).digest())
                    doc.append(d)
                    count.append(int(ends[k]) - begins[k])
                    data.append(own)
                    a = upto[k]
                yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(key, pa.binary()), pa.array(doc, pa.int64()), pa.array(count, pa.int64()), pa.array(data, pa.binary())], names=["kind", "key", "doc_id", "n_tokens", "data"])

        return one

    return map_batches(texts(docs), make, _ROWS, 4 * PIECE)


def _once(rows: DataFrame) -> DataFrame:
    """Each chunk key once: rows of a key meet in one task, which keeps the first."""

    def make():
        seen: set = set()

        def one(batch: pa.RecordBatch):
            keep = []
            for kind, key in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                keep.append(kind != "chunks" or key not in seen)
                if kind == "chunks":
                    seen.add(key)
            return batch.filter(pa.array(keep))

        return one

    return map_batches(rows, make, _ROWS)


def write_store(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2) -> None:
    """Writes the documents' ids below ``path``: data/kind=chunks (key, n_tokens, data), recipes (doc_id, start, n_tokens,
    keys; files and rows by ascending doc_id, null first) and manifest (block of ids, leaves, root).

    start counts the ids of all documents before. The leaf of a document is the SHA-256 of its doc_id, n_tokens and keys;
    the root of a block that of its leaves in order, and the root of the store, a table of its own, that of the blocks' roots.
    Null text is empty, so it has the end id only.
    """
    spark = docs.sparkSession
    # equal keys meet; recipes are spread by their own digest with the doc_id, or copies of a text would meet in one task
    spread = F.when(F.col("kind") == "chunks", F.xxhash64("key")).otherwise(F.xxhash64("doc_id"))
    _once(_encode(docs, tokenizer, end_id).repartition(spread)).write.partitionBy("kind").option("compression", "none").parquet(f"{path}/data")
    recipes = _stored(spark, path, "recipes").select("doc_id", "n_tokens", F.col("data").alias("keys"))
    started = running_start(recipes, "n_tokens", "start", "keys")
    started.select("doc_id", "start", "n_tokens", "keys").repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "start").write.parquet(f"{path}/recipes")
    manifest(spark.read.parquet(f"{path}/recipes")).write.parquet(f"{path}/manifest")
    root_of(spark.read.parquet(f"{path}/manifest")).write.parquet(f"{path}/root")


def _stored(spark: SparkSession, path: str, kind: str) -> DataFrame:
    return spark.read.schema(_ROWS).parquet(f"{path}/data").filter(F.col("kind") == kind)


def manifest(recipes: DataFrame) -> DataFrame:
    """block, leaves, root: one row for each BLOCK ids. A root is taken over its leaves in order of start."""
    leaf = F.sha2(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "n_tokens", F.hex("keys")), 256)
    leaves = with_block(recipes).select("__block", "start", leaf.alias("leaf"))
    groups = leaves.groupBy(F.col("__block").alias("block")).agg(F.array_sort(F.collect_list(F.struct("start", "leaf"))).alias("x"))
    return groups.select("block", F.size("x").alias("leaves"), F.sha2(F.concat_ws("", F.col("x.leaf")), 256).alias("root"))


def root_of(manifests: DataFrame) -> DataFrame:
    """One row: the root over all blocks. Blocks are a thousandth of the documents."""
    return manifests.agg(F.sha2(F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("block", "root"))), lambda x: x["root"])), 256).alias("root"))


def verify(spark: SparkSession, path: str) -> None:
    """Raises if a recipe differs from the manifest, or the manifest from the root of the whole store."""
    if spark.read.parquet(f"{path}/root").first()["root"] != root_of(spark.read.parquet(f"{path}/manifest")).first()["root"]:
        raise ValueError(f"the manifest in {path} doesn't match its root")
    old, new = spark.read.parquet(f"{path}/manifest"), manifest(spark.read.parquet(f"{path}/recipes"))
    wrong = old.alias("a").join(new.alias("b"), F.col("a.block").eqNullSafe(F.col("b.block")), "full").filter(~F.col("a.root").eqNullSafe(F.col("b.root")) | ~F.col("a.leaves").eqNullSafe(F.col("b.leaves")))
    if wrong.limit(1).count():
        raise ValueError(f"the recipes in {path} don't match their manifest")


def read_chunks(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """key, n, crc (of the ids as little-endian 32-bit integers) and, if asked for, ids of every chunk, read from the files;
    a chunk whose bytes don't have its key raises."""

    def make():
        stretch = zstandard.ZstdDecompressor().decompress

        def one(batch: pa.RecordBatch):
            keys, n, crc, blobs = batch.column(0).to_pylist(), [], [], []
            for key, data in zip(keys, batch.column(1).to_pylist(), strict=True):
                ids = unpacked(data, stretch)
                raw = ids.astype("<u4").tobytes()
                if hashlib.blake2b(raw, digest_size=KEY_BYTES).digest() != key:
                    raise ValueError("a chunk's bytes don't match its key")
                n.append(len(ids))
                crc.append(zlib.crc32(raw))
                blobs.append(raw)
            more = [pa.array(blobs, pa.binary())] if with_ids else []
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(n, pa.int64()), pa.array(crc, pa.int64()), *more], names=["key", "n", "crc", *(["ids"] if with_ids else [])])

        return one

    files = _stored(spark, path, "chunks").select("key", "data")
    return map_batches(files, make, "key binary, n long, crc long" + (", ids binary" if with_ids else ""))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids: every document put together from its chunks."""
    used = _uses(spark.read.parquet(f"{path}/recipes"))
    joined = used.join(read_chunks(spark, path, True), "key")
    whole = joined.groupBy("doc_id", "start", "n_tokens").agg(F.array_sort(F.collect_list(F.struct("pos", "ids"))).alias("x"))
    return whole.select("doc_id", "start", "n_tokens", F.expr("aggregate(x, cast('' AS binary), (a, c) -> concat(a, c.ids))").alias("ids"))


def _uses(recipes: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, pos, key: a row for each chunk of each document."""
    each = f"transform(sequence(0, int(length(keys) / {KEY_BYTES}) - 1), i -> substring(keys, i * {KEY_BYTES} + 1, {KEY_BYTES}))"
    return recipes.select("doc_id", "start", "n_tokens", F.posexplode(F.expr(each)).alias("pos", "key"))


_POLY = np.uint64(0xEDB88320)


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products modulo the CRC-32 polynomial, bits reflected."""
    out, b = np.zeros_like(a), b.copy()
    for bit in range(31, -1, -1):
        out ^= np.where(a >> np.uint64(bit) & np.uint64(1), b, np.uint64(0))
        b = np.where(b & np.uint64(1), b >> np.uint64(1) ^ _POLY, b >> np.uint64(1))
    return out


@lru_cache(1 << 16)
def _shift(n: int) -> int:
    """x to the power 32 n modulo the polynomial: what n ids after a prefix do to its checksum."""
    out, square = np.array([1 << 31], np.uint64), np.array([1 << 30], np.uint64)
    k = 32 * n
    while k:
        if k & 1:
            out = _times(out, square)
        square = _times(square, square)
        k >>= 1
    return int(out[0])


def joined_crcs(crcs: list[list[int]], sizes: list[list[int]]) -> np.ndarray:
    """The CRC-32 of each list of runs put together, from the runs' checksums and numbers of ids."""
    out = np.array([c[0] for c in crcs], np.uint64)
    for k in range(1, max(map(len, crcs), default=0)):
        live = np.flatnonzero(np.fromiter((len(c) > k for c in crcs), bool, len(crcs)))
        shift = np.fromiter((_shift(sizes[i][k]) for i in live), np.uint64, len(live))
        out[live] = _times(out[live], shift) ^ np.fromiter((crcs[i][k] for i in live), np.uint64, len(live))
    return out


def digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document from the store's files: every chunk is read, checked against
    its key and summed up once; a document's checksum follows from its chunks' checksums in the recipe's order. A document
    whose chunks are missing or count otherwise than its recipe raises."""

    def make():
        def one(batch: pa.RecordBatch):
            doc, start, n, runs = (batch.column(k).to_pylist() for k in range(4))
            sizes, crcs = [[r["n"] for r in x] for x in runs], [[r["crc"] for r in x] for x in runs]
            if any(None in x or sum(x) != k for x, k in zip(sizes, n, strict=True)):
                raise ValueError("a chunk is missing, or a document's chunks don't have its number of ids")
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (doc, start, n, joined_crcs(crcs, sizes).astype(np.int64))], names=["doc_id", "start", "n_tokens", "ids_crc32"])

        return one

    verify(spark, path)
    found = _uses(spark.read.parquet(f"{path}/recipes")).join(read_chunks(spark, path), "key", "left")
    runs = found.groupBy("doc_id", "start", "n_tokens").agg(F.array_sort(F.collect_list(F.struct("pos", "n", "crc"))).alias("runs"))
    return map_batches(runs, make, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op3_token_store(spark, sf_dir: str) -> DataFrame:
    path = new_path(spark, "token-store")
    write_store(documents(spark, sf_dir), path, default_path())
    return digests(spark, path)


__all__ = ["BLOCK", "digests", "op3_token_store", "read_documents", "root_of", "verify", "write_store"]
