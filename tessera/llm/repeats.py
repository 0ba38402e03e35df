"""Removal of repeated passages: suffixes that share their first 200 bytes, from merged Burrows-Wheeler transforms.

All 200-byte strings of the corpus are told apart by an anchor first: of the 40-byte grams in a string, the one of least hash
(the leftmost of equals). Equal strings have equal anchors in equal places, so a string whose anchor occurs once is unique.
Runs of neighbouring strings with one anchor make a context. Anchors whose contexts are all alike are settled by counting.
Of the others, contexts of one anchor meet in one task, which builds the transform of each shard of them and merges the
transforms by refining their interleave, one symbol of depth at a time; after 200 bytes, positions that still stand in one
block start with equal strings.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, forget, kept, map_batches, parts, release, ship

LENGTH, GRAM = 200, 40
SPAN = LENGTH - GRAM + 1
#: Bytes of a symbol of the transforms.
SYMBOL = 8
DEPTH = LENGTH // SYMBOL
#: Contexts of one anchor that one task compares. Anchors with more are compared through all their strings' hashes instead.
TOGETHER = 2_000
#: An anchor with more than one in so many runs is heavy.
MOST_HEAVY = 20_000
#: Positions that one merge takes, fewer than there are 16-bit symbols.
MERGED = 60_000
SHARDS = 4
_BYTES = np.random.default_rng(11).integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class _Hashes:
    """Hashes of any run of the bytes, from running sums of bytes times powers."""

    def __init__(self, raw: np.ndarray):
        self.sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_BYTES[raw] * _powers(_BASE, len(raw)), out=self.sums[1:])
        self.back = _powers(_INVERSE, len(raw) + 1)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mixed((self.sums[end] - self.sums[start]) * self.back[start] + (end - start).astype(np.uint64))

    def grams(self, size: int) -> np.ndarray:
        return _mixed((self.sums[size:] - self.sums[:-size]) * self.back[:len(self.sums) - size] + np.uint64(size))


def runs_of(raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of strings with one anchor, in documents that end at ``ends``: first string's start, number of strings, the
    anchor's place in the first string, the anchor's hash, the hash of all bytes of the run's strings with that place."""
    begins = np.concatenate([[0], ends[:-1]])
    count = np.maximum(ends - begins - LENGTH + 1, 0)
    if len(raw) < LENGTH or not count.any():
        return (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64),) * 2
    h = _Hashes(raw)
    gram = h.grams(GRAM)
    least = (gram & ~np.uint64((1 << 24) - 1)) | np.arange(len(gram), dtype=np.uint64)  # ties: the leftmost
    width = 1
    while 2 * width <= SPAN:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    least = np.minimum(least[:len(least) - (SPAN - width)], least[SPAN - width:])
    anchor = (least & np.uint64((1 << 24) - 1)).astype(np.int64)
    total = np.cumsum(count)
    at = np.arange(total[-1]) - np.repeat(total - count, count) + np.repeat(begins, count)
    anchor = anchor[at]
    new = np.ones(len(at), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1)
    first = np.flatnonzero(new)
    n = np.diff(np.append(first, len(at)))
    start, place = at[first], anchor[first] - at[first]
    whole = h.of(start, start + n + LENGTH - 1)
    return start, n, place, gram[anchor[first]], _mixed(whole * np.uint64(LENGTH) + place.astype(np.uint64))


def _raw(batch: pa.RecordBatch, text: int):
    values = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column(text).to_pylist()]
    for part in parts(values, 2_000_000):
        some = values[part]
        big = [k for k, v in enumerate(some) if len(v) >= 1 << 23]
        for k in big:  # one text beyond the places of an anchor is taken in overlapping pieces
            yield from _pieces(part.start + k, some[k])
            some[k] = b""
        yield np.arange(part.start, part.stop), np.zeros(len(some), np.int64), some


def _pieces(row: int, value: bytes, size: int = 1 << 22):
    for a in range(0, max(1, len(value) - LENGTH + 1), size):
        yield np.array([row]), np.array([a]), [value[a:a + size + LENGTH - 1]]


def _runs(docs: DataFrame) -> DataFrame:
    """anchor, context, rid, start, n: the runs of each document; rid names the row."""

    def make():
        def one(batch: pa.RecordBatch):
            rid = batch.column(0).to_numpy()
            for rows, shift, some in _raw(batch, 1):
                ends = np.cumsum([len(x) for x in some])
                start, n, _, anchor, context = runs_of(np.frombuffer(b"".join(some), np.uint8), ends)
                of = np.searchsorted(ends, start, "right")
                begins = np.concatenate([[0], ends[:-1]])
                cols = [anchor.view(np.int64), context.view(np.int64), rid[rows[of]], start - begins[of] + shift[of], n.astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["anchor", "context", "rid", "start", "n"])

        return one

    return map_batches(docs.select("rid", "text"), make, "anchor long, context long, rid long, start long, n int")


class Transform:
    """The Burrows-Wheeler transform of a shard: over strings of symbols (1 and up) that each end in an end mark, the symbol
    before each suffix in sorted order (0 where none is). places: what the caller knows each suffix by, -1 for end marks."""

    def __init__(self, strings: list[np.ndarray], places: list[np.ndarray]):
        n = len(strings)
        size = np.fromiter(map(len, strings), np.int64, n)
        text = np.zeros(size.sum() + n, np.int64)
        own = np.arange(size.sum()) + np.repeat(np.arange(n), size)
        text[own] = np.concatenate(strings)
        mark = np.repeat(np.cumsum(size) + np.arange(n), size + 1)
        left = mark - np.arange(len(text))
        rank, step = text, 1
        while step <= size.max():  # doubling; a suffix ends at its end mark, and ties go by the order of strings
            after = np.zeros_like(rank)
            more = np.flatnonzero(left >= step)
            after[more] = rank[more + step]
            _, rank = np.unique(rank * (rank.max() + 1) + after, return_inverse=True)
            step *= 2
        order = np.argsort(rank, kind="stable")
        before = np.zeros_like(text)
        before[1:] = text[:-1]
        where = np.full(len(text), -1, np.int64)
        where[own] = np.concatenate(places)
        self.symbols, self.places, self.marks = before[order], where[order], n


def merge(shards: list[Transform], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The interleave of the shards' suffixes by their first ``depth`` symbols: the places in merged order, and block
    numbers, equal for suffixes with equal beginnings.

    The interleave holds one shard number per suffix. One refinement reads each shard's transform in the interleave's order
    and deals the shard numbers out by symbol, keeping their order within a symbol: suffixes sorted by k symbols become
    suffixes sorted by k + 1. A border between blocks arises where symbols differ or the blocks dealt from did; the
    refinement in which it arises is the common prefix of its neighbours, so common prefixes come without comparisons.
    """
    narrow = np.uint16 if max(int(s.symbols.max()) for s in shards) < 1 << 16 else np.int64
    transforms = [s.symbols.astype(narrow) for s in shards]
    marks = np.repeat(np.arange(len(shards)), [s.marks for s in shards]).astype(np.uint8)
    shard = np.repeat(np.arange(len(shards)), [len(t) for t in transforms]).astype(np.uint8)
    block = np.zeros(len(shard), np.int64)
    symbols = np.empty(len(shard), narrow)
    for _ in range(depth):
        for k, t in enumerate(transforms):
            symbols[shard == k] = t
        source = np.flatnonzero(symbols)
        source = source[np.argsort(symbols[source], kind="stable")]
        dealt, from_ = symbols[source], block[source]
        border = np.zeros(len(shard), bool)
        border[len(marks)] = True
        border[len(marks) + 1:] = (dealt[1:] != dealt[:-1]) | (from_[1:] != from_[:-1])
        shard = np.concatenate([marks, shard[source]])
        block = np.cumsum(border)
    places = np.empty(len(shard), np.int64)
    for k, s in enumerate(shards):
        places[shard == k] = s.places
    return places, block


def repeated_starts(contexts: list[bytes], counts: list[int]) -> list[np.ndarray]:
    """For each context, which of its first ``counts`` strings of LENGTH bytes also starts in another context."""
    size = np.fromiter(map(len, contexts), np.int64, len(contexts))
    raw = np.frombuffer(b"".join(contexts) + bytes(SYMBOL), np.uint8)
    eight = np.lib.stride_tricks.sliding_window_view(raw, SYMBOL)[:-1]
    begins = np.cumsum(size) - size
    _, rank = np.unique(np.ascontiguousarray(eight).view(np.uint64).ravel(), return_inverse=True)
    rank = rank + 1
    # a context is SYMBOL strings of symbols, one for each remainder of the place
    strings, places = [], []
    for a, n in zip(begins.tolist(), size.tolist(), strict=True):
        for r in range(SYMBOL):
            at = np.arange(a + r, a + n - SYMBOL + 1, SYMBOL)
            strings.append(rank[at])
            places.append(at)
    per = -(-len(strings) // SHARDS)
    shards = [Transform(strings[k:k + per], places[k:k + per]) for k in range(0, len(strings), per)]
    at, block = merge(shards, DEPTH)
    size_of = np.bincount(block)
    flags = np.zeros(len(raw), bool)
    starts = np.zeros(len(raw), bool)
    for a, n in zip(begins.tolist(), counts, strict=True):
        starts[a:a + n] = True
    real = at >= 0
    alike = size_of[block] > 1
    flags[at[real & alike]] = True
    flags &= starts
    return [flags[a:a + n] for a, n in zip(begins.tolist(), counts, strict=True)]


def _spans(flags: np.ndarray) -> list[dict]:
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return [{"a": a, "b": b} for a, b in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True)]


_SPANS = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
_SETTLED = "anchor long, context long, spans array<struct<a:int,b:int>>"


def _merged(contexts: DataFrame) -> DataFrame:
    """anchor, context, spans from contexts (anchor, context, n, content) that come sorted by anchor."""

    def run(batches):
        held: list[tuple] = []
        total = 0

        def settle():
            found = repeated_starts([h[3] for h in held], [h[2] for h in held])
            return pa.RecordBatch.from_arrays([pa.array([h[0] for h in held], pa.int64()), pa.array([h[1] for h in held], pa.int64()), pa.array([_spans(f) for f in found], _SPANS)], names=["anchor", "context", "spans"])

        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if total >= MERGED and row[0] != held[-1][0]:
                    yield settle()
                    held, total = [], 0
                held.append(row)
                total += len(row[3])
        if held:
            yield settle()

    ship(contexts.sparkSession)
    return contexts.select("anchor", "context", "n", "content").mapInArrow(run, _SETTLED)


def _by_hash(contexts: DataFrame) -> DataFrame:
    """The same for anchors with very many contexts: each string's hash is a row, and rows of a hash are counted wherever
    they are, so no task holds an anchor's contexts together."""

    def make():
        def one(batch: pa.RecordBatch):
            anchor, context, n, content = (batch.column(k).to_pylist() for k in range(4))
            for a, c, m, x in zip(anchor, context, n, content, strict=True):
                h = _Hashes(np.frombuffer(x, np.uint8))
                at = np.arange(m)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(m, a)), pa.array(np.full(m, c)), pa.array(at.astype(np.int32)), pa.array(h.of(at, at + LENGTH).view(np.int64))], names=["anchor", "context", "i", "h"])

        return one

    rows = map_batches(contexts.select("anchor", "context", "n", "content"), make, "anchor long, context long, i int, h long")
    twice = rows.groupBy("h").agg(F.count(F.lit(1)).alias("times")).filter("times > 1")
    found = rows.join(twice, "h", "left_semi").groupBy("anchor", "context").agg(F.collect_list("i").alias("i"))
    return found.select("anchor", "context", F.expr("transform(i, x -> named_struct('a', x, 'b', x + 1))").alias("spans"))


def _removed(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept of every row."""

    def make():
        def one(batch: pa.RecordBatch):
            out = []
            for doc, text, x in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                done, kept_parts, removed, runs = 0, [], 0, 0
                end = -1
                for s in sorted((s["a"], s["b"]) for s in x or ()):
                    if s[0] > end:  # a new run; one that starts where the last ended goes on with it
                        kept_parts.append(raw[done:s[0]])
                        runs += 1
                        removed += s[1] - s[0]
                        end = s[1]
                    elif s[1] > end:
                        removed += s[1] - end
                        end = s[1]
                    done = end
                kept_parts.append(raw[done:])
                left = b"".join(kept_parts)
                out.append((doc, len(raw), removed, runs, hashlib.sha256(left).hexdigest(), left))
            cols = list(zip(*out, strict=True))
            kinds = [pa.int64()] * 4 + [pa.string(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

        return one

    joined = docs.join(spans, "rid", "left").select("doc_id", "text", "x")
    return map_batches(joined, make, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def without_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (bytes) of every row: each byte that lies in a string of LENGTH
    bytes which also starts elsewhere, in this document or another, is removed.

    Null text is empty. Texts shorter than LENGTH lose nothing. Rows count as documents each, with equal ids or texts too.
    """
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("rid", F.xxhash64("doc_id", "text"))
    runs = kept(_runs(d), "runs")
    # counted before rows move; anchors with one in MOST_HEAVY runs, at most so many, are told to all tasks, so their rows stay
    twice = kept(runs.groupBy("anchor").agg(F.count(F.lit(1)).alias("times"), (F.min("context") != F.max("context")).alias("mixed")).filter("times > 1"), "anchors")
    is_heavy = F.col("times") * MOST_HEAVY > runs.count()
    told = runs.join(F.broadcast(twice.filter(is_heavy).select("anchor", "mixed")), "anchor", "left")
    columns = ("anchor", "context", "rid", "start", "n", "mixed")
    light = told.filter("mixed IS NULL").drop("mixed").join(twice.filter(~is_heavy).select("anchor", "mixed"), "anchor")
    shared = kept(told.filter("mixed IS NOT NULL").select(*columns).unionByName(light.select(*columns)), "shared")
    forget(runs, twice)
    release(d.sparkSession)
    of = shared.filter("mixed").groupBy("anchor", "context").agg(F.count(F.lit(1)).alias("times"), F.min(F.struct("rid", "start", "n")).alias("at"))
    group = of.groupBy("anchor").agg(F.count(F.lit(1)).alias("together"))
    of = of.join(group, "anchor").select("anchor", "context", "times", "together", "at.rid", "at.start", "at.n")
    content = F.expr(f"substring(cast(text AS binary), int(start + 1), int(n + {LENGTH - 1}))")
    whole = kept(of.join(d.select("rid", "text"), "rid").select("anchor", "context", "times", "together", "n", content.alias("content")).dropDuplicates(["anchor", "context"]), "contexts")
    few = whole.filter(F.col("together") <= TOGETHER).repartition("anchor").sortWithinPartitions("anchor", "context")
    settled = _merged(few).unionByName(_by_hash(whole.filter(F.col("together") > TOGETHER)))
    settled = settled.join(whole.filter("times = 1").select("anchor", "context"), ["anchor", "context"])
    settled = kept(settled.filter("size(spans) > 0"), "settled")
    once = shared.filter("mixed").join(whole.filter("times > 1").select("anchor", "context"), ["anchor", "context"], "left_semi").unionByName(shared.filter("NOT mixed"))
    full = once.select("rid", F.array(F.struct(F.col("start").alias("a"), (F.col("start") + F.col("n") + LENGTH - 1).alias("b"))).alias("x"))
    part = shared.filter("mixed").join(settled, ["anchor", "context"]).select("rid", F.expr(f"transform(spans, s -> named_struct('a', start + s.a, 'b', start + s.b + {LENGTH - 1}))").alias("x"))
    spans = full.unionByName(part).groupBy("rid").agg(F.flatten(F.collect_list("x")).alias("x"))
    return _removed(d, spans)


def op8_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return without_repeats(documents(spark, sf_dir)).drop("kept")
