"""Best-fit packing of token sequences, improved by swaps, on counts of lengths."""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, kept, map_batches, parts, texts
from .tokens import default_path, encoder, little_endian

#: Groups of ids over which equal lengths are numbered, so that a very common length is spread over many tasks.
SPREAD = 256
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def encode_pieces(docs: DataFrame, path: str, limit: int = 1024, end_id: int = 2, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids, little-endian 32-bit, if asked for) of each document's pieces.

    A document is its ids and ``end_id``; one of more than ``limit`` ids is cut so that only its first piece may be shorter.
    Null and empty texts are one piece of one id. Repeated rows give pieces each.
    """

    def make():
        enc = encoder(path)

        def one(batch: pa.RecordBatch):
            ids_of, text = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for part in parts(text):
                ids, at = enc.encode(text[part])
                raw = memoryview(little_endian(ids))
                rows, blobs = [], []
                tail = int(end_id).to_bytes(4, "little")
                for k, d in enumerate(ids_of[part]):
                    body = raw[4 * int(at[k]):4 * int(at[k + 1])]
                    n = len(body) // 4 + 1
                    cut = (n - 1) % limit + 1
                    a, piece = 0, 0
                    while a < n:
                        b = cut if not a else a + limit
                        blob = body[4 * a:4 * b]
                        c = zlib.crc32(blob)
                        if b == n:
                            c = zlib.crc32(tail, c)
                        rows.append((d, piece, a, b - a, c))
                        if with_ids:
                            blobs.append(bytes(blob) + (tail if b == n else b""))
                        a, piece = b, piece + 1
                cols = list(zip(*rows, strict=True))
                arrays = [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[2:])]
                yield pa.RecordBatch.from_arrays([*arrays, *([pa.array(blobs, pa.binary())] if with_ids else [])], names=["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])])

        return one

    return map_batches(texts(docs), make, PIECES + (", ids binary" if with_ids else ""))


def best_fit(counts: dict[int, int], limit: int) -> Counter:
    """Best-fit-decreasing bins {lengths, longest first: how many such bins} for {length: how many}.

    Equal items and equal bins are handled together, so time and memory depend on ``limit`` and not on the items.
    """
    by_room: list[Counter] = [Counter() for _ in range(limit + 1)]
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            room = next((r for r in range(length, limit) if by_room[r]), limit)
            fits = min(room // length, left)
            bins = left // fits
            if room < limit:
                pattern, there = next(iter(by_room[room].items()))
                bins = min(bins, there)
                by_room[room][pattern] -= bins
                if not by_room[room][pattern]:
                    del by_room[room][pattern]
            else:
                pattern = ()
            by_room[room - fits * length][pattern + (length,) * fits] += bins
            left -= bins * fits
    return sum(by_room, Counter())


def _exchange(source: tuple[int, ...], target: tuple[int, ...], limit: int) -> tuple[int, tuple, tuple] | None:
    """What to give (one or two items of source) for what (none, one or two items of target) so that target gets fullest:
    moves, one-for-one, two-for-one and one-for-two."""
    room = limit - sum(target)
    least = max(1, sum(source) - sum(target) + 1)  # then the sum of squared fills grows
    singles = [(a, (a,)) for a in sorted(set(source))]
    pairs = [(source[i] + source[j], (source[i], source[j])) for i in range(len(source)) for j in range(i)]
    back = [(0, ()), *((b, (b,)) for b in sorted(set(target)))]
    back2 = [(target[i] + target[j], (target[i], target[j])) for i in range(len(target)) for j in range(i)]
    best = None
    for given, returned in ((singles, back), (pairs, back), (singles, back2)):
        for a, what in given:
            for b, gets in returned:
                if least <= a - b <= room and (best is None or a - b > best[0]):
                    best = (a - b, what, gets)
    return best


def swap_search(bins: Counter, limit: int, steps: int = 20_000, wide: int = 400) -> Counter:
    """Moves and exchanges between kinds of underfull bins, emptiest first, each of which increases the sum of squared
    fills, until none is left or ``steps`` are done. Equal bins change together. A bin that runs empty is gone.
    ``wide``: most kinds of target bins, fullest first, that one step compares."""
    bins = Counter({tuple(sorted(p, reverse=True)): n for p, n in bins.items()})
    stuck: set = set()
    for _ in range(steps):
        under = sorted((sum(p), p) for p in bins if sum(p) < limit)
        found = None
        for fill, source in under:
            if source in stuck:
                continue
            for other, target in list(reversed(under))[:wide]:
                if other < fill or (target == source and bins[source] < 2):
                    continue
                move = _exchange(source, target, limit)
                if move and (found is None or other + move[0] > found[0]):
                    found = (other + move[0], source, target, move)
                    if found[0] == limit:
                        break
            if found:
                break
            stuck.add(source)
        if not found:
            break
        _, source, target, (_, gives, gets) = found
        m = bins[source] // 2 if source == target else min(bins[source], bins[target])
        new_source, new_target = Counter(source), Counter(target)
        new_source.subtract(gives)
        new_source.update(gets)
        new_target.subtract(gets)
        new_target.update(gives)
        for p in (source, target):
            bins[p] -= m
            if not bins[p]:
                del bins[p]
        for p in (new_source, new_target):
            if pattern := tuple(sorted(p.elements(), reverse=True)):
                bins[pattern] += m
                stuck.discard(pattern)
    return bins


def plan(counts: dict[int, int], limit: int) -> list[tuple[int, int, int, int, int, int]]:
    """Where the items of each length go: (length, first, beyond, per_bin, sequence, offset): items numbered from ``first``
    to before ``beyond`` fill bins from ``sequence`` on, ``per_bin`` to a bin, from ``offset``."""
    bins = swap_search(best_fit({k: n for k, n in counts.items() if k < limit}, limit), limit)
    if counts.get(limit):
        bins[(limit,)] += counts[limit]
    used, rows, sequence = Counter(), [], 0
    for pattern, n in sorted(bins.items(), reverse=True):
        offset = 0
        for length, per in sorted(Counter(pattern).items(), reverse=True):
            rows.append((length, used[length], used[length] + n * per, per, sequence, offset))
            used[length] += n * per
            offset += length * per
        sequence += n
    return rows


def pack(pieces: DataFrame, limit: int = 1024) -> DataFrame:
    """``pieces`` (doc_id, piece, length, ...; length 1 to ``limit``) with sequence_id and offset.

    Only the counts of the ``limit`` lengths reach the driver. The plan has a few rows per length, so its broadcast is
    bounded by ``limit``. Pieces of a length are numbered within SPREAD groups of ids and offset by the groups' counts.
    """
    numbered = pieces.withColumn("__group", F.pmod(F.xxhash64("doc_id"), F.lit(SPREAD)))
    counts = numbered.groupBy("length", "__group").agg(F.count(F.lit(1)).alias("__n"))
    totals = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("__n").alias("n")).collect()}
    before = Window.partitionBy("length").orderBy("__group").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("length", "__group", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__first"))
    inside = Window.partitionBy("length", "__group").orderBy("doc_id", "piece", *[c for c in ("ids_crc32",) if c in pieces.columns])
    numbered = numbered.withColumn("__rank", F.row_number().over(inside) - 1).join(F.broadcast(firsts), ["length", "__group"])  # at most limit * SPREAD rows
    numbered = numbered.withColumn("__rank", F.col("__rank") + F.col("__first"))
    rows = pieces.sparkSession.createDataFrame(plan(totals, limit), "length long, __a long, __b long, __per long, __sequence long, __offset long")
    placed = numbered.join(F.broadcast(rows), (numbered["length"] == rows["length"]) & (F.col("__rank") >= F.col("__a")) & (F.col("__rank") < F.col("__b"))).drop(rows["length"])
    k = F.col("__rank") - F.col("__a")
    return placed.select(
        *[placed[c] for c in pieces.columns],
        (F.col("__sequence") + F.floor(k / F.col("__per"))).cast("long").alias("sequence_id"),
        (F.col("__offset") + k % F.col("__per") * F.col("length")).cast("long").alias("offset"),
    )


def op9_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack(kept(encode_pieces(documents(spark, sf_dir), default_path()), "pieces"))


def check_packing(rows: list, limit: int) -> None:
    """Raises unless the rows of every sequence lie end to end from 0 and within the limit (for tests)."""
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        at = np.cumsum([0, *(n for _, n in sorted(places))])
        if [o for o, _ in sorted(places)] != at[:-1].tolist() or at[-1] > limit:
            raise ValueError("pieces overlap, leave a gap or run over")
