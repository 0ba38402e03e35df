"""N-gram Jaccard join: a grouped prefix join over word shingles, exact, and the components of its links."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, forget, held, kept, map_batches, parts, release

#: Bits of a shingle's hash. Two sets of a thousand shingles meet by chance in one with a probability of 4e-9.
BITS = 48
#: Shingles whose hash is below come first in the global order, by frequency; the others follow by hash.
COUNTED = 1 << (BITS - 2)
#: Rounds in which each list of candidates is compared with one leader before what is left is compared in pairs.
STAR_ROUNDS = 2
#: A shingle counts as often met in a part of a batch from so many sets on; heavy are those with one in MOST_HEAVY of all.
OFTEN, MOST_HEAVY = 16, 80_000
#: Marks the places of heavy shingles, above eight bits that share them out.
HEAVY_BIT = 1 << (BITS + 8)
#: Longs of a set's sketch, their bits, and the bits of a hash that say where in the bitmap of wanted rows it stands.
SKETCH = 8
SKETCH_BITS = 64 * SKETCH
_SKETCH = [f"s{i}" for i in range(SKETCH)]
MAP_BITS = 25
_SPACES = np.zeros(256, bool)
_SPACES[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of all texts, A-Z lowered, and the number of words of each text."""
    raw = np.frombuffer(b"".join(x for t in texts for x in (t.encode("utf-8", "surrogatepass"), b"\n")), np.uint8)
    sizes = np.fromiter((len(t.encode("utf-8", "surrogatepass")) + 1 for t in texts), np.int64, len(texts)) if not all(map(str.isascii, texts)) else np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    blank = _SPACES[raw]
    edge = np.diff(blank.astype(np.int8), prepend=1)
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if len(starts) and len(ends) and ends[0] < starts[0]:
        ends = ends[1:]
    if not len(starts):
        return np.empty(0, np.uint64), np.zeros(len(texts), np.int64)
    length = ends - starts
    inside = ~blank
    place = np.flatnonzero(inside) - np.repeat(starts, length)
    x = _mixed((_LOWER[raw[inside]].astype(np.uint64) + (place.astype(np.uint64) << np.uint64(8)) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
    at = np.cumsum(length)
    words = _mixed(np.add.reduceat(x, at - length) + length.astype(np.uint64))
    upto = np.searchsorted(starts, np.cumsum(sizes))
    return words, np.diff(upto, prepend=0)


def shingle_sets(texts: list[str], k: int) -> tuple[np.ndarray, np.ndarray]:
    """The sets of all texts, each ascending, in a row, and the size of each: hashes of BITS bits of k words in a row; of all
    words, if there are fewer; none without words. At most 65,536 texts at once."""
    words, count = word_hashes(texts)
    first = np.cumsum(count) - count
    n = np.where(count >= k, count - k + 1, np.minimum(count, 1))
    total = np.cumsum(n)
    if not len(total) or not total[-1]:
        return np.empty(0, np.uint64), n
    owner = np.repeat(np.arange(len(texts)), n)
    at = np.arange(total[-1]) - np.repeat(total - n, n) + first[owner]
    width = np.minimum(count, k)[owner]
    h = np.zeros(len(at), np.uint64)
    for j in range(k):
        live = width > j
        if live.all():
            h = _mixed(h * np.uint64(0x9E3779B97F4A7C15) + words[at + j])
        else:
            h[live] = _mixed(h[live] * np.uint64(0x9E3779B97F4A7C15) + words[at[live] + j])
    both = np.sort((owner.astype(np.uint64) << np.uint64(BITS)) | (h >> np.uint64(64 - BITS)))
    new = np.ones(len(both), bool)
    new[1:] = both[1:] != both[:-1]
    both = both[new]
    return both & np.uint64((1 << BITS) - 1), np.bincount((both >> np.uint64(BITS)).astype(np.int64), minlength=len(texts))


def prefix_length(n, num: int, den: int):
    """How many shingles of a set of n hold one of any partner's, in any order common to all."""
    return n - (num * n + den - 1) // den + 1


def _key(tokens: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(tokens.tobytes(), digest_size=8).digest(), "little", signed=True)


def _sets_of(batch: pa.RecordBatch, text: int, k: int):
    texts = [t or "" for t in batch.column(text).to_pylist()]
    for part in parts(texts):
        tokens, n = shingle_sets(texts[part], k)
        yield part, tokens, n, np.cumsum(n) - n


def _posted(tokens: np.ndarray, n: np.ndarray, at: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which shingles of the sets may be in a prefix (all below COUNTED, or as many as a prefix has), how many these are of
    each set, and how many of each are below COUNTED."""
    below = np.concatenate([[0], np.cumsum(tokens < COUNTED)])
    counted = below[at + n] - below[at]
    some = np.where(n > 0, np.maximum(counted, prefix_length(n, num, den)), 0)
    return np.arange(len(tokens)) - np.repeat(at, n) < np.repeat(some, n), some, counted


def _classes(docs: DataFrame, k: int, num: int, den: int, *carry: str) -> DataFrame:
    """doc_id, key, n, counted, ``carry``: of each row the hash of its set, the set's size and how many of it are below
    COUNTED. Rows with n = -1 are none of documents: they name a shingle (key) that ``counted`` sets of one part of a batch
    have, where that are at least OFTEN and one in a hundred."""

    def make():
        held("jaccard", None, lambda: None)  # workers let go of what other operators keep

        def one(batch: pa.RecordBatch):
            for part, tokens, n, at in _sets_of(batch, 1, k):
                _, _, counted = _posted(tokens, n, at, num, den)
                keys = [_key(tokens[a:a + m]) if m else 0 for a, m in zip(at.tolist(), n.tolist(), strict=True)]
                own = [batch.column(c).slice(part.start, part.stop - part.start) for c in (0, *range(2, 2 + len(carry)))]
                names = ["doc_id", "key", "n", "counted", *carry]
                yield pa.RecordBatch.from_arrays([own[0], pa.array(keys, pa.int64()), pa.array(n, pa.int64()), pa.array(counted, pa.int64()), *own[1:]], names=names)
                token, times = np.unique(tokens, return_counts=True)
                often = times >= max(OFTEN, len(n) // 100)
                if often.any():
                    m = int(often.sum())
                    yield pa.RecordBatch.from_arrays([pa.nulls(m, own[0].type), pa.array(token[often].astype(np.int64)), pa.array(np.full(m, -1)), pa.array(times[often].astype(np.int64)), *(pa.nulls(m, x.type) for x in own[1:])], names=names)

        return one

    rows = docs.select("doc_id", "text", *carry)
    return map_batches(rows, make, ", ".join(["doc_id long, key long, n long, counted long", *(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in carry)]))


def _heavy(classes: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles, ascending, that stand for at least one in MOST_HEAVY of all sets' shingles, and their counts. The counts are
    sums over parts of the sets, so there are at most MOST_HEAVY such shingles, whatever the input."""
    total = classes.filter("n > 0").agg(F.sum("n").alias("s")).first()["s"] or 0
    found = classes.filter("n = -1").groupBy("key").agg(F.sum("counted").alias("c")).filter(F.col("c") * MOST_HEAVY > total).orderBy("key").collect()
    return np.array([r["key"] for r in found], np.int64), np.array([r["c"] for r in found], np.int64)


def _postings(docs: DataFrame, k: int, num: int, den: int, heavy: np.ndarray) -> DataFrame:
    """place, key: of each set the shingles that may be in its prefix, once for each set of a batch. place is the shingle; of
    heavy ones it has a share of the keys in its upper bits, from HEAVY_BIT on, so that no task gets all of a shingle's."""

    def make():
        seen: set = set()

        def one(batch: pa.RecordBatch):
            for _, tokens, n, at in _sets_of(batch, 1, k):
                mask, some, _ = _posted(tokens, n, at, num, den)
                keys = np.array([_key(tokens[a:a + m]) if m else 0 for a, m in zip(at.tolist(), n.tolist(), strict=True)], np.int64)
                if len(seen) > 200_000:
                    seen.clear()
                new = np.zeros(len(n), bool)
                for i in np.flatnonzero(n):
                    if keys[i] not in seen:
                        seen.add(keys[i])
                        new[i] = True
                mask &= np.repeat(new, n)
                key, place = np.repeat(keys[new], some[new]), tokens[mask].astype(np.int64)
                if len(place):
                    if len(heavy):
                        hot = heavy[np.minimum(np.searchsorted(heavy, place), len(heavy) - 1)] == place
                        place = np.where(hot, place | HEAVY_BIT | (key & 255) << BITS, place)
                    yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(key)], names=["place", "key"])

        return one

    return map_batches(docs.select("doc_id", "text"), make, "place long, key long")


def _prefixes(docs: DataFrame, classes: DataFrame, k: int, num: int, den: int, heavy: np.ndarray, counts: np.ndarray) -> DataFrame:
    """key, n, single, x: the prefix of each class as far as other classes have the same shingles: x has (token, pos, df) in
    the global order; single is how many shingles of the class, of those that are counted, no other class has.

    The global order: shingles below COUNTED that only one class has, those that more classes have by rising frequency, then
    shingles from COUNTED on. A class's prefix is what of it comes first; shingles of one class find no partner. pos never
    is above the true place in that order (single shingles from COUNTED on are not counted), so filters by it lose nothing.
    """

    def make():
        def one(batch: pa.RecordBatch):
            key, n, counted = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(3))
            lists = batch.column(3)
            sizes = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten()
            token, df = (flat.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in range(2))
            if len(heavy):
                i = np.minimum(np.searchsorted(heavy, token), len(heavy) - 1)
                df = np.where(heavy[i] == token, counts[i], df)
            owner, later = np.repeat(np.arange(len(key)), sizes), token >= COUNTED
            df = np.where(later, 0, df)
            order = np.lexsort((token, df, later, owner))
            token, df, later = token[order], df[order], later[order]  # owners stay as they are
            single = counted - np.bincount(owner[~later], minlength=len(key))
            pos = single[owner] + np.arange(len(token)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            inside = pos < prefix_length(n, num, den)[owner]
            length = np.bincount(owner[inside], minlength=len(key))
            some = length > 0
            ends = np.concatenate([[0], np.cumsum(length)[some]])
            x = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.StructArray.from_arrays([pa.array(c[inside]) for c in (token, pos, df)], names=["token", "pos", "df"]))
            yield pa.RecordBatch.from_arrays([pa.array(key[some]), pa.array(n[some]), pa.array(single[some]), x], names=["key", "n", "single", "x"])

        return one

    w = Window.partitionBy("place")
    shared = _postings(docs, k, num, den, heavy).withColumns({"df": F.count(F.lit(1)).over(w), "lo": F.min("key").over(w), "hi": F.max("key").over(w)})
    shared = shared.filter(f"place >= {HEAVY_BIT} OR lo != hi").select("place", "key", "df").dropDuplicates(["place", "key"])
    lists = shared.groupBy("key").agg(F.collect_list(F.struct(F.expr(f"place & {(1 << BITS) - 1}").alias("token"), "df")).alias("x"))
    lists = lists.join(classes.select("key", "n", "counted").dropDuplicates(["key"]), "key").select("key", "n", "counted", "x")
    return map_batches(lists, make, "key long, n long, single long, x array<struct<token:long,pos:long,df:long>>")


def _as_bytes(tokens: np.ndarray) -> bytes:
    return tokens.view(np.uint8).reshape(-1, 8)[:, :BITS // 8].tobytes()


def _from_bytes(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // (BITS // 8), 8), np.uint8)
    out[:, :BITS // 8] = np.frombuffer(raw, np.uint8).reshape(-1, BITS // 8)
    return out.view(np.uint64).ravel()


def _row() -> Column:
    return F.xxhash64("doc_id", "text").alias("__row")


def _sketches(tokens: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Of each set, for each of SKETCH_BITS buckets whether it has an odd number of shingles, as SKETCH longs. Where two
    sketches differ, the sets differ by a shingle at least."""
    bits = np.bincount(np.repeat(np.arange(len(n)), n) * SKETCH_BITS + (tokens & np.uint64(SKETCH_BITS - 1)).astype(np.int64), minlength=len(n) * SKETCH_BITS) & 1
    return np.packbits(bits.astype(bool).reshape(len(n), SKETCH_BITS), axis=1).view(np.int64)


def _bitmap(rows: DataFrame) -> np.ndarray:
    """Which of the 2 ** MAP_BITS shares of hashes have a row. Its size is fixed; what it fails to rule out is joined."""
    bit = F.shiftrightunsigned("__row", 64 - MAP_BITS)
    words = rows.groupBy(F.shiftright(bit, 6).alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, int(shiftrightunsigned(__row, {64 - MAP_BITS}) & 63))")).alias("bits")).toArrow()
    out = np.zeros(1 << (MAP_BITS - 6), np.uint64)
    out[words["word"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    return out


def _sets(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """key, n, tokens, sketch columns: the sets of the wanted (row, key), the shingles ascending. Texts are read where they
    lie: a bitmap of the wanted rows' hashes rules most others out, and a join by key the rest. A row is found by a hash, so
    what it finds counts only if its key is a wanted one."""
    here = docs.sparkSession.sparkContext.broadcast(_bitmap(wanted))

    def make():
        table = here.value

        def one(batch: pa.RecordBatch):
            at = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) >> np.uint64(64 - MAP_BITS)
            batch = batch.filter(pa.array((table[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)))
            for _, tokens, n, at in _sets_of(batch, 1, k):
                tokens, n, at = tokens, n[n > 0], at[n > 0]
                own = [tokens[a:a + m] for a, m in zip(at.tolist(), n.tolist(), strict=True)]
                sketch = _sketches(tokens, n)
                yield pa.RecordBatch.from_arrays([pa.array([_key(x) for x in own], pa.int64()), pa.array(n, pa.int64()), pa.array([_as_bytes(x) for x in own], pa.binary()), *map(pa.array, sketch.T.copy())], names=["key", "n", "tokens", *_SKETCH])

        return one

    found = map_batches(docs.select(_row(), "text"), make, "key long, n long, tokens binary, " + ", ".join(f"{c} long" for c in _SKETCH))
    return found.join(wanted.select("key"), "key", "left_semi").dropDuplicates(["key"])


def _alike(one: str, other: str, num: int, den: int) -> Column:
    """Whether sets may link, by their sizes and by a bound on what one has and the other lacks. one, other: SQL of a sketch
    column's bits that are set and of those that may be set, by suffix; sketches of groups have the bits that all members'
    have and that any member's has."""
    apart = " + ".join(f"bit_count(({c}_all_{one} & ~{c}_any_{other}) | ({c}_all_{other} & ~{c}_any_{one}))" for c in _SKETCH)
    return F.expr(f"{num + den} * ({apart}) <= {den - num} * (n_{one} + n_{other})")


def _narrowed(prefixes: DataFrame, sets: DataFrame, num: int, den: int, heavy: np.ndarray) -> DataFrame:
    """prefixes (key, n, single, grp, x, end) of the classes that may still link when all their shingles are counted, those
    from COUNTED on as well, among the classes in question: what no other of these has comes first in the global order, so
    positions rise and prefixes get shorter. grp names the classes with the same prefix and size, end is the place of its
    last shingle in that order."""

    def make():
        def one(batch: pa.RecordBatch):
            raw = batch.column(1).to_pylist()
            tokens = _from_bytes(b"".join(raw)).astype(np.int64)
            key = np.repeat(batch.column(0).to_numpy(), [len(x) // (BITS // 8) for x in raw])
            some = tokens >= COUNTED
            if len(heavy):
                some &= heavy[np.minimum(np.searchsorted(heavy, tokens), len(heavy) - 1)] != tokens
            return pa.RecordBatch.from_arrays([pa.array(tokens[some]), pa.array(key[some])], names=["token", "key"])

        return one

    each = map_batches(sets.select("key", "tokens"), make, "token long, key long")
    alone = each.groupBy("token").agg(F.count(F.lit(1)).alias("df"), F.min("key").alias("key")).filter("df = 1").groupBy("key").agg(F.count(F.lit(1)).alias("more"))
    plen = f"(n - floor(({num} * n + {den - 1}) / {den}) + 1)"
    found = prefixes.join(alone, "key", "left").withColumn("more", F.coalesce("more", F.lit(0)))
    found = found.withColumn("x", F.expr(f"filter(transform(x, e -> named_struct('token', e.token, 'pos', e.pos + more, 'df', e.df)), e -> e.pos < {plen})")).filter("size(x) > 0")
    last = F.element_at("x", -1)
    end = F.struct((last["token"] >= COUNTED).alias("later"), last["df"].alias("df"), last["token"].alias("token"))
    return found.select("key", "n", (F.col("single") + F.col("more")).alias("single"), F.xxhash64("n", "x.token", "x.pos").alias("grp"), "x", end.alias("end"))


def _own_sketch(side: str) -> list[Column]:
    return [F.col(c).alias(f"{c}_{kind}_{side}") for c in _SKETCH for kind in ("all", "any")]


def _verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose sets have den * shared >= num * union."""

    def make():
        def one(batch: pa.RecordBatch):
            good = []
            before, x = None, None
            for a, u, v in zip(*(batch.column(c).to_pylist() for c in (0, 2, 3)), strict=True):
                if a != before:
                    before, x = a, _from_bytes(u)
                y = _from_bytes(v)
                at = np.searchsorted(x, y)
                same = int(np.count_nonzero(x[np.minimum(at, len(x) - 1)] == y))
                good.append(den * same >= num * (len(x) + len(y) - same))
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

        return one

    for side in "ab":
        pairs = pairs.join(sets.select(F.col("key").alias(side), F.col("n").alias(f"n_{side}"), *_own_sketch(side)), side)
    pairs = pairs.filter(_alike("a", "b", num, den)).select("a", "b")
    both = pairs.join(sets.select(F.col("key").alias("b"), F.col("tokens").alias("v")), "b").join(sets.select(F.col("key").alias("a"), F.col("tokens").alias("u")), "a")
    return map_batches(both.select("a", "b", "u", "v"), make, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """node, component (its smallest node) of every node of ``links`` (a, b), by alternating large and small stars. Each
    round's edges are written to the shared folder, and the result; a node's edges move as partial minima."""
    edges = kept(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct(), "edges")
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u")
        new = small.filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(down.select("u", F.col("m").alias("v"))).filter("u != v").distinct()
        new = kept(new, "edges")
        forget(edges)
        edges = new
        # settled when every node has one edge and no node is both above and below
        tops = edges.select(F.col("v").alias("u")).distinct()
        more = edges.groupBy("u").count().filter("count > 1").select("u").limit(1).unionByName(edges.join(tops, "u", "left_semi").select("u").limit(1))
        if not more.take(1):
            break
    found = edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
    found = kept(found, "labels")
    forget(edges)
    return found


def _links(prefixes: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b) links between classes that together connect every class to all it links with, directly or over others.

    Classes in one list (one shingle) are first compared with a leader of their size band, at first with the one of the
    fewest shingles of its own, to which most variants of a text link. What is not connected yet is compared in pairs of
    groups. A pair of groups is taken at its first common shingle only. It passes if the sizes allow it, if the members'
    sketches do not rule it out, and if enough of the prefixes is common: up to the earlier of both prefixes' ends it is
    known which shingles are, and what one group has there and the other lacks is lost to both. Pairs that are connected
    already are no news. Pairs of members pass if their own sketches allow it.
    """
    spark = prefixes.sparkSession
    candidates = prefixes.select("key", "n", "single", "grp", F.explode("x").alias("e")).select("e.token", "e.pos", "key", "n", "single", "grp")
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(den / num))).cast("int")
    lists = kept(candidates.withColumn("band", band), "candidates")
    links, label = None, None
    for turn in range(STAR_ROUNDS):
        now = lists if label is None else _labelled(lists, label)
        rank = F.struct("single", "key", "n", "pos") if turn == 0 else F.struct(F.xxhash64("key", F.lit(turn)).alias("single"), "key", "n", "pos")
        leaders = now.groupBy("token", "band").agg(F.min(rank).alias("l")).select("token", "band", F.col("l.key").alias("lead"), F.col("l.n").alias("lead_n"), F.col("l.pos").alias("lead_pos"))
        least = F.ceil((F.col("n") + F.col("lead_n")) * num / (num + den) - 1e-9)
        pairs = now.join(leaders, ["token", "band"]).filter((F.col("key") != F.col("lead")) & (F.least(F.col("n") - F.col("pos"), F.col("lead_n") - F.col("lead_pos")) >= least))
        if label is not None:
            pairs = pairs.join(label.select(F.col("node").alias("lead"), F.col("component").alias("lead_component")), "lead", "left").filter("component != coalesce(lead_component, lead)")
        pairs = pairs.select(F.least("key", "lead").alias("a"), F.greatest("key", "lead").alias("b")).distinct()
        found = _verified(pairs, sets, num, den)
        old = links, label
        links = kept(found if links is None else found.unionByName(links), "links")
        label = components(links)
        forget(*old)
        release(spark)
    # groups: classes of one component with the same prefix and size stand in a list once
    now = _labelled(lists, label)
    mixed = now.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo != hi").select("token")
    now = kept(now.join(mixed, "token"), "mixed")
    members = kept(now.select("grp", "component", "key").distinct().join(sets.drop("tokens"), "key"), "members")
    bits = [f(c).alias(f"{c}_{kind}") for c in _SKETCH for kind, f in (("all", F.bit_and), ("any", F.bit_or))]
    groups = now.select("token", "pos", "n", "grp", "component").distinct().join(members.groupBy("grp", "component").agg(F.count(F.lit(1)).alias("size"), *bits), ["grp", "component"])
    arrays = prefixes.select("grp", F.col("x.token").alias("tokens"), "end", (F.element_at("x", -1)["pos"] + 1).alias("depth")).dropDuplicates(["grp"])
    groups = kept(groups.join(arrays, "grp"), "groups")
    forget(lists, label, now)
    names = ["token", "pos", "n", "size", "grp", "component", "tokens", "end", "depth", *(f"{c}_{kind}" for c in _SKETCH for kind in ("all", "any"))]
    left, right = (groups.select(*[F.col(c).alias(f"{c}_{s}") for c in names]) for s in "ab")
    least = F.ceil((F.col("n_a") + F.col("n_b")) * num / (num + den) - 1e-9)
    common = F.array_intersect("tokens_a", "tokens_b")
    most = F.size(common) + F.when(F.col("end_a") <= F.col("end_b"), F.col("n_a") - F.col("depth_a")).otherwise(F.col("n_b") - F.col("depth_b"))
    passed = left.join(right, (F.col("token_a") == F.col("token_b"))
        & (F.col("component_a") < F.col("component_b"))
        & (den * F.least("n_a", "n_b") >= num * F.greatest("n_a", "n_b"))
        & (F.least(F.col("n_a") - F.col("pos_a"), F.col("n_b") - F.col("pos_b")) >= least)
        & _alike("a", "b", num, den)
        & (common[0] == F.col("token_a"))
        & (most >= least)
    )
    # the smaller group of a pair is expanded first: one row for each of its members, then for each pair of members left
    turned = F.col("size_a") > F.col("size_b")
    passed = passed.select(*[F.when(turned, F.col(f"{c}_{o}")).otherwise(F.col(f"{c}_{s}")).alias(f"{c}_{s}") for s, o in ("ab", "ba") for c in ("grp", "component")])
    sides = {s: members.select(F.col("grp").alias(f"grp_{s}"), F.col("component").alias(f"component_{s}"), F.col("key").alias(f"key_{s}"), F.col("n").alias(f"n_{s}"), *_own_sketch(s)) for s in "ab"}
    on = (F.col("p.grp_b") == F.col("q.grp_b")) & (F.col("p.component_b") == F.col("q.component_b")) & _alike("a", "b", num, den)
    expanded = passed.join(sides["a"], ["grp_a", "component_a"]).alias("p").join(sides["b"].alias("q"), on)
    rest = _verified(expanded.select(F.least("key_a", "key_b").alias("a"), F.greatest("key_a", "key_b").alias("b")).distinct(), sets, num, den)
    found = kept(links.unionByName(rest), "links")
    forget(links, groups, members)
    return found


def _labelled(lists: DataFrame, label: DataFrame) -> DataFrame:
    return lists.join(label.withColumnRenamed("node", "key"), "key", "left").withColumn("component", F.coalesce("component", "key"))


def jaccard_components(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``docs``; with ``carry`` also those of its columns, and component.

    Rows link when den * shared >= num * union of their sets of k-word shingles; component_id is the smallest doc_id that
    links reach. Rows without words have no set and link with nothing; a null text has no words. Rows with the same doc_id
    are linked as any others. A null doc_id counts as larger than any other. component tells components apart that have the
    same component_id, as repeated or null doc_ids may; null without words.
    """
    found = kept(_classes(docs.select("doc_id", "text", *carry, _row()), k, num, den, *carry, "__row"), "classes")
    classes, heavy = found.filter("n >= 0"), _heavy(found)
    sized = classes.filter("n > 0")
    firsts = sized.groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.min("__row").alias("__row"))
    first = kept(_prefixes(docs, sized, k, num, den, *heavy), "prefixes")
    release(docs.sparkSession)
    sets = kept(_sets(docs, firsts.join(first, "key", "left_semi"), k), "sets")
    prefixes = kept(_narrowed(first, sets, num, den, heavy[0]), "prefixes")
    forget(first)
    release(docs.sparkSession)
    links = _links(prefixes, sets, num, den)
    forget(prefixes, sets)
    label = components(links)
    forget(links)
    release(docs.sparkSession)
    named = firsts.join(label, firsts["key"] == label["node"], "left").select("key", "doc_id", F.coalesce("component", "key").alias("component"))
    named = named.join(named.groupBy("component").agg(F.min("doc_id").alias("component_id")), "component").select("key", "component_id", "component")
    more, names = (carry, ["component"]) if carry else ((), [])
    linked = sized.join(named, "key").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), *more, *names)
    return linked.unionByName(classes.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), *more, *(F.lit(None).cast("long").alias(c) for c in names)))


def op4_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(documents(spark, sf_dir), 4, 85, 100)


#: The contract's rows: shared shingles by a self-join, components by recursion. For small tables.
ORACLE = r"""
WITH RECURSIVE words AS (
    SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), sets AS (
    SELECT doc_id, CASE WHEN len(w) >= 4 THEN list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM words
), each AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets
), links AS (
    SELECT a.doc_id AS a, b.doc_id AS b FROM each a JOIN each b ON a.x = b.x AND a.doc_id <> b.doc_id
    GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), reach AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, least(doc_id, coalesce(m, doc_id)) AS component_id
FROM sets LEFT JOIN (SELECT a, min(b) AS m FROM reach GROUP BY a) ON a = doc_id
"""
