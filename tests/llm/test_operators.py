"""Each operator against a brute-force version, and its defined results for nulls, empty and long texts, ties, repeated rows,
empty tables and further columns with clashing names."""

import collections
import hashlib
import math
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import dedup, jaccard, langid, packing, repeats, secrets, spotsigs, store, toxicity
from tessera.llm.common import documents, kept, running_start
from tessera.llm.tokens import default_path, encoder

ODD = [(1, None), (2, ""), (3, "  \n"), (4, "a"), (4, "a"), (5, "a"), (None, "null id"), (7, "É 😀 x" * 30), (8, "word " * 4000), (9, "word " * 4000), (-3, "!?")]
#: Columns that operators use inside, to clash with.
CLASHING = ("key", "n", "block", "row", "start", "rid", "token", "component", "length", "spans", "lang", "source")


@pytest.fixture(scope="module")
def odd(spark):
    d = spark.createDataFrame(ODD, "doc_id long, text string")
    return d.select("doc_id", "text", *[F.lit(k).alias(c) for k, c in enumerate(CLASHING)])


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


def prose(rng, n, words=400):
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 8))) for _ in range(words)]
    return " ".join(rng.choice(vocabulary) for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(5)
    base = [prose(rng, rng.randrange(1, 160)) for _ in range(40)]
    shared = prose(rng, 60)
    texts = list(base)
    for t in base[:15]:
        words = t.split()
        for _ in range(4):
            w = list(words)
            for _ in range(rng.randrange(0, 4)):
                w[rng.randrange(len(w))] = "changed"
            texts.append(" ".join(w))
    texts += [base[3]] * 6 + [f"{prose(rng, 20)} {shared} {prose(rng, 20)}" for _ in range(12)] + ["", "x", "One two three", None]
    rows = [(7 * k + 1, t) for k, t in enumerate(texts)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(5), dict(rows)


def test_running_start(spark):
    d = spark.createDataFrame([(5000, 3), (1, 2), (None, 4), (1, 1), (90, 5)], "doc_id long, n long")
    got = sorted(((r["doc_id"] or -1, r["n"], r["at"]) for r in running_start(d, "n", "at", "n").collect()))
    assert got == [(-1, 4, 0), (1, 1, 4), (1, 2, 5), (90, 5, 7), (5000, 3, 12)]


# exact dedup


def test_exact_dedup(corpus, odd, empty):
    d, texts = corpus
    by = collections.defaultdict(list)
    for k, t in texts.items():
        by[t or ""].append(k)
    for r in dedup.exact_dedup(d, capacity=4).collect():
        group = by[texts[r["doc_id"]] or ""]
        assert (r["keep_id"], r["group_size"], r["kept"]) == (max(group), len(group), r["doc_id"] == max(group))
        assert r["text_sha256"] == hashlib.sha256((texts[r["doc_id"]] or "").encode()).hexdigest()
    got = [(r["doc_id"], r["keep_id"], r["group_size"]) for r in dedup.exact_dedup(odd).collect()]
    assert len(got) == len(ODD) and got.count((4, 5, 3)) == 2 and (1, 2, 2) in got and (8, 9, 2) in got
    assert dedup.exact_dedup(empty).collect() == []


@pytest.mark.parametrize("hot", [20_000, 1])
def test_index_splits_and_chains(spark, monkeypatch, hot):
    """A tiny directory: slots that are over capacity are split further, one text with most rows gets overflow pages, and
    texts with a key in common are told apart by their bytes."""
    monkeypatch.setattr(dedup, "SLOT_BITS", 3)
    monkeypatch.setattr(dedup, "MOST_HOT", hot)
    monkeypatch.setattr(dedup.F, "xxhash64", lambda c: (F.length(c) % 7).cast("long") * (1 << 60))
    rng = random.Random(12)
    texts = ["".join(rng.choice("ab") for _ in range(rng.randrange(1, 9))) for _ in range(300)] + ["hot" * 5] * 400 + [None, ""]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    by = collections.defaultdict(list)
    for k, t in rows:
        by[t or ""].append(k)
    got = dedup.exact_dedup(d, capacity=5).collect()
    assert len(got) == len(rows)
    for r in got:
        group = by[texts[r["doc_id"]] or ""]
        assert (r["keep_id"], r["group_size"], r["kept"]) == (max(group), len(group), r["doc_id"] == max(group))
    entries = dedup.index(d, 5).collect()
    assert sorted(r["text"] for r in entries) == sorted(by) and max(r["depth"] for r in entries) > 3
    chains = collections.defaultdict(list)
    for r in entries:
        chains[r["bucket"], r["key"]].append(r["chain"])
    assert all(sorted(x) == list(range(len(x))) for x in chains.values()) and max(map(len, chains.values())) > 20


def test_directory_doubling():
    counts = {k: 10 for k in range(0, 16)} | {16: 500}
    buckets = dedup.split_buckets(counts, 40, bits=5)
    assert (5, 16) in buckets  # one slot too full: as deep as it goes
    inside = {s: [(d, p) for d, p in buckets if s >> (5 - d) == p] for s in counts}
    assert all(len(x) == 1 for x in inside.values())
    assert dedup.split_buckets({0: 3}, 40, bits=5) == [(0, 0)]


# n-gram Jaccard


def brute_components(texts, k, num, den):
    sets = {}
    for i, t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[a:a + k]) for a in range(len(w) - k + 1)} or ({tuple(w)} if w else set())
    top = {i: i for i in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                same = len(sets[a] & sets[b])
                if den * same >= num * (len(sets[a]) + len(sets[b]) - same):
                    x, y = find(a), find(b)
                    top[max(x, y)] = min(x, y)
    return {(i, len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize(("k", "num", "den"), [(4, 85, 100), (5, 80, 100), (2, 60, 100)])
def test_jaccard_components(corpus, k, num, den):
    d, texts = corpus
    got = {tuple(r) for r in jaccard.jaccard_components(d, k, num, den).collect()}
    assert got == brute_components(list(texts.items()), k, num, den)


def test_jaccard_odd_rows(odd, empty):
    got = collections.Counter(tuple(r) for r in jaccard.jaccard_components(odd, 4, 85, 100).collect())
    assert got[(4, 1, 4)] == 2 and got[(5, 1, 4)] == 1 and got[(1, 0, 1)] == 1 and got[(9, 1, 8)] == 1 and got[(None, 1, None)] == 1 and sum(got.values()) == len(ODD)
    assert jaccard.jaccard_components(empty).collect() == []


def test_jaccard_of_repeated_and_null_ids(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(30)) for x in "abc")
    rows = [(1, a), (1, b), (1, c), (2, a + " more"), (3, b + " more"), (None, c + " more"), (None, c + " tail"), (None, "far away from all the others")]
    d = spark.createDataFrame(rows * 2, "doc_id long, text string")
    got = collections.Counter(tuple(r) for r in jaccard.jaccard_components(d, 4, 85, 100).collect())
    assert got == {(1, 27, 1): 6, (2, 28, 1): 2, (3, 28, 1): 2, (None, 28, 1): 4, (None, 3, None): 2}
    null = spark.createDataFrame([(None, c), (None, c + " more"), (None, "far away from all the others")], "doc_id long, text string")
    found = jaccard.jaccard_components(null.withColumn("t", F.col("text")), 4, 85, 100, carry=("t",)).collect()
    assert len({r["component"] for r in found}) == 2 and len({r["component"] for r in found if r["t"].startswith(c)}) == 1


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 200), (200, 150)], "a long, b long")
    got = dict(map(tuple, jaccard.components(links).collect()))
    assert all(got[k] == 0 for k in range(61)) and {got[100], got[150], got[200]} == {100}


# repeats


def brute_repeats(rows):
    count = collections.Counter(b[i:i + 200] for _, t in rows for b in [(t or "").encode()] for i in range(len(b) - 199))
    out = []
    for k, t in rows:
        b = (t or "").encode()
        gone = [False] * len(b)
        for i in range(len(b) - 199):
            if count[b[i:i + 200]] > 1:
                gone[i:i + 200] = [True] * 200
        runs = sum(g and not p for g, p in zip(gone, [False, *gone], strict=False))
        out.append((k, len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=repr)


def test_repeats(corpus, odd, empty):
    d, texts = corpus
    columns = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert sorted(map(tuple, repeats.without_repeats(d).select(*columns).collect()), key=repr) == brute_repeats(texts.items())
    assert sorted(map(tuple, repeats.without_repeats(odd).select(*columns).collect()), key=repr) == brute_repeats(ODD)
    assert repeats.without_repeats(empty).collect() == []


def test_repeats_of_crowded_anchors(corpus, monkeypatch):
    monkeypatch.setattr(repeats, "TOGETHER", 1)
    d, texts = corpus
    got = repeats.without_repeats(d).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted(map(tuple, got), key=repr) == brute_repeats(texts.items())


def test_merged_transforms():
    rng = random.Random(3)
    for _ in range(15):
        base = bytes(rng.choice(b"abc") for _ in range(700))
        contexts = []
        for _ in range(rng.randrange(2, 9)):
            a = rng.randrange(300)
            x = bytearray(base[a:a + 200 + rng.randrange(160)])
            if rng.random() < 0.6:
                x[rng.randrange(len(x))] = 100
            contexts.append(bytes(x))
        sizes = [len(x) - 199 for x in contexts]
        count = collections.Counter(x[i:i + 200] for x, n in zip(contexts, sizes, strict=True) for i in range(n))
        assert [f.tolist() for f in repeats.repeated_starts(contexts, sizes)] == [[count[x[i:i + 200]] > 1 for i in range(n)] for x, n in zip(contexts, sizes, strict=True)]


def test_transform_is_the_sorted_order():
    strings = [np.array([2, 1, 2, 1]), np.array([1, 2]), np.array([2, 1])]
    t = repeats.Transform(strings, [np.arange(4), np.arange(10, 12), np.arange(20, 22)])
    suffixes = {p: tuple(s[k:]) for s, a in zip(strings, (0, 10, 20), strict=True) for k, p in enumerate(range(a, a + len(s)))}
    order = [p for p in t.places.tolist() if p >= 0]
    assert [suffixes[p] for p in order] == sorted(suffixes.values())


# fingerprints


def test_fingerprints(spark, corpus, odd):
    d, texts = corpus
    got = {r["doc_id"]: r for r in spotsigs.with_next(spotsigs.fingerprints(d), "signatures").collect()}
    ids = sorted(texts)
    assert all(got[i]["next_text"] == (texts[ids[(k + 1) % len(ids)]] or "") for k, i in enumerate(ids))
    assert all(got[a]["signatures"] == got[b]["signatures"] for a in ids for b in ids if (texts[a] or "") == (texts[b] or ""))
    assert len(spotsigs.with_next(spotsigs.fingerprints(odd)).collect()) == len(ODD)
    x = spark.createDataFrame([(1, "The cat sat on the mat by a door."), (2, "the CAT sat, on the mat by a door")], "doc_id long, text string")
    a, b = (set(r["signatures"]) for r in spotsigs.fingerprints(x).orderBy("doc_id").collect())
    assert a == b and len(a) == 5


def test_near_links(spark):
    rng = random.Random(8)
    texts = []
    for _ in range(12):
        w = prose(rng, 80).split()
        for k in range(0, 80, 4):
            w[k] = "the"
        for _ in range(4):
            v = list(w)
            for _ in range(rng.randrange(3)):
                v[rng.randrange(80)] = "other"
            texts.append(" ".join(v))
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    members, links = spotsigs.near_links(d, 0.8)
    sets = {r["doc_id"]: set(r["signatures"]) for r in spotsigs.fingerprints(d).collect()}
    classes = sorted(set(dict(map(tuple, members.collect())).values()))
    want = {(a, b) for a in classes for b in classes if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    assert {(r["a"], r["b"]) for r in links.collect()} == want and want


def test_native_plans_have_no_python(corpus):
    for d in (dedup.exact_dedup(corpus[0]), spotsigs.fingerprints(corpus[0]), secrets.scan(corpus[0])):
        plan = d._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Arrow|Pandas", plan)


# store and packing


def test_store(spark, corpus, odd, empty, tmp_path):
    enc = encoder(default_path())
    for name, d, rows in (("a", corpus[0], list(corpus[1].items())), ("b", odd, ODD), ("c", empty, [])):
        path = str(tmp_path / name)
        store.write_store(d, path, default_path())
        at, want = 0, []
        for k, t in sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0)):
            ids = np.append(enc.whole(t or ""), 2).astype("<u4")
            want.append((k, at, len(ids), zlib.crc32(ids.tobytes())))
            at += len(ids)
        got = store.digests(spark, path).collect()
        assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
        whole = {(r["doc_id"], r["start"]): np.frombuffer(r["ids"], "<u4") for r in store.read_documents(spark, path).collect()}
        assert all(zlib.crc32(whole[k, s].astype("<u4").tobytes()) == c for k, s, _, c in want)
        keys = [r["key"] for r in store.read_chunks(spark, path).collect()]
        assert len(keys) == len(set(map(bytes, keys)))


def test_store_notices_changes(spark, corpus, tmp_path):
    path = str(tmp_path / "s")
    store.write_store(corpus[0], path, default_path())
    recipes = kept(spark.read.parquet(f"{path}/recipes").withColumn("n_tokens", F.col("n_tokens") + (F.col("doc_id") == 8).cast("long")), "changed")
    recipes.write.mode("overwrite").parquet(f"{path}/recipes")
    with pytest.raises(ValueError, match="manifest"):
        store.digests(spark, path)


def test_chunks_of_long_runs_and_shared_passages():
    rng = np.random.default_rng(1)
    same = np.full(20_000, 7, np.uint32)
    cuts = store.cut_points(same, np.array([len(same)]))
    assert np.diff(np.concatenate([[0], cuts])).max() <= store.LONGEST and cuts[-1] == len(same)
    passage = rng.integers(0, 50_000, 8_000).astype(np.uint32)
    chunks = []
    for head in (13, 700):
        ids = np.concatenate([rng.integers(0, 50_000, head).astype(np.uint32), passage])
        ends = store.cut_points(ids, np.array([len(ids)]))
        chunks.append({store.chunk_key(ids[a:b]) for a, b in zip([0, *ends[:-1]], ends, strict=True)})
    assert len(chunks[0] & chunks[1]) > 5


def test_joined_checksums():
    rng = np.random.default_rng(2)
    runs = [[rng.integers(0, 1 << 32, n).astype("<u4") for n in sizes] for sizes in ((3,), (1, 5000, 2), (7, 7))]
    got = store.joined_crcs([[zlib.crc32(x.tobytes()) for x in r] for r in runs], [[len(x) for x in r] for r in runs])
    assert got.tolist() == [zlib.crc32(b"".join(x.tobytes() for x in r)) for r in runs]


def test_packing(spark, corpus, odd, empty):
    enc = encoder(default_path())
    for d, rows, limit in ((corpus[0], list(corpus[1].items()), 64), (odd, ODD, 1024)):
        got = packing.pack(kept(packing.encode_pieces(d, default_path(), limit), "pieces"), limit).collect()
        packing.check_packing(got, limit)
        want = collections.Counter()
        for k, t in rows:
            ids, a, piece = np.append(enc.whole(t or ""), 2).astype("<u4"), 0, 0
            while a < len(ids):
                b = a + (limit if a else (len(ids) - 1) % limit + 1)
                want[k, piece, a, b - a, zlib.crc32(ids[a:b].tobytes())] += 1
                a, piece = b, piece + 1
        assert collections.Counter(tuple(r)[:5] for r in got) == want
        total = sum(r["length"] for r in got)
        assert len({r["sequence_id"] for r in got}) <= 1.05 * -(-total // limit) + 1
    assert packing.pack(packing.encode_pieces(empty, default_path())).collect() == []


def test_swaps_empty_bins():
    bins = collections.Counter({(60,): 1, (50,): 1, (40, 35): 1, (55,): 1})
    out = packing.swap_search(bins, 100)
    fill = lambda b: sum(n * sum(p) ** 2 for p, n in b.items())
    assert sum(out.values()) == 3 and fill(out) > fill(bins)
    assert sorted(x for p, n in out.items() for _ in range(n) for x in p) == [35, 40, 50, 55, 60]
    counts = {k: 1000 // k for k in range(1, 100)}
    assert sum(packing.swap_search(packing.best_fit(counts, 100), 100).values()) <= 1 + -(-sum(k * n for k, n in counts.items()) // 100)


# secrets


def brute_spans(t):
    either = lambda w: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w)
    names = "|".join(map(either, ("password", "passwd", "secret", "token"))) + "|[aA][pP][iI]_?[kK][eE][yY]"
    kinds = (("assign", rf"""({names})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 12), ("access", "AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 18), ("hex", "[0-9a-f]+", lambda m: len(m[0]) >= 16))
    found = [(m.start(), k, f"{name}:{m.start()}:{m.end()}") for k, (name, p, keep) in enumerate(kinds) for m in re.finditer(p, t) if keep(m)]
    return ",".join(x for *_, x in sorted(found))


def test_secret_patterns(spark, odd, empty):
    rng = random.Random(4)
    bits = ["password", "TOKEN", "api_key", "ApiKey", "secret", "=", ":", " ", "  ", "'", '"', "abcDEF012345", "short", "AKIA", "AKIAABCDEFGHIJKLMN0", "0123456789abcdef", "deadbeef", "é", "😀", "\n", ".", "-", "ſecret", "K"]
    rows = [(k, "".join(rng.choice(bits) for _ in range(rng.randrange(30)))) for k in range(250)]
    got = secrets.scan(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", secrets.written("base").alias("b")).collect()
    want = {k: brute_spans(t) for k, t in rows}
    assert {r["doc_id"]: r["b"] for r in got} == want and sum(map(bool, want.values())) > 50
    assert len(secrets.scan(odd).collect()) == len(ODD) and secrets.scan(empty).collect() == []


def test_battery(spark):
    rng = random.Random(6)
    letters = secrets.ALPHABETS["base64"][0]
    random_ones = ["".join(rng.choice(letters) for _ in range(40)) for _ in range(60)]
    plain = ["Donaudampfschifffahrtsgesellschaft", "internationalizationframework", "some/path/of/a/file/that/is/long", "x" * 40, "AbstractSingletonProxyFactoryBean", "1234567890" * 3, "ab" * 20]
    rows = [(k, f"see {t} there") for k, t in enumerate(random_ones + plain)]
    got = {r["doc_id"]: r for r in secrets.scan(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", secrets.written("spans").alias("s"), secrets.masked().alias("m")).collect()}
    assert sum("random:4:44" in got[k]["s"] for k in range(60)) >= 55
    assert not [t for k, t in enumerate(plain, 60) if "random" in got[k]["s"]]
    assert all(got[k]["m"] == "see [SECRET] there" for k in range(60) if got[k]["s"])


def test_secrets_beside_signs(spark):
    rng = random.Random(8)
    tokens = ["".join(rng.choice(secrets.ALPHABETS["base64"][0][:62]) for _ in range(40)) for _ in range(20)]
    before = ("AWS_SECRET_ACCESS_KEY=", "client_id=", "https://h.example/x?sig=", "path_a/b/", "A=1&long_name_of_a_thing==")
    rows = [(20 * i + k, f"see {b}{t} there") for i, b in enumerate(before) for k, t in enumerate(tokens)]
    got = {r["doc_id"]: r["m"] for r in secrets.scan(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", secrets.masked().alias("m")).collect()}
    for i in range(len(before)):
        assert sum(tokens[k] not in got[20 * i + k] for k in range(20)) >= 18
    padded = tokens[0][:38] + "=="
    at = secrets.scan(spark.createDataFrame([(1, f"k={padded}")], "doc_id long, text string")).select(secrets.written("spans").alias("s")).collect()
    assert at[0]["s"] == "random:2:42"


def test_battery_alphabets(spark):
    rng = random.Random(9)
    small, digits = "abcdefghijklmnopqrstuvwxyz", "0123456789"
    cases = [(small + digits, 40), (small + digits, 64), (small.upper() + digits, 40), (small.upper() + digits, 64), (small + "234567", 52), (small.upper() + "234567", 52), (small + small.upper() + digits, 32)]
    rows = [(50 * i + k, "".join(rng.choice(letters) for _ in range(n))) for i, (letters, n) in enumerate(cases) for k in range(50)]
    plain = ["INTERNATIONALIZATIONFRAMEWORK", "my-blog-post-2024-about-a-title-of-words", "internationalization2frameworks", "MAXIMUM_NUMBER_OF_CONNECTIONS_ALLOWED", "thequickbrownfoxjumpsoverthelazydog"]
    rows += [(1000 + k, t) for k, t in enumerate(plain)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["s"] for r in secrets.scan(d).select("doc_id", secrets.written("spans").alias("s")).collect()}
    for i in range(len(cases)):
        assert sum("random" in got[50 * i + k] or "hex" in got[50 * i + k] for k in range(50)) >= 42
    assert not any(got[1000 + k] for k in range(len(plain)))


def slow_battery(hit):
    """z of each test and p, by counting."""
    b = hit.rstrip("=")
    e = next((e for e, (_, test) in secrets.ALPHABETS.items() if re.search(test, b)), None)
    if e is None or len(b) < 2:
        return (0, 0, 0), 1.0
    letters, n = secrets.ALPHABETS[e][0], len(b)
    k = len(letters)
    chi = sum((b.count(c) - n / k) ** 2 / (n / k) for c in letters)
    equal = n * ((chi + n) / k - 1) / 2
    usual = secrets.EQUAL_HEX if e.startswith("hex") else secrets.EQUAL
    z1 = 2 * (math.sqrt(usual * n * (n - 1) / 2) - math.sqrt(equal + 1)) / math.sqrt(1 + secrets.SPREAD * n)
    kinds = "".join("0" if c.isdigit() else "A" if c.isupper() else "a" for c in b if c.isalnum())
    m, changes, i = len(kinds) - 1, -1, 0
    while i < len(kinds):
        j = i + 1
        first = "a" if kinds[i : i + 2] == "Aa" else kinds[i]
        while j < len(kinds) and kinds[j] == first:
            j += 1
        i, changes = j, changes + 1
    z2 = -9 if m < 1 else 2 * math.sqrt(m) * (math.asin(math.sqrt(changes / m)) - math.asin(math.sqrt(secrets.CHANGES)))
    v = [letters.index(c) - (k - 1) / 2 for c in b]
    r = sum(x * y for x, y in zip(v, v[1:])) / ((n - 1) * (k * k - 1) / 12)
    z3 = (math.sqrt(2 / math.pi) - abs(r) * math.sqrt(n - 1)) / math.sqrt(1 - 2 / math.pi)
    return (z1, z2, z3), math.erfc((z1 + z2 + z3) / math.sqrt(3) / math.sqrt(2)) / 2


def slow_spans(t):
    base = [(int(a), ("assign", "access", "hex").index(k), int(b)) for k, a, b in (x.split(":") for x in brute_spans(t).split(",") if x)]
    tried = set()
    for signs in ("+/", "_-", ""):
        inside = lambda c: c.isascii() and (c.isalnum() or c in signs)  # noqa: B023, E731
        i = 0
        while i < len(t):
            j = i
            while j < len(t) and inside(t[j]):
                j += 1
            run = t[i:j]
            change = any((x.islower() and (y.isupper() or y.isdigit())) or (x.isdigit() and y.isalpha()) or (x.isupper() and y.isdigit()) for x, y in zip(run, run[1:]))
            if len(run) >= 12 and change:
                end = j
                while end < len(t) and t[end] == "=":
                    end += 1
                if all(end <= s or e <= i for s, _, e in base):
                    tried.add((i, end))
            i = max(j, i + 1)
    ranked = sorted((slow_battery(t[a:b])[1], a, b) for a, b in tried)
    m = max((i for i, x in enumerate(ranked, 1) if x[0] <= 0.01 * i / len(ranked)), default=0)
    found = [x[1:] for x in ranked[:m]]
    outer = [(a, 3, b) for a, b in found if not any(c <= a and d >= b and d - c > b - a for c, d in found)]
    return ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in sorted(base + outer))


def test_battery_against_slow(spark):
    rng = random.Random(14)
    texts = [x.text or "" for x in documents(spark, "/root/testdata/sf0.001").select("text").limit(40).collect()]
    alphabets = [x for x, _ in secrets.ALPHABETS.values()]
    words = ["password=", "token: ", "isoDate20240102T030405", "x", "internationalization", "CamelCaseName2", "snake_case_name_1", "==", "=", "/", "-", "_", " ", " ", "\n", "é", "AKIA", "0123456789abcdef0", "aB3" * 6, "3f2a9c1e-8b4d-4c1a-9f00-1b2c3d4e5f60", "2024-01-02", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"]

    def some():
        return "".join(rng.choice(words) if rng.random() < 0.6 else "".join(rng.choice(rng.choice(alphabets[-3:] if rng.random() < 0.7 else alphabets)) for _ in range(rng.choice((5, 12, 13, 16, 20, 40)))) for _ in range(rng.randrange(1, 25)))

    rows = list(enumerate(texts + [some() for _ in range(300)]))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["s"], r["m"]) for r in secrets.scan(d).select("doc_id", secrets.written("spans").alias("s"), secrets.masked().alias("m")).collect()}
    want = {k: slow_spans(t) for k, t in rows}
    assert {k: s for k, (s, _) in got.items()} == want and sum("random" in s for s in want.values()) > 100
    for k, t in rows:
        out, upto = "", 0
        for a, b in sorted((int(x.split(":")[1]), int(x.split(":")[2])) for x in want[k].split(",") if x):
            out, upto = (out + t[upto:a] + "[SECRET]" if a >= upto else out), max(upto, b)
        assert got[k][1] == out + t[upto:]
    hits = ["".join(rng.choice(a) for _ in range(n)) for a in alphabets for n in (2, 12, 15, 33, 200)] + words
    b = spark.createDataFrame([(x,) for x in hits], "h string").select("h", F.expr(secrets.battery("h")).alias("b")).select("h", "b.*").collect()
    for r in b:
        z, p = slow_battery(r["h"])
        assert (r["z_chi"], r["z_runs"], r["z_serial"]) == pytest.approx(z, abs=1e-4) and r["p"] == pytest.approx(p, rel=0.02, abs=1e-9)


def test_short_secrets_are_tested(spark):
    rng = random.Random(15)
    letters = secrets.ALPHABETS["base62"][0]
    rows = [(100 * n + k, "the key is " + "".join(rng.choice(letters) for _ in range(n)) + " for now") for n in (12, 16, 19) for k in range(100)]
    got = secrets.scan(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", F.size("spans").alias("n")).collect()
    found = collections.Counter(r["doc_id"] // 100 for r in got if r["n"])
    assert found[12] >= 45 and found[16] >= 75 and found[19] >= 85


def test_secrets_in_long_runs(spark):
    rng = random.Random(16)
    letters = secrets.ALPHABETS["base64"][0]
    rows = [(n, "a " + "".join(rng.choices(letters, k=n)) + " b") for n in (46_341, 47_000, 1_000_000)]
    rows += [(1, " ".join("".join(rng.choices(letters[:62], k=20)) for _ in range(10_000))), (2, "Ab1" * 100_000), (3, "x" * 500_000)]
    began = time.time()
    got = {r["doc_id"]: r for r in secrets.scan(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", secrets.written("spans").alias("s"), secrets.masked().alias("m")).collect()}
    assert time.time() - began < 60
    for n in (46_341, 47_000, 1_000_000):
        assert got[n]["s"] == f"random:2:{n + 2}" and got[n]["m"] == "a [SECRET] b"
    assert got[1]["m"].count("[SECRET]") > 9_000 and got[2]["s"] == got[3]["s"] == ""


# language and toxicity


def test_suffix_automaton():
    def slow(model, x):
        count = i = 0
        while i < len(x):
            j = i + 1
            while j <= len(x) and x[i:j] in model:
                j += 1
            i, count = max(i + 1, j - 1), count + 1
        return count

    rng = random.Random(1)
    for _ in range(400):
        model, x = ("".join(rng.choice(a) for _ in range(rng.randrange(1, 15))) for a in ("abc", "abcd"))
        assert langid.SuffixAutomaton(model).phrases(x) == slow(model, x)


@pytest.mark.parametrize("dense, side", [(96, 12), (3, 1), (5, 40)])
def test_cross_parsing_of_whole_texts(monkeypatch, dense, side):
    """Phrases run over word ends; every model's count of every text is that of the automaton walked by itself."""
    monkeypatch.setattr(langid, "DENSE", dense)
    monkeypatch.setattr(langid, "SIDE_BY_SIDE", side)
    rng = random.Random(31)
    kinds = langid._kinds()
    make = lambda letters, n: " ".join("".join(rng.choice(letters) for _ in range(rng.randrange(1, 7))) for _ in range(n))
    samples = {lang: " " + langid.clean(make(letters, 200), kinds) for lang, letters in (("a", "abcde"), ("b", "bcdefé"), ("c", "ñoß日本"))}
    model = langid.Identifier(samples)
    texts = [make(rng.choice(["abcde", "bcdefé", "ñoß日本", "ABCxyz 1!é日"]), rng.randrange(0, 60)) for _ in range(120)] + ["", "1 2", "a", "Z", "İ x", "a\n\n-  b", "word " * 3000, make("abcdefé", 3000)]
    assert [langid.clean(t, kinds) for t in texts[-6:-2]] == ["a ", "z ", "i x ", "a b "]
    parsed = [langid.letters(t, kinds) for t in texts]
    counts = model.phrases([model.symbol[p] for p in parsed])
    for m, lang in enumerate(model.langs):
        slow = langid.SuffixAutomaton(samples[lang])
        assert counts[m].tolist() == [slow.phrases((" " + langid.clean(t, kinds)) if len(p) else "") for t, p in zip(texts, parsed)]
    langs, scores = model.identify(texts)
    for i, t in enumerate(texts):
        rate = counts[:, i] / max(len(parsed[i]), 1)
        assert langs[i] == (model.langs[int(np.argmin(rate))] if len(parsed[i]) else "und") and 0 <= scores[i] <= 1


def test_language(spark, odd, empty):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = langid.train(docs)
    got = langid.predict(docs, model, "lang").filter(langid.held_out(4, 2)).collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) >= 0.95 * len(got)
    found = [(r["doc_id"], r["lang_pred"], r["score"]) for r in langid.predict(odd, model).collect()]
    assert found.count((1, "und", 0.0)) == 1 and {x[1] for x in found if x[0] in (1, 2, 3, -3)} == {"und"} and all(0 <= x[2] <= 1 for x in found) and len(found) == len(ODD)
    assert langid.predict(empty, model).collect() == [] and {r["lang_pred"] for r in langid.predict(odd, langid.train(empty)).collect()} == {"und"}


def test_toxicity(spark, odd, empty):
    rng = random.Random(9)
    insults = ["blorgwit", "snazzmuck", "grimfozz"]
    rows = []
    for k in range(300):
        words = prose(rng, 60).split()
        if k % 4 == 0:
            for w in rng.sample(insults, 2):
                words[rng.randrange(60)] = w
        rows.append((" ".join(words), int(k % 4 == 0)))
    model = toxicity.fit(rows[:200])
    d = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(rows)], "doc_id long, text string")
    got = {r["doc_id"]: r["predicted"] for r in toxicity.score(d, model).collect()}
    assert all(got[k] == y for k, (_, y) in enumerate(rows))
    scorer = toxicity.Scorer(model)
    near = scorer.largest(["blo-rgwit", "blorrgwit", "b l o r g w i t"])
    far = scorer.largest(["gibberish", "orange", ""])
    assert near.min() > far.max()
    assert len(toxicity.score(odd, model).collect()) == len(ODD) and toxicity.score(empty, model).collect() == []
    assert toxicity.fit([]).probability(np.array([0.0]))[0] == 0.5 and toxicity.fit([("a", 0)] * 8).probability(np.array([9.0]))[0] < 0.2
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (2, None), (None, 1)], "doc_id long, toxic int")
    assert toxicity.labelled(odd, labels) == [("", 0)]
