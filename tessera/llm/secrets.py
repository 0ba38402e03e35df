"""Secret scan: fixed patterns and a randomness test battery. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents, texts

#: The three base patterns, and least lengths (of group 2, of the match, of the match).
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_KEPT = ASSIGN.replace("=-]+)", "=-]{12,})")
ACCESS = r"AKIA[A-Z0-9]{14,}"  # a run that is too short has no longer match inside it
HEX = r"[0-9a-f]{16,}"
KINDS = ("assign", "access", "hex", "random")
#: Least length of a candidate: the one the assign pattern has for a secret.
CANDIDATE_LENGTH = 12
_UPPER, _LOWER, _DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
#: A change of class that an ordinary word or number does not have.
_CHANGE = "(?:[a-z][A-Z0-9]|[0-9][A-Za-z]|[A-Z][0-9])"
#: Candidates: whole runs in either pair of signs, and in none, each with its padding, that have such a change. A run is thus
#: tried whole and in its parts.
RUNS = tuple(f"(?<![{s}])(?=[{s}]*{_CHANGE})[{s}]{{{CANDIDATE_LENGTH},}}=*" for s in ("A-Za-z0-9+/", "A-Za-z0-9_-", "A-Za-z0-9"))
#: Texts without this have no candidate.
_ANY = f"(?<![A-Za-z0-9+/_-])(?=[A-Za-z0-9+/_-]*{_CHANGE})[A-Za-z0-9+/_-]{{{CANDIDATE_LENGTH},}}"
#: Alphabets by encoding, in the order of their values; narrowest first, and the first that holds a run counts.
ALPHABETS = {
    "hex": (_DIGITS + "abcdef", "^[0-9a-f]+$"),
    "hex_upper": (_DIGITS + "ABCDEF", "^[0-9A-F]+$"),
    "base32": (_UPPER + "234567", "^[A-Z2-7]+$"),
    "base32_lower": (_LOWER + "234567", "^[a-z2-7]+$"),
    "base36": (_DIGITS + _LOWER, "^[0-9a-z]+$"),
    "base36_upper": (_DIGITS + _UPPER, "^[0-9A-Z]+$"),
    "base62": (_UPPER + _LOWER + _DIGITS, "^[A-Za-z0-9]+$"),
    "base64": (_UPPER + _LOWER + _DIGITS + "+/", "^[A-Za-z0-9+/]+$"),
    "base64_url": (_UPPER + _LOWER + _DIGITS + "-_", "^[A-Za-z0-9_-]+$"),
}
#: Of ordinary strings: the chance that two characters are equal (of those that pass for hexadecimal, and of others), how much
#: more than a Poisson count the number of equal pairs varies per character, and changes of class per character.
EQUAL_HEX, EQUAL, SPREAD, CHANGES = 0.12, 0.06, 0.04, 0.1
#: Mean and deviation of the absolute value of a standard normal variable.
HALF_MEAN, HALF_SPREAD = 0.797885, 0.602810
FALSE_DISCOVERIES = 0.01
#: States of a running fold are put together in blocks of so many, so that none copies what came long before.
BLOCK = 256
CHUNK = 4096

_SPANS = "array<struct<start:bigint,end:bigint,hit:string>>"


def let(value: str, name: str, then: str) -> str:
    """SQL of ``then`` with ``name`` standing for ``value``, which is worked out once."""
    return f"element_at(transform(array({value}), {name} -> {then}), 1)"


def running(items: str, kind: str, zero: str, step: str) -> str:
    """SQL of the array of states after each of ``items``, a name: ``zero`` is the state before, ``step`` the next one from
    ``s`` and ``x``, ``kind`` a state's type. Time is in proportion to the number of items but for a step a block."""
    inner = f"aggregate(part, named_struct('s', acc.s, 'out', cast(array() AS array<{kind}>)), (a, x) -> " + let(let("a.s", "s", step), "next", "named_struct('s', next, 'out', array_append(a.out, next))") + ")"
    outer = f"""aggregate(transform(sequence(0, int((size({items}) - 1) / {BLOCK})), i -> slice({items}, i * {BLOCK} + 1, {BLOCK})),
        named_struct('s', {zero}, 'outs', cast(array() AS array<array<{kind}>>)),
        (acc, part) -> {let(inner, "r", "named_struct('s', r.s, 'outs', array_append(acc.outs, r.out))")}, acc -> flatten(acc.outs))"""
    return f"CASE WHEN size({items}) = 0 THEN cast(array() AS array<{kind}>) ELSE {outer} END"


def located(text: str, pattern: str, kept: str | None = None) -> Column:
    """Leftmost non-overlapping matches of a pattern as (start, end, hit), in code points, end exclusive.

    What stands between matches comes from splitting by the same pattern; running lengths give the places. ``kept`` is a
    pattern that any match to be kept implies; texts without it are passed over.
    """
    quoted = "r'" + pattern.replace("'", "\\x27") + "'"
    hits, gaps = f"regexp_extract_all({text}, {quoted}, 0)", f"split({text}, {quoted}, -1)"
    step = "named_struct('start', s.end + length(x.gap), 'end', s.end + length(x.gap) + length(x.hit), 'hit', x.hit)"
    fold = let(let(hits, "h", f"zip_with(h, slice({gaps}, 1, size(h)), (a, b) -> named_struct('hit', a, 'gap', b))"), "items", running("items", "struct<start:bigint,end:bigint,hit:string>", "named_struct('start', 0L, 'end', 0L, 'hit', '')", step))
    none = f"cast(array() AS {_SPANS})"
    return F.when(F.col(text).rlike(kept or pattern), F.expr(fold)).otherwise(F.expr(none))


def battery(hit: str) -> str:
    """SQL of one candidate's tests: named_struct(encoding, n, chi, z_chi, z_runs, z_serial, p). Time is in proportion to n.

    Three tests over the values of the inferred encoding, each a normal score of how much better than an ordinary string of
    that length the candidate agrees with random values:

    * chi: chi-squared uniformity over the whole alphabet of k. It is k / n * (n + 2 * e) - n, where e pairs of characters
      are equal; of an ordinary string EQUAL of all pairs are, give or take a Poisson count widened by SPREAD. The score
      compares square roots.
    * runs of one class (capitals, small letters, digits; signs left out; one capital before small letters is of their run,
      as in names put together of words): in an ordinary string CHANGES of the places begin a run. The score compares arcs
      of square roots.
    * lag-one serial correlation, which random values have near 0 of either sign: score by the mean and deviation of an
      absolute normal variable; what ordinary strings have is further off.

    p is the upper tail of the scores' sum, divided by the square root of 3, and so the chance that an ordinary string of this
    length looks as random. Values that are too regular (a row of letters, a repeated pair) lose by one test what they gain by
    another. Padding at the end is no part of the values.
    """
    which = "CASE " + " ".join(f"WHEN rlike(b, '{test}') THEN '{name}'" for name, (_, test) in ALPHABETS.items()) + " ELSE 'none' END"
    alphabet = "CASE e " + " ".join(f"WHEN '{name}' THEN '{letters}'" for name, (letters, _) in ALPHABETS.items()) + " ELSE '' END"
    equal = "aggregate(split(l, ''), 0.0D, (a, c) -> a + " + let("double(length(b) - length(replace(b, c, '')))", "m", "m * (m - 1) / 2") + ")"
    z_chi = f"2 * (sqrt(CASE WHEN e LIKE 'hex%' THEN {EQUAL_HEX}D ELSE {EQUAL}D END * n * (n - 1) / 2) - sqrt(q + 1)) / sqrt(1 + {SPREAD}D * n)"
    classes = let("regexp_replace(b, '[^A-Za-z0-9]', '')", "w", let("double(length(w) - 1)", "m", f"CASE WHEN m < 1 THEN -9.0D ELSE 2 * sqrt(m) * (asin(sqrt((size(regexp_extract_all(w, '[A-Z]?[a-z]+|[A-Z]+|[0-9]+', 0)) - 1) / m)) - asin(sqrt({CHANGES}D))) END"))
    values = "transform(filter(split(b, ''), c -> c != ''), c -> instr(l, c) - 1 - (k - 1) / 2)"
    serial = let(values, "v", "aggregate(zip_with(slice(v, 1, int(n) - 1), slice(v, 2, int(n) - 1), (x, y) -> x * y), 0.0D, (a, c) -> a + c) / ((n - 1) * (k * k - 1) / 12)")
    z_serial = f"({HALF_MEAN}D - abs({serial}) * sqrt(n - 1)) / {HALF_SPREAD}D"
    # upper tail of the normal distribution; erfc by Abramowitz and Stegun 7.1.26
    tail = let("abs(z) / sqrt(2.0D)", "y", let("1 / (1 + 0.3275911D * y)", "t", "0.5D * exp(-y * y) * t * (0.254829592D + t * (-0.284496736D + t * (1.421413741D + t * (-1.453152027D + t * 1.061405429D))))"))
    p = let("(z1 + z2 + z3) / sqrt(3.0D)", "z", let(tail, "u", "CASE WHEN z >= 0 THEN u ELSE 1 - u END"))
    made = let(equal, "q", let(z_chi, "z1", let(classes, "z2", let(z_serial, "z3", f"named_struct('encoding', e, 'n', int(n), 'chi', k / n * (n + 2 * q) - n, 'z_chi', z1, 'z_runs', z2, 'z_serial', z3, 'p', {p})"))))
    none = "named_struct('encoding', 'none', 'n', 0, 'chi', 0.0D, 'z_chi', 0.0D, 'z_runs', 0.0D, 'z_serial', 0.0D, 'p', 1.0D)"
    known = let(alphabet, "l", let("double(length(l))", "k", let("double(length(b))", "n", made)))
    return let(f"rtrim('=', {hit})", "b", let(which, "e", f"CASE WHEN e = 'none' OR length(b) < 2 THEN {none} ELSE {known} END"))


def scan(docs: DataFrame, *carry: str) -> DataFrame:
    """doc_id, text, ``carry``, base and spans: arrays of (start, kind, end), kind a place in KINDS, sorted.

    base: matches of the fixed patterns. spans: those, and what the battery adds: candidates (RUNS; '=' is part of one only
    at its end) that lie clear of base spans, in no other candidate found, and are discoveries of the Benjamini-Hochberg rule
    at rate FALSE_DISCOVERIES among the text's candidates, by the battery's p, which grows with how likely an ordinary string
    of that length is. Null text counts as empty, which has no span; every row of a repeated or null doc_id is scanned on its
    own; an empty table gives none; a run of any length is tested whole, in time in proportion to it.
    """
    d = texts(docs, *carry)
    d = d.withColumns({"__a": located("text", ASSIGN, ASSIGN_KEPT), "__k": located("text", ACCESS), "__h": located("text", HEX)})
    d = d.withColumns({f"__c{i}": located("text", run, _ANY) for i, run in enumerate(RUNS)})
    group2 = "r'" + ASSIGN.replace("'", "\\x27") + "'"
    kind = lambda name, column, test="true": f"transform(filter({column}, x -> {test}), x -> named_struct('start', x.start, 'kind', {KINDS.index(name)}, 'end', x.end))"
    d = d.withColumn("base", F.expr(f"array_sort(concat({kind('assign', '__a', f'length(regexp_extract(x.hit, {group2}, 2)) >= 12')}, {kind('access', '__k')}, {kind('hex', '__h')}))"))
    # candidates and base spans in order; of each, how far a base span before reaches and where the next one starts
    d = d.withColumn("__c", F.expr(f"array_sort(concat(transform(array_distinct(concat({', '.join(f'__c{i}' for i in range(len(RUNS)))})), x -> named_struct('start', x.start, 'end', x.end, 'hit', x.hit)), transform(base, x -> named_struct('start', x.start, 'end', x.end, 'hit', ''))))"))
    d = d.withColumn("__r", F.expr("reverse(__c)"))
    d = d.withColumn("__u", F.expr(running("__c", "bigint", "0L", "CASE WHEN x.hit = '' THEN greatest(s, x.end) ELSE s END")))
    next_base = running("__r", "bigint", f"{2**62}L", "CASE WHEN x.hit = '' THEN x.start ELSE s END")
    d = d.withColumn("__d", F.expr(f"reverse({next_base})"))
    tried = "filter(transform(arrays_zip(__c, __u, __d), z -> named_struct('x', z.__c, 'clear', z.__c.hit != '' AND z.__u <= z.__c.start AND z.__d >= z.__c.end)), z -> z.clear)"
    d = d.withColumn("__t", F.expr(f"CASE WHEN size(__c) = size(base) THEN array() ELSE transform({tried}, z -> named_struct('p', ({battery('z.x.hit')}).p, 'start', z.x.start, 'end', z.x.end)) END"))
    # Benjamini-Hochberg: the largest rank whose p lies under its line
    d = d.withColumn("__t", F.expr("array_sort(__t)"))
    d = d.withColumn("__m", F.expr(f"coalesce(array_max(filter(sequence(0, size(__t)), i -> i > 0 AND __t[i - 1].p <= {FALSE_DISCOVERIES} * i / size(__t))), 0)"))
    # what lies in a longer discovery goes: in order of start, the longest first, it ends no later than one before
    d = d.withColumn("__f", F.expr("array_sort(transform(slice(__t, 1, __m), x -> named_struct('start', x.start, 'back', -x.end)))"))
    d = d.withColumn("__e", F.expr(running("__f", "struct<before:bigint,upto:bigint>", "named_struct('before', -1L, 'upto', -1L)", "named_struct('before', s.upto, 'upto', greatest(s.upto, -x.back))")))
    added = f"transform(filter(arrays_zip(__f, __e), z -> -z.__f.back > z.__e.before), z -> named_struct('start', z.__f.start, 'kind', {KINDS.index('random')}, 'end', -z.__f.back))"
    d = d.withColumn("spans", F.expr(f"CASE WHEN __m = 0 THEN base ELSE array_sort(concat(base, {added})) END"))
    return d.select("doc_id", "text", *carry, "base", "spans")


def written(spans: str) -> Column:
    names = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    return F.expr(f"concat_ws(',', transform({spans}, x -> concat({names}[x.kind], ':', x.start, ':', x.end)))")


def masked(text: str = "text", spans: str = "spans", mask: str = "[SECRET]") -> Column:
    """The text with each run of overlapping spans replaced by the mask. Parts are taken from chunks of CHUNK characters, as
    taking one from a string costs time in proportion to the whole string."""
    part = f"""CASE WHEN high <= low THEN '' ELSE array_join(transform(sequence(low div {CHUNK}, (high - 1) div {CHUNK}), c ->
        substring(chunks[int(c)], int(greatest(low - c * {CHUNK}, 0) + 1), int(least(high, (c + 1) * {CHUNK}) - greatest(low, c * {CHUNK})))), '') END"""
    step = "CASE WHEN x.start >= s.upto THEN named_struct('low', s.upto, 'high', x.start, 'upto', x.end) ELSE named_struct('low', -1L, 'high', -1L, 'upto', greatest(s.upto, x.end)) END"
    gaps = running(spans, "struct<low:bigint,high:bigint,upto:bigint>", "named_struct('low', 0L, 'high', 0L, 'upto', 0L)", step)
    before = "array_join(transform(filter(gaps, g -> g.low >= 0), g -> concat(" + let("g.low", "low", let("g.high", "high", part)) + f", '{mask}')), '')"
    after = let("element_at(gaps, -1).upto", "low", let(f"bigint(length({text}))", "high", part))
    whole = let(f"transform(sequence(0, int(length({text}) / {CHUNK})), i -> substring({text}, i * {CHUNK} + 1, {CHUNK}))", "chunks", let(gaps, "gaps", f"concat({before}, {after})"))
    return F.when(F.size(spans) == 0, F.col(text)).otherwise(F.expr(whole))


def op10_secret_scans(spark, sf_dir: str) -> DataFrame:
    found = scan(documents(spark, sf_dir))
    count = lambda name: F.expr(f"bigint(size(filter(base, x -> x.kind = {KINDS.index(name)})))").alias(f"n_{name}")
    return found.select("doc_id", *map(count, KINDS[:3]), F.sha2(written("base"), 256).alias("base_sha256"), written("spans").alias("spans"))
