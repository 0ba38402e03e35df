"""Spot signatures: chains of content words after common words. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, kept, with_block

#: Common words that anchor chains (English, German, French, Spanish).
ANCHORS = (
    "a an and are as at be been but by for from had has have he her his in is it its not of on or she so that the their they this to was were which who will with you "
    "als am auch auf aus bei das dass dem den der des die durch ein eine einem einen einer es im ist mit nach nicht sich sie sind um und von war wie wird zu zum zur "
    "au aux avec ce cette dans du elle en est et ils je la le les mais ne nous ou où par pas plus pour que qui se son sur un une vous "
    "al como con de del el ella ellos era esta este fue las lo los más muy para pero por se sin su también una uno y ya"
)
#: Content words of a chain, and words after the anchor among which they are looked for.
CHAIN, REACH = 2, 10
_MARK = "\\u0001"
#: White space of any kind, inside a character class.
_BLANK = r"\s\p{Z}\x85"


def signatures(text: str) -> Column:
    """The sorted distinct signatures of a text column, 32 bits each.

    Words are lower-case runs of letters and digits between white space (no-break spaces as well), signs dropped. After each
    anchor the next CHAIN words that are no anchors, among REACH words, are a signature with it; fewer at a text's end make a
    shorter chain. A text with no signature has one for all its words (or, without words, for its characters), so equal texts have equal sets and
    no set is empty.
    """
    anchors = "|".join(sorted(set(ANCHORS.split()), key=lambda w: (-len(w), w)))
    plain = f"regexp_replace(lower({text}), r'[^\\p{{L}}\\p{{N}}{_BLANK}]+', '')"
    marked = f"regexp_replace({plain}, r'(?<![^{_BLANK}])({anchors})(?![^{_BLANK}])', '{_MARK}$1')"
    words = f"filter(split({marked}, r'[{_BLANK}]+'), w -> w != '')"
    chain = f"slice(filter(slice(w, i + 1, {REACH}), x -> x >= '\\u0002'), 1, {CHAIN})"
    spots = f"filter(transform(filter(sequence(1, greatest(size(w), 1)), i -> size(w) > 0 AND w[i - 1] < '\\u0002'), i -> hash(w[i - 1], {chain})), x -> x IS NOT NULL)"
    whole = f"array(CASE WHEN size(w) > 0 THEN hash('words', array_join(w, ' ')) ELSE hash('text', {text}) END)"
    chosen = f"element_at(transform(array({words}), w -> element_at(transform(array({spots}), s -> CASE WHEN size(s) > 0 THEN s ELSE {whole} END), 1)), 1)"
    return F.array_sort(F.array_distinct(F.expr(chosen)))


def written(sigs: str) -> Column:
    """A fingerprint as text: each signature in eight hexadecimal digits."""
    return F.expr(f"array_join(transform({sigs}, x -> lpad(hex(x & 4294967295L), 8, '0')), '')")


def jaccard(a: str, b: str) -> Column:
    both = F.size(F.array_intersect(a, b))
    return both / (F.size(a) + F.size(b) - both)


def with_next(docs: DataFrame, *columns: str) -> DataFrame:
    """docs (doc_id, text, ``columns``) with next_<name> of the next document by ascending doc_id (ties by text, null ids
    first); the last one's next is the first.

    Blocks of ids are windows of their own. The first document of a block is handed to the block before as one more row;
    which rows those are is a thousandth of the ids, found beforehand and joined as Spark sees fit for their size.
    """
    d = with_block(docs).withColumn("__block", F.coalesce("__block", F.lit(-(1 << 62))))
    heads = d.groupBy("__block").agg(F.min("doc_id").alias("__head"))
    order = Window.orderBy("__block")
    target = F.coalesce(F.lag("__block").over(order), F.max("__block").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    # written, so that its true size decides how it is joined
    heads = kept(heads.select(F.col("__block").alias("__own"), "__head", target.alias("__target")), "heads")
    # one row hands on its block's beginning: copies of the id would do so as well, and sorting takes the first
    joined = d.join(heads, (F.col("__block") == F.col("__own")) & F.col("doc_id").eqNullSafe(F.col("__head")), "left")
    places = F.array_compact(F.array(F.struct(F.col("__block").alias("block"), F.lit(False).alias("extra")), F.when(F.col("__target").isNotNull(), F.struct(F.col("__target").alias("block"), F.lit(True).alias("extra")))))
    rows = joined.withColumn("__place", F.explode(places)).select("doc_id", "text", *columns, F.col("__place.block").alias("__block"), F.col("__place.extra").alias("__extra"))
    w = Window.partitionBy("__block").orderBy("__extra", F.col("doc_id").asc_nulls_first(), "text")
    rows = rows.select("*", *[F.lead(c).over(w).alias(f"next_{c}") for c in ("text", *columns)])
    return rows.filter(~F.col("__extra")).drop("__block", "__extra")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, text (null: empty), signatures of every whole text, repeated rows included."""
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return d.withColumn("signatures", signatures("text"))


def near_links(docs: DataFrame, threshold: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """(members, links): members has class_id (smallest doc_id with the same signatures) of each doc_id; links has pairs of
    classes a < b and their likeness, at least ``threshold``.

    Equal sets are one class. Classes are partitioned by set length, in steps by which the length may differ within the
    threshold, so only the same and the next partition can hold a partner. Each set looks its rarest signatures up (as many
    as two sets this alike must share one of); lengths and what is left of both sets after the shared signature rule out
    candidates before sets are compared.
    """
    sets = fingerprints(docs).select("doc_id", "signatures")
    classes = sets.groupBy("signatures").agg(F.min("doc_id").alias("class_id"))
    members = sets.join(classes, "signatures").select("doc_id", "class_id")
    n = F.size("signatures")
    step = F.floor(F.log(n.cast("double")) / F.log(F.lit(1 / threshold))).cast("int")
    classes = classes.withColumn("n", n).withColumn("part", step)
    each = classes.select("class_id", "n", "part", F.explode("signatures").alias("s"))
    common = each.groupBy("s").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    rank = Window.partitionBy("class_id").orderBy("df", "s")
    ranked = each.join(common, "s", "left").withColumn("df", F.coalesce("df", F.lit(1))).withColumn("k", F.row_number().over(rank))
    prefix = ranked.filter((F.col("k") <= F.col("n") - F.ceil(F.lit(threshold) * F.col("n") - 1e-9) + 1) & (F.col("df") > 1))
    left = prefix.select("s", F.col("class_id").alias("a"), F.col("n").alias("na"), F.col("k").alias("ka"), F.explode(F.array("part", F.col("part") + 1)).alias("part"))
    right = prefix.select("s", F.col("class_id").alias("b"), F.col("n").alias("nb"), F.col("k").alias("kb"), "part")
    least = F.ceil(F.lit(threshold / (1 + threshold)) * (F.col("na") + F.col("nb")) - 1e-9)
    pairs = left.join(right, ["s", "part"]).filter(
        (F.col("a") != F.col("b"))
        & (F.least("na", "nb") >= F.lit(threshold) * F.greatest("na", "nb") - 1e-9)
        & (F.least(F.col("na") - F.col("ka"), F.col("nb") - F.col("kb")) + F.least("ka", "kb") >= least)
    )
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    by = classes.select("class_id", "signatures")
    full = pairs.join(by.select(F.col("class_id").alias("a"), F.col("signatures").alias("x")), "a").join(by.select(F.col("class_id").alias("b"), F.col("signatures").alias("y")), "b")
    return members, full.select("a", "b", jaccard("x", "y").alias("likeness")).filter(F.col("likeness") >= threshold)


def op2_document_fingerprints(spark, sf_dir: str) -> DataFrame:
    d = with_next(fingerprints(documents(spark, sf_dir)), "signatures")
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.expr("substring(text, 1, int(length(text) - floor(length(text) / 2)))"), F.expr("substring(next_text, 1, int(floor(length(text) / 2)))"))
    d = d.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "signatures", "next_signatures", half.alias("half"))
    d = d.withColumn("edited_signatures", signatures("edited"))
    return d.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), written("signatures").alias("fingerprint"), written("edited_signatures").alias("edited_fingerprint"),
        jaccard("signatures", "edited_signatures").alias("near_edited"), jaccard("signatures", "next_signatures").alias("near_next"),
    )
