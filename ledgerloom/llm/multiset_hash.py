"""Homomorphic multiset fingerprints of documents.

A text is a multiset of paragraphs (its lines). Each paragraph hashes to a wide vector, and
a document's fingerprint is the sum of its paragraphs' vectors, each lane modulo a power of
two. So the order of paragraphs does not matter, and paragraphs are inserted or deleted by
adding or subtracting their vectors (``combined``). The vector has two parts:

* identity: six 64-bit hashes of the whole paragraph, cut into twelve lanes modulo 2^32;
* likeness: each word of the paragraph (what stands between spaces) hashes to 128 bits, and every
  bit is a lane modulo 2^30; two lanes share a long, with spare bits above each, so that no
  lane carries over. A further lane counts the words, modulo 2^48.

The sums are plain aggregates over the words of all texts, which shrink to one row per text
in the task that reads it, so nothing but fingerprints is shuffled.

The likeness of two fingerprints is the cosine of their centred lanes (each lane minus half
the count), within 0 to 1, as estimated for the multisets of words; a text may have fewer than
2^30 words.

Only built-in functions are used. Defined cases: a null text counts as empty; the empty text
has one empty paragraph and no words; two fingerprints without words are alike (1) if they
are equal, else 0. For ``edited``: a row without an id has no next document; of rows that
repeat an id, the one with the least hash of its text is the next document of others, and all
are kept; a single document follows itself; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import stored, whole_text

#: 64-bit hashes of a paragraph, and of a word.
IDENTITY_HASHES = 6
HASHES = 2

_HALF = (1 << 32) - 1
_COUNT = (1 << 48) - 1
#: One bit, and all bits but the spare ones, of both lanes of a long.
_ONES = 0x0000_0001_0000_0001
_LANES = 0x3FFF_FFFF_3FFF_FFFF


def _parts(text: Column, number: int) -> Column:
    """The paragraphs and words of the text with that number."""
    def tagged(parts: Column, whole: bool) -> Column:
        return F.transform(parts, lambda x: F.struct(
            F.lit(number).alias("number"), F.lit(whole).alias("whole"), x.alias("part")))

    words = F.filter(F.split(F.translate(text, "\n", " "), " "), lambda x: x != "")
    return F.concat(tagged(F.split(text, "\n"), True), tagged(words, False))


def fingerprints(rows: DataFrame, texts: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """``keys``, the ``number`` of the text among ``texts``, and its fingerprint ``fp``: a struct of
    identity (array of longs), pieces (long) and lanes (array of longs).

    ``keys`` tell the rows apart.
    """
    parts = F.concat(*[_parts(F.coalesce(F.col(t), F.lit("")), n) for n, t in enumerate(texts)])
    words = rows.select(*keys, F.explode(parts).alias("x")).select(
        *keys, "x.number", "x.whole", *[
            F.xxhash64(F.lit(n), "x.part").alias(f"hash{n}") for n in range(IDENTITY_HASHES)])
    whole = [F.when(F.col("whole"), F.col(f"hash{n}")) for n in range(IDENTITY_HASHES)]
    word = [F.when(~F.col("whole"), F.col(f"hash{n}")) for n in range(HASHES)]
    sums = {f"identity{2 * n + high}": F.sum(
        F.shiftrightunsigned(h, 32) if high else h.bitwiseAND(F.lit(_HALF)))
        for n, h in enumerate(whole) for high in (0, 1)}
    sums |= {f"lanes{32 * n + bit}": F.sum(F.shiftright(h, bit).bitwiseAND(F.lit(_ONES)))
             for n, h in enumerate(word) for bit in range(32)}
    summed = words.groupBy(*keys, "number").agg(
        F.count_if(~F.col("whole")).alias("pieces"), *[v.alias(k) for k, v in sums.items()])

    def lanes(kind: str, mask: int) -> Column:
        return F.array(*[F.coalesce(k, F.lit(0)).bitwiseAND(F.lit(mask))
                         for k in sums if k.startswith(kind)])

    return summed.select(*keys, "number", F.struct(
        lanes("identity", _HALF).alias("identity"), F.col("pieces"),
        lanes("lanes", _LANES).alias("lanes")).alias("fp"))


def _negative(lanes: Column) -> Column:
    """Both lanes, modulo: the complement plus one."""
    return (F.bitwise_not(lanes).bitwiseAND(F.lit(_LANES)) + F.lit(_ONES)) \
        .bitwiseAND(F.lit(_LANES))


def combined(a: Column, b: Column, remove: bool = False) -> Column:
    """The fingerprint of both texts' paragraphs, or of a's without b's."""
    sign = -1 if remove else 1
    return F.struct(
        F.zip_with(a["identity"], b["identity"],
                   lambda x, y: (x + sign * y).bitwiseAND(F.lit(_HALF))).alias("identity"),
        (a["pieces"] + sign * b["pieces"]).bitwiseAND(F.lit(_COUNT)).alias("pieces"),
        F.zip_with(a["lanes"], b["lanes"],
                   lambda x, y: (x + (_negative(y) if remove else y)).bitwiseAND(F.lit(_LANES)))
        .alias("lanes"))


def as_string(fp: Column) -> Column:
    """Hexadecimal digits of all lanes."""
    def digits(x: Column, n: int) -> Column:
        return F.lpad(F.lower(F.hex(x)), n, "0")

    return F.concat(
        F.array_join(F.transform(fp["identity"], lambda x: digits(x, 8)), ""),
        digits(fp["pieces"], 12),
        F.array_join(F.transform(fp["lanes"], lambda x: digits(x, 16)), ""))


def _centred(fp: Column) -> Column:
    """Twice each lane minus the count of words."""
    lanes = F.concat(
        F.transform(fp["lanes"], lambda x: x.bitwiseAND(F.lit(_HALF))),
        F.transform(fp["lanes"], lambda x: F.shiftright(x, 32)))
    return F.transform(lanes, lambda x: (2 * x - fp["pieces"]).cast("double"))


def _product(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def likeness(a: Column, b: Column) -> Column:
    """Cosine of the centred lanes, from 0 to 1; equal fingerprints have 1."""
    x, y = _centred(a), _centred(b)
    norms = F.sqrt(_product(x, x) * _product(y, y))
    cosine = F.when(norms > 0, _product(x, y) / norms).otherwise(F.lit(0.0))
    return (F.when(a == b, F.lit(1.0)).when(a.isNull() | b.isNull(), F.lit(None))
            .otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), cosine))))


def successors(ids: DataFrame) -> DataFrame:
    """``doc_id`` and ``next_id``, the next id in ascending order; the last is followed by the first.

    Ids are dealt into ranges; a window orders those of one range, and the first ids of the
    ranges (one row each) close the gaps between them.
    """
    distinct = ids.select(F.col("doc_id").cast("long")).where("doc_id IS NOT NULL").distinct()
    ranged = stored(distinct.repartitionByRange("doc_id")
                    .withColumn("part", F.spark_partition_id()), "ranges")
    firsts = ranged.groupBy("part").agg(F.min("doc_id").alias("first"))
    starts = Window.orderBy("first")
    after = firsts.select("part", F.coalesce(
        F.lead("first").over(starts), F.min("first").over(
            starts.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
        .alias("next_first"))
    inside = Window.partitionBy("part").orderBy("doc_id")
    return (ranged.withColumn("next_id", F.lead("doc_id").over(inside)).join(after, "part")
            .select("doc_id", F.coalesce("next_id", "next_first").alias("next_id")))


def with_edited(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``n_chars``, ``edited_sha256`` (of the text with its last quarter from the
    next document's start), and the fingerprints ``fp``, ``edited_fp``, ``next_fp``."""
    every = docs.select(F.col("doc_id").cast("long").alias("id"), whole_text().alias("body"))
    # both joins take the texts by id in the same form, so that they are shuffled once
    texts = every.where("id IS NOT NULL")
    take = F.floor(F.length("body") / 4).cast("int")
    sizes = texts.groupBy("id").agg(F.max(take).alias("take"))
    asked = successors(docs).withColumnRenamed("doc_id", "id").join(sizes, "id").select(
        F.col("id").alias("asker"), F.col("next_id").alias("id"), "take")
    # what the next document gives goes back to the document that asked; of rows that
    # repeat an id, the one with the least hash gives
    given = (
        asked.join(texts, "id")
        .select(F.col("asker").alias("id"), F.col("id").alias("next_id"),
                F.expr("left(body, take)").alias("start"), F.xxhash64("body").alias("order"))
        .groupBy("id", "next_id").agg(F.min_by("start", "order").alias("start"))
    )
    def whole(rows: DataFrame) -> DataFrame:
        """Both texts of every row, told apart by ``keys``."""
        cut = F.expr("left(body, length(body) - cast(floor(length(body) / 4) as int))")
        start = F.substring(F.coalesce("start", F.lit("")), F.lit(1), take)
        return rows.select(
            F.col("id").alias("doc_id"), F.monotonically_increasing_id().alias("row"), "next_id",
            F.length("body").cast("long").alias("n_chars"), F.xxhash64("body").alias("order"),
            F.col("body").alias("text"), F.concat(cut, start).alias("edited")) \
            .withColumn("digest", F.unhex(F.sha2("edited", 256)))

    # the texts lie by id, and so do the sums over their words
    keys = ["doc_id", "row", "next_id", "n_chars", "order", "digest"]
    none = every.where("id IS NULL").select(
        "id", "body", F.lit(None).cast("long").alias("next_id"),
        F.lit(None).cast("string").alias("start"))
    summed = [fingerprints(whole(x), ["text", "edited"], keys)
              for x in (texts.join(given, "id"), none)]
    # both fingerprints of a row into one, where the sums are: nothing is shuffled for it
    paired = [x.groupBy(*keys).agg(
        F.max(F.when(F.col("number") == 0, F.col("fp"))).alias("fp"),
        F.max(F.when(F.col("number") == 1, F.col("fp"))).alias("edited_fp")) for x in summed]
    made = stored(paired[0].unionByName(paired[1]).drop("row"), "fingerprints")
    following = (made.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("next_id"))
                 .agg(F.min_by("fp", "order").alias("next_fp")))
    return made.drop("order").join(following, "next_id", "left").select(
        "doc_id", "n_chars", F.lower(F.hex("digest")).alias("edited_sha256"), "fp", "edited_fp",
        "next_fp")
