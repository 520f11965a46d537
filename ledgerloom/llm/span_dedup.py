"""Substring deduplication by sliding sentence spans.

Every run of ``span`` consecutive sentences is hashed (128 bits). The hashes meet in one
global aggregation that keeps, for those that occur more than once, the first place; joined
back, every other place is a repeat, and the sentences that a repeat covers are removed. A
sentence of more than ``longest`` words counts as several, of that many words each: a passage
of three times as many words then has at least a span, however few sentences it has.

A hash that very many documents share is combined before the shuffle in the aggregation, and
the join back can be split, so no group of places is collected. The places (numbers and
hashes) are stored once for both. Only built-in functions are used; the text is cut after
``.``, ``!`` or ``?`` with the spaces that follow, and after newlines, and the pieces, joined,
are the text again.

Defined cases: a null or empty text has no sentences; fewer sentences than a span are never
removed; sentences compare without case and outer white space; the order of places is by
doc_id (nulls last), then a hash of the text, then the sentence's number, so rows that repeat
both are one document and keep the same; the control character U+0001 ends a sentence and is
dropped; an empty table gives no rows; all columns of the input are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import stored, whole_text

SPAN = 3
LONGEST = 16
_MARK = "\u0001"


def sentences(text: Column, longest: int = LONGEST) -> Column:
    """The pieces of a text, each with the white space that follows it."""
    marked = F.regexp_replace(text, r"([.!?]++ ++|\n++)", f"$1{_MARK}")
    # from the start of a sentence, or from the last cut in it
    words = rf"(?:\G|(?<={_MARK}))((?: *+[^ \n{_MARK}]++ ++){{{longest}}})"
    cut = F.regexp_replace(marked, words, f"$1{_MARK}")
    return F.filter(F.split(cut, _MARK), lambda x: x != "")


def _hashes(pieces: Column) -> Column:
    """Two hashes of every sentence."""
    def hashed(x: Column) -> Column:
        plain = F.lower(F.regexp_replace(x, r"^[ \n]+|[ \n]+$", ""))
        return F.struct(F.xxhash64(plain).alias("h1"), F.xxhash64(F.lit(1), plain).alias("h2"))

    return F.transform(pieces, hashed)


def _spans(hashes: Column, span: int) -> Column:
    """Place and hashes of every run, from those of the sentences."""
    starts = F.size(hashes) - span

    def hashed(at: Column) -> Column:
        run = [F.get(hashes, at + step) for step in range(span)]
        return F.struct(at.alias("at"), *[F.xxhash64(*[x[h] for x in run]).alias(h)
                                          for h in ("h1", "h2")])

    return F.when(starts >= 0, F.transform(F.sequence(F.lit(0), starts), hashed))


def dedup(docs: DataFrame, span: int = SPAN, longest: int = LONGEST) -> DataFrame:
    """The columns of ``docs`` with ``n_sentences``, ``n_removed`` and ``kept``."""
    results = ("n_sentences", "n_removed", "kept")
    names = [x for x in docs.columns if x not in results]
    owned = docs.select(*[docs[x].alias(f"_kept_{x}") for x in names],
                        F.coalesce(docs["doc_id"].cast("long"), F.lit((1 << 63) - 1))
                        .alias("_owner"),
                        F.xxhash64(whole_text()).alias("_text_hash"),
                        sentences(whole_text(), longest).alias("_sentences"))
    places = stored(
        owned.select("_owner", "_text_hash", _hashes(F.col("_sentences")).alias("_hashes"))
        .select("_owner", "_text_hash", F.explode(_spans(F.col("_hashes"), span)).alias("x"))
        .select("_owner", "_text_hash", "x.at", "x.h1", "x.h2"), "places")
    place = F.struct("_owner", "_text_hash", "at")
    # stored, so that both sides of the join back are plain shuffles and a hash that very many
    # documents share can be split there
    firsts = stored(
        places.groupBy("h1", "h2")
        .agg(F.min(place).alias("first"), F.max(place).alias("last"))
        .where(F.col("first") < F.col("last")).select("h1", "h2", "first"), "spans")
    covered = (
        places.join(firsts, ["h1", "h2"]).where(place != F.col("first"))
        .groupBy("_owner", "_text_hash").agg(F.collect_set("at").alias("_removed"))
    )
    gone = F.array_distinct(F.flatten(F.transform(
        F.coalesce("_removed", F.array().cast("array<int>")),
        lambda at: F.sequence(at, at + span - 1))))
    return (
        owned.join(covered, ["_owner", "_text_hash"], "left")
        .withColumn("_removed", gone)
        .select(*[F.col(f"_kept_{x}").alias(x) for x in names],
                F.size("_sentences").cast("long").alias("n_sentences"),
                F.size("_removed").cast("long").alias("n_removed"),
                F.array_join(F.filter("_sentences", lambda x, i: ~F.array_contains(
                    F.col("_removed"), i)), "").alias("kept"))
    )
