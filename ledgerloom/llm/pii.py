"""Personal data: exact patterns, and identifiers that their contexts reveal.

Emails, addresses, card and phone numbers that match fixed patterns are the seeds. The word
before an instance is a lexical pattern of the instance's kind. Tokens with a digit or an at
sign, with the groups of digits that follow them, are candidates. Patterns and the instances
(strings) that they extract form a graph, scored in rounds: seeds count one, accepted candidates
their score; a word's confidence for a kind is the sum of its instances' scores over all tokens
that follow it anywhere in the corpus; it is a pattern if it has enough distinct instances and
confidence; a candidate's score is the chance that not all patterns before it are wrong, and
those with a high score are accepted. So the candidates that one round accepts induce the
next one's patterns at all their other places, and those find further candidates. At the end
accepted strings are added as spans of their kind wherever they stand; short ones, which may
mean something else elsewhere, only behind a pattern.

Only built-in functions are used: matches are wrapped in marks, the text is split at them,
and the pieces' lengths give the places (code points, end exclusive).

Defined cases: a null or empty text has no spans; a very long text is searched whole (the
patterns are written so that none backtracks over a run); rows with a null or repeated doc_id
are searched each; an empty table gives no rows; candidates have five code points at least; the word
before is the one of at most 40 code points that ends, with white space, the 60 before an instance,
and without one there is no pattern; no column name of the input is special but
``doc_id``, ``text`` and those of the results, which replace it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import stored, whole_text

KINDS = ("email", "ip", "card", "phone")
#: Same matches as the plain patterns; possessive, and only tried where a run starts (or the
#: last match ended), which spares the tries that cannot match.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++"
             r"(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
NEEDED = {"email": "@", "phone": "+"}
CANDIDATE = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+(?:(?<=[0-9)]) \(?[0-9]\S*+)*+"
MARK, OTHER, HIDDEN = "\u0001", "\u0002", "\u0003"
#: Pieces whose lengths are summed at once.
BLOCK = 256
LEFT = 60
LONGEST_WORD = 40
LEAST_LENGTH = 5
#: Longer strings are compared by their hash.
PLAIN_LENGTH = 120
#: Letters and digits of a string that is marked away from patterns, too.
TELLING = 7
#: Distinct instances that a pattern needs, its least confidence, an instance's least score.
SUPPORT, CONFIDENCE, SCORE = 3, 0.6, 0.6
ROUNDS = 3
BUCKETS = 1 << 16

_FOUND = "array<struct<start:int,end:int,value:string,left:string>>"


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _cut(text: Column, pattern: str, body, otherwise: Column) -> Column:
    """``body`` of the pieces between and of the matches, in turn; ``otherwise`` without any."""
    marked = F.regexp_replace(text, pattern, f"{MARK}$0{MARK}")
    return _let(marked, lambda m: F.when(
        F.contains(m, F.lit(MARK)), _let(F.split(m, MARK), body)).otherwise(otherwise))


def _matches(text: Column, pattern: str) -> Column:
    """The matches with their places and what stands before them.

    A place is the sum of the lengths before it: of whole blocks of pieces, and of the pieces
    of its own block.
    """
    def total(lengths: Column) -> Column:
        return F.aggregate(lengths, F.lit(0), lambda s, x: s + x)

    def located(parts: Column, lengths: Column, blocks: Column) -> Column:
        def match(i: Column) -> Column:
            block = F.floor(i / BLOCK).cast("int")
            start = (total(F.slice(blocks, 1, block))
                     + total(F.slice(lengths, block * BLOCK + 1, i % BLOCK)))
            return F.struct(start.alias("start"), (start + lengths[i]).alias("end"),
                            parts[i].alias("value"),
                            F.right(parts[i - 1], F.lit(LEFT)).alias("left"))

        return F.transform(F.sequence(F.lit(1), F.size(parts) - 2, F.lit(2)), match)

    def summed(lengths: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(lengths), F.lit(BLOCK))
        return F.transform(starts, lambda at: total(F.slice(lengths, at, BLOCK)))

    def body(parts: Column) -> Column:
        return _let(F.transform(parts, F.length), lambda lengths: _let(
            summed(lengths), lambda blocks: located(parts, lengths, blocks)))

    return _cut(text, pattern, body, F.array().cast(_FOUND))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    digits = F.reverse(_digits(value))

    def weighed(place: Column) -> Column:
        digit = F.substring(digits, place, F.lit(1)).cast("int")
        twice = F.when(digit > 4, 2 * digit - 9).otherwise(2 * digit)
        return F.when(place % 2 == 0, twice).otherwise(digit)

    total = F.aggregate(F.transform(F.sequence(F.lit(1), F.length(digits)), weighed),
                        F.lit(0), lambda s, x: s + x)
    return F.when(F.length(digits).between(13, 19), total % 10 == 0).otherwise(F.lit(False))


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(value, r"\."),
                        lambda x: F.coalesce(x.try_cast("int") <= 255, F.lit(False)))
    if kind == "card":
        return _luhn(value)
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    return F.lit(True)


def _clear(text: Column) -> Column:
    """A mark in the text itself is no part of any match, so another sign may stand for it."""
    own = F.contains(text, F.lit(MARK)) | F.contains(text, F.lit(HIDDEN))
    return F.when(own, F.translate(text, MARK + HIDDEN, OTHER * 2)).otherwise(text)


def base_spans(text: Column) -> Column:
    """The valid matches of all kinds: kind, start, end, value, left; by kind, then start."""
    clear = _clear(text)

    def of_kind(kind: str) -> Column:
        found = _matches(clear, PATTERNS[kind])
        if kind in NEEDED:
            found = F.when(F.contains(text, F.lit(NEEDED[kind])), found) \
                .otherwise(F.array().cast(_FOUND))
        valid = F.filter(found, lambda x: _valid(kind, x["value"]))
        return F.transform(valid, lambda x: F.struct(
            F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end"),
            x["value"].alias("value"), x["left"].alias("left")))

    return F.concat(*map(of_kind, KINDS))


def _hidden(text: Column) -> Column:
    """The text with the valid matches of each kind written over, length for length."""
    def over(kind: str, text: Column) -> Column:
        def body(parts: Column) -> Column:
            return F.array_join(F.transform(parts, lambda x, i: F.when(
                (i % 2 == 1) & _valid(kind, x), F.repeat(F.lit(HIDDEN), F.length(x)))
                .otherwise(x)), "")

        return _cut(text, PATTERNS[kind], body, text)

    for kind in KINDS:
        text = over(kind, text)
    return text


def _candidates(text: Column, spans: Column) -> Column:
    """Tokens with a digit or an at sign, and groups of digits behind them, without outer
    punctuation, beside the spans."""
    shown = F.when(F.size(spans) > 0, _hidden(_clear(text))).otherwise(_clear(text))

    def trimmed(x: Column) -> Column:
        inner = F.regexp_replace(x["value"], r"^[(\[<\"'«]++", "")
        start = x["start"] + F.length(x["value"]) - F.length(inner)
        core = F.regexp_replace(inner, r"(?<=[^.,;:!?)\]>\"'»])[.,;:!?)\]>\"'»]++$", "")
        return F.struct(start.alias("start"), (start + F.length(core)).alias("end"),
                        core.alias("value"), x["left"].alias("left"))

    return F.filter(F.transform(_matches(shown, CANDIDATE), trimmed),
                    lambda x: ~F.contains(x["value"], F.lit(HIDDEN))
                    & (F.length(x["value"]) >= LEAST_LENGTH))


def _key(value: Column) -> Column:
    return F.when(F.length(value) > PLAIN_LENGTH, F.concat(F.lit(MARK), F.sha2(value, 256))) \
        .otherwise(value)


def _word_before(left: Column) -> Column:
    """The last word of what stands before, if white space follows it; else empty."""
    word = F.lower(F.regexp_extract(left, r"(?<!\S)(\S++)\s++$", 1))
    return F.when(F.length(word) <= LONGEST_WORD, word).otherwise(F.lit(""))


def _bucket(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(BUCKETS)).cast("int")


def _followers(docs: DataFrame, words: DataFrame) -> DataFrame:
    """How many tokens follow each of the words in the corpus.

    Words whose hash falls in no wanted word's bucket leave before the count; the buckets are
    a bitmap of fixed size.
    """
    used = {r[0] for r in words.select(_bucket(F.col("word"))).distinct().collect()}
    bitmap = F.lit(bytearray(1 if i in used else 0 for i in range(BUCKETS)))
    counted = docs.select(F.explode(F.split(F.lower(whole_text()), r"\s+")).alias("word"))
    return (counted.where(F.length("word").between(1, LONGEST_WORD))
            .where(F.substring(bitmap, _bucket(F.col("word")) + 1, F.lit(1))
                   == F.lit(bytearray([1])))
            .groupBy("word").agg(F.count("*").alias("followers"))
            .join(words, "word", "left_semi"))


def _patterns(instances: DataFrame, followers: DataFrame) -> DataFrame:
    """kind, word, confidence of the words with enough instances: kind, word, key, times, score."""
    return (instances.groupBy("kind", "word")
            .agg(F.count("*").alias("support"), F.sum(F.col("times") * F.col("score")).alias("n"))
            .where(F.col("support") >= SUPPORT).join(followers, "word")
            .select("kind", "word", F.least(F.lit(1.0), F.col("n") / F.col("followers"))
                    .alias("confidence"))
            .where(F.col("confidence") >= CONFIDENCE))


def _accepted(edges: DataFrame, patterns: DataFrame) -> DataFrame:
    """key, kind and score of the candidates that the patterns before them make likely."""
    wrong = F.sum(F.log(F.greatest(F.lit(1e-12), 1 - F.col("confidence"))))
    return (edges.join(patterns, "word").groupBy("key", "kind")
            .agg((1 - F.exp(wrong)).alias("score")).where(F.col("score") >= SCORE)
            .groupBy("key").agg(F.max(F.struct("score", "kind")).alias("best"))
            .select("key", "best.kind", "best.score"))


def _discovered(docs: DataFrame, found: DataFrame) -> DataFrame:
    """Spans that the contexts reveal: row, kind, start, end."""
    def before(x: str) -> Column:
        return _word_before(F.col(f"{x}.left")).alias("word")

    seeds = (
        found.select(F.explode("_spans").alias("x"))
        .select("x.kind", _key(F.col("x.value")).alias("key"), before("x")).where("word <> ''")
        .groupBy("kind", "word", "key").agg(F.count("*").alias("times"))
        .withColumn("score", F.lit(1.0))
    )
    places = found.select("_row", F.explode("_candidates").alias("x")).select(
        "_row", "x.start", "x.end", _key(F.col("x.value")).alias("key"), before("x"),
        (F.length(F.regexp_replace("x.value", r"[^\p{L}\p{N}]", "")) >= TELLING).alias("telling"))
    seeds = stored(seeds, "seeds")
    edges = stored(places.where("word <> ''").groupBy("word", "key")
                   .agg(F.count("*").alias("times")), "edges")
    # words that any round could take as patterns
    words = stored(
        seeds.select("word", "key").unionByName(edges.select("word", "key")).distinct()
        .groupBy("word").agg(F.count("*").alias("instances"))
        .where(F.col("instances") >= SUPPORT).select("word"), "words")
    followers = stored(_followers(docs, words), "followers")
    edges = edges.join(words, "word", "left_semi")
    accepted, patterns = None, None
    for _ in range(ROUNDS):
        instances = seeds if accepted is None else seeds.unionByName(
            edges.join(accepted, "key").select(*seeds.columns))
        patterns = stored(_patterns(instances, followers), "patterns")
        accepted = stored(_accepted(edges, patterns), "accepted")
    behind = patterns.select("word", "kind", F.lit(True).alias("behind"))
    return (places.join(accepted, "key").join(behind, ["word", "kind"], "left")
            .where(F.col("telling") | F.col("behind")).select("_row", "kind", "start", "end"))


def detect(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """The columns of ``docs`` (or those to ``keep``) with ``base`` and ``spans``: arrays of
    (kind number, start, end), sorted."""
    kept = [x for x in (docs.columns if keep is None else keep) if x not in ("base", "spans")]
    text = whole_text()
    found = (
        docs.select(*[docs[x].alias(f"_kept_{x}") for x in kept], text.alias("_text"),
                    base_spans(text).alias("_spans"))
        .select(*[f"_kept_{x}" for x in kept], "_spans",
                _candidates(F.col("_text"), F.col("_spans")).alias("_candidates"))
        .withColumn("_row", F.monotonically_increasing_id())
    )
    found = stored(found, "spans")
    number = F.element_at(F.create_map(*[F.lit(x) for pair in zip(KINDS, range(4))
                                         for x in pair]), F.col("kind"))
    more = (_discovered(docs, found)
            .groupBy("_row").agg(F.collect_set(F.struct(
                number.alias("kind"), F.col("start"), F.col("end"))).alias("_more")))

    def numbered(x: Column) -> Column:
        kind = F.array_position(F.array(*map(F.lit, KINDS)), x["kind"]) - 1
        return F.struct(kind.cast("int").alias("kind"), x["start"].alias("start"),
                        x["end"].alias("end"))

    def beside(x: Column) -> Column:
        return ~F.exists("_spans", lambda s: (s["start"] < x["end"]) & (x["start"] < s["end"]))

    base = F.transform("_spans", numbered)
    none = F.array().cast("array<struct<kind:int,start:int,end:int>>")
    return (
        found.join(more, "_row", "left")
        .select(*[f"_kept_{x}" for x in kept], F.array_sort(base).alias("base"),
                F.array_sort(F.concat(base, F.coalesce(F.filter("_more", beside), none)))
                .alias("spans"))
        .select(*[F.col(f"_kept_{x}").alias(x) for x in kept], "base", "spans")
    )


def listed(spans: Column) -> Column:
    """Spans as kind:start:end, joined by commas."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(
        ":", F.element_at(kinds, x["kind"] + 1), x["start"].cast("string"),
        x["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column) -> Column:
    """The text with every span, overlapping ones together, replaced by its kind."""
    names = F.array(*(F.lit(f"<{x.upper()}>") for x in KINDS))
    ordered = F.array_sort(F.transform(spans, lambda x: F.struct(
        x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))))
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(done: Column, x: Column) -> Column:
        gap = F.substring(text, done["at"] + 1, x["start"] - done["at"])
        return F.struct(
            F.greatest(done["at"], x["end"]).alias("at"),
            F.when(x["start"] < done["at"], done["out"])
            .otherwise(F.concat(done["out"], gap, F.element_at(names, x["kind"] + 1)))
            .alias("out"))

    done = F.aggregate(ordered, zero, step)
    rest = F.concat(done["out"], F.substring(text, done["at"] + 1, F.length(text)))
    return F.when(F.size(spans) > 0, rest).otherwise(text)
