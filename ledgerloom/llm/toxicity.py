"""Toxicity scores from a weighted finite-state pattern grammar.

Small transducers read the classes of a clause's tokens. The insult transducer is an
automaton of whole words and of stems with short endings, whose weights are learned from
labels; a short list of insults has prior weights, which labels replace. Threats, speakers,
targets, negations and reported speech are word lists. Negations, reports, targets and
speakers open scopes of a few tokens; targets do so in both directions, so that the machine is
composed of forward scopes and one backward scope. The composition is a table of transitions over
the product of the forward states, the backward state and the token's class, and its outputs say
on which channel an insult or a threat counts: plain, aimed at a target, negated or
reported, a menace (a speaker's threat to a target), a hint of one (a threat with a target
alone). A clause's weights add up per channel, and a document's channels give its score by a
logistic function whose weights keep the grammar's order: aimed at least as much as plain,
negated and reported a tenth of plain, nothing below zero. So it is matched clauses that are
scored, with what the grammar says of them, not words by themselves.

Learning uses a bounded sample of the labelled rows (``SAMPLE`` rows, drawn by a hash of the
id): three parts for the patterns, one for the weights of the channels. Rows of the held-out
fifth, crc32(doc_id) mod 5 = 0, are never learned from.

Defined cases: null and empty texts get the score of a document without matches; labels that
are null or repeat with different values count as toxic only if any says so; without labels
the prior weights decide; rows without an id are scored but not learned from; repeated rows
are scored each; an empty table gives no rows; all columns of the input are kept.
"""

from __future__ import annotations

import itertools
import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm.common import ship, whole_text

SAMPLE = 30_000
#: Letters of a stem, and of the ending that a word may add to it.
SHORTEST, LONGEST, ENDING = 4, 24, 6
#: A pattern needs this share of the toxic documents, and so many at least.
SUPPORT, LEAST_DOCUMENTS = 0.004, 4
#: Lower bound that a pattern's log-odds need, so many standard errors below the estimate.
LEAST_WEIGHT, ERRORS = 1.0, 2.3
#: Twice the log of the likelihood ratio that it needs: many patterns are tried, few by chance
#: reach this.
LEAST_RATIO = 25.0
#: Weights of a listed insult that labels do not know, of a menace and of a hint of one.
LISTED, MENACING, HINTING = 4.0, 5.0, 1.0

# Fixed word lists, by language: English, German, French, Spanish.
INSULTS = {
    "idiot", "idiots", "moron", "morons", "imbecile", "scumbag", "jerk", "dumbass", "bastard",
    "bitch", "asshole", "retard", "cretin", "fuckwit", "dimwit", "nitwit",
    "idioten", "trottel", "dummkopf", "arschloch", "schwachkopf", "vollidiot", "mistkerl",
    "idiote", "imbécile", "connard", "connasse", "salaud", "abruti", "crétin", "enfoiré",
    "idiota", "imbécil", "gilipollas", "cabrón", "pendejo", "estúpido", "estúpida", "cretino",
}
SPEAKERS = {
    "i", "we", "i'll", "we'll", "i'm", "we're", "i'd", "gonna",
    "ich", "wir", "werde",
    "je", "nous", "vais", "allons",
    "yo", "nosotros", "voy", "vamos",
}
TARGETS = {
    "you", "your", "yourself", "yourselves", "you're", "you'll", "he", "she", "him", "they",
    "them", "their", "these", "those", "he's", "she's", "they're",
    "du", "dich", "dir", "dein", "deine", "ihr", "ihn", "euch", "euer", "sie",
    "tu", "te", "toi", "ton", "vous", "votre", "ils", "elles", "leur",
    "tú", "ti", "eres", "usted", "ustedes", "vosotros", "ellos", "ellas",
}
NEGATIONS = {
    "not", "never", "no", "nobody", "none", "neither", "nor", "without", "cannot", "hardly",
    "nicht", "kein", "keine", "keinen", "keiner", "nie", "niemals", "niemand", "ohne",
    "pas", "jamais", "aucun", "aucune", "personne", "sans",
    "nunca", "jamás", "ningún", "ninguno", "ninguna", "nadie", "sin",
}
REPORTS = {
    "said", "says", "say", "saying", "called", "calls", "calling", "wrote", "writes", "claimed",
    "claims", "quoted", "quotes", "reported", "reports", "told", "shouted", "accused", "alleged",
    "sagte", "sagt", "schrieb", "nannte", "behauptete", "rief", "meinte", "laut",
    "dit", "disait", "écrit", "appelé", "affirmé", "traité", "prétendu", "selon",
    "dijo", "dice", "escribió", "llamó", "afirmó", "gritó", "según",
}
THREATS = {
    "kill", "kills", "murder", "hurt", "destroy", "beat", "shoot", "burn", "stab", "strangle",
    "smash", "crush", "hang", "punch",
    "töten", "töte", "umbringen", "schlagen", "schlage", "vernichten", "erschießen", "verprügeln",
    "tuer", "tue", "frapper", "frappe", "détruire", "brûler", "massacrer", "égorger",
    "matar", "mato", "matarte", "golpear", "golpearte", "destruir", "destruirte", "quemar",
}

CLAUSE = re.compile(r"[.!?;:\n\r…]+")
TOKEN = re.compile(r"[^\W_]+(?:'[^\W_]+)*")

WORD, INSULT, THREAT, TARGET, NEGATION, REPORT, SPEAKER = range(7)
PLAIN, AIMED, NEGATED, REPORTED, MENACE, HINT = range(6)
CHANNELS = 6
#: A negated or reported insult counts this share of a plain one.
DAMPED = 0.1
#: How the channels (and the intercept before them) are made of the free weights: intercept,
#: any insult, what a target adds, menaces. All but the first stay at zero or above.
GRAMMAR = np.array([
    [1, 0, 0, 0],
    [0, 1, 0, 0], [0, 1, 1, 0], [0, DAMPED, 0, 0], [0, DAMPED, 0, 0],
    [0, 0, 0, 1], [0, 0, 0, 1],
])
PRIOR = np.array([-3.0, 0.9, 0.1, 0.9])
PRIOR_PRECISION = 0.05
#: Most that a channel adds up to.
MOST = 20.0


# --- the grammar -------------------------------------------------------------------------

@dataclass(frozen=True)
class Scope:
    """A transducer that is on for some tokens after its trigger, or to the clause's end."""

    trigger: int
    tokens: int | None

    def states(self) -> range:
        return range(2 if self.tokens is None else self.tokens + 1)

    def step(self, state: int, token: int) -> int:
        if token == self.trigger:
            return 1 if self.tokens is None else self.tokens
        return state if self.tokens is None else max(0, state - 1)


#: Read from left to right, and (the last) from right to left.
SCOPES = (Scope(NEGATION, 3), Scope(REPORT, None), Scope(TARGET, 6), Scope(SPEAKER, 6))
BEHIND = Scope(TARGET, 6)


def _channel(token: int, negated: int, reported: int, aimed: int, spoken: int) -> int | None:
    """What the composed transducer puts out for a token in its scopes' states."""
    if token == THREAT:
        return None if negated or reported or not aimed else MENACE if spoken else HINT
    if token != INSULT:
        return None
    return REPORTED if reported else NEGATED if negated else AIMED if aimed else PLAIN


def composed() -> dict[tuple, tuple]:
    """Transitions of the product: (forward states, whether a target follows, token class) to
    (forward states, channel or none)."""
    table = {}
    for states in itertools.product(*(s.states() for s in SCOPES)):
        for follows in (False, True):
            for token in range(7):
                after = tuple(s.step(x, token) for s, x in zip(SCOPES, states))
                negated, reported, aimed, spoken = states
                table[states, follows, token] = after, _channel(
                    token, negated, reported, aimed or follows, spoken)
    return table


TRANSITIONS = composed()
START = (0,) * len(SCOPES)
LISTS = ((THREAT, THREATS), (TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS),
         (SPEAKER, SPEAKERS))
CLASSES = {word: kind for kind, words in LISTS for word in words}


@dataclass
class Model:
    """Insult words and stems with weights, and the free weights of the grammar."""

    words: dict[str, float] = field(default_factory=lambda: dict.fromkeys(INSULTS, LISTED))
    stems: dict[str, float] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=PRIOR.copy)

    @property
    def patterns(self) -> dict[str, float]:
        return self.stems | self.words

    def matched(self, token: str) -> float:
        """The weight of the token as a word, or of its longest stem, or zero."""
        weight = self.words.get(token)
        if weight is not None:
            return weight
        for size in range(min(len(token), LONGEST), max(SHORTEST, len(token) - ENDING) - 1, -1):
            weight = self.stems.get(token[:size])
            if weight is not None:
                return weight
        return 0.0

    def classified(self, token: str) -> tuple[int, float]:
        kind = CLASSES.get(token, WORD)
        if kind == THREAT:
            return kind, MENACING
        if kind == WORD and token.endswith("n't"):
            return NEGATION, 0.0
        weight = self.matched(token) if kind == WORD else 0.0
        return (INSULT if weight else kind), weight

    def features(self, text: str, finder) -> np.ndarray:
        """One, and the channels' sums over all clauses."""
        out = np.zeros(1 + CHANNELS)
        lower = text.lower().replace("\u2019", "'")
        for begin, end in _matched_clauses(lower, finder):
            tokens = [self.classified(x) for x in TOKEN.findall(lower, begin, end)]
            for channel, weight in matches(tokens):
                out[1 + channel] += HINTING if channel == HINT else weight
        out = np.minimum(out, MOST)
        out[0] = 1.0
        return out

    def score(self, features: np.ndarray) -> float:
        x = float(features @ GRAMMAR @ self.weights)
        return 1 / (1 + math.exp(-x)) if x > -700 else 0.0

    def finder(self):
        """An automaton that finds the places of patterns and threats in a text."""
        import ahocorasick

        found = ahocorasick.Automaton()
        for word in (*self.patterns, *THREATS):
            found.add_word(word, len(word))
        found.make_automaton()
        return found


def matches(tokens: list[tuple[int, float]]) -> list[tuple[int, float]]:
    """Channels and weights of the insults and threats of a clause's classified tokens."""
    follows, state = [], 0
    for kind, _ in reversed(tokens):
        follows.append(state > 0)
        state = BEHIND.step(state, kind)
    out, states = [], START
    for (kind, weight), target in zip(tokens, reversed(follows)):
        states, channel = TRANSITIONS[states, target, kind]
        if channel is not None:
            out.append((channel, weight))
    return out


def _matched_clauses(lower: str, finder):
    """Bounds of the clauses in which a word starts with a pattern, in order."""
    done = 0
    for last, size in finder.iter(lower):
        start = last - size + 1
        if start < done or (start and (lower[start - 1].isalnum())):
            continue
        begin = done
        for stop in CLAUSE.finditer(lower, done, start):
            begin = stop.end()
        stop = CLAUSE.search(lower, start)
        done = stop.end() if stop else len(lower)
        yield begin, done


# --- learning ----------------------------------------------------------------------------

def _prefixes(text: str) -> set[str]:
    """The words of a text, each after an equals sign, and the beginnings of words."""
    found = set()
    for word in set(TOKEN.findall(text.lower().replace("\u2019", "'"))):
        found.add("=" + word)
        found.update(word[:n] for n in range(max(SHORTEST, len(word) - ENDING),
                                             min(len(word), LONGEST) + 1))
    return found


def _counted(batches, wanted: frozenset | None):
    """Documents per word or prefix, toxic or not, of this task's rows."""
    counts: dict[int, Counter] = {0: Counter(), 1: Counter()}
    for batch in batches:
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            found = _prefixes(text)
            counts[toxic].update(found if wanted is None else wanted.intersection(found))
    for toxic, counter in counts.items():
        items = list(counter.items())
        for at in range(0, len(items), 50_000):
            words, n = zip(*items[at:at + 50_000])
            yield pa.RecordBatch.from_arrays(
                [pa.array(words), pa.array(n, pa.int64()), pa.array([toxic] * len(n), pa.int32())],
                names=["prefix", "n", "toxic"])


def _counts(sample: DataFrame, wanted: frozenset | None, least: int) -> dict[str, int]:
    counted = sample.mapInArrow(lambda b: _counted(b, wanted), "prefix string, n long, toxic int")
    rows = counted.groupBy("prefix").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    return {r.prefix: r.n for r in rows.collect()}


def _ratio(a: int, n: int, b: int, m: int) -> float:
    """Twice the log-likelihood ratio of shares ``a`` of ``n`` and ``b`` of ``m``."""
    def part(seen: float, size: float, share: float) -> float:
        return seen * math.log(seen / (size * share)) if seen else 0.0

    share = (a + b) / (n + m)
    return 2 * (part(a, n, share) + part(n - a, n, 1 - share)
                + part(b, m, share) + part(m - b, m, 1 - share))


def chosen_patterns(toxic: dict[str, int], clean: dict[str, int], n_toxic: int, n_clean: int,
                    least: int) -> tuple[dict[str, float], dict[str, float]]:
    """Words, and stems of several words, with clear log-odds; weights are a quarter of their lower
    bounds squared, so that a few sure words outweigh many doubtful ones.

    A stem must bring ``least`` toxic documents beyond those of its most frequent word, so that a
    word's own beginning is none; longer stems count only where they say more than shorter
    ones.
    """
    def log_odds(pattern: str) -> tuple[float, float]:
        a, b = toxic.get(pattern, 0), clean.get(pattern, 0)
        weight = math.log((a + 0.5) / (n_toxic + 1)) - math.log((b + 0.5) / (n_clean + 1))
        return weight, weight - ERRORS * math.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))

    def weighed(pattern: str) -> float | None:
        ratio = _ratio(toxic[pattern], n_toxic, clean.get(pattern, 0), n_clean)
        sure = log_odds(pattern)[1]
        return sure * sure / 4 if sure >= LEAST_WEIGHT and ratio >= LEAST_RATIO else None

    found = {p: weighed(p) for p in toxic}
    words = {p[1:]: w for p, w in found.items() if p[0] == "=" and w is not None}
    most: Counter = Counter()
    for word, n in ((p[1:], n) for p, n in toxic.items() if p[0] == "="):
        for size in range(max(SHORTEST, len(word) - ENDING), min(len(word), LONGEST) + 1):
            most[word[:size]] = max(most[word[:size]], n)
    stems: dict[str, float] = {}
    longer = {p[:-1] for p, n in toxic.items() if p[0] != "=" and toxic.get(p[:-1]) == n}
    for prefix in sorted((p for p, w in found.items() if p[0] != "=" and w is not None),
                         key=lambda p: (len(p), p)):
        if prefix in longer or toxic[prefix] - most[prefix] < least:
            continue
        shorter = [stems[prefix[:n]] for n in range(SHORTEST, len(prefix)) if prefix[:n] in stems]
        if not shorter or found[prefix] > shorter[-1]:
            stems[prefix] = found[prefix]
    for word in INSULTS:  # unless labels speak against them
        seen = toxic.get("=" + word, 0) + clean.get("=" + word, 0)
        if seen < LEAST_DOCUMENTS or log_odds("=" + word)[0] >= LEAST_WEIGHT:
            words[word] = max(LISTED, words.get(word, 0.0))
    return words, stems


def fitted(rows: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Logistic weights drawn to the prior, all but the first at least zero: Newton steps by
    coordinate, which the convex loss allows."""
    rows, weights = rows @ GRAMMAR, PRIOR.copy()
    for _ in range(500):
        before = weights.copy()
        for i in range(len(weights)):
            p = 1 / (1 + np.exp(-np.clip(rows @ weights, -30, 30)))
            gradient = rows[:, i] @ (labels - p) - PRIOR_PRECISION * (weights[i] - PRIOR[i])
            curve = rows[:, i] ** 2 @ (p * (1 - p)) + PRIOR_PRECISION
            moved = weights[i] + np.clip(gradient / curve, -1, 1)
            weights[i] = max(0.0, moved) if i else moved
        if np.abs(weights - before).max() < 1e-8:
            break
    if not rows[:, -1].any():  # nothing was learned of menaces: one makes a document toxic
        weights[-1] = max(weights[-1], (1 - weights[0]) / MENACING)
    return weights


def fold(id_column: str = "doc_id"):
    """crc32 of the id as text, modulo five; 0 is held out."""
    return F.crc32(F.col(id_column).cast("string")) % 5


def learn(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE) -> Model:
    """Learn from the labelled rows that are not held out, at most about ``bound`` of them."""
    ship(docs.sparkSession)
    known = (labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(fold() != 0)
             .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")))
    share = min(1.0, bound / max(1, known.count()))
    sample = known.where(F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1 << 20))
                         < int(share * (1 << 20)))
    # the sample's size is bounded, so it may be sent to every task
    rows = docs.select(F.col("doc_id"), whole_text().alias("text")) \
        .join(F.broadcast(sample), "doc_id").withColumn("fold", fold())
    parts = {part: rows.where(where).select("text", "toxic")
             for part, where in (("patterns", "fold < 4"), ("weights", "fold = 4"))}
    sizes = {r.toxic: r.n for r in sample.where(fold() < 4).groupBy("toxic")
             .agg(F.count("*").alias("n")).collect()}
    n_toxic, n_clean = sizes.get(1, 0), sizes.get(0, 0)
    least = max(LEAST_DOCUMENTS, math.ceil(SUPPORT * n_toxic))
    toxic = _counts(parts["patterns"].where("toxic = 1"), None, least)
    wanted = frozenset(toxic) | {"=" + word for word in INSULTS}
    clean = _counts(parts["patterns"].where("toxic = 0"), wanted, 1)
    model = Model(*chosen_patterns(toxic, clean, n_toxic, n_clean, least))

    def featured(batches):
        finder = model.finder()
        for batch in batches:
            found = [model.features(x, finder) for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([x.tolist() for x in found], pa.list_(pa.float64())), batch.column(1)],
                names=["features", "toxic"])

    found = parts["weights"].mapInArrow(featured, "features array<double>, toxic int").collect()
    if found:
        model.weights = fitted(np.array([r.features for r in found]),
                               np.array([r.toxic for r in found], float))
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """The columns of ``docs`` with ``score`` (0 to 1) and ``predicted``."""
    from pyspark.sql.pandas.types import to_arrow_schema

    ship(docs.sparkSession)
    names = [x for x in docs.columns if x not in ("score", "predicted")]
    docs = docs.select(*[docs[x] for x in names])
    schema = (T.StructType(list(docs.schema.fields))
              .add("score", "double").add("predicted", "integer"))
    out = to_arrow_schema(schema)

    def scored(batches):
        finder = model.finder()
        for batch in batches:
            texts = batch.column(names.index("text")).to_pylist()
            values = np.array([model.score(model.features(x or "", finder)) for x in texts])
            columns = [batch.column(i).cast(out.field(i).type) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(values), pa.array((values >= 0.5).astype(np.int32))],
                schema=out)

    return docs.mapInArrow(scored, schema)
