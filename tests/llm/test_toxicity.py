import math
import random
import re
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__ as entry
from ledgerloom.llm import toxicity
from tests.conftest import SMALL
from tests.llm.helpers import awkward, clashing, documents

LABELS = "doc_id long, quality int, toxic int"
WORDS = "the river ran by a mill and we saw it from our old stone bridge today".split()


def corpus(spark, n=1500):
    """A third of the documents with one of two insults, of which one has many endings."""
    drawn, rows, labels = random.Random(2), [], []
    for i in range(n):
        words = [drawn.choice(WORDS) for _ in range(40)]
        toxic = int(i % 3 == 0)
        if toxic:
            insult = drawn.choice(["grubnik", "flomp" + drawn.choice("aeiou") + "st"])
            words[drawn.randrange(40)] = insult
        rows.append((i, " ".join(words)))
        labels.append((i, 1, toxic))
    return documents(spark, rows), spark.createDataFrame(labels, LABELS), labels


@pytest.fixture(scope="module")
def learned(spark):
    docs, labels, rows = corpus(spark)
    return docs, toxicity.learn(docs, labels), rows


def test_patterns_are_stems(learned):
    _, model, _ = learned
    assert {"grubnik", "flomp"} <= set(model.patterns)
    assert not any("river".startswith(p) for p in model.patterns)


def test_held_out_accuracy(spark, learned):
    docs, model, rows = learned
    labels = {i: t for i, _, t in rows}
    scored = toxicity.score(docs, model).collect()
    held = [r for r in scored if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert len(held) > 200
    assert sum(r.predicted == labels[r.doc_id] for r in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in scored)


def test_unseen_endings_and_the_grammar(learned):
    _, model, _ = learned
    finder = model.finder()

    def channels(text):
        return [bool(x) for x in model.features(text, finder)[1:]]

    plain, aimed, negated, reported, menace, hint = range(toxicity.CHANNELS)
    assert channels("we saw a flompzzz today")[plain]
    assert channels("we saw a flompzzzzzzzz today") == [False] * 6  # the ending is too long
    assert channels("you flompzzz")[aimed]
    assert channels("such a flompzzz, all of you")[aimed]
    assert channels("that is not a grubnik")[negated]
    assert channels("that isn\u2019t a grubnik")[negated]
    assert channels("Mary said it was a grubnik")[reported]
    assert channels("I will hurt you. The end")[menace]
    assert channels("you there, I will hurt it")[menace]
    assert channels("the sun can hurt you")[hint]
    assert channels("I will never hurt you") == [False] * 6
    assert channels("she said I would hurt you") == [False] * 6
    assert channels("it is not. a grubnik")[plain]  # a clause ends the negation
    assert channels("the river ran by a mill") == [False] * 6


def test_a_words_beginning_is_no_pattern(spark):
    docs, labels, _ = corpus(spark, 600)
    worth = docs.withColumn("text", F.regexp_replace("text", "flomp[aeiou]st", "worthless"))
    model = toxicity.learn(worth, labels)
    assert "worthless" in model.words and model.stems == {}
    finder = model.finder()
    neutral = model.score(model.features("", finder))
    assert model.score(model.features("the work of the world, worth it", finder)) == neutral


def test_transitions_cover_the_product():
    table = toxicity.composed()
    assert len(table) == 4 * 2 * 7 * 7 * 2 * 7
    assert {s for s, _, _ in table} >= {s for s, _ in table.values()}


def plainly(model, text):
    """Channels without automata: every word looks around itself in its clause."""
    sums = [0.0] * toxicity.CHANNELS
    for clause in re.split(r"[.!?;:\n\r\u2026]+", text.lower().replace("\u2019", "'")):
        words = re.findall(r"[^\W_]+(?:'[^\W_]+)*", clause)
        for i, word in enumerate(words):
            stems = [word[:n] for n in range(len(word), 0, -1)
                     if word[:n] in model.stems and len(word) - n <= toxicity.ENDING]
            weight = model.words.get(word, model.stems[stems[0]] if stems else 0)
            threat = word in toxicity.THREATS
            if not weight and not threat or word in set(toxicity.CLASSES) - toxicity.THREATS:
                continue
            near = words[max(0, i - 6):i]
            reported = toxicity.REPORTS & set(words[:i])
            negated = any(w in toxicity.NEGATIONS or w.endswith("n't")
                          for w in words[max(0, i - 3):i])
            aimed = toxicity.TARGETS & set(near + words[i + 1:i + 7])
            if threat:
                if aimed and not negated and not reported:
                    spoken = toxicity.SPEAKERS & set(near)
                    sums[4 if spoken else 5] += toxicity.MENACING if spoken else toxicity.HINTING
            else:
                sums[3 if reported else 2 if negated else 1 if aimed else 0] += weight
    sums = [min(x, toxicity.MOST) for x in sums]
    start, insult, target, menace = model.weights
    any_insult = sums[0] + sums[1] + toxicity.DAMPED * (sums[2] + sums[3])
    x = start + insult * any_insult + target * sums[1] + menace * (sums[4] + sums[5])
    return 1 / (1 + math.exp(-x))


SAID = ["grubnik", "flompist", "flompzz", "idiot", "you", "they", "not", "isn't", "said", "kill",
        "hurt", "I", "we", "the", "river", "mill", "ran", "old", ".", ",", "!", "\n", "him"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(SAID), max_size=40))
def test_scores_equal_a_plain_search(learned, words):
    _, model, _ = learned
    text = " ".join(words)
    assert model.score(model.features(text, model.finder())) == pytest.approx(plainly(model, text))


def test_query_scores_equal_a_plain_search(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = toxicity.learn(docs, spark.read.parquet(f"{SMALL}/labels.parquet"))
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    for r in entry.queries()["op3_toxicity_grammar"](spark, SMALL).collect():
        assert r.score == pytest.approx(plainly(model, texts[r.doc_id] or ""))


@pytest.mark.parametrize("size", ["0.01", "0.1"])
def test_the_grammar_decides(spark, size):
    folder = SMALL.replace("0.001", size)
    docs, labels = (spark.read.parquet(f"{folder}/{x}.parquet") for x in ("documents", "labels"))
    model = toxicity.learn(docs, labels)
    finder = model.finder()

    def score(text):
        return model.score(model.features(text, finder))

    neutral = score("the weather is fine")
    for plain, other in (("you are an idiot", "you are not an idiot"),
                         ("you are an idiot", "he said you are an idiot"),
                         ("it was stupid", "it was not stupid at all")):
        assert neutral < score(other) < 0.25
        assert score(plain) > 1.5 * score(other)
    assert score("you are an idiot") > 0.9
    assert size == "0.01" or score("it was stupid") > 0.9  # seven documents have it there
    assert score("I will kill you") > 0.5 > neutral
    assert score("I will hurt them badly") > 0.5
    assert score("the work of the world in other words") == neutral
    assert score("no worries, worth it") == neutral


def test_awkward_rows_and_no_labels(spark):
    docs = clashing(awkward(spark), "score", "predicted", "fold", "toxic")
    none = spark.createDataFrame([], LABELS)
    model = toxicity.learn(docs, none)
    assert model.patterns == dict.fromkeys(toxicity.INSULTS, toxicity.LISTED)
    scored = toxicity.score(docs, model)
    assert scored.count() == docs.count()
    assert {r.predicted for r in scored.collect()} == {0}
    assert toxicity.score(documents(spark, []), model).count() == 0
    odd = spark.createDataFrame([(1, 1, None), (None, 1, 1), (2, 1, 1), (2, 1, 0)], LABELS)
    toxicity.learn(docs, odd)


def test_query(spark):
    found = entry.queries()["op3_toxicity_grammar"](spark, SMALL).collect()
    assert len(found) == 200
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in found)
