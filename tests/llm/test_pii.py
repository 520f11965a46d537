import hashlib
import math
import re
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import __spark_entry__ as entry
from ledgerloom.llm import pii
from pyspark.sql import functions as F
from tests.conftest import SMALL
from tests.llm.helpers import awkward, clashing, documents, sample

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    doubled = [int(x) * (1 + i % 2) for i, x in enumerate(reversed(digits))]
    return sum(x - 9 if x > 9 else x for x in doubled) % 10 == 0


def plain(text):
    out = []
    for number, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": lambda: True,
                    "ip": lambda: all(int(x) <= 255 for x in m[0].split(".")),
                    "card": lambda: 13 <= len(digits) <= 19 and luhn(digits),
                    "phone": lambda: 9 <= len(digits) <= 15}[kind]
            if good():
                out.append((number, m.start(), m.end()))
    return out


def base(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    found = df.select("i", pii.base_spans(F.col("text")).alias("x")).collect()
    return {r.i: [(pii.KINDS.index(x.kind), x.start, x.end) for x in r.x] for r in found}


def test_base_spans_equal_the_plain_patterns(spark):
    texts = [t for _, t in sample(SMALL)] + [
        "a@b.c_d@e.f", "1.2.3.4.5.6.7.8", "1.2.3", "300.1.1.1", "000001.2.3.4", "é\U0001f642 x@y.z",
        "4111 1111 1111 1111 and 4111-1111-1111-1112", "+1 (555) 010-9999", "+12345678", "a@b",
        "\u0001x@y.z\u0001", "1" * 40, "@.@.@", "+1+22 333 444 55", "", "a@b.c@d.e"]
    found = base(spark, texts)
    assert [found[i] for i in range(len(texts))] == [plain(t) for t in texts]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.text("ab1029.@+- ()%é", max_size=60), min_size=40, max_size=80))
def test_base_spans_of_random_texts(spark, texts):
    found = base(spark, texts)
    assert [found[i] for i in range(len(texts))] == [plain(t) for t in texts]


LONG = ("a", "1", "1 ", "1.", "a@b.", "+1(((", "1.2.3.4 ", "@", "a.b-")


@pytest.mark.parametrize("unit", LONG)
def test_long_runs(spark, unit):
    assert base(spark, [unit * 600])[0] == plain(unit * 600)


def test_very_long_runs_end(spark):
    found = base(spark, [unit * 60_000 for unit in LONG])
    assert len(found[LONG.index("1.2.3.4 ")]) == 60_000
    assert found[0] == found[1] == []


def planted(spark):
    """Eight seeds and two identifiers that no pattern matches, after one word; other words
    precede no seed."""
    rows = [(i, f"Please write to mailbox: user{i}@host{i}.org or wait {i}.") for i in range(8)]
    rows += [(20, "Old style mailbox: someone[at]host9 here"),
             (21, "The old mailbox: other[at]host8 too"), (22, "It costs 12345 today"), (23, None)]
    return documents(spark, rows)


def test_contexts_reveal_other_identifiers(spark):
    found = {r.doc_id: r for r in pii.detect(planted(spark)).collect()}
    text = "Old style mailbox: someone[at]host9 here"
    start = text.index("someone")
    assert [tuple(x) for x in found[20].spans] == [(0, start, start + len("someone[at]host9"))]
    assert found[20].base == []
    assert found[22].spans == []
    assert all(x in found[i].spans for i in range(8) for x in found[i].base)
    assert found[23].spans == []


def bootstrapped(texts):
    """All spans of the texts, by plain loops."""
    places, followers = [], Counter()
    for row, text in enumerate(texts):
        base, hidden = plain(text), list(text)
        followers.update(w for w in re.split(r"\s+", text.lower()) if 0 < len(w) <= 40)
        for kind, start, end in base:
            places.append((row, start, end, text[start:end], kind))
            hidden[start:end] = "\u0003" * (end - start)
        for m in re.finditer(r"(?<!\S)[^\s0-9@]*[0-9@]\S*(?:(?<=[0-9)]) \(?[0-9]\S*)*",
                             "".join(hidden)):
            inner = re.sub(r"^[(\[<\"'«]+", "", m[0])
            start = m.end() - len(inner)
            core = re.sub(r"(?<=[^.,;:!?)\]>\"'»])[.,;:!?)\]>\"'»]+$", "", inner)
            if len(core) >= 5 and "\u0003" not in core:
                places.append((row, start, start + len(core), core, None))

    def word(place):
        m = re.search(r"(?<!\S)(\S+)\s+$", texts[place[0]][max(0, place[1] - 60):place[1]])
        return m[1].lower() if m and len(m[1]) <= 40 else ""

    accepted, patterns = {}, {}
    for _ in range(pii.ROUNDS):
        instances = defaultdict(Counter)
        for place in places:
            kind, score = (place[4], 1.0) if place[4] is not None else accepted.get(
                place[3], (None, 0))
            if kind is not None and word(place):
                instances[kind, word(place)][place[3], place[4] is None] += score
        patterns = {}
        for (kind, w), scores in instances.items():
            confidence = min(1.0, sum(scores.values()) / followers[w]) if followers[w] else 0
            if len(scores) >= pii.SUPPORT and confidence >= pii.CONFIDENCE:
                patterns[kind, w] = confidence
        accepted = {}
        for value in {p[3] for p in places if p[4] is None}:
            before = {word(p) for p in places if p[4] is None and p[3] == value}
            best = max((1 - math.prod(max(1e-12, 1 - c) for (k, w), c in patterns.items()
                                      if k == kind and w in before), pii.KINDS[kind])
                       for kind in range(4))
            if best[0] >= pii.SCORE:
                accepted[value] = pii.KINDS.index(best[1]), best[0]
    found = [sorted(plain(t)) for t in texts]
    for row, start, end, value, kind in places:
        if kind is None and value in accepted:
            kind = accepted[value][0]
            telling = sum(c.isalnum() for c in value) >= pii.TELLING
            apart = all(e <= start or s >= end for _, s, e in plain(texts[row]))
            if apart and (telling or (kind, word((row, start, end))) in patterns):
                found[row].append((kind, start, end))
    return [sorted(set(x)) for x in found]


def detected(spark, texts):
    rows = pii.detect(documents(spark, list(enumerate(texts)))).collect()
    return [[tuple(x) for x in r.spans] for r in sorted(rows, key=lambda r: r.doc_id)]


def of(text, value, kind):
    return kind, text.index(value), text.index(value) + len(value)


def test_spaced_numbers_after_a_learned_word(spark):
    texts = [f"Ring phone: +1 555 01{i} 9{i}99 today" for i in range(10, 40)]
    texts += ["His phone: 555 010 9999, ask", "Her phone: 01512 345678 now", "the (030) 44 55 sign"]
    found = detected(spark, texts)
    assert found[30] == [of(texts[30], "555 010 9999", 3)]
    assert found[31] == [of(texts[31], "01512 345678", 3)]
    assert found[32] == []
    assert found == bootstrapped(texts)


def chained():
    """Seeds teach "mailbox:", what follows it teaches "reachable:"."""
    texts = [f"write to mailbox: user{i}@host{i}.org or wait" for i in range(12)]
    names = [f"person{i}[at]host{i}" for i in range(4)]
    texts += [f"an old mailbox: {x} here" for x in names]
    texts += [f"reachable: {x} at night" for x in names]
    return texts + ["reachable: hermit[at]cave77 never", "hermit[at]cave77 is elsewhere, too",
                    "mailbox: no1x5 is short", "the no1x5 and 12345 are no names"]


def test_accepted_instances_induce_patterns(spark, monkeypatch):
    texts = chained()
    found = detected(spark, texts)
    hermit = [of(texts[20], "hermit[at]cave77", 0)]
    assert found[20] == hermit  # a pattern of the second round
    assert found[21] == [of(texts[21], "hermit[at]cave77", 0)]  # at its other places
    assert found[22] == [of(texts[22], "no1x5", 0)] and found[23] == []
    assert found == bootstrapped(texts)
    monkeypatch.setattr(pii, "ROUNDS", 1)
    assert detected(spark, texts)[20] == [] and detected(spark, texts)[12] != []


@settings(max_examples=6, deadline=None)
@given(st.randoms(use_true_random=False))
def test_added_spans_equal_plain_loops(spark, drawn):
    values = ([f"a{i}@b{i}.org" for i in range(6)] + [f"+1 555 010 99{i}0" for i in range(6)]
              + [f"name{i}[at]host" for i in range(5)] + [f"01{i}2 345 678" for i in range(5)]
              + ["12345", "x9", "10.0.0.1", "1" * 130])
    words = ["mail:", "phone:", "box", "the", "line"]
    texts = []
    for _ in range(150):
        group = drawn.randrange(3)
        value = drawn.choice(values[:6] + values[12:17] if group == 0 else
                             values[6:12] + values[17:22] if group == 1 else values)
        word = drawn.choice([["mail:", "box"], ["phone:", "line"], words][group])
        texts.append(f"see {word} {value}{drawn.choice(['', '.', ', and'])} end")
    assert detected(spark, texts) == bootstrapped(texts)


def test_query_spans_equal_plain_loops(spark):
    rows = sorted(spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
                  .collect())
    expected = bootstrapped([r.text or "" for r in rows])
    found = {r.doc_id: r.spans
             for r in entry.queries()["op7_contextual_pii"](spark, SMALL).collect()}
    for r, spans in zip(rows, expected):
        assert found[r.doc_id] == ",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in spans)


def test_redaction(spark):
    docs = planted(spark).where("doc_id >= 20").unionByName(documents(
        spark, [(1, "Mail a@1.2.3.4 now, +1 555 010 9999."), (2, "None.")]))
    found = pii.detect(docs)
    text = {r.doc_id: r.out for r in found.select(
        "doc_id", pii.redacted(F.col("text"), F.col("spans")).alias("out")).collect()}
    assert text[1] == "Mail <EMAIL> now, <PHONE>."
    assert text[2] == "None."
    assert text[23] is None


def test_awkward_rows(spark):
    docs = clashing(awkward(spark), "spans", "base", "_row", "_spans", "kind", "word")
    found = pii.detect(docs)
    assert found.count() == docs.count()
    assert {"_row", "_spans", "kind"} <= set(found.columns)
    for r in found.collect():
        assert [tuple(x) for x in r.base] == sorted(plain(r.text))
    assert pii.detect(documents(spark, [])).count() == 0


def test_query(spark):
    found = {r.doc_id: r for r in entry.queries()["op7_contextual_pii"](spark, SMALL).collect()}
    for doc_id, text in sample(SMALL):
        listed = [f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in plain(text)]
        r = found[doc_id]
        assert r.base_sha256 == hashlib.sha256(",".join(listed).encode()).hexdigest()
        assert set(listed) <= set(r.spans.split(",")) | {""}
        counts = [sum(x.startswith(k + ":") for x in listed) for k in pii.KINDS]
        assert counts == [r.n_email, r.n_ip, r.n_card, r.n_phone]
