import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerloom.llm import suffix_dedup
from ledgerloom.llm.suffix import reaches, suffix_array, words_at
from tests.conftest import SMALL
from tests.llm.helpers import PASSAGE, awkward, clashing, documents, sample


def plain(rows, length=50):
    """What stays of every row, by looking every string up."""
    least = {}
    raw = [(i, (t or "").encode()) for i, t in rows]
    for doc_id, data in raw:
        if doc_id is not None:
            for p in range(len(data) - length + 1):
                cut = data[p:p + length]
                least[cut] = min(least.get(cut, doc_id), doc_id)
    out = []
    for doc_id, data in raw:
        gone = np.zeros(len(data), bool)
        if doc_id is not None:
            for p in range(len(data) - length + 1):
                if least[data[p:p + length]] < doc_id:
                    gone[p:p + length] = True
        starts = int(np.count_nonzero(gone & ~np.r_[False, gone][:-1]))
        out.append((doc_id, len(data), int(gone.sum()), starts,
                    bytes(np.frombuffer(data, np.uint8)[~gone])))
    return sorted(out, key=str)


def got(docs):
    found = suffix_dedup.dedup(docs).collect()
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in found),
                  key=str)


def test_equals_brute_force(spark, monkeypatch):
    rows = sample(SMALL)
    expected = plain(rows)
    assert got(documents(spark, rows)) == expected
    for name, size in (("BLOCK_BYTES", 20_000), ("KEYS_BYTES", 60_000), ("SHARD_BYTES", 9_000)):
        monkeypatch.setattr(suffix_dedup, name, size)
    assert got(documents(spark, rows)) == expected


def test_awkward_rows(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", 30_000)
    docs = awkward(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert got(clashing(docs, "kept", "n_bytes", "block", "shard")) == plain(rows)
    digest = suffix_dedup.dedup(docs.select("doc_id", "text"), digest=True).collect()
    assert sorted((str(r.doc_id), r.kept_sha256) for r in digest) == sorted(
        (str(r[0]), hashlib.sha256(r[4]).hexdigest()) for r in plain(rows))
    assert suffix_dedup.dedup(documents(spark, [])).count() == 0


def test_random_texts_of_few_letters(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", 600)
    drawn = random.Random(5)
    parts = ["".join(drawn.choice("abcé") for _ in range(90)) for _ in range(6)]
    rows = []
    for i in range(60):
        part = drawn.choice(parts)
        a, b = sorted(drawn.sample(range(91), 2))
        rows.append((drawn.randrange(40), "".join(drawn.choice("ab") for _ in range(20))
                     + part[a:b] + drawn.choice(["", "a" * 120, part[b:]])))
    assert got(documents(spark, rows)) == plain(rows)


def test_cleaned_text_keeps_columns_and_whole_characters(spark):
    shared = "é" * 40
    docs = documents(spark, [(1, "a" + shared), (2, "b" + shared + "c"), (3, None)])
    found = suffix_dedup.cleaned(docs)
    assert found.columns == docs.columns
    rows = {r.doc_id: r for r in found.collect()}
    assert rows[1].text == "a" + shared
    assert rows[2].text == "bc" and rows[2].n_chars == 2
    assert rows[3].text == ""


@pytest.mark.parametrize("length", [31, 128])
def test_length_bounds(spark, length):
    with pytest.raises(ValueError):
        suffix_dedup.dedup(documents(spark, []), length)


@settings(max_examples=150, deadline=None)
@given(st.one_of(st.binary(max_size=80), st.text("ab", max_size=80).map(str.encode)))
def test_suffix_array(data):
    whole = suffix_array(data, len(data) + 1).tolist()
    assert whole == sorted(range(len(data)), key=lambda i: data[i:])
    part = suffix_array(data, 8).tolist()
    assert [data[i:i + 8] for i in part] == sorted(data[i:i + 8] for i in range(len(data)))


def test_common_prefixes():
    data = PASSAGE.encode() * 2 + b"end"
    words, size = words_at(data), len(PASSAGE.encode())
    a = np.array([0, 1, size - 45])
    assert reaches(words, a, a + size, 48).tolist() == [True, True, False]


def test_hot_keys_are_dealt_by_windows(spark, monkeypatch):
    drawn = random.Random(8)

    def own(size):
        return "".join(drawn.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(size))

    passage, phrase = own(200), own(30)
    rows = [(i, own(80) + (passage if i % 3 else phrase) + own(80) + "x" * (i % 5 * 40))
            for i in range(400)]
    rows += [(i, rows[i][1][30:150]) for i in range(0, 400, 7)] + [(None, passage)]
    held = []
    for name, size in (("BLOCK_BYTES", 9_000), ("KEYS_BYTES", 30_000), ("SHARD_BYTES", 6_000)):
        monkeypatch.setattr(suffix_dedup, name, size)
    docs = documents(spark, rows)
    assert got(docs) == plain(rows)

    # what one shard holds, without Spark: blocks of 50 documents, one shard of keys
    tables = [suffix_dedup.pa.table({
        "doc_id": [i for i, _ in rows[at:at + 50]], "_ledgerloom_block": [at] * len(rows[at:at + 50]),
        "_ledgerloom_text": [t.encode() for _, t in rows[at:at + 50]]})
        for at in range(0, len(rows), 50)]
    keys = suffix_dedup.pa.concat_tables(
        suffix_dedup._ask_keys(t, "doc_id", 50, 1) for t in tables)
    seen = suffix_dedup._answer_keys(keys, 6_000)
    for number, t in zip(range(0, len(rows), 50), tables):
        mine = seen.filter(suffix_dedup.pc.equal(seen.column("_ledgerloom_block"), number))
        held.append(suffix_dedup._ask_regions(t, mine, "doc_id", 50, 1, 40))
    regions = suffix_dedup.pa.concat_tables(held)
    sizes = {}
    for shard, data in zip(*(regions.column(x).to_pylist() for x in ("shard", "data"))):
        sizes[shard] = sizes.get(shard, 0) + len(data)
    assert max(size for shard, size in sizes.items() if shard < 40) <= 3 * 6_000
    windows = [size for shard, size in sizes.items() if shard >= 40]
    assert len(windows) == 40 and max(windows) < 3 * sum(windows) / 40


def test_rows_without_an_id_in_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", 1000)
    docs = documents(spark, [(None, f"{i} " * 60) for i in range(40)] + [(1, "x" * 90)])
    rows = suffix_dedup.dedup(docs).collect()
    assert sum(r.n_removed for r in rows) == 0 and len(rows) == 41
