import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from ledgerloom.llm import packing
from tests.conftest import SMALL
from tests.llm.helpers import awkward, clashing, documents, sample

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def expected(tokenizer, rows, capacity=2048):
    out = []
    for doc_id, text in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        for start in range(0, len(ids), capacity):
            raw = np.array(ids[start:start + capacity], "<u4").tobytes()
            out.append((doc_id, start // capacity, start, len(raw) // 4, zlib.crc32(raw)))
    return sorted(out, key=str)


def checked(packed, capacity=2048):
    rows = packed.collect()
    places = {}
    for r in rows:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in places.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= capacity
    return rows, places


def test_pieces_equal_the_tokenizer(spark, tokenizer):
    rows = sample(SMALL)
    found, places = checked(packing.pack(documents(spark, rows), PATH))
    got = sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found), key=str)
    assert got == expected(tokenizer, rows)
    total = sum(r.length for r in found)
    assert len(places) <= 1.02 * total / 2048 + 1


def test_awkward_rows(spark, tokenizer):
    docs = awkward(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    found, _ = checked(packing.pack(clashing(docs, "piece", "loose", "ids"), PATH))
    got = sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found), key=str)
    assert got == expected(tokenizer, rows)


def test_empty_table_and_ids(spark):
    assert packing.pack(documents(spark, []), PATH).count() == 0
    packed = packing.pack(documents(spark, [(1, "a cat")]), PATH, with_ids=True).first()
    assert len(packed.ids) == 4 * packed.length


def test_second_pass_merges_tasks(spark, tokenizer):
    rows = [(i, "short text number %d" % i) for i in range(400)]
    found, places = checked(packing.pack(documents(spark, rows).repartition(8), PATH))
    assert len(found) == 400
    assert len(places) == -(-sum(r.length for r in found) // 2048)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(max_size=30), max_size=6))
def test_word_ids_equal_the_tokenizer(texts):
    words, tokenizer = packing.word_ids(PATH), Tokenizer.from_file(PATH)
    for text, ids in zip(texts, words.of(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == \
            tokenizer.encode(text, add_special_tokens=False).ids


@given(st.lists(st.integers(1, 64), max_size=300), st.integers(1, 8))
def test_bins(lengths, most):
    bins, fill = packing.OpenBins(64, most), {}
    for length in lengths:
        number, place = bins.put(length)
        assert place == fill.get(number, 0)
        fill[number] = place + length
        assert fill[number] <= 64
        assert len(bins.used) <= most


def test_the_fullest_sufficient_bin_is_taken_and_the_fullest_closes():
    bins = packing.OpenBins(10, 2)
    a, b = bins.put(6)[0], bins.put(5)[0]
    assert bins.put(4)[0] == a  # four are free in a, five in b
    c = bins.put(8)[0]
    assert set(bins.used) == {b, c}
    bins.put(7)
    assert c not in bins.used
