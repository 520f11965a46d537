from array import array

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import SentencePieceProcessor

from ledgerloom.llm import pieces
from tests.conftest import SMALL
from tests.llm.helpers import awkward, clashing, documents, sample

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def model():
    return SentencePieceProcessor(model_file=PATH)


def test_equals_the_library_and_round_trips(spark, model):
    rows = sample(SMALL)
    done = pieces.decode(pieces.encode(documents(spark, rows), PATH), PATH).collect()
    assert len(done) == len(rows)
    for r in done:
        assert r.ids == model.encode(r.text)
        assert r.decoded == r.text


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(
    st.text(max_size=25), st.text("aeinst th▁ \n", max_size=25),
    st.text("1.,<>0xA ", max_size=12)), max_size=5))
def test_random_texts(texts):
    model, encoder = SentencePieceProcessor(model_file=PATH), pieces.encoder(PATH)
    for text, ids in zip(texts, encoder.encode(texts)):
        expected = model.encode(text)
        assert array("I", ids).tolist() == expected
        assert encoder.decode(expected) == model.decode(expected)


def test_awkward_rows(spark, model):
    docs = clashing(awkward(spark), "ids", "decoded", "piece")
    done = pieces.encode(docs, PATH, decoded=True).collect()
    assert len(done) == docs.count()
    for r in done:
        assert r.ids == model.encode(r.text or "")
        assert r.decoded == model.decode(r.ids)
    assert pieces.encode(documents(spark, []), PATH).count() == 0


def test_long_words_of_unknown_characters(model):
    for text in ("漢" * 30_000, " " * 5_000, "ab" * 20_000, "🙂漢" * 3_000):
        assert array("I", pieces.encoder(PATH).encode([text])[0]).tolist() == model.encode(text)


def test_unknown_ids_decode_to_nothing():
    assert pieces.encoder(PATH).decode([-1, 10**6, 1, 0]) == ""
