import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as entry
from ledgerloom.llm import byte_pairs
from tests.conftest import SMALL
from tests.llm.helpers import awkward, clashing, documents, sample

FILE = public_tokenizers.path("byte_bpe_50k.json")
PARTS = [
    " ", "  ", "\n", "\t", "a", "the", " The", "ing", "tion", "x" * 300, "é", "日本", "語", "🙂", "1",
    "23", "...", "'s", "'re", "'", "<|endoftext|>", "<|endo", "\x1c", "\x85", "Ω", "ſ", "0x",
    "==", "  \n", " \n ", "zzzz", "lololol", "ÃÂÃÂ", "﻿", "​", "\U0001d6a6", "՘", "\0",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(FILE)


@pytest.fixture(scope="module")
def vocabulary():
    return byte_pairs.Vocabulary(FILE)


def ids_of(library, text):
    return np.array(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def texts(seed):
    drawn = random.Random(seed)
    made = ["".join(drawn.choice(PARTS) for _ in range(drawn.randrange(30))) for _ in range(3000)]
    made += ["".join(chr(drawn.choice([
        drawn.randrange(32, 127), drawn.randrange(0x3000), drawn.randrange(0xD800),
        drawn.randrange(0xE000, 0x110000)])) for _ in range(drawn.randrange(20)))
        for _ in range(3000)]
    return made + ["".join(drawn.choice("abcdeorstn") for _ in range(drawn.randrange(1, 40)))
                   for _ in range(3000)]


def test_equals_library_on_drawn_texts(library, vocabulary, monkeypatch):
    monkeypatch.setattr(byte_pairs, "CACHED_WORDS", 500)
    encoder = byte_pairs.Encoder(vocabulary)
    for seed in range(3):
        drawn = texts(seed)
        for text, ids in zip(drawn, encoder.encode(drawn)):
            assert ids == ids_of(library, text), text
            assert byte_pairs.decode_ids(ids, vocabulary.bytes) == library.decode(
                np.frombuffer(ids, "<u4").tolist(), skip_special_tokens=False)


def test_every_character_is_cut_as_in_the_library(library, vocabulary):
    encoder = byte_pairs.Encoder(vocabulary)
    every = [chr(c) for c in range(0x30000) if not 0xD800 <= c < 0xE000]
    drawn = ["".join(f"a{c}1{c}.{c}{c}" for c in every[at:at + 64])
             for at in range(0, len(every), 64)]
    assert encoder.encode(drawn) == [ids_of(library, x) for x in drawn]


def test_verification_sends_only_failing_words_to_the_merges(vocabulary, monkeypatch):
    merged = []
    exact = byte_pairs.Vocabulary.merge
    monkeypatch.setattr(byte_pairs.Vocabulary, "merge",
                        lambda self, word: merged.append(word) or exact(self, word))
    words = [x for x in texts(9)[6000:]]
    found = vocabulary.encode_words(words)
    assert 0 < len(merged) < len(words)
    for word, ids in zip(words, found):
        text = word.encode()
        proposal = vocabulary.propose(text)
        assert ids == exact(vocabulary, text)
        assert (ids == proposal) == (text not in merged)


def test_compatible_pairs_are_those_that_merge_to_themselves(vocabulary):
    drawn = np.random.default_rng(4)
    a, b = drawn.integers(0, 50256, (2, 4000))
    good = vocabulary.compatible(a, b)
    tokens = vocabulary.bytes
    for x, y, apart in zip(a.tolist(), b.tolist(), good.tolist()):
        assert apart == (vocabulary.merge(tokens[x] + tokens[y]) == [x, y])


def test_heap_and_list_merge_alike(vocabulary, monkeypatch):
    words = [x.encode() for x in texts(11)[6000:]]
    found = [vocabulary.merge(x) for x in words]
    monkeypatch.setattr(byte_pairs, "HEAP_FROM", 0)
    assert [vocabulary.merge(x) for x in words] == found


def test_long_words_merge_in_linear_memory(vocabulary, library):
    drawn = random.Random(5)
    word = "".join(drawn.choice("abn") for _ in range(60_000))
    ids = byte_pairs.Encoder(vocabulary).encode([word])[0]
    assert ids == ids_of(library, word)


def test_decoding_unknown_and_broken_ids(vocabulary, library):
    broken = library.encode("𒀀", add_special_tokens=False).ids
    assert byte_pairs.decode_ids(np.array(broken[:1], "<u4").tobytes(), vocabulary.bytes) == \
        library.decode(broken[:1], skip_special_tokens=False) == "�"
    assert byte_pairs.decode_ids(np.array([10**6], "<u4").tobytes(), vocabulary.bytes) == ""


def test_awkward_rows(spark, library):
    docs = clashing(awkward(spark), "ids", "_text", "decoded", "n_tokens")
    found = byte_pairs.encode(docs, FILE, decoded=True)
    assert found.columns == ["doc_id", "text", "lang", "source", "n_chars", "_text", "n_tokens",
                             "ids", "decoded"]
    rows = found.collect()
    assert len(rows) == docs.count()
    for row in rows:
        assert bytes(row.ids) == ids_of(library, row.text or "")
        assert row.decoded == (row.text or "") and row.n_tokens == len(row.ids) // 4
    back = byte_pairs.decode(found.select("doc_id", "ids", found.decoded.alias("before")), FILE)
    assert back.where("decoded <> before").count() == 0 and back.count() == len(rows)
    assert byte_pairs.encode(documents(spark, []), FILE).count() == 0


def test_query_equals_library(spark, library):
    import hashlib

    found = {r.doc_id: r for r in
             entry.queries()["op12_speculative_byte_pairs"](spark, SMALL).collect()}
    expected = sample(SMALL)
    assert len(found) == len(expected)
    for doc_id, text in expected:
        ids = library.encode(text or "", add_special_tokens=False).ids
        row = found[doc_id]
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(library.decode(
            ids, skip_special_tokens=False).encode()).hexdigest()
