"""Byte-level BPE encoding and decoding: speculate greedily, verify neighbours, merge the rest.

For every distinct word the longest vocabulary entry that fits is proposed, again and again.
A proposal is the encoding if and only if every two adjacent tokens are *compatible*, that is,
if merging the bytes of the two alone gives these two tokens; all adjacent pairs of a batch are
checked at once, by undoing the later of the two tokens' last merges until one of their parts
would have been merged across the border (no encoding) or both are single bytes. Only the words
with an incompatible pair are merged exactly. The same check tells at load which entries an
encoding can never hold; they are not proposed.

Words are what stands between spaces; they are looked up in a cache of the task, since the
pattern that cuts texts never looks across a single space between other characters. Texts
with other runs of white space are cut by the pattern as a whole.

Defined cases: a null text counts as empty and has no ids; strings of added tokens (such as the
end-of-text mark) are these tokens wherever they stand; ids that are no entries decode to
nothing, and bytes that are no UTF-8 to U+FFFD; null ids decode to null; repeated rows are
encoded each; an empty table gives no rows; other columns stay, but for ones named like the
results, which are replaced.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import pairwise
from unicodedata import category

import numpy as np
import pyarrow as pa
import pyarrow.compute
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import ship

#: The pattern that byte-level vocabularies of this kind cut texts by.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words in a task's cache, in each of two generations, and the longest that are kept.
CACHED_WORDS = 200_000
LONGEST_CACHED = 64
#: Bytes of a word from which on its merges are found by a heap.
HEAP_FROM = 100
#: Characters of texts that are encoded at once (a longer text is encoded alone).
CHUNK = 4_000_000

_WORDS = regex.compile(PATTERN)
_RUNS = regex.compile(r" \s|\s ")


def byte_characters() -> list[str]:
    """The character that stands for each byte in the vocabulary."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [x for x in range(256) if x not in set(shown)]
    named = {x: chr(x) for x in shown} | {x: chr(256 + i) for i, x in enumerate(hidden)}
    return [named[x] for x in range(256)]


class Vocabulary:
    """Entries and merges of a tokenizer file, and what the checks of pairs need.

    ``left`` and ``right`` are the parts that an entry was merged from (itself for a byte), and
    ``made`` is the number of that merge (-1 for a byte).
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            whole = json.load(file)
        model = whole["model"]
        plain = (whole["normalizer"], model["continuing_subword_prefix"] or None,
                 model["end_of_word_suffix"] or None, model["dropout"])
        cut = whole["pre_tokenizer"]
        if any(plain) or cut["type"] != "ByteLevel" or cut["add_prefix_space"] \
                or not cut["use_regex"]:
            raise ValueError(f"no plain byte-level vocabulary: {path}")
        self.cut = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
        byte_of = {c: i for i, c in enumerate(byte_characters())}
        self.ids = {bytes(byte_of[c] for c in x): i for x, i in model["vocab"].items()}
        self.added = {x["content"]: x["id"] for x in whole["added_tokens"]}
        if any(x["lstrip"] or x["rstrip"] or x["single_word"] for x in whole["added_tokens"]):
            raise ValueError(f"added tokens with conditions: {path}")
        size = 1 + max([*self.ids.values(), *self.added.values()])
        self.bytes = [b""] * size
        for text, i in self.ids.items():
            self.bytes[i] = text
        for text, i in self.added.items():
            self.bytes[i] = text.encode()
        self.single = [self.ids[bytes([x])] for x in range(256)]
        self._read_merges(model["merges"], byte_of, size)
        self._find_proposals()

    def _read_merges(self, merges: list, byte_of: dict[str, int], size: int) -> None:
        self.left, self.right = np.arange(size), np.arange(size)
        self.made = np.full(size, -1)
        self.number: dict[tuple[int, int], int] = {}
        self.wholes: list[int] = []
        for number, pair in enumerate(merges):
            one, two = (bytes(byte_of[c] for c in x)
                        for x in (pair if isinstance(pair, list) else pair.split(" ")))
            a, b, made = self.ids[one], self.ids[two], self.ids[one + two]
            if self.made[made] >= 0:
                raise ValueError("an entry that two merges make")
            self.left[made], self.right[made], self.made[made] = a, b, number
            self.number[a, b] = number
            self.wholes.append(made)
        keys = np.array([a * size + b for a, b in self.number], np.int64)
        self._order = np.argsort(keys)
        self._keys = np.append(keys[self._order], np.iinfo(np.int64).max)
        self._order = np.append(self._order, -1)

    def _find_proposals(self) -> None:
        """Entries that encodings can hold, and the longest one for each first three bytes."""
        merged = np.flatnonzero(self.made >= 0)
        alone = self.compatible(self.left[merged], self.right[merged], self.made[merged])
        usable = dict.fromkeys(self.single, True) | dict(zip(merged.tolist(), alone.tolist()))
        # parts that are merged otherwise make their wholes unusable, too
        for i in sorted(merged.tolist(), key=self.made.__getitem__):
            usable[i] = usable[i] and usable[int(self.left[i])] and usable[int(self.right[i])]
        self.proposed = {x: i for x, i in self.ids.items() if usable.get(i)}
        self.longest: dict[bytes, int] = {}
        for text in self.proposed:
            self.longest[text[:3]] = max(self.longest.get(text[:3], 2), len(text))

    def compatible(self, a: np.ndarray, b: np.ndarray, before: np.ndarray | None = None) \
            -> np.ndarray:
        """For each pair, whether it stays apart in all merges (or in those before a number)."""
        size = len(self.left)
        good = np.ones(len(a), bool)
        at = np.arange(len(a))
        a, b = a.astype(np.int64), b.astype(np.int64)
        limit = np.full(len(a), len(self.wholes)) if before is None else before.copy()
        while len(at):
            keys = a * size + b
            place = np.searchsorted(self._keys, keys)
            joined = (self._keys[place] == keys) & (self._order[place] < limit)
            good[at[joined]] = False
            first, second = self.made[a], self.made[b]
            # the later one is undone; of the same merge, the left one was first
            undo_a = first > second
            limit = np.where(undo_a, first, second + 1)
            go = ~joined & ((first >= 0) | (second >= 0))
            a, b = np.where(undo_a, self.right[a], a), np.where(undo_a, b, self.left[b])
            at, a, b, limit = at[go], a[go], b[go], limit[go]
        return good

    def propose(self, word: bytes) -> list[int]:
        """Always the longest entry that fits."""
        proposed, longest = self.proposed, self.longest
        whole = proposed.get(word)
        if whole is not None:
            return [whole]
        found, at, end = [], 0, len(word)
        while at < end:
            to = min(end, at + longest.get(word[at:at + 3], 2))
            while (token := proposed.get(word[at:to])) is None:
                to -= 1
            found.append(token)
            at = to
        return found

    def merge(self, word: bytes) -> list[int]:
        """The merges one by one, least number first, then leftmost."""
        ids = [self.single[x] for x in word]
        if len(ids) > HEAP_FROM:
            return self._merge_long(ids)
        number, wholes, none = self.number.get, self.wholes, len(self.wholes)
        numbers = [number(x, none) for x in pairwise(ids)]
        while numbers and (least := min(numbers)) < none:
            i = numbers.index(least)
            ids[i:i + 2] = [wholes[least]]
            del numbers[i]
            if i:
                numbers[i - 1] = number((ids[i - 1], ids[i]), none)
            if i < len(numbers):
                numbers[i] = number((ids[i], ids[i + 1]), none)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same with a heap of pairs and links between the ids that are left."""
        after = [*range(1, len(ids)), -1]
        before = list(range(-1, len(ids) - 1))
        number = self.number
        heap = [(number[x], i, *x) for i, x in enumerate(pairwise(ids)) if x in number]
        heapify(heap)
        while heap:
            least, i, a, b = heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = self.wholes[least], -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for at in (before[i], i):
                if at >= 0 and after[at] >= 0:
                    pair = ids[at], ids[after[at]]
                    if pair in number:
                        heappush(heap, (number[pair], at, *pair))
        return [x for x in ids if x >= 0]

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Ids of words that the pattern has cut."""
        texts = [x.encode() for x in words]
        found = [self.propose(x) for x in texts]
        sizes = np.array([len(x) for x in found], np.int64)
        tokens = np.fromiter((i for x in found for i in x), np.int64, int(sizes.sum()))
        owner = np.repeat(np.arange(len(found)), sizes)
        same = owner[1:] == owner[:-1]
        keys, inverse = np.unique((tokens[:-1] * len(self.left) + tokens[1:])[same],
                                  return_inverse=True)
        good = self.compatible(keys // len(self.left), keys % len(self.left))
        for at in np.unique(owner[1:][same][~good[inverse]]).tolist():
            found[at] = self.merge(texts[at])
        return found


class Encoder:
    """Encodes texts with a vocabulary, and keeps the words that it has met."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self._young: dict[str, bytes] = {}
        self._old: dict[str, bytes] = {}
        marks = sorted(vocabulary.added, key=len, reverse=True)
        self._assigned: set[str] = set()
        self._four = [x.to_bytes(4, "little") for x in range(len(vocabulary.bytes))]
        self._marks = regex.compile("(" + "|".join(map(regex.escape, marks)) + ")") \
            if marks else None

    def _cut(self, text: str) -> list[str]:
        """The pattern's words; the library cuts what holds characters that are new to Unicode."""
        if not text.isascii():
            new = set(text).difference(self._assigned)
            fresh = {c for c in new if category(c) == "Cn"}
            self._assigned |= new - fresh
            if fresh:
                return [text[a:b] for _, (a, b) in self.vocabulary.cut(text)]
        if text.isalpha() or text[:1] == " " and text[1:].isalpha():
            return [text]
        return _WORDS.findall(text)

    def _units(self, text: str) -> list[str]:
        """Parts of a text whose encodings, one after another, are the text's."""
        if _RUNS.search(text):
            return self._cut(text)
        first, *rest = text.split(" ")
        return [first, *[" " + x for x in rest]]

    def _learn(self, units: set[str]) -> None:
        """Put units into the cache; their words, as far as they are short, too."""
        young, old, four = self._young, self._old, self._four
        cut = {x: self._cut(x) for x in units}
        words = {w for parts in cut.values() for w in parts}.difference(young)
        known = words.intersection(old)
        young.update((w, old[w]) for w in known)
        new = list(words - known)
        for word, ids in zip(new, self.vocabulary.encode_words(new)):
            young[word] = b"".join([four[i] for i in ids])
        for unit, parts in cut.items():
            if len(parts) != 1:
                young[unit] = b"".join([young[w] for w in parts])
        for word in new:
            if len(word) > LONGEST_CACHED and word not in units:
                del young[word]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        added = self.vocabulary.added
        split: list[list[str]] = []
        for text in texts:
            parts = self._marks.split(text) if self._marks else [text]
            units = []
            for n, part in enumerate(parts):  # every other one is a mark
                units += [part] if n % 2 else self._units(part)
            split.append(units)
        if len(self._young) > CACHED_WORDS:
            self._young, self._old = {}, self._young
        young, old = self._young, self._old
        missing = set().union(*split).difference(young)
        for mark in missing.intersection(added):
            young[mark] = np.array([added[mark]], "<u4").tobytes()
        known = missing.intersection(old)
        young.update((x, old[x]) for x in known)
        missing.difference_update(known, added)
        self._learn(missing)
        out = [b"".join(map(young.__getitem__, units)) for units in split]
        for unit in missing:
            if len(unit) > LONGEST_CACHED:
                del young[unit]
        return out


def decode_ids(ids: bytes, tokens: list[bytes]) -> str:
    """The text of little-endian unsigned 32-bit ids."""
    found = np.frombuffer(ids, "<u4")
    if len(found) and found.max() >= len(tokens):
        found = found[found < len(tokens)]
    return b"".join(map(tokens.__getitem__, found.tolist())).decode("utf-8", "replace")


_vocabularies: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    """One for each worker process."""
    if path not in _vocabularies:
        _vocabularies[path] = Vocabulary(path)
    return _vocabularies[path]


def _chunks(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about CHUNK bytes of the column."""
    sizes = pa.compute.binary_length(batch.column(column)).fill_null(0)
    sums = np.cumsum(np.array(sizes, np.int64))
    start = 0
    while start < batch.num_rows:
        spent = int(sums[start - 1]) if start else 0
        end = max(start + 1, int(np.searchsorted(sums, spent + CHUNK, "right")))
        yield batch.slice(start, end - start)
        start = end


def _replaced(docs: DataFrame, **columns: str) -> str:
    """The schema of ``docs`` with columns that take the place of ones with the same name."""
    kept = [f"`{x.name}` {x.dataType.simpleString()}" for x in docs.schema
            if x.name not in columns]
    return ", ".join([*kept, *[f"{name} {kind}" for name, kind in columns.items()]])


def encode(docs: DataFrame, tokenizer: str, text: str = "text", decoded: bool = False,
           keep: list[str] | None = None) -> DataFrame:
    """``docs`` with ``n_tokens`` and ``ids`` (little-endian unsigned 32-bit integers).

    With ``decoded`` the column ``decoded`` has the text that the ids give; ``keep`` names the
    columns that stay (all, unless given). ``tokenizer`` is a file that every executor can
    read at that path.
    """
    ship(docs.sparkSession)
    results = {"n_tokens": "long", "ids": "binary"} | ({"decoded": "string"} if decoded else {})
    kept = [x for x in (docs.columns if keep is None else keep) if x not in results]
    own = "_" + max([*kept, text], key=len)  # no other column's name

    def run(batches):
        known = vocabulary(tokenizer)
        encoder = Encoder(known)
        for batch in batches:
            for part in _chunks(batch, own):
                ids = encoder.encode(part.column(own).to_pylist())
                columns = [part.column(x) for x in kept]
                columns += [pa.array([len(x) // 4 for x in ids], pa.int64()),
                            pa.array(ids, pa.binary())]
                if decoded:
                    columns.append(pa.array([decode_ids(x, known.bytes) for x in ids]))
                yield pa.RecordBatch.from_arrays(columns, names=[*kept, *results])

    rows = docs.select(*[docs[x] for x in kept], F.coalesce(docs[text], F.lit("")).alias(own))
    return rows.mapInArrow(run, _replaced(docs.select(*kept), **results))


def decode(rows: DataFrame, tokenizer: str, ids: str = "ids") -> DataFrame:
    """``rows`` with the text of their ids in the column ``decoded``."""
    ship(rows.sparkSession)
    kept = [x for x in rows.columns if x != "decoded"]

    def run(batches):
        tokens = vocabulary(tokenizer).bytes
        for batch in batches:
            for part in _chunks(batch, ids):
                texts = [None if x is None else decode_ids(x, tokens)
                         for x in part.column(ids).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(x) for x in kept], pa.array(texts, pa.string())],
                    names=[*kept, "decoded"])

    return rows.select(*kept).mapInArrow(run, _replaced(rows.select(*kept), decoded="string"))
