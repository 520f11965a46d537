"""SentencePiece encoding and decoding by suffix-array matching.

The new words of a batch are concatenated and indexed by a suffix array. Every piece of the
vocabulary is looked up in it by binary search, all of them at once; the ranges found give the
occurrences, which are edges of the words' lattices. Sorted by position, they are relaxed:
the best way to a place is known by its last piece, and an edge extends the way to its start
if the model would not merge across the two pieces. For merge models (byte-pair encoding)
exactly one way to each place passes these checks, and it is the model's encoding. Whether
two pieces stay apart is found by merging their joined characters once, and remembered.

Words with characters outside the vocabulary, and runs of spaces (whose pieces have equal
scores), are merged directly. Characters that have no piece become byte pieces.

Defined cases: null and empty texts have no ids; ids outside the vocabulary decode to
nothing; decoding drops the one space that encoding puts in front, and reads U+2581 as a
space; invalid byte sequences decode to U+FFFD; very long texts are cut into words first;
repeated rows are encoded each; an empty table gives no rows; other columns are kept.
"""

from __future__ import annotations

import re
from array import array
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ledgerloom.llm.common import ship
from ledgerloom.llm.suffix import suffix_array

SPACE = "▁"
#: Texts of so many characters are encoded together; words that a worker remembers.
BATCH_CHARS = 4 << 20
CACHED_WORDS = 250_000
CACHED_PAIRS = 500_000
LONGEST_CACHED = 64
#: Words that are indexed and matched at once.
INDEXED_WORDS = 80_000
SIGNS = ".,;:!?"
_SEPARATOR = b"\xff"
_RUNS = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n")


class Vocabulary:
    """Pieces of a merge model, its merges, and what of them has been worked out."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        count = model.get_piece_size()
        names = [model.id_to_piece(i) for i in range(count)]
        special = {i for i in range(count) if model.is_control(i) or model.is_unknown(i)
                   or model.is_unused(i)}
        self.bytes = {int(names[i][1:-1], 16): i for i in range(count) if model.is_byte(i)}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.names = ["" if i in special or i in self.byte_of else x for i, x in enumerate(names)]
        self.ids = {x: i for i, x in enumerate(self.names) if x}
        self.unknown = model.unk_id()
        self.scores = {x: model.get_score(i) for x, i in self.ids.items()}
        # nothing merges across two characters that stand together in no piece
        self.together = {x[i:i + 2] for x in self.ids for i in range(len(x) - 1)}
        self.apart: dict[int, bool] = {}
        # a piece that its own characters don't merge to never occurs
        self.usable = np.array([i for x, i in self.ids.items()
                                if set(x) != {SPACE} and "\n" not in x and self.merged(x) == [x]])
        longest = max(len(self.names[i].encode()) for i in self.usable)
        self.lengths = np.array([len(self.names[i].encode()) for i in self.usable])
        self.padded = np.zeros((len(self.usable), longest), np.uint8)
        for row, i in enumerate(self.usable):
            raw = self.names[i].encode()
            self.padded[row, :len(raw)] = np.frombuffer(raw, np.uint8)

    def merged(self, text: str) -> list[str]:
        """Merge neighbours, best score first and leftmost among equals, until none is a piece."""
        parts: list[str | None] = list(text)
        count, scores = len(parts), self.scores
        before, after = list(range(-1, count - 1)), list(range(1, count + 1))
        heap: list[tuple[float, int, str]] = []

        def offer(i: int) -> None:
            if i >= 0 and after[i] < count:
                joined = parts[i] + parts[after[i]]
                if joined in scores:
                    heappush(heap, (-scores[joined], i, joined))

        for i in range(count - 1):
            offer(i)
        while heap:
            _, i, joined = heappop(heap)
            if parts[i] is None or after[i] >= count or parts[i] + parts[after[i]] != joined:
                continue  # one of the two has merged meanwhile
            gone = after[i]
            parts[i], parts[gone] = joined, None
            after[i] = after[gone]
            if after[i] < count:
                before[after[i]] = i
            offer(before[i])
            offer(i)
        return [x for x in parts if x is not None]

    def stay_apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the model leaves each two neighbours as they are."""
        if len(self.apart) > CACHED_PAIRS:
            self.apart.clear()
        pairs, at = np.unique(a.astype(np.int64) << 20 | b, return_inverse=True)
        known, names = self.apart, self.names
        found = np.empty(len(pairs), bool)
        for i, pair in enumerate(pairs.tolist()):
            apart = known.get(pair)
            if apart is None:
                x, y = names[pair >> 20], names[pair & 0xFFFFF]
                apart = known[pair] = self.merged(x + y) == [x, y]
            found[i] = apart
        return found[at]

    def direct(self, word: str) -> list[int]:
        """Ids of a word by its merges; spaces lead it, and long runs are cut at new spaces."""
        out = []
        for part in self.merged(word):
            if part in self.ids:
                out.append(self.ids[part])
            elif self.bytes:
                out += [self.bytes[x] for x in part.encode()]
            else:
                out.append(self.unknown)
        return out

    def ranges(self, data: np.ndarray, sa: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For every usable piece, where the suffixes that start with it begin and end."""
        found = []
        for after in (False, True):
            low, high = np.zeros(len(self.usable), np.int64), np.full(len(self.usable), len(sa))
            while (open_ := np.flatnonzero(low < high)).size:
                middle = (low[open_] + high[open_]) // 2
                before = self._compare(data, sa[middle], open_)
                right = before < 0 if not after else before <= 0
                low[open_[right]] = middle[right] + 1
                high[open_[~right]] = middle[~right]
            found.append(low)
        return found[0], found[1]

    def _compare(self, data: np.ndarray, starts: np.ndarray, pieces: np.ndarray) -> np.ndarray:
        """Sign of each suffix's first bytes against a piece; 0 if it starts with the piece."""
        order = np.zeros(len(starts), np.int8)
        left = np.arange(len(starts))
        for depth in range(self.padded.shape[1]):
            left = left[self.lengths[pieces[left]] > depth]
            if not len(left):
                break
            a = data[starts[left] + depth].astype(np.int16)
            b = self.padded[pieces[left], depth].astype(np.int16)
            order[left] = np.sign(a - b)
            left = left[a == b]
        return order

    def encoded(self, words: list[str]) -> list[bytes]:
        """Ids of distinct words, as little-endian uint32 bytes."""
        raw = [x.encode() for x in words]
        joined = _SEPARATOR.join(raw) + _SEPARATOR
        longest = self.padded.shape[1]
        sa = suffix_array(joined, longest)
        data = np.frombuffer(joined + _SEPARATOR * longest, np.uint8)
        low, high = self.ranges(data, sa)
        counts = high - low
        ends = np.cumsum(counts)
        start = sa[np.arange(int(ends[-1])) + np.repeat(low - (ends - counts), counts)]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        stops = np.cumsum(sizes + 1) - 1
        begins = stops - sizes
        offset = start - np.repeat(begins.astype(np.int32), sizes + 1)[start]
        if sizes.max() < 65536:
            offset = offset.astype(np.uint16)
        order = np.argsort(offset, kind="stable")
        edges = (start[order], (start + np.repeat(self.lengths.astype(np.int32), counts))[order],
                 np.repeat(self.usable.astype(np.int32), counts)[order], offset[order])
        last, source = self._relaxed(len(joined), begins, *edges)
        last, source = last.tolist(), source.tolist()
        out = []
        for word, begin, stop in zip(words, begins.tolist(), stops.tolist()):
            if last[stop] >= 0:
                ids, at = [], stop
                while at > begin:
                    ids.append(last[at])
                    at = source[at]
                ids.reverse()
            else:
                ids = self.direct(word)
            out.append(array("I", ids).tobytes())
        return out

    def _relaxed(self, size: int, begins, start, end, piece, offset):
        """The last piece of the way to each place, and where it starts. All words advance
        together, by the places in them."""
        last, source = np.full(size, -1, np.int32), np.full(size, -1, np.int64)
        reached = np.zeros(size, bool)
        reached[begins] = True
        groups = np.flatnonzero(np.r_[True, offset[1:] != offset[:-1]]) if len(offset) else []
        for a, b in zip(groups, [*groups[1:], len(offset)]):
            kept = np.flatnonzero(reached[start[a:b]]) + a
            before = last[start[kept]]
            inner = np.flatnonzero(before >= 0)
            fits = np.ones(len(kept), bool)
            fits[inner] = self.stay_apart(before[inner], piece[kept[inner]])
            kept = kept[fits]
            last[end[kept]], source[end[kept]] = piece[kept], start[kept]
            reached[end[kept]] = True
        return last, source


class Encoder:
    """Ids of texts, with the ids of words seen before."""

    def __init__(self, path: str):
        self.vocabulary = Vocabulary(path)
        self._known: dict[str, bytes] = {}  # and those of the generation before
        self._old: dict[str, bytes] = {}

    @staticmethod
    def words(text: str) -> list[str]:
        """A text's parts, across which nothing merges; with a space in front, as encoded."""
        if not text:
            return []
        spaced = SPACE + text.replace(" ", SPACE)
        if SPACE * 2 in spaced or text.count(SPACE):
            return _RUNS.findall(spaced)
        out = []
        for number, line in enumerate(spaced.split("\n")):
            if number:
                out.append("\n")
            parts = line.split(SPACE)
            if parts[0]:
                out.append(parts[0])
            out += [SPACE + x for x in parts[1:]]
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [self.words(x) for x in texts]
        if len(self._known) > CACHED_WORDS:
            self._known, self._old = {}, self._known
        known, old = self._known, self._old
        new = set().union(*split).difference(known)
        again = new.intersection(old)
        known.update((word, old[word]) for word in again)
        new -= again
        together, ends = self.vocabulary.together, {}
        for word in new:  # a word and the sign after it, if nothing merges across
            if word[-1] in SIGNS and len(word) > 1 and word[-2:] not in together:
                ends[word] = word[:-1], word[-1]
        words = new.difference(ends)
        words.update(x for pair in ends.values() for x in pair)
        words.difference_update(known)
        plain = [x for x in words if x.strip(SPACE + "\n") and SPACE not in x[1:]]
        for at in range(0, len(plain), INDEXED_WORDS):
            part = plain[at:at + INDEXED_WORDS]
            known.update(zip(part, self.vocabulary.encoded(part)))
        for word in words.difference(plain):
            known[word] = array("I", self.vocabulary.direct(word)).tobytes()
        for word, (stem, sign) in ends.items():
            known[word] = known[stem] + known[sign]
        out = [b"".join(map(known.__getitem__, x)) for x in split]
        for word in (new | words):
            if len(word) > LONGEST_CACHED:
                del known[word]
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of ids, without the space in front."""
        names, byte_of = self.vocabulary.names, self.vocabulary.byte_of
        raw = b"".join(
            bytes([byte_of[i]]) if i in byte_of else names[i].encode()
            for i in ids if 0 <= i < len(names))
        text = raw.decode("utf-8", "replace").replace(SPACE, " ")
        return text[1:] if text.startswith(" ") else text


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each worker process."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


#: Rows that are encoded, decoded and returned together.
ROWS = 2000


def _with(docs: DataFrame, added: dict[str, T.DataType], rows) -> DataFrame:
    """The columns of ``docs`` with more, which ``rows`` makes of a batch of them."""
    from pyspark.sql.pandas.types import to_arrow_schema

    ship(docs.sparkSession)
    names = [x for x in docs.columns if x not in added]
    docs = docs.select(*[docs[x] for x in names])
    schema = T.StructType(list(docs.schema.fields))
    for name, kind in added.items():
        schema = schema.add(name, kind)
    out = to_arrow_schema(schema)

    def made(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                columns = [batch.column(i).cast(out.field(i).type) for i in range(len(names))]
                new = rows(batch, names)
                yield pa.RecordBatch.from_arrays(
                    [*columns, *(pa.array(v, out.field(n).type) for n, v in new.items())],
                    schema=out)

    return docs.mapInArrow(made, schema)


def encode(docs: DataFrame, model: str, text: str = "text", decoded: bool = False) -> DataFrame:
    """The columns of ``docs`` with ``ids``, and on request ``decoded``, the text of these.

    ``model`` is a file that executors can read.
    """
    added = {"ids": T.ArrayType(T.IntegerType())} | ({"decoded": T.StringType()} if decoded else {})

    def rows(batch, names):
        texts = [x or "" for x in batch.column(names.index(text)).to_pylist()]
        out, part, size = [], [], 0
        for x in [*texts, None]:
            if x is None or size > BATCH_CHARS:
                out += encoder(model).encode(part)
                part, size = [], 0
            if x is not None:
                part.append(x)
                size += len(x)
        offsets = np.cumsum([0, *(len(x) // 4 for x in out)]).astype(np.int32)
        ids = pa.ListArray.from_arrays(
            offsets, pa.array(np.frombuffer(b"".join(out), "<u4").astype(np.int32)))
        if not decoded:
            return {"ids": ids}
        return {"ids": ids,
                "decoded": [encoder(model).decode(array("I", x).tolist()) for x in out]}

    return _with(docs, added, rows)


def decode(docs: DataFrame, model: str, ids: str = "ids") -> DataFrame:
    """The columns of ``docs`` with ``decoded``, the text of its ids."""

    def rows(batch, names):
        decoder = encoder(model)
        return {"decoded": [decoder.decode(x or [])
                            for x in batch.column(names.index(ids)).to_pylist()]}

    return _with(docs, {"decoded": T.StringType()}, rows)
