"""Best-fit packing of tokenized documents into fixed-length sequences.

Bounded-space online best-fit: each task keeps a fixed number of open bins, indexed by a
bitset in which bit ``f`` says that some open bin has ``f`` free tokens. A piece goes to
the bin with the least sufficient space (lowest set bit from its length on); when all
bins are open and a new one is needed, the fullest (lowest set bit) closes first. Bins
that are still open when a task ends are taken apart, and the pieces of many tasks are
packed once more, largest first, by the same rule.

Defined cases: a null text counts as empty, an empty text is the single end token, a null
doc_id stays null, repeated rows are packed once each, an empty table gives no rows, and
columns other than ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from unicodedata import normalize

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import released, ship, stored, whole_text

CAPACITY = 2048
OPEN_BINS = 1024
#: Of the second pass: its partitions hold at most MERGED_TASKS * OPEN_BINS bins' pieces.
MERGED_BINS = 65536
MERGED_TASKS = 32
END_ID = 0
#: Entries of a task's word cache, in each of two generations.
CACHED_WORDS = 500_000
LONGEST_CACHED = 64
#: Bytes of texts that are looked up at once (a longer text alone).
PART_BYTES = 8 << 20

PIECES = ("doc_id long, piece int, start long, length long, ids_crc32 long, ids binary, "
          "sequence_id long, offset long, loose boolean")


#: Bytes that byte-level vocabularies write as the code points from 256 on, in this order.
SHIFTED = {byte: 256 + i for i, byte in enumerate(
    [*range(0x21), *range(0x7F, 0xA1), 0xAD])}


class WordIds:
    """Token ids of texts as little-endian uint32 bytes.

    The tokenizer never joins characters across white space, nor letters and other signs, so
    ids are looked up per word; words of letters that are new go to the merges straight away,
    all other new words through the whole tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._merges = self._tokenizer.model
        self._four = [x.to_bytes(4, "little") for x in range(self._tokenizer.get_vocab_size())]
        self.most = CACHED_WORDS
        self.forget()

    def forget(self) -> None:
        """Empty the cache."""
        self._young: dict[str, bytes] = {"": b""}
        self._old: dict[str, bytes] = {}

    def _letters(self, lower: str) -> bytes:
        """Ids of a lower-case word of letters."""
        if not lower.isascii():
            lower = lower.encode().decode("latin-1").translate(SHIFTED)
        return b"".join([self._four[x.id] for x in self._merges.tokenize(lower)])

    def _encode(self, words: list[str]) -> list[bytes]:
        found = self._tokenizer.encode_batch_fast(words, add_special_tokens=False)
        return [b"".join([self._four[i] for i in x.ids]) for x in found]

    def _learn(self, missing: set[str]) -> None:
        young, others = self._young, {}
        for word in missing:
            stem = word.rstrip(".,")
            if stem.isalpha() and "\u03a3" not in stem:  # whose lower case depends on the place
                lower = stem.lower()
                if not lower.isascii():
                    lower = normalize("NFC", stem).lower()
                if lower.isalpha():
                    ids = young.get(lower)
                    if ids is None:
                        ids = young[lower] = self._letters(lower)
                    tail = word[len(stem):]
                    if tail:
                        if tail not in young:
                            young[tail], = self._encode([tail])
                        ids = ids + young[tail]
                    young[word] = ids
                    continue
            others[word] = None
        young.update(zip(others, self._encode(list(others))))

    def of(self, texts: list[str]) -> list[bytes]:
        split = [x.replace("\n", " ").split(" ") for x in texts]
        if len(self._young) > self.most:
            self._young, self._old = {"": b""}, self._young
        young, old = self._young, self._old
        missing = set().union(*split).difference(young)
        known = missing.intersection(old)
        young.update((word, old[word]) for word in known)
        missing -= known
        self._learn(missing)
        out = [b"".join(map(young.__getitem__, words)) for words in split]
        for word in missing:
            if len(word) > LONGEST_CACHED:
                young.pop(word, None)
                young.pop(word.rstrip(".,").lower(), None)
        return out


_tokenizers: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """One tokenizer for each worker process; its cache is emptied when a task ends."""
    if path not in _tokenizers:
        _tokenizers[path] = WordIds(path)
    return _tokenizers[path]


class OpenBins:
    """At most ``most`` open bins; ``put`` returns the bin's number and the place in it."""

    def __init__(self, capacity: int, most: int):
        self.capacity, self.most = capacity, most
        self.used: dict[int, int] = {}  # of open bins
        self._free: dict[int, list[int]] = {}  # bins by free space
        self._bits = 0
        self.made = 0

    def _take(self, least: int) -> int | None:
        """Remove and return the fullest bin with at least so much free space."""
        bits = self._bits >> least
        if not bits:
            return None
        free = least + (bits & -bits).bit_length() - 1
        stack = self._free[free]
        found = stack.pop()
        if not stack:
            self._bits ^= 1 << free
        return found

    def put(self, length: int) -> tuple[int, int]:
        number = self._take(length)
        if number is None:
            if len(self.used) >= self.most:
                del self.used[self._take(1)]  # full bins have left already
            number, self.made = self.made, self.made + 1
            self.used[number] = 0
        place = self.used[number]
        free = self.capacity - place - length
        if free:
            self.used[number] = place + length
            self._free.setdefault(free, []).append(number)
            self._bits |= 1 << free
        else:
            del self.used[number]
        return number, place


def _table(rows: dict[str, list]) -> pa.RecordBatch:
    types = {"piece": pa.int32(), "ids": pa.binary(), "loose": pa.bool_()}
    return pa.RecordBatch.from_arrays(
        [pa.array(v, types.get(k, pa.int64())) for k, v in rows.items()], names=list(rows))


def _numbered(task: int, number: int) -> int:
    return task << 32 | number


def _pieces(batches, tokenizer: str, capacity: int, with_ids: bool, part_bytes: int,
            cached_words: int) -> Iterator[dict[str, list]]:
    words = word_ids(tokenizer)
    words.most = cached_words
    try:
        for batch in batches:
            sizes = pa.compute.binary_length(batch.column(1)).fill_null(0)
            sums, at = np.cumsum(np.array(sizes, np.int64)), 0
            while at < batch.num_rows:
                spent = int(sums[at - 1]) if at else 0
                end = max(at + 1, int(np.searchsorted(sums, spent + part_bytes, "right")))
                yield _cut(words, batch.slice(at, end - at), capacity, with_ids)
                at = end
    finally:  # workers live on between tasks and stages
        words.forget()
        released()


def _cut(words: WordIds, part: pa.RecordBatch, capacity: int, with_ids: bool) -> dict[str, list]:
    """The pieces of some documents."""
    end = np.array([END_ID], "<u4").tobytes()
    rows: dict[str, list] = {k: [] for k in (
        "doc_id", "piece", "start", "length", "ids_crc32", "ids")}
    for doc_id, ids in zip(part.column(0).to_pylist(), words.of(part.column(1).to_pylist())):
        ids = memoryview(ids + end)
        for piece, start in enumerate(range(0, len(ids), 4 * capacity)):
            cut = ids[start:start + 4 * capacity]
            for k, v in zip(rows, (doc_id, piece, start // 4, len(cut) // 4,
                                   zlib.crc32(cut), bytes(cut) if with_ids else None)):
                rows[k].append(v)
    return rows


def _pack(tables: Iterator[dict[str, list]], capacity: int, most: int, loosen: bool):
    """Place the rows; rows of bins that stay open to the end are marked loose on request.

    Rows wait for their bin's end only as numbers of bins: the mark is set on the rows of
    the last ``most`` bins, which are held back and bounded by these bins' content.
    """
    from pyspark import TaskContext

    task = TaskContext.get().partitionId()
    bins = OpenBins(capacity, most)
    held: dict[int, list[tuple]] = {}
    names: list[str] = []
    columns = ("sequence_id", "offset", "loose")
    out: list[tuple] = []

    def table(rows: list[tuple]) -> pa.RecordBatch:
        return _table(dict(zip([*names, *columns], map(list, zip(*rows)))))

    for rows in tables:
        names = list(rows)
        for row in zip(*rows.values()):
            number, place = bins.put(row[3])
            held.setdefault(number, []).append((*row, _numbered(task, number), place, False))
        for number in [x for x in held if x not in bins.used]:
            out += held.pop(number)
        if out:
            yield table(out)
            out = []
    rest = [(*row[:-1], loosen) for rows in held.values() for row in rows]
    if rest:
        yield table(rest)


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, open_bins: int = OPEN_BINS,
         with_ids: bool = False, part_bytes: int = PART_BYTES,
         cached_words: int = CACHED_WORDS) -> DataFrame:
    """Pieces of every document with their sequence and place; ``ids`` only on request.

    ``part_bytes`` and ``cached_words`` bound a task's memory; results do not depend on them.
    ``tokenizer`` is a tokenizer file that every executor can read at that path.
    """
    spark = docs.sparkSession
    ship(spark)

    def first(batches):
        parts = _pieces(batches, tokenizer, capacity, with_ids, part_bytes, cached_words)
        yield from _pack(parts, capacity, open_bins, True)

    def again(batches):
        names = ("doc_id", "piece", "start", "length", "ids_crc32", "ids")
        yield from _pack(
            ({k: x.column(k).to_pylist() for k in names} for x in batches),
            capacity, MERGED_BINS, False)

    texts = docs.select(F.col("doc_id").cast("long"), whole_text().alias("text"))
    placed = stored(texts.mapInArrow(first, PIECES), "packed")
    task = F.shiftright("sequence_id", 32)
    groups = (placed.agg(F.max(task)).first()[0] or 0) // MERGED_TASKS + 1
    loose = (placed.where("loose")
             .repartition(groups, task % groups)
             .sortWithinPartitions(F.desc("length"), "doc_id", "piece", "ids_crc32"))
    merged = loose.mapInArrow(again, PIECES)
    # numbers of the second pass are negative, so that they differ from the first's
    both = placed.where("NOT loose").unionByName(
        merged.withColumn("sequence_id", -1 - F.col("sequence_id")))
    return both.drop("loose") if with_ids else both.drop("loose", "ids")
