"""Exact substring deduplication with suffix arrays of shards.

A byte goes if it lies in a string of ``length`` bytes that also starts in a document with a
smaller id. Documents are dealt into blocks, and three exchanges between blocks and shards
find those strings without sending the text around:

1. Every window of ``length`` bytes has a key, the least hash of its grams. A run of windows
   with one key is a region. Each block sends its distinct keys (four bytes each, cut) and
   learns which also occur in other blocks. The others cannot repeat. It also learns which
   keys are hot: those whose regions are more bytes than a shard has of text.
2. The regions that remain are sent, each different one once per block with the block's least
   document id, to the shard of their key. Equal windows have equal keys and so meet there.
   The shard sorts all suffixes of its regions by induced sorting, takes the permuted common
   prefixes, and answers the least document id of every window. Regions of hot keys are cut
   into their windows, which go, each different one once per block, to a shard by the hash of
   all their bytes, and need no sorting: so no key's regions are gathered in one place.
3. Each block marks the windows whose least id is below the document's own.

A string that very many documents share costs one region per block, not one per document.

Defined cases: a null text counts as empty; a document with a null id neither loses bytes
nor makes others lose them; rows that repeat an id are cleaned each and do not affect each
other; an empty table gives no rows; all columns of the input are kept.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm.common import released, ship
from ledgerloom.llm.suffix import reaches, suffix_array, words_at

LENGTH = 50
#: Bytes of a gram; shorter ones make smaller messages and more regions that don't repeat.
GRAM = 24
BLOCK_BYTES = 4 << 20
#: Of text, for each shard of keys and for each shard of regions.
KEYS_BYTES = 24 << 20
SHARD_BYTES = 2 << 20
#: Bytes of a block's regions of one key that are told when keys are counted; fewer count as so many.
TOLD_BYTES = 256
#: Windows whose keys are computed at once.
CHUNK = 1 << 17

_BLOCK = "_ledgerloom_block"
_TEXT = "_ledgerloom_text"
_MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)
_NULL = np.iinfo(np.int64).min


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX[2]
    x = (x ^ (x >> np.uint64(29))) * _MIX[0]
    return x ^ (x >> np.uint64(32))


def _window_keys(data: bytes, length: int) -> np.ndarray:
    """The key of every window: the least hash of its grams."""
    view, last = memoryview(data), len(data) - length + 1
    keys = np.empty(last, np.uint64)
    for at in range(0, last, CHUNK):
        to = min(at + CHUNK, last)
        keys[at:to] = _keys_of(view[at:to + length - 1], length)
    return keys


def _keys_of(data: memoryview, length: int) -> np.ndarray:
    words = words_at(data)
    count = len(data) - GRAM + 1
    hashes = _mixed(words[:count] * _MIX[0] + (words[8:8 + count] ^ _MIX[2]) * _MIX[1]
                    + np.bitwise_xor(words[16:16 + count], words[16:16 + count] >> np.uint64(31))
                    * _MIX[2])
    grams, span = length - GRAM + 1, 1
    while 2 * span <= grams:
        hashes = np.minimum(hashes[:-span], hashes[span:])
        span *= 2
    if span < grams:
        hashes = np.minimum(hashes[:span - grams], hashes[grams - span:])
    return hashes


class _Block:
    """The documents of a block, concatenated, with their regions (runs of windows)."""

    def __init__(self, table: pa.Table, id_column: str, length: int):
        ids = table.column(id_column).cast(pa.int64())
        texts = pc.fill_null(table.column(_TEXT).cast(pa.large_binary()), b"")
        order = pc.sort_indices(
            pa.table({"id": ids, "text": texts}), [("id", "ascending"), ("text", "ascending")])
        self.table = table.take(order)
        self.texts = texts.take(order).to_pylist()
        self.ids = np.array(pc.fill_null(ids.take(order), _NULL), np.int64)
        self.length = length
        self.data = b"".join(self.texts)
        self.ends = np.cumsum([len(x) for x in self.texts], dtype=np.int64)
        self.starts = self.ends - [len(x) for x in self.texts]
        self._regions()

    def _regions(self) -> None:
        empty = np.empty(0, np.int64)
        self.key, self.first, self.windows, self.doc = np.empty(0, np.uint64), empty, empty, empty
        last = len(self.data) - self.length + 1
        if last <= 0:
            return
        keys = _window_keys(self.data, self.length)
        new = np.empty(last, bool)
        new[0] = True
        np.not_equal(keys[1:], keys[:-1], out=new[1:])
        # windows within documents that have an id: from their starts to these bounds
        stops = np.maximum(self.ends - self.length + 1, self.starts)
        stops[self.ids == _NULL] = self.starts[self.ids == _NULL]
        for bounds in (self.starts, stops):
            new[bounds[bounds < last]] = True
        first = np.flatnonzero(new)
        windows = np.diff(np.r_[first, last])
        doc = np.searchsorted(self.ends, first, "right")
        kept = first < stops[doc]
        self.first, self.windows, self.doc = first[kept], windows[kept], doc[kept]
        self.key = _mixed(keys[self.first])

    def repeated(self, at: np.ndarray, seen_elsewhere: np.ndarray) -> np.ndarray:
        """Which regions have a key that another document has, here or elsewhere; ``at`` are
        the places of their keys among the distinct ones."""
        owner = self.ids[self.doc]  # ascending
        first, last = np.empty(len(seen_elsewhere), np.int64), np.empty_like(seen_elsewhere, int)
        first[at[::-1]] = owner[::-1]
        last[at] = owner
        return ((first != last) | seen_elsewhere)[at]

    def pieces(self, chosen: np.ndarray, hot: np.ndarray, shards: int):
        """First place, number of windows, document and shard of what is sent of the chosen
        regions: whole ones or, of hot ones, every window."""
        cold, cut = chosen[~hot], chosen[hot]
        counts = self.windows[cut]
        first = _expanded(self.first[cut], counts)
        shard = shards + _shard_of(self._hashes(first), shards)
        return (np.r_[self.first[cold], first],
                np.r_[self.windows[cold], np.ones(len(first), np.int64)],
                np.r_[self.doc[cold], np.repeat(self.doc[cut], counts)],
                np.r_[_shard_of(self.key[cold], shards), shard])

    def _hashes(self, first: np.ndarray) -> np.ndarray:
        """Hashes of all bytes of the windows that start there."""
        out = np.zeros(len(first), np.uint64)
        if len(first):
            words = words_at(self.data)
            for at in (*range(0, self.length - 8, 8), self.length - 8):
                out = _mixed(out * _MIX[1] + words[first + at])
        return out

    def distinct(self, first: np.ndarray, windows: np.ndarray, doc: np.ndarray, shard: np.ndarray):
        """Different contents in the order of their first place, the least id of each, the
        place of every piece among them, and their shards."""
        place: dict[bytes, int] = {}
        at = np.empty(len(first), np.int64)
        data, more = self.data, self.length - 1
        for i, (start, count) in enumerate(zip(first.tolist(), windows.tolist())):
            at[i] = place.setdefault(data[start:start + count + more], len(place))
        least = np.full(len(place), np.iinfo(np.int64).max)
        np.minimum.at(least, at, self.ids[doc])
        shards = np.empty(len(place), np.int64)
        shards[at] = shard
        return list(place), least, at, shards


def _shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    return (((keys >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)).astype(np.int64)


def _batch(schema: pa.Schema, rows: list[tuple]) -> pa.Table:
    return pa.table(
        [pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


_KEYS = pa.schema([("shard", pa.int64()), (_BLOCK, pa.int64()), ("keys", pa.binary()),
                   ("told", pa.binary()), ("bytes", pa.binary())])
_SEEN = pa.schema([(_BLOCK, pa.int64()), ("shard", pa.int64()), ("seen", pa.binary()),
                   ("hot", pa.binary())])
_REGIONS = pa.schema([("shard", pa.int64()), (_BLOCK, pa.int64()), ("sizes", pa.binary()),
                      ("ids", pa.binary()), ("data", pa.binary())])
_LEAST = pa.schema([(_BLOCK, pa.int64()), ("shard", pa.int64()), ("runs", pa.binary()),
                    ("ids", pa.binary())])


def _spark_schema(schema: pa.Schema) -> str:
    names = {pa.int64(): "long", pa.binary(): "binary"}
    return ", ".join(f"{f.name} {names[f.type]}" for f in schema)


def _sent_keys(block: _Block, shards: int) -> np.ndarray:
    """The shard and 32 bits of every region's key. Different keys that fall together can
    only make more candidates."""
    return (_shard_of(block.key, shards).astype(np.uint64) << np.uint64(32)) \
        | (block.key & np.uint64(0xFFFFFFFF))


def _by_shard(keys: np.ndarray) -> list[tuple[int, int, int]]:
    """Shard and bounds in sorted keys."""
    shard = (keys >> np.uint64(32)).astype(np.int64)
    firsts = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]]) if len(keys) else []
    return [(int(shard[a]), int(a), int(b)) for a, b in zip(firsts, np.r_[firsts[1:], len(keys)])]


def _ask_keys(table: pa.Table, id_column: str, length: int, shards: int) -> pa.Table:
    block = _Block(table, id_column, length)
    keys, at = np.unique(_sent_keys(block, shards), return_inverse=True)
    size = np.bincount(at, block.windows + length - 1, len(keys)).astype("<i8")
    cut, number, rows = keys.astype("<u4"), table.column(_BLOCK)[0].as_py(), []
    for shard, a, b in _by_shard(keys):
        told = np.flatnonzero(size[a:b] > TOLD_BYTES)
        rows.append((shard, number, cut[a:b].tobytes(), told.astype("<u4").tobytes(),
                     size[a:b][told].tobytes()))
    return _batch(_KEYS, rows)


def _answer_keys(table: pa.Table, most: int) -> pa.Table:
    """For each block's keys, whether another block sent them too, and which are hot: their
    regions may have more than ``most`` bytes in all blocks."""
    asked = [np.frombuffer(x, "<u4") for x in table.column("keys").to_pylist()]
    # each block's keys are distinct
    every, blocks = np.unique(np.concatenate(asked), return_counts=True)
    size = blocks * TOLD_BYTES
    for keys, told, told_bytes in zip(asked, table.column("told").to_pylist(),
                                      table.column("bytes").to_pylist()):
        large = keys[np.frombuffer(told, "<u4")]
        size[np.searchsorted(every, large)] += np.frombuffer(told_bytes, "<i8")
    hot, shard, rows = size > most, table.column("shard")[0].as_py(), []
    for number, keys in zip(table.column(_BLOCK).to_pylist(), asked):
        at = np.searchsorted(every, keys)
        rows.append((number, shard, np.packbits(blocks[at] > 1).tobytes(),
                     np.flatnonzero(hot[at]).astype("<u4").tobytes()))
    return _batch(_SEEN, rows)


def _candidates(block: _Block, seen: pa.Table, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """The regions whose key another document has, and which of them are of hot keys."""
    sent = _sent_keys(block, shards)
    keys, at = np.unique(sent, return_inverse=True)
    elsewhere, hot = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    answers = {x[0]: x[1:] for x in zip(*(seen.column(x).to_pylist()
                                          for x in ("shard", "seen", "hot")))}
    for shard, a, b in _by_shard(keys):
        bits, places = (np.frombuffer(x, t) for x, t in zip(answers[shard], (np.uint8, "<u4")))
        elsewhere[a:b] = np.unpackbits(bits, count=b - a).astype(bool)
        hot[a + places.astype(np.int64)] = True
    chosen = np.flatnonzero(block.repeated(at, elsewhere))
    return chosen, hot[at[chosen]]


def _ask_regions(table: pa.Table, seen: pa.Table, id_column: str, length: int, key_shards: int,
                 shards: int) -> pa.Table:
    if not len(table):
        return _batch(_REGIONS, [])
    block = _Block(table, id_column, length)
    sent = block.pieces(*_candidates(block, seen, key_shards), shards)
    regions, least, _, target = block.distinct(*sent)
    number = table.column(_BLOCK)[0].as_py()
    order = np.argsort(target, kind="stable")
    rows = []
    for part in np.split(order, np.flatnonzero(np.diff(target[order])) + 1):
        if len(part):
            mine = [regions[i] for i in part]
            rows.append((int(target[part[0]]), number,
                         np.array([len(x) for x in mine], "<u4").tobytes(),
                         least[part].astype("<i8").tobytes(), b"".join(mine)))
    return _batch(_REGIONS, rows)


def _expanded(firsts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers from each first on, so many as counted."""
    ends = np.cumsum(counts)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(firsts - (ends - counts), counts)


def _least_ids(data: bytes, starts: np.ndarray, owners: np.ndarray, length: int) -> np.ndarray:
    """For the windows at ``starts``, the least owner of an equal window."""
    sa = suffix_array(data, length)
    place = np.full(len(data), -1, np.int32)
    place[starts] = np.arange(len(starts))
    order = place[sa]
    order = order[order >= 0]  # windows in the order of their suffixes
    words = words_at(data)
    # permuted: the common prefix with the suffix before, in text order
    before = np.full(len(starts), -1, np.int64)
    before[order[1:]] = order[:-1]
    has = np.flatnonzero(before >= 0)
    same = np.zeros(len(starts), bool)
    same[has] = reaches(words, starts[has], starts[before[has]], length)
    groups = np.flatnonzero(~same[order])
    least = np.minimum.reduceat(owners[order], groups)
    out = np.empty(len(starts), np.int64)
    out[order] = np.repeat(least, np.diff(np.r_[groups, len(order)]))
    return out


def _answer_regions(table: pa.Table, length: int, shards: int) -> pa.Table:
    """The least id of every window of every block's regions; equal regions are sorted once.
    Shards from ``shards`` on have single windows, which are known by being equal."""
    place: dict[bytes, int] = {}
    places, ids = [], []
    for sizes, owners, data in zip(*(table.column(x).to_pylist()
                                     for x in ("sizes", "ids", "data"))):
        ends = np.cumsum(np.frombuffer(sizes, "<u4").astype(np.int64)).tolist()
        places.append(np.array([place.setdefault(data[a:b], len(place))
                                for a, b in zip([0, *ends], ends)], np.int64))
        ids.append(np.frombuffer(owners, "<i8"))
    own = np.full(len(place), np.iinfo(np.int64).max)
    for at, owners in zip(places, ids):
        np.minimum.at(own, at, owners)
    sizes = np.fromiter(map(len, place), np.int64, len(place))
    ends, windows = np.cumsum(sizes), sizes - length + 1
    shard, rows = table.column("shard")[0].as_py(), []
    least = own if shard >= shards else _least_ids(
        b"".join(place), _expanded(ends - sizes, windows), np.repeat(own, windows), length)
    begins = np.cumsum(windows) - windows
    for number, at in zip(table.column(_BLOCK).to_pylist(), places):
        mine = least[_expanded(begins[at], windows[at])]
        firsts = np.flatnonzero(np.r_[True, mine[1:] != mine[:-1]])
        rows.append((number, shard, np.diff(np.r_[firsts, len(mine)]).astype("<u4").tobytes(),
                     mine[firsts].astype("<i8").tobytes()))
    return _batch(_LEAST, rows)


def _marked(block: _Block, seen: pa.Table, least: pa.Table, key_shards: int,
            shards: int) -> np.ndarray:
    """The starts of windows that also start in a document with a smaller id."""
    first, counts, doc, shard = block.pieces(*_candidates(block, seen, key_shards), shards)
    regions, _, at, target = block.distinct(first, counts, doc, shard)
    if not len(first):
        return np.empty(0, np.int64)
    order = np.argsort(target, kind="stable")
    windows = np.array([len(x) - block.length + 1 for x in regions], np.int64)
    answers = {s: np.repeat(np.frombuffer(i, "<i8"), np.frombuffer(r, "<u4")) for s, r, i in zip(
        *(least.column(x).to_pylist() for x in ("shard", "runs", "ids")))}
    flat = np.concatenate([answers[s] for s in sorted(answers)])
    begins = np.empty(len(regions), np.int64)
    begins[order] = np.cumsum(windows[order]) - windows[order]
    owner = np.repeat(block.ids[doc], counts)
    places = _expanded(first, counts)
    return places[flat[_expanded(begins[at], counts)] < owner]


def _clean(table: pa.Table, seen: pa.Table, least: pa.Table, id_column: str, length: int,
           key_shards: int, shards: int, out: pa.Schema) -> pa.Table:
    if not len(table):
        return out.empty_table()
    block = _Block(table, id_column, length)
    starts = _marked(block, seen, least, key_shards, shards)
    steps = np.zeros(len(block.data) + 1, np.int8)
    steps[starts] += 1
    steps[starts + length] -= 1
    gone = np.cumsum(steps, dtype=np.int8)[:-1] > 0  # at most ``length`` at a place
    raw = np.frombuffer(block.data, np.uint8)
    as_text = "kept" not in out.names and "kept_sha256" not in out.names
    rows: dict[str, list] = {k: [] for k in ("n_bytes", "n_removed", "n_spans", "kept")}
    for a, b, text in zip(block.starts.tolist(), block.ends.tolist(), block.texts):
        mine = gone[a:b]
        removed = int(np.count_nonzero(mine))
        if as_text and removed:
            mine = _whole_characters(raw[a:b], mine)
        rows["n_bytes"].append(b - a)
        rows["n_removed"].append(removed)
        rows["n_spans"].append(
            int(mine[0]) + int(np.count_nonzero(mine[1:] > mine[:-1])) if removed else 0)
        rows["kept"].append(raw[a:b][~mine].tobytes() if removed else text)
    if "kept_sha256" in out.names:
        rows["kept_sha256"] = [hashlib.sha256(x).hexdigest() for x in rows.pop("kept")]
    if as_text:
        kept = rows.pop("kept")
        rows = {"text": [x.decode("utf-8", "replace") for x in kept]}
        if "n_chars" in out.names:
            rows["n_chars"] = [len(x) for x in rows["text"]]
    new = {k: pa.array(v, out.field(k).type) for k, v in rows.items()}
    if "text" in out.names and not as_text:
        new["text"] = block.table.column(_TEXT).cast(out.field("text").type, safe=False)
    return pa.table([new[f.name] if f.name in new else
                     block.table.column(f.name).cast(f.type) for f in out], schema=out)


def _whole_characters(raw: np.ndarray, gone: np.ndarray) -> np.ndarray:
    """Which bytes go if a character only goes with all its bytes."""
    starts = np.flatnonzero((raw & 0xC0) != 0x80)
    if not len(starts) or starts[0]:
        starts = np.r_[0, starts]
    whole = np.logical_and.reduceat(gone, starts)
    return np.repeat(whole, np.diff(np.r_[starts, len(raw)]))


def _split(table: pa.Table) -> tuple[pa.Table, pa.Table]:
    """Answers on keys and on regions, which come in one table."""
    is_key = pc.is_valid(table.column("seen"))
    return table.filter(is_key), table.filter(pc.invert(is_key))


def dedup(docs: DataFrame, length: int = LENGTH, digest: bool = False,
          keep: list[str] | None = None) -> DataFrame:
    """The columns of ``docs`` (or those to ``keep``) with n_bytes, n_removed, n_spans and kept (the bytes that stay),
    or with ``digest`` kept_sha256 in its place. ``length`` is from 32 to 127 bytes.
    """
    return _deduped(docs, length, docs.columns if keep is None else keep, [
        ("n_bytes", "long"), ("n_removed", "long"), ("n_spans", "long"),
        ("kept_sha256", "string") if digest else ("kept", "binary")])


def cleaned(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """The columns of ``docs`` with what stays of ``text``, and its ``n_chars`` if there is one.

    Characters of which some bytes stay, stay whole.
    """
    return _deduped(docs, length, docs.columns, [])


def _deduped(docs: DataFrame, length: int, keep: list[str],
             new: list[tuple[str, str]]) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema

    if not GRAM + 8 <= length < 128:
        raise ValueError(f"length must be from {GRAM + 8} to 127")
    spark = docs.sparkSession
    ship(spark)
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = total // BLOCK_BYTES + 1
    key_shards, shards = total // KEYS_BYTES + 1, total // SHARD_BYTES + 1
    most = SHARD_BYTES
    schema = T.StructType([docs.schema[x] for x in keep if x not in dict(new)])
    for name, kind in new:
        schema = schema.add(name, kind)
    out = to_arrow_schema(schema)

    others = [x for x in keep if x not in dict(new) and x not in ("text", "doc_id")]
    dealt = docs.select(
        F.col("doc_id"), *[docs[x] for x in others], F.col("text").cast("binary").alias(_TEXT),
        F.pmod(F.xxhash64(F.col("doc_id").cast("long"), "text"), F.lit(blocks)).alias(_BLOCK))
    # by id and text: least ids don't depend on the dealing, and rows that share an id (or have
    # none) spread over all blocks
    by_block = dealt.groupBy(_BLOCK)
    keys = by_block.applyInArrow(
        lambda t: _ask_keys(t, "doc_id", length, key_shards), _spark_schema(_KEYS))
    seen = keys.groupBy("shard").applyInArrow(
        lambda t: _answer_keys(t, most), _spark_schema(_SEEN))
    regions = by_block.cogroup(seen.groupBy(_BLOCK)).applyInArrow(
        lambda t, s: _ask_regions(t, s, "doc_id", length, key_shards, shards),
        _spark_schema(_REGIONS))

    def answer(table: pa.Table) -> pa.Table:
        done = _answer_regions(table, length, shards)
        released()
        return done

    least = regions.groupBy("shard").applyInArrow(answer, _spark_schema(_LEAST))
    answers = seen.unionByName(least, allowMissingColumns=True)

    def clean(block: pa.Table, answered: pa.Table) -> pa.Table:
        done = _clean(block, *_split(answered), "doc_id", length, key_shards, shards, out)
        released()
        return done

    return by_block.cogroup(answers.groupBy(_BLOCK)).applyInArrow(clean, schema)
