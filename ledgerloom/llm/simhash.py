"""SimHash fingerprints and their links by pivot distance tables.

A fingerprint has a bit where more than half of the document's shingle hashes have it.
Equal fingerprints are one node. Nodes that share the bits of some blocks meet in a group:
if two fingerprints differ in at most four bits, cutting them into more than four blocks
leaves all but four blocks alike, so every combination of that many blocks is one table of
groups. Within a group the Hamming distances to many reference fingerprints are computed
once; by the triangle inequality a pair whose distances to any reference differ by more than
the limit is discarded, and only survivors are compared bit by bit. A group gives the edges
of a spanning forest, not its pairs. Groups above a size are split into pairs of chunks.

Defined cases: a null or empty text has fingerprint zero; fewer words than a shingle are one
shingle; rows with a null or repeated doc_id are compared like any other, and a component
without any doc_id has none; an empty table gives no rows; other columns are not read.
``one_of_each`` keeps all rows without an id and all columns.
"""

from __future__ import annotations

import random
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import ship, stored, whole_text
from ledgerloom.llm.components import components

SHINGLE = 4
SEED = 42
MOST_BITS = 4
PIVOTS = 24
CHUNK = 4096
#: Members of a group that are compared with so many followers at once; larger groups walk.
NEXT = 8


def references(count: int = PIVOTS) -> np.ndarray:
    """Fixed reference fingerprints."""
    drawn = random.Random(SEED)
    return np.array([drawn.getrandbits(64) for _ in range(count)], "<u8")


def _majority(hashes: np.ndarray) -> int:
    """The bits that more than half of the hashes have."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 8192):
        bits = np.unpackbits(hashes[at:at + 8192].view(np.uint8).reshape(-1, 8), axis=1,
                             bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    set_bits = (2 * counts > len(hashes)).astype(np.uint8)
    return int(np.packbits(set_bits, bitorder="little").view("<u8")[0])


def shingle_hashes(text: str, words: int = SHINGLE) -> np.ndarray:
    """The hashes of a text's shingles, in their order."""
    from xxhash import xxh64_intdigest

    found = text.encode().lower().split()
    if not found:
        return np.empty(0, "<u8")
    joined = b" ".join(found)
    ends = list(accumulate((len(x) + 1 for x in found), initial=-1))
    if len(found) <= words:
        cuts = [joined]
    else:
        cuts = [joined[a + 1:b] for a, b in zip(ends, ends[words:])]
    return np.array([xxh64_intdigest(x, SEED) for x in cuts], "<u8")


def fingerprint(text: str, words: int = SHINGLE) -> int:
    """Unsigned 64-bit fingerprint of a text."""
    hashes = shingle_hashes(text, words)
    return _majority(hashes) if len(hashes) else 0


def fingerprints(docs: DataFrame, words: int = SHINGLE) -> DataFrame:
    """``doc_id`` and ``fp`` (a signed long)."""
    ship(docs.sparkSession)

    def made(batches):
        for batch in batches:
            fps = np.array([fingerprint(x, words) for x in batch.column(1).to_pylist()], "<u8")
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(fps.view("<i8"))], names=["doc_id", "fp"])

    texts = docs.select(F.col("doc_id").cast("long"), whole_text().alias("text"))
    return texts.mapInArrow(made, "doc_id long, fp long")


class _Links:
    """Which members of a group are linked: by their fingerprints' pivot distances, then bits."""

    def __init__(self, fps: np.ndarray, most: int):
        self.fps, self.most = fps, most
        self.table = np.bitwise_count(fps[:, None] ^ references()[None, :]).astype(np.int8)

    def alike(self, a, b: np.ndarray) -> np.ndarray:
        """Which of the places ``b`` are linked with ``a`` (one place, or one for each)."""
        kept = np.arange(len(b))
        first = a if np.isscalar(a) else a[kept]
        if len(b) > 64:  # most pairs leave by the first few distances
            near = np.abs(self.table[b, :4] - self.table[first, :4]) <= self.most
            kept = kept[near.all(axis=1)]
        first = a if np.isscalar(a) else a[kept]
        near = (np.abs(self.table[b[kept]] - self.table[first]) <= self.most).all(axis=1)
        kept = kept[near]
        first = a if np.isscalar(a) else a[kept]
        return kept[np.bitwise_count(self.fps[b[kept]] ^ self.fps[first]) <= self.most]

    def walk(self, members: np.ndarray) -> list[tuple[int, int]]:
        """Edges of a spanning forest of one group."""
        left, edges = members, []
        while len(left):
            queue, left = [int(left[0])], left[1:]
            while queue and len(left):
                at = queue.pop()
                near = self.alike(at, left)
                found = left[near].tolist()
                edges += [(at, x) for x in found]
                queue += found
                left = np.delete(left, near)
        return edges

    def edges(self, groups: np.ndarray) -> np.ndarray:
        """Pairs of linked places; ``groups`` is sorted. Small groups go pair by pair, at
        once for all of them."""
        firsts = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]])
        sizes = np.diff(np.r_[firsts, len(groups)])
        small = np.repeat(sizes <= NEXT + 1, sizes)
        found = [np.empty((0, 2), int)]
        for step in range(1, min(NEXT + 1, len(groups))):
            a = np.flatnonzero(small[:-step] & (groups[:-step] == groups[step:]))
            a = a[self.alike(a, a + step)]
            found.append(np.stack([a, a + step], axis=1))
        for first, size in zip(firsts[sizes > NEXT + 1], sizes[sizes > NEXT + 1]):
            edges = self.walk(np.arange(first, first + size))
            if edges:
                found.append(np.array(edges))
        return np.concatenate(found)


def _pairs(rows: np.ndarray, pairs: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(rows[pairs[:, 0], 2]), pa.array(rows[pairs[:, 1], 2])], names=["a", "b"])


def _solve(batches, most: int):
    """Edges of a spanning forest of each group; a partition's rows (group in two columns, node,
    fingerprint) come sorted by group, and a group, of at most two chunks, is carried over to
    the next batch until it ends."""
    def numbers(table: pa.Table, columns: int) -> np.ndarray:
        return np.stack([table.column(i).to_numpy() for i in range(columns)], axis=1)

    def edges(table: pa.Table):
        rows = numbers(table, 4)
        changes = (rows[1:, :2] != rows[:-1, :2]).any(axis=1)
        groups = np.r_[0, np.cumsum(changes)]
        yield _pairs(rows, _Links(rows[:, 3].astype("<u8"), most).edges(groups))

    rest = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if rest is None else pa.concat_tables([rest, table])
        if not len(table):
            continue
        rows = numbers(table, 2)
        last = np.flatnonzero((rows != rows[-1]).any(axis=1))
        cut = last[-1] + 1 if len(last) else 0
        rest = table.slice(cut)
        if cut:
            yield from edges(table.slice(0, cut))
    if rest is not None and len(rest):
        yield from edges(rest)


def blocks_for(nodes: int, most: int = MOST_BITS) -> int:
    """Blocks, so that a table of all other blocks' bits has more places than nodes."""
    blocks = most + 1
    while blocks < 2 * most + 4 and 2 ** (64 * (blocks - most) // blocks) < nodes:
        blocks += 1
    return blocks


def _table_keys(blocks: int, most: int) -> list[Column]:
    """The kept bits of every table, hashed with the table's number."""
    bounds = [64 * i // blocks for i in range(blocks + 1)]
    masks = [sum(1 << bit for bit in range(a, b)) for a, b in zip(bounds, bounds[1:])]
    keys = []
    for number, kept in enumerate(combinations(masks, blocks - most)):
        mask = sum(kept)
        signed = mask - (1 << 64) if mask >> 63 else mask
        keys.append(F.xxhash64(F.lit(number), F.col("fp").bitwiseAND(F.lit(signed))))
    return keys


def links(nodes: DataFrame, most: int = MOST_BITS) -> DataFrame:
    """Edges ``a``, ``b`` that join all linked nodes, given ``node`` and ``fp``."""
    keys = _table_keys(blocks_for(nodes.count(), most), most)
    zero = F.lit(0).cast("long")
    entries = nodes.select(F.explode(F.array(*keys)).alias("key"), "node", "fp")
    ship(nodes.sparkSession)
    sizes = entries.groupBy("key").agg(F.count("*").alias("count")).where("count > 1")
    members = (
        entries.join(sizes, "key")
        .withColumn("chunks", F.ceil(F.col("count") / CHUNK))
        .withColumn("own", F.pmod(F.xxhash64("node"), "chunks"))
        # a member meets its own chunk and every other: once per unordered pair of chunks
        .withColumn("other", F.explode(F.expr("sequence(0L, chunks - 1)")))
        .select("key", (F.least("own", "other") * F.col("chunks") + F.greatest("own", "other"))
                .alias("pair"), "node", "fp")
    )
    dealt = members.repartition("key", "pair").sortWithinPartitions("key", "pair", "node")
    return dealt.mapInArrow(lambda batches: _solve(batches, most), "a long, b long")


def near_duplicates(docs: DataFrame, words: int = SHINGLE, most: int = MOST_BITS) -> DataFrame:
    """``doc_id``, ``fp`` and ``component_id``, the least doc_id that links lead to."""
    found = stored(fingerprints(docs, words), "fingerprints")
    nodes = stored(found.groupBy("fp").agg(F.min("doc_id").alias("least"))
                   .withColumn("node", F.col("fp")), "nodes")
    roots = components(links(nodes, most))
    nodes = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = nodes.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = nodes.join(least, "root").select("fp", "component_id")
    return found.join(by_fp, "fp").select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, words: int = SHINGLE, most: int = MOST_BITS) -> DataFrame:
    """One document of each component, the one of the least id (then of the least text hash).

    Rows without an id stay. Rows that repeat an id are documents of their own, unless their
    texts are the same.
    """
    key = "_" + max(docs.columns, key=len)  # no other column's name
    keyed = docs.where("doc_id IS NOT NULL").withColumn(key, F.xxhash64("doc_id", "text"))
    rows = keyed.select(F.col(key).alias("doc_id"), "text")
    groups = near_duplicates(rows, words, most).select(
        F.col("doc_id").alias(key), F.col("component_id").alias("_group")).distinct()
    first = (keyed.select("doc_id", key).distinct().join(groups, key)
             .groupBy("_group").agg(F.min(F.struct("doc_id", key)).alias("_first"))
             .select(F.col("_first.doc_id").alias("doc_id"), F.col(f"_first.{key}").alias(key)))
    kept = keyed.join(first, ["doc_id", key], "left_semi").dropDuplicates(["doc_id", key])
    return kept.select(*docs.columns).unionByName(docs.where("doc_id IS NULL"))
