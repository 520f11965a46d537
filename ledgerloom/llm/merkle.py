"""Merkle manifest of a dataset: a root, and a proof for every row, with few stored levels.

Every row is hashed to a leaf. The leaves of a source, in order, make a tree in which runs of
FAN nodes become their hash, and the roots of the sources make one more. Only every STRIDE-th
level is written. A proof is extracted from the top down: the nodes of an aligned subtree
(FAN ** STRIDE stored descendants of one stored node) meet in one group, which regenerates the
levels between, gives every descendant its siblings there followed by those of the subtree's
own top, and drops the regenerated nodes. Proofs of rows are folded where they arise; only those
of stored inner nodes, one for FAN ** STRIDE rows, are shuffled.

Leaves get their place in the source from one range sort of digests, whatever the sizes of
sources: a source spans many partitions, and a small table tells how many of its leaves stand
in earlier ones. No text is moved; only built-in functions are used.

Defined cases: fields that are null are ``-`` in a leaf; rows without a source are a source, the
first; within a source, rows without an id come first, and rows with the same id in the order
of their leaves (equal rows are interchangeable); a source of one row has the leaf as its root;
rows without an id are never changed by ``lower_cased``; an empty table has no root and gives
no rows; columns other than the hashed fields are not read.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import stored

FAN_BITS = 4
FAN = 1 << FAN_BITS
#: Levels from one stored level to the next.
STRIDE = 2
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_SIBLINGS = "array<struct<left: string, right: string>>"


def hashed(*values: Column) -> Column:
    """Lowercase hex sha256 of the concatenated strings."""
    return F.sha2(F.concat(*values), 256)


def leaf(fields: list[Column]) -> Column:
    """The hash of a row: each field with its length in bytes before it."""
    def framed(value: Column) -> Column:
        text = value.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text),
                          F.lit("-"))

    return hashed(*[framed(x) for x in fields])


def lower_cased(docs: DataFrame, every: int = 5) -> Column:
    """The leaf after tampering: A-Z of the text lower-cased in the rows that a checksum picks."""
    chosen = F.crc32(docs["doc_id"].cast("string").cast("binary")) % every == 0
    text = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(chosen, leaf([*[docs[x] for x in FIELDS[:-1]], text]))


def placed(rows: DataFrame, tree: str, order: list[str]) -> DataFrame:
    """``rows`` with ``pos``, their place (from 0) in the order of their tree, and its size ``n``."""
    part = F.shiftright("place", 33)
    tied = stored(rows.withColumn("tie", F.monotonically_increasing_id()), "leaves")
    keys = [tree, *order, "tie"]
    # numbered within the partitions of a range sort, then stored: sampling is not repeated
    ranged = stored(tied.repartitionByRange(*keys).sortWithinPartitions(*keys)
                    .drop("tie").withColumn("place", F.monotonically_increasing_id()), "ordered")
    runs = ranged.groupBy(F.col(tree).alias("_tree"), part.alias("_part")).agg(
        F.min("place").alias("first"), F.count("*").alias("rows"))
    of_tree = Window.partitionBy("_tree")
    earlier = of_tree.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("_tree", "_part", F.sum("rows").over(of_tree).alias("n"),
                       (F.coalesce(F.sum("rows").over(earlier), F.lit(0)) - F.col("first"))
                       .alias("shift"))
    same = ranged[tree].eqNullSafe(runs["_tree"]) & (part == runs["_part"])
    return ranged.join(runs, same).withColumn("pos", F.col("place") + F.col("shift")) \
        .drop("_tree", "_part", "place", "shift")


def _parents(nodes: Column) -> Column:
    """The hashes of runs of nodes."""
    last = F.floor((F.size(nodes) - 1) / FAN).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.sha2(
        F.array_join(F.slice(nodes, i * FAN + 1, F.lit(FAN)), ""), 256))


def _subtrees(level: DataFrame, kept: tuple[str, ...] = ()) -> DataFrame:
    """The aligned subtrees over a stored level, with all their nodes regenerated."""
    block = F.shiftright("pos", FAN_BITS * STRIDE).alias("block")
    members = F.array_sort(F.collect_list(F.struct("pos", "digest", *kept)))
    trees = level.where("n > 1").groupBy("tree", "n", block).agg(members.alias("members"))
    trees = trees.withColumn("level0", F.transform("members", lambda x: x["digest"]))
    for i in range(STRIDE):
        trees = trees.withColumn(f"level{i + 1}", _parents(F.col(f"level{i}")))
    return trees


def levels(leaves: DataFrame) -> list[DataFrame]:
    """The stored levels (``tree``, ``pos``, ``digest``, ``n``) over the leaves, the leaves first.

    Trees that have come to one node are not on later levels.
    """
    made = [leaves]
    width = leaves.agg(F.max("n")).first()[0] or 0
    while width > 1:
        # the only node of the first level that has one
        tops = [F.when(F.col("n") <= FAN ** (i + 1), F.col(f"level{i + 1}")[0])
                for i in range(STRIDE)]
        above = _subtrees(made[-1]).select(
            "tree", F.col("block").alias("pos"),
            F.coalesce(*tops, F.col(f"level{STRIDE}")[0]).alias("digest"),
            F.ceil(F.col("n") / FAN ** STRIDE).alias("n"))
        made.append(stored(above, "level"))
        width = -(-width // FAN ** STRIDE)
    return made


def _siblings(at: Column) -> Column:
    """Siblings of a subtree's descendant on its regenerated levels, from the bottom up."""
    steps = []
    for i in range(STRIDE):
        node = F.shiftright(at, FAN_BITS * i)
        within = node % FAN
        nodes = F.slice(F.col(f"level{i}"), node - within + 1, F.lit(FAN))
        steps.append(F.when(F.col("n") > FAN ** i, F.struct(
            F.array_join(F.slice(nodes, F.lit(1), within), "").alias("left"),
            F.array_join(F.slice(nodes, within + 2, F.lit(FAN)), "").alias("right"))))
    return F.array_compact(F.array(*steps))


def extracted(made: list[DataFrame], tops: DataFrame | None, kept: tuple[str, ...],
              result: Callable[[Column, Column], Column]) -> DataFrame:
    """``tree``, the columns of ``tops``, and ``result(leaf, path)`` of every leaf.

    A leaf is a struct of ``digest`` and the ``kept`` columns; a path is an array of siblings.
    ``tops`` gives each ``tree`` its ``path`` above its root (nothing is above, unless given).
    """
    names = [x for x in tops.columns if x not in ("tree", "path")] if tops else []
    tops = tops and tops.withColumnRenamed("tree", "_tree")
    above = None
    for number, level in reversed(list(enumerate(made))):
        payload, made_of = (kept, result) if number == 0 else ((), lambda x, path: F.struct(
            x["pos"].alias("pos"), path.alias("path")))
        item = F.struct("pos", "digest", *payload)
        own = level.where("n = 1")
        if tops is None:
            own = own.withColumn("path", F.array().cast(_SIBLINGS))
        else:
            own = own.join(tops, own["tree"].eqNullSafe(tops["_tree"]))
        found = own.select(
            "tree", *names, made_of(item, F.col("path")).alias("made"))
        if above is not None:
            trees, top = _subtrees(level, payload), above.withColumnRenamed("tree", "_tree")
            inside = trees.join(top, trees["tree"].eqNullSafe(top["_tree"])
                                & (trees["block"] == top["pos"]))
            each = F.transform("members", lambda x, at: made_of(
                x, F.concat(_siblings(at), F.col("path"))))
            found = found.unionByName(inside.select("tree", *names, F.explode(each).alias("made")))
        above = found.select("tree", *names, "made.*") if number else found
    return above


def joined(path: Column) -> Column:
    """All siblings of a path, one after another."""
    return F.array_join(F.transform(path, lambda x: F.concat(x["left"], x["right"])), "")


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf and its siblings lead to."""
    return F.aggregate(path, start, lambda acc, x: hashed(x["left"], acc, x["right"]))


@dataclass(frozen=True)
class Manifest:
    """The stored levels of the sources' trees and of the tree above them, and the root."""

    sources: list[DataFrame]
    top: list[DataFrame]
    root: str | None


def build(docs: DataFrame, **kept: Column) -> Manifest:
    """Hash all rows. ``kept`` columns stay beside the leaves for ``proofs``."""
    leaves = docs.select("doc_id", F.col("source").cast("string").alias("tree"),
                         leaf([docs[x] for x in FIELDS]).alias("digest"),
                         *[column.alias(name) for name, column in kept.items()])
    ordered = placed(leaves, "tree", ["doc_id", "digest"])
    sources = levels(stored(ordered, "level"))
    roots = sources[0].where("n = 1").select("tree", "digest")
    for level in sources[1:]:
        roots = roots.unionByName(level.where("n = 1").select("tree", "digest"))
    first = placed(roots.select(F.lit("").alias("over"), F.col("tree").alias("source"), "digest"),
                   "over", ["source"]).withColumnRenamed("over", "tree")
    top = levels(stored(first, "level"))
    root = top[-1].where("n = 1").first()
    return Manifest(sources, top, root and root["digest"])


def proofs(manifest: Manifest, start: Callable[[Column], Column] | None = None,
           kept: tuple[str, ...] = (), siblings: bool = False) -> DataFrame:
    """The proof of every row, folded from its leaf or from what ``start`` makes of the row.

    Columns: ``doc_id``, ``leaf``, the ``kept`` ones, ``subroot``, ``root``, ``proof_sha256``,
    ``folded_root``, ``verified``, and on request the ``siblings`` themselves.
    """
    over = extracted(manifest.top, None, ("source",),
                     lambda x, path: F.struct(x["source"].alias("source"), path.alias("path"),
                                              x["digest"].alias("subroot")))
    tops = over.select(F.col("made.source").alias("tree"), "made.path", "made.subroot")

    def proof(x: Column, path: Column) -> Column:
        first = start(x) if start else x["digest"]
        parts = [x["doc_id"].alias("doc_id"), x["digest"].alias("leaf"),
                 *[x[name].alias(name) for name in kept],
                 F.sha2(joined(path), 256).alias("proof_sha256"),
                 folded(first, path).alias("folded_root")]
        return F.struct(*parts, *([path.alias("siblings")] if siblings else []))

    found = extracted(manifest.sources, tops, ("doc_id", *kept), proof)
    return found.select("subroot", "made.*", F.lit(manifest.root).alias("root"),
                        (F.col("made.folded_root") == F.lit(manifest.root)).alias("verified"))
