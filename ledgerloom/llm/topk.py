"""Exact top-k inner products by no-random-access aggregation.

The candidates are dealt into blocks, the queries into blocks, and every pair of blocks is
one task's group, whose lists are the block's vectors sorted by each component. The lists are
read sequentially, a stretch of each at a time, for all queries of the group side by side, from
both ends: a query takes the end that its component's sign favours. What was read of a candidate
is its partial score (for all candidates and queries one matrix product of what was read and
the queries, while many candidates are left); its upper bound adds the last
read value of every list in which it has not been seen, its lower bound those lists' least
values. Candidates whose upper bound is below the k-th lower bound leave, those seen nowhere
included, and reading stops when no outsider can qualify any more (or at the lists' ends, if
scores tie). Then the scores of those that are left are resolved.

Defined cases: vectors that are null, or hold null or non-finite components, take no part;
a query without other candidates gives no rows; ties go to the smaller id; a vector whose
length differs from a query's is not its candidate; a null id takes no part; rows that repeat
an id are candidates each (never for their own id) and one query, with the least vector;
an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import ship

K = 5
CANDIDATES = 8192
QUERIES = 512
#: Stretches in which a list is read.
STRETCHES = 16
#: Whole numbers below these are exact as floats and as doubles.
SINGLE, DOUBLE = 1 << 24, 1 << 53
#: Queries with at most this share of the candidates left are followed one by one.
FEW = 8

_ROWS = "query_id long, vec_id long, score long"


def quantized(vector: Column, scale: int = 256) -> Column:
    """Components as floor(scale * x) in double precision; null if any is null or not finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x)
                   | (F.abs(x.cast("double")) == float("inf")))
    return F.when(~bad, F.transform(
        vector, lambda x: F.floor(x.cast("double") * scale).cast("long")))


class Lists:
    """The vectors of a block and, for each component, a list sorted by it."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        # as rows of components, ascending and, for negative weights, read from the front
        self.order = np.argsort(self.vectors.T, axis=1, kind="stable")
        self.values = np.take_along_axis(self.vectors.T, self.order, axis=1)
        self.most = int(np.abs(self.vectors).max(initial=0))

    def best(self, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of the k best, ties to smaller ids, without the query's own."""
        return self.best_of(query[None, :], np.array([own]), k)[0]

    def best_of(self, queries: np.ndarray, owns: np.ndarray,
                k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """The same for each of several queries."""
        n = len(self.ids)
        bounds, alive = _Bounds(self, queries), self.ids[None, :] != owns[:, None]
        many = np.flatnonzero(alive.sum(axis=1) > k)
        few: dict[int, np.ndarray] = {}
        step = max(1, -(-n // STRETCHES))
        for at in range(0, n, step):
            if not len(many) and all(len(places) <= k for places in few.values()):
                break
            bounds.read(at, min(at + step, n))
            for query, places in few.items():
                if len(places) > k:
                    lower, upper = bounds.of(places, query)
                    few[query] = places[upper >= np.partition(lower, -k)[-k]]
            if len(many):
                lower, upper = bounds.of(slice(None), many)
                lower[~alive[many]] = lower.min() - 1  # less than that of any outsider
                bar = np.partition(lower, n - k, axis=1)[:, n - k]
                alive[many] &= upper >= bar[:, None]
                left = alive[many].sum(axis=1) <= max(k, n // FEW)
                few |= {query: np.flatnonzero(alive[query]) for query in many[left]}
                many = many[~left]
        return [self._resolved(few.get(i, np.flatnonzero(alive[i])), query, k)
                for i, query in enumerate(queries)]

    def _resolved(self, places: np.ndarray, query: np.ndarray,
                  k: int) -> tuple[np.ndarray, np.ndarray]:
        scores = self.vectors[places] @ query
        first = np.lexsort((places, -scores))[:k]
        return places[first], scores[first]


class _Bounds:
    """What queries have read of the lists.

    Rows are candidates. Columns come twice, for lists read from their greatest values (weights
    above zero) and from their least: the values read so far, and ones for what is unread.
    """

    def __init__(self, lists: Lists, queries: np.ndarray):
        queries = np.atleast_2d(queries)
        sums = lists.most * int(np.abs(queries).sum(axis=1).max(initial=0))
        kind = (np.float32 if 2 * sums < SINGLE else float if 2 * sums < DOUBLE else np.int64)
        self.order, self.values = lists.order, lists.values
        n, d = len(lists.ids), queries.shape[1]
        self.weights = np.hstack([np.maximum(queries, 0), np.minimum(queries, 0)]).astype(kind)
        self.read_values, self.unread = np.zeros((n, 2 * d), kind), np.ones((n, 2 * d), kind)
        self.least = self._ends(0, n - 1)
        self.gap = np.zeros_like(self.least)

    def _ends(self, down: int, up: int) -> np.ndarray:
        """The queries' products with what stands at these places of the lists."""
        return np.r_[self.values[:, down], self.values[:, up]].astype(
            self.weights.dtype) * self.weights

    def read(self, start: int, end: int) -> None:
        """Go on reading all lists, from one place to another."""
        d, n = self.order.shape
        lists = np.arange(d)[:, None]
        for part, column in ((slice(n - end, n - start), lists), (slice(start, end), lists + d)):
            rows = self.order[:, part]
            self.read_values[rows, column] = self.values[:, part]
            self.unread[rows, column] = 0
        self.gap = self._ends(n - end, end - 1) - self.least

    def of(self, places, queries=0) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of the candidates there, for one or several queries."""
        unread = self.unread[places].T
        lower = self.weights[queries] @ self.read_values[places].T + self.least[queries] @ unread
        return lower, lower + self.gap[queries] @ unread


def _search(table: pa.Table, k: int) -> pa.Table:
    """One group: the candidates of a block and the queries of a block."""
    is_query = np.array(table.column("is_query"))
    ids = np.array(table.column("id"), np.int64)
    sizes = np.array(pa.compute.list_value_length(table.column("vector")))
    found: tuple[list, list, list] = ([], [], [])
    for size in np.unique(sizes[is_query]):
        rows = np.flatnonzero(sizes == size)
        part = table.column("vector").take(pa.array(rows)).combine_chunks()
        vectors = np.array(part.flatten(), np.int64).reshape(len(rows), size)
        asked = is_query[rows]
        if asked.all():
            continue
        lists = Lists(ids[rows][~asked], vectors[~asked])
        owns, queries = ids[rows][asked], vectors[asked]
        for own, (at, scores) in zip(owns, lists.best_of(queries, owns, k)):
            for column, values in zip(found, (np.full(len(at), own), lists.ids[at], scores)):
                column.append(values)
    names = ("query_id", "vec_id", "score")
    return pa.table({n: np.concatenate(c) if c else np.empty(0, np.int64)
                     for n, c in zip(names, found)})


def top_k(vectors: DataFrame, queries: Column, k: int = K, id_column: str = "vec_id",
          vector_column: str = "embedding") -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id``, ``score`` for the rows that ``queries`` selects."""
    ship(vectors.sparkSession)
    valid = (
        vectors.select(F.col(id_column).cast("long").alias("id"), queries.alias("asked"),
                       quantized(F.col(vector_column)).alias("vector"))
        .where("id IS NOT NULL AND vector IS NOT NULL")
    )
    candidates = valid.select("id", "vector")
    asking = valid.where("asked").groupBy("id").agg(F.min("vector").alias("vector"))
    rows, asked = valid.agg(F.count("*"), F.count_if("asked")).first()
    blocks, query_blocks = -(-rows // CANDIDATES) or 1, -(-asked // QUERIES) or 1

    def dealt(df: DataFrame, own: str, own_blocks: int, other: str, others: int) -> DataFrame:
        """Every row to the pairs of its own block with each of the other side's."""
        return (df.withColumn(own, F.pmod(F.xxhash64("id"), F.lit(own_blocks)))
                .withColumn(other, F.explode(F.expr(f"sequence(0L, {others - 1}L)")))
                .select("block", "query_block", F.lit(own == "query_block").alias("is_query"),
                        "id", "vector"))

    both = dealt(candidates, "block", blocks, "query_block", query_blocks).unionByName(
        dealt(asking, "query_block", query_blocks, "block", blocks))
    found = both.groupBy("block", "query_block").applyInArrow(lambda t: _search(t, k), _ROWS)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
