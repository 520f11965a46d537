import math

import numpy as np
import pytest

import __spark_entry__ as entry
from checks.compare import difference, duckdb_over
from ledgerloom.llm import topk
from pyspark.sql import functions as F
from tests.conftest import SMALL
from tests.llm.helpers import clashing

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, every, k=5):
    valid = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows
             if i is not None and v is not None
             and all(x is not None and math.isfinite(x) for x in v)]
    queries = {}
    for i, v in valid:
        if i % every == 0:
            queries[i] = min(queries.get(i, v), v)
    out = []
    for i, q in queries.items():
        scores = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in valid
                        if j != i and len(v) == len(q))
        out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(scores[:k])]
    return sorted(out)


def got(df, every, **options):
    found = topk.top_k(df, F.col("vec_id") % every == 0, **options)
    return sorted(tuple(r) for r in found.collect())


def test_equals_oracle(spark):
    name = "op10_exact_top_k_search"
    assert difference(entry.queries()[name](spark, SMALL), duckdb_over(SMALL),
                      entry.oracle_sql()[name]) is None


def test_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, -0.5]), (1, [1.0, 0.5]), (2, None), (3, [nan, 1.0]), (4, [inf, 0.0]),
            (5, [None, 1.0]), (6, [1.0, 0.5]), (7, [1.0]), (10, [0.0, 0.0]), (10, [0.25, 0.0]),
            (None, [1.0, 1.0]), (20, []), (30, [9.0, 9.0, 9.0])]
    df = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA)
    assert got(clashing(df, "id", "vector", "block", "score"), 10) == plain(rows, 10)
    assert got(df.limit(0), 10) == []
    assert got(df.where("vec_id = 0"), 10) == []


def test_pruning_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(topk, "CANDIDATES", 700)
    monkeypatch.setattr(topk, "QUERIES", 30)
    drawn = np.random.default_rng(1)
    rows = [(i, drawn.normal(size=12).round(1).tolist()) for i in range(2000)]
    df = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA)
    assert got(df, 20, k=7) == plain(rows, 20, 7)


@pytest.mark.parametrize("size", [8, 60, 500, 3000])
def test_bounds_decide_at_every_size(size, monkeypatch):
    drawn = np.random.default_rng(size)
    vectors = (drawn.normal(size=(size, 64)) * 30).astype(np.int64)
    lists, reads = topk.Lists(np.arange(size), vectors), []
    read = topk._Bounds.read
    monkeypatch.setattr(topk._Bounds, "read",
                        lambda self, a, b: reads.append((a, b)) or read(self, a, b))
    for own in range(0, size, max(1, size // 8)):
        reads.clear()
        at, scores = lists.best(vectors[own], own, 5)
        every = vectors @ vectors[own]
        expected = [i for i in np.lexsort((np.arange(size), -every)) if i != own][:5]
        assert at.tolist() == expected and scores.tolist() == every[expected].tolist()
        assert reads and reads[0][0] == 0
        assert all(a[1] == b[0] for a, b in zip(reads, reads[1:]))  # sequentially


def test_bounds_hold_while_reading():
    drawn = np.random.default_rng(6)
    vectors = drawn.integers(-40, 40, (200, 9))
    lists, query = topk.Lists(np.arange(200), vectors), drawn.integers(-40, 40, 9)
    bounds, exact = topk._Bounds(lists, query), vectors @ query
    for at in range(0, 200, 13):
        bounds.read(at, min(at + 13, 200))
        lower, upper = bounds.of(np.arange(200))
        assert (lower <= exact).all() and (exact <= upper).all()
    assert (lower == exact).all() and (upper == exact).all()


def test_reading_stops_early_where_scores_are_far_apart(monkeypatch):
    vectors = np.zeros((4000, 6), np.int64)
    vectors[:, 0] = np.arange(4000)
    lists, reads = topk.Lists(np.arange(4000), vectors), []
    read = topk._Bounds.read
    monkeypatch.setattr(topk._Bounds, "read",
                        lambda self, a, b: reads.append(b) or read(self, a, b))
    at, _ = lists.best(np.array([3, 0, 0, 0, 0, 0]), 3999, 5)
    assert at.tolist() == [3998, 3997, 3996, 3995, 3994] and reads[-1] < 4000


def test_great_numbers_are_exact():
    vectors = np.array([[1 << 28, 1], [(1 << 28) - 1, 1 << 28], [1 << 28, 2]])
    lists = topk.Lists(np.arange(3), vectors)
    at, scores = lists.best(np.array([1 << 28, 1]), -1, 2)
    assert at.tolist() == [2, 0] and scores.tolist() == [(1 << 56) + 2, (1 << 56) + 1]


def test_more_leaders_than_candidates():
    drawn = np.random.default_rng(2)
    lists = topk.Lists(np.arange(3000), drawn.integers(-50, 50, (3000, 6)))
    query = lists.vectors[0]
    at, scores = lists.best(query, 0, 900)
    every = lists.vectors @ query
    expected = [i for i in np.lexsort((np.arange(3000), -every)) if i][:900]
    assert at.tolist() == expected and scores.tolist() == every[expected].tolist()
