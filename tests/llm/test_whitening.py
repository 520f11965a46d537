import math

import numpy as np
import pytest

import __spark_entry__ as entry
from ledgerloom.llm import whitening
from tests.conftest import SMALL
from tests.llm.helpers import clashing, sample

SCHEMA = "vec_id long, embedding array<double>, label int"


def expected(rows, components=16):
    """By the whole covariance: {vec_id: [(component, n, deviation, |whitened|, explained)]}."""
    x = {}
    for at, (_, v) in enumerate(rows):
        if v and all(c is not None and math.isfinite(c) for c in v):
            x[at] = [math.floor(64 * float(c)) + 1_000_000 for c in v]
    out = {}
    for dims in {len(v) for v in x.values()}:
        own = {at: v for at, v in x.items() if len(v) == dims}
        distinct = sorted({tuple(v) for v in own.values()})
        n, sums = len(distinct), [sum(c) for c in zip(*distinct)]
        centred = np.array([[n * a - s for a, s in zip(v, sums)] for v in distinct], float) / n
        values, vectors = np.linalg.eigh(centred.T @ centred / n)
        values, vectors = values[::-1], vectors[:, ::-1]
        kept = [i for i in range(min(components, dims)) if values[i] > 1e-9 * values[0]]
        for at, v in own.items():
            near = np.array([n * a - s for a, s in zip(v, sums)], float) / n
            white = np.abs(near @ vectors[:, kept] / np.sqrt(values[kept]))
            out[at] = (n, sum((n * a - s) ** 2 for a, s in zip(v, sums)), white,
                       values[kept] / values.sum())
    return out


def check(spark, rows, df=None, components=16, near=1e-9):
    df = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA) if df is None else df
    found = {}
    for r in whitening.whiten(df, components=components).collect():
        found.setdefault(r.vec_id, []).append(r)
    want = expected(rows, components)
    assert sum(len(x) for x in found.values()) == sum(len(x[2]) for x in want.values())
    for at, (n, deviation, white, shares) in want.items():
        got = sorted((r for r in found.get(rows[at][0], []) if r.dims == len(rows[at][1])),
                     key=lambda r: r.component)
        repeats = sum(r[0] == rows[at][0] for r in rows)
        if repeats > 1:  # an id with several vectors: only counted
            continue
        assert [r.component for r in got] == list(range(1, len(white) + 1))
        assert all(r.n == n and int(r.deviation) == deviation for r in got)
        assert np.allclose([abs(r.whitened) for r in got], white, rtol=near, atol=near)
        assert np.allclose([r.explained for r in got], shares, rtol=1e-10)
        assert all(r.identity_error < 1e-9 for r in got)


@pytest.mark.parametrize("spread", [1.0, 30.0])
def test_equals_whole_covariance(spark, spread):
    drawn = np.random.default_rng(3)
    scale = np.linspace(3, 1, 40) * spread
    rows = [(i, (drawn.normal(size=40) * scale + 5000).tolist()) for i in range(3000)]
    check(spark, rows)


def test_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    drawn = np.random.default_rng(5)
    rows = [(i, drawn.normal(size=3).tolist()) for i in range(60)]
    rows += [(100, None), (101, [nan, 1.0, 2.0]), (102, [inf, 0.0, 1.0]), (103, [None, 1.0, 2.0]),
             (104, []), (105, rows[0][1]), (None, [0.5, 0.25, 4.0]), (106, [1.0, 2.0]),
             (107, [3.0, -1.0]), (108, [2.0, 7.0]), (109, [7.0] * 5)]
    rows += [(110, rows[1][1])] * 40  # one vector in a third of all rows
    df = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA)
    check(spark, rows, clashing(df, "x", "dims", "white", "n"))
    assert whitening.whiten(df.limit(0)).count() == 0
    assert whitening.whiten(df.where("vec_id = 109")).count() == 0


def test_exact_deviation_beyond_64_bits(spark):
    rows = [(i, [float(i % 7) * 2.0**30, float(i)]) for i in range(50)]
    check(spark, rows)
    assert max(x[1] for x in expected(rows).values()) > 1 << 63


@pytest.mark.parametrize("dims, spectrum", [
    (300, np.linspace(3, 1, 300)), (64, np.ones(64)), (200, 1 / np.arange(1, 201)),
    (32, np.r_[1e8, 1, np.full(30, 1e-8)]), (5, np.ones(5)), (1, np.ones(1))])
def test_solver(dims, spectrum):
    turn = np.linalg.qr(np.random.default_rng(1).standard_normal((dims, dims)))[0]
    matrix = (turn * spectrum) @ turn.T
    matrix = (matrix + matrix.T) / 2
    used = []
    values, vectors = whitening.eigenpairs(lambda w: used.append(w.shape) or matrix @ w, dims, 16)
    best = np.sort(spectrum)[::-1][:16]
    assert np.allclose(values, best, rtol=0, atol=1e-13 * best[0] * dims)
    assert np.abs(matrix @ vectors - vectors * values).max() <= 1e-13 * best[0]
    assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-13


def test_minres_solves_the_projected_equation():
    drawn = np.random.default_rng(2)
    matrix = np.diag(np.arange(1.0, 31.0))
    away = np.linalg.qr(drawn.standard_normal((30, 4)))[0]
    theta, residuals = np.array([28.3, 27.1]), drawn.standard_normal((30, 2))
    found = whitening.corrections(lambda w: matrix @ w, theta, residuals, away, 60)
    inside = np.eye(30) - away @ away.T
    for j in range(2):
        solved = inside @ (matrix @ found[:, j] - theta[j] * found[:, j])
        assert np.allclose(solved, -inside @ residuals[:, j], atol=1e-8)
        assert np.allclose(away.T @ found[:, j], 0, atol=1e-10)


def test_query(spark):
    found = entry.queries()["op13_embedding_whitening"](spark, SMALL).collect()
    rows = sample(SMALL, "vec_id, embedding", "embeddings")
    want = expected([(i, [float(c) for c in v]) for i, v in rows])
    assert len(found) == 16 * len(want)
    by_id = {i: want[at] for at, (i, _) in enumerate(rows) if at in want}
    for r in found:
        n, deviation, white, shares = by_id[r.vec_id]
        assert (r.n, r.deviation) == (n, deviation)
        assert abs(abs(r.whitened) - white[r.component - 1]) < 1e-9
        assert abs(r.explained / shares[r.component - 1] - 1) < 1e-10 and r.identity_error < 1e-4
