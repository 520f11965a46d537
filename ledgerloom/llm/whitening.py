"""Whitening of embeddings by the leading eigenvectors of their covariance (Jacobi-Davidson).

The covariance is never formed. What the solver needs are products of it with a few vectors;
each is one Spark job over the distinct vectors, which are stored in blocks: a task centres its
rows, multiplies, and returns one small partial product, and the driver adds these in the
order of partitions. The driver holds the search subspace only (vectors of the embedding's
length, a fixed multiple of the components).

Each round takes the Ritz pairs of the subspace, locks the leading ones whose residual is at
rounding, and solves for every other wanted pair the projected correction equation
``(I - QQ')(A - theta I)(I - QQ') t = -r`` by a few steps of MINRES, all pairs in step, so that a
step is one product. The corrections extend the subspace, which restarts from its leading Ritz
vectors when it is full.

Centring is exact: entries are integers, their sums are, too, and only the quotient by the
number of vectors is rounded.

Defined cases: rows whose vector is null, empty, or holds an entry that is null, not finite, or
of 2 ** 46 or more take no part; vectors of different lengths are fitted and whitened among
themselves; repeated rows count once in the fit and are whitened each; a null id stays null;
directions without variance (in particular all, if there is one distinct vector) are no
components; there are no more components than dimensions; deviations have 38 digits; an empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import ship, stored

COMPONENTS = 16
SCALE, SHIFT = 64, 1_000_000
#: Entries of a block, and steps of MINRES for a correction.
BLOCK = 1 << 18
STEPS = 5
#: Ritz pairs followed beyond the wanted ones, size of the subspace by components, rounds.
GUARD = 4
SUBSPACE = 6
ROUNDS = 200

EPS = float(np.finfo(float).eps)


def quantized(vector: Column) -> Column:
    """Entries as floor(SCALE * x) + SHIFT; null if one is null, not finite, or too large."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x)
                   | (F.abs(x.cast("double")) >= float(1 << 46)))
    return F.when(~bad & (F.size(vector) > 0), F.transform(
        vector, lambda x: F.floor(x.cast("double") * SCALE).cast("long") + SHIFT))


def _matrices(batch: pa.RecordBatch, column: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The rows of each vector length, and their vectors as a matrix."""
    vectors = batch.column(column)
    sizes = np.diff(np.array(vectors.offsets))
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        flat = vectors.take(pa.array(rows)).flatten()
        yield rows, np.array(flat, np.int64).reshape(len(rows), size)


def _to_blocks(batches) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, matrix in _matrices(batch, "x"):
            step = max(1, BLOCK // matrix.shape[1])
            for at in range(0, len(matrix), step):
                part = matrix[at:at + step]
                yield pa.RecordBatch.from_pylist(
                    [{"dims": part.shape[1], "data": part.astype("<i8").tobytes()}],
                    pa.schema([("dims", pa.int32()), ("data", pa.binary())]))


def summed(blocks: DataFrame, dims: int, tasks: int,
           function: Callable[[np.ndarray], np.ndarray]) -> np.ndarray | None:
    """The sum over all blocks of an array that ``function`` makes of a block's vectors.

    One array per task comes to the driver; there are as many tasks as cores.
    """
    def run(batches):
        from pyspark import TaskContext

        total = None
        for batch in batches:
            for data in batch.column("data"):
                part = function(np.frombuffer(data.as_buffer(), "<i8").reshape(-1, dims))
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_pylist(
                [{"part": TaskContext.get().partitionId(), "data": total.tobytes(),
                  "kind": total.dtype.str, "shape": total.shape}],
                pa.schema([("part", pa.int32()), ("data", pa.binary()), ("kind", pa.string()),
                           ("shape", pa.list_(pa.int32()))]))

    found = (blocks.coalesce(tasks).select("data")
             .mapInArrow(run, "part int, data binary, kind string, shape array<int>").collect())
    parts = [np.frombuffer(x.data, x.kind).reshape(x.shape)
             for x in sorted(found, key=lambda x: x.part)]
    return sum(parts[1:], parts[0]) if parts else None


@dataclass(frozen=True)
class Centre:
    """The mean of ``count`` integer vectors: ``whole + rest / count``, exactly."""

    count: int
    whole: np.ndarray
    rest: np.ndarray

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole) - self.rest / self.count

    def deviations(self, x: np.ndarray) -> list[int]:
        """For each vector, the exact sum of (count * x - sum) ** 2."""
        near = x - self.whole
        most = int(np.abs(near).max(initial=0)) + 1
        if (self.count * most) ** 2 * x.shape[1] >= 1 << 63:
            near = near.astype(object)
        return [int(v) for v in ((self.count * near - self.rest) ** 2).sum(axis=1)]


def _orthonormal(new: np.ndarray, away: np.ndarray) -> np.ndarray:
    """A basis of what the new columns add to the given orthonormal ones."""
    for _ in range(2):
        new = new - away @ (away.T @ new)
        norms = np.linalg.norm(new, axis=0)
        new = new[:, norms > 0] / norms[norms > 0]
    left, sizes, _ = np.linalg.svd(new, full_matrices=False)
    new = left[:, sizes > 1e-10 * max(1.0, sizes.max(initial=0))]
    new = new - away @ (away.T @ new)
    return np.linalg.qr(new)[0]


def corrections(product: Callable, theta: np.ndarray, residuals: np.ndarray, away: np.ndarray,
                steps: int) -> np.ndarray:
    """MINRES for the projected correction equations of all columns, in step."""
    def project(x: np.ndarray) -> np.ndarray:
        x = x - away @ (away.T @ x)
        return x - away @ (away.T @ x)

    def unit(x: np.ndarray, norms: np.ndarray) -> np.ndarray:
        return np.divide(x, norms, out=np.zeros_like(x), where=norms > 0)

    v = project(-residuals)
    beta = np.linalg.norm(v, axis=0)
    phi, v, v_before = beta, unit(v, beta), np.zeros_like(v)
    beta = np.zeros_like(beta)
    x, w, w_before = np.zeros_like(v), np.zeros_like(v), np.zeros_like(v)
    cos, sin = -np.ones_like(phi), np.zeros_like(phi)
    bar, eps = np.zeros_like(phi), np.zeros_like(phi)
    for _ in range(steps):
        p = project(product(v) - v * theta)
        alpha = (v * p).sum(axis=0)
        p -= v * alpha + v_before * beta
        beta = np.linalg.norm(p, axis=0)
        eps_before, delta, gamma_bar = eps, cos * bar + sin * alpha, sin * bar - cos * alpha
        eps, bar = sin * beta, -cos * beta
        gamma = np.maximum(np.hypot(gamma_bar, beta), EPS * np.maximum(1.0, np.abs(theta)))
        cos, sin = gamma_bar / gamma, beta / gamma
        step, phi = cos * phi, sin * phi
        w, w_before = (v - w_before * eps_before - w * delta) / gamma, w
        x += w * step
        v, v_before = unit(p, beta), v
    return project(x)


def eigenpairs(product: Callable[[np.ndarray], np.ndarray], dims: int, count: int) \
        -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` greatest eigenvalues, falling, and their eigenvectors as columns."""
    count = min(count, dims)
    block = min(dims, count + GUARD)
    room = max(SUBSPACE * count, 2 * block)
    basis = np.linalg.qr(np.random.default_rng(0).standard_normal((dims, block)))[0]
    image = product(basis)
    locked, values, top = np.empty((dims, 0)), [], 0.0
    fresh = False
    for _ in range(ROUNDS):
        small = basis.T @ image
        theta, turn = np.linalg.eigh((small + small.T) / 2)
        theta, turn = theta[::-1], turn[:, ::-1]
        basis, image = basis @ turn, image @ turn
        top = max(top, abs(theta[0]))
        residuals = image - basis * theta
        residuals -= locked @ (locked.T @ residuals)
        norms = np.linalg.norm(residuals, axis=0)
        whole = basis.shape[1] + locked.shape[1] == dims
        bound = 16 * EPS * np.sqrt(dims) * top * (64 if whole and fresh else 1)
        wanted = count - len(values)
        late = np.flatnonzero(norms[:wanted] > bound)
        done = int(late[0]) if len(late) else min(wanted, len(norms))
        locked = np.hstack([locked, basis[:, :done]])
        values += theta[:done].tolist()
        if len(values) == count:
            return np.array(values), np.linalg.qr(locked)[0]
        basis, image, theta = basis[:, done:], image[:, done:], theta[done:]
        residuals, norms, wanted = residuals[:, done:], norms[done:], wanted - done
        if whole:  # nothing to add: only rounding in the turned images is left
            if fresh:
                raise RuntimeError("residuals of the eigenvectors stay above rounding")
            basis = np.linalg.qr(basis - locked @ (locked.T @ basis))[0]
            image, fresh = product(basis), True
            continue
        aims = np.flatnonzero(norms[:wanted] > bound)
        if basis.shape[1] + len(aims) > room:
            keep = min(basis.shape[1], wanted + block)
            basis, image = basis[:, :keep], image[:, :keep]
        away = np.hstack([locked, basis[:, :wanted]])
        new = corrections(product, theta[aims], residuals[:, aims], away, STEPS)
        new = _orthonormal(new, np.hstack([locked, basis]))
        if not new.shape[1]:
            drawn = np.random.default_rng(len(values)).standard_normal((dims, 1))
            new = _orthonormal(drawn, np.hstack([locked, basis]))
        basis, image = np.hstack([basis, new]), np.hstack([image, product(new)])
    raise RuntimeError("the eigenvectors have not converged")


@dataclass(frozen=True)
class Whitening:
    """A fitted map: components are the columns of ``vectors``."""

    centre: Centre
    vectors: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float

    def apply(self, x: np.ndarray) -> np.ndarray:
        return self.centre.centred(x) @ self.vectors / np.sqrt(self.values)


def fit(blocks: DataFrame, dims: int, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of the stored vectors of a length; None if they do not vary."""
    context = blocks.sparkSession.sparkContext
    tasks = context.defaultParallelism
    blocks = blocks.where(F.col("dims") == dims)

    def sums(x: np.ndarray) -> np.ndarray:  # of halves, so that no sum leaves 64 bits
        return np.vstack([np.full(dims, len(x)), (x >> 32).sum(axis=0),
                          (x & 0xFFFFFFFF).sum(axis=0)])

    count, high, low = summed(blocks, dims, tasks, sums).astype(object)
    count, total = int(count[0]), high * (1 << 32) + low
    whole = np.array([int(x) // count for x in total], np.int64)
    centre = Centre(count, whole, np.array([int(x) % count for x in total], np.int64))

    def squares(x: np.ndarray) -> np.ndarray:
        return np.square(centre.centred(x)).sum(axis=0)

    def product(w: np.ndarray) -> np.ndarray:
        def part(x: np.ndarray) -> np.ndarray:
            near = centre.centred(x)
            return near.T @ (near @ w)

        return summed(blocks, dims, tasks, part) / count

    trace = float(summed(blocks, dims, tasks, squares).sum() / count)
    if trace == 0:
        return None
    values, vectors = eigenpairs(product, dims, components)
    varied = values > 1e3 * EPS * dims * values[0]
    values, vectors = values[varied], vectors[:, varied]
    found = Whitening(centre, vectors, values, trace, 0.0)

    def moments(x: np.ndarray) -> np.ndarray:
        white = found.apply(x)
        return np.vstack([white.T @ white, white.sum(axis=0)])

    *products, mean = summed(blocks, dims, tasks, moments) / count
    error = np.abs(np.array(products) - np.outer(mean, mean) - np.eye(len(values))).max()
    return Whitening(centre, vectors, values, trace, float(error))


def whiten(rows: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding",
           components: int = COMPONENTS) -> DataFrame:
    """One row per vector and component, with the shares and the error of the fit."""
    ship(rows.sparkSession)
    valid = rows.select(F.col(id_column).cast("long").alias("vec_id"),
                        quantized(F.col(vector_column)).alias("x")).where("x IS NOT NULL")
    blocks = stored(valid.select("x").distinct().mapInArrow(_to_blocks, "dims int, data binary"),
                    "vectors")
    lengths = sorted(x.dims for x in blocks.select("dims").distinct().collect())
    fits = {d: found for d in lengths if (found := fit(blocks, d, components))}

    def run(batches):
        for batch in batches:
            for at, x in _matrices(batch, "x"):
                found = fits.get(x.shape[1])
                if not found:
                    continue
                white = found.apply(x)
                yield pa.RecordBatch.from_arrays([
                    batch.column("vec_id").take(pa.array(at)),
                    pa.array(np.full(len(x), x.shape[1], np.int32)),
                    pa.array(found.centre.deviations(x), pa.decimal128(38, 0)),
                    pa.ListArray.from_arrays(
                        np.arange(0, white.size + 1, white.shape[1], dtype=np.int32),
                        white.ravel())], names=["vec_id", "dims", "deviation", "white"])

    made = valid.mapInArrow(
        run, "vec_id long, dims int, deviation decimal(38,0), white array<double>")

    def known(kind: str, value: Callable[[Whitening], Column]) -> Column:
        """A value of the fit for the row's length."""
        return F.coalesce(*[F.when(F.col("dims") == d, value(x)) for d, x in fits.items()],
                          F.lit(None)).cast(kind)

    shares = known("array<double>",
                   lambda x: F.array(*[F.lit(float(e / x.trace)) for e in x.values]))
    return (
        made.select("vec_id", "dims", "deviation", F.posexplode("white").alias("at", "whitened"))
        .select("vec_id", "dims", (F.col("at") + 1).alias("component"),
                known("long", lambda x: F.lit(x.centre.count)).alias("n"), "deviation",
                "whitened", F.get(shares, F.col("at")).alias("explained"),
                known("double", lambda x: F.lit(x.identity_error)).alias("identity_error"))
    )
