"""Whitening of embeddings by a matrix-free block Lanczos iteration.

The covariance is never formed: a pass over the vectors multiplies it with a block of columns, each task summing (n x - S)' Q rows
of its own, and Spark adds the sums up. The driver holds the basis, orthogonalised twice against all of itself, and solves the small
projected problem. The iteration ends when the residuals of the wanted components are at rounding level and a block of random
directions brings no larger one, or when the basis is the whole space. Directions that a block has lost are begun anew at random.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

SCALE, SHIFT = 64, 1_000_000
COMPONENTS, BLOCK, SEED = 32, 16, 13
RESIDUAL = 1e-14  # of the largest eigenvalue, times the root of the dimensions: what double precision gives
NOTHING = 1e-13  # eigenvalues below this part of the largest, times the dimensions, are none
ROWS = 1024  # vectors multiplied at once
LARGEST = 1 << 52  # entries as whole numbers are below this


def whole_numbers(rows: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, dim, x): x the entries floor(64 c) + 1000000 as 32-bit or, where they don't fit, 64-bit integers.

    Rows whose vector is null, empty, or holds null or non-finite entries go. Entries beyond 2^52 raise.
    """

    def run(batches):
        for batch in batches:
            keep, dim, x = [], [], []
            for k, v in enumerate(batch.column("embedding")):
                if not v.is_valid or not len(v.values) or v.values.null_count:
                    continue
                c = v.values.to_numpy(zero_copy_only=False)
                if not np.isfinite(c).all():
                    continue
                y = np.floor(SCALE * c) + SHIFT
                if np.abs(y).max() >= LARGEST:
                    raise ValueError(f"an entry of {np.abs(c).max()} is too large for whole numbers")
                keep.append(k)
                dim.append(len(c))
                x.append(y.astype(np.int32 if np.abs(y).max() < 1 << 31 else np.int64).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(pa.array(keep, pa.int64())), pa.array(dim, pa.int32()), pa.array(x, pa.binary())], names=["vec_id", "dim", "x"])

    given = rows.select(F.col(vec_id).alias("vec_id"), F.col(embedding).cast("array<double>").alias("embedding"))
    return given.mapInArrow(run, f"vec_id {given.schema['vec_id'].dataType.simpleString()}, dim int, x binary")


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    data = [np.frombuffer(v, np.int32 if len(v) == 4 * dim else np.int64) for v in column.to_pylist()]
    return np.array(data, np.int64).reshape(-1, dim)


def _parts(batches, dim: int):
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            yield part, _matrix(part.column("x"), dim)


def _exact(x: np.ndarray, n: int, total: np.ndarray) -> np.ndarray:
    """n x - S without rounding: as 64-bit integers if they hold it, else as Python's."""
    if n * int(np.abs(x).max(initial=1)) < 1 << 62:
        return n * x - total
    return x.astype(object) * n - np.array([int(t) for t in total], object)


def centred(x: np.ndarray, n: int, total: np.ndarray) -> np.ndarray:
    """x - S / n in double precision: one rounding, after the difference."""
    return (_exact(x, n, total) / n).astype(np.float64)


def add_up(rows: DataFrame, dim: int, size: int, one: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all vectors of one(x), x some vectors as rows; `size` numbers come back, whatever the count of vectors."""

    def run(batches):
        total = np.zeros(size)
        for _, x in _parts(batches, dim):
            total += one(x).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(total)], names=["at", "value"])

    out = np.zeros(size)
    for at, value in rows.select("x").mapInArrow(run, "at long, value double").groupBy("at").agg(F.sum("value")).collect():
        out[at] = value
    return out


class Fit:
    """n vectors of one length with sums `total`; eigenvalues that fall, unit eigenvectors as columns, and the trace."""

    def __init__(self, rows: DataFrame, dim: int, components: int = COMPONENTS, block: int = BLOCK):
        self.rows, self.dim = rows, dim
        self.n, self.total = self.sums()
        n, total = self.n, self.total
        self.trace = add_up(rows, dim, 1, lambda x: np.square(centred(x, n, total)).sum(keepdims=True)).item() / n
        self.values, self.vectors = np.zeros(0), np.zeros((dim, 0))
        if self.trace > 0:
            values, vectors = lanczos(self.times, dim, min(components, dim), min(block, dim))
            some = values > NOTHING * dim * values[0]
            self.values, self.vectors = values[some], vectors[:, some]

    def sums(self) -> tuple[int, np.ndarray]:
        """Count and exact sums of each dimension."""
        dim = self.dim

        def run(batches):
            n, total, high = 0, np.zeros(dim, np.int64), np.zeros(dim, np.int64)
            for _, x in _parts(batches, dim):
                n += len(x)
                total += x.sum(axis=0)  # 1024 numbers below 2^52 and a rest below 2^32
                high += total >> 32
                total &= 0xFFFFFFFF
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim + 1)), pa.array(np.append(high, 0)), pa.array(np.append(total, n))], names=["at", "high", "low"])

        got = self.rows.select("x").mapInArrow(run, "at long, high long, low long").groupBy("at").agg(F.sum("high"), F.sum("low")).collect()
        sums = {at: (int(high) << 32) + int(low) for at, high, low in got}
        out = [sums[k] for k in range(dim + 1)]
        wide = max(map(abs, out[:dim])) >= 1 << 62
        return out[dim], np.array(out[:dim], object if wide else np.int64)

    def times(self, block: np.ndarray) -> np.ndarray:
        """The covariance times some columns, in one pass."""
        n, total = self.n, self.total
        held = self.rows.sparkSession.sparkContext.broadcast(block)

        def one(x: np.ndarray) -> np.ndarray:
            c = centred(x, n, total)
            return c.T @ (c @ held.value)

        out = add_up(self.rows, self.dim, block.size, one).reshape(block.shape) / n
        held.unpersist()
        return out

    def whiteners(self) -> np.ndarray:
        return self.vectors / np.sqrt(self.values)

    def identity_error(self) -> float:
        """Largest entry, without sign, of the covariance of whitened vectors minus the identity: centred before multiplying."""
        n, total, w = self.n, self.total, self.whiteners()
        k = w.shape[1]
        mean = add_up(self.rows, self.dim, k, lambda x: (centred(x, n, total) @ w).sum(axis=0)) / n

        def product(x: np.ndarray) -> np.ndarray:
            z = centred(x, n, total) @ w - mean
            return z.T @ z

        return float(np.abs(add_up(self.rows, self.dim, k * k, product).reshape(k, k) / n - np.eye(k)).max(initial=0.0))


def _orthogonal(block: np.ndarray, basis: np.ndarray, random: np.random.Generator) -> np.ndarray:
    """Orthonormal columns that span what the block has beyond the basis; those that vanish are begun anew at random."""
    out = np.zeros((len(block), 0))
    for column in block.T[: len(block) - basis.shape[1]]:
        v, least = column, 1e-10 * np.linalg.norm(column)
        while True:
            for _ in range(2):
                for q in (basis, out):
                    v = v - q @ (q.T @ v)
            size = np.linalg.norm(v)
            if size > least:
                break
            v = random.normal(size=len(block))
            least = 1e-6
        v = v / size
        for q in (basis, out):
            v = v - q @ (q.T @ v)
        out = np.column_stack([out, v / np.linalg.norm(v)])
    return out


def lanczos(times: Callable[[np.ndarray], np.ndarray], dim: int, wanted: int, block: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues, falling, and their unit vectors of a symmetric matrix known by its products with blocks.

    The products of the whole basis are kept, so residuals are told without a pass. It ends when they are at rounding level or
    no longer fall; then one block of random directions looks for what the start was blind to, such as further copies of a
    repeated eigenvalue. At the latest it ends with the whole space, after dim / block passes.
    """
    random = np.random.default_rng(SEED)
    basis, products = np.zeros((dim, 0)), np.zeros((dim, 0))
    following = random.normal(size=(dim, block))
    probing, settled, before = False, None, np.inf
    while True:
        q = _orthogonal(following, basis, random)
        product = times(q)
        basis, products = np.column_stack([basis, q]), np.column_stack([products, product])
        small = basis.T @ products
        values, turns = np.linalg.eigh((small + small.T) / 2)
        values, turns = values[::-1], turns[:, ::-1]
        k = min(wanted, len(values))
        vectors = basis @ turns[:, :k]
        residuals = np.linalg.norm(products @ turns[:, :k] - vectors * values[:k], axis=0)
        if basis.shape[1] >= dim:
            break
        bar, worst = RESIDUAL * np.sqrt(dim) * values[0], residuals.max()
        done = k == wanted and (worst <= bar or (worst <= 100 * bar and worst > before / 2))
        if probing and done and np.abs(values[:k] - settled).max() <= 10 * bar:
            break
        probing, settled, before = done, values[:k], worst
        following = random.normal(size=(dim, block)) if done else product
    vectors = vectors / np.linalg.norm(vectors, axis=0)
    return values[:k], vectors


def whiten(rows: DataFrame, components: int = COMPONENTS, block: int = BLOCK, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error), a row for each vector and component.

    Vectors that are null, empty or hold null or non-finite entries go; repeated ids and null ids stay, a row each. Vectors of
    different lengths share no space: each length is fitted apart, with its own n. Components whose eigenvalue is zero, as all
    of a single vector's are, can't be scaled and are left out; of equal eigenvalues any basis serves. An empty table gives
    none. A deviation beyond 64 bits raises. Other columns are left behind.
    """
    kept = written(whole_numbers(rows, vec_id, embedding), "vectors")
    kind = kept.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    out = None
    for dim in sorted(r[0] for r in kept.select("dim").distinct().collect()):
        some = _whitened(Fit(kept.where(F.col("dim") == dim), dim, components, block), schema)
        out = some if out is None else out.union(some)
    return out if out is not None else kept.sparkSession.createDataFrame([], schema)


def _whitened(fit: Fit, schema: str) -> DataFrame:
    n, total, w, dim = fit.n, fit.total, fit.whiteners(), fit.dim
    k, explained, error = w.shape[1], fit.values / fit.trace if fit.trace > 0 else fit.values, fit.identity_error() if len(fit.values) else 0.0

    def run(batches):
        for part, x in _parts(batches, dim):
            d = _exact(x, n, total)
            wide = d.dtype == object or float(np.square(d.astype(np.float64)).sum(axis=1).max(initial=0)) > 9e18
            deviation = np.square(d.astype(object) if wide else d).sum(axis=1)
            z = (d / n).astype(np.float64) @ w
            m = len(x)
            columns = [part.column("vec_id").take(pa.array(np.repeat(np.arange(m), k))), np.tile(np.arange(1, k + 1, dtype=np.int32), m), np.full(m * k, n), np.repeat(deviation, k), z.ravel(), np.tile(explained, m), np.full(m * k, error)]
            yield pa.RecordBatch.from_arrays([columns[0], pa.array(columns[1]), pa.array(columns[2], pa.int64()), pa.array(columns[3].tolist() if wide else columns[3], pa.int64()), *map(pa.array, columns[4:])], names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return fit.rows.mapInArrow(run, schema)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
