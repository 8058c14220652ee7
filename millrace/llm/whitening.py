"""Whitening of embeddings on their leading principal components, found by LOBPCG.

The covariance is never formed: each step multiplies it by a block of directions in one Spark job over the centred
rows, solves the small eigenproblem on iterate, residual and previous direction, and stops at certified residuals.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import fresh, written

#: Directions that are iterated besides those asked for, so that these converge faster.
GUARD = 6
#: The largest residual of a certified component, as a share of the first eigenvalue, and the steps after which it must be reached.
RESIDUAL, MOST_STEPS = 1e-12, 300
#: An eigenvalue below this share of the trace is rounding: there is no variance to divide by.
NO_VARIANCE = 1e-13
#: Entries beyond this (times the scale) are no longer whole doubles and count as non-finite.
LARGEST = 2.0**53


@dataclass(frozen=True)
class Components:
    """n distinct vectors with sums per dimension, unit eigenvectors as columns, eigenvalues, trace, residuals, error of identity."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    values: np.ndarray
    trace: float
    residuals: np.ndarray
    steps: int
    identity_error: float


def quantized(df: DataFrame, column: str = "embedding", name: str = "x", scale: int = 256) -> DataFrame:
    """Rows whose vector holds only finite entries, with ``name``: floor(scale * entry) of each, as longs.

    Left out are rows with a null or empty vector, a null or non-finite entry, or an entry that ``scale`` makes larger than
    2 ** 53; of vectors of several lengths only those of the commonest length (of these the longest) have a
    covariance, and the others are left out too.
    """
    scaled = F.transform(column, lambda c: c.cast("double") * scale)
    sound = F.coalesce((F.size(column) > 0) & F.forall(scaled, lambda c: F.coalesce(F.abs(c) <= LARGEST, F.lit(False))), F.lit(False))
    out = df.where(sound).withColumn(name, F.transform(scaled, lambda c: F.floor(c)))
    lengths = out.groupBy(F.size(name).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return out.where(F.size(name) == (lengths["d"] if lengths else 0))


def block(batch: pa.RecordBatch, column: str, dims: int) -> np.ndarray:
    """Vectors of a batch as rows of longs."""
    x = batch.column(batch.schema.get_field_index(column))
    return x.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def summed(rows: DataFrame, dims: int, shape: tuple[int, int], per_batch: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum of a matrix of ``shape`` over all rows: each task adds up its own, Spark adds by matrix row, the driver gets the sum."""
    high, width = shape
    names = [f"v{j}" for j in range(width)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for b in batches:
            if b.num_rows:
                total += per_batch(block(b, "x", dims))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(high)), *(pa.array(total[:, j].copy()) for j in range(width))], names=["i", *names])

    sums = rows.select("x").mapInArrow(run, ", ".join(["i long", *(f"{n} double" for n in names)])).groupBy("i").agg(*(F.sum(n).alias(n) for n in names)).collect()
    out = np.zeros(shape)
    for r in sums:
        out[r["i"]] = [r[n] for n in names]
    return out


def orthonormal(vectors: np.ndarray) -> np.ndarray:
    """Orthonormal directions that span ``vectors``, the most pronounced first, without what is rounding."""
    u, s, _ = np.linalg.svd(vectors, full_matrices=False)
    return u[:, s > 1e-10 * max(s.max(initial=0), 1e-300)]


def lobpcg(product: Callable[[np.ndarray], np.ndarray], dims: int, count: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The ``count`` largest eigenpairs of the symmetric matrix behind ``product``: vectors, values, residual norms, steps.

    The product of the iterate follows from those of the last step's orthonormal basis; before a result is certified the iterate
    is multiplied anew. Residuals and previous directions are multiplied in each step: near the end they are tiny, so that what would follow
    for them is mostly rounding. A block that spans all dimensions is solved at once.
    """
    m = min(dims, count + GUARD)
    x = orthonormal(np.random.default_rng(seed).standard_normal((dims, m)))
    ax, exact = product(x), True
    p = np.zeros((dims, 0))
    for step in range(MOST_STEPS):
        small = x.T @ ax
        values, turn = np.linalg.eigh((small + small.T) / 2)
        turn, values = turn[:, ::-1], values[::-1]
        x, ax = x @ turn, ax @ turn
        residual = ax - x * values
        norms = np.linalg.norm(residual, axis=0)
        if (norms[:count] <= RESIDUAL * max(values[0], 0)).all() or m == dims:
            if exact:
                return x[:, :count], values[:count], norms[:count], step
            x, _ = np.linalg.qr(x)
            ax, exact = product(x), True
            p = np.zeros((dims, 0))
            continue
        # directions outside the iterate, of length one: residuals and the previous ones
        w = np.hstack([residual / np.maximum(norms, 1e-300), p / np.maximum(np.linalg.norm(p, axis=0), 1e-300)])
        w -= x @ (x.T @ w)
        w = orthonormal(w)[:, : dims - m]
        for _ in range(2):  # what rounding has left of the iterate
            w, _ = np.linalg.qr(w - x @ (x.T @ w))
        basis, images = np.hstack([x, w]), np.hstack([ax, product(w) if w.shape[1] else w])
        small = basis.T @ images
        values, turn = np.linalg.eigh((small + small.T) / 2)
        turn = turn[:, ::-1][:, :m]
        p = w @ turn[m:]
        x, ax, exact = basis @ turn, images @ turn, False
    raise ArithmeticError(f"residuals {norms[:count]} after {MOST_STEPS} steps")


def fit(rows: DataFrame, count: int = 4, column: str = "x") -> Components:
    """Components of the distinct vectors of whole numbers in ``column``, each counted once; at most as many as dimensions.

    The distinct vectors are written once and read in every step; a step returns ``dims`` times the block's width numbers to
    the driver. Without rows there are no components.
    """
    distinct = written(rows.select(F.col(column).alias("x")).distinct(), rows.count())
    n, dims = distinct.agg(F.count("*"), F.coalesce(F.max(F.size("x")), F.lit(0))).first()
    if not n:
        return Components(0, [], np.zeros((0, 0)), np.zeros(0), 0.0, np.zeros(0), 0, 0.0)
    sums = [int(s) for (s,) in distinct.select(F.posexplode("x").alias("dim", "v")).groupBy("dim").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("s")).orderBy("dim").select("s").collect()]
    mean = np.array([s / n for s in sums])

    def product(directions: np.ndarray) -> np.ndarray:
        def add(x: np.ndarray) -> np.ndarray:
            centred = x - mean
            return centred.T @ (centred @ directions)

        return summed(distinct, dims, directions.shape, add) / n

    trace = float(summed(distinct, dims, (dims, 1), lambda x: ((x - mean) ** 2).sum(axis=0)[:, None]).sum()) / n
    vectors, values, residuals, steps = lobpcg(product, dims, min(count, dims))
    vectors = vectors * np.sign(np.take_along_axis(vectors, np.abs(vectors).argmax(axis=0)[None], axis=0))
    values = np.where(values > NO_VARIANCE * trace, values, 0)
    k = len(values)
    to = vectors / np.sqrt(np.where(values > 0, values, np.inf))
    centre = summed(distinct, dims, (k, 1), lambda x: ((x - mean) @ to).sum(axis=0)[:, None])[:, 0] / n

    def squares(x: np.ndarray) -> np.ndarray:
        z = (x - mean) @ to - centre
        return z.T @ z

    identity = np.diag((values > 0).astype(float))
    error = float(np.abs(summed(distinct, dims, (k, k), squares) / n - identity).max())
    return Components(n, sums, vectors, values, trace, residuals, steps, error)


def whitened(rows: DataFrame, components: Components, key: str = "vec_id", column: str = "x") -> DataFrame:
    """One row per row and component: key, component, n, deviation, whitened, explained, identity_error.

    A component without variance (fewer distinct vectors than components, say) has whitened null and explained 0.
    ``deviation`` is exact; where it does not fit a long the job fails, as no long could hold it. Rows are taken as they are:
    repeated ones are repeated, those without a key keep the null.
    """
    c, k = components, len(components.values)
    (own,) = fresh([column], "key")
    source = rows.select(F.col(key).alias(own), F.col(column))
    schema = T.StructType([T.StructField(key, source.schema[own].dataType), T.StructField("component", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("deviation", T.LongType()), T.StructField("whitened", T.DoubleType()), T.StructField("explained", T.DoubleType()), T.StructField("identity_error", T.DoubleType())])
    names, dims = schema.names, len(c.sums)
    mean = np.array([s / c.n for s in c.sums])
    to = c.vectors / np.sqrt(np.where(c.values > 0, c.values, np.inf)) if k else c.vectors
    sums = np.array(c.sums, object)
    most = max((abs(s) for s in c.sums), default=0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = block(b, column, dims)
            small = (c.n * int(np.abs(x).max()) + most) ** 2 * dims < 2**63
            off = x * c.n - sums.astype(np.int64) if small else x.astype(object) * c.n - sums
            deviation = pa.array((off * off).sum(axis=1).tolist(), pa.int64())
            z = (x - mean) @ to
            at = np.repeat(np.arange(b.num_rows), k)
            order = np.tile(np.arange(k), b.num_rows)
            flat = pa.array(z.ravel(), mask=(c.values <= 0)[order])
            same = lambda v, t, many=len(at): pa.array(np.full(many, v), t)
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index(own)).take(pa.array(at)), pa.array((order + 1).astype(np.int32)), same(c.n, pa.int64()), deviation.take(pa.array(at)), flat, pa.array((c.values / (c.trace or 1))[order]), same(c.identity_error, pa.float64())], names=names)

    return source.mapInArrow(run, schema)


def whiten(df: DataFrame, count: int = 4, key: str = "vec_id", column: str = "embedding", scale: int = 256) -> DataFrame:
    """``whitened`` rows of a table of vectors, fitted on its distinct quantized vectors; an empty table gives no rows."""
    (x,) = fresh(df.columns, "x")
    rows = quantized(df.select(key, column), column, x, scale)
    return whitened(rows, fit(rows, count, x), key, x)
