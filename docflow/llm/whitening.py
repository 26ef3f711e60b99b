"""Whitening of embeddings by matrix-free block Lanczos.

The covariance is never formed: a pass over the vectors multiplies the centred data with a block of directions, X'(XV),
and adds up one small matrix. Each new block is made orthogonal to all earlier ones (full reorthogonalisation); directions
that break down are replaced by random ones. The Ritz pairs' residuals, which the passes give without another, say when
the wanted components have converged. Only matrices of dimensions x directions come to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, raw, release, small_batches, table

COMPONENTS = 8
BLOCK = 8  # directions of a pass
SCALE, SHIFT = 1024, 100_000  # an entry c counts as floor(SCALE * c) + SHIFT
RESIDUAL = 1e-14  # of the largest eigenvalue, at which a component has converged
LEAST = 1e-12  # of the largest eigenvalue; directions of less variance can't be whitened
CHUNK = 4096  # vectors that a task centres at once


class Whitening(NamedTuple):
    n: int
    sums: np.ndarray  # exact sum of each dimension
    values: np.ndarray  # eigenvalues, falling
    vectors: np.ndarray  # dimensions x components
    trace: float
    passes: int


def integers(rows: DataFrame, column: str, key: str | None = None) -> DataFrame:
    """(key, d, x) of the rows whose vector is neither null nor empty and holds neither null nor non-finite entries: its dimensions and its entries as packed integers, 32 bits each where a batch's fit, else 64. Checkpointed, as every pass reads them."""
    v = F.col(column).cast("array<double>")
    bad = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    kept = rows.where(F.col(column).isNotNull() & (F.size(column) > 0) & ~bad).select((F.col(key) if key else F.lit(None)).cast("bigint").alias("key"), v.alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column("v")
            x = np.floor(SCALE * v.flatten().to_numpy(zero_copy_only=False)).astype(np.int64) + SHIFT
            x = x.astype(np.int32) if np.abs(x).max(initial=0) < 2**31 else x
            ends = np.concatenate([[0], np.cumsum(v.value_lengths().to_numpy(zero_copy_only=False))])
            packed = pa.array([x[i:j].tobytes() for i, j in zip(ends[:-1], ends[1:], strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(np.diff(ends), pa.int32()), packed], ["key", "d", "x"])

    return checkpoint(kept.mapInArrow(run, "key bigint, d int, x binary"))


def _integers(batch: pa.RecordBatch, d: int) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, vectors) in chunks."""
    for at in range(0, batch.num_rows, CHUNK):
        data, ends = raw(batch.column("x").slice(at, CHUNK))
        sizes = np.diff(ends)
        if (sizes == 4 * d).all():
            x = np.frombuffer(data.tobytes(), np.int32).reshape(-1, d).astype(np.int64)
        else:
            x = np.array([np.frombuffer(data[i:j].tobytes(), np.int32 if j - i == 4 * d else np.int64) for i, j in zip(ends[:-1], ends[1:], strict=True)], np.int64)
        yield at, x


def _summed(vectors: DataFrame, d: int, width: int, of) -> np.ndarray:
    """The sum over all vectors of of(integers), a matrix of d x width: each task adds up its own, Spark those of the tasks by row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, width))
        for batch in batches:
            for _, x in _integers(batch, d):
                total += of(x)
        release()
        yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int32()), pa.array(total.tolist(), pa.list_(pa.float64()))], ["i", "v"])

    parts = vectors.select("x").mapInArrow(run, "i int, v array<double>")
    out = np.zeros((d, width))
    for r in parts.groupBy("i").agg(F.array(*[F.sum(F.col("v")[k]) for k in range(width)]).alias("v")).collect():  # d rows
        out[r["i"]] = r["v"]
    return out


def sums(vectors: DataFrame) -> tuple[int, np.ndarray]:
    """Number of vectors and exact sums of their integers by dimension."""
    d, most = vectors.agg(F.min("d"), F.max("d")).first()
    if d is None:
        return 0, np.zeros(0, np.int64)
    if d != most:
        raise ValueError(f"vectors of {d} and of {most} dimensions")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(d, np.int64)
        for batch in batches:
            for _, x in _integers(batch, d):
                n, total = n + len(x), total + x.sum(0)
        release()
        yield pa.RecordBatch.from_arrays([pa.array(range(-1, d), pa.int32()), pa.array([n, *total.tolist()], pa.int64())], ["i", "v"])

    parts = vectors.select("x").mapInArrow(run, "i int, v bigint").groupBy("i").agg(F.sum("v").alias("v")).collect()
    found = {r["i"]: r["v"] for r in parts}
    return found.pop(-1), np.array([found[i] for i in range(d)], np.int64)


def _centred(n: int, total: np.ndarray):
    mean_whole, rest = np.divmod(total, n)  # x - S / n with the whole parts taken off exactly
    return lambda x: (x - mean_whole) - rest / n


def _new_directions(block: np.ndarray, basis: np.ndarray, width: int, rng: np.random.Generator) -> tuple[np.ndarray, int]:
    """width orthonormal directions, orthogonal to basis, that span the block; those that break down are random. How many were."""
    d = len(block)
    out, broken = [], 0
    for k in range(width):
        v = block[:, k]
        size = np.linalg.norm(v)
        for attempt in range(6):
            own = v / size if size > 0 else v
            for _ in range(2):  # twice is enough
                for q in (basis, np.array(out).T if out else np.zeros((d, 0))):
                    own = own - q @ (q.T @ own)
            left = np.linalg.norm(own)
            if left > 1e-8:
                own = own / left
                for q in (basis, np.array(out).T if out else np.zeros((d, 0))):
                    own = own - q @ (q.T @ own)
                out.append(own / np.linalg.norm(own))
                break
            broken += attempt == 0
            v = rng.standard_normal(d)
            size = np.linalg.norm(v)
    return np.array(out).T.reshape(d, -1), broken


def fit(vectors: DataFrame, components: int = COMPONENTS, block: int = BLOCK, residual: float = RESIDUAL, seed: int = 11) -> Whitening:
    """Mean and leading components of vectors, which come from integers(). Fewer components than asked for where fewer directions have variance."""
    n, total = sums(vectors)
    d = len(total)
    if not n:
        return Whitening(0, total, np.zeros(0), np.zeros((d, 0)), 0.0, 0)
    centred, rng = _centred(n, total), np.random.default_rng(seed)
    trace = float(_summed(vectors, d, 1, lambda x: (centred(x) ** 2).sum(0)[:, None]).sum() / n)
    basis = images = np.zeros((d, 0))
    fresh, values, ritz, passes = rng.standard_normal((d, min(block, d))), np.zeros(0), np.zeros((d, 0)), 0
    while basis.shape[1] < d:
        q, _ = _new_directions(fresh, basis, min(block, d - basis.shape[1]), rng)
        w = _summed(vectors, d, q.shape[1], lambda x, q=q: (c := centred(x)).T @ (c @ q)) / n
        passes += 1
        basis, images = np.hstack([basis, q]), np.hstack([images, w])
        small = basis.T @ images
        values, own = np.linalg.eigh((small + small.T) / 2)
        values, own = values[::-1], own[:, ::-1]
        ritz = basis @ own
        off = np.linalg.norm(images @ own - ritz * values, axis=0)
        if len(values) >= components + 1 and (off[:components] <= residual * max(values[0], 1e-300)).all():
            break
        fresh = w
    kept = [k for k in range(min(components, len(values))) if values[k] > LEAST * max(values[0], 0) and values[k] > 0]
    ritz = ritz[:, kept] / np.linalg.norm(ritz[:, kept], axis=0) if kept else np.zeros((d, 0))
    return Whitening(n, total, values[kept], ritz, trace, passes)


def _whiten(w: Whitening):
    centred, scaled = _centred(w.n, w.sums), w.vectors / np.sqrt(w.values)
    return lambda x: centred(x) @ scaled


def identity_error(vectors: DataFrame, w: Whitening) -> float:
    """The largest absolute entry of the whitened vectors' covariance, divisor n, less the identity."""
    k = len(w.values)
    if not k:
        return 0.0
    white = _whiten(w)

    def moments(x: np.ndarray) -> np.ndarray:
        y = np.hstack([white(x), np.ones((len(x), 1))])
        out = np.zeros((len(w.sums), k + 1))
        out[: k + 1] = (y.T @ y)[: len(out)]
        return out

    if len(w.sums) < k + 1:  # as many components as dimensions: their sums come by another pass
        means = _summed(vectors, len(w.sums), k, lambda x: np.vstack([white(x).sum(0), np.zeros((len(w.sums) - 1, k))]))[0] / w.n
        second = _summed(vectors, len(w.sums), k, lambda x: (y := white(x)).T @ y) / w.n
    else:
        m = _summed(vectors, len(w.sums), k + 1, moments) / w.n
        means, second = m[k, :k], m[:k, :k]
    return float(np.abs(second - np.outer(means, means) - np.eye(k)).max())


def deviations(x: np.ndarray, n: int, total: np.ndarray) -> list[int | None]:
    """Sum over the dimensions of (n x - S)² of each row of x, exact; null where it doesn't fit 64 bits."""
    off = n * x.astype(object) - total if n > 2**40 else n * x - total
    if off.dtype != object and (np.abs(off.astype(float)) ** 2).sum(1).max(initial=0) < 2**62:
        return (off * off).sum(1).tolist()
    exact = (sum(int(v) ** 2 for v in row) for row in off)
    return [v if v < 2**63 else None for v in exact]


def whitened(rows: DataFrame, column: str = "embedding", components: int = COMPONENTS, key: str = "vec_id") -> DataFrame:
    """key, component, n, deviation, whitened, explained, identity_error: a row for each vector that counts and component.

    Vectors that are null, empty or hold null or non-finite entries are dropped; the others must have the same number of
    dimensions, else a ValueError says so. Rows that repeat count and come out each; a null key is kept. Components are numbered from 1 by falling variance,
    at most as many as have any, so vectors that are all alike, and an empty table, give no rows. Other columns are left out.
    deviation is null where it exceeds 64 bits.
    """
    small_batches(rows.sparkSession)
    vectors = integers(rows, column, key)
    w = fit(vectors, components)
    k, off = len(w.values), identity_error(vectors, w)
    white = _whiten(w) if k else None
    explained = (w.values / w.trace).tolist() if k else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not k:
                continue
            for at, x in _integers(batch, len(w.sums)):
                m = len(x)
                rep = pa.array(np.repeat(np.arange(m), k))
                own = pc.take(batch.column("key").slice(at, m), rep)
                far = pc.take(pa.array(deviations(x, w.n, w.sums), pa.int64()), rep)
                arrays = [own, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, w.n)), far, pa.array(white(x).ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, off))]
                yield pa.RecordBatch.from_arrays(arrays, [key, "component", "n", "deviation", "whitened", "explained", "identity_error"])
        release()

    return vectors.mapInArrow(run, f"`{key}` bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double")


def op11_whitening(spark, sf_dir: str) -> DataFrame:
    return whitened(table(spark, sf_dir, "embeddings"))
