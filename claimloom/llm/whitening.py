"""Embedding whitening from exact integer scatter, by bit slices.

Components become integers y = floor(scale * c). In a block of rows, each dimension is shifted by its smallest value
and cut into bit planes, and a plane's bits of all rows are packed into 64-bit words. The cross-product of two
dimensions is then the sum over pairs of planes of popcount(a AND b), weighted by the planes' powers of two; shifts
are undone in whole numbers. Tasks send one row per pair of dimensions, in two parts that cannot overflow, and the
driver gets the sums: dimensions squared, however many rows. n * P - S * S' centres the scatter as integers before
the eigendecomposition, so the offset of the data costs no digit.

Statistics are over the fit list, each distinct vector once; its distinct rows are found by a shuffle that combines
copies first, so a vector that holds a third of the rows is one row a task.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from claimloom.staging import staged

from .common import load

SCALE = 64
COMPONENTS = 16
LIMIT = float(1 << 61)
LOW_BITS = 40
MOST = (1 << 63) - 1


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dim)


def bit_planes(z: np.ndarray) -> np.ndarray:
    """Bit planes of non-negative numbers (rows, dims): (dims, planes, words), 64 rows a word."""
    bits = max(1, int(z.max()).bit_length())
    out = np.zeros((z.shape[1], bits, -(-len(z) // 64) * 8), dtype=np.uint8)
    for p in range(bits):
        packed = np.packbits((z >> p & 1).astype(bool).T, axis=1)
        out[:, p, : packed.shape[1]] = packed
    return out.view(np.uint64)


def scatter(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exact sums (dims) and cross-products (dims, dims) of whole numbers (rows, dims), as Python ints."""
    low = y.min(axis=0)
    planes = bit_planes(y - low)
    dims, bits, words = planes.shape
    whole = np.int64 if 2 * bits + len(y).bit_length() < 63 else object
    weight = np.array([1 << p for p in range(bits)], dtype=object).astype(whole)
    total = np.bitwise_count(planes).sum(axis=2, dtype=np.int64).astype(whole) @ weight
    cross = np.zeros((dims, dims), dtype=object)
    for i in range(dims):
        rest = planes[i:].reshape(-1, words)
        row = 0
        for p in range(bits):
            common = np.bitwise_count(planes[i, p] & rest).sum(axis=1, dtype=np.int64)
            row = row + common.reshape(-1, bits).astype(whole) @ weight * weight[p]
        cross[i, i:] = cross[i:, i] = row
    total, low, n = total.astype(object), low.astype(object), len(y)
    side = np.outer(low, total)
    return total + n * low, cross + side + side.T + n * np.outer(low, low)


@dataclass
class Whitening:
    """n rows and their sums; eigenvalues by fall, eigenvectors in columns, trace of the covariance (of y)."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    @property
    def dim(self) -> int:
        return len(self.sums)


def solve(n: int, sums: np.ndarray, cross: np.ndarray, components: int) -> Whitening:
    """Eigenvectors of the covariance. Eigenvalues too small to be told from rounding (relative error over 0.0001) are left out."""
    centred = n * cross - np.outer(sums, sums)
    covariance = np.array([[c / (n * n) for c in row] for row in centred.tolist()], dtype=float)
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1], vectors[:, ::-1]
    keep = int(np.count_nonzero(values > len(sums) * np.finfo(float).eps * 1e4 * max(values[0], 0.0)))
    keep = min(keep, components)
    vectors = vectors[:, :keep]
    turn = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(keep)])
    return Whitening(n, sums.tolist(), values[:keep], vectors * turn, sum(centred.diagonal().tolist()) / (n * n))


def integer_rows(table: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(vec_id, y) of every vector without null or non-finite components."""
    v = F.col("v")
    finite = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    bound = lambda x: F.least(F.greatest(x, F.lit(-LIMIT)), F.lit(LIMIT))
    y = F.transform(v, lambda c: F.floor(bound(c.cast("double") * F.lit(float(scale)))).cast("long"))
    rows = table.select(table[id_col].cast("long").alias("vec_id"), table[vector_col].alias("v"))
    return rows.filter(F.coalesce(finite & (F.size(v) > 0), F.lit(False))).select("vec_id", y.alias("y"))


def _exact_sums(fit: DataFrame, dim: int) -> tuple[int, np.ndarray, np.ndarray]:
    def run(batches):
        n, sums, cross = 0, np.zeros(dim, dtype=object), np.zeros((dim, dim), dtype=object)
        for batch in batches:
            if batch.num_rows:
                s, c = scatter(_matrix(batch.column(0), dim))
                n, sums, cross = n + batch.num_rows, sums + s, cross + c
        i, j = np.triu_indices(dim)
        found = [n, *sums.tolist(), *cross[i, j].tolist()]
        high = pa.array([x >> LOW_BITS for x in found], pa.decimal128(38, 0))
        low = pa.array([x & (1 << LOW_BITS) - 1 for x in found], pa.int64())
        rows = np.concatenate([np.full(1 + dim, -1), i]).astype(np.int32)
        columns = np.concatenate([np.arange(-1, dim), j]).astype(np.int32)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(columns), high, low], names=["i", "j", "high", "low"])

    parts = fit.select("y").mapInArrow(run, "i int, j int, high decimal(38,0), low long")
    total = parts.groupBy("i", "j").agg(F.sum("high"), F.sum("low")).collect()
    n, sums, cross = 0, np.zeros(dim, dtype=object), np.zeros((dim, dim), dtype=object)
    for i, j, high, low in total:
        x = (int(high) << LOW_BITS) + low
        if j < 0:
            n = x
        elif i < 0:
            sums[j] = x
        else:
            cross[i, j] = cross[j, i] = x
    return n, sums, cross


def _centred(y: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n * y - sums, exact."""
    most = max(abs(int(y.min())), abs(int(y.max()))) * n + max(map(abs, sums.tolist()))
    whole = np.int64 if most < 1 << 62 else object
    return y.astype(whole) * n - sums.astype(whole)


def _deviation(centred: np.ndarray) -> list:
    """Sum of squares of each row; None where it does not fit a long."""
    most = max(abs(int(centred.min())), abs(int(centred.max())))
    if most * most * centred.shape[1] <= MOST:
        return (centred.astype(np.int64) ** 2).sum(axis=1).tolist()
    return [x if x <= MOST else None for x in (centred.astype(object) ** 2).sum(axis=1)]


def _projector(model: Whitening):
    n, sums, project = model.n, np.array(model.sums, dtype=object), model.vectors / np.sqrt(model.values)
    return n, sums, lambda centred: centred.astype(float) / n @ project


def identity_error(fit: DataFrame, model: Whitening) -> float:
    """Largest entry of the whitened fit list's covariance minus the identity, from its rows."""
    (n, sums, project), dim, k = _projector(model), model.dim, len(model.values)
    i, j = np.triu_indices(k)

    def run(batches):
        first, second = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            if batch.num_rows:
                w = project(_centred(_matrix(batch.column(0), dim), n, sums))
                first, second = first + w.sum(axis=0), second + w.T @ w
        rows, columns = np.concatenate([np.full(k, -1), i]), np.concatenate([np.arange(k), j])
        yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(columns), pa.array(np.concatenate([first, second[i, j]]))], names=["i", "j", "s"])

    parts = fit.select("y").mapInArrow(run, "i long, j long, s double")
    total = {(r[0], r[1]): r[2] / n for r in parts.groupBy("i", "j").agg(F.sum("s")).collect()}
    mean = [total[-1, c] for c in range(k)]
    return max(abs(total[a, b] - mean[a] * mean[b] - (a == b)) for a, b in zip(i.tolist(), j.tolist()))


def fit(rows: DataFrame, components: int = COMPONENTS) -> tuple[Whitening | None, DataFrame]:
    """The whitening of integer rows (vec_id, y) and its fit list; None without rows of positive variance."""
    # The commonest length; vectors of another one cannot share a covariance.
    common = rows.groupBy(F.size("y").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    if common is None:
        return None, rows
    distinct = staged(rows.filter(F.size("y") == common.dim).select("y").distinct(), "whitening_fit")
    model = solve(*_exact_sums(distinct, common.dim), components)
    return (model if len(model.values) else None), distinct


def whiten(
    table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS, scale: int = SCALE,
) -> DataFrame:
    """One row per usable vector and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    Vectors that are null, empty or hold null or non-finite components give no rows, nor do vectors of another
    length than the commonest (of equally common ones, the longest). Repeated rows are whitened each, but are one
    vector of the fit list. Components whose eigenvalue is zero to rounding are left out, so equal vectors alone, or
    one vector, give no rows; neither does an empty table. deviation is null where it exceeds a long. Numbers
    beyond 2**61 count as 2**61. Other columns are not read.
    """
    spark = table.sparkSession
    rows = integer_rows(table, id_col, vector_col, scale)
    few = len(table.inputFiles()) < (cores := spark.sparkContext.defaultParallelism)
    rows = staged(rows.repartition(cores) if few else rows, "whitening_rows")
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    model, distinct = fit(rows, components)
    if model is None:
        return spark.createDataFrame([], schema)
    (n, sums, project), dim, k = _projector(model), model.dim, len(model.values)
    error, explained = identity_error(distinct, model), model.values / model.trace

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            centred = _centred(_matrix(batch.column(1), dim), n, sums)
            rows = pa.array(np.repeat(np.arange(batch.num_rows), k))
            size = len(rows)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(rows), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), batch.num_rows)), pa.array(np.full(size, n)),
                    pa.array(_deviation(centred), pa.int64()).take(rows), pa.array(project(centred).ravel()),
                    pa.array(np.tile(explained, batch.num_rows)), pa.array(np.full(size, error)),
                ],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.filter(F.size("y") == dim).mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    """y = x - 1,000,000 for the x of the contract: covariance, deviation and centred values are the same."""
    return whiten(load(spark, sf_dir, "embeddings"))
