"""PCA whitening of vectors by exact integer scatter.

Every entry c becomes the integer x = floor(1024 * c) + 100000.  Tasks subtract
the shift again, so that products are small, and accumulate count, sums and
cross-products without rounding: in floating point where a bound of the batch's
entries proves that every intermediate sum is a whole number below 2**53, in
integers of arbitrary precision otherwise.  What a task sends is one row for
each limb of 32 bits of each number, so plain long sums merge any number of
tasks exactly.  The driver puts d * (d + 3) / 2 + 1 numbers together (d
dimensions, whatever the number of vectors), forms n X'X - S S' in whole
numbers, and only then divides and decomposes it (eigh).  Eigenvectors are
signed so that their largest component is positive.

Whitened values are measured on all vectors before they are returned:
identity_error is the largest deviation of their covariance from the identity.

Vectors are dropped if they are null, hold null or non-finite entries, or are
not of the length that most vectors have (the longer one of equally frequent
ones), or if an entry is 2**52 or more once scaled.  Repeated rows count each.
A component without variance (at most d times the rounding error of the
largest), as in a table of one vector or of equal ones, has null in `whitened`
and is left out of identity_error, which is null if there is no other.  With fewer than
`components` dimensions there are as many components.  deviation is null where
it does not fit a long.  An empty table gives no rows.  Other columns are not
read; ids may be null or repeat.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.vectors import entries, floors, matrix

SCALE, SHIFT, MOST = 1024, 100_000, 1 << 52
LIMB = 32


def cross_products(v: np.ndarray) -> np.ndarray:
    """v'v of integer vectors, exactly, as Python integers."""
    most = int(np.abs(v).max(initial=0))
    if most * most * len(v) < 1 << 53:
        f = v.astype(np.float64)
        return (f.T @ f).astype(np.int64).astype(object)
    v = v.astype(object)
    return v.T @ v


def limbs(value: int) -> Iterator[tuple[int, int]]:
    """(place, signed limb) of the limbs of an integer that are not zero."""
    sign, value, place = (1 if value >= 0 else -1), abs(value), 0
    while value:
        if low := value & ((1 << LIMB) - 1):
            yield place, sign * low
        value, place = value >> LIMB, place + 1


def scatter(rows: DataFrame, dims: int) -> tuple[int, list[int], list[list[int]]]:
    """(n, sums, cross-products) of the vectors of rows(id, v), each less the shift, exactly."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, products = 0, np.zeros(dims, object), np.zeros((dims, dims), object)
        for batch in batches:
            _, v = floors(matrix(batch.column(1), dims), SCALE, MOST)
            n += len(v)
            sums += v.astype(object).sum(axis=0) if len(v) and int(np.abs(v).max()) * len(v) >= 1 << 62 else v.sum(axis=0).astype(object)
            products += cross_products(v)
        # Row -1 has the sums, and the count in the end.
        numbers = [(-1, dims, n), *((-1, j, sums[j]) for j in range(dims)), *((i, j, products[i, j]) for i in range(dims) for j in range(i, dims))]
        out = [(i, j, place, limb) for i, j, x in numbers for place, limb in limbs(int(x))]
        if out:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.int32(), pa.int32(), pa.int64()), strict=True)], names=["i", "j", "place", "limb"])

    merged = rows.mapInArrow(run, "i int, j int, place int, limb long").groupBy("i", "j", "place").agg(F.sum("limb").alias("limb"))
    sums, products, n = [0] * dims, [[0] * dims for _ in range(dims)], 0
    for r in merged.collect():
        part = r.limb << (LIMB * r.place)
        if r.i >= 0:
            products[r.i][r.j] += part
        elif r.j < dims:
            sums[r.j] += part
        else:
            n += part
    for i in range(dims):
        for j in range(i):
            products[i][j] = products[j][i]
    return n, sums, products


def decompose(n: int, sums: list[int], products: list[list[int]]) -> tuple[np.ndarray, np.ndarray, float]:
    """(falling eigenvalues, unit eigenvectors as columns, trace) of the covariance, of which only the quotients are rounded."""
    dims = len(sums)
    exact = [[n * products[i][j] - sums[i] * sums[j] for j in range(dims)] for i in range(dims)]
    values, vectors = np.linalg.eigh(np.array([[x / (n * n) for x in row] for row in exact]))
    values, vectors = values[::-1], vectors[:, ::-1]
    return values, vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(dims)]), sum(exact[i][i] for i in range(dims)) / (n * n)


def whiten(vectors: DataFrame, components: int = 8, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """A row for each kept row of vectors(id, vector) and each of the first components: whitened value, share of the variance, deviation."""
    rows = vectors.select(F.col(id).alias("id"), entries(vectors, vector).alias("v")).where("v is not null")
    kind = vectors.schema[id].dataType.simpleString()
    columns = f"{id} {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    length = rows.groupBy(F.size("v").alias("d")).count().where("d > 0").orderBy(F.desc("count"), F.desc("d")).first()
    n = 0
    if length:
        dims = length.d
        rows = rows.where(F.size("v") == dims)
        n, sums, products = scatter(rows, dims)
    if not n:
        return vectors.sparkSession.createDataFrame([], columns)
    values, directions, trace = decompose(n, sums, products)
    components = min(components, dims)
    full = int((values[:components] > dims * np.finfo(float).eps * max(values[0], 0)).sum())
    project = directions[:, :full] / np.sqrt(values[:full])
    share = [float(max(v, 0) / trace) if trace else 0.0 for v in values[:components]]

    def centred(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        """(rows kept, n * x - S of them)."""
        good, v = floors(matrix(batch.column(1), dims), SCALE, MOST)
        if (n * int(np.abs(v).max(initial=0)) + max(map(abs, sums))) < 1 << 62:
            return good, n * v - np.array(sums, np.int64)
        return good, n * v.astype(object) - np.array(sums, object)

    def white(away: np.ndarray) -> np.ndarray:
        return (away / n).astype(np.float64) @ project

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((full, full))
        for batch in batches:
            w = white(centred(batch)[1])
            total += w.T @ w
        yield pa.record_batch([pa.array(np.arange(full * full, dtype=np.int32)), pa.array(total.ravel())], names=["k", "s"])

    error = None
    if full:
        found = {r.k: r.s for r in rows.mapInArrow(measure, "k int, s double").groupBy("k").agg(F.sum("s").alias("s")).collect()}
        error = float(max(abs(found[k] / n - (k // full == k % full)) for k in range(full * full)))

    def deviations(away: np.ndarray) -> list[int | None]:
        most = int(np.abs(away).max(initial=0))
        if most * most * dims < 1 << 63:
            return np.einsum("ij,ij->i", away, away).tolist()
        exact = (sum(int(x) ** 2 for x in row) for row in away)
        return [x if x < 1 << 63 else None for x in exact]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good, away = centred(batch)
            m = len(good)
            each = np.repeat(np.arange(m), components)
            w = np.full((m, components), np.nan)
            w[:, :full] = white(away)
            whitened = pa.array(w.ravel(), mask=np.tile(np.arange(components) >= full, m))
            deviation = pa.array(deviations(away), pa.int64()).take(pa.array(each))
            same = lambda value, kind: pa.array([value] * len(each), kind)
            yield pa.record_batch(
                [batch.column(0).take(pa.array(good[each])), pa.array(np.tile(np.arange(1, components + 1, dtype=np.int32), m)), same(n, pa.int64()), deviation, whitened, pa.array(np.tile(share, m), pa.float64()), same(error, pa.float64())],
                names=[c.split()[0] for c in columns.split(", ")],
            )

    return rows.mapInArrow(run, columns)
