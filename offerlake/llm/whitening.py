"""Whitening of integer vectors from an exact covariance: digit slices multiplied by BLAS, recombined as big integers."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import one_core, slices

#: An entry c becomes floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 64, 1_000_000
#: What floor(SCALE * c) is cut to, so that differences of two stay within 64 bits.
FAR = 1 << 61
#: Bits of a slice and rows of a product: sums of 2**ROWS products of two slices need 53 bits, which float64 has.
BITS, ROWS = 20, 13
_SUMS = pa.schema([("i", pa.int32()), ("sums", pa.list_(pa.string()))])


def _integers(batch: pa.RecordBatch, dim: int) -> np.ndarray:
    """floor(SCALE * c) as int64, a row for each vector; SHIFT is left out, as it takes part in no difference."""
    values = np.asarray(batch.column("vector").flatten()).reshape(batch.num_rows, dim)
    with np.errstate(over="ignore"):
        return np.clip(np.floor(values * SCALE), -FAR, FAR).astype(np.int64)


def _big(x: np.ndarray) -> np.ndarray:
    return x.astype(object)


def _sum(y: np.ndarray) -> np.ndarray:
    """Exact sums of the columns."""
    low = y & 0xFFFFFFFF
    return _big(low.sum(0)) + (_big((y >> 32).sum(0)) << 32)


def _slices_of(z: np.ndarray) -> list[np.ndarray]:
    """Slices of BITS bits, the lowest first; the last has the sign. Small numbers are one slice."""
    out = []
    while z.size and max(int(z.max()), -int(z.min())) > 1 << BITS:
        out.append((z & ((1 << BITS) - 1)).astype(np.float64))
        z = z >> BITS
    return [*out, z.astype(np.float64)]


def gram(z: np.ndarray) -> np.ndarray:
    """z.T @ z in exact integers, for any int64 z."""
    total = _big(np.zeros((z.shape[1], z.shape[1]), np.int64))
    for start in range(0, len(z), 1 << ROWS):
        parts = _slices_of(z[start : start + (1 << ROWS)])
        for p, a in enumerate(parts):
            for q in range(p, len(parts)):
                product = _big((a.T @ parts[q]).astype(np.int64))
                total = total + ((product if p == q else product + product.T) << (BITS * (p + q)))
    return total


def _partial_sums(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[pa.RecordBatch]:
    total = _big(np.zeros(dim, np.int64))
    for batch in slices(batches, "vector"):
        total = total + _sum(_integers(batch, dim))
    yield pa.RecordBatch.from_pydict({"i": [0], "sums": [list(map(str, total))]}, _SUMS)


def _partial_grams(batches: Iterator[pa.RecordBatch], mean: np.ndarray) -> Iterator[pa.RecordBatch]:
    one_core()
    dim = len(mean)
    total = _big(np.zeros((dim, dim), np.int64))
    for batch in slices(batches, "vector"):
        total = total + gram(_integers(batch, dim) - mean)
    for i in range(dim):
        yield pa.RecordBatch.from_pydict({"i": [i], "sums": [list(map(str, total[i, i:]))]}, _SUMS)


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals: dict[int, list[int]] = {}  # as many as there are dimensions
    for batch in batches:
        for i, sums in zip(batch.column("i").to_pylist(), batch.column("sums").to_pylist()):
            sums = list(map(int, sums))
            totals[i] = [a + b for a, b in zip(totals[i], sums)] if i in totals else sums
    for i, sums in totals.items():
        yield pa.RecordBatch.from_pydict({"i": [i], "sums": [list(map(str, sums))]}, _SUMS)


def _exact_sums(rows: DataFrame, made) -> dict[int, list[int]]:
    """Sums by row i over all tasks: a task gives each row once, rows meet by i, and only totals come to the driver."""
    schema = "i int, sums array<string>"
    return {r.i: list(map(int, r.sums)) for r in rows.select("vector").mapInArrow(made, schema).repartition("i").mapInArrow(_merged, schema).collect()}


def vectors(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, vector as doubles) of the rows whose vector is not null and has finite entries only."""
    vector = F.col(vector_col).cast("array<double>")
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    return df.select(F.col(id_col).alias("id"), vector.alias("vector")).where(F.col("vector").isNotNull() & ~F.exists("vector", bad))


@dataclass
class Whitening:
    """What fit() finds; everything has the size of one vector or of the dimensions' square."""

    dim: int
    n: int
    mean: np.ndarray  # integers next to the true means of floor(SCALE * c)
    rest: list[int]  # sums of the differences from them
    values: np.ndarray  # eigenvalues, falling
    axes: np.ndarray  # a unit eigenvector in each column
    trace: float
    identity_error: float | None = None

    @property
    def explained(self) -> list[float]:
        return [float(e / self.trace) if self.trace else 0.0 for e in self.values]

    @property
    def sums(self) -> list[int]:
        """The sums of the integers x, SHIFT included."""
        return [r + self.n * (int(m) + SHIFT) for r, m in zip(self.rest, self.mean)]

    def directions(self) -> np.ndarray:
        """Eigenvectors over the root of their eigenvalue; zero for those without variance."""
        return self.axes * np.where(self.values > 0, 1 / np.sqrt(np.where(self.values > 0, self.values, 1.0)), 0.0)

    def whiten(self, z: np.ndarray) -> np.ndarray:
        return (z - np.array([r / self.n for r in self.rest])) @ self.directions()

    def deviations(self, z: np.ndarray) -> pa.Array:
        """Sum over dimensions of (n * x - S)**2 for each row, exact; null beyond 38 digits."""
        n, most = self.n, max(1, int(np.abs(z).max(initial=0)))
        far = n * most + max(map(abs, self.rest), default=0)
        if self.dim * far * far < 1 << 63:
            return pa.array(((n * z - np.array(self.rest, np.int64)) ** 2).sum(1), pa.int64()).cast(pa.decimal128(38, 0), safe=False)
        if self.dim * most * most < 1 << 63 and self.dim * most << BITS < 1 << 63:
            squares, crossed, shift, rest = _big((z * z).sum(1)), 0, 0, self.rest
            while any(rest):
                low = [r if -1 <= r >> BITS <= 0 else r & ((1 << BITS) - 1) for r in rest]
                crossed = crossed + (_big((z * np.array(low, np.int64)).sum(1)) << shift)
                rest, shift = [(r - x) >> BITS for r, x in zip(rest, low)], shift + BITS
            exact = squares * (n * n) - crossed * (2 * n) + sum(r * r for r in self.rest)
        else:
            exact = ((_big(z) * n - np.array(self.rest, object)) ** 2).sum(1)
        return pa.array([Decimal(x) if x < 10**38 else None for x in exact], pa.decimal128(38, 0))

    def _rows(self, df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
        return vectors(df, id_col, vector_col).where(F.size("vector") == self.dim)

    def transform(self, df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
        """(id, deviation decimal(38,0), whitened array<double>) of each row that fit() would take."""
        rows, key = self._rows(df, id_col, vector_col), df.schema[id_col].dataType
        schema = f"id {key.simpleString()}, deviation decimal(38,0), whitened array<double>"
        return rows.mapInArrow(partial(_transformed, model=self), schema).withColumnRenamed("id", id_col)


def _transformed(batches: Iterator[pa.RecordBatch], model: Whitening) -> Iterator[pa.RecordBatch]:
    one_core()
    k = len(model.values)
    for batch in slices(batches, "vector", 8 << 20):
        z = _integers(batch, model.dim) - model.mean
        made = pa.ListArray.from_arrays(np.arange(0, batch.num_rows * k + 1, k, dtype=np.int32) if k else np.zeros(batch.num_rows + 1, np.int32), model.whiten(z).ravel())
        yield pa.RecordBatch.from_arrays([batch.column("id"), model.deviations(z), made], ["id", "deviation", "whitened"])


def _partial_products(batches: Iterator[pa.RecordBatch], model: Whitening) -> Iterator[pa.RecordBatch]:
    """Sums of whitened values (j = -1) and of their products, of one task."""
    one_core()
    k = len(model.values)
    first, second = np.zeros(k), np.zeros((k, k))
    for batch in slices(batches, "vector"):
        w = model.whiten(_integers(batch, model.dim) - model.mean)
        first, second = first + w.sum(0), second + w.T @ w
    i, j = np.triu_indices(k)
    yield pa.RecordBatch.from_pydict(
        {"i": pa.array([*range(k), *i], pa.int32()), "j": pa.array([-1] * k + [*j], pa.int32()), "total": pa.array([*first, *second[i, j]], pa.float64())}
    )


def fit(df: DataFrame, components: int = 32, id_col: str = "vec_id", vector_col: str = "embedding") -> Whitening:
    """The whitening of all vectors of df: eigenvectors of the covariance of x = floor(64 * c) + 1000000, divisor n.

    Three passes over the vectors, which are never shuffled: sums; products of the differences from the nearest integer to
    the mean; and the covariance of the whitened values. Differences are split into slices of 20 bits and multiplied in
    float64 by at most 8,192 rows, so that no product rounds; slices are put together as integers without bound, a task gives
    one row of sums for each dimension, and these meet by dimension. So n**2 times the covariance is exact, and one
    division rounds each entry before the driver's eigendecomposition (its size is the dimensions' square). Each
    eigenvector's largest entry is made positive.

    Rows with a null vector, or null or non-finite entries, are left out, as are vectors whose length is not the most
    frequent one (the longer of two as frequent). Integers beyond 2**61 count as 2**61. Repeated rows count each; null
    ids are ids; other columns are ignored. Directions without variance have whitened values of 0 and take no part in
    identity_error, the largest absolute entry of the whitened values' covariance minus the identity. An empty table gives a model
    without components.
    """
    rows = vectors(df, id_col, vector_col)
    most = rows.groupBy(F.size("vector").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    dim, n = (most["dim"], most["count"]) if most else (0, 0)
    if not dim:
        return Whitening(0, n, np.zeros(0, np.int64), [], np.zeros(0), np.zeros((0, 0)), 0.0)
    rows = rows.where(F.size("vector") == dim)
    sums = _exact_sums(rows, partial(_partial_sums, dim=dim))[0]
    mean = [(2 * s + n) // (2 * n) for s in sums]
    rest = [s - n * m for s, m in zip(sums, mean)]
    mean = np.array(mean, np.int64)
    products = _exact_sums(rows, partial(_partial_grams, mean=mean))
    covariance = np.zeros((dim, dim))
    for i, found in products.items():
        for j, g in enumerate(found, i):
            covariance[i, j] = covariance[j, i] = (n * g - rest[i] * rest[j]) / (n * n)
    values, axes = np.linalg.eigh(covariance)
    k = min(components, dim)
    values, axes = values[::-1][:k].copy(), axes[:, ::-1][:, :k]
    values[values <= dim * np.finfo(float).eps * max(values[0], 0.0)] = 0.0
    axes = axes * np.sign(axes[np.abs(axes).argmax(0), np.arange(k)])
    model = Whitening(dim, n, mean, rest, values, axes, float(np.trace(covariance)))
    parts = rows.select("vector").mapInArrow(partial(_partial_products, model=model), "i int, j int, total double")
    found = {(r.i, r.j): r.total / n for r in parts.groupBy("i", "j").agg(F.sum("total").alias("total")).collect()}
    used = [i for i in range(k) if values[i] > 0]
    model.identity_error = max((abs(found[i, j] - found[i, -1] * found[j, -1] - (i == j)) for i in used for j in used if i <= j), default=0.0)
    return model
