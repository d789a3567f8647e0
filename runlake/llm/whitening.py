"""Embedding whitening: exact integer moments, components by spectral divide and conquer, a broadcast projection."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Tables
from .spectral import top_components

#: Rows of vectors that a task works on at a time.
SLAB = 2048
#: Entries scaled beyond this count as this, so that sums stay exact.
LARGEST = float(1 << 55)


def integers(df: DataFrame, id_col: str, vector_col: str, scale: int = 64, shift: int = 1_000_000) -> DataFrame:
    """(vec_id, x array<long>): floor(scale * c) + shift of every entry c; rows with null or non-finite entries, or none, are left out."""
    v = F.transform(F.col(vector_col), lambda c: c.cast("double") * scale)
    fine = (F.size("v") > 0) & ~F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))))
    x = F.transform("v", lambda c: F.floor(F.greatest(F.lit(-LARGEST), F.least(F.lit(LARGEST), c))) + F.lit(shift).cast("long"))
    return df.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where(F.col("v").isNotNull() & fine).select("vec_id", x.alias("x"))


def _slabs(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, SLAB):
            part = batch.slice(at, SLAB)
            if part.num_rows:
                yield part, np.asarray(part.column("x").flatten(), np.int64).reshape(-1, dims)


class Centre:
    """The mean of integer vectors, S / n, as its floor and the rest, so that rows lose no digits by centring."""

    def __init__(self, n: int, sums: list[int]):
        self.n = n
        self.floor = np.array([s // n for s in sums], np.int64)
        self.rest = np.array([s % n for s in sums], object)  # n * mean less n * floor
        self.fraction = np.array([(s % n) / n for s in sums])

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.floor).astype(np.float64) - self.fraction

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n * x - S)**2, exact; None beyond the range of a long."""
        moved = x - self.floor
        if float(np.abs(moved).max() + 1) * self.n * np.sqrt(moved.shape[1]) < 2.0**31:
            scaled = moved * self.n - self.rest.astype(np.int64)
            return (scaled * scaled).sum(1).tolist()
        scaled = moved.astype(object) * self.n - self.rest
        return [d if d < 1 << 63 else None for d in (scaled * scaled).sum(1)]


def _sums(fit: DataFrame, dims: int) -> list[int]:
    """The exact sum of each dimension: high and low halves of the numbers are added up apart."""

    def partial(batches):
        high, low = np.zeros(dims, np.int64), np.zeros(dims, np.int64)
        for _, x in _slabs(batches, dims):
            high, low = high + (x >> 32).sum(0), low + (x & 0xFFFFFFFF).sum(0)
        yield pa.RecordBatch.from_pydict({"d": pa.array(np.arange(dims)), "high": pa.array(high), "low": pa.array(low)})

    rows = fit.select("x").mapInArrow(partial, "d long, high long, low long").groupBy("d").agg(F.sum("high").alias("high"), F.sum("low").alias("low")).collect()
    return [(r.high << 32) + r.low for r in sorted(rows, key=lambda r: r.d)]


def _covariance(fit: DataFrame, dims: int, centre: Centre, weights: np.ndarray | None = None) -> np.ndarray:
    """The covariance of centred rows, or of their projections on the rows of `weights`; a task holds one matrix of sums."""
    shared = fit.sparkSession.sparkContext.broadcast((centre, weights))
    size = dims if weights is None else len(weights)

    def partial(batches):
        centre, weights = shared.value
        total = np.zeros((size, size))
        for _, x in _slabs(batches, dims):
            c = centre.centred(x)
            c = c if weights is None else c @ weights.T
            total += c.T @ c
        i, j = np.triu_indices(size)
        yield pa.RecordBatch.from_pydict({"i": pa.array(i), "j": pa.array(j), "s": pa.array(total[i, j])})

    sums = fit.select("x").mapInArrow(partial, "i long, j long, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).toArrow()
    out = np.zeros((size, size))
    i, j, s = (sums.column(c).to_numpy() for c in ("i", "j", "s"))
    out[i, j] = out[j, i] = s / centre.n
    return out


def whiten(vectors: DataFrame, most: int = 16) -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained and identity_error of each row and component.

    `vectors` (vec_id, x) is as `integers` makes it. The fit list is every distinct x once, n in all with sums S;
    copies are taken together before the shuffle. Components are unit eigenvectors of its covariance, by falling
    eigenvalue; directions without variance have none, so at most `most` and at most the rank of the fit list come
    back, and none for equal or no vectors. `deviation` is the sum of (n*x - S)**2, null beyond a long. Rows whose
    number of dimensions is not the most frequent one (of equally frequent ones the largest) take no part. A null
    vec_id stays null, repeated rows stay repeated, other columns take no part. The driver and each task hold
    matrices of dimensions x dimensions, whatever the number of rows.
    """
    spark = vectors.sparkSession
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    shape = vectors.groupBy(F.size("x").alias("dims")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("dims")).first()
    if shape is None:
        return spark.createDataFrame([], schema)
    dims, tables = shape.dims, Tables(spark, "whitening")
    rows = vectors.where(F.size("x") == dims)
    fit = tables.written(rows.select("x").distinct(), "fit")
    n = fit.count()
    centre = Centre(n, _sums(fit, dims))
    covariance = _covariance(fit, dims, centre)
    values, components = top_components(covariance, most)
    if not len(values):
        return spark.createDataFrame([], schema)
    weights = components / np.sqrt(values)[:, None]
    error = float(np.abs(_covariance(fit, dims, centre, weights) - np.eye(len(values))).max())
    shared = spark.sparkContext.broadcast((centre, weights, values / np.trace(covariance)))

    def projected(batches):
        centre, weights, explained = shared.value
        k = len(weights)
        for part, x in _slabs(batches, dims):
            r = len(x)
            whitened = centre.centred(x) @ weights.T
            columns = {
                "vec_id": part.column("vec_id").take(pa.array(np.repeat(np.arange(r), k))),
                "component": pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), r)),
                "n": pa.array(np.full(r * k, centre.n, np.int64)),
                "deviation": pa.array(centre.deviations(x), pa.int64()).take(pa.array(np.repeat(np.arange(r), k))),
                "whitened": pa.array(whitened.ravel()),
                "explained": pa.array(np.tile(explained, r)),
                "identity_error": pa.array(np.full(r * k, error)),
            }
            yield pa.RecordBatch.from_pydict(columns)

    return tables.result(rows.mapInArrow(projected, schema), "whitened")
