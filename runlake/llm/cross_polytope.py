"""Approximate nearest neighbours by cross-polytope hashing.

Vectors are lifted to a sphere and turned by pseudo-rotations, three rounds of random signs and a fast Hadamard
transform; the hash is the nearest signed axis. The index is a written table of every row with its hashes. Queries
go to all tasks in blocks of bounded bytes; each task builds its hash tables over slabs of rows, probes for each
query the nearest few axes of every table, and ranks what it finds by exact distances.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Tables

#: Rotations. How many signed axes a query probes of each is fitted: the least number that finds this share of the true
#: neighbours of at most so many queries, which are searched over all rows. Vectors without any structure need axes
#: that hold about a third of all rows; of clustered ones the first axis or two are enough.
TABLES, RECALL, FITTED = 24, 0.97, 128
#: Rows that a task holds at a time, and bytes of query vectors that are broadcast at a time.
SLAB, BLOCK_BYTES = 65_536, 32 << 20
#: Rows hashed at a time, so that a rotation stays in the processor's cache.
HASHED = 512


def finite(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v array<double>, norm): rows with an id and a vector of finite entries that is not zero."""
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    fine = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where("vec_id IS NOT NULL AND v IS NOT NULL").where(fine)
    return rows.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))).where("norm > 0")


def signs(dims: int, tables: int) -> np.ndarray:
    """Random signs of three rounds for each table; the lifted vectors are padded to a power of two."""
    return np.random.default_rng(12).choice(np.array([-1, 1], np.float32), (tables, 3, 1 << dims.bit_length()))


def turned(x: np.ndarray, rounds: np.ndarray) -> np.ndarray:
    """Columns of x, turned by rounds of signs and Hadamard transforms."""
    for s in rounds:
        x = x * s[:, None]
        half = 1
        while half < len(x):
            pairs = x.reshape(-1, 2, half, x.shape[1])
            x = np.stack([pairs[:, 0] + pairs[:, 1], pairs[:, 0] - pairs[:, 1]], axis=1).reshape(x.shape)
            half *= 2
        x = x / np.float32(np.sqrt(len(x)))
    return x


def lifted(x: np.ndarray, radius: float) -> np.ndarray:
    """Rows of x as unit columns with one more entry, so that those near in Euclidean distance are near on the sphere; longer ones than the radius are shortened to it."""
    norm = np.sqrt(np.einsum("ij,ij->i", x, x))
    scale = 1 / np.maximum(norm, radius)
    out = np.zeros((1 << x.shape[1].bit_length(), len(x)), np.float32)
    out[: x.shape[1]] = (x * scale[:, None]).T
    out[x.shape[1]] = np.sqrt(np.maximum(0, 1 - (norm * scale) ** 2))
    return out


def hashes(x: np.ndarray, radius: float, rounds: np.ndarray) -> np.ndarray:
    """Of each row and table the nearest signed axis: 2 * axis, and 1 more on its negative side."""
    out = np.empty((len(x), len(rounds)), np.int32)
    for at in range(0, len(x), HASHED):
        u = lifted(x[at : at + HASHED], radius)
        for t, r in enumerate(rounds):
            y = turned(u, r)
            axis = np.abs(y).argmax(0)
            out[at : at + HASHED, t] = 2 * axis + (y[axis, np.arange(y.shape[1])] < 0)
    return out


def probes(x: np.ndarray, radius: float, rounds: np.ndarray, most: int) -> np.ndarray:
    """Of each row and table the `most` nearest signed axes, the nearest first."""
    out = np.empty((len(x), len(rounds), most), np.int32)
    for at in range(0, len(x), HASHED):
        u = lifted(x[at : at + HASHED], radius)
        for t, r in enumerate(rounds):
            y = turned(u, r)
            both = np.stack([y, -y], axis=1).reshape(2 * len(y), -1)
            out[at : at + HASHED, t] = np.argsort(-both, axis=0, kind="stable")[:most].T
    return out


def _vectors(column: pa.Array, dims: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(-1, dims)


def _slabs(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Ids, vectors and hashes of up to `SLAB` rows."""
    held: list = []

    def joined():
        return tuple(np.concatenate(parts) for parts in zip(*held, strict=True))

    for batch in batches:
        for at in range(0, batch.num_rows, SLAB):
            part = batch.slice(at, SLAB)
            if held and sum(len(h[0]) for h in held) + part.num_rows > SLAB:
                yield joined()
                held = []
            held.append((np.asarray(part.column("vec_id")), _vectors(part.column("v"), dims), np.asarray(part.column("hashes").flatten(), np.int32).reshape(part.num_rows, -1)))
    if held and sum(len(h[0]) for h in held):
        yield joined()


class HashTables:
    """The rows of a slab by hash, for each table."""

    def __init__(self, codes: np.ndarray):
        self.rows = len(codes)
        self.order = np.argsort(codes, axis=0, kind="stable").astype(np.int32)
        self.starts = [np.append(0, np.cumsum(np.bincount(c, minlength=int(codes.max()) + 1))) for c in codes.T]

    def candidates(self, probed: np.ndarray) -> np.ndarray:
        """Rows in any of the buckets probed of each table."""
        hit = np.zeros(self.rows, bool)
        for t, starts in enumerate(self.starts):
            for bucket in probed[t]:
                if bucket + 1 < len(starts):
                    hit[self.order[starts[bucket] : starts[bucket + 1], t]] = True
        return np.flatnonzero(hit)


class Best:
    """The k nearest candidates of a query so far, ties to the smaller id."""

    def __init__(self, k: int):
        self.k, self.score, self.ids = k, np.empty(0), np.empty(0, np.int64)

    def add(self, q: np.ndarray, rows: np.ndarray, ids: np.ndarray, x: np.ndarray, squares: np.ndarray) -> None:
        if len(self.score) == self.k and len(rows):
            # near enough by products; rounding gets room, and exact distances decide
            q2, top = float(q @ q), self.score[-1] ** 2
            rows = rows[squares[rows] - 2 * (x[rows] @ q) + q2 <= top + 1e-9 * (q2 + top + squares[rows])]
        d = x[rows] - q
        score, own = np.concatenate([self.score, np.sqrt(np.einsum("ij,ij->i", d, d))]), np.concatenate([self.ids, ids[rows]])
        order = np.lexsort((own, score))[: self.k]
        self.score, self.ids = score[order], own[order]


def _search(index: DataFrame, block: tuple, dims: int, k: int) -> DataFrame:
    """The k nearest of each query of the block (ids, vectors, probes or None for every row) over the index."""
    shared = index.sparkSession.sparkContext.broadcast(block)

    def nearest(batches):
        ids, q, probed = shared.value
        best = [Best(k) for _ in ids]
        for own, x, codes in _slabs(batches, dims):
            squares = np.einsum("ij,ij->i", x, x)
            tables = HashTables(codes) if probed is not None else None
            for i, query_id in enumerate(ids):
                rows = tables.candidates(probed[i]) if tables else np.arange(len(own))
                best[i].add(q[i], rows[own[rows] != query_id], own, x, squares)
        at = np.repeat(np.arange(len(ids)), [len(b.ids) for b in best])
        if len(at):
            columns = {"i": at, "query_id": ids[at], "vec_id": np.concatenate([b.ids for b in best]), "score": np.concatenate([b.score for b in best])}
            yield pa.RecordBatch.from_pydict({c: pa.array(v) for c, v in columns.items()})

    found = index.select("vec_id", "v", "hashes").mapInArrow(nearest, "i long, query_id long, vec_id long, score double")
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("i").orderBy("score", "vec_id"))).where(F.col("rank") <= k)


def _fitted_probes(index: DataFrame, asked: DataFrame, dims: int, k: int, radius: float, rounds: np.ndarray, recall: float, fitted: int) -> int:
    """The least number of axes a table that finds a share `recall` of the true neighbours of `fitted` queries, the first by hash."""
    sample = asked.select("vec_id", "v").orderBy(F.xxhash64("vec_id"), "vec_id").limit(fitted).collect()
    ids, q = np.array([r.vec_id for r in sample], np.int64), np.array([r.v for r in sample], np.float64).reshape(-1, dims)
    true = _search(index, (ids, q, None), dims, k).select("i", "vec_id")
    pairs = index.select("vec_id", "hashes").join(F.broadcast(true), "vec_id").collect()  # k rows a query, but for repeated ids
    if not pairs:
        return 1
    # of every pair the place that the neighbour's axis has for the query, in the table where it comes first
    place = np.argsort(probes(q, radius, rounds, 2 * rounds.shape[2]), axis=2)
    needed = [min(place[r.i, np.arange(len(rounds)), r.hashes]) + 1 for r in pairs]
    return int(np.quantile(needed, recall, method="higher"))


def nearest_neighbours(vectors: DataFrame, queries: DataFrame, k: int = 10, tables: int = TABLES, recall: float = RECALL, fitted: int = FITTED, probed: int | None = None) -> DataFrame:
    """query_id, rank from 1, vec_id and score, the Euclidean distance, of the k nearest rows found of each query.

    `vectors` and `queries` are frames of (vec_id, v, norm) as `finite` makes them: null and zero vectors and those
    with null or non-finite entries take no part. A query's own id is no candidate; ties go to the smaller vec_id;
    rows of another number of dimensions than a query take no part in it. Rows that repeat a vec_id are candidates,
    and queries, of their own. Every row is indexed. `probed` axes a table are searched; None fits them. A query whose buckets hold fewer than k rows is searched over
    all rows, so only a table with fewer candidates gives fewer. Empty inputs give no rows; other columns take no
    part. Nothing is dealt by hash, so a bucket with many rows is spread over the tasks as the rows are.
    """
    spark = vectors.sparkSession
    work = Tables(spark, "neighbours")
    schema = "query_id long, rank int, vec_id long, score double"
    found = [spark.createDataFrame([], schema)]
    shapes = queries.groupBy(F.size("v").alias("dims")).agg(F.count("*").alias("n")).collect()
    for dims, n in sorted((r.dims, r.n) for r in shapes):
        rows, asked = (df.where(F.size("v") == dims) for df in (vectors, queries))
        radius = rows.agg(F.percentile_approx("norm", 0.99)).first()[0] or 1.0
        rounds = signs(dims, tables)

        def hashed(batches, dims=dims, radius=radius, rounds=rounds):
            for batch in batches:
                for at in range(0, batch.num_rows, SLAB):
                    part = batch.slice(at, SLAB)
                    codes = hashes(_vectors(part.column("v"), dims), radius, rounds)
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, codes.size + 1, codes.shape[1], dtype=np.int32)), pa.array(codes.ravel()))
                    yield pa.RecordBatch.from_arrays([part.column("vec_id"), part.column("v"), lists], ["vec_id", "v", "hashes"])

        index = work.written(rows.select("vec_id", "v").mapInArrow(hashed, "vec_id long, v array<double>, hashes array<int>"), f"index{dims}")
        axes = probed or _fitted_probes(index, asked, dims, k, radius, rounds, recall, fitted)
        most = max(1, BLOCK_BYTES // (8 * dims))
        blocks = -(-2 * n // most)  # by hash; half full as a rule, and cut where they are not
        for b in range(blocks):
            part = asked.select("vec_id", "v").where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).toArrow()
            part_ids, part_q = part.column("vec_id").to_numpy(), _vectors(part.column("v").combine_chunks(), dims)
            for at in range(0, len(part_ids), most):
                ids, q = part_ids[at : at + most], part_q[at : at + most]
                near = work.written(_search(index, (ids, q, probes(q, radius, rounds, min(axes, 2 * rounds.shape[2]))), dims, k), "near")
                few = np.setdiff1d(np.arange(len(ids)), [r.i for r in near.groupBy("i").count().where(F.col("count") == k).select("i").collect()])
                if len(few):
                    all_rows = work.written(_search(index, (ids[few], q[few], None), dims, k), "all")
                    again = spark.createDataFrame([(int(i),) for i in few], "i long")
                    near = near.join(F.broadcast(again), "i", "left_anti").unionByName(all_rows)
                found.append(near.select("query_id", "rank", "vec_id", "score"))
    out = found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    return work.result(out, "neighbours")
