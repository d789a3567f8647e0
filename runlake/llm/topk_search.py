"""Exact top-k search by distributed histogram selection.

Every (query, candidate) pair is scored. Passes over the candidates refine, for each query, a global
histogram of scores until the bin holding the k-th best score is one score wide; a last pass keeps
only rows at or above that score and breaks ties by id. Queries are taken in blocks of a fixed size,
so what is broadcast is bounded whatever the number of queries.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Queries in a block: what is broadcast at a time is at most BLOCK * dimensions * 8 bytes.
BLOCK = 2048
BINS = 1024
#: Candidates scored at a time in a task.
SLAB = 512


def quantized(df: DataFrame, id_col: str, vector_col: str, scale: int = 1024) -> DataFrame:
    """(vec_id long, q array<double>): floor(scale * x) of finite vectors; null or non-finite ones are left out."""
    v = F.col(vector_col)
    q = F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("double"))
    fine = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return df.where(F.col(id_col).isNotNull() & v.isNotNull()).where(fine).select(F.col(id_col).cast("long").alias("vec_id"), q.alias("q"))


def _slabs(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and vectors of candidates that have as many dimensions as the queries."""
    for batch in batches:
        for at in range(0, batch.num_rows, SLAB):
            part = batch.slice(at, SLAB)
            lists = part.column("q")
            same = np.asarray(lists.value_lengths()) == dims
            ids = np.asarray(part.column("vec_id"))[same]
            if len(ids):
                flat = np.asarray(lists.filter(pa.array(same)).flatten(), dtype=np.float64)
                yield ids, flat.reshape(len(ids), dims)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, block: int = BLOCK) -> DataFrame:
    """The k best candidates of each query by integer inner product: query_id, rank, vec_id, score.

    `vectors` and `queries` are frames of (vec_id, q) as `quantized` makes them. A query's own id is no
    candidate. Ties go to the smaller vec_id, with fewer than k candidates all are returned, and rows with
    another number of dimensions than a query take no part in it. Every row is a candidate of its own, also
    where rows repeat a vec_id, and every query row has a result of its own: repeated ones come back repeated. Inner products are exact while they stay
    under 2**53. Empty inputs give no rows. Work is queries times candidates, as the contract asks.
    """
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score long"
    out = spark.createDataFrame([], schema)
    # one row a query: its block by rank in id order within ranges, without a global sort in one task
    heads = queries.select(F.col("vec_id").alias("query_id"), F.size("q").alias("dims"), "q")
    shapes = [(r.dims, r.n) for r in heads.groupBy("dims").agg(F.count("*").alias("n")).collect()]
    for dims, n in sorted(shapes):
        blocks = max(1, -(-n // (block // 2)))
        for b in range(blocks):
            rows = heads.where((F.col("dims") == dims) & (F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)).collect()
            for at in range(0, len(rows), block):
                out = out.unionByName(_one_block(vectors, rows[at : at + block], dims, k))
    return out


def _one_block(vectors: DataFrame, rows: list, dims: int, k: int) -> DataFrame:
    spark = vectors.sparkSession
    ids = np.array([r.query_id for r in rows], np.int64)
    q = np.array([r.q for r in rows], np.float64).reshape(len(rows), dims)
    shared = spark.sparkContext.broadcast((ids, q))

    def extent(batches):
        ids, q = shared.value
        low, high, n = np.full(len(ids), np.inf), np.full(len(ids), -np.inf), 0
        for cand, x in _slabs(batches, dims):
            s = q @ x.T
            own = ids[:, None] == cand[None, :]
            low, high, n = np.minimum(low, np.where(own, np.inf, s).min(1)), np.maximum(high, np.where(own, -np.inf, s).max(1)), n + len(cand) - own.sum(1)
        some = np.isfinite(low)
        if some.any():
            yield pa.RecordBatch.from_pydict({"i": pa.array(np.flatnonzero(some)), "low": low[some].astype(np.int64), "high": high[some].astype(np.int64), "n": (np.zeros(len(ids), np.int64) + n)[some]})

    low, high, count = np.zeros(len(ids), np.int64), np.full(len(ids), -1, np.int64), np.zeros(len(ids), np.int64)
    for r in vectors.mapInArrow(extent, "i long, low long, high long, n long").groupBy("i").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n")).collect():
        low[r.i], high[r.i], count[r.i] = r.low, r.high, r.n
    left = np.minimum(k, count)  # still to find among scores in [low, high]

    while (wide := (high > low)).any():
        width = np.maximum(1, -(-(high - low + 1) // BINS))
        state = spark.sparkContext.broadcast((low, high, width, wide))

        def histogram(batches, state=state):
            ids, q = shared.value
            low, high, width, wide = state.value
            rows = np.flatnonzero(wide)
            total = np.zeros((len(rows), BINS), np.int64)
            for cand, x in _slabs(batches, dims):
                s = (q[rows] @ x.T).astype(np.int64)
                bins = (s - low[rows, None]) // width[rows, None]
                ok = (s >= low[rows, None]) & (s <= high[rows, None]) & (ids[rows, None] != cand[None, :])
                at, _ = np.nonzero(ok)
                total += np.bincount(at * BINS + bins[ok], minlength=total.size).reshape(total.shape)
            at, bin_ = np.nonzero(total)
            yield pa.RecordBatch.from_pydict({"i": pa.array(rows[at]), "bin": pa.array(bin_), "n": pa.array(total[at, bin_])})

        above = Window.partitionBy("i").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)
        need = spark.createDataFrame([(int(i), int(left[i])) for i in np.flatnonzero(wide)], "i long, need long")
        bins = vectors.mapInArrow(histogram, "i long, bin long, n long").groupBy("i", "bin").agg(F.sum("n").alias("n"))
        kth = bins.withColumn("upto", F.sum("n").over(above)).join(F.broadcast(need), "i").where((F.col("upto") >= F.col("need")) & (F.col("upto") - F.col("n") < F.col("need")))
        for r in kth.collect():  # one row a query of the block
            left[r.i] -= r.upto - r.n
            low[r.i] += r.bin * width[r.i]
            high[r.i] = min(high[r.i], low[r.i] + width[r.i] - 1)
    found = spark.sparkContext.broadcast((low, np.flatnonzero(count > 0)))

    def winners(batches):
        ids, q = shared.value
        kth, rows = found.value
        best: dict[int, list] = {}
        for cand, x in _slabs(batches, dims):
            s = (q[rows] @ x.T).astype(np.int64)
            ok = (s >= kth[rows, None]) & (ids[rows, None] != cand[None, :])
            for j in np.flatnonzero(ok.any(1)):
                i, mine = int(rows[j]), ok[j]
                both = best.get(i, []) + list(zip((-s[j, mine]).tolist(), cand[mine].tolist(), strict=True))
                best[i] = sorted(both)[:k]
        rows_ = [(i, int(ids[i]), v, -s) for i, pairs in best.items() for s, v in pairs]
        if rows_:
            columns = (pa.array(c, pa.int64()) for c in zip(*rows_, strict=True))
            yield pa.RecordBatch.from_arrays(list(columns), ["i", "query_id", "vec_id", "score"])

    # by the query's place in the block, not its id, which may be repeated
    order = Window.partitionBy("i").orderBy(F.desc("score"), "vec_id")
    kept = vectors.mapInArrow(winners, "i long, query_id long, vec_id long, score long")
    return kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
