"""Best-fit packing by a grouping genetic algorithm.

Pieces of documents are dealt into shards of bounded size. Islands of a shard each evolve packings: an
offspring takes whole well-filled bins of one parent, loses the other parent's bins that hold the same
pieces, and best-fits the displaced ones. Elites migrate between islands through a shuffle. The loosest
bins of many shards are then packed together once more, so that shards cost next to no room.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .tokens import token_ids

#: Pieces of a shard, about.
SHARD = 4096
#: Shards whose loosest bins are packed together.
GATHERED = 64
ISLANDS, ROUNDS, POPULATION, OFFSPRING = 2, 3, 4, 12
#: Bins tried, and displaced pieces paired, in the exchange of one crossover.
EXCHANGED = 64


def pieces_of(docs: DataFrame, tokenizer_json: str, pattern: str | None, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): the ids of every whole text and the end id, cut where longer than `capacity`. A null text is empty."""
    shared = docs.sparkSession.sparkContext.broadcast((tokenizer_json, pattern))
    end = np.array([end_id], "<u4")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = token_ids(*shared.value)
        for batch in batches:
            rows = []
            for doc, own in zip(batch.column("doc_id").to_pylist(), ids.batch(batch.column("text")), strict=True):
                all_ids = np.append(own, end).tobytes()
                for n, at in enumerate(range(0, len(all_ids), 4 * capacity)):
                    part = all_ids[at : at + 4 * capacity]
                    rows.append((doc, n, at // 4, len(part) // 4, zlib.crc32(part)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(sizes: np.ndarray, items: np.ndarray, bins: np.ndarray, fill: list[int], capacity: int) -> None:
    """Puts `items`, largest first, each into the fullest bin with room; `bins` and `fill` are changed."""
    room = sorted((capacity - f, b) for b, f in enumerate(fill) if f < capacity)
    for i in items[np.lexsort((items, -sizes[items]))].tolist():
        size = int(sizes[i])
        at = bisect_left(room, (size, -1))
        if at < len(room):
            left, b = room.pop(at)
        else:
            left, b = capacity, len(fill)
            fill.append(0)
        bins[i] = b
        fill[b] += size
        if left > size:
            insort(room, (left - size, b))


def dense(bins: np.ndarray) -> np.ndarray:
    return np.unique(bins, return_inverse=True)[1].astype(np.int32)


def fitness(sizes: np.ndarray, bins: np.ndarray, capacity: int) -> tuple[int, float]:
    """Fewer bins first; then the more uneven their fill, the easier one is emptied."""
    fill = np.bincount(bins, sizes)
    return len(fill), -float(np.square(fill / capacity).mean())


def exchange(sizes: np.ndarray, bins: np.ndarray, displaced: list[int], capacity: int, rng: np.random.Generator) -> list[int]:
    """Bins give up one or two pieces for displaced ones that fill them better; what is displaced then is smaller and easier to place.

    Some bins with room are tried, each for its best exchange; `bins` is changed and the pieces now displaced are given.
    """
    placed = np.flatnonzero(bins >= 0)
    room = capacity - np.bincount(bins[placed], sizes[placed]).astype(int)
    tried = rng.permutation(np.flatnonzero(room > 0))[:EXCHANGED]
    out = np.zeros(len(room), bool)
    out[tried] = True
    own: dict[int, list[int]] = {}
    for i in placed[out[bins[placed]]].tolist():
        own.setdefault(int(bins[i]), []).append(i)
    loose = sorted((int(sizes[i]), i) for i in displaced)
    for b in tried.tolist():
        best, gives, takes = 0, (), ()
        some = own[b][:8]
        pool = loose[-EXCHANGED:]
        for given in [(i,) for i in some] + [(i, j) for k, i in enumerate(some) for j in some[k + 1 :]]:
            held = int(sizes[list(given)].sum())
            most = held + int(room[b])
            at = bisect_right(loose, (most, len(sizes))) - 1
            if at >= 0 and loose[at][0] - held > best:
                best, gives, takes = loose[at][0] - held, given, (at,)
            for first in range(len(loose) - len(pool), len(loose)) if len(given) == 2 and best < room[b] else ():
                at = bisect_right(loose, (most - loose[first][0], len(sizes)), 0, first) - 1
                if at >= 0 and loose[first][0] + loose[at][0] - held > best:
                    best, gives, takes = loose[first][0] + loose[at][0] - held, given, (first, at)
        if best:
            for at in takes:  # the later place first
                bins[loose.pop(at)[1]] = b
            for i in gives:
                bins[i] = -1
                insort(loose, (int(sizes[i]), i))
    return [i for _, i in loose]


def crossover(sizes: np.ndarray, mother: np.ndarray, father: np.ndarray, capacity: int, rng: np.random.Generator) -> np.ndarray:
    """The mother with whole well-filled bins of the father injected; displaced pieces are exchanged for those of other bins, then best-fitted."""
    fill = np.bincount(father, sizes)
    good = np.flatnonzero(fill >= np.quantile(fill, 0.5))
    chosen = np.zeros(len(fill), bool)
    chosen[rng.choice(good, max(1, int(len(good) * rng.uniform(0.1, 0.4))), replace=False)] = True
    injected = chosen[father]
    hit = np.zeros(mother.max() + 1, bool)
    hit[mother[injected]] = True
    # the mother's loosest bins are opened too: those are what the search has to empty
    own = np.bincount(mother, sizes)
    hit[np.argsort(own)[: max(2, len(own) // 50)]] = True
    displaced = np.flatnonzero(hit[mother] & ~injected)
    child = mother.copy()
    child[injected] = father[injected] + len(hit)
    keep = np.ones(len(child), bool)
    keep[displaced] = False
    child[keep] = dense(child[keep])
    child[displaced] = -1
    left = np.array(exchange(sizes, child, displaced.tolist(), capacity, rng) if keep.any() else displaced, np.int64)
    keep = child >= 0
    fill = np.bincount(child[keep], sizes[keep]).astype(int).tolist() if keep.any() else []
    best_fit(sizes, left, child, fill, capacity)
    return dense(child)


def evolve(sizes: np.ndarray, population: list[np.ndarray], capacity: int, seed: int) -> list[np.ndarray]:
    """One island for OFFSPRING children; ends at once with a packing that needs no bin too many."""
    rng, least = np.random.default_rng(seed), -(-int(sizes.sum()) // capacity)
    while len(population) < POPULATION:
        bins, order = np.zeros(len(sizes), np.int32), np.argsort(-sizes * rng.uniform(0.97 if population else 1, 1, len(sizes)), kind="stable")
        fill: list[int] = []
        if population:  # noise in the order makes another packing
            for part in np.array_split(order, 8):
                best_fit(sizes, part, bins, fill, capacity)
        else:
            best_fit(sizes, order, bins, fill, capacity)
        population = [*population, dense(bins)]
        if bins.max() + 1 <= least:
            break
    population = sorted(population, key=lambda b: fitness(sizes, b, capacity))
    for _ in range(OFFSPRING):
        if population[0].max() + 1 <= least or len(population) < 2:
            break
        a, b = sorted(rng.choice(len(population), 2, replace=False).tolist())
        child = crossover(sizes, population[a], population[b], capacity, rng)
        population = sorted([*population, child], key=lambda x: fitness(sizes, x, capacity))[:POPULATION]
    return population


_STATE = "shard long, island int, uids binary, sizes binary, packings binary"


def _evolved(state: DataFrame, capacity: int, turn: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                sizes = np.frombuffer(row["sizes"], np.int32)
                old = np.frombuffer(row["packings"], np.int32).reshape(-1, len(sizes))
                new = evolve(sizes, [dense(x) for x in old], capacity, (row["shard"] * 31 + row["island"]) * 17 + turn)
                yield pa.RecordBatch.from_pylist([row | {"packings": np.concatenate(new).astype(np.int32).tobytes()}], batch.schema)

    return state.mapInArrow(run, _STATE)


def _migrated(frame: pd.DataFrame) -> pd.DataFrame:
    """Each island's elite replaces the worst packing of the next island."""
    frame = frame.sort_values("island").reset_index(drop=True)
    packings = [np.frombuffer(p, np.int32).reshape(-1, len(s) // 4) for p, s in zip(frame["packings"], frame["sizes"], strict=True)]
    moved = [np.concatenate([packings[i - 1][:1], own[: POPULATION - 1]]).tobytes() for i, own in enumerate(packings)]
    return frame.assign(packings=moved)


def _gathered(frame: pd.DataFrame) -> pd.DataFrame:
    """The pieces of a shard as one row an island."""
    frame = frame.sort_values(["length", "uid"], ascending=[False, True])
    uids, sizes = frame["uid"].to_numpy(np.int64).tobytes(), frame["length"].to_numpy(np.int32).tobytes()
    n = len(frame)
    islands = ISLANDS if n > 1 else 1
    return pd.DataFrame({"shard": [int(frame["shard"].iloc[0])] * islands, "island": range(islands), "uids": [uids] * islands, "sizes": [sizes] * islands, "packings": [b""] * islands})


def _packed(items: DataFrame, capacity: int) -> DataFrame:
    """(uid, length, shard, bin, offset, loose) of (uid, length, shard): the best packing any island of the shard found."""
    state = items.groupBy("shard").applyInPandas(_gathered, _STATE)
    for turn in range(ROUNDS):
        state = _evolved(state.repartition("shard", "island"), capacity, turn)
        if turn + 1 < ROUNDS:
            state = state.groupBy("shard").applyInPandas(_migrated, _STATE)

    def best(frame: pd.DataFrame) -> pd.DataFrame:
        sizes = np.frombuffer(frame["sizes"].iloc[0], np.int32)
        bins = min((np.frombuffer(p, np.int32)[: len(sizes)] for p in frame.sort_values("island")["packings"]), key=lambda b: fitness(sizes, b, capacity))
        order = np.argsort(bins, kind="stable")
        ends = np.cumsum(sizes[order])
        fill = np.bincount(bins, sizes)
        offset = np.empty(len(sizes), np.int64)
        offset[order] = ends - sizes[order] - np.repeat(np.concatenate(([0], np.cumsum(fill)[:-1])), np.bincount(bins)).astype(np.int64)
        loose = np.isin(bins, np.argsort(fill, kind="stable")[: max(1, len(fill) // 200)])
        return pd.DataFrame({"uid": np.frombuffer(frame["uids"].iloc[0], np.int64), "length": sizes.astype(np.int64), "shard": int(frame["shard"].iloc[0]), "bin": bins.astype(np.int64), "offset": offset, "loose": loose})

    return state.groupBy("shard").applyInPandas(best, "uid long, length long, shard long, bin long, offset long, loose boolean")


def pack(pieces: DataFrame, capacity: int = 2048, shard: int = SHARD) -> DataFrame:
    """`pieces` (any columns, with `length` from 1 to `capacity`) and sequence_id, offset for each.

    Pieces of the full length are sequences by themselves. Every piece is placed, ties are broken by the
    place in the written table, and repeated rows are pieces of their own. No pieces give no rows.
    """
    spark = pieces.sparkSession
    numbered = written(pieces.withColumn("__uid", F.monotonically_increasing_id()), "pieces")
    small = numbered.where(F.col("length") < capacity)
    n = max(1, -(-small.count() // shard))
    items = small.select(F.col("__uid").alias("uid"), "length", F.pmod(F.xxhash64("__uid"), F.lit(n)).alias("shard"))
    first = _packed(items, capacity)
    if n > 1:
        first = written(first, "packed")
        again = first.where("loose").select("uid", "length", F.pmod(F.xxhash64("shard"), F.lit(-(-n // GATHERED))).alias("shard"))
        second = _packed(again, capacity).select("uid", (F.lit(1 << 61) + F.shiftleft("shard", 24) + F.col("bin")).alias("sequence_id"), "offset")
        first = first.where(~F.col("loose"))
    placed = first.select("uid", (F.shiftleft("shard", 24) + F.col("bin")).alias("sequence_id"), "offset")
    placed = placed.unionByName(second) if n > 1 else placed
    full = numbered.where(F.col("length") >= capacity).withColumns({"sequence_id": F.lit(1 << 62) + F.col("__uid"), "offset": F.lit(0).cast("long")})
    return small.join(placed.withColumnRenamed("uid", "__uid"), "__uid").select(*pieces.columns, "sequence_id", "offset").unionByName(full.select(*pieces.columns, "sequence_id", "offset"))


def pack_documents(docs: DataFrame, tokenizer_json: str, pattern: str | None = None, capacity: int = 2048) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece of every document."""
    return pack(pieces_of(docs, tokenizer_json, pattern, capacity), capacity)
