"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages. Every passage of the whole text is encoded, a gated attention network
(tanh and sigmoid branches) weighs the passages, and the weighted passage representation is scored. Only
document labels are used: the attention weights are learned from them.
"""

from __future__ import annotations

import copy
import itertools
import pickle
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import written

#: Words of a passage; a longer word than so many bytes, as in scripts without blanks, counts as several.
PASSAGE, WORD = 64, 32
#: Character-pair features, besides the shape features.
HASHED = 64
#: The classifier is fitted on at most this many labelled rows, with all their passages: those with the smallest hash of their id.
FIT_ROWS = 3000
#: Fitting: rounds, of which each reads the rows once; rows of a replica, whose weights are averaged after a round; rows of a step; passages that a task holds at a time, but for those of one row.
ROUNDS, REPLICA, STEP, HELD = 20, 1000, 16, 20_000

#: Kinds of bytes: small letters, capitals, digits, stops, other marks, line ends, spaces, parts of non-ASCII letters.
_KINDS = 8
_KIND = np.full(256, 4, np.uint8)
for _kind, _range in ((0, range(97, 123)), (1, range(65, 91)), (2, range(48, 58)), (3, b".,;:"), (5, b"\n\r"), (6, b" \t"), (7, range(128, 256))):
    _KIND[list(_range)] = _kind
_WHITE = (_KIND == 5) | (_KIND == 6)
_WHITE[[11, 12]] = True
_POWERS = np.cumprod(np.full(1024, 0x9E3779B97F4A7C15, np.uint64), dtype=np.uint64)


def word_starts(raw: np.ndarray) -> np.ndarray:
    """Where words begin: after ASCII white space, and every WORD bytes of what is longer."""
    white = _WHITE[raw]
    starts = np.append(0, np.flatnonzero(white[:-1] & ~white[1:]) + 1)
    pieces = -(-np.diff(np.append(starts, len(raw))) // WORD)
    nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    return np.repeat(starts, pieces) + WORD * nth


def encode(text: str | None) -> np.ndarray:
    """One row of features for every run of PASSAGE words: shares of kinds of bytes, word lengths, repetition, hashed byte pairs.

    The whole text is read; an empty or null text is one passage of zeros.
    """
    raw = np.frombuffer(text.encode("utf-8", "replace") if text else b"", np.uint8)
    if not len(raw):
        return np.zeros((1, _KINDS + 7 + HASHED), np.float32)
    at = word_starts(raw)
    of_word = np.arange(len(at)) // PASSAGE
    starts = at[::PASSAGE]
    n = len(starts)
    size, words = np.diff(np.append(starts, len(raw))), np.bincount(of_word, minlength=n)
    of_byte = np.repeat(np.arange(n), size)
    out = np.empty((n, _KINDS + 7 + HASHED), np.float32)
    out[:, :_KINDS] = np.bincount(of_byte * _KINDS + _KIND[raw], minlength=n * _KINDS).reshape(n, _KINDS) / size[:, None]
    lengths = np.diff(np.append(at, len(raw)))
    inside = np.minimum(np.arange(len(raw)) - np.repeat(at, lengths), 1023)
    names = np.add.reduceat((raw.astype(np.uint64) + np.uint64(1)) * _POWERS[inside], at)
    _, which, often = np.unique(names, return_inverse=True, return_counts=True)
    own = np.bincount(np.unique(of_word * len(at) + which) // len(at), minlength=n) / words
    again = np.bincount(of_word, often[which] > 1, n) / words
    mean = np.bincount(of_word, lengths, n) / words
    spread = np.sqrt(np.maximum(0, np.bincount(of_word, lengths.astype(float) ** 2, n) / words - mean**2))
    out[:, _KINDS : _KINDS + 7] = np.stack((own, again, mean / 10, spread / 10, words / PASSAGE, np.full(n, np.log1p(n) / 5), np.ones(n)), 1)
    low = np.where(_KIND[raw] == 1, raw + 32, raw).astype(np.uint32)
    pairs = ((low[:-1] * np.uint32(131) + low[1:]) * np.uint32(2654435761)) >> np.uint32(26)
    out[:, -HASHED:] = np.sqrt(np.bincount(of_byte[:-1] * HASHED + pairs, minlength=n * HASHED).reshape(n, HASHED) / size[:, None])
    return out


@dataclass
class Attention:
    """Gated attention over passages: a = softmax(w . (tanh(V h) * sigmoid(U h))), score = sigmoid(c . sum(a h) + c0)."""

    mean: np.ndarray
    scale: np.ndarray
    p: dict[str, np.ndarray]

    def _forward(self, x: np.ndarray, starts: np.ndarray) -> dict:
        p, size = self.p, np.diff(np.append(starts, len(x)))
        x = (x - self.mean) / self.scale
        h = np.tanh(x @ p["E"] + p["e"])
        v, u = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        raw = (v * u) @ p["w"]
        top = np.repeat(np.maximum.reduceat(raw, starts), size)
        ex = np.exp(raw - top)
        a = ex / np.repeat(np.add.reduceat(ex, starts), size)
        z = np.add.reduceat(a[:, None] * h, starts)
        return {"x": x, "h": h, "v": v, "u": u, "a": a, "z": z, "size": size, "score": 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["c0"], -30, 30)))}

    def score(self, bags: list[np.ndarray]) -> np.ndarray:
        """A score for each document, from all its passages."""
        starts = np.cumsum([0] + [len(b) for b in bags[:-1]])
        return self._forward(np.concatenate(bags), starts)["score"]

    def _gradient(self, x: np.ndarray, starts: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        p, f = self.p, self._forward(x, starts)
        d = (f["score"] - y) * weight / weight.sum()
        g = {"c": f["z"].T @ d, "c0": d.sum(keepdims=True)}
        dz = np.repeat(d[:, None] * p["c"][None, :], f["size"], 0)
        da = (dz * f["h"]).sum(1)
        da -= np.repeat(np.add.reduceat(da * f["a"], starts), f["size"])
        draw = f["a"] * da
        g["w"] = (f["v"] * f["u"]).T @ draw
        dv, du = draw[:, None] * p["w"] * f["u"] * (1 - f["v"] ** 2), draw[:, None] * p["w"] * f["v"] * f["u"] * (1 - f["u"])
        g["V"], g["U"] = f["h"].T @ dv, f["h"].T @ du
        dh = (f["a"][:, None] * dz + dv @ p["V"].T + du @ p["U"].T) * (1 - f["h"] ** 2)
        g["E"], g["e"] = f["x"].T @ dh, dh.sum(0)
        return g


class Adam:
    """Steps of one replica, with the averages they need, over the cross entropy of documents."""

    def __init__(self, net: Attention, state: dict | None = None):
        self.net = net
        zeros = {k: np.zeros_like(x) for k, x in net.p.items()}
        self.m, self.v, self.t = (state["m"], state["v"], state["t"]) if state else (zeros, dict(zeros), 0)

    def step(self, gradient: dict[str, np.ndarray], rate: float) -> None:
        self.t += 1
        for k, g in gradient.items():
            g = g + 1e-4 * self.net.p[k]
            self.m[k], self.v[k] = 0.9 * self.m[k] + 0.1 * g, 0.999 * self.v[k] + 0.001 * g**2
            self.net.p[k] = self.net.p[k] - rate * (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.v[k] / (1 - 0.999**self.t)) + 1e-8)

    def round(self, rows: Iterable[tuple[int, np.ndarray]], weights: tuple[float, float], rate: float, passages: int = HELD) -> int:
        """One pass over rows (label, passages), a step for every STEP of them; returns how many rows it saw.

        The gradient of a step is added up over parts of about `passages`.
        """
        seen, held, total, weight = 0, [], None, 0.0

        def add():
            nonlocal total, weight, held
            if held:
                y = np.array([label for label, _ in held], np.float64)
                w = np.where(y == 1, weights[1], weights[0])
                starts = np.cumsum([0] + [len(b) for _, b in held[:-1]])
                g = self.net._gradient(np.concatenate([b for _, b in held]).astype(np.float64), starts, y, w)
                total, weight, held = {k: g[k] * w.sum() + (0 if total is None else total[k]) for k in g}, weight + w.sum(), []

        def finish():
            nonlocal total, weight
            add()
            if total is not None:
                self.step({k: g / weight for k, g in total.items()}, rate)
                total, weight = None, 0.0

        for row in rows:
            held.append(row)
            seen += 1
            if sum(len(b) for _, b in held) >= passages:
                add()
            if seen % STEP == 0:
                finish()
        finish()
        return seen


def new_net(mean: np.ndarray, scale: np.ndarray, hidden: int = 24, gate: int = 12, seed: int = 7) -> Attention:
    rng, dims = np.random.default_rng(seed), len(mean)
    shapes = {"E": (dims, hidden), "e": (hidden,), "V": (hidden, gate), "U": (hidden, gate), "w": (gate,), "c": (hidden,), "c0": (1,)}
    return Attention(mean, scale, {k: rng.normal(0, 1 / np.sqrt(n[0]), n) if len(n) > 1 or k in "wc" else np.zeros(n) for k, n in shapes.items()})


def label_weights(ones: float) -> tuple[float, float]:
    """Of labels 0 and 1, given the share of 1: the rarer one counts up to the square root of its odds."""
    ones = min(max(ones, 1e-3), 1 - 1e-3)
    return 1 / np.sqrt(1 - ones), 1 / np.sqrt(ones)


def rate_of(round_: int) -> float:
    return 0.01 * 0.5 ** (round_ / 7)


def fit(bags: list[np.ndarray], labels: np.ndarray, hidden: int = 24, gate: int = 12, epochs: int = ROUNDS) -> Attention:
    """The network fitted on documents in memory, in their order: what one replica does."""
    every = np.concatenate(bags).astype(np.float64)
    net = new_net(every.mean(0), every.std(0) + 1e-3, hidden, gate)
    adam = Adam(net)
    for k in range(epochs):
        adam.round(zip(labels, bags, strict=True), label_weights(labels.mean()), rate_of(k))
    return net


def fit_written(bags: DataFrame, rounds: int = ROUNDS, hidden: int = 24, gate: int = 12, passages: int = HELD) -> Attention | None:
    """The network fitted on `bags` (doc_id, y, n, passages) as `encoded` writes them; None without rows.

    Rows are dealt by hash to replicas. In each round a replica takes Adam steps over its rows as they stream by, and
    the driver averages the weights. So the driver holds weights only, and a task some passages more than one row's.
    """
    shape = bags.agg(F.count("*").alias("rows"), F.avg("y").alias("ones")).first()
    if not shape.rows:
        return None
    dims = _KINDS + 7 + HASHED
    spark, replicas, weights = bags.sparkSession, -(-shape.rows // REPLICA), label_weights(shape.ones)

    def matrix(raw: bytes) -> np.ndarray:
        return np.frombuffer(raw, np.float32).reshape(-1, dims)

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, squares = 0, np.zeros(dims), np.zeros(dims)
        for batch in batches:
            for raw in batch.column("passages"):
                x = matrix(raw.as_buffer())
                n, total, squares = n + len(x), total + x.sum(0, np.float64), squares + np.einsum("ij,ij->j", x, x, dtype=np.float64)
        yield pa.RecordBatch.from_pydict({"n": pa.array([n]), "total": pa.array([total.tobytes()]), "squares": pa.array([squares.tobytes()])})

    parts = bags.select("passages").mapInArrow(moments, "n long, total binary, squares binary").collect()  # one row a task
    n = sum(r.n for r in parts)
    mean, squares = (sum(np.frombuffer(r[c]) for r in parts) / n for c in ("total", "squares"))
    net = new_net(mean, np.sqrt(np.maximum(0, squares - mean**2)) + 1e-3, hidden, gate)
    order = F.xxhash64("doc_id", "y", F.lit(1))
    dealt = bags.select(F.pmod(F.xxhash64("doc_id"), F.lit(replicas)).cast("int").alias("replica"), "y", "passages", order.alias("order"))
    dealt = dealt.repartition(replicas, "replica").sortWithinPartitions("replica", "order", "y", F.xxhash64("passages"))
    state = None
    for k in range(rounds):
        shared, rate = spark.sparkContext.broadcast((net, state)), rate_of(k)

        def replica_rounds(batches: Iterator[pa.RecordBatch], shared=shared, rate=rate) -> Iterator[pa.RecordBatch]:
            rows = ((r.as_py(), y.as_py(), matrix(raw.as_buffer())) for batch in batches for r, y, raw in zip(*(batch.column(c) for c in ("replica", "y", "passages")), strict=True))
            for replica, own in itertools.groupby(rows, key=lambda r: r[0]):
                net, state = copy.deepcopy(shared.value)
                adam = Adam(net, state)
                seen = adam.round(((y, x) for _, y, x in own), weights, rate, passages)
                yield pa.RecordBatch.from_pydict({"replica": pa.array([replica]), "seen": pa.array([seen]), "state": pa.array([pickle.dumps((net.p, adam.m, adam.v, adam.t))])})

        ran = sorted(dealt.mapInArrow(replica_rounds, "replica long, seen long, state binary").collect())  # one row a replica
        shares, states = [r.seen / shape.rows for r in ran], [pickle.loads(r.state) for r in ran]
        net.p, m, v = ({name: sum(s * x[i][name] for s, x in zip(shares, states, strict=True)) for name in net.p} for i in range(3))
        state = {"m": m, "v": v, "t": max(x[3] for x in states)}
        shared.unpersist()
    return net


def fit_sample(docs: DataFrame, labels: DataFrame, label: str, allowed, rows: int) -> DataFrame:
    """(doc_id, text, y) of at most `rows` documents whose label may be learned from, those with the smallest hash of doc_id. Repeated label rows count once."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & allowed).groupBy("doc_id").agg(F.max(label).alias("y"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "y")


def score(docs: DataFrame, net: Attention) -> DataFrame:
    """`docs` with `__score` added, from the text alone. Null ids and texts and repeated rows are scored like any other."""
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                bags = [encode(t) for t in batch.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shared.value.score(bags))], [*batch.schema.names, "__score"])

    kept = T.StructType([*docs.schema.fields, T.StructField("__score", T.DoubleType())])
    return docs.mapInArrow(scores, kept)


def encoded(sample: DataFrame) -> DataFrame:
    """(doc_id, y, n, passages) of `sample` (doc_id, text, y): every passage of every row encoded on the executors, as 32-bit numbers."""

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [encode(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), pa.array([len(b) for b in own], pa.int64()), pa.array([b.tobytes() for b in own], pa.binary())], ["doc_id", "y", "n", "passages"])

    return written(sample.select(F.col("doc_id").cast("long"), "text", F.col("y").cast("int")).mapInArrow(bags, "doc_id long, y int, n long, passages binary"), "bags")


def classifier(docs: DataFrame, labels: DataFrame, allowed, label: str = "quality", rows: int = FIT_ROWS, passages: int = HELD) -> Attention | None:
    """The network fitted on all passages of at most `rows` labelled rows; None where no labelled row may be learned from.

    A task holds about `passages` at a time, or those of one row; the driver gets neither texts nor features.
    """
    return fit_written(encoded(fit_sample(docs, labels, label, allowed, rows)), passages=passages)


def with_scores(docs: DataFrame, labels: DataFrame, allowed, label: str = "quality") -> DataFrame:
    """All columns of `docs`, which may have any names, and `__score`; 0.5 where there are no labels to learn from."""
    net = classifier(docs, labels, allowed, label)
    return docs.withColumn("__score", F.lit(0.5)) if net is None else score(docs, net)


def classify(docs: DataFrame, labels: DataFrame, allowed, label: str = "quality") -> DataFrame:
    """doc_id, score, predicted for every row of `docs`, from its text alone.

    Texts of any length and script are read as a whole, in passages; a null or empty text is one passage of zeros.
    Repeated rows are scored alike; without labels to learn from every score is 0.5.
    """
    scored = with_scores(docs.select("doc_id", "text"), labels, allowed, label)
    return scored.select("doc_id", F.col("__score").alias("score"), (F.col("__score") >= 0.5).cast("int").alias("predicted"))
