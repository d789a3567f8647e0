"""Substring dedup by content-defined chunking.

A gear rolling hash over the bytes of a text sets the cuts, so chunks follow the content and come back into
step after an insertion. Chunks are deduplicated by digest: the first occurrence, by (doc_id, start), stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucketed, n_buckets, with_places

#: A cut where the hash has these bits clear: every 16 bytes on average.
MASK = np.uint32(0b1111 << 12)
#: No cut closer than this to the one before it that the hash proposes; chunks are split at MOST bytes.
LEAST, MOST = 16, 256
#: Runs of repeated chunks are removed from this many bytes on; shorter ones recur by chance.
MIN_RUN = 100
#: Bytes of text that share one packed row of the exchange.
FLUSH = 4 << 20

_GEAR = np.random.default_rng(20).integers(0, 1 << 32, 256, dtype=np.uint32)
_GEAR[0] = 0


def cuts(raw: np.ndarray) -> np.ndarray:
    """Starts of the chunks of a text's bytes. The hash is the sum of G[byte] << age over 16 bytes, summed up by doubling."""
    if not len(raw):
        return np.empty(0, np.int64)
    h = _GEAR[raw]
    for age in (1, 2, 4, 8):
        h[age:] = h[age:] + (h[:-age] << np.uint32(age))
    at = np.flatnonzero((h & MASK) == 0) + 1
    at = at[at < len(raw)]
    gaps = np.diff(at, prepend=0)
    at = np.concatenate(([0], at[gaps >= LEAST]))
    size = np.diff(np.append(at, len(raw)))
    if (size > MOST).any():
        parts = -(-size // MOST)
        at = np.repeat(at, parts) + MOST * (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts))
    return at


def chunk_digests(raw: bytes, starts: np.ndarray) -> np.ndarray:
    """128-bit digests as two columns of 64 bits."""
    ends = np.append(starts[1:], len(raw))
    joined = b"".join([xxhash.xxh3_128_digest(raw[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)])
    return np.frombuffer(joined, np.uint64).reshape(-1, 2)


def _later(new: np.ndarray, doc: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Of places sorted by digest, those that differ from the first of their digest; a repeated row has its own places once more."""
    first = np.flatnonzero(new)[np.cumsum(new) - 1]
    return (doc != doc[first]) | (start != start[first])


class _Slab:
    """Chunks of some documents, of which each digest's first leaves for the exchange."""

    def __init__(self, buckets: int):
        self.buckets, self.bytes = buckets, 0
        self.docs: list[int] = []
        self.starts: list[np.ndarray] = []
        self.digests: list[np.ndarray] = []

    def add(self, doc: int, raw: bytes, starts: np.ndarray) -> None:
        self.docs.append(doc)
        self.starts.append(starts)
        self.digests.append(chunk_digests(raw, starts))
        self.bytes += len(raw)

    def rows(self) -> dict[str, list]:
        doc = np.repeat(np.array(self.docs, np.int64), [len(s) for s in self.starts])
        start, digest = np.concatenate(self.starts), np.concatenate(self.digests)
        order = np.lexsort((start, doc, digest[:, 1], digest[:, 0]))
        doc, start, digest = doc[order], start[order], digest[order]
        new = np.append(True, (digest[1:] != digest[:-1]).any(1))
        later = _later(new, doc, start)
        out: dict[str, list] = {"bucket": [], "doc": [], "start": [], "digest": [], "known": []}
        bucket = (digest[:, 0] % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1):
            first, again = part[new[part]], part[later[part]]
            out["bucket"].append(int(bucket[part[0]]))
            out["doc"].append(doc[first].tobytes())
            out["start"].append(start[first].astype(np.int32).tobytes())
            out["digest"].append(digest[first].tobytes())
            out["known"].append(doc[again].tobytes() + start[again].astype(np.int64).tobytes())
        return out


def _repeats_in_bucket(frame: pd.DataFrame) -> pd.DataFrame:
    """Of the chunks of a bucket, those that occurred before: packed by document."""
    doc = np.concatenate([np.frombuffer(b, np.int64) for b in frame["doc"]])
    start = np.concatenate([np.frombuffer(b, np.int32) for b in frame["start"]]).astype(np.int64)
    digest = np.concatenate([np.frombuffer(b, np.uint64).reshape(-1, 2) for b in frame["digest"]])
    order = np.lexsort((start, doc, digest[:, 1], digest[:, 0]))
    digest = digest[order]
    again = order[_later(np.append(True, (digest[1:] != digest[:-1]).any(1)), doc[order], start[order])] if len(order) else order
    known = [np.frombuffer(b, np.int64).reshape(2, -1) for b in frame["known"]]
    doc = np.concatenate([doc[again], *(k[0] for k in known)])
    start = np.concatenate([start[again], *(k[1] for k in known)])
    order = np.argsort(doc, kind="stable")
    parts = np.split(order, np.flatnonzero(np.diff(doc[order])) + 1) if len(order) else []
    return pd.DataFrame({"doc_id": [int(doc[p[0]]) for p in parts], "starts": [start[p].astype(np.int32).tobytes() for p in parts]})


def repeated_chunks(docs: DataFrame) -> DataFrame:
    """(doc_id, starts): packed 32-bit starts, several rows a document, of chunks whose digest occurred before.

    A slab of documents sends each digest once, with its first place there, so a chunk that a third of all
    documents share is a row per slab and no hot group; its other places in the slab are repeats as they are.
    """
    buckets = n_buckets(docs)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slab = _Slab(buckets)
        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                raw = text.encode("utf-8", "replace") if text else b""
                if raw and doc is not None:
                    slab.add(doc, raw, cuts(np.frombuffer(raw, np.uint8)))
                if slab.bytes >= FLUSH:
                    yield pa.RecordBatch.from_pydict(slab.rows(), schema)
                    slab = _Slab(buckets)
        if slab.docs:
            yield pa.RecordBatch.from_pydict(slab.rows(), schema)

    schema = pa.schema([("bucket", pa.int64()), ("doc", pa.binary()), ("start", pa.binary()), ("digest", pa.binary()), ("known", pa.binary())])
    sent = docs.select("doc_id", "text").mapInArrow(send, "bucket long, doc binary, start binary, digest binary, known binary")
    return bucketed(sent, buckets).applyInPandas(_repeats_in_bucket, "doc_id long, starts binary")


def dedup_substrings(docs: DataFrame, min_run: int = MIN_RUN) -> DataFrame:
    """doc_id, n_chunks, n_repeated, n_bytes, n_removed, text: every document without repeated chunks.

    A chunk is repeated if its digest occurs at a smaller (doc_id, start). Runs of neighbouring repeated
    chunks of at least `min_run` bytes are removed. Null and empty texts have no chunks and come back as they
    are, as do rows without a doc_id. Rows that repeat a doc_id with the same text are one document; further
    texts of an id count as documents after all others.
    A cut within a character (chunks are bytes) drops the split character's remaining bytes.
    """
    docs = with_places(docs)
    facts = repeated_chunks(docs.select(F.col("place").alias("doc_id"), "text")).groupBy(F.col("doc_id").alias("place")).agg(F.collect_list("starts").alias("__repeated"))
    joined = docs.join(facts, "place", "left")

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, text, packed in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                raw = text.encode("utf-8", "replace") if text else b""
                starts = cuts(np.frombuffer(raw, np.uint8))
                repeated = np.isin(starts, np.frombuffer(b"".join(packed or []), np.int32))
                ends = np.append(starts[1:], len(raw))
                edges = np.flatnonzero(np.diff(np.concatenate(([False], repeated, [False])).astype(np.int8)))
                runs = [(starts[a], ends[b - 1]) for a, b in edges.reshape(-1, 2) if ends[b - 1] - starts[a] >= min_run]
                at, kept = 0, []
                for a, b in runs:
                    kept.append(raw[at:a])
                    at = b
                kept.append(raw[at:])
                left = b"".join(kept)
                rows.append((doc, len(starts), int(repeated.sum()), len(raw), len(raw) - len(left), text if not runs else left.decode("utf-8", "ignore")))
            if rows:
                columns = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["doc_id", "n_chunks", "n_repeated", "n_bytes", "n_removed", "text"])

    return joined.select("doc_id", "text", "__repeated").mapInArrow(remove, "doc_id long, n_chunks int, n_repeated int, n_bytes long, n_removed long, text string")
