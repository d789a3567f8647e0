"""Exact substring dedup over a suffix array in parts.

Every window of LENGTH bytes holds an anchor: the gram of GRAM bytes with the smallest hash in it. Equal
windows have equal anchors at equal distances, so windows only need to be compared within an anchor's group.
The windows of one anchor are one segment of text. Equal segments are found by digest; different segments
of one anchor go, as text, to one task, which sorts their suffixes, scans the longest common prefixes with
a stack (the interval tree of the enhanced suffix array), tests each interval for different left
extensions and reports maximal repeats with all occurrences. Windows of an anchor with very many different
segments are spread by their own digest instead, so no anchor is a hot group.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucketed, mix, n_buckets, with_places, written

LENGTH = 100
GRAM = 20
#: From so many different segments on, an anchor's windows are spread by digest.
HOT = 2000
#: Bytes of text that share one packed row of an exchange; bytes of a text searched at a time.
FLUSH, BLOCK = 6 << 20, 8 << 20
#: Bytes of segments whose suffixes are sorted at a time.
SORTED = 4 << 20

_VALUE = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_FACTOR = 0x9E3779B97F4A7C15

#: An occurrence of a segment: document, first window, last window.
OCCURRENCE = np.dtype([("gram", "<u8"), ("digest", "<u8"), ("doc", "<i8"), ("low", "<u4"), ("high", "<u4")])
OPEN = np.dtype([("gram", "<u8"), ("low", "<u4"), ("high", "<u4"), ("hot", "<u4")])
SPAN = np.dtype([("start", "<u4"), ("end", "<u4")])


def grams(raw: np.ndarray, size: int = GRAM) -> np.ndarray:
    """A hash of the `size` bytes from each place on, by doubling: of n + m bytes from those of n and m."""
    have, width = _VALUE[raw], 1
    out, done = None, 0
    while size:
        if size & 1:
            part = have[done:] if done else have
            out = part if out is None else out[: len(part)] * np.uint64(pow(_FACTOR, width, 1 << 64)) + part[: len(out)]
            done += width
        size >>= 1
        if size:
            have = have[:-width] * np.uint64(pow(_FACTOR, width, 1 << 64)) + have[width:]
            width *= 2
    return mix(out, 5)


def segments(raw: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(gram hash of the anchor, first window, last window) of each run of windows with the same anchor."""
    found = [[np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)]]
    for at in range(0, len(raw) - length + 1, BLOCK):
        part = raw[at : at + BLOCK + length - 1]
        h = grams(part, gram)
        # the smallest of each `length - gram + 1` neighbours, leftmost of equals: hash above, place below
        key = (h >> np.uint64(24) << np.uint64(24)) | np.arange(len(h), dtype=np.uint64)
        width, least = length - gram + 1, key
        have = 1
        while have * 2 <= width:
            least = np.minimum(least[:-have], least[have:])
            have *= 2
        if have < width:
            least = np.minimum(least[: len(least) - (width - have)], least[width - have :])
        anchor = (least & np.uint64(0xFFFFFF)).astype(np.int64)
        first = np.append(0, np.flatnonzero(np.diff(anchor)) + 1)
        last = np.append(first[1:], len(anchor)) - 1
        found.append([h[anchor[first]], first + at, last + at])
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _by_bucket(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(bucket, kind="stable")
    if len(order):
        for part in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1):
            yield int(bucket[part[0]]), part


def _repeated(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of occurrences in the order of (gram, digest, doc, low): which start their segment's list, and which repeat its first."""
    new = np.append(True, (rows["gram"][1:] != rows["gram"][:-1]) | (rows["digest"][1:] != rows["digest"][:-1]))
    head = rows[new][np.cumsum(new) - 1]
    return new, ~new & ((rows["doc"] != head["doc"]) | (rows["low"] != head["low"]))


def _sorted(rows: np.ndarray) -> np.ndarray:
    return rows[np.lexsort((rows["low"], rows["doc"], rows["digest"], rows["gram"]))]


def _per_doc(doc: np.ndarray, items: np.ndarray) -> Iterator[tuple[int, bytes]]:
    for d, part in _by_bucket(doc):
        yield d, items[part].tobytes()


def _spans(low: np.ndarray, high: np.ndarray, length: int) -> np.ndarray:
    out = np.empty(len(low), SPAN)
    out["start"], out["end"] = low, high + length
    return out


def _first_pass(docs: DataFrame, buckets: int, length: int) -> DataFrame:
    """(doc, spans, open): bytes known to be repeated, and segments whose windows are yet to be compared."""

    def rows_of(parts: list[np.ndarray]) -> dict[str, list]:
        rows = _sorted(np.concatenate(parts))
        new, again = _repeated(rows)
        out: dict[str, list] = {"bucket": [], "rows": [], "doc": [], "spans": []}
        first = rows[new]
        for b, part in _by_bucket((first["gram"] % np.uint64(buckets)).astype(np.int64)):
            out["bucket"].append(b)
            # column by column, so that the numbers that repeat compress
            out["rows"].append(b"".join(np.ascontiguousarray(first[part][name]).tobytes() for name in OCCURRENCE.names))
            out["doc"].append(0)
            out["spans"].append(None)
        same = rows[again]
        for doc, spans in _per_doc(same["doc"], _spans(same["low"], same["high"], length)):
            out["bucket"].append(doc % buckets)
            out["rows"].append(None)
            out["doc"].append(doc)
            out["spans"].append(spans)
        return out

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                raw = text.encode() if text else b""
                if doc is None or len(raw) < length:
                    continue
                gram, low, high = segments(np.frombuffer(raw, np.uint8), length)
                own = np.empty(len(gram), OCCURRENCE)
                own["gram"], own["doc"], own["low"], own["high"] = gram, doc, low, high
                own["digest"] = np.fromiter((xxhash.xxh3_64_intdigest(raw[a : b + length]) for a, b in zip(low.tolist(), high.tolist(), strict=True)), np.uint64, len(gram))
                parts.append(own)
                size += len(raw)
                if size >= FLUSH:
                    yield pa.RecordBatch.from_pydict(rows_of(parts), schema)
                    parts, size = [], 0
        if parts:
            yield pa.RecordBatch.from_pydict(rows_of(parts), schema)

    def merge(frame: pd.DataFrame) -> pd.DataFrame:
        out = [(int(doc), spans, b"") for doc, spans in zip(frame["doc"], frame["spans"], strict=True) if spans is not None]
        packed = [b for b in frame["rows"] if b is not None]
        if packed:
            parts = []
            for b in packed:
                n = len(b) // OCCURRENCE.itemsize
                own, at = np.empty(n, OCCURRENCE), 0
                for name in OCCURRENCE.names:
                    kind = OCCURRENCE[name]
                    own[name] = np.frombuffer(b, kind, n, at)
                    at += n * kind.itemsize
                parts.append(own)
            rows = _sorted(np.concatenate(parts))
            new, again = _repeated(rows)
            same = rows[again]
            out += [(doc, spans, b"") for doc, spans in _per_doc(same["doc"], _spans(same["low"], same["high"], length))]
            first = rows[new]
            of_gram = np.cumsum(np.append(True, first["gram"][1:] != first["gram"][:-1])) - 1
            many = np.bincount(of_gram)[of_gram]
            left = first[many > 1]
            open_ = np.empty(len(left), OPEN)
            open_["gram"], open_["low"], open_["high"], open_["hot"] = left["gram"], left["low"], left["high"], many[many > 1] >= HOT
            out += [(doc, b"", packed_) for doc, packed_ in _per_doc(left["doc"], open_)]
        return pd.DataFrame(out, columns=["doc", "spans", "open"])

    schema = pa.schema([("bucket", pa.int64()), ("rows", pa.binary()), ("doc", pa.int64()), ("spans", pa.binary())])
    sent = docs.select("doc_id", "text").mapInArrow(send, "bucket long, rows binary, doc long, spans binary")
    return written(bucketed(sent, buckets).applyInPandas(merge, "doc long, spans binary, open binary"), "segments")


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if a[:mid] == b[:mid] else (low, mid)
    return low


def _intervals(suffixes: list[tuple[bytes, object]], least: int) -> Iterator[tuple[int, int, int]]:
    """(length, first, last) of every interval of sorted suffixes with a common prefix of at least `least` bytes, by a stack."""
    stack: list[tuple[int, int]] = []
    for right, (here, _) in enumerate(suffixes):
        lcp = common_prefix(here, suffixes[right + 1][0]) if right + 1 < len(suffixes) else 0
        lcp, left = lcp if lcp >= least else 0, right
        while stack and stack[-1][0] > lcp:
            length, left = stack.pop()
            yield length, left, right
        if lcp and (not stack or stack[-1][0] < lcp):
            stack.append((lcp, left))


def maximal_repeats(texts: list[bytes], windows: list[int], least: int) -> Iterator[tuple[int, list[tuple[int, int]]]]:
    """(length, occurrences (text, place)) of the maximal repeats of at least `least` bytes among suffixes of `texts`.

    `windows` is the number of places of each text, from 0 on, whose suffixes count. The suffix array is sorted in
    two steps. By a hash of their first `least` bytes, for all suffixes at once: what shares that prefix becomes
    adjacent, and shorter repeats are not wanted. Then within such a run by what follows. A stack over the longest
    common prefixes of a run yields the tree of its intervals; an interval is reported if its occurrences have
    different bytes on their left, the start of a text being like no other. A run whose bytes on the left are all
    the same holds no such interval.
    """
    size = np.array([len(t) for t in texts], np.int64)
    counted = np.clip(np.minimum(np.array(windows, np.int64), size - least + 1), 0, None)
    if not counted.sum():
        return
    start = np.cumsum(size) - size
    raw = np.frombuffer(b"".join(texts), np.uint8)
    text = np.repeat(np.arange(len(texts)), counted)
    at = np.arange(len(text)) - np.repeat(np.cumsum(counted) - counted, counted)
    place = start[text] + at
    prefix = grams(raw, least)[place]
    order = np.argsort(prefix)
    prefix = prefix[order]
    run = np.flatnonzero(np.append(True, prefix[1:] != prefix[:-1]))
    length = np.diff(np.append(run, len(prefix)))
    run, length = run[length > 1], length[length > 1]
    if not len(run):
        return
    # the suffixes of these runs, one after another
    shared = order[np.repeat(run - np.cumsum(length) + length, length) + np.arange(length.sum())]
    head = np.cumsum(length) - length
    left = np.where(at[shared] > 0, raw[place[shared] - 1].astype(np.int64), 256 + np.arange(len(shared)))
    diverse = np.minimum.reduceat(left, head) != np.maximum.reduceat(left, head)
    text, at, left = text[shared].tolist(), at[shared].tolist(), left.tolist()
    for a, n in zip(head[diverse].tolist(), length[diverse].tolist(), strict=True):
        suffixes = sorted((texts[text[i]][at[i] :], i) for i in range(a, a + n))
        for common, first, last in _intervals(suffixes, least):
            own = [i for _, i in suffixes[first : last + 1]]
            if len({left[i] for i in own}) > 1:
                yield common, [(text[i], at[i]) for i in own]


def _second_pass(docs: DataFrame, facts: DataFrame, buckets: int, length: int) -> DataFrame:
    """(doc, spans) found among the open segments."""
    open_ = facts.where(F.length("open") > 0).groupBy("doc").agg(F.collect_list("open").alias("open"))
    wanted = docs.select(F.col("doc_id").alias("doc"), "text").join(open_.hint("merge"), "doc")

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("bucket", "doc", "gram", "low", "windows", "text", "digests")}
            digests, docs_, lows = [], [], []

            def put(**row):
                for k in out:
                    out[k].append(row.get(k, 0 if k == "doc" else None))

            for doc, text, packed in zip(*(batch.column(c).to_pylist() for c in ("doc", "text", "open")), strict=True):
                raw = text.encode() if text else b""
                rows = np.frombuffer(b"".join(packed), OPEN)
                for gram, low, high, hot in rows.tolist():
                    if hot:
                        digests += [xxhash.xxh3_128_digest(raw[p : p + length]) for p in range(low, high + 1)]
                        docs_ += [doc] * (high + 1 - low)
                        lows += range(low, high + 1)
                    else:
                        put(bucket=gram % buckets, doc=doc, gram=gram - (1 << 63), low=low, windows=high - low + 1, text=raw[low : high + length])
            if digests:
                rows = np.empty(len(digests), OCCURRENCE)
                pairs = np.frombuffer(b"".join(digests), "<u8").reshape(-1, 2)
                rows["gram"], rows["digest"], rows["doc"], rows["low"], rows["high"] = pairs[:, 0], pairs[:, 1], docs_, lows, lows
                rows = _sorted(rows)
                new, again = _repeated(rows)
                first, same = rows[new], rows[again]
                for b, part in _by_bucket((first["gram"] % np.uint64(buckets)).astype(np.int64)):
                    put(bucket=b, digests=first[part].tobytes())
                for doc, spans in _per_doc(same["doc"], _spans(same["low"], same["high"], length)):
                    put(bucket=doc % buckets, doc=doc, text=spans)
            yield pa.RecordBatch.from_pydict(out, schema)

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        out = [(int(doc), spans) for doc, gram, spans in zip(frame["doc"], frame["gram"], frame["text"], strict=True) if spans is not None and pd.isna(gram)]
        packed = [b for b in frame["digests"] if b is not None]
        found: dict[int, list[tuple[int, int]]] = {}
        if packed:
            rows = _sorted(np.frombuffer(b"".join(packed), OCCURRENCE))
            same = rows[_repeated(rows)[1]]
            out += list(_per_doc(same["doc"], _spans(same["low"], same["high"], length)))
        texts = frame[frame["gram"].notna()].sort_values("gram")
        gram, doc, low, windows = (texts[c].to_numpy(np.int64) for c in ("gram", "doc", "low", "windows"))
        own = texts["text"].to_numpy(object)
        # some anchors at a time, none of them in parts
        ends = np.append(np.flatnonzero(np.diff(gram)) + 1, len(gram)) if len(gram) else []
        done, filled = 0, np.cumsum([len(t) for t in own])
        for end in ends:
            if end < len(own) and filled[end - 1] - (filled[done - 1] if done else 0) < SORTED:
                continue
            where = list(zip(doc[done:end].tolist(), low[done:end].tolist(), strict=True))
            for size, places in maximal_repeats(list(own[done:end]), windows[done:end], length):
                places = [(where[i][0], where[i][1] + at) for i, at in places]
                first = min(places)
                for d, start in places:
                    if (d, start) != first:
                        found.setdefault(d, []).append((start, start + size))
            done = end
        out += [(d, np.array(sorted(set(spans)), SPAN).tobytes()) for d, spans in found.items()]
        return pd.DataFrame(out, columns=["doc", "spans"])

    schema = pa.schema([("bucket", pa.int64()), ("doc", pa.int64()), ("gram", pa.int64()), ("low", pa.int64()), ("windows", pa.int64()), ("text", pa.binary()), ("digests", pa.binary())])
    sent = wanted.mapInArrow(send, "bucket long, doc long, gram long, low long, windows long, text binary, digests binary")
    return bucketed(sent, buckets).applyInPandas(compare, "doc long, spans binary")


def removed_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, spans): packed spans of bytes, several rows a document, that an earlier equal string of `length` bytes covers."""
    buckets = n_buckets(docs)
    facts = _first_pass(docs, buckets, length)
    known = facts.where(F.length("spans") > 0).select("doc", "spans")
    return known.unionByName(_second_pass(docs, facts, buckets, length)).withColumnRenamed("doc", "doc_id")


def dedup_repeats(docs: DataFrame, length: int = LENGTH, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and `kept`, the remaining bytes, with `with_text`).

    A byte is removed if a string of `length` bytes that covers it also starts at a smaller (doc_id, start) in
    the input. Null texts are empty, texts shorter than `length` lose nothing, and rows without a doc_id take
    no part and lose nothing. Rows that repeat a doc_id with the same text are one document; further texts of an
    id count as documents after all others.
    """
    docs = with_places(docs)
    spans = removed_spans(docs.select(F.col("place").alias("doc_id"), "text"), length).groupBy(F.col("doc_id").alias("place")).agg(F.collect_list("spans").alias("__spans"))
    joined = docs.join(spans, "place", "left").select("doc_id", "text", "__spans")

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, text, packed in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                raw = text.encode() if text else b""
                spans = np.sort(np.frombuffer(b"".join(packed or []), SPAN), order="start")
                at, kept, n = 0, [], 0
                end = 0
                for a, b in spans.tolist():
                    if a > end or not n:
                        kept.append(raw[end:a])
                        n += 1
                    end = max(end, b)
                at = b"".join([*kept, raw[end:]])
                rows.append((doc, len(raw), len(raw) - len(at), n, hashlib.sha256(at).hexdigest(), at))
            if rows:
                columns = zip(*rows, strict=True)
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
                arrays = [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays[: 6 if with_text else 5], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: 6 if with_text else 5])

    return joined.mapInArrow(remove, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text)
