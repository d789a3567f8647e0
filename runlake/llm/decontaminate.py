"""Benchmark decontamination by pigeonhole edit matching.

A test item with an error budget of k edits is split into k + 1 pieces. A passage within k edits of the
item holds at least one piece unchanged, so exact piece hits (one Aho-Corasick pass over the whole text)
give every candidate place; Myers' bit-parallel algorithm verifies each place.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: One edit (insertion, deletion, substitution of a character) is allowed for every so many characters of an item.
CHARS_PER_EDIT = 12
#: Characters of test items held in a task at a time; larger benchmarks are taken in blocks.
BLOCK_CHARS = 4_000_000

#: Length of the substrings counted before a place is verified: an edit changes at most so many of them.
GRAM = CHARS_PER_EDIT // 2
_MARKS = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256))


def normalized(text: str | None) -> str:
    """Small letters, digits and non-ASCII signs, with single spaces for everything between them."""
    return b" ".join(text.lower().encode("utf-8", "replace").translate(_MARKS).split()).decode() if text else ""


def pieces(item: str, per_edit: int = CHARS_PER_EDIT) -> tuple[int, list[tuple[int, str]]]:
    """The error budget of an item and its k + 1 pieces with their places."""
    k = len(item) // per_edit
    cuts = [len(item) * i // (k + 1) for i in range(k + 2)]
    return k, [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


class Pattern:
    """An item as bit masks for Myers' algorithm; Python's integers hold any length."""

    def __init__(self, item: str):
        self.size, self.masks = len(item), {}
        for i, c in enumerate(item):
            self.masks[c] = self.masks.get(c, 0) | (1 << i)
        self.grams = {item[i : i + GRAM] for i in range(len(item) - GRAM + 1)}
        self.full, self.top = (1 << len(item)) - 1, 1 << (len(item) - 1)

    def near(self, text: str, most: int) -> bool:
        """Whether enough substrings of the item are in `text` for a passage within `most` edits (never wrongly false)."""
        grams = self.grams
        return sum(text[i : i + GRAM] in grams for i in range(len(text) - GRAM + 1)) >= self.size - GRAM + 1 - most * GRAM

    def best(self, text: str, most: int) -> tuple[int, int] | None:
        """(edits, end) of the closest passage of `text` ending first, None if it needs over `most` edits."""
        plus, minus, edits, full, top = self.full, 0, self.size, self.full, self.top
        found, masks, left = None, self.masks, len(text)
        for j, c in enumerate(text):
            eq = masks.get(c, 0)
            diag = ((((eq & plus) + plus) ^ plus) | eq | minus) & full
            up = minus | (~(diag | plus) & full)
            down = plus & diag
            if up & top:
                edits += 1
            elif down & top:
                edits -= 1
            up, down = (up << 1) & full, (down << 1) & full
            plus, minus = down | (~(diag | up) & full), up & diag
            if edits <= most and (found is None or edits < found[0]):
                found, most = (edits, j + 1), edits
            left -= 1
            if edits - left > most:
                break
        return found


class Matcher:
    """All items of a block, ready to be looked for in texts."""

    def __init__(self, items: list[tuple[int, str]]):
        self.items = [(i, t) for i, t in items if t]
        self.patterns: dict[int, Pattern] = {}
        found: dict[str, list[tuple[int, int]]] = {}
        self.budgets = []
        for n, (_, text) in enumerate(self.items):
            k, parts = pieces(text)
            self.budgets.append(k)
            for at, part in parts:
                found.setdefault(part, []).append((n, at))
        self.pieces = ahocorasick.Automaton()
        for part, where in found.items():
            self.pieces.add_word(part, (len(part), where))
        if found:
            self.pieces.make_automaton()

    def matches(self, text: str | None) -> list[tuple[int, int, int, int]]:
        """(item_id, edits, start, end) of the closest passage for each item found; places count in the normalized text."""
        text = normalized(text)
        if not text or not self.items:
            return []
        places: dict[int, set[int]] = {}
        for end, (size, where) in self.pieces.iter(text):
            for n, at in where:
                places.setdefault(n, set()).add(end + 1 - size - at)
        out = []
        for n, starts in places.items():
            (item_id, item), k = self.items[n], self.budgets[n]
            best = None
            for low, high in _ranges(sorted(starts), k):
                low, high = max(0, low - k), min(len(text), high + len(item) + k)
                exact = text.find(item, low, high)
                if exact >= 0:
                    hit = (0, exact + len(item))
                else:
                    pattern = self.patterns.get(n) or self.patterns.setdefault(n, Pattern(item))
                    window = text[low:high]
                    hit = pattern.best(window, k) if pattern.near(window, k) else None
                    hit = hit and (hit[0], hit[1] + low)
                if hit and (best is None or hit < best):
                    best = hit
            if best:
                out.append((item_id, best[0], max(0, best[1] - len(item)), best[1]))
        return out


def _ranges(starts: list[int], k: int) -> Iterator[tuple[int, int]]:
    """Neighbouring starts together, so that places that overlap are verified once."""
    low = high = starts[0]
    for s in starts[1:]:
        if s - high > 2 * k + 1:
            yield low, high
            low = s
        high = s
    yield low, high


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of a bounded size, one on the driver at a time."""
    items = benchmark.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-2 * total // BLOCK_CHARS))
    for b in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b)
        yield sorted((r.item_id, normalized(r.text)) for r in part.collect())


def find_matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, edits, start, end): the closest passage of every document for every test item within its budget.

    One row for each pair, `start` and `end` in the normalized text; `start` is as if the passage were as long
    as the item. Items and documents that are null or empty after normalizing match nothing; repeated items
    with the same id give their closest match; repeated documents give a row each. Map-only over documents.
    """
    spark = docs.sparkSession
    out = spark.createDataFrame([], "doc_id long, item_id long, edits int, start long, end long")
    for items in _blocks(benchmark):
        shared = spark.sparkContext.broadcast(items)

        def match(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(shared.value)
            for batch in batches:
                rows = []
                for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                    closest: dict[int, tuple] = {}
                    for item, *hit in matcher.matches(text):
                        closest[item] = min(closest.get(item, (1 << 30,)), tuple(hit))
                    rows += [(doc, item, *hit) for item, hit in closest.items()]
                if rows:
                    doc, item, edits, start, end = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(item, pa.int64()), pa.array(edits, pa.int32()), pa.array(start, pa.int64()), pa.array(end, pa.int64())], ["doc_id", "item_id", "edits", "start", "end"])

        out = out.unionByName(docs.select("doc_id", "text").mapInArrow(match, out.schema))
    return out


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents, all columns kept, that hold no test item within its budget; needs the columns of `docs` only."""
    spark = docs.sparkSession
    for items in _blocks(benchmark):
        shared = spark.sparkContext.broadcast(items)

        def keep(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(shared.value)
            for batch in batches:
                fine = np.array([not matcher.matches(t) for t in batch.column("text").to_pylist()], bool)
                yield batch.filter(pa.array(fine))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs
