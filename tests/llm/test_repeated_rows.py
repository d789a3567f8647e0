"""Substring dedup of rows that repeat a doc_id."""

import random

import pytest

from runlake.llm import chunks, common


@pytest.mark.parametrize("flush", (1, 1 << 20))
def test_a_repeated_row_is_no_repeat_of_itself(spark, monkeypatch, flush):
    common.small_batches(spark)
    monkeypatch.setattr(chunks, "FLUSH", flush)
    rng = random.Random(3)
    text = "".join(chr(rng.randrange(97, 123)) for _ in range(2000))
    docs = spark.createDataFrame([(1, text), (1, text), (2, text)], "doc_id long, text string").coalesce(1)
    got = sorted((r.doc_id, r.n_repeated, r.n_removed, r.text) for r in chunks.dedup_substrings(docs).collect())
    n = len(chunks.cuts(chunks.np.frombuffer(text.encode(), chunks.np.uint8)))
    assert got == [(1, 0, 0, text), (1, 0, 0, text), (2, n, 2000, "")]
