"""Rows that repeat an id, ids that are null, and columns with clashing names, by operator."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_ops import best_fit_decreasing, table, words

from runlake.llm import chunks, common, decontaminate, lines, ngram_join, packing, queries, repeats, topk_search


def test_repeated_vectors(spark):
    rng = np.random.default_rng(8)
    v = rng.normal(size=(40, 4))
    rows = [(i % 30, [float(x) for x in r], "s", 1, 2) for i, r in enumerate(v)]  # ids 0 to 9 twice, with other vectors
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string, rank int, i int")
    q = topk_search.quantized(df, "vec_id", "embedding")
    ints = np.floor(1024 * v.astype(np.float32).astype(np.float64)).astype(np.int64)
    want = []
    for at in (0, 10, 20, 30):
        best = sorted((-int(ints[j] @ ints[at]), j % 30) for j in range(40) if j % 30 != at % 30)[:5]
        want += [(at % 30, k + 1, j, -s) for k, (s, j) in enumerate(best)]
    got = topk_search.top_k(q, q.where(F.col("vec_id") % 10 == 0), 5, block=3)
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_rows_without_an_id(spark):
    """They take no part in finding repeats and lose nothing."""
    common.small_batches(spark)
    text = words(random.Random(3), 120)
    docs = spark.createDataFrame([(None, text), (1, text), (2, text), (None, None)], "doc_id long, text string")
    assert sorted((str(r.doc_id), r.n_removed) for r in chunks.dedup_substrings(docs).collect()) == [("1", 0), ("2", len(text)), ("None", 0), ("None", 0)]
    assert sorted((str(r.doc_id), r.n_removed) for r in repeats.dedup_repeats(docs).collect()) == [("1", 0), ("2", len(text)), ("None", 0), ("None", 0)]
    assert sorted(map(tuple, ngram_join.join_components(docs).select("doc_id", "component_id").collect())) == [(1, 1), (2, 1)]
    assert lines.drop_recurring_lines(docs).where("doc_id IS NULL AND n_dropped > 0").count() == 0


def test_repeated_rows_of_the_suffix_arrays(spark):
    common.small_batches(spark)
    rng = random.Random(5)
    a, b = words(rng, 80), words(rng, 80)
    docs = spark.createDataFrame([(1, a + b), (1, a + b), (2, b), (3, None), (3, None), (3, "")], "doc_id long, text string").coalesce(1)
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans) for r in repeats.dedup_repeats(docs).collect())
    assert got == [(1, len(a + b), 0, 0), (1, len(a + b), 0, 0), (2, len(b), len(b), 1), (3, 0, 0, 0), (3, 0, 0, 0), (3, 0, 0, 0)]


def test_different_texts_of_one_id(spark):
    """A text loses nothing because another text of its id repeats."""
    common.small_batches(spark)
    rng = random.Random(6)
    own, copied = words(rng, 90), words(rng, 90)
    docs = spark.createDataFrame([(1, own), (1, copied), (1, copied), (2, copied), (9, own[:50])], "doc_id long, text string").coalesce(1)
    for run in (repeats.dedup_repeats, chunks.dedup_substrings):
        got = sorted((r.doc_id, r.n_bytes, r.n_removed > 0) for r in run(docs).collect())
        assert len(got) == 5 and not any(gone for d, n, gone in got if n == len(own) != len(copied))
        # two of the three rows that hold the copied text go, or the other document's
        assert sum(gone for _, n, gone in got if n == len(copied)) in (1, 2)


def test_repeated_rows_and_long_texts_of_decontamination(spark):
    common.small_batches(spark)
    rng = random.Random(7)
    item = words(rng, 30)
    long = words(rng, 150_000)
    docs = spark.createDataFrame([(1, f"x {item} y"), (1, f"x {item} y"), (2, long + " " + item), (3, long), (4, None)], "doc_id long, text string").withColumn("item_id", F.lit("own"))
    bench = spark.createDataFrame([(5, item), (5, item)], "item_id long, text string")
    assert {r.doc_id for r in decontaminate.find_matches(docs, bench).collect()} == {1, 2}
    assert sorted(r.doc_id for r in decontaminate.clean(docs, bench).collect()) == [3, 4]


def test_repeated_rows_are_packed_each(spark):
    common.small_batches(spark)
    text = words(random.Random(9), 700)
    docs = spark.createDataFrame([(1, text), (1, text), (None, text), (2, "")], "doc_id long, text string").withColumn("length", F.lit("own"))
    rows = packing.pack_documents(docs, *queries.tokenizer_file(), capacity=256).collect()
    per = [r for r in rows if r.doc_id == 1]
    assert len(per) == 2 * len({r.piece for r in per}) and len(rows) == 3 * len({r.piece for r in per}) + 1
    assert len({(r.sequence_id, r.offset) for r in rows}) == len(rows)
    (empty,) = [r for r in rows if r.doc_id == 2]
    assert (empty.length, empty.ids_crc32) == (1, zlib.crc32(b"\0\0\0\0"))


def triples(rng, n, capacity):
    """Sizes that fill n bins exactly, three a bin, all of about a third: hard for best fit."""
    out = []
    for _ in range(n):
        a = rng.randrange(capacity * 26 // 100, capacity * 40 // 100)
        b = rng.randrange(capacity * 26 // 100, capacity * 40 // 100)
        out += [a, b, capacity - a - b]
    return out


def test_the_search_beats_best_fit_decreasing():
    """Islands with migration need fewer bins than best-fit decreasing, where that needs too many."""
    better = 0
    for seed in range(4):
        sizes = np.array(sorted(triples(random.Random(seed), 40, 1000), reverse=True), np.int32)
        plain = best_fit_decreasing(sizes.tolist(), 1000)
        islands = [[], []]
        for turn in range(packing.ROUNDS):
            islands = [packing.evolve(sizes, population, 1000, 10 * seed + i + 100 * turn) for i, population in enumerate(islands)]
            islands = [[islands[1 - i][0], *own[: packing.POPULATION - 1]] for i, own in enumerate(islands)]
        found = min(int(p.max()) + 1 for own in islands for p in own)
        assert found <= plain
        better += found < plain
    assert better >= 3


@pytest.mark.parametrize("clash", ("bucket", "line", "text_a", "__drop_"))
def test_lines_with_clashing_columns(spark, clash):
    texts = ["a line that many documents share here", "own\na line that many documents share here", "more\na line that many documents share here", None]
    docs = table(spark, texts).withColumn(clash, F.lit(3))
    got = lines.drop_recurring_lines(docs).orderBy("doc_id").collect()
    assert [r[clash] for r in got] == [3] * 4 and [r.text for r in got] == ["a line that many documents share here", "own", "more", None]
