"""Bounds of the n-gram join on pairs that the rounds before them leave."""

import random

import pytest

from runlake.llm import common, ngram_join

from test_ops import naive_components, shingle_set


def components(spark, rows):
    common.small_batches(spark)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return {r.doc_id: r.component_id for r in ngram_join.join_components(docs).collect()}


def components_without_stars(spark, monkeypatch, rows):
    monkeypatch.setattr(ngram_join, "STARS", 1 << 62)
    return components(spark, rows)


def edited(rng, base, edits):
    words = list(base)
    for at in rng.sample(range(len(words)), edits):
        kind = rng.random()
        words[at] = "" if kind < 0.2 else f"n{rng.randrange(40)}" if kind < 0.5 else f"n{rng.randrange(10**9)}"
    return " ".join(w for w in words if w)


def test_unequal_nested_sets_are_linked(spark, monkeypatch):
    """A text and a copy with a passage added, around the threshold."""
    texts = []
    for k in range(150):
        base = [f"b{k}x{i}" for i in range(30 + k % 40)]
        texts += [" ".join(base), " ".join([*base, *(f"e{k}x{i}" for i in range((len(base) - 4) // 3 - k % 4 + 1))])]
    want = naive_components({i: shingle_set(t) for i, t in enumerate(texts)})
    assert 0 < sum(i != c for i, c in want.items()) < 150
    assert components_without_stars(spark, monkeypatch, list(enumerate(texts))) == want


def test_every_text_of_a_repeated_id_is_linked(spark, monkeypatch):
    rows = []
    for k in range(0, 60, 2):
        base = [f"b{k}x{i}" for i in range(60)]
        rows += [(k, " ".join(base)), (k, " ".join(f"l{k}x{i}" for i in range(400))), (k + 1, " ".join([*base, "more", "words"]))]
    assert components_without_stars(spark, monkeypatch, rows) == {i: i - i % 2 for i in range(60)}


def test_rows_of_a_repeated_id_keep_their_own_sizes(spark):
    common.small_batches(spark)
    long, short = " ".join(f"l{i}" for i in range(50)), " ".join(f"s{i}" for i in range(20))
    rows = [(5, long), (5, short), (5, short), (5, None), (2, short), (9, long + " more"), (None, long), (7, "")]
    got = ngram_join.join_components(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(tuple(r) for r in got.select("doc_id", "n_shingles", "component_id").collect()) == [(2, 16, 2), (5, 0, 2), (5, 16, 2), (5, 16, 2), (5, 46, 2), (7, 0, 7), (9, 47, 2)]


@pytest.mark.parametrize("frequent", (1_000_000, 0))
def test_a_large_group_around_the_threshold(spark, monkeypatch, frequent):
    """Copies of one text with more and more edits, many of them just below the threshold, with and without known frequencies."""
    monkeypatch.setattr(ngram_join, "FREQUENT_MOST", frequent)
    rng = random.Random(11)
    base = [f"b{i}" for i in range(90)]
    texts = [" ".join(base)] + [edited(rng, base, rng.choice((1, 2, 3, 4, 5, 5, 5, 6, 7))) for _ in range(350)]
    texts += [edited(rng, texts[i].split(), 1) for i in range(0, 350, 7)]
    want = naive_components({i: shingle_set(t) for i, t in enumerate(texts)})
    alone = sum(i == c for i, c in want.items())
    assert 25 < alone < 300
    run = components(spark, list(enumerate(texts))) if frequent else components_without_stars(spark, monkeypatch, list(enumerate(texts)))
    assert run == want


def test_few_pairs_of_a_large_group_are_candidates(spark):
    """Copies that differ from one another by shingles of their own never meet, however many they are."""
    rng = random.Random(5)
    base = [f"b{i}" for i in range(150)]
    made = {}
    for n in (200, 800):
        texts = [edited(rng, base, 9) for _ in range(n)]
        sets = [sorted(shingle_set(t)) for t in texts]
        often = {}
        for s in sets:
            for x in s:
                often[x] = often.get(x, 0) + 1
        names = {x: i for i, x in enumerate(sorted(often, key=lambda x: (often[x], x)))}
        listed, facts = [], []
        for d, s in enumerate(sets):
            mine = sorted(map(names.__getitem__, s))[: ngram_join.prefix_size(len(s), 75, 100)]
            listed += [(t, d, d) for t in mine]
            facts.append((d, len(s), mine[-1]))
        listed = spark.createDataFrame(listed, "token long, doc long, comp long")
        listed = listed.join(listed.groupBy("token").count().where("count > 1").select("token"), "token")
        made[n] = ngram_join.candidates(listed, spark.createDataFrame(facts, "doc long, n long, last long"), 75, 100).count()
    assert made[800] < 8 * max(made[200], 100)


def test_readers_of_long_texts_hold_few_rows(spark):
    """A reader's batch of 4,096 whole texts lay on the heap of each task."""
    from runlake.llm.common import ARROW_ROWS, small_batches

    small_batches(spark)
    assert int(spark.conf.get("spark.sql.parquet.columnarReaderBatchSize")) == ARROW_ROWS
