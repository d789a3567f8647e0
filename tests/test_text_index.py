"""Searches by the trigram index: the same rows as a scan, from fewer files."""

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from runlake.functions.columns import json_text
from runlake.sources import text_index as T

TEXTS = ["Straße ΟΔΟΣ", "the quick fox", "THE QUICK FOX", "İstanbul K9", None, "", "ab", "a" * 50, 'says "quick"\n', "\U0001f600\U0001f601\U0001f602 x", "100% + 1", "Émile ÉTÉ"]


@pytest.fixture
def stored(spark, tmp_path):
    path = str(tmp_path / "runs")
    df = spark.createDataFrame([(str(i), f"p {i % 4}+é", t, str(i)) for i, t in enumerate(TEXTS)], "id string, project string, inputs string, outputs string")
    df.repartition(4, "id").write.partitionBy("project").parquet(path)
    return path


def both(spark, path, index, query, texts, ignore_case):
    got = T.search_files(spark, path, index, query, *texts, ignore_case=ignore_case)
    scan = [(F.lower(t) if ignore_case else t).contains(query.lower() if ignore_case else query) for t in texts]
    want = spark.read.parquet(path).where(F.greatest(*(F.coalesce(s, F.lit(False)) for s in scan), F.lit(False)))
    assert sorted(r.id for r in got.collect()) == sorted(r.id for r in want.collect())
    return len(T.files_with(spark, path, index, query.lower() if ignore_case else query))


def test_the_same_rows_as_a_scan(spark, stored, tmp_path):
    index, texts = str(tmp_path / "index"), [F.col("inputs"), F.col("outputs")]
    everything = len(T._files(spark, stored))
    assert T.index_texts(spark, stored, index, *texts) == everything > 4
    assert T.index_texts(spark, stored, index, *texts) == 0
    for query in ("quick", "QUICK FOX", "k9", "ΟΔΟΣ", "οδος", "straße", "i̇st", "éti", "été", "aaaa", "\U0001f600\U0001f601\U0001f602", "% +", "nowhere", "10", ""):
        for ignore_case in (False, True):
            read = both(spark, stored, index, query, texts, ignore_case)
            assert read == everything if len(query) < 3 else read < everything
    assert T.files_with(spark, stored, index, "nowhere") == []
    assert len(T.files_with(spark, stored, index, "100%")) == 1


def test_json_text_and_files_that_come_and_go(spark, stored, tmp_path):
    index, text = str(tmp_path / "json"), json_text("inputs", "outputs")
    T.index_texts(spark, stored, index, text)
    assert both(spark, stored, index, 'says \\"quick\\"\\n', [text], False) == 1
    assert both(spark, stored, index, '"inputs":null,"outputs":"4"', [text], False) == 1
    spark.createDataFrame([("new", "p", "a zebra", "z")], "id string, project string, inputs string, outputs string").write.mode("append").partitionBy("project").parquet(stored)
    assert both(spark, stored, index, "zebra", [text], True) == 1  # not indexed, so it is read
    assert both(spark, stored, index, "no such text", [text], True) == 1
    assert T.index_texts(spark, stored, index, text) == 1
    assert both(spark, stored, index, "zebra", [text], True) == 1 and both(spark, stored, index, "no such text", [text], True) == 0


def test_files_ruled_out_are_not_opened(spark, stored, tmp_path):
    index = str(tmp_path / "index")
    T.index_texts(spark, stored, index, F.col("inputs"))
    (file,) = T.files_with(spark, stored, index, "Émile")
    rows = T.search_files(spark, stored, index, "Émile", F.col("inputs"))
    assert len(rows.inputFiles()) == 1 and rows.inputFiles()[0].endswith(file.rsplit("/", 1)[1]) and rows.count() == 1


def test_an_empty_table(spark, tmp_path):
    path, index = str(tmp_path / "none"), str(tmp_path / "index")
    spark.createDataFrame([], "id string, inputs string").write.parquet(path)
    T.index_texts(spark, path, index, F.col("inputs"))
    assert T.search_files(spark, path, index, "abc", F.col("inputs")).count() == 0


@given(st.text(max_size=40))
def test_trigrams(text):
    plain = {(ord(a) << 42) | (ord(b) << 21) | ord(c) for a, b, c in zip(text, text[1:], text[2:], strict=False)}
    assert set(T.grams_of(text).tolist()) == plain


def test_trigrams_of_a_long_text(monkeypatch):
    text = "".join(map(chr, np.random.default_rng(1).integers(97, 123, 5000)))
    whole = T.grams_of(text)
    monkeypatch.setattr(T, "_SLICE", 7)
    assert np.array_equal(T.grams_of(text), whole)
