"""Appends that ask a filter of the stored ids: the same rows as the exact join, without reading what cannot hold an id."""

import pytest
from pyspark.sql import functions as F

from runlake.sources import id_filter, jsonl, store


def batch(spark, *rows):
    return spark.createDataFrame([(i, p, n) for n, (i, p) in enumerate(rows)], "id string, project string, n int")


def append(spark, path, *rows, by_filter=True):
    return sorted((r.id, str(r.project)) for r in jsonl.append_runs(batch(spark, *rows), str(path), [F.asc("n")], by_filter).collect())


def break_files(path, *folders):
    for folder in folders:
        for f in path.glob(f"{folder}/*.parquet"):
            f.write_bytes(b"no parquet")
            f.with_name(f".{f.name}.crc").unlink(missing_ok=True)


def test_the_same_rows_as_the_exact_join(spark, tmp_path):
    batches = [[("1", "a"), ("2", "a"), ("1", "b"), ("1", None), (None, "a")], [("1", "a"), ("3", "a"), ("2", "b"), ("1", None), ("2", None), ("3", "a")], [("é=%", "x/y z"), ("1", "007"), ("", "a")], [("é=%", "x/y z"), ("1", "007"), ("", "a"), ("1", "7")], []]
    for rows in batches:
        assert append(spark, tmp_path / "f", *rows) == append(spark, tmp_path / "e", *rows, by_filter=False)
    assert append(spark, tmp_path / "f", *batches[1]) == []


def test_new_ids_read_no_stored_ones(spark, tmp_path):
    path = tmp_path / "runs"
    append(spark, path, ("1", "a"), ("2", "b"))
    break_files(path, "project=a", "project=b")
    assert append(spark, path, ("3", "a"), ("4", "b")) == [("3", "a"), ("4", "b")]
    # the append that holds the id is read, the one before it is not
    assert append(spark, path, ("3", "a"), ("5", "a")) == [("5", "a")]
    with pytest.raises(Exception, match="parquet"):
        append(spark, path, ("1", "a"))


def test_few_false_hits_at_any_growth(spark, tmp_path):
    path = str(tmp_path / "runs")
    runs = spark.range(24_000).select(F.concat(F.lit("run-"), "id").alias("id"), F.when(F.col("id") % 3 > 0, "hot").otherwise("b").alias("project"), F.col("id").cast("int").alias("n"))
    for low, high in ((0, 100), (100, 4_000), (4_000, 12_000)):
        jsonl.append_runs(runs.where(F.col("n").between(low, high - 1)), path, [F.asc("n")], True)
    known = id_filter.covered(spark, path, store.data_files(spark, path))
    assert len({size for p, _, size, _ in known if p == "hot"}) == 3
    hits = {r.id for r in id_filter.possible(runs, known, path).collect()}
    stored = {f"run-{i}" for i in range(12_000)}
    assert stored <= hits and len(hits - stored) < 12_000 * 0.005
    assert jsonl.append_runs(runs, path, [F.asc("n")], True).count() == 12_000
    assert spark.read.parquet(path).select("id").distinct().count() == spark.read.parquet(path).count() == 24_000


def test_files_that_are_not_covered(spark, tmp_path, monkeypatch):
    """By another writer, by an append without the filter, and by one stopped before it was written."""
    path = tmp_path / "runs"
    batch(spark, ("1", "a"), ("2", "b")).write.partitionBy("project").parquet(str(path))
    append(spark, path, ("3", "a"), by_filter=False)
    assert append(spark, path, ("1", "a"), ("3", "a"), ("4", "a")) == [("4", "a")]

    def stopped(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(id_filter, "cover", stopped)
        with pytest.raises(KeyboardInterrupt):
            append(spark, path, ("5", "a"))
    assert append(spark, path, ("5", "a"), ("1", "a"), ("2", "b"), ("6", "b")) == [("6", "b")]
    assert sorted((r.project, r.run_count) for r in store.metadata(spark, str(path)).collect()) == [("a", 4), ("b", 2)]
