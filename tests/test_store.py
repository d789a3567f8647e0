"""Appends to a stored table and its metadata: exact whatever else is in the batch, merged, and mended after a stop."""

import shutil
from pathlib import Path

from pyspark.sql import functions as F

from runlake.operators import discovery
from runlake.sources import jsonl, store

SCHEMA = "id string, project string, start_time timestamp, n int"


def batch(spark, *rows):
    df = spark.createDataFrame([(i, p, t, n) for n, (i, p, t) in enumerate(rows)], "id string, project string, t string, n int")
    return df.select("id", "project", F.to_timestamp("t").alias("start_time"), "n")


def append(spark, path, *rows):
    return sorted((r.id, str(r.project)) for r in jsonl.append_runs(batch(spark, *rows), path, [F.asc("n")]).collect())


def stored(spark, path):
    return spark.read.schema(SCHEMA).parquet(path)


def same_as_a_scan(spark, path):
    found = sorted(map(str, store.metadata(spark, path).select("project", "run_count", "oldest", "newest").collect()))
    assert found == sorted(map(str, discovery.project_metadata(stored(spark, path)).collect()))
    return found


def test_an_id_of_another_project_does_not_matter(spark, tmp_path):
    for more in ((), (("7", "b", "2026-01-05"),)):
        path = str(tmp_path / f"t{len(more)}")
        append(spark, path, ("1", "b", "2026-01-01"))
        assert ("1", "a") in append(spark, path, ("1", "a", "2026-01-02"), *more)
        assert append(spark, path, ("1", "a", "2026-01-02"), ("1", "b", "2026-01-01"), *more) == []
    assert append(spark, str(tmp_path / "new"), ("1", "a", "2026-01-01"), ("1", "b", "2026-01-01"), ("1", "a", "2026-01-03")) == [("1", "a"), ("1", "b")]


def test_metadata_is_merged(spark, tmp_path):
    path = str(tmp_path / "runs")
    assert store.metadata(spark, path).count() == 0
    append(spark, path, ("1", "a/x y", "2026-01-03"), ("2", "a/x y", "2026-01-01"), ("1", "007", None), ("9", None, "2026-02-01"))
    same_as_a_scan(spark, path)
    append(spark, path, ("3", "a/x y", "2026-01-09"), ("2", "a/x y", "2020-01-01"), ("9", None, "2026-02-01"), ("10", None, "2026-03-01"), ("4", "é=%", "2026-01-02"))
    found = same_as_a_scan(spark, path)
    assert len(found) == 4 and "2026, 1, 9" in str(found) and "2020" not in str(found)
    before = [p.name for p in (tmp_path / "runs" / "_meta").iterdir() if p.name.startswith("v")]
    assert append(spark, path, ("3", "a/x y", "2026-01-09"), (None, "a/x y", "2026-01-09")) == []
    assert before == [p.name for p in (tmp_path / "runs" / "_meta").iterdir() if p.name.startswith("v")] and 1 <= len(before) <= 2
    assert stored(spark, path).count() == 7


def test_metadata_reads_no_runs(spark, tmp_path):
    """What is published is used as long as a project's files are those counted: the runs themselves are broken here."""
    path = tmp_path / "runs"
    append(spark, str(path), ("1", "a", "2026-01-01"), ("2", "b", "2026-01-02"))
    for f in path.glob("project=*/*.parquet"):
        f.write_bytes(b"no parquet")
        f.with_name(f".{f.name}.crc").unlink(missing_ok=True)
    assert sorted((r.project, r.run_count) for r in store.metadata(spark, str(path)).collect()) == [("a", 1), ("b", 1)]
    shutil.rmtree(path / "project=b")
    assert [(r.project, r.run_count) for r in store.metadata(spark, str(path)).collect()] == [("a", 1)]


def test_only_the_batch_s_projects_are_read(spark, tmp_path):
    path = tmp_path / "runs"
    append(spark, str(path), ("1", "a", "2026-01-01"), ("2", "b", "2026-01-02"))
    for f in path.glob("project=b/*.parquet"):
        f.write_bytes(b"no parquet")
        f.with_name(f".{f.name}.crc").unlink(missing_ok=True)
    assert append(spark, str(path), ("1", "a", "2026-01-01"), ("3", "a", "2026-01-05")) == [("3", "a")]


def test_a_writer_stopped_before_publishing(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "runs")
    append(spark, path, ("1", "a", "2026-01-01"), ("2", "b", "2026-01-02"))

    def stopped(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(store, "publish", stopped)
        try:
            append(spark, path, ("5", "a", "2026-05-01"))
        except KeyboardInterrupt:
            pass
    same_as_a_scan(spark, path)
    assert append(spark, path, ("5", "a", "2026-05-01"), ("6", "b", "2026-06-01")) == [("6", "b")]
    same_as_a_scan(spark, path)


def test_a_table_without_metadata(spark, tmp_path):
    path = str(tmp_path / "runs")
    batch(spark, ("1", "a", "2026-01-01"), ("2", "b", "2026-01-02")).write.partitionBy("project").parquet(path)
    same_as_a_scan(spark, path)
    assert append(spark, path, ("1", "a", "2026-01-01")) == []
    assert any(p.name.startswith("v") for p in Path(path, "_meta").iterdir())
    same_as_a_scan(spark, path)


def test_runs_without_start_times(spark, tmp_path):
    path = str(tmp_path / "runs")
    jsonl.append_runs(spark.createDataFrame([("1", "a"), ("2", "a")], "id string, project string"), path, [F.asc("id")])
    assert [(r.run_count, r.oldest) for r in store.metadata(spark, path).collect()] == [(2, None)]
    assert jsonl.append_runs(spark.createDataFrame([], "id string, project string"), path, [F.asc("id")]).count() == 0
