"""Sources that fail when they are opened or while they are read, and one monitor over all of them."""

import gzip
import json
import os

import pytest
from pyspark.sql import types as T

from runlake.sources import feeds, jsonl
from runlake.streaming import monitor

SCHEMA = T.StructType([T.StructField(n, T.StringType()) for n in ("id", "name", "parent_run_id")] + [T.StructField("start_time", T.TimestampType())])


def lines(*runs):
    return "".join(json.dumps({"id": i, "name": f"n{i}", "start_time": f"2026-01-01T00:00:{s:02}.000001Z", **more}) + "\n" for i, s, more in runs)


def folder(tmp_path, name, **files):
    (tmp_path / name).mkdir(exist_ok=True)
    for file, text in files.items():
        path = tmp_path / name / file.replace("_", ".")
        path.write_bytes(text if isinstance(text, bytes) else text.encode())
    return str(tmp_path / name)


def test_failures_are_captured_and_others_read(spark, tmp_path):
    """A truncated gzip, one that is no gzip, a folder in a file's place, one that is missing, and one that may not be read."""
    many = lines(*((f"g{i}", i % 60, {}) for i in range(3000)))
    sources = {
        "good": folder(tmp_path, "good", a_json=lines(("1", 1, {}), ("2", 2, {})) + "{broken\n\n[1]\n", b_json_gz=gzip.compress(lines(("3", 3, {})).encode()), empty_json=""),
        "cut": folder(tmp_path, "cut", a_json=lines(("4", 4, {})), z_json_gz=gzip.compress(many.encode())[:-20]),
        "no gzip": folder(tmp_path, "odd", a_json_gz=b"plain text"),
        "missing": str(tmp_path / "missing"),
        "locked": folder(tmp_path, "locked", a_json=lines(("5", 5, {}))),
        "one file": folder(tmp_path, "one", a_json=lines(("6", 6, {}))) + "/a.json",
        "empty": folder(tmp_path, "empty"),
        "scheme": "nosuchscheme://host/x",
    }
    os.chmod(tmp_path / "locked" / "a.json", 0)
    runs, failed = jsonl.load_sources(spark, sources, SCHEMA)
    readable = os.access(tmp_path / "locked" / "a.json", os.R_OK)  # root may read everything
    reasons = {r.source: r.reason.split(":")[0] for r in failed.collect()}
    assert reasons.pop("locked", "PermissionError") == "PermissionError" and (readable or failed.where("source = 'locked'").count() == 1)
    assert set(reasons) == {"cut", "no gzip", "missing", "scheme"} and reasons["cut"] == "EOFError" and reasons["missing"] == "FileNotFoundError"
    assert sorted((r.id, r.source) for r in runs.where("source <> 'locked'").collect()) == [("1", "good"), ("2", "good"), ("3", "good"), ("6", "one file")]
    limited, _ = jsonl.load_sources(spark, sources, SCHEMA, limit=1)
    assert [(r.id, r.source) for r in limited.where("source = 'good'").collect()] == [("3", "good")]
    assert jsonl.load_sources(spark, {}, SCHEMA)[0].count() == 0


def test_a_file_is_read_in_parts(spark, tmp_path, monkeypatch):
    text = lines(*((str(i), i % 60, {"name": "x" * (i % 97)}) for i in range(500))).rstrip("\n")
    path = folder(tmp_path, "long", a_json=text)
    for size in (1, 37, 1000, 10**6):
        monkeypatch.setattr(feeds, "SPLIT", size)
        parts = [p for p in feeds.parts_of("s", path) if p.file][:2000]
        got = [raw.decode().strip() for p in parts for raw in feeds.lines_of(p)]
        want = text.split("\n")
        assert got == (want if size > 1 else want[: len(got)]) and len(got) >= min(len(want), 10)


def last_table(spark, out, q):
    rows = spark.read.parquet(f"{out}/{q.lastProgress['batchId']}").orderBy("rank").collect()
    return [r.id for r in rows], {r.failed_sources for r in rows}


def test_one_monitor_across_restarts(spark, tmp_path):
    a, b = folder(tmp_path, "a", x_json=lines(("1", 1, {}), ("2", 50, {"parent_run_id": "1"}), ("3", 3, {}))), folder(tmp_path, "b", x_json=lines(("4", 4, {}), ("5", 3, {})))
    sources, out, checkpoint = {"a": a, "b": b, "c": str(tmp_path / "c")}, str(tmp_path / "out"), str(tmp_path / "checkpoint")

    def look():
        with monitor.rocksdb(spark):
            stream = monitor.watch_sources(spark, sources, SCHEMA, n=3)
            q = monitor.for_each_batch(stream, lambda batch, n: batch.write.mode("overwrite").parquet(f"{out}/{n}"), checkpoint)
            q.awaitTermination()
        return last_table(spark, out, q)

    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    assert look() == (["4", "3", "5"], {1})
    folder(tmp_path, "c", y_json=lines(("6", 20, {}), ("4", 30, {})))  # it is there now
    os.remove(tmp_path / "a" / "x.json")
    os.rmdir(tmp_path / "a")  # and this one is gone; its runs are kept
    folder(tmp_path, "b", cut_json_gz=gzip.compress(lines(("9", 59, {})).encode())[:-9])
    assert look() == (["9", "4", "6"], {2})  # what came before the break is shown
    os.remove(tmp_path / "b" / "cut.json.gz")
    folder(tmp_path, "b", late_json=lines(("7", 2, {}), ("8", 40, {})))
    assert look() == (["9", "8", "4"], {1})
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before
