"""Running streams: alerts against their batch form, and late rows of many batches."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runlake.streaming import monitor

SCHEMA = T.StructType([T.StructField(n, T.StringType()) for n in ("id", "name", "error", "parent_run_id")] + [T.StructField("start_time", T.TimestampType())])


def at(second):
    return f"2026-01-01T{second // 3600:02}:{second % 3600 // 60:02}:{second % 60:02}Z"


def write(folder, name, rows):
    """Rows (id, second, error); files are read in the order of their times, here of their writing."""
    folder.mkdir(exist_ok=True)
    nth = 1_700_000_000 + len(list(folder.iterdir()))
    (folder / name).write_text("".join(json.dumps({"id": i, "start_time": at(s), "error": e}) + "\n" for i, s, e in rows))
    os.utime(folder / name, (nth, nth))


@pytest.fixture
def one_partition(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def alerts_of_stream(spark, folder, tmp_path, runs=1):
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")
    for _ in range(runs):
        alerts = monitor.error_alerts(monitor.run_stream(spark, str(folder), SCHEMA, files_per_trigger=1), threshold=2, delay="10 minutes")
        monitor.to_table(alerts, out, checkpoint).awaitTermination()
    return sorted(map(str, spark.read.schema(alerts.schema).parquet(out).collect()))


def alerts_of_batch(spark, rows):
    df = spark.createDataFrame([(i, at(s), e) for i, s, e in rows], "id string, t string, error string").select("id", F.to_timestamp("t").alias("start_time"), "error")
    return sorted(map(str, monitor.error_alerts(df, threshold=2).collect()))


def errors(rng, low, high, n, name):
    return [(f"{name}{k}", rng.randrange(low, high), rng.choice(("ValueError: x", "KeyError: y", "odd", None))) for k in range(n)]


def test_alerts_of_a_stream_are_those_of_the_batch(spark, tmp_path, one_partition):
    """Errors out of order within the delay, over several batches and a restart."""
    rng, folder, rows = random.Random(1), tmp_path / "in", []
    for k in range(4):
        part = errors(rng, max(0, k * 600 - 500), k * 600 + 600, 60, f"b{k}-")
        write(folder, f"{k}.json", part)
        rows += part
    alerts_of_stream(spark, folder, tmp_path)
    write(folder, "end.json", [("end", 20_000, None)])
    assert alerts_of_stream(spark, folder, tmp_path, runs=2) == alerts_of_batch(spark, rows) != []


def test_errors_beyond_the_delay_do_not_count(spark, tmp_path, one_partition):
    rng, folder = random.Random(2), tmp_path / "in"
    kept = errors(rng, 3000, 4000, 80, "a")
    late = errors(rng, 0, 1000, 50, "late")
    for name, rows in (("0", kept), ("1", [("beat", 8000, None)]), ("2", late), ("3", [("end", 30_000, None)])):
        write(folder, name, rows)
    assert alerts_of_stream(spark, folder, tmp_path) == alerts_of_batch(spark, kept) != alerts_of_batch(spark, kept + late)


def test_late_rows_of_150_batches(spark, tmp_path, one_partition):
    """Every batch but the first two has one late row; progress is kept of 100 batches only, and the query is restarted."""
    folder = tmp_path / "in"
    listener = monitor.LateRows(spark, str(tmp_path / "late"))

    def run():
        stream = monitor.once_per_id(monitor.run_stream(spark, str(folder), SCHEMA, files_per_trigger=1), "10 minutes")
        q = monitor.to_table(stream, str(tmp_path / "out"), str(tmp_path / "checkpoint"))
        q.awaitTermination()
        return listener.count(q), len(q.recentProgress)

    for k in range(150):
        write(folder, f"{k:03}.json", [(f"n{k}", 20_000 + k, None), *([(f"l{k}", k, None)] if k > 1 else [])])
    late, kept = run()
    assert late == 148 and kept < 150
    write(folder, "more.json", [("m", 30_000, None), ("late", 5, None), ("later", 6, None)])
    assert run()[0] == 150
    listener.stop()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 151
