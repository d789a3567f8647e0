"""Queries of reading, writing, appending and streaming; their files are derived from the tables, in the shared folder."""

from __future__ import annotations

import gzip
import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runlake.plans.fixtures import view
from runlake.plans.registry import query
from runlake.schema import RUN_SCHEMA
from runlake.sources import jsonl, sinks, text_index
from runlake.sources.shared import new_path
from runlake.streaming import monitor

_FIELDS = ("id", "name", "run_type", "error", "parent_run_id", "start_time", "total_tokens")
SCHEMA = T.StructType([*(f for f in RUN_SCHEMA if f.name in _FIELDS), T.StructField("project", T.StringType())])


def event_lines(spark, d) -> DataFrame:
    """Events as JSON lines; of fifty, one is cut off, one blank, one has a list for its tokens and one no id."""
    runs = view(spark, d, "runs_events").withColumn("start_time", F.date_format("start_time", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
    line = F.to_json(F.struct(*_FIELDS, "project"))
    k = F.col("id").cast("long") % 50
    broken = F.when(k == 0, F.left(line, F.lit(20))).when(k == 1, "  ").when(k == 2, F.replace(line, F.lit('"total_tokens":'), F.lit('"total_tokens":["x"],"was":'))).when(k == 3, F.replace(line, F.lit('"id":'), F.lit('"key":')))
    return runs.select(F.coalesce(broken, line).alias("value"))


def whole_lines(spark, d) -> DataFrame:
    """(start_time, value): every event as a JSON line."""
    runs = view(spark, d, "runs_events").withColumn("start_time", F.date_format("start_time", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
    return runs.select("start_time", F.to_json(F.struct(*_FIELDS, "project")).alias("value"))


def stored_lines(spark, d) -> str:
    path = new_path(spark, "lines")
    event_lines(spark, d).write.text(path)
    return path


_KIND = "CASE event_id % 50 WHEN 0 THEN 'not JSON' WHEN 2 THEN 'does not fit the schema' WHEN 3 THEN 'a required field is missing' ELSE concat('svc/', CAST(user_id % 5 AS STRING)) END"
_GOOD = "CAST(id AS BIGINT) % 50 > 3"


@query(f"SELECT {_KIND} AS kind, count(*) AS n FROM events WHERE event_id % 50 <> 1 GROUP BY ALL", ())
def a1_read_json_lines(spark, d):
    good, bad = jsonl.parse_runs(jsonl.read_lines(spark, stored_lines(spark, d)), SCHEMA)
    kinds = good.select(F.col("project").alias("kind")).unionAll(bad.select(F.col("reason").alias("kind")))
    return kinds.groupBy("kind").agg(F.count("*").alias("n"))


@query("SELECT project, count(*) AS n FROM runs_events WHERE project IN ('svc/1', 'svc/3') GROUP BY project UNION ALL SELECT 'svc/9', 0")
def a2_load_projects(spark, d):
    path = new_path(spark, "runs")
    view(spark, d, "runs_events").write.partitionBy("project").parquet(path)
    runs, missing = jsonl.load_projects(spark.read.parquet(path), ["svc/1", "svc/3", "svc/9"])
    return runs.groupBy("project").agg(F.count("*").alias("n")).unionAll(missing.select("project", F.lit(0).alias("n")))


def stored_sources(spark, d) -> dict[str, str]:
    """Events of all projects as JSON lines in folders; besides, a folder that is not there and one with a gzip file that breaks off."""
    path = new_path(spark, "sources")
    runs = view(spark, d, "runs_events").withColumn("folder", F.substr("project", F.lit(5)))
    runs.withColumn("start_time", F.date_format("start_time", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")).select(*_FIELDS, "project", "folder").write.partitionBy("folder").json(path)
    good = "".join(json.dumps({"id": f"cut{i}", "start_time": "2100-01-01T00:00:00Z"}) + "\n" for i in range(2000))
    broken = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/cut/a.json.gz")
    out = broken.getFileSystem(spark._jsc.hadoopConfiguration()).create(broken)
    out.write(bytearray(gzip.compress(good.encode())[:-40]))
    out.close()
    return {f"svc/{n}": f"{path}/folder={n}" for n in (0, 1, 2, 3, 4, 9)} | {"svc/8": f"{path}/cut"}


@query("SELECT source, n, reason FROM (SELECT project AS source, least(count(*), 50) AS n, CAST(NULL AS STRING) AS reason FROM runs_events GROUP BY project UNION ALL SELECT 'svc/8', 0, 'EOFError' UNION ALL SELECT 'svc/9', 0, 'FileNotFoundError')")
def a4_failed_sources(spark, d):
    runs, failed = jsonl.load_sources(spark, stored_sources(spark, d), SCHEMA, limit=50)
    read = runs.groupBy("source").agg(F.count("*").alias("n")).withColumn("reason", F.lit(None).cast("string"))
    return read.unionByName(failed.select("source", F.lit(0).alias("n"), F.substring_index("reason", ":", 1).alias("reason")))


@query("SELECT id, name, 1 AS failed_sources FROM runs_events ORDER BY start_time DESC, id LIMIT 10")
def j1_failed_sources(spark, d):
    """One stream for runs and failures, stopped after its first look and started again."""
    sources = {n: path for n, path in stored_sources(spark, d).items() if n != "svc/8"}
    path, checkpoint = new_path(spark, "watched"), new_path(spark, "checkpoint")

    def keep(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/{n}")

    for _ in range(2):
        with monitor.rocksdb(spark):
            q = monitor.for_each_batch(monitor.watch_sources(spark, sources, SCHEMA), keep, checkpoint)
            q.awaitTermination()
    return spark.read.parquet(f"{path}/{q.lastProgress['batchId']}").select("id", "name", "failed_sources")


@query("""SELECT concat('{"id":"', CAST(event_id AS STRING), '","type":"', event_type, '"}') AS line FROM events WHERE event_id % 3 > 0 ORDER BY line LIMIT 100""", ())
def a5_raw_sample(spark, d):
    path = new_path(spark, "raw")
    e = view(spark, d, "events")
    line = F.to_json(F.struct(F.col("event_id").cast("string").alias("id"), F.col("event_type").alias("type")))
    e.select(F.when(F.col("event_id") % 3 > 0, line).otherwise("{broken")).write.text(path)
    return jsonl.raw_sample(jsonl.read_lines(spark, path), 100).select("line")


@query("SELECT CASE item_id % 5 WHEN 0 THEN 'valid' WHEN 1 THEN 'inputs is not an object' WHEN 2 THEN 'not JSON' WHEN 3 THEN 'outputs is not an object' ELSE 'not an object' END AS reason, count(*) AS n FROM benchmark GROUP BY 1", ())
def a6_validated_examples(spark, d):
    valid, bad = jsonl.valid_examples(jsonl.read_lines(spark, stored_examples(spark, d)))
    return valid.select(F.lit("valid").alias("reason")).unionAll(bad.select("reason")).groupBy("reason").agg(F.count("*").alias("n"))


def stored_examples(spark, d) -> str:
    """Items as JSON lines in one file, by their ids; of five, one is valid."""
    path = new_path(spark, "examples")
    k, text = F.col("item_id") % 5, F.struct(F.col("text").alias("question"))
    good = F.to_json(F.struct(F.col("item_id").cast("string").alias("id"), text.alias("inputs")))
    line = F.when(k == 0, good).when(k == 1, F.to_json(F.struct(F.col("text").alias("inputs")))).when(k == 2, "no JSON").when(k == 3, F.to_json(F.struct(text.alias("inputs"), F.array("item_id").alias("outputs")))).otherwise("[1]")
    view(spark, d, "benchmark").select("item_id", line.alias("value")).coalesce(1).sortWithinPartitions("item_id").select("value").write.text(path)
    return path


@query("SELECT * FROM (SELECT row_number() OVER (ORDER BY item_id) AS row, CASE item_id % 5 WHEN 1 THEN 'inputs is not an object' WHEN 2 THEN 'not JSON' WHEN 3 THEN 'outputs is not an object' WHEN 4 THEN 'not an object' END AS reason FROM benchmark) WHERE reason IS NOT NULL", ())
def a6_bad_rows(spark, d):
    _, bad = jsonl.valid_examples(jsonl.read_numbered_lines(spark, stored_examples(spark, d)))
    return bad.select("row", "reason")


@query("SELECT id, name, error, concat('[\"', tag_len, '\"]') AS tags FROM runs_events WHERE error IS NOT NULL")
def b1_csv_round_trip(spark, d):
    path = new_path(spark, "csv")
    runs = view(spark, d, "runs_events").where(F.col("error").isNotNull()).withColumn("tags", F.array("tag_len"))
    sinks.write(runs, path, "csv", ["id", "name", "error", "tags", "nothing"])
    return spark.read.option("header", True).option("escape", '"').csv(path)


@query("SELECT project, name, count(*) AS n, sum(total_tokens)::BIGINT AS tokens FROM runs_events WHERE run_type = 'llm' GROUP BY ALL")
def b2_partitioned_export(spark, d):
    path = new_path(spark, "export")
    runs = view(spark, d, "runs_events").where(F.col("run_type") == "llm")
    sinks.write(runs, path, "json", ["id", "total_tokens"], ["project", "name"])
    back = spark.read.schema("id string, total_tokens bigint, project string, name string").json(path)
    return back.groupBy("project", "name").agg(F.count("*").alias("n"), F.sum("total_tokens").alias("tokens"))


@query("SELECT id, min(row_key) AS row_key FROM runs_trace_llm WHERE id NOT LIKE '%-1' GROUP BY id", ("runs_trace_llm",))
def b3_idempotent_append(spark, d):
    path, batch = new_path(spark, "appended"), new_path(spark, "batch")
    view(spark, d, "runs_trace_llm").select("id", "row_key", "project").write.parquet(batch)  # its joins are made once, not for each of its three uses
    runs = spark.read.schema("id string, row_key string, project string").parquet(batch)
    order = [F.asc("row_key")]
    runs.where(F.col("id").endswith("-1")).write.partitionBy("project").parquet(path)
    first = jsonl.append_runs(runs, path, order)  # noqa: F841  (written; the second time nothing is new)
    jsonl.append_runs(runs, path, order)
    return spark.read.parquet(path).where(~F.col("id").endswith("-1")).select("id", "row_key")


_PLAIN = "CASE WHEN length({0}) >= 10000 AND regexp_full_match(left({0}, 200), '[A-Za-z0-9+/=\\n\\r ]*') THEN concat('[binary:base64:', CAST(length({0}) AS STRING), 'bytes:...]') ELSE md5({0}) END"
_URI = "concat('[binary:audio/wav:', CAST(length(text) + 22 AS STRING), 'bytes:...]')"


@query(f"SELECT CAST(doc_id AS STRING) AS id, CASE WHEN doc_id % 2 = 0 THEN {_URI} ELSE {_PLAIN.format('text')} END AS inputs FROM documents", ())
def b4_strip_at_ingest(spark, d):
    docs = view(spark, d, "documents")
    runs = docs.select(F.col("doc_id").cast("string").alias("id"), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("data:audio/wav;base64,"), "text")).otherwise(F.col("text")).alias("inputs"))
    out = jsonl.strip_payloads(runs, "inputs")
    return out.select("id", F.when(F.col("inputs").startswith("[binary:"), F.col("inputs")).otherwise(F.md5("inputs")).alias("inputs"))


@query(f"SELECT CAST(doc_id AS STRING) AS id, {_URI} AS media, {_PLAIN.format('text')} AS part, {_PLAIN.format('long')} AS deep, 'data:;base64,' AS name FROM (SELECT doc_id, text, repeat(left(md5(text), 20), 600) AS long FROM documents WHERE text IS NOT NULL)", ())
def b4_strip_nested(spark, d):
    """Media at several depths of a payload; keys that look like media stay."""
    docs = view(spark, d, "documents").where(F.col("text").isNotNull())
    uri, long = F.concat(F.lit("data:audio/wav;base64,"), "text"), F.repeat(F.left(F.md5("text"), F.lit(20)), F.lit(600))
    inner = F.struct(uri.alias("media"), F.array("text").alias("parts"), F.array(F.struct(long.alias("deep"), F.lit('a "quoted\\" text').alias("short"))).alias("list"))
    payload = F.to_json(F.struct(F.col("doc_id").alias("n"), inner.alias("a"), F.create_map(F.lit("data:;base64,"), F.lit(1)).alias("keys")))
    runs = jsonl.strip_payloads(docs.select(F.col("doc_id").cast("string").alias("id"), payload.alias("inputs")), "inputs")
    out = runs.select("id", *(F.get_json_object("inputs", at).alias(n) for n, at in (("media", "$.a.media"), ("part", "$.a.parts[0]"), ("deep", "$.a.list[0].deep"))), F.get(F.json_object_keys(F.get_json_object("inputs", "$.keys")), F.lit(0)).alias("name"))
    return out.withColumns({c: F.when(F.col(c).startswith("[binary:"), F.col(c)).otherwise(F.md5(c)) for c in ("part", "deep")})


@query("SELECT project, count(*) AS n FROM runs_events WHERE CAST(id AS BIGINT) % 7 = 0 GROUP BY project")
def e4_dedup_against_stored(spark, d):
    runs = view(spark, d, "runs_events")
    fresh = jsonl.new_rows(runs.unionAll(runs), runs.where(F.col("id").cast("long") % 7 != 0), [F.desc("start_time")])
    return fresh.groupBy("project").agg(F.count("*").alias("n"))


@query("SELECT id, q AS query FROM runs_docs, (VALUES ('Licensed Under', true), ('License', false), ('zq', true)) v(q, any_case) WHERE CASE WHEN any_case THEN contains(lower(text), lower(q)) ELSE contains(text, q) END", ("runs_docs",))
def d12_indexed_search(spark, d):
    """Whole texts searched by a trigram index of their files; the last query is too short for it."""
    path, index = new_path(spark, "texts"), new_path(spark, "grams")
    view(spark, d, "runs_docs").select("id", "text", "project").write.partitionBy("project").parquet(path)
    text_index.index_texts(spark, path, index, F.col("text"))
    found = [text_index.search_files(spark, path, index, q, F.col("text"), ignore_case=any_case).select("id", F.lit(q).alias("query")) for q, any_case in (("Licensed Under", True), ("License", False), ("zq", True))]
    return found[0].unionAll(found[1]).unionAll(found[2])


@query("SELECT id, project FROM runs_events WHERE CAST(id AS BIGINT) % 3 = 0")
def e4_dedup_by_filter(spark, d):
    """What an append by the filter of stored ids adds: two thirds of the events, half of which are stored."""
    path, runs = new_path(spark, "filtered"), view(spark, d, "runs_events").select("id", "project", "start_time")
    k, order = F.col("id").cast("long") % 3, [F.asc("start_time")]
    jsonl.append_runs(runs.where(k != 0), path, order, by_filter=True)
    return jsonl.append_runs(runs.where(k != 1), path, order, by_filter=True).select("id", "project")


@query("SELECT count(*) AS total, count(project) AS attributed FROM runs_trace", ("runs_trace",))
def e5_project_attribution(spark, d):
    return view(spark, d, "runs_trace").agg(F.count("*").alias("total"), F.count("project").alias("attributed"))


@query(f"SELECT id, name FROM runs_events WHERE {_GOOD} ORDER BY start_time DESC, id LIMIT 10")
def j1_live_monitor(spark, d):
    path = new_path(spark, "latest")

    def refresh(batch: DataFrame, n: int) -> None:
        before = spark.read.schema(SCHEMA).parquet(f"{path}/{n - 1}") if n else None
        monitor.latest_roots(batch, before).write.mode("overwrite").parquet(f"{path}/{n}")

    stream = monitor.run_stream(spark, stored_lines(spark, d), SCHEMA, files_per_trigger=4)
    q = monitor.for_each_batch(stream, refresh, new_path(spark, "checkpoint"))
    q.awaitTermination()
    return spark.read.schema(SCHEMA).parquet(f"{path}/{q.lastProgress['batchId']}").select("id", "name")


def ingested(spark, d) -> str:
    out, checkpoint, lines = new_path(spark, "ingested"), new_path(spark, "checkpoint"), stored_lines(spark, d)
    for _ in range(2):  # the second run starts from the checkpoint and finds nothing new
        stream = monitor.once_per_id(monitor.run_stream(spark, lines, SCHEMA), "60 days")
        monitor.to_table(stream, out, checkpoint).awaitTermination()
    return out


@query(f"SELECT project, count(*) AS n, sum(total_tokens)::BIGINT AS tokens FROM runs_events WHERE {_GOOD} GROUP BY project")
def j2_incremental_ingest(spark, d):
    return spark.read.parquet(ingested(spark, d)).groupBy("project").agg(F.count("*").alias("n"), F.sum("total_tokens").alias("tokens"))


@query(f"SELECT strftime(date_trunc('hour', start_time), '%Y-%m-%d %H:%M') AS hour, count(*) AS run_count, count(error) AS errors, sum(total_tokens)::BIGINT AS total_tokens FROM runs_events WHERE {_GOOD} GROUP BY 1")
def j3_windowed_usage(spark, d):
    path = new_path(spark, "hours")

    def keep(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/{n}")

    usage = monitor.windowed_usage(monitor.run_stream(spark, stored_lines(spark, d), SCHEMA, files_per_trigger=4), delay="60 days")
    q = usage.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", new_path(spark, "checkpoint")).trigger(availableNow=True).start()
    q.awaitTermination()
    # of a window's updates the last counts, which is the one with the most runs
    updates = spark.read.option("recursiveFileLookup", True).parquet(path)
    last = Window.partitionBy("window").orderBy(F.desc("run_count"))
    final = updates.withColumn("rank", F.row_number().over(last)).where("rank = 1")
    return final.select(F.date_format("window.start", "yyyy-MM-dd HH:mm").alias("hour"), "run_count", "errors", "total_tokens")


@query("""SELECT strftime(w, '%Y-%m-%d %H:%M') AS started, sum(n)::BIGINT AS errors FROM (SELECT date_trunc('minute', start_time) - to_minutes(CAST(unnest([0, 1, 2, 3, 4]) AS BIGINT)) AS w, 1 AS n FROM runs_events WHERE error IS NOT NULL) GROUP BY w HAVING sum(n) > 1""")
def j4_error_alerts(spark, d):
    """A running stream; a heartbeat far ahead, in the last batch, lets the watermark pass every window."""
    path, out = new_path(spark, "errors"), new_path(spark, "alerts")
    whole_lines(spark, d).select("value").write.text(path)
    beat = F.to_json(F.struct(F.lit("beat").alias("id"), F.lit("2100-01-01T00:00:00Z").alias("start_time")))
    spark.range(1).select(beat.alias("value")).write.mode("append").text(path)
    alerts = monitor.error_alerts(monitor.run_stream(spark, path, SCHEMA, files_per_trigger=4), threshold=1, delay="60 days")
    monitor.to_table(alerts, out, new_path(spark, "checkpoint")).awaitTermination()
    alerts = spark.read.schema(alerts.schema).parquet(out)
    return alerts.select(F.date_format("window.start", "yyyy-MM-dd HH:mm").alias("started"), "errors")


@query(f"SELECT run_type, count(*) AS n FROM runs_events WHERE {_GOOD} GROUP BY run_type")
def j5_processing_loop(spark, d):
    path = new_path(spark, "processed")

    def handle(batch: DataFrame, n: int) -> None:
        batch.groupBy("run_type").agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{path}/batch={n}")

    lines, checkpoint = stored_lines(spark, d), new_path(spark, "checkpoint")
    for _ in range(2):
        monitor.for_each_batch(monitor.run_stream(spark, lines, SCHEMA, files_per_trigger=4), handle, checkpoint).awaitTermination()
    return spark.read.parquet(path).groupBy("run_type").agg(F.sum("n").alias("n"))


@query(f"SELECT project, count(*) AS late FROM runs_events WHERE {_GOOD} AND start_time < TIMESTAMP '2024-01-03' GROUP BY project")
def j6_late_rows(spark, d):
    """Runs that a stream with a short watermark would have missed are counted and added by the batch reconcile."""
    good, _ = jsonl.parse_runs(jsonl.read_lines(spark, stored_lines(spark, d)), SCHEMA)
    stored = good.where(F.col("start_time") >= F.lit("2024-01-03").cast("timestamp"))
    return jsonl.new_rows(good, stored, [F.desc("start_time")]).groupBy("project").agg(F.count("*").alias("late"))


@query("SELECT (SELECT count(*) FROM runs_events WHERE start_time < TIMESTAMP '2024-01-03' AND start_time < (SELECT max(start_time) FROM runs_events) - INTERVAL 2 DAY)::BIGINT AS late, (SELECT count(*) FROM runs_events WHERE start_time >= TIMESTAMP '2024-01-03' OR start_time >= (SELECT max(start_time) FROM runs_events) - INTERVAL 2 DAY)::BIGINT AS kept")
def j6_late_stream(spark, d):
    """A stream whose oldest runs come last: those beyond the watermark, which counts from the next but one batch on, are kept out and counted."""
    path, out = new_path(spark, "late"), new_path(spark, "kept")
    line = whole_lines(spark, d)
    for part in (F.col("start_time") >= "2024-01-04", F.col("start_time").startswith("2024-01-03"), F.col("start_time") < "2024-01-03"):
        line.where(part).select("value").coalesce(1).write.mode("append").text(path)
    stream = monitor.once_per_id(monitor.run_stream(spark, path, SCHEMA, files_per_trigger=1), "2 days")
    listener = monitor.LateRows(spark, new_path(spark, "dropped"))
    q = monitor.to_table(stream, out, new_path(spark, "checkpoint"))
    q.awaitTermination()
    late = listener.count(q)
    listener.stop()
    return spark.read.parquet(out).agg(F.lit(late).cast("long").alias("late"), F.count("*").alias("kept"))
