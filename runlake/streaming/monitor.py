"""Structured Streaming over directories of JSON-line runs."""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery, StreamingQueryListener

from runlake.operators.sampling import top_per
from runlake.sources.feeds import source_lines
from runlake.sources.jsonl import BAD, load_sources

LATEST = 10


def run_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int = 100) -> DataFrame:
    """Runs of a directory as they arrive; lines that do not fit the schema or have no id are left out."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path)
    full = T.StructType([*schema.fields, T.StructField(BAD, T.StringType())])
    run = F.from_json("value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD})
    return lines.select(run.alias("run")).where(F.col("run").isNotNull() & F.col(f"run.{BAD}").isNull() & F.col("run.id").isNotNull()).select("run.*").drop(BAD)


def once_per_id(runs: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Each id once within the watermark's delay; later repeats are for the batch reconcile (jsonl.new_rows)."""
    return runs.withWatermark("start_time", delay).dropDuplicatesWithinWatermark(["id"])


def windowed_usage(runs: DataFrame, length: str = "1 hour", slide: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Runs, errors and tokens by window of their start."""
    w = F.window("start_time", length, slide) if slide else F.window("start_time", length)
    return runs.withWatermark("start_time", delay).groupBy(w.alias("window")).agg(F.count("*").alias("run_count"), F.count("error").alias("errors"), F.sum(F.coalesce("total_tokens", F.lit(0))).alias("total_tokens"))


def error_alerts(runs: DataFrame, threshold: int = 10, length: str = "5 minutes", slide: str = "1 minute", delay: str | None = None) -> DataFrame:
    """Windows with more errors than `threshold`, with the number of each kind, for batches and streams.

    Of a stream, which needs a `delay`, a window comes out once, in append mode, when the watermark has passed its end:
    errors may arrive out of order by the delay, and later ones do not count. Kinds are counted by window and kind
    first, and then by window, both within the stream's state.
    """
    # a stream's runs without an error stay in it, as one kind more, since they move the watermark on, too
    failed = F.col("error").isNotNull()
    runs = runs.where(failed) if delay is None else runs.withWatermark("start_time", delay)
    kind = F.when(failed, F.coalesce(F.nullif(F.regexp_extract("error", "^(\\w+Error)", 1), F.lit("")), F.lit("other")))
    by_kind = runs.groupBy(F.window("start_time", length, slide).alias("window"), kind.alias("kind")).agg(F.count("error").alias("n"))
    kinds = F.collect_list(F.when(F.col("kind").isNotNull(), F.struct("kind", "n")))
    return by_kind.groupBy("window").agg(F.sum("n").alias("errors"), F.array_sort(kinds).alias("kinds")).where(F.col("errors") > threshold)


def latest_roots(batch: DataFrame, before: DataFrame | None = None, n: int = LATEST) -> DataFrame:
    """The `n` newest root runs of a batch and of those kept so far; of an id the newest row."""
    roots = batch.where(F.col("parent_run_id").isNull())
    roots = roots if before is None else roots.unionByName(before)
    rest = [F.asc(c) for c in roots.columns if c not in ("id", "start_time")]
    return top_per(roots, ["id"], 1, [F.desc("start_time"), *rest]).orderBy(F.desc("start_time"), "id").limit(n)


def latest_of_sources(spark: SparkSession, sources: dict[str, str], schema: T.StructType, n: int = LATEST) -> DataFrame:
    """The `n` newest root runs of all sources that can be read, each with the number of those that cannot."""
    runs, failed = load_sources(spark, sources, schema)
    return latest_roots(runs, n=n).withColumn("failed_sources", F.lit(failed.count()))


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Within it, streams that are started keep their state in RocksDB, as those with a processor of their own must."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before)


class Newest(StatefulProcessor):
    """State of one monitor: the newest root runs, and of each source whether it failed when it was last looked at."""

    def __init__(self, n: int):
        self.n = n

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.runs = handle.getMapState("runs", "id string", "start double, run string")
        self.sources = handle.getMapState("sources", "source string", "failed boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        newest = {k[0]: (v[0], v[1]) for k, v in self.runs.iterator()}
        looked_at: dict[str, bool] = {}
        for batch in rows:
            for kind, name, start, run in zip(batch["kind"], batch["name"], batch["start"], batch["run"], strict=True):
                if kind == "run":
                    newest[name] = max(newest.get(name, (start, run)), (start, run))
                else:
                    looked_at[name] = looked_at.get(name, False) or kind == "failed"
        for source, failed in looked_at.items():
            self.sources.updateValue((source,), (failed,))
        kept = sorted(newest.items(), key=lambda x: (-x[1][0], x[0]))[: self.n]
        self.runs.clear()
        for name, value in kept:
            self.runs.updateValue((name,), value)
        failed = sum(bool(v[0]) for _, v in self.sources.iterator())
        yield pd.DataFrame({"rank": range(1, len(kept) + 1), "run": [v[1] for _, v in kept], "failed_sources": failed})

    def close(self) -> None:
        pass


def watch_sources(spark: SparkSession, sources: dict[str, str], schema: T.StructType, n: int = LATEST) -> DataFrame:
    """A stream of the `n` newest root runs of all sources, with the number of sources that failed at the last look; one table each time the sources are polled.

    Both are kept in the stream's state, so they outlive a restart. Of a file that breaks off, the runs before the break
    are shown, and its source counts as failed. A task hands on its own newest runs only; what
    meets in one group is at most `n` rows a task and one a source. The state store must be RocksDB.
    """
    lines = source_lines(spark, sources, stream=True)
    full = T.StructType([*schema.fields, T.StructField(BAD, T.StringType())])
    run = F.from_json("line", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD})
    kind = F.when(F.col("line").isNotNull(), "run").when(F.col("error").isNotNull(), "failed").otherwise("read")
    rows = lines.withColumn("run", run).where(F.col("line").isNull() | (F.col(f"run.{BAD}").isNull() & F.col("run.id").isNotNull() & F.col("run.parent_run_id").isNull()))
    start = F.coalesce(F.unix_micros("run.start_time") / 1e6, F.lit(float("-inf")))
    rows = rows.select(kind.alias("kind"), F.when(F.col("line").isNull(), F.col("source")).otherwise(F.col("run.id")).alias("name"), start.alias("start"), F.col("line").alias("run"))

    def newest_of_task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = None
        for batch in batches:
            both = batch if kept is None else pd.concat([kept, batch])
            runs = both[both["kind"] == "run"].sort_values(["start", "name", "run"], ascending=[False, True, False]).drop_duplicates("name").head(n)
            kept = pd.concat([runs, both[both["kind"] != "run"].drop_duplicates()])
        if kept is not None:
            yield kept

    few = rows.mapInPandas(newest_of_task, rows.schema).withColumn("monitor", F.lit(0))
    made = few.groupBy("monitor").transformWithStateInPandas(Newest(n), "rank int, run string, failed_sources int", "Update", "None")
    return made.select("rank", F.from_json("run", schema).alias("run"), "failed_sources").select("rank", "run.*", "failed_sources")


class LateRows(StreamingQueryListener):
    """Adds up the rows that the watermarks of queries have kept out, in a folder that outlives them.

    A batch that dropped rows leaves an empty file that names the query, the batch and their number, so a batch that
    runs again after a restart is not counted twice, and queries of any number of batches are counted in full.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self.ended: dict[str, threading.Event] = {}
        spark.streams.addListener(self)

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(name)

    def onQueryStarted(self, event) -> None:
        self.ended[str(event.runId)] = threading.Event()

    def onQueryProgress(self, event) -> None:
        p = event.progress
        dropped = sum(s.numRowsDroppedByWatermark for s in p.stateOperators)
        if dropped:
            path = self._path(f"{self.folder}/{p.id}/{p.batchId:012d}-{dropped}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).create(path, True).close()

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended.setdefault(str(event.runId), threading.Event()).set()

    def count(self, query: StreamingQuery, wait: float = 60) -> int:
        """All late rows of a query over its runs; of one that has ended, after its last progress has come in."""
        if not query.isActive and not self.ended.setdefault(str(query.runId), threading.Event()).wait(wait):
            raise TimeoutError("the listener has not heard of the end of the query")
        path = self._path(f"{self.folder}/{query.id}")
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return sum(int(f.getPath().getName().rpartition("-")[2]) for f in fs.listStatus(path)) if fs.exists(path) else 0

    def stop(self) -> None:
        self.spark.streams.removeListener(self)


def for_each_batch(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Runs `handle` on each batch, from where the checkpoint left off; without `every` on what is there, then stops."""
    writer = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Appends what is there to a Parquet table, exactly once across restarts."""
    return stream.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
