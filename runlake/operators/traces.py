"""Operators on traces: runs that share a trace_id, of which the root has no parent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def trace_context(runs: DataFrame, metadata: str = "metadata", extra: Column | None = None) -> DataFrame:
    """trace_id, context: each key's value in the trace, the root's first, else the earliest run's (by start, then id).

    `extra` is a map that goes before the metadata of the same run. Empty values are passed over. Values are
    reduced to one for each trace and key before maps are built, so the size of a trace does not matter.
    """
    entries = F.map_entries(metadata)
    if extra is not None:
        own = F.map_filter(extra, lambda _, v: v.isNotNull() & (v != ""))
        entries = F.concat(F.map_entries(own), F.filter(entries, lambda e: ~F.array_contains(F.map_keys(own), e["key"])))
    values = runs.select("trace_id", F.col("parent_run_id").isNotNull().alias("inner"), "start_time", "id", F.explode(entries).alias("e"))
    values = values.where(F.col("e.value").isNotNull() & (F.col("e.value") != ""))
    first = values.groupBy("trace_id", F.col("e.key").alias("key")).agg(F.min_by("e.value", F.struct("inner", "start_time", "id")).alias("value"))
    return first.groupBy("trace_id").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("context"))


def with_context(runs: DataFrame, source: DataFrame | None = None) -> DataFrame:
    """`runs` with the `context` of their trace."""
    return runs.join(trace_context(runs if source is None else source), "trace_id", "left")


def with_children(runs: DataFrame, parents: DataFrame) -> DataFrame:
    """The runs `parents`, each with all other runs of its trace in order of start (unknown starts first), in long form."""
    kids = runs.select("trace_id", F.col("id").alias("child_id"), F.col("start_time").alias("child_start"), F.col("name").alias("child_name"))
    return parents.select("id", "trace_id").join(kids, "trace_id").where(F.col("id") != F.col("child_id")).orderBy("id", F.col("child_start").asc_nulls_first(), "child_id")


def where_root(runs: DataFrame, condition: Column) -> DataFrame:
    """Runs of traces whose root meets the condition."""
    return runs.join(runs.where(F.col("parent_run_id").isNull() & condition).select("trace_id"), "trace_id", "left_semi")


def where_any(runs: DataFrame, condition: Column) -> DataFrame:
    """Runs of traces in which any run meets the condition."""
    return runs.join(runs.where(condition).select("trace_id"), "trace_id", "left_semi")


def where_feedback(runs: DataFrame, feedback: DataFrame, key: str, score: Column) -> DataFrame:
    """Runs with a feedback row that has this key and whose score meets the condition."""
    return runs.join(feedback.where((F.col("key") == key) & score).select(F.col("run_id").alias("id")), "id", "left_semi")


def with_feedback_stats(runs: DataFrame, feedback: DataFrame) -> DataFrame:
    stats = feedback.groupBy("run_id", "key").agg(F.avg("score").alias("avg")).groupBy("run_id").agg(F.map_from_entries(F.collect_list(F.struct("key", "avg"))).alias("feedback_stats"))
    return runs.join(stats.withColumnRenamed("run_id", "id"), "id", "left")
