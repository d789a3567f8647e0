"""Runs and examples as JSON lines: reading, quarantine of bad lines, idempotent appending."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runlake.functions.columns import strip_binary
from runlake.operators.sampling import top_per
from runlake.sources import store
from runlake.sources.feeds import source_lines
from runlake.sources.shared import new_path

#: Where a line that could not be used went wrong.
BAD = "__corrupt"


def read_lines(spark: SparkSession, *paths: str) -> DataFrame:
    """(file, line) of text files; globs are read like files, by Spark's own readers."""
    return spark.read.text(list(paths)).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("line")).where(F.trim("line") != "")


def read_numbered_lines(spark: SparkSession, *paths: str) -> DataFrame:
    """(file, line, row) of text files: `row` is the number of the line in its file, from 1, blank lines counted.

    A file may be read in several splits. Lines are counted by split, the counts before a split are its offset, and
    a line's place within its split comes from the order in which a task reads it; so texts are read twice and only
    the counts, one for each split, are shuffled.
    """
    block, nth = F.col("_metadata.file_block_start"), F.monotonically_increasing_id()
    lines = spark.read.text(list(paths)).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("line"), block.alias("__block"), nth.alias("__nth"))
    counts = lines.groupBy("file", "__block").agg(F.count("*").alias("__n"), F.min("__nth").alias("__first"))
    before = F.sum("__n").over(Window.partitionBy("file").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("file", "__block", (F.coalesce(before, F.lit(0)) - F.col("__first") + 1).alias("__offset"))
    return lines.join(offsets, ["file", "__block"]).where(F.trim("line") != "").select("file", "line", (F.col("__nth") + F.col("__offset")).alias("row"))


def _quarantine(marked: DataFrame) -> DataFrame:
    """file, line, reason and, where lines are numbered, row of lines that have a reason."""
    return marked.where(F.col("reason").isNotNull()).select("file", "line", "reason", *(["row"] if "row" in marked.columns else []))


def parse_runs(lines: DataFrame, schema: T.StructType, required: tuple[str, ...] = ("id",)) -> tuple[DataFrame, DataFrame]:
    """(runs, quarantine) of (file, line[, row]): a line that is no JSON, does not fit the schema or lacks a required field is put aside with a reason, and its row where lines are numbered."""
    full = T.StructType([*schema.fields, T.StructField(BAD, T.StringType())])
    parsed = lines.withColumn("run", F.from_json("line", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD}))
    missing = None
    for f in required:
        missing = F.col(f"run.{f}").isNull() if missing is None else missing | F.col(f"run.{f}").isNull()
    reason = F.when(F.try_parse_json("line").isNull(), "not JSON").when(F.col(f"run.{BAD}").isNotNull(), "does not fit the schema").when(missing, "a required field is missing")
    parsed = parsed.withColumn("reason", reason)
    good = parsed.where(F.col("reason").isNull()).select("run.*", "file").drop(BAD)
    return good, _quarantine(parsed)


def raw_sample(lines: DataFrame, n: int) -> DataFrame:
    """The first `n` lines that are JSON, by text, without any schema."""
    return lines.where(F.try_parse_json("line").isNotNull()).orderBy("line", "file").limit(n)


def load_projects(stored: DataFrame, wanted: list[str]) -> tuple[DataFrame, DataFrame]:
    """(runs of the wanted projects, wanted projects that have none). Stored as partitions, others are not read."""
    names = stored.sparkSession.createDataFrame([(n,) for n in wanted], "project string")
    runs = stored.where(F.col("project").isin(wanted))
    return runs, names.join(runs.select("project").distinct(), "project", "left_anti")


def load_sources(spark: SparkSession, sources: dict[str, str], schema: T.StructType, limit: int = 0) -> tuple[DataFrame, DataFrame]:
    """(runs, failed) of JSON-line sources by name: runs with their `source`, at most `limit` of each, newest first (0 is all), and (source, reason) of sources that failed.

    A source fails if it cannot be listed or one of its files cannot be read to its end; it is left out as a whole,
    and the others are read. Lines that are no runs of the schema are passed over.
    """
    lines = source_lines(spark, sources)
    failed = lines.where(F.col("error").isNotNull()).groupBy("source").agg(F.min("error").alias("reason"))
    path = new_path(spark, "failed")
    failed.write.parquet(path)  # one row a source; reading them again would read the sources again
    failed = spark.read.schema("source string, reason string").parquet(path)
    full = T.StructType([*schema.fields, T.StructField(BAD, T.StringType())])
    run = F.from_json("line", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD})
    parsed = lines.where(F.col("line").isNotNull()).select("source", run.alias("run")).where(F.col("run").isNotNull() & F.col(f"run.{BAD}").isNull())
    runs = parsed.select("run.*", "source").drop(BAD).join(F.broadcast(failed.select("source")), "source", "left_anti").select(*(f.name for f in schema), "source")
    return (top_per(runs, ["source"], limit) if limit else runs), failed


def valid_examples(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(examples, quarantine, with the row of numbered lines): a line is an object whose `inputs` is an object and whose `outputs` is one, null or missing."""
    v = F.try_parse_json("line")

    def kind(path: str) -> Column:
        return F.coalesce(F.schema_of_variant(F.try_variant_get(v, path, "variant")), F.lit("VOID"))

    whole = F.coalesce(F.schema_of_variant(v), F.lit("VOID"))
    reason = (
        F.when(v.isNull(), "not JSON").when(~whole.startswith("OBJECT"), "not an object").when(~kind("$.inputs").startswith("OBJECT"), "inputs is not an object")
        .when(~(kind("$.outputs").startswith("OBJECT") | (kind("$.outputs") == "VOID")), "outputs is not an object")
    )
    marked = lines.withColumn("reason", reason)
    good = marked.where(F.col("reason").isNull()).select("file", F.get_json_object("line", "$.id").alias("id"), F.get_json_object("line", "$.inputs").alias("inputs"), F.get_json_object("line", "$.outputs").alias("outputs"))
    return good, _quarantine(marked)


def new_rows(batch: DataFrame, stored: DataFrame, order: list[Column], key: str = "id") -> DataFrame:
    """Rows of `batch` to append: of each id the first by `order`, without ids already stored. Running it again adds nothing."""
    w = Window.partitionBy(key).orderBy(*order)
    first = batch.where(F.col(key).isNotNull()).withColumn("__rank", F.row_number().over(w)).where(F.col("__rank") == 1).drop("__rank")
    return first.join(stored.select(key), key, "left_anti")


def strip_payloads(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: strip_binary(c) for c in columns})


def append_runs(batch: DataFrame, path: str, order: list[Column], by_filter: bool = False) -> DataFrame:
    """Appends the new runs of `batch` to the Parquet table at `path`, by project, and merges its metadata; gives what was appended.

    Runs are told apart by (project, id); of those that the batch repeats the first by `order` is taken. The batch is
    evaluated once and staged in the shared folder, from which rows are shuffled once; of the stored table only the ids of its projects are read.
    With `by_filter` a Bloom filter beside the data is asked first, and only files that may hold an id of the batch are
    read, which pays where the stored ids are many times those of a batch; the result is the same.
    """
    spark = batch.sparkSession
    staging = new_path(spark, "staged")
    try:
        store.first_of_each(spark.createDataFrame([], batch.schema), order)
        batch.where(F.col("id").isNotNull()).write.parquet(staging)
    except AnalysisException:  # columns of the order that are bound to the batch mean nothing to the staged table
        store.first_of_each(batch, order).write.parquet(staging)
        order = [F.asc("id")]  # each is there once
    staged = spark.read.schema(batch.schema).parquet(staging)
    touched = [r.project for r in staged.select("project").distinct().collect()]  # folder names
    return store.append(staged, order, touched, path, by_filter)
