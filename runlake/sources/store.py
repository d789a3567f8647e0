"""A table of stored runs, in folders by project, with metadata beside them that is merged at each append.

The driver holds a listing of the folders and one row of metadata for each, never runs.
"""

from __future__ import annotations

import uuid
from datetime import UTC, datetime
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runlake.sources import id_filter
from runlake.sources.shared import new_path

META = "project string, run_count long, oldest timestamp, newest timestamp, last_updated timestamp, files long"
_NO_PROJECT = "__HIVE_DEFAULT_PARTITION__"


def data_files(spark: SparkSession, path: str) -> dict[str | None, set[str]]:
    """The table's files by project, from a listing of its folders; empty where there is no table."""
    try:
        files = spark.read.schema("id string, project string").parquet(path).inputFiles()
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return {}
    out: dict[str | None, set[str]] = {}
    for f in files:
        folder = unquote(f).rsplit("/", 2)[1].removeprefix("project=")
        out.setdefault(None if folder == _NO_PROJECT else unquote(folder), set()).add(f)
    return out


def of_projects(runs: DataFrame, projects: list[str | None]) -> DataFrame:
    """Rows of the projects; stored as folders, others are not read."""
    named = F.col("project").isin([p for p in projects if p is not None])
    return runs.where(named | F.col("project").isNull() if None in projects else named)


def _counted(runs: DataFrame) -> dict[str | None, dict]:
    """Count and times of `runs` by project; without start times they are null."""
    start = F.col("start_time") if "start_time" in runs.columns else F.lit(None)
    rows = runs.groupBy("project").agg(F.count("*").alias("run_count"), F.min(start).cast("timestamp").alias("oldest"), F.max(start).cast("timestamp").alias("newest")).collect()
    return {r.project: r.asDict() for r in rows}


def _versions(spark: SparkSession, path: str):
    """Hadoop's file system of `path`, its Path class, and the published versions of the metadata, oldest first."""
    new_path = spark._jvm.org.apache.hadoop.fs.Path
    folder = new_path(f"{path}/_meta")
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    names = sorted(x.getPath().getName() for x in fs.listStatus(folder)) if fs.exists(folder) else []
    return fs, new_path, [n for n in names if n.startswith("v")]


def publish(spark: SparkSession, meta: dict[str | None, dict], path: str) -> None:
    """Writes the next version of the metadata, which one rename makes visible; only the version before it is kept. For one writer at a time."""
    fs, new_path, versions = _versions(spark, path)
    made, name = f"{path}/_meta/new-{uuid.uuid4().hex}", f"v{int(versions[-1][1:]) + 1 if versions else 0:012d}"
    _frame(spark, meta).coalesce(1).write.parquet(made)
    if not fs.rename(new_path(made), new_path(f"{path}/_meta/{name}")):
        raise OSError(f"cannot publish {name} of {path}")
    for old in versions[:-1]:
        fs.delete(new_path(f"{path}/_meta/{old}"), True)


def _frame(spark: SparkSession, meta: dict[str | None, dict]) -> DataFrame:
    names = [f.split(" ")[0] for f in META.split(", ")]
    return spark.createDataFrame([tuple(row.get(n) for n in names) for row in meta.values()], META)


def _known(spark: SparkSession, path: str, files: dict[str | None, set[str]]) -> tuple[dict[str | None, dict], bool]:
    """What is known of each project of the listing, one row a folder, and whether all of it is published."""
    _, _, versions = _versions(spark, path)
    rows = spark.read.schema(META).parquet(f"{path}/_meta/{versions[-1]}").collect() if versions else []
    out = {r.project: r.asDict() for r in rows if len(files.get(r.project, ())) == r.files}
    stale = [p for p in files if p not in out]
    if stale:
        one = unquote(next(iter(files[stale[0]])))
        schema = T.StructType([*(f for f in spark.read.parquet(one).schema if f.name == "start_time"), T.StructField("project", T.StringType())])
        again = _counted(of_projects(spark.read.schema(schema).parquet(path), stale))
        out |= {p: again.get(p, {"project": p, "run_count": 0}) | {"files": len(files[p])} for p in stale}
    return out, not stale


def metadata(spark: SparkSession, path: str) -> DataFrame:
    """META of the table at `path`, without reading its runs.

    A project whose number of files is not the one published, since a writer was stopped between data and metadata
    or is another one, is counted anew; only its folder is read.
    """
    return _frame(spark, _known(spark, path, data_files(spark, path))[0])


def _fresh(staged: DataFrame, order: list[Column], stored: DataFrame | None) -> DataFrame:
    """Of each (project, id) of `staged` the first row by `order`, where `stored` lacks it.

    Both steps part rows by the same two columns, so the rows are shuffled once; for that, rows without a project have the name of their folder meanwhile.
    """
    named = F.coalesce("project", F.lit(_NO_PROJECT))
    fresh = first_of_each(staged.withColumn("project", named), order)
    if stored is not None:
        stored = stored.select(F.col("id").alias("__id"), named.alias("__project"))
        fresh = fresh.join(stored, (F.col("id") == F.col("__id")) & (F.col("project") == F.col("__project")), "left_anti")
    return fresh.withColumn("project", F.nullif("project", F.lit(_NO_PROJECT)))


def _held_by_filter(staged: DataFrame, files: dict[str | None, set[str]], known: dict[str | None, dict], path: str) -> DataFrame | None:
    """(id, project) of the rows of `staged` that the table holds, if any; of `files`, those of the batch's projects, only those are read that may hold one of its ids by the filter."""
    spark = staged.sparkSession
    done = id_filter.covered(spark, path, files)
    have = {f for _, f, *_ in done}
    if open_files := {p: left for p, own in files.items() if (left := own - have)}:
        id_filter.cover(spark, path, open_files, {p: known[p]["run_count"] for p in open_files})
        done = id_filter.covered(spark, path, files)
    hits = new_path(spark, "hits")
    id_filter.possible(staged, done, path).write.parquet(hits)
    found = spark.read.schema("id string, project string, batch string").parquet(hits)
    where = {(r.project, r.batch) for r in found.select("project", "batch").distinct().collect()}  # at most the appends of each folder
    held = [unquote(f) for p, f, _, b in done if (p, b) in where]
    if not held:
        return None
    stored = spark.read.schema("id string, project string").option("basePath", path).parquet(*held)
    asked = found.select(F.col("id").alias("__id"), F.col("project").alias("__project")).distinct()
    return stored.join(asked, (F.col("id") == F.col("__id")) & F.col("project").eqNullSafe(F.col("__project")), "left_semi")


def append(staged: DataFrame, order: list[Column], touched: list[str | None], path: str, by_filter: bool = False) -> DataFrame:
    """Appends of each (project, id) of `staged`, a written table of the projects `touched`, the first row by `order`, if the table at `path` lacks it, and merges its metadata; gives what was appended.

    `by_filter` asks a Bloom filter of the stored ids first, which is kept beside the data.
    """
    spark = staged.sparkSession
    before = data_files(spark, path)
    known, published = _known(spark, path, before)
    stored = None
    if here := [p for p in touched if p in before]:
        if by_filter:
            stored = _held_by_filter(staged, {p: before[p] for p in here}, known, path)
        else:
            stored = of_projects(spark.read.schema("id string, project string").parquet(path), here)
    _fresh(staged, order, stored).write.mode("append").partitionBy("project").parquet(path)
    after = data_files(spark, path)
    new = sorted(f for p, own in after.items() for f in own - before.get(p, set()))
    if not new:
        if not published:
            publish(spark, known, path)
        return staged.limit(0)
    appended = of_projects(spark.read.schema(staged.schema).option("basePath", path).parquet(*(unquote(f) for f in new)).select(*staged.columns), touched)
    now = datetime.now(UTC)
    for p, row in _counted(appended).items():
        old = known.get(p, {"run_count": 0})
        times = {n: best(t for t in (old.get(n), row[n]) if t is not None) if old.get(n) or row[n] else None for n, best in (("oldest", min), ("newest", max))}
        known[p] = {"project": p, "run_count": old["run_count"] + row["run_count"], "last_updated": now, "files": len(after[p])} | times
    if by_filter:
        added = {p: own - before.get(p, set()) for p, own in after.items()}
        id_filter.cover(spark, path, added, {p: known[p]["run_count"] for p, own in added.items() if own})
    publish(spark, known, path)
    return appended


def first_of_each(batch: DataFrame, order: list[Column]) -> DataFrame:
    """Of each (project, id) the first row by `order`; rows without an id go."""
    w = Window.partitionBy("id", "project").orderBy(*order)  # sorted by the id first, which tells rows apart sooner
    return batch.where(F.col("id").isNotNull()).withColumn("__rank", F.row_number().over(w)).where(F.col("__rank") == 1).drop("__rank")
