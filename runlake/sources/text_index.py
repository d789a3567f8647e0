"""A trigram index of the texts of a Parquet table, by file, so that a search opens only files that may hold its text.

The index has a row for each trigram and file, in order of the trigrams, so row groups without a searched one are not
read; a second table, written last, names the files that are indexed. A file that is not is always searched, and one
that is gone is not looked for. Whole texts are indexed, as they are and in small letters.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from urllib.parse import unquote

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

GRAMS, FILES = "gram long, file string", "file string"
#: Code points that a slice of a text has at most while its trigrams are taken; rows of (gram, file) that a file of the index should have.
_SLICE, _ROWS = 1 << 22, 5_000_000


def grams_of(text: str) -> np.ndarray:
    """Distinct trigrams of a text as numbers: three code points of 21 bits each, so different ones never share a number."""
    found = [np.empty(0, np.int64)]
    for at in range(0, max(0, len(text) - 2), _SLICE):
        points = np.frombuffer(text[at : at + _SLICE + 2].encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        found.append(np.unique((points[:-2] << 42) | (points[1:-1] << 21) | points[2:]))
    return found[-1] if len(found) == 2 else np.unique(np.concatenate(found))


def _grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for file, texts in batch.groupby("file"):
            grams = np.empty(0, np.int64)
            for column in ("text", "small"):
                for text in texts[column].dropna():
                    grams = np.union1d(grams, grams_of(text)) if len(text) > 10_000 else np.concatenate([grams, grams_of(text)])
                    if len(grams) > 2_000_000:
                        grams = np.unique(grams)
            yield pd.DataFrame({"gram": np.unique(grams), "file": file})


def _files(spark: SparkSession, path: str) -> set[str]:
    """Addresses of the files of a Parquet table, from its listing; none where there is no table."""
    try:
        return set(spark.read.schema("none string").parquet(path).inputFiles())
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return set()


def _indexed(spark: SparkSession, index: str) -> set[str]:
    """Addresses of indexed files, one row a file, as in the listing of the table."""
    return {r.file for r in spark.read.schema(FILES).parquet(f"{index}/files").collect()} if _files(spark, f"{index}/files") else set()


def index_texts(spark: SparkSession, path: str, index: str, *texts: Column) -> int:
    """Indexes those files of the table at `path` that the `index` folder lacks; gives how many. `texts` are what searches look at: columns, or the JSON text of some."""
    missing = sorted(_files(spark, path) - _indexed(spark, index))
    if not missing:
        return 0
    rows = spark.read.option("basePath", path).parquet(*map(unquote, missing))
    text = F.explode(F.array(*(t.cast("string") for t in texts)))
    rows = rows.select(F.input_file_name().alias("file"), text.alias("text")).where(F.length("text") > 2)
    rows = rows.withColumn("small", F.nullif(F.lower("text"), F.col("text")))
    staged = f"{index}/staged-{uuid.uuid4().hex}"
    rows.mapInPandas(_grams, GRAMS).distinct().write.parquet(staged)
    grams = spark.read.schema(GRAMS).parquet(staged)
    parts = max(1, math.ceil(grams.count() / _ROWS))
    grams.repartitionByRange(parts, "gram", "file").sortWithinPartitions("gram", "file").write.mode("append").parquet(f"{index}/grams")
    spark.createDataFrame([(f,) for f in missing], FILES).coalesce(1).write.mode("append").parquet(f"{index}/files")
    folder = spark._jvm.org.apache.hadoop.fs.Path(staged)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    return len(missing)


def files_with(spark: SparkSession, path: str, index: str, query: str) -> list[str]:
    """Files of the table at `path` that may hold the literal text `query`, or `query` in small letters for a search in any case: those with all its trigrams and those not indexed.

    A query of fewer than three signs rules no file out.
    """
    files, indexed = _files(spark, path), _indexed(spark, index)
    wanted = [int(g) for g in grams_of(query)]
    if not wanted or not files & indexed:
        return sorted(files)
    grams = spark.read.schema(GRAMS).parquet(f"{index}/grams").where(F.col("gram").between(min(wanted), max(wanted)) & F.col("gram").isin(wanted))
    held = grams.groupBy("file").agg(F.count_distinct("gram").alias("n")).where(F.col("n") == len(wanted))
    return sorted((files - indexed) | (files & {r.file for r in held.select("file").collect()}))


def search_files(spark: SparkSession, path: str, index: str, query: str, *texts: Column, ignore_case: bool = False) -> DataFrame:
    """Rows of the table at `path` of which one of the indexed `texts` holds the literal `query`: the same as of a scan, from those files only that may hold it."""
    asked = query.lower() if ignore_case else query
    files = files_with(spark, path, index, asked)
    rows = spark.read.option("basePath", path).schema(spark.read.parquet(path).schema)
    rows = rows.parquet(*map(unquote, files)) if files else rows.parquet(path).limit(0)
    found = F.lit(False)
    for t in texts:
        t = t.cast("string")
        found = found | F.coalesce((F.lower(t) if ignore_case else t).contains(asked), F.lit(False))
    return rows.where(found)
