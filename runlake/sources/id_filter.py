"""Bloom filters of stored ids beside a table of runs, as rows that a join looks up.

A filter is a Parquet table of blocks of 256 bits in eight words, in each of which an id sets one bit; of an append's
ids those of a project share a number of blocks, `size`, that follows the runs the project then has. A file of the table
counts as covered when a second table, written last, names it; what is not covered is read and covered first, so
that no stored id is ever missed. After files of the table have been replaced by others, delete the folder `_ids`.
"""

from __future__ import annotations

import uuid
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORDS = [f"w{i}" for i in range(8)]
BITS = f"size long, block long, batch string, {', '.join(f'{w} int' for w in WORDS)}, project string"
FILES = "project string, file string, size long, batch string"
#: About one id in a thousand that is not stored is taken for a possible hit.
IDS_A_BLOCK = 16


def _name(file: str) -> str:
    return unquote(file).rsplit("/", 1)[1]


def _same_project(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def covered(spark: SparkSession, path: str, files: dict[str | None, set[str]]) -> list[tuple[str | None, str, int, str]]:
    """(project, file, size, batch) of those files of the listing that the filter covers; one row a file, as in the listing."""
    try:
        rows = spark.read.schema(FILES).parquet(f"{path}/_ids/files").collect()
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return []
    names = {(p, _name(f)): f for p, own in files.items() for f in own}
    return [(r.project, names[r.project, r.file], r.size, r.batch) for r in rows if (r.project, r.file) in names]


def _with_bits(ids: DataFrame, sizes: DataFrame) -> DataFrame:
    """`ids` (id, project) once for every size of its project (__project, size), with block and bits; `sizes` has a few rows a folder."""
    rows = ids.join(F.broadcast(sizes), _same_project("project", "__project")).drop("__project")
    rows = rows.withColumns({"block": F.pmod(F.xxhash64("id"), F.col("size")), "__bits": F.xxhash64("id", F.lit(1))})
    return rows.withColumns({w: F.expr(f"shiftleft(1, CAST(shiftrightunsigned(__bits, {5 * i}) & 31 AS INT))") for i, w in enumerate(WORDS)}).drop("__bits")


def cover(spark: SparkSession, path: str, files: dict[str | None, set[str]], counts: dict[str | None, int]) -> None:
    """Adds the ids of `files`, by project, to the filter; `counts` is how many runs each project has by now."""
    files = {p: own for p, own in files.items() if own}
    if not files:
        return
    batch = uuid.uuid4().hex
    sizes = {p: 1 << max(0, -(-counts.get(p, 0) // IDS_A_BLOCK) - 1).bit_length() for p in files}
    every = (unquote(f) for own in files.values() for f in own)
    ids = spark.read.schema("id string, project string").option("basePath", path).parquet(*every).where(F.col("id").isNotNull())
    rows = _with_bits(ids, spark.createDataFrame(list(sizes.items()), "__project string, size long"))
    bits = rows.groupBy("project", "size", "block").agg(F.lit(batch).alias("batch"), *(F.bit_or(w).alias(w) for w in WORDS))
    bits.write.mode("append").partitionBy("project").parquet(f"{path}/_ids/bits")
    named = [(p, _name(f), sizes[p], batch) for p, own in files.items() for f in own]
    spark.createDataFrame(named, FILES).coalesce(1).write.mode("append").parquet(f"{path}/_ids/files")


def possible(ids: DataFrame, known: list[tuple[str | None, str, int, str]], path: str) -> DataFrame:
    """(id, project, batch): those `ids` (id, project) that a batch covered by the filter may hold. Only the filter is read, of the projects of `known`."""
    spark = ids.sparkSession
    sizes = spark.createDataFrame(sorted({(p, size) for p, _, size, _ in known}, key=str), "__project string, size long")
    asked = _with_bits(ids.select("id", "project"), sizes)
    projects = {p for p, *_ in known}
    bits = spark.read.schema(BITS).parquet(f"{path}/_ids/bits")
    named = F.col("project").isin([p for p in projects if p is not None])
    bits = bits.where(named | F.col("project").isNull() if None in projects else named)
    bits = bits.select("batch", *(F.col(c).alias(f"__{c}") for c in ("project", "size", "block", *WORDS)))
    held = [F.col(f"__{w}").bitwiseAND(F.col(w)) == F.col(w) for w in WORDS]
    met = asked.join(bits, [_same_project("project", "__project"), F.col("size") == F.col("__size"), F.col("block") == F.col("__block"), *held])
    return met.select("id", "project", "batch")
