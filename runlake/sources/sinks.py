"""Results as JSON lines, CSV or Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runlake.operators.entities import prune


def flat(df: DataFrame) -> DataFrame:
    """Lists, maps and structs as JSON text, for formats without them."""
    return df.select(*(F.to_json(f.name).alias(f.name) if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)) else F.col(f.name) for f in df.schema))


def write(df: DataFrame, path: str, kind: str = "json", fields: list[str] | None = None, partition_by: list[str] | None = None, mode: str = "errorifexists") -> None:
    """Writes the named fields (all by default); nested values are JSON text in CSV, text keeps its signs."""
    out = prune(df, [*fields, *(partition_by or [])]) if fields else df
    writer = (flat(out) if kind == "csv" else out).write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if kind == "csv":
        writer.option("header", True).option("escape", '"').csv(path)
    elif kind in ("json", "parquet"):
        getattr(writer, kind)(path)
    else:
        raise ValueError(f"cannot write {kind!r}")
