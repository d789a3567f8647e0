"""Analytics over list fields inside payloads, and payload sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def items(df: DataFrame, keep: list[str], text: str, path: str, schema: str) -> DataFrame:
    """One row for each item of a JSON list field: `keep` and `item`."""
    return df.select(*keep, F.explode(F.from_json(F.get_json_object(text, path), f"array<{schema}>")).alias("item"))


def count_items(unnested: DataFrame, value: Column) -> DataFrame:
    return unnested.groupBy(value.alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value")


def distinct_items(unnested: DataFrame, *keys: Column) -> DataFrame:
    """Items once for each combination of keys, such as minute, channel and value."""
    return unnested.select(*keys).distinct()


def largest_payloads(df: DataFrame, text: Column, top: int = 10) -> DataFrame:
    return df.select("id", F.length(text).alias("chars")).orderBy(F.desc("chars"), "id").limit(top)
