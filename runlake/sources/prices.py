"""Price tables and price catalogues."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def load_prices(raw: DataFrame) -> DataFrame:
    """model (small letters), input_per_million, output_per_million; a row with a model but not both prices is an error."""
    out = raw.where(F.col("model").isNotNull()).select(F.lower("model").alias("model"), *(F.col(c).try_cast("double").alias(c) for c in ("input_per_million", "output_per_million")))
    broken = F.col("input_per_million").isNull() | F.col("output_per_million").isNull()
    return out.withColumn("model", F.when(broken, F.raise_error(F.concat(F.lit("both prices are needed: "), F.col("model")))).otherwise(F.col("model")))


def load_catalogue(lines: DataFrame) -> DataFrame:
    """id, input_per_million, output_per_million of JSON entries (line) with prices per token as text; entries without both are left out."""
    price = {k: F.round(F.get_json_object("line", f"$.pricing.{p}").try_cast("double") * 1e6, 4) for k, p in (("input_per_million", "prompt"), ("output_per_million", "completion"))}
    out = lines.select(F.get_json_object("line", "$.id").alias("id"), *(c.alias(k) for k, c in price.items()))
    return out.dropna()
