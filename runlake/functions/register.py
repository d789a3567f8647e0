"""Makes functions callable from SQL."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .columns import MODEL_PROVIDERS

#: Levels of nested objects that the table function opens.
FLATTEN_DEPTH = 5


def register(spark: SparkSession) -> None:
    """runlake_model, runlake_provider, runlake_hour and runlake_day as SQL functions; Catalyst inlines them."""
    cases = " ".join(f"WHEN startswith(lower(m), '{p}') OR contains(lower(m), '/{p}') THEN '{who}'" for p, who in MODEL_PROVIDERS)
    for name, arguments, body in (
        ("runlake_model", "a STRING, b STRING, c STRING", "coalesce(nullif(a, ''), nullif(coalesce(b, c), ''), 'unknown')"),
        ("runlake_provider", "m STRING, g STRING", f"CASE {cases} WHEN g <> 'unknown' THEN initcap(g) ELSE 'unknown' END"),
        ("runlake_hour", "t TIMESTAMP", "coalesce(date_format(date_trunc('HOUR', t), \"yyyy-MM-dd'T'HH:00'Z'\"), 'unknown')"),
        ("runlake_day", "t TIMESTAMP", "coalesce(date_format(t, 'yyyy-MM-dd'), 'unknown')"),
    ):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS STRING RETURN {body}")
    register_flatten(spark)


def register_flatten(spark: SparkSession, max_depth: int = FLATTEN_DEPTH) -> None:
    """runlake_flatten(text) as a table function: (path, value VARIANT) of the leaves of a JSON object under dotted paths, as `discovery.flatten_json` gives them.

    Lists and empty objects are leaves; an object below `max_depth` levels disappears; text that is no JSON has none.
    Use it laterally: FROM runs, LATERAL runlake_flatten(runs.inputs).
    """
    kind = "coalesce(schema_of_variant({0}) LIKE 'OBJECT%' AND schema_of_variant({0}) <> 'OBJECT<>', false)"
    level = "SELECT '' AS path, try_parse_json(doc) AS value"
    for k in range(max_depth):
        opened = f"LATERAL variant_explode_outer(CASE WHEN {kind.format('t.value')} THEN t.value END) e"
        path = "CASE WHEN e.key IS NULL THEN t.path WHEN t.path = '' THEN e.key ELSE concat(t.path, '.', e.key) END"
        start = f" WHERE {kind.format('t.value')}" if k == 0 else ""
        level = f"SELECT {path} AS path, CASE WHEN e.key IS NULL THEN t.value ELSE e.value END AS value FROM ({level}) t, {opened}{start}"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION runlake_flatten(doc STRING) RETURNS TABLE(path STRING, value VARIANT) RETURN SELECT path, value FROM ({level}) WHERE NOT {kind.format('value')}")


def register_detector(spark: SparkSession, name: str, detect: Callable[[pd.Series], pd.Series], returns: str | T.DataType = "string") -> None:
    """A detector of the user's own as an SQL function of one text: `detect` gets and gives whole series, in Arrow batches."""

    def batch(texts: pd.Series) -> pd.Series:
        return detect(texts)

    spark.udf.register(name, F.pandas_udf(batch, returns))
