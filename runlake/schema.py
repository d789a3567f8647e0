"""Schemas of the tables the operators work on."""

from __future__ import annotations

from pyspark.sql import types as T

#: A run as stored: a fixed envelope, payloads as JSON text, hot metadata as maps.
RUN_SCHEMA = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("id", "name", "run_type", "status", "error", "trace_id", "parent_run_id", "session_id", "reference_example_id", "inputs", "outputs")]
    + [T.StructField(n, T.TimestampType()) for n in ("start_time", "end_time", "first_token_time")]
    + [
        T.StructField("tags", T.ArrayType(T.StringType())),
        T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
        T.StructField("invocation_params", T.MapType(T.StringType(), T.StringType())),
    ]
    + [T.StructField(n, T.LongType()) for n in ("total_tokens", "prompt_tokens", "completion_tokens")]
    + [T.StructField(n, T.DecimalType(38, 12)) for n in ("total_cost", "prompt_cost", "completion_cost")]
)

#: Price per million tokens of a model or of "model+tier".
PRICE_SCHEMA = T.StructType([T.StructField("model", T.StringType()), T.StructField("input_per_million", T.DoubleType()), T.StructField("output_per_million", T.DoubleType())])

EXAMPLE_SCHEMA = T.StructType([T.StructField(n, T.StringType()) for n in ("id", "dataset_id", "inputs", "outputs", "source_run_id")])
