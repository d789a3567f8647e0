"""Inline media within JSON payloads, with and without escapes; a string is parsed once at most."""

import json

from runlake.functions.columns import strip_binary


def stripped(spark, payload):
    df = spark.createDataFrame([(json.dumps(payload, ensure_ascii=False),)], "x string")
    return json.loads(df.select(strip_binary("x").alias("y")).first().y)


def test_strings_with_and_without_escapes(spark):
    plain, lines = "QUJD" * 3000, "QUJD\n" * 3000
    payload = {"a": plain, "b": [lines, 'no "media" \\ here', 'x"' + plain], "c": {"d": 'data:a"b\\c;base64,xé\n', "e": "data:;base64,"}, plain: 1, "data:x;base64,": "data:x"}
    expected = {
        "a": "[binary:base64:12000bytes:...]", "b": ["[binary:base64:15000bytes:...]", 'no "media" \\ here', 'x"' + plain],
        "c": {"d": '[binary:a"b\\c:21bytes:...]', "e": "[binary::13bytes:...]"}, plain: 1, "data:x;base64,": "data:x",
    }
    assert stripped(spark, payload) == expected


def test_a_string_is_parsed_once(spark):
    """It was parsed anew for each part of the rule, some ten times."""
    plan = spark.createDataFrame([("x",)], "x string").select(strip_binary("x").alias("y"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") <= 1
