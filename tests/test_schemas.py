"""Schemas summed up by kinds of payload, against every value opened in plain Python."""

import json

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from runlake.operators import discovery


def kind_of(v):
    return {bool: "bool", int: "int", float: "float", str: "str", dict: "dict", list: "list"}[type(v)]


def opened(v, path, depth):
    if depth and isinstance(v, dict):
        for k, x in v.items():
            yield from [(f"{path}.{k}" if path else k, x)]
            yield from opened(x, f"{path}.{k}" if path else k, depth - 1)
    elif depth and isinstance(v, list):
        for x in v:
            yield (f"{path}[]", x)
            yield from opened(x, f"{path}[]", depth - 1)


def plain(rows, depth=8):
    kinds, keys = {}, {}
    for key, text in rows:
        try:
            v = json.loads(text)
        except (TypeError, ValueError):
            continue
        for path, x in opened(v, "", depth):
            if x is not None:
                kinds.setdefault(path, set()).add(kind_of(x))
                keys.setdefault(path, set()).add(key)
    return {p: (kinds[p].pop() if len(kinds[p]) == 1 else "mixed", len(keys[p]), min(keys[p])) for p in kinds}


def check(spark, rows):
    df = spark.createDataFrame(rows, "id string, t string")
    got = discovery.infer_schema(df, "id", "t", sample=10**6).collect()
    expected = plain(rows)
    assert {r.path: (r.type, r.present_count) for r in got} == {p: (t, n) for p, (t, n, _) in expected.items()}
    text = dict(rows)
    for r in got:  # the sample is a value of the smallest key
        values = [x for p, x in opened(json.loads(text[expected[r.path][2]]), "", 8) if p == r.path]
        assert json.loads(r.sample) in values


def test_lists_that_mix_types(spark):
    texts = ['{"a": [1, 2], "z": 1.5}', '{"a": [1, 2.5], "z": 2.25}', '{"a": [2.5, 3.5]}', '{"a": [1, "x"]}', '{"a": [1, {"k": 1}]}', '{"a": [{"k": 1}, {"k": 1.5}]}', '{"a": [{"k": [1]}], "b": 1e3}', '{"a": [[1], ["x"]]}', '{"a": []}', '{"a": [null]}',
             '{"DECIMAL": [1], "`ARRAY<": [1.5], "a b": {"VARIANT": null}}', "[1, 2]", "3", "no JSON", "", None, "{}", '{"deep": ' * 12 + "1" + "}" * 12]
    check(spark, [(f"k{i:02d}", t) for i, t in enumerate(texts)])
    assert discovery.infer_schema(spark.createDataFrame([], "id string, t string"), "id", "t").collect() == []


def test_one_payload_of_a_schema_is_opened(spark):
    df = spark.range(2000).selectExpr("lpad(id, 5, '0') AS id", "concat('{\"a\": {\"b\": ', id, '.5}, \"l\": [1, ', id, ']}') AS t")
    assert discovery._kinds_of_payload(df, "id", "t").count() == 1
    got = {r.path: (r.type, r.present_count, r.sample) for r in discovery.infer_schema(df, "id", "t").collect()}
    assert got == {"a": ("dict", 2000, '{"b":0.5}'), "a.b": ("float", 2000, "0.5"), "l": ("list", 2000, "[1,0]"), "l[]": ("int", 2000, "0")}


leaf = st.one_of(st.none(), st.booleans(), st.integers(-9, 9), st.sampled_from([0.5, 2.25, 1e30]), st.sampled_from(["", "x", "DECIMAL"]))
value = st.recursive(leaf, lambda x: st.one_of(st.lists(x, max_size=3), st.dictionaries(st.sampled_from(["a", "b", "a b", "c`<"]), x, max_size=3)), max_leaves=8)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(value, min_size=5, max_size=60))
def test_any_payloads(spark, values):
    check(spark, [(f"k{i:03d}", json.dumps(v)) for i, v in enumerate(values)])
