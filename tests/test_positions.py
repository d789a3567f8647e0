"""Row numbers of lines in files of several splits, and functions that SQL can call."""

import gzip
import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runlake.functions import register
from runlake.operators import discovery
from runlake.sources import jsonl


@pytest.fixture
def small_splits(spark):
    names = {"spark.sql.files.maxPartitionBytes": "200", "spark.sql.files.openCostInBytes": "1"}
    before = {n: spark.conf.get(n) for n in names}
    for n, v in names.items():
        spark.conf.set(n, v)
    yield
    for n, v in before.items():
        spark.conf.set(n, v)


def test_rows_of_files_of_several_splits(spark, tmp_path, small_splits):
    """Long and blank lines, a file without a last line end, an empty one, and one that cannot be split."""
    lines = {"a.jsonl": [f'{{"id": "{i}", "x": "{"y" * (i % 90)}"}}' if i % 7 else "" for i in range(400)], "b.jsonl": ["{broken"] * 3, "empty.jsonl": [], "c.jsonl.gz": ["", *(f"[{i}]" for i in range(50))]}
    for name, own in lines.items():
        raw = "\n".join(own).encode()
        (tmp_path / name).write_bytes(gzip.compress(raw) if name.endswith("gz") else raw)
    read = jsonl.read_numbered_lines(spark, str(tmp_path))
    assert spark.read.text(str(tmp_path / "a.jsonl")).rdd.getNumPartitions() > 10
    got = {(r.file.rsplit("/", 1)[1], r.row, r.line) for r in read.collect()}
    assert got == {(name, i, x) for name, own in lines.items() for i, x in enumerate(own, 1) if x.strip()}


def test_quarantine_gives_file_and_row(spark, tmp_path, small_splits):
    rows = [json.dumps({"id": str(i), "n": i}) if i % 10 else "{broken" if i % 20 else '{"n": 1}' for i in range(200)]
    (tmp_path / "runs.jsonl").write_text("\n\n".join(rows))
    schema = T.StructType([T.StructField("id", T.StringType()), T.StructField("n", T.LongType())])
    good, bad = jsonl.parse_runs(jsonl.read_numbered_lines(spark, str(tmp_path)), schema)
    assert {(r.row, r.reason) for r in bad.collect()} == {(2 * i + 1, "not JSON" if i % 20 else "a required field is missing") for i in range(0, 200, 10)}
    assert good.count() == 180 and good.columns == ["id", "n", "file"]
    _, examples = jsonl.valid_examples(jsonl.read_numbered_lines(spark, str(tmp_path)))
    assert examples.count() == 200 and {r.row for r in examples.collect()} == set(range(1, 400, 2))


def test_flattening_from_sql(spark):
    payloads = ['{"a": 1, "b": {"c": "x", "d": {"e": [1, {"f": 2}]}, "g": {}}, "n": null}', "[1]", "no JSON", None, "{}", json.dumps({"l1": {"l2": {"l3": {"l4": {"l5": {"l6": 1}}, "four": 4}}}}), '{"":{"x":1}, "a.b": {"c": 2}}']
    df = spark.createDataFrame(list(enumerate(payloads)), "id int, doc string")
    register.register(spark)
    got = spark.sql("SELECT r.id, f.path, to_json(f.value) AS value FROM {runs} r, LATERAL runlake_flatten(r.doc) f", runs=df)
    want = discovery.flatten_json(df, "id", "doc").select("id", "path", F.to_json("value").alias("value"))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) != []


def test_a_detector_of_one_s_own(spark):
    register.register_detector(spark, "my_language", lambda texts: texts.map(lambda t: None if t is None else "loud" if t.isupper() else "quiet"))
    register.register_detector(spark, "my_length", lambda texts: texts.fillna("").str.len().astype("int64"), "long")
    df = spark.createDataFrame([("ABC",), ("abc",), (None,)], "t string")
    assert [tuple(r) for r in spark.sql("SELECT my_language(t), my_length(t) FROM {df}", df=df).collect()] == [("loud", 3), ("quiet", 3), (None, 0)]
