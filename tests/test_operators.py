import random
import statistics
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runlake.functions import columns as C
from runlake.operators import discovery, entities, metrics, pricing, sampling, traces, usage
from runlake.operators import predicates as P
from runlake.operators.text import language
from runlake.sources import jsonl, sinks
from runlake.streaming import monitor


def one(spark, column, **values):
    kinds = {str: T.StringType(), float: T.DoubleType(), int: T.LongType()}
    schema = T.StructType([T.StructField(k, T.ArrayType(T.StringType()) if isinstance(v, list) else T.MapType(T.StringType(), T.StringType()) if isinstance(v, dict) else kinds.get(type(v), T.StringType())) for k, v in values.items()])
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first().x


def runs(spark, rows):
    """rows: dicts over a few defaults."""
    schema = "id string, trace_id string, parent_run_id string, project string, name string, run_type string, start_time timestamp, latency_s double, error string, tags array<string>, metadata map<string,string>, model string, gateway string, service_tier string, total_tokens long, prompt_tokens long, completion_tokens long, total_cost double, prompt_cost double, completion_cost double"
    base = dict(trace_id="t", parent_run_id=None, project="p", name="n", run_type="llm", start_time=datetime(2026, 3, 9, 16), latency_s=1.0, error=None, tags=[], metadata={}, model="m", gateway="unknown", service_tier="unknown", total_tokens=1000, prompt_tokens=700, completion_tokens=300, total_cost=0.0, prompt_cost=0.0, completion_cost=0.0)
    names = [f.split()[0] for f in schema.split(", ")]
    return spark.createDataFrame([tuple((base | {"id": str(i)} | r)[n] for n in names) for i, r in enumerate(rows)], schema)


def test_exclusive_quantiles_match_python(spark):
    rng = random.Random(3)
    groups = {f"g{n}": [rng.uniform(0, 50) for _ in range(n)] for n in (2, 3, 7, 19, 20, 21, 100, 133)}
    groups["same"] = [4.0] * 9
    df = spark.createDataFrame([(k, x) for k, v in groups.items() for x in v], "k string, x double")
    got = {r.k: r for r in metrics.exclusive_quantiles(df, ["k"], "x", metrics.EXCLUSIVE).collect()}
    for k, v in groups.items():
        assert got[k].p95_latency == pytest.approx(statistics.quantiles(v, n=20)[18])
        assert got[k].p99_latency == pytest.approx(statistics.quantiles(v, n=100)[98])
    single = metrics.exclusive_quantiles(spark.createDataFrame([("a", 3.0), ("b", None)], "k string, x double"), ["k"], "x", metrics.EXCLUSIVE).collect()
    assert [(r.k, r.p95_latency) for r in single] == [("a", 3.0)]


def test_grouped_metrics(spark):
    df = runs(spark, [{"tags": ["length:short"], "latency_s": 1.0}] * 5 + [{"tags": ["length:long"], "latency_s": 5.0, "error": "E"}] * 3 + [{"tags": []}])
    got = {r.length: r for r in metrics.grouped_metrics(df, {"length": C.group_value("tag", "length")}).collect()}
    assert set(got) == {"short", "long"} and got["short"]["count"] == 5 and got["long"].avg_latency == 5.0 and got["long"].error_rate == 1.0
    series = runs(spark, [{"latency_s": float(i), "tags": ["a:b"]} for i in range(1, 101)])
    r = metrics.grouped_metrics(series, {"a": C.group_value("tag", "a")}).first()
    assert r.p50_latency == pytest.approx(50.5) and r.p95_latency >= 95 and r.p99_latency >= 99
    assert metrics.grouped_metrics(series, {"a": C.group_value("tag", "a")}, ["count"], approximate=True).columns == ["a", "count"]
    with pytest.raises(ValueError):
        metrics.grouped_metrics(series, {"a": F.lit("x")}, ["p42"])


def test_usage_summary_counts_concurrent_groups(spark):
    at = lambda h: datetime(2026, 3, 9, h)
    df = runs(spark, [{"start_time": at(16), "metadata": {"room": r}} for r in "abc"] + [{"start_time": at(17), "metadata": {"room": "a"}}])
    s = usage.usage_summary(usage.usage_cube(df, "hour", F.col("metadata")["room"])).first()
    assert (s.max_concurrent, s.avg_concurrent, s.unique_groups, s.active_buckets, s.run_count) == (3, 2.0, 3, 2, 4)
    empty = usage.usage_summary(usage.usage_cube(df.limit(0), "hour")).first()
    assert (empty.run_count, empty.max_concurrent, empty.total_tokens) == (0, 0, 0)


def test_price_of_tier_goes_first_and_known_costs_stay(spark):
    prices = spark.createDataFrame([("M", 2.0, 10.0), ("m+flex", 1.0, 5.0)], "model string, input_per_million double, output_per_million double")
    df = runs(spark, [{}, {"service_tier": "flex"}, {"total_cost": 9.0}, {"model": "other"}, {"total_tokens": 0}])
    got = {r.id: r.total_cost for r in pricing.estimate_costs(df, prices).collect()}
    assert got == {"0": pytest.approx(0.0044), "1": pytest.approx(0.0022), "2": 9.0, "3": 0.0, "4": 0.0}


def test_catalogue_candidates_in_order(spark):
    models = spark.createDataFrame([("llama-3",), ("gpt-4",), ("x-versatile",)], "model string")
    catalogue = spark.createDataFrame([("meta-llama/llama-3-instruct", 1.0, 1.0), ("Meta-Llama/Llama-3", 2.0, 2.0), ("openai/gpt-4", 3.0, 3.0), ("meta-llama/x-instruct", 4.0, 4.0)], "id string, input_per_million double, output_per_million double")
    got = {r.model: r.catalogue_id for r in pricing.match_catalogue(models, catalogue).collect()}
    assert got == {"llama-3": "Meta-Llama/Llama-3", "gpt-4": "openai/gpt-4", "x-versatile": "meta-llama/x-instruct"}


def test_trace_context_prefers_the_root(spark):
    df = runs(spark, [{"id": "root", "metadata": {"room": "r"}, "start_time": datetime(2026, 3, 10)}, {"id": "kid", "parent_run_id": "root", "metadata": {"room": "k", "x": "1"}}, {"id": "kid2", "parent_run_id": "root", "metadata": {"x": "2", "y": ""}, "start_time": datetime(2026, 3, 8)}])
    assert traces.trace_context(df).first().context == {"room": "r", "x": "2"}


def test_semi_joins(spark):
    df = runs(spark, [{"id": "a", "trace_id": "1", "error": "E"}, {"id": "b", "trace_id": "1", "parent_run_id": "a"}, {"id": "c", "trace_id": "2"}, {"id": "d", "trace_id": "2", "parent_run_id": "c", "error": "E"}])
    ids = lambda x: sorted(r.id for r in x.select("id").collect())
    assert ids(traces.where_root(df, P.failed())) == ["a", "b"]
    assert ids(traces.where_any(df, P.failed())) == ["a", "b", "c", "d"]
    feedback = spark.createDataFrame([("a", "k", 1.0), ("b", "k", 0.0), ("c", "z", 1.0)], "run_id string, key string, score double")
    assert ids(traces.where_feedback(df, feedback, "k", F.col("score") > 0.5)) == ["a"]


def test_wildcards_and_names(spark):
    names = spark.createDataFrame([(n,) for n in ("prod-api-v1", "prod-web-v1", "staging-api", "test1", "test2", "test10", None, "a.b", "a+b", "[x]")], "name string")
    found = lambda c: sorted(r.name for r in names.where(c).collect())
    assert found(P.name_matches(glob="prod-*")) == ["prod-api-v1", "prod-web-v1"]
    assert found(P.name_matches(glob="test?")) == ["test1", "test2"]
    assert found(P.name_matches(glob="test[!1]")) == ["test2"]
    assert found(P.name_matches(glob="a.b")) == ["a.b"] and found(P.name_matches(glob="a+?")) == ["a+b"]
    assert found(P.name_matches(exact="test1", regex=".*")) == ["test1"]
    assert found(P.name_matches(regex="api", contains="v1")) == ["prod-api-v1"]
    assert found(P.excludes(["test", "prod"]) & F.col("name").isNotNull()) == ["[x]", "a+b", "a.b", "staging-api"]
    assert names.where(P.excludes(["test", "prod"]) & F.col("name").isNull()).count() == 1
    with pytest.raises(ValueError):
        P.name_matches(regex="(")


def test_time_windows():
    now = datetime(2024, 1, 31)
    with pytest.raises(ValueError):
        P.time_window(since=now, before=now, last=timedelta(1))
    with pytest.raises(ValueError):
        P.time_window(last=timedelta(1))
    with pytest.raises(ValueError):
        P.root_scope(True, parent_id="x")


def test_metadata_modes(spark):
    value = dict(metadata={"k": "abc"}, tags=["k:tagged", "plain"], context={"k": "ctx"})
    hit = lambda p: one(spark, P.metadata_or_tag("k", p, context="context"), **value)
    assert hit("abc") and hit("a*") and hit("/^a.c$/") and hit("tagged") and hit("plain") and hit("c?x")
    assert not hit("zzz") and not hit("/(/")
    assert one(spark, P.metadata_like("none", "*"), metadata={"k": "v"})


def test_scalars(spark):
    assert one(spark, C.display_model(F.lit(None).cast("string"), F.col("m")), m="a" * 30) == "a" * 17 + "..."
    assert one(spark, C.full_model(F.lit(""), F.col("m"), F.lit("name")), m="") == "unknown"
    assert one(spark, C.provider("m", "g"), m="cerebras/gpt-oss", g="unknown") == "OpenAI"
    assert one(spark, C.provider("m", "g"), m="mine", g="azure_openai") == "Azure_Openai"
    assert one(spark, C.tag_value("t", "a"), t=["b:1", "a:2", "a:3"]) == "2" and one(spark, C.tag_value("t", "a"), t=[]) is None
    assert one(spark, C.strip_binary("x"), x="A" * 20_000) == "[binary:base64:20000bytes:...]"
    assert one(spark, C.strip_binary("x"), x="data:video/mp4;base64,AAAA") == "[binary:video/mp4:26bytes:...]"
    prose = "It is prose, with signs. " * 1400
    assert one(spark, C.strip_binary("x"), x=prose) == prose
    assert one(spark, C.input_context("x")["channel_id"], x='{"channel_info": "{\\"channel_id\\": \\"7\\"}"}') == "7"
    assert one(spark, C.input_context("x")["channel_id"], x='{"channel_info": {"channel_id": "8"}}') == "8"
    assert one(spark, language("x"), x="short") is None
    assert one(spark, language("x"), x="the cat and the dog are in the house of the king") == "en"


def test_flatten_and_schema(spark):
    deep = '{"a":{"b":{"c":{"d":{"e":{"f":1}}}}},"l":[{"x":1,"y":"s"},{"x":"t"}],"n":null,"z":{}}'
    df = spark.createDataFrame([("1", deep), ("2", "broken{"), ("3", '{"v":42}'), ("4", '{"v":"hello"}')], "id string, j string")
    got = sorted((r.id, r.path) for r in discovery.flatten_json(df, "id", "j").select("id", "path").collect())
    assert got == [("1", "l"), ("1", "n"), ("1", "z"), ("3", "v"), ("4", "v")]
    schema = {r.path: (r.type, r.present_count) for r in discovery.infer_schema(df, "id", "j").collect()}
    assert schema["v"] == ("mixed", 2) and schema["l[].x"] == ("mixed", 1) and schema["l[].y"] == ("str", 1) and schema["l"] == ("list", 1)


def test_stratified_sample(spark):
    df = runs(spark, [{"tags": [f"length:{a}", f"content:{b}"]} for a in ("short", "long") for b in ("news", "gaming") for _ in range(4)])
    strata = {"a": C.group_value("tag", "length"), "b": C.group_value("tag", "content")}
    got = sampling.stratified(df, strata, 2, combinations=[("short", "news"), ("long", "gaming")]).groupBy("stratum").count().collect()
    assert {(r.stratum, r["count"]) for r in got} == {("short:news", 2), ("long:gaming", 2)}
    with pytest.raises(ValueError):
        sampling.stratified(df, strata, 2, combinations=[("short",)])
    with pytest.raises(ValueError):
        sampling.sort_by(df, "-nothing", {"name": F.col("name")})


def test_resolve_and_suggest(spark):
    known = spark.createDataFrame([("123e4567-e89b-12d3-a456-426614174000", "alpha"), ("id2", "beta"), ("alpha", "gamma")], "id string, name string")
    asked = spark.createDataFrame([("alpha",), ("id2",), ("123e4567-e89b-12d3-a456-426614174000",), ("none",)], "query string")
    got = {r.query: r.id for r in entities.resolve(asked, known).collect()}
    assert got["alpha"].startswith("123e") and got["id2"] == "id2" and got["none"] is None and got["123e4567-e89b-12d3-a456-426614174000"].startswith("123e")
    names = spark.createDataFrame([("prd/api",), ("prd/web",), ("dev/api-v2",), ("other",)], "name string")
    best = entities.suggest_names(spark.createDataFrame([("prd/api-v2",)], "query string"), names).collect()
    assert {r.name for r in best} == {"prd/api", "prd/web", "dev/api-v2"} and best[0].score <= 1


def test_json_lines_round_trip(spark, tmp_path):
    path = tmp_path / "in"
    path.mkdir()
    (path / "a.jsonl").write_text('{"id":"1","n":1}\n\n{"id":"2","n":"x"}\n{broken\n{"n":3}\n{"id":"4","n":4}\n')
    schema = T.StructType([T.StructField("id", T.StringType()), T.StructField("n", T.LongType())])
    good, bad = jsonl.parse_runs(jsonl.read_lines(spark, str(path)), schema)
    assert sorted(r.id for r in good.collect()) == ["1", "4"]
    assert sorted(r.reason for r in bad.collect()) == ["a required field is missing", "does not fit the schema", "not JSON"]
    out = str(tmp_path / "out")
    batch = good.select("id", "n", F.lit("p").alias("project"))
    jsonl.append_runs(batch, out, [F.asc("n")])
    jsonl.append_runs(batch.unionAll(batch), out, [F.asc("n")])
    assert spark.read.parquet(out).count() == 2
    sinks.write(runs(spark, [{"tags": ["é", 'a"b']}]), str(tmp_path / "csv"), "csv", ["id", "tags"])
    assert spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "csv")).first().tags == '["é","a\\"b"]'
    with pytest.raises(ValueError):
        sinks.write(good, str(tmp_path / "x"), "yaml")


def test_stream_skips_bad_lines_and_repeats(spark, tmp_path):
    (tmp_path / "in").mkdir()
    line = '{"id":"%s","start_time":"2024-01-01T00:00:%02dZ"}\n'
    (tmp_path / "in" / "a").write_text(line % ("1", 1) + line % ("1", 2) + "{bad\n" + line % ("2", 3))
    schema = T.StructType([T.StructField("id", T.StringType()), T.StructField("start_time", T.TimestampType())])
    for _ in range(2):
        stream = monitor.once_per_id(monitor.run_stream(spark, str(tmp_path / "in"), schema))
        monitor.to_table(stream, str(tmp_path / "out"), str(tmp_path / "checkpoint")).awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["1", "2"]


def test_without_the_corpus_operators():
    """The rest imports nothing of them."""
    import pathlib

    root = pathlib.Path(__file__).parents[1] / "runlake"
    for f in root.rglob("*.py"):
        if "llm" not in f.relative_to(root).parts:
            assert "runlake.llm" not in f.read_text()
