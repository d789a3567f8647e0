import json
import random
import re
import statistics

import pytest
from pyspark.sql import functions as F

from runlake.functions import columns as C
from runlake.operators import discovery, metrics, similar
from runlake.sources import jsonl
from runlake.streaming import monitor


def test_ranked_values_of_odd_groups(spark):
    rng = random.Random(1)
    groups = {"wide": [rng.choice((-1, 1)) * 10 ** rng.uniform(-9, 12) for _ in range(501)], "ties": [rng.choice((1.0, 2.0, 2.5)) for _ in range(400)], "zero": [0.0] * 10, None: [3.0, -1.0, 2.0]}
    df = spark.createDataFrame([(k, x) for k, v in groups.items() for x in v] + [("none", None)], "k string, x double").repartition(7)
    got = {r.k: r for r in metrics.ranked_values(df, ["k"], "x", {"p50": metrics.continuous(0.5), "low": metrics.exclusive(1, 20), "p99": metrics.continuous(0.99)}).collect()}
    assert set(got) == set(groups)
    for k, v in groups.items():
        assert got[k].p50 == pytest.approx(statistics.median(v))
        assert got[k].low == pytest.approx(statistics.quantiles(v, n=20)[0])
        s = sorted(v)
        at = 0.99 * (len(s) - 1)
        assert got[k].p99 == pytest.approx(s[int(at)] + (at - int(at)) * (s[min(int(at) + 1, len(s) - 1)] - s[int(at)]))
    whole = metrics.ranked_values(df, [], "x", {"p50": metrics.continuous(0.5)}).collect()
    assert [r.p50 for r in whole] == [pytest.approx(statistics.median([x for v in groups.values() for x in v]))]
    assert [r.p50 for r in metrics.ranked_values(df.limit(0), [], "x", {"p50": metrics.continuous(0.5)}).collect()] == [None]


def test_media_is_stripped_at_any_depth(spark):
    long = "QUJD" * 3000
    payload = {
        "image": "data:image/png;base64," + long,
        "list": [long, {"deep": [long + "=", 'say "data:;base64,x" \\'], "n": 1.5}, None, True],
        "data:image/png;base64,": "a key",
        "text": 'ends with a backslash \\',
        "more": "data:text/plain;base64,\"quoted\\",
        "prose": "Long prose, no media. " * 1000,
    }
    texts = [json.dumps(payload), json.dumps([payload], ensure_ascii=False, indent=1), json.dumps(long), "data:x;base64,", "{broken" + long, None, "", long]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string").withColumn("t", C.strip_binary("t"))
    got = [r.t for r in df.orderBy("id").collect()]
    want = payload | {
        "image": "[binary:image/png:12022bytes:...]",
        "list": ["[binary:base64:12000bytes:...]", {"deep": ["[binary:base64:12001bytes:...]", 'say "data:;base64,x" \\'], "n": 1.5}, None, True],
        "more": "[binary:text/plain:31bytes:...]",
    }
    assert json.loads(got[0]) == want and json.loads(got[1]) == [want]
    assert got[3:] == ["[binary:x:14bytes:...]", "{broken" + long, None, "", "[binary:base64:12000bytes:...]"]


def test_flattening_opens_each_level_once(spark):
    df = spark.createDataFrame([("1", '{"a":null,"b":{"c":[1,{"d":"x"}],"e":{}},"k":1.5}'), ("2", "[1,2]"), ("3", "no JSON"), ("4", '{"a":"s"}'), ("5", None)], "id string, t string")
    flat = discovery.flatten_json(df, "id", "t")
    assert sorted((r.id, r.path, r.v) for r in flat.select("id", "path", F.to_json("value").alias("v")).collect()) == [("1", "a", "null"), ("1", "b.c", '[1,{"d":"x"}]'), ("1", "b.e", "{}"), ("1", "k", "1.5"), ("4", "a", '"s"')]
    assert flat._jdf.queryExecution().executedPlan().toString().count("Scan ExistingRDD") == 1
    schema = {r.path: (r.type, r.present_count, r.sample) for r in discovery.infer_schema(df, "id", "t").collect()}
    assert schema["b.c[]"] == ("mixed", 1, "1") and schema["b.c[].d"] == ("str", 1, '"x"') and schema["a"] == ("str", 1, '"s"') and schema["[]"] == ("int", 1, "1")
    profile = {r.path: r for r in discovery.profile_fields(flat, 5).collect()}
    assert profile["k"].number_sum == 1.5 and profile["k"].sample == "1.5" and profile["b.c"].length_p50 == 2 and profile["a"].present_count == 1


def test_tags_of_a_key_with_many_values(spark):
    df = spark.createDataFrame([([f"user:{i:03}", "env:dev"],) for i in range(50)], "tags array<string>")
    assert discovery.tag_values(df).count() == 51
    assert {r.key: r["values"] for r in discovery.discover_tags(df, most=3).collect()} == {"env": ["dev"], "user": ["000", "001", "002"]}


def plain_suggestions(asked, names, top=5):
    def parts(x):
        return set(re.split(r"[/\-_.]", x.lower())) - {""}

    out = []
    for q in asked:
        scored = []
        for n in names:
            a, b = q.lower(), n.lower()
            union = parts(q) | parts(n)
            score = 1.0 if a in b or b in a else len(parts(q) & parts(n)) / len(union) if union else 0
            if a != b and score > 0:
                scored.append((-score, n))
        out += [(q, n, round(-s, 9)) for s, n in sorted(scored)[:top]]
    return sorted(out)


@pytest.mark.parametrize("common", (500, 3, 0))
def test_similar_names_against_all_pairs(spark, monkeypatch, common):
    """Parts that most names hold, contained and empty names, other cases, short and repeated ones."""
    monkeypatch.setattr(similar, "COMMON", common)
    rng = random.Random(7)
    words = ["prod", "dev", "api", "web", "v1", "v2", "eu", "team"] + [f"x{i}" for i in range(40)]
    names = {rng.choice("-/._").join(["prod" if rng.random() < 0.5 else rng.choice(words), *(rng.choice(words) for _ in range(rng.randrange(0, 5)))]) for _ in range(250)}
    names |= {"", "p", "PR", "Prod", "prod-API", "---", "é/ü", "a/b/c/d/e/f/g/h"}
    asked = set(rng.sample(sorted(names), 60)) | {"", "x", "ro", "od", "zzz", "zzz/prod", "Prod", "prod/api/v1/eu/team/x1/x2", "---", "É", "api-only"}
    frame = spark.createDataFrame([(n,) for n in [*names, "prod-API", None]], "name string")
    queries = spark.createDataFrame([(q,) for q in [*asked, "ro", None]], "query string")
    got = similar.suggest_names(queries, frame)
    assert sorted((r.query, r.name, round(r.score, 9)) for r in got.collect()) == plain_suggestions(asked, names)
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString() and "Cartesian" not in got._jdf.queryExecution().executedPlan().toString()
    assert similar.suggest_names(queries, frame.limit(0)).count() == 0 == similar.suggest_names(queries.limit(0), frame).count()


def test_newest_row_of_an_id_is_kept(spark):
    rows = [("a", "2026-01-01", "old"), ("a", "2026-01-03", "new"), ("b", "2026-01-02", "b")]
    df = spark.createDataFrame(rows, "id string, t string, name string").select("id", F.to_timestamp("t").alias("start_time"), "name", F.lit(None).cast("string").alias("parent_run_id"))
    for some in (df, df.repartition(5, "name")):
        assert [(r.id, r.name) for r in monitor.latest_roots(some.where("name <> 'new'"), some.where("name = 'new'")).collect()] == [("a", "new"), ("b", "b")]


def test_appending_reads_only_the_batch_s_projects(spark, tmp_path):
    path = str(tmp_path / "stored")
    batch = spark.createDataFrame([("1", "p"), ("2", "q"), ("1", "p")], "id string, project string")
    jsonl.append_runs(batch, path, [F.asc("id")])
    again = jsonl.append_runs(spark.createDataFrame([("2", "p"), ("1", "p")], "id string, project string"), path, [F.asc("id")])
    assert "PartitionFilters: [isnotnull(project" in again._jdf.queryExecution().executedPlan().toString() or again.count() == 0
    assert sorted((r.id, r.project) for r in spark.read.parquet(path).select("id", "project").collect()) == [("1", "p"), ("2", "p"), ("2", "q")]
