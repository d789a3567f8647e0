"""Queries of scans, scalar functions, filters, sorts and set operations."""

from __future__ import annotations

from datetime import timedelta

import pandas as pd
from pyspark.sql import functions as F

from runlake.functions import columns as C
from runlake.functions.register import register, register_detector
from runlake.operators import predicates as P
from runlake.operators import sampling as S
from runlake.operators.entities import contains_metadata, list_entities, prune
from runlake.operators.text import detect_languages, languages_of
from runlake.plans.fixtures import NOW, language_sql, view, with_maps
from runlake.plans.registry import query

LLM = ("runs_trace_llm",)
TRACE = ("runs_trace",)
DOCS = ("runs_docs",)
_TS = "strftime(start_time, '%Y-%m-%d %H:%M:%S.%f')"


def events(spark, d):
    return with_maps(view(spark, d, "runs_events"))


def stamp(c="start_time"):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(c)


@query(f"SELECT id, project, {_TS} AS start_time FROM runs_events WHERE run_type = 'llm' ORDER BY runs_events.start_time DESC, id LIMIT 500")
def a3_pruned_scan_sample(spark, d):
    runs = view(spark, d, "runs_events").where(F.col("run_type") == "llm").select("id", "project", "start_time")
    return S.recent_sample(runs, 500).select("id", "project", stamp())


@query("SELECT id, project, name FROM runs_events QUALIFY row_number() OVER (PARTITION BY project ORDER BY start_time DESC, id) <= 20")
def a4_limit_per_project(spark, d):
    return S.limit_per_project(view(spark, d, "runs_events"), 20).select("id", "project", "name")


@query("SELECT id, left(text, 40) AS text FROM examples WHERE text LIKE '%th%' ORDER BY length(text) DESC, id LIMIT 10 OFFSET 5", ("examples",))
def a9_list_examples(spark, d):
    e = view(spark, d, "examples").withColumn("name", F.col("text"))
    return list_entities(e, name_contains="th", order=[F.desc(F.length("text")), F.asc("id")], offset=5, limit=10, fields=["id", "text"]).withColumn("text", F.left("text", F.lit(40)))


@query("SELECT project AS id, count(*) AS run_count FROM runs_events GROUP BY project HAVING count(*) > 0 ORDER BY run_count DESC, id LIMIT 3")
def a9_list_projects(spark, d):
    p = view(spark, d, "runs_events").groupBy(F.col("project").alias("id")).agg(F.count("*").alias("run_count"))
    return list_entities(p, where=F.col("run_count") > 0, order=[F.desc("run_count"), F.asc("id")], limit=3)


@query("SELECT id, name, error FROM runs_events")
def c1_field_pruning(spark, d):
    return prune(view(spark, d, "runs_events"), ["id", " name ", "nothing", "", "error", "id"])


@query("SELECT row_key, latency_s AS seconds FROM (SELECT row_key, (epoch_us(start_time + to_microseconds(CAST(round(latency_s * 1000000) AS BIGINT))) - epoch_us(start_time)) / 1000000.0 AS latency_s FROM runs_trace_llm)", LLM)
def c5_latency(spark, d):
    runs = view(spark, d, "runs_trace_llm")
    end = F.timestamp_micros(F.unix_micros("start_time") + F.round(F.col("latency_s") * 1e6).cast("long"))
    return runs.withColumn("end_time", end).select("row_key", C.latency_seconds().alias("seconds"))


@query(
    """SELECT model, gateway, CASE WHEN length(shown) > 20 THEN concat(left(shown, 17), '...') ELSE shown END AS shown, account, count(*) AS n FROM (
    SELECT model, gateway, coalesce(nullif(CASE WHEN service_tier = 'flex' THEN concat(model, '-', service_tier, '-', gateway) END, ''), nullif(model, ''), '-') AS shown,
    coalesce(nullif(CASE WHEN service_tier = 'flex' THEN '' ELSE model END, ''), nullif(coalesce(CASE WHEN gateway = 'gw0' THEN '' END, CASE WHEN gateway = 'gw1' THEN 'm1' END, gateway), ''), 'unknown') AS account FROM runs_trace_llm) GROUP BY ALL""",
    LLM,
)
def c6_model_names(spark, d):
    runs = view(spark, d, "runs_trace_llm")
    flex = F.col("service_tier") == "flex"
    shown = C.display_model(F.when(flex, F.concat_ws("-", "model", "service_tier", "gateway")), F.col("model"))
    inner = F.when(F.col("gateway") == "gw1", "m1").otherwise(F.col("gateway"))
    account = C.full_model(F.when(flex, "").otherwise(F.col("model")), F.when(F.col("gateway") == "gw0", ""), inner)
    return runs.groupBy("model", "gateway", shown.alias("shown"), account.alias("account")).agg(F.count("*").alias("n"))


@query("SELECT coalesce(nullif(CASE WHEN gateway <> 'gw3' THEN gateway ELSE '' END, ''), 'unknown') AS gateway, coalesce(nullif(CASE WHEN service_tier = 'flex' THEN 'flex' END, ''), 'unknown') AS service_tier, count(*) AS n FROM runs_trace_llm GROUP BY ALL", LLM)
def c7_c8_gateway_and_tier(spark, d):
    runs = view(spark, d, "runs_trace_llm")
    keys = [C.or_unknown(F.when(F.col("gateway") != "gw3", F.col("gateway")).otherwise("")).alias("gateway"), C.or_unknown(F.when(F.col("service_tier") == "flex", "flex")).alias("service_tier")]
    return runs.groupBy(*keys).agg(F.count("*").alias("n"))


_PROVIDER = "CASE " + " ".join(f"WHEN starts_with(lower(model), '{p}') OR contains(lower(model), '/{p}') THEN '{w}'" for p, w in C.MODEL_PROVIDERS) + " WHEN gateway <> 'unknown' THEN concat(upper(left(gateway, 1)), substr(gateway, 2)) ELSE 'unknown' END"


@query(f"SELECT model, {_PROVIDER} AS provider, count(*) AS n FROM runs_trace_llm GROUP BY ALL", LLM)
def c9_provider(spark, d):
    return view(spark, d, "runs_trace_llm").groupBy("model", C.provider("model", "gateway").alias("provider")).agg(F.count("*").alias("n"))


@query("SELECT substr(tag_len, 5) AS length, CASE WHEN tag_env IS NOT NULL THEN substr(tag_env, 5) END AS env, json_extract_string(props, '$.k') AS k, count(*) AS n FROM runs_events GROUP BY ALL")
def c10_group_values(spark, d):
    keys = [C.group_value("tag", "len").alias("length"), C.group_value("tag", "env").alias("env"), C.group_value("metadata", "k").alias("k")]
    return events(spark, d).groupBy(*keys).agg(F.count("*").alias("n"))


@query("SELECT trace_id, channel_id, concat('name of ', channel_id) AS channel_name FROM runs_trace_root", ("runs_trace_root",))
def c12_input_context(spark, d):
    roots = view(spark, d, "runs_trace_root")
    info = F.struct("channel_id", F.concat(F.lit("name of "), "channel_id").alias("channel_name"))
    as_text = F.to_json(F.struct(F.to_json(info).alias("channel_info")))
    as_object = F.to_json(F.struct(info.alias("channel_info")))
    inputs = F.when(F.length("id") % 2 == 0, as_text).otherwise(as_object)
    c = C.input_context("inputs")
    return roots.withColumn("inputs", inputs).select("trace_id", c["channel_id"].alias("channel_id"), c["channel_name"].alias("channel_name"))


@query("SELECT strftime(date_trunc('hour', start_time), '%Y-%m-%dT%H:00Z') AS hour, strftime(start_time, '%Y-%m-%d') AS day, count(*) AS n FROM runs_events GROUP BY ALL")
def c13_time_buckets(spark, d):
    runs = view(spark, d, "runs_events")
    return runs.groupBy(C.time_bucket("start_time", "hour").alias("hour"), C.time_bucket("start_time", "day").alias("day")).agg(F.count("*").alias("n"))


_MEDIA = "CASE doc_id % 3 WHEN 0 THEN concat('data:image/png;base64,', text) WHEN 1 THEN repeat(regexp_replace(lower(left(text, 50)), '[^a-z]', 'A', 'g'), 250) ELSE text END"


@query(
    f"""SELECT doc_id, CASE WHEN starts_with(t, 'data:') AND contains(left(t, 100), ';base64,') THEN concat('[binary:', regexp_extract(left(t, 100), '^data:([^;]*);base64,', 1), ':', CAST(length(t) AS STRING), 'bytes:...]')
    WHEN length(t) >= 10000 AND regexp_full_match(left(t, 200), '[A-Za-z0-9+/=\\n\\r ]*') THEN concat('[binary:base64:', CAST(length(t) AS STRING), 'bytes:...]') ELSE md5(t) END AS shown FROM (SELECT doc_id, {_MEDIA} AS t FROM documents)""",
    (),
)
def c14_binary_placeholder(spark, d):
    docs = view(spark, d, "documents")
    media = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("data:image/png;base64,"), "text")).when(F.col("doc_id") % 3 == 1, F.repeat(F.regexp_replace(F.lower(F.left("text", F.lit(50))), "[^a-z]", "A"), 250)).otherwise(F.col("text"))
    out = docs.select("doc_id", media.alias("t")).withColumn("shown", C.strip_binary("t"))
    return out.select("doc_id", F.when(F.col("shown").startswith("[binary:"), F.col("shown")).otherwise(F.md5("t")).alias("shown"))


@query("SELECT split_part(tag, ':', 1) AS key, substr(tag, instr(tag, ':') + 1) AS value, count(*) AS n FROM (SELECT unnest([tag_len, tag_env]) AS tag FROM runs_events) WHERE tag IS NOT NULL GROUP BY ALL")
def c16_tag_split(spark, d):
    tags = events(spark, d).select(F.explode("tags").alias("tag"))
    return tags.groupBy(C.tag_key("tag").alias("key"), C.tag_rest("tag").alias("value")).agg(F.count("*").alias("n"))


@query("""SELECT count(*) AS n, sum(CASE WHEN o_custkey % 2 = 0 THEN 1 ELSE 0 END) AS uuids FROM orders""", ())
def c17_uuid(spark, d):
    h = F.md5(F.col("o_orderkey").cast("string"))
    uuid = F.concat_ws("-", *(F.substr(h, F.lit(a), F.lit(n)) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))
    o = view(spark, d, "orders").select(F.when(F.col("o_custkey") % 2 == 0, uuid).otherwise(h).alias("id"))
    return o.agg(F.count("*").alias("n"), F.count_if(C.looks_like_uuid("id")).alias("uuids"))


@query("SELECT project, list_filter(string_split_regex(lower(project), '[/\\-_.]'), lambda x: x <> '') AS parts FROM (SELECT DISTINCT replace(project, '/', '-X_') AS project FROM runs_trace_root)", ("runs_trace_root",))
def c19_name_tokens(spark, d):
    names = view(spark, d, "runs_trace_root").select(F.replace("project", F.lit("/"), F.lit("-X_")).alias("project")).distinct()
    return names.select("project", C.name_tokens("project").alias("parts"))


@query("""SELECT id, concat('{"id":"', id, '","error":', coalesce('"' || error || '"', 'null'), ',"tokens":', CAST(total_tokens AS STRING), '}') AS line FROM runs_events""")
def c21_json_text(spark, d):
    return view(spark, d, "runs_events").select("id", C.json_text("id", "error", F.col("total_tokens").alias("tokens")).alias("line"))


@query(f"{language_sql('runs_docs', 'text')} SELECT lang, language AS found, count(*) AS n FROM detected GROUP BY ALL", ("runs_docs",))
def c23_language(spark, d):
    return detect_languages(view(spark, d, "runs_docs"), "text", ["lang"], "found").groupBy("lang", "found").agg(F.count("*").alias("n"))


@query("SELECT id, strftime(start_time, '%Y-%m-%dT%H:%M:%SZ') AS utc FROM runs_events")
def c24_naive_is_utc(spark, d):
    return view(spark, d, "runs_events").select("id", F.date_format(C.as_utc("start_time"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("utc"))


@query(f"SELECT model, {_PROVIDER} AS provider, strftime(start_time, '%Y-%m-%d') AS day, count(*) AS n FROM runs_trace_llm GROUP BY ALL", LLM)
def k1_functions_in_sql(spark, d):
    register(spark)
    return spark.sql("SELECT runlake_model(model, NULL, NULL) AS model, runlake_provider(model, gateway) AS provider, runlake_day(start_time) AS day, count(*) AS n FROM {runs} GROUP BY ALL", runs=view(spark, d, "runs_trace_llm"))


@query(f"{language_sql('runs_docs', 'text')} SELECT lang, language AS found, count(*) AS n FROM detected GROUP BY ALL", ("runs_docs",))
def k3_detector_in_sql(spark, d):
    """A vectorised detector, registered under a name of the user's own."""
    register_detector(spark, "my_language", lambda texts: pd.Series(languages_of(texts), dtype=object))
    return spark.sql("SELECT lang, my_language(text) AS found, count(*) AS n FROM {docs} GROUP BY ALL", docs=view(spark, d, "runs_docs"))


@query("SELECT CASE WHEN error IS NULL THEN 'success' ELSE 'error' END AS status, count(*) AS n FROM runs_trace GROUP BY ALL", TRACE)
def d1_status(spark, d):
    runs = view(spark, d, "runs_trace").select("error")
    return runs.where(P.failed()).select(F.lit("error").alias("status")).unionAll(runs.where(P.succeeded()).select(F.lit("success").alias("status"))).groupBy("status").agg(F.count("*").alias("n"))


@query("""SELECT 'last' AS which, id FROM runs_events WHERE start_time > TIMESTAMP '2024-01-24' UNION ALL SELECT 'forward', id FROM runs_events WHERE start_time > TIMESTAMP '2024-01-10' AND start_time < TIMESTAMP '2024-01-12'
    UNION ALL SELECT 'back', id FROM runs_events WHERE start_time > TIMESTAMP '2024-01-09 12:00:00' AND start_time < TIMESTAMP '2024-01-10'""")
def d2_time_windows(spark, d):
    runs, ten = view(spark, d, "runs_events"), NOW.replace(day=10)
    windows = {"last": dict(last=timedelta(weeks=1), now=NOW), "forward": dict(since=ten, last=timedelta(days=2)), "back": dict(before=ten, last=timedelta(hours=12))}
    parts = [runs.where(P.time_window(**w)).select(F.lit(k).alias("which"), "id") for k, w in windows.items()]
    return parts[0].unionAll(parts[1]).unionAll(parts[2])


@query("""SELECT id, latency_s > 5 AS slow, start_time > TIMESTAMP '2024-01-29 23:00:00' AS recent, start_time > TIMESTAMP '2024-01-30' AS today FROM runs_events WHERE latency_s > 1.5 AND latency_s < 9""")
def d4_latency_and_recency(spark, d):
    now = NOW.replace(day=30)
    return view(spark, d, "runs_events").where(P.latency_between(low=1.5, high=9)).select("id", P.slow().alias("slow"), P.recent(now).alias("recent"), P.today(now).alias("today"))


@query("SELECT id FROM runs_events WHERE tag_len = 'len:short' AND tag_env = 'env:prod'")
def d5_all_tags(spark, d):
    return events(spark, d).where(P.has_all_tags(["len:short", "env:prod"])).select("id")


@query("SELECT id FROM runs_events WHERE json_extract_string(props, '$.k') = '42'")
def d6_metadata_exact(spark, d):
    return events(spark, d).where(P.metadata_is("k", "42")).select("id")


@query("SELECT count(*) FILTER (WHERE regexp_full_match(json_extract_string(props, '$.k'), '4.')) AS forties, count(*) FILTER (WHERE regexp_full_match(json_extract_string(props, '$.k'), '[12].*')) AS ones, count(*) AS missing FROM runs_events")
def d7_metadata_glob(spark, d):
    return events(spark, d).agg(F.count_if(P.metadata_like("k", "4?")).alias("forties"), F.count_if(P.metadata_like("k", "[12]*")).alias("ones"), F.count_if(P.metadata_like("none", "*")).alias("missing"))


@query("""SELECT id FROM runs_trace_llm l JOIN (SELECT trace_id, channel_id AS room FROM runs_trace_root) r USING (trace_id)
    WHERE regexp_matches(gateway, '^gw[01]$') AND regexp_full_match(room, 'room-[0-4]') GROUP BY id""", ("runs_trace_llm", "runs_trace_root"))
def d8_metadata_tag_or_context(spark, d):
    from runlake.operators.traces import with_context

    keyed = F.map_from_arrays(F.array(F.lit("gateway"), F.lit("room")), F.array("gateway", "channel_id"))
    runs = view(spark, d, "runs_trace").withColumns({"metadata": keyed, "tags": F.array(F.concat(F.lit("tier:"), "service_tier"))})
    llm = with_context(runs.where(F.col("run_type") == "llm"), runs)
    return llm.where(P.metadata_or_tag("gateway", "/^gw[01]$/") & P.metadata_or_tag("room", "/^room-[0-4]$/", context="context")).select("id").distinct()


@query("""SELECT count(*) FILTER (WHERE name = 'click') AS exact, count(*) FILTER (WHERE regexp_matches(name, '^(cl|v)') AND contains(name, 'i')) AS both, count(*) FILTER (WHERE regexp_full_match(name, '.*c.?')) AS globbed,
    count(*) FILTER (WHERE regexp_full_match(project, 'svc/[13]')) AS sets, count(*) FILTER (WHERE NOT contains(name, 'ew') AND NOT contains(name, 'ick')) AS excluded FROM runs_events""")
def d9_d10_names(spark, d):
    n = P.name_matches
    tests = {"exact": n(exact="click", regex="nothing"), "both": n(regex="^(cl|v)", contains="i"), "globbed": n(glob="*c?") | n(glob="*c"), "sets": n("project", glob="svc/[13]"), "excluded": P.excludes(["ew", "ick"])}
    return view(spark, d, "runs_events").agg(*(F.count_if(c).alias(k) for k, c in tests.items()))


@query("""SELECT count(*) FILTER (WHERE contains(error, 'user 1')) AS literal, count(*) FILTER (WHERE regexp_matches(error, 'user [0-9]$')) AS regex, count(*) FILTER (WHERE contains(lower(error), 'valueerror')) AS any_case, count(*) FILTER (WHERE name = 'click' AND error IS NULL) AS pair FROM runs_events""")
def d11_grep(spark, d):
    tests = {"literal": P.grep("user 1", "error"), "regex": P.grep('user [0-9]"', "error", regex=True), "any_case": P.grep("valueERROR", "name", "error", ignore_case=True), "pair": P.grep('"name":"click","error":null', "name", "error")}
    return view(spark, d, "runs_events").agg(*(F.count_if(c).alias(k) for k, c in tests.items()))


@query("SELECT count(*) FILTER (WHERE contains(lower(left(text, 250)), 'then')) AS indexed, count(*) FILTER (WHERE contains(lower(text), 'then')) AS anywhere FROM runs_docs", DOCS)
def d12_search(spark, d):
    docs = view(spark, d, "runs_docs").withColumn("inputs", F.col("text"))
    return docs.agg(F.count_if(P.search("Then", "text")).alias("indexed"), F.count_if(P.search_in("then", "inputs")).alias("anywhere"))


@query("SELECT id FROM runs_events WHERE (run_type IN ('llm', 'tool') AND latency_s >= 2 AND NOT (name = 'view' OR error IS NOT NULL)) OR (tag_env IS NULL AND latency_s < 0.3)")
def d13_predicates(spark, d):
    c = F.col("latency_s")
    no_env = ~F.exists("tags", lambda t: t.startswith("env:"))
    return events(spark, d).where(P.any_of(P.all_of(F.col("run_type").isin("llm", "tool"), c >= 2, P.none_of(P.eq("name", "view"), P.neq("error", None))), P.all_of(no_env, c < 0.3))).select("id")


@query("SELECT run_type, parent_run_id IS NULL AS root, count(*) AS n FROM runs_trace GROUP BY ALL", TRACE)
def d14_root_scope(spark, d):
    return view(spark, d, "runs_trace").groupBy("run_type", P.root_scope(True).alias("root")).agg(F.count("*").alias("n"))


@query("SELECT count(*) FILTER (WHERE contains(model, 'gpt-4')) AS anywhere, count(*) FILTER (WHERE model = 'gpt-4o') AS exact, count(*) FILTER (WHERE run_type = 'llm' AND model <> 'unknown') AS billable FROM runs_trace", TRACE)
def d15_d16_models(spark, d):
    return view(spark, d, "runs_trace").agg(F.count_if(P.mentions_model("gpt-4", "name", "model")).alias("anywhere"), F.count_if(F.col("model") == "gpt-4o").alias("exact"), F.count_if(P.billable()).alias("billable"))


@query("SELECT run_id, key, score FROM feedback WHERE key = 'quality' AND score = 0", ("feedback",))
def d17_entity_filters(spark, d):
    f = view(spark, d, "feedback").withColumn("metadata", F.map_from_arrays(F.array(F.lit("key")), F.array("key")))
    return f.where(contains_metadata({"key": "quality"}) & (F.col("score") == 0)).select("run_id", "key", "score")


@query("SELECT id FROM runs_events WHERE error IS NULL AND start_time > TIMESTAMP '2024-01-20' AND start_time < TIMESTAMP '2024-01-25' AND latency_s > 2 AND tag_env = 'env:prod' AND starts_with(json_extract_string(props, '$.k'), '1') AND name <> 'view' AND run_type = 'llm'")
def d18_run_filter(spark, d):
    f = P.RunFilter(status="success", since=NOW.replace(day=20), before=NOW.replace(day=25), min_latency=2, tags=("env:prod",), metadata={"k": "1*"}, exclude=("view",), run_type="llm", roots=True)
    return events(spark, d).where(f.column()).select("id")


@query("SELECT name FROM (SELECT DISTINCT name FROM runs_trace_llm) WHERE (starts_with(name, 'E') OR starts_with(name, 'S')) AND NOT starts_with(name, 'ST')", LLM)
def d20_path_prefixes(spark, d):
    return view(spark, d, "runs_trace_llm").select("name").distinct().where(P.path_within("name", ["E", "S"], ["ST"]))


@query("SELECT id, row_number() OVER (ORDER BY latency_s DESC, id) AS place FROM (SELECT id, latency_s FROM runs_events ORDER BY latency_s DESC, id LIMIT 50)")
def h1_h2_sort_and_limit(spark, d):
    out = S.sort_by(view(spark, d, "runs_events").select("id", "latency_s"), "-latency", {"latency": F.coalesce("latency_s", F.lit(0)), "name": F.lower("id")}).limit(50)
    from pyspark.sql import Window

    return out.withColumn("place", F.row_number().over(Window.orderBy(F.desc("latency_s"), "id"))).select("id", "place")


@query("SELECT id, latency_s FROM runs_events ORDER BY start_time DESC, id LIMIT 10")
def h3_top_k(spark, d):
    return S.recent_sample(view(spark, d, "runs_events"), 10).select("id", "latency_s")


@query("SELECT id FROM runs_events ORDER BY start_time, id LIMIT 25 OFFSET 100")
def h4_offset_paging(spark, d):
    return S.page(view(spark, d, "runs_events"), [F.asc("start_time"), F.asc("id")], 100, 25).select("id")


@query("SELECT name, count(*) AS n FROM (SELECT name FROM runs_events ORDER BY start_time DESC, id LIMIT 300) GROUP BY name")
def h5_recent_sample(spark, d):
    return S.recent_sample(view(spark, d, "runs_events"), 300).groupBy("name").agg(F.count("*").alias("n"))


@query("SELECT user_id, event_id AS version, event_type FROM events WHERE ts <= TIMESTAMP '2024-01-15' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1", ())
def h6_as_of(spark, d):
    versions = view(spark, d, "events").select("user_id", F.col("event_id").alias("version"), "event_type", F.col("ts").cast("timestamp").alias("modified_at"))
    return S.as_of(versions, F.lit("2024-01-15").cast("timestamp"), "user_id").select("user_id", "version", "event_type")


@query("SELECT 'events' AS source, count(*) AS n FROM runs_events UNION ALL SELECT 'roots', count(*) FROM runs_trace_root", ("runs_events", "runs_trace_root"))
def i1_union(spark, d):
    a, b = (view(spark, d, n).select("id", F.lit(s).alias("source")) for n, s in (("runs_events", "events"), ("runs_trace_root", "roots")))
    return a.unionByName(b).groupBy("source").agg(F.count("*").alias("n"))


@query("SELECT DISTINCT project, tag_env FROM runs_events")
def i2_distinct(spark, d):
    return view(spark, d, "runs_events").select("project", "tag_env").distinct()


@query("SELECT id FROM runs_trace_root WHERE id NOT IN (SELECT trace_id FROM runs_trace_llm)", ("runs_trace_root", "runs_trace_llm"))
def i3_except(spark, d):
    roots, lines = view(spark, d, "runs_trace_root"), view(spark, d, "runs_trace_llm")
    return roots.select("id").join(lines.select(F.col("trace_id").alias("id")), "id", "left_anti")


@query("SELECT id, (CASE WHEN tag_len = 'len:long' THEN 1 ELSE 0 END) + (CASE WHEN tag_env = 'env:dev' THEN 1 ELSE 0 END) AS common, tag_len IN ('len:long', 'len:short') AND coalesce(tag_env = 'env:dev', true) AS subset FROM runs_events")
def i4_tag_sets(spark, d):
    wanted = F.array(*map(F.lit, ("len:long", "env:dev")))
    allowed = F.array(*map(F.lit, ("len:long", "len:short", "env:dev")))
    return events(spark, d).select("id", F.size(F.array_intersect("tags", wanted)).alias("common"), (F.size(F.array_except("tags", allowed)) == 0).alias("subset"))
