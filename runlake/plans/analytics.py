"""Queries of metrics, usage, pricing, traces, samples and discovery."""

from __future__ import annotations

from pyspark.sql import functions as F

from runlake.functions import columns as C
from runlake.functions.register import register_flatten
from runlake.operators import discovery as D
from runlake.operators import entities as E
from runlake.operators import metrics as M
from runlake.operators import payloads
from runlake.operators import predicates as P
from runlake.operators import pricing, sampling, traces, usage
from runlake.operators.text import language_distribution
from runlake.plans.filters import LLM, TRACE, _PROVIDER, events
from runlake.plans.fixtures import language_sql, view
from runlake.plans.registry import query
from runlake.sources import store
from runlake.sources.jsonl import append_runs
from runlake.sources.shared import new_path

BOTH = ("runs_trace_root", "runs_trace_llm")
PRICED = ("runs_trace_llm", "prices")


def rounded(df, n=6, **how):
    """Floating figures rounded, so that the order of summing does not show."""
    return df.withColumns({f.name: F.round(f.name, how.get(f.name, n)).cast("double") for f in df.schema if f.dataType.typeName() in ("double", "decimal")})


def exclusive(i, n, keys, source, value="latency_s"):
    """DuckDB SQL of the exclusive quantile i/n by ranks."""
    return f"""SELECT {keys}, CASE WHEN max(n) = 1 THEN max(x) ELSE max(CASE WHEN r = j THEN x END) * (1 - max(part)) + max(CASE WHEN r = j + 1 THEN x END) * max(part) END AS q FROM (
      SELECT *, ({i} * (n + 1) - j * {n}) / {n}.0 AS part FROM (SELECT *, greatest(1, least(n - 1, ({i} * (n + 1)) // {n})) AS j FROM (
        SELECT {keys}, {value} AS x, row_number() OVER (PARTITION BY {keys} ORDER BY {value}) AS r, count(*) OVER (PARTITION BY {keys}) AS n FROM {source} WHERE {value} IS NOT NULL))) GROUP BY {keys}"""


_METRICS = """count(*) AS count, round(avg(CASE WHEN error IS NULL THEN 0.0 ELSE 1.0 END), 6) AS error_rate, round(avg(latency_s), 6) AS avg_latency, round(quantile_cont(latency_s, 0.5), 6) AS p50_latency,
  sum(total_tokens)::BIGINT AS total_tokens, round(avg(total_cost), 6) AS avg_cost"""


def _metrics_sql(key, source):
    return f""", g AS (SELECT *, {key} AS k FROM {source} WHERE {key} IS NOT NULL), a AS (SELECT k, {_METRICS} FROM g GROUP BY k), b AS ({exclusive(19, 20, "k", "g")}), c AS ({exclusive(99, 100, "k", "g")})
    SELECT k, count, error_rate, avg_latency, p50_latency, round(b.q, 6) AS p95_latency, round(c.q, 6) AS p99_latency, total_tokens, avg_cost FROM a JOIN b USING (k) JOIN c USING (k)"""


@query(_metrics_sql("substr(tag_len, 5)", "runs_events"))
def f1_metrics_by_tag(spark, d):
    return rounded(M.grouped_metrics(events(spark, d), {"k": C.group_value("tag", "len")}))


@query(_metrics_sql("json_extract_string(props, '$.k')", "runs_events"))
def f1_metrics_by_metadata(spark, d):
    return rounded(M.grouped_metrics(events(spark, d), {"k": C.group_value("metadata", "k")}))


@query(_metrics_sql("model", "runs_trace_llm"), LLM)
def f1q_exclusive_quantiles(spark, d):
    return rounded(M.grouped_metrics(view(spark, d, "runs_trace_llm"), {"k": F.col("model")}))


_SUMS = ", ".join(f"sum({c})::BIGINT AS {c}" for c in ("total_tokens", "prompt_tokens", "completion_tokens")) + ", " + ", ".join(f"round(sum(CAST({c} AS DECIMAL(38, 12))), 6)::DOUBLE AS {c}" for c in ("total_cost", "prompt_cost", "completion_cost")) + ", count(*) AS run_count"
#: Runs with estimated costs, in DuckDB.
_ESTIMATED = """, priced AS (SELECT l.* REPLACE (
    CASE WHEN w THEN pc + cc ELSE total_cost END AS total_cost, CASE WHEN w THEN pc ELSE prompt_cost END AS prompt_cost, CASE WHEN w THEN cc ELSE completion_cost END AS completion_cost) FROM (
    SELECT l.*, total_cost = 0 AND total_tokens > 0 AND coalesce(t.input_per_million, p.input_per_million) IS NOT NULL AS w, prompt_tokens * coalesce(t.input_per_million, p.input_per_million) / 1000000 AS pc,
      completion_tokens * coalesce(t.output_per_million, p.output_per_million) / 1000000 AS cc
    FROM runs_trace_llm l LEFT JOIN prices t ON t.model = concat(l.model, '+', l.service_tier) LEFT JOIN prices p ON p.model = l.model) l)"""


def priced(spark, d):
    return pricing.estimate_costs(view(spark, d, "runs_trace_llm"), view(spark, d, "prices"))


@query(f"{_ESTIMATED} SELECT strftime(start_time, '%Y-%m-%d') AS time, 'all' AS group_value, model, {_SUMS} FROM priced WHERE model <> 'unknown' GROUP BY ALL", PRICED)
def usage_by_day_model(spark, d):
    return rounded(usage.usage_cube(priced(spark, d).where(P.billable()), "day", breakdown=("model",)))


@query(f"{_ESTIMATED} SELECT strftime(start_time, '%Y-%m-%d') AS time, CASE WHEN service_tier = 'flex' THEN 'flex' ELSE 'ungrouped' END AS group_value, project, {_PROVIDER} AS provider, {_SUMS} FROM priced GROUP BY ALL HAVING sum(total_tokens) > 0", PRICED)
def f2_usage_cube(spark, d):
    group = F.when(F.col("service_tier") == "flex", "flex")
    return rounded(usage.usage_cube(priced(spark, d), "day", group, ("project", "provider"), active_only=True))


@query(f"""{_ESTIMATED}, cube AS (SELECT strftime(date_trunc('hour', start_time), '%Y-%m-%dT%H:00Z') AS time, gateway AS g, sum(total_tokens) AS t, sum(CAST(total_cost AS DECIMAL(38, 12))) AS c, count(*) AS n FROM priced GROUP BY ALL), per AS (SELECT time, count(DISTINCT g) AS k FROM cube GROUP BY time)
    SELECT (SELECT sum(t)::BIGINT FROM cube) AS total_tokens, (SELECT round(sum(c), 4)::DOUBLE FROM cube) AS total_cost, (SELECT sum(n)::BIGINT FROM cube) AS run_count, (SELECT count(DISTINCT g) FROM cube) AS unique_groups, count(*) AS active_buckets, max(k) AS max_concurrent, round(avg(k), 6) AS avg_concurrent FROM per""", PRICED)
def f3_usage_summary(spark, d):
    return rounded(usage.usage_summary(usage.usage_cube(priced(spark, d), "hour", F.col("gateway"))), total_cost=4)


@query("SELECT strftime(start_time, '%Y-%m-%d') AS time, model, sum(total_tokens)::BIGINT AS total_tokens, round(sum(CAST(total_cost AS DECIMAL(38, 12))), 4)::DOUBLE AS total_cost, count(*) AS run_count FROM runs_trace_llm GROUP BY ROLLUP(1, 2)", LLM)
def f2_usage_with_subtotals(spark, d):
    return rounded(usage.usage_totals(view(spark, d, "runs_trace_llm"), "day", ["model"]), 4)


@query("SELECT model, count(*) AS run_count, sum(total_tokens)::BIGINT AS total_tokens, round(sum(CAST(total_cost AS DECIMAL(38, 12))), 6)::DOUBLE AS total_cost, sum(total_cost) > 0 OR sum(total_tokens) = 0 AS has_pricing, sum(total_tokens) > 0 AND sum(total_cost) = 0 AS missing FROM (SELECT * REPLACE (CASE WHEN model IN ('acme-7b', 'o3-mini') THEN 0 ELSE total_cost END AS total_cost) FROM runs_trace_llm) GROUP BY model", LLM)
def f4_pricing_coverage(spark, d):
    runs = view(spark, d, "runs_trace_llm").withColumn("total_cost", F.when(F.col("model").isin("acme-7b", "o3-mini"), 0.0).otherwise(F.col("total_cost")))
    return rounded(pricing.pricing_coverage(runs))


_CATALOGUE = """catalogue AS (SELECT concat(CASE p_type WHEN 'ECONOMY' THEN 'openai/gpt-' WHEN 'PROMO' THEN 'Meta-Llama/llama-' WHEN 'STANDARD' THEN 'qwen/qwen-' ELSE 'other-' END, CAST(p_size AS STRING)) AS id,
    round(min(p_retailprice) / 1000000000 * 1000000, 4) AS input_per_million, round(max(p_retailprice) / 1000000000 * 1000000, 4) AS output_per_million FROM part GROUP BY 1)"""
_MODELS = "(SELECT DISTINCT concat(CASE l_linenumber % 4 WHEN 0 THEN 'gpt-' WHEN 1 THEN 'llama-' WHEN 2 THEN 'qwen-' ELSE 'other-' END, CAST(l_partkey % 60 AS STRING)) AS model FROM lineitem)"


def catalogue(spark, d):
    """A price catalogue from `part`, as JSON entries with prices per token as text."""
    from runlake.sources.prices import load_catalogue

    kind = F.when(F.col("p_type") == "ECONOMY", "openai/gpt-").when(F.col("p_type") == "PROMO", "Meta-Llama/llama-").when(F.col("p_type") == "STANDARD", "qwen/qwen-").otherwise("other-")
    entries = view(spark, d, "part").groupBy(F.concat(kind, F.col("p_size").cast("string")).alias("id")).agg(F.min("p_retailprice").alias("a"), F.max("p_retailprice").alias("b"))
    return load_catalogue(entries.select(F.to_json(F.struct("id", F.struct(*((F.col(x) / 1e9).cast("string").alias(n) for x, n in (("a", "prompt"), ("b", "completion")))).alias("pricing"))).alias("line")))


@query(f"WITH {_CATALOGUE} SELECT * FROM catalogue", ())
def a8_price_catalogue(spark, d):
    return catalogue(spark, d)


@query("SELECT lower(p_type) AS model, CAST(min(p_retailprice) AS DOUBLE) AS input_per_million, CAST(max(p_retailprice) AS DOUBLE) AS output_per_million FROM part GROUP BY p_type", ())
def a7_price_table(spark, d):
    from runlake.sources.prices import load_prices

    return load_prices(view(spark, d, "part").groupBy(F.col("p_type").alias("model")).agg(F.min("p_retailprice").cast("string").alias("input_per_million"), F.max("p_retailprice").cast("string").alias("output_per_million")))


@query(f"""WITH {_CATALOGUE}, names AS (SELECT model, unnest([0, 1, 2]) AS pos FROM {_MODELS}), tried AS (SELECT model, pos, CASE pos WHEN 0 THEN model WHEN 1 THEN CASE WHEN starts_with(model, 'llama') THEN concat('meta-llama/', model) WHEN starts_with(model, 'qwen') THEN concat('qwen/', model) WHEN starts_with(model, 'gpt') THEN concat('openai/', model) END
      ELSE CASE WHEN starts_with(model, 'llama') THEN concat('meta-llama/', model, '-instruct') END END AS name FROM names)
    SELECT model, id AS catalogue_id, input_per_million, output_per_million FROM tried JOIN catalogue ON lower(name) = lower(id) QUALIFY row_number() OVER (PARTITION BY model ORDER BY pos) = 1""", ())
def e3_catalogue_match(spark, d):
    kind = F.element_at(F.array(*map(F.lit, ("gpt-", "llama-", "qwen-", "other-"))), (F.col("l_linenumber") % 4 + 1).cast("int"))
    models = view(spark, d, "lineitem").select(F.concat(kind, (F.col("l_partkey") % 60).cast("string")).alias("model")).distinct()
    return pricing.match_catalogue(models, catalogue(spark, d))


@query("SELECT model, coalesce(nullif(round(sum(prompt_cost) / nullif(sum(prompt_tokens), 0) * 1000000, 4), 0), 0) AS input_per_million, coalesce(nullif(round(sum(completion_cost) / nullif(sum(completion_tokens), 0) * 1000000, 4), 0), 0) AS output_per_million FROM runs_trace_llm GROUP BY model", LLM)
def f5_effective_prices(spark, d):
    return pricing.effective_prices(view(spark, d, "runs_trace_llm"))


@query(f"{_ESTIMATED} SELECT row_key, round(total_cost, 9) AS total_cost, round(prompt_cost, 9) AS prompt_cost FROM priced", PRICED)
def e2_price_join(spark, d):
    return rounded(priced(spark, d).select("row_key", "total_cost", "prompt_cost"), 9)


@query(f"SELECT r.channel_id AS room, sum(l.total_tokens)::BIGINT AS total_tokens, count(*) AS run_count FROM runs_trace_llm l JOIN runs_trace_root r USING (trace_id) GROUP BY 1", BOTH)
def e1_usage_by_trace_context(spark, d):
    runs = view(spark, d, "runs_trace").withColumn("metadata", F.map_from_arrays(F.array(F.lit("room")), F.array("channel_id")))
    llm = traces.with_context(runs.where(F.col("run_type") == "llm"), runs)
    return llm.groupBy(F.col("context")["room"].alias("room")).agg(F.sum("total_tokens").alias("total_tokens"), F.count("*").alias("run_count"))


@query("SELECT r.id AS id, l.row_key AS child FROM runs_trace_root r JOIN runs_trace_llm l USING (trace_id) WHERE r.error IS NOT NULL", BOTH)
def e6_children(spark, d):
    runs = view(spark, d, "runs_trace").select("trace_id", F.col("row_key").alias("id"), "name", "start_time", "parent_run_id", "error")
    kids = traces.with_children(runs, runs.where(F.col("parent_run_id").isNull() & F.col("error").isNotNull()))
    return kids.select("id", F.col("child_id").alias("child"))


@query("SELECT row_key FROM runs_trace WHERE trace_id IN (SELECT trace_id FROM runs_trace_root WHERE error IS NOT NULL)", TRACE)
def e7_trace_filter(spark, d):
    return traces.where_root(view(spark, d, "runs_trace"), P.failed()).select("row_key")


@query("SELECT row_key FROM runs_trace WHERE parent_run_id IS NULL AND trace_id IN (SELECT trace_id FROM runs_trace_llm WHERE model = 'o3-mini')", TRACE)
def e8_tree_filter(spark, d):
    return traces.where_any(view(spark, d, "runs_trace"), F.col("model") == "o3-mini").where(P.is_root()).select("row_key")


@query("SELECT id FROM runs_docs WHERE id IN (SELECT run_id FROM feedback WHERE key = 'quality' AND score = 1)", ("runs_docs", "feedback"))
def e9_feedback_filter(spark, d):
    return traces.where_feedback(view(spark, d, "runs_docs"), view(spark, d, "feedback"), "quality", F.col("score") == 1).select("id")


@query("SELECT e.id AS reference_example_id, d.id FROM runs_docs d JOIN examples e ON CAST(e.id AS BIGINT) = CAST(d.id AS BIGINT) % 40", ("runs_docs", "examples"))
def e10_runs_of_examples(spark, d):
    runs = view(spark, d, "runs_docs").withColumn("reference_example_id", (F.col("id").cast("long") % 40).cast("string"))
    return E.runs_of_examples(view(spark, d, "examples").withColumn("inputs", F.col("text")), runs).select("reference_example_id", "id")


@query("SELECT concat('c', CAST(c_custkey AS STRING)) AS id, c_name AS name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_name LIKE 'N%5'", ())
def e10_experiments_of_dataset(spark, d):
    """Customers as experiments, nations as datasets."""
    projects = view(spark, d, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("reference_dataset_id"))
    datasets = view(spark, d, "nation").where(F.col("n_name").like("N%5")).select(F.col("n_nationkey").alias("id"))
    return E.experiments_of_dataset(projects, datasets).select("id", "name")


@query("SELECT c_name AS query, concat('c', CAST(c_custkey AS STRING)) AS id FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT concat('c', CAST(c_custkey AS STRING)), concat('c', CAST(c_custkey AS STRING)) FROM customer WHERE c_custkey % 2 = 1 UNION ALL SELECT concat('no', CAST(n_nationkey AS STRING)), NULL FROM nation", ())
def e11_resolve_entities(spark, d):
    known = view(spark, d, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id"), F.col("c_name").alias("name"), "c_custkey")
    wanted = known.select(F.when(F.col("c_custkey") % 2 == 0, F.col("name")).otherwise(F.col("id")).alias("query"))
    none = view(spark, d, "nation").select(F.concat(F.lit("no"), F.col("n_nationkey").cast("string")).alias("query"))
    return E.resolve(wanted.unionAll(none), known)


_PARTS = "list_distinct(list_filter(string_split_regex(lower({}), '[/\\-_. ]'), lambda x: x <> ''))"


@query(f"""WITH names AS (SELECT DISTINCT replace(p_name, ' ', '-') AS name FROM part), q AS (SELECT name AS query FROM names),
    s AS (SELECT query, name, CASE WHEN contains(lower(name), lower(query)) OR contains(lower(query), lower(name)) THEN 1.0 ELSE len(list_intersect({_PARTS.format("query")}, {_PARTS.format("name")})) / (len({_PARTS.format("query")}) + len({_PARTS.format("name")}) - len(list_intersect({_PARTS.format("query")}, {_PARTS.format("name")}))) END AS score FROM q, names WHERE lower(query) <> lower(name))
    SELECT query, name, round(score, 6) AS score FROM s WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, name) <= 5""", ())
def e12_similar_names(spark, d):
    names = view(spark, d, "part").select(F.replace("p_name", F.lit(" "), F.lit("-")).alias("name")).distinct()
    return rounded(E.suggest_names(names.select(F.col("name").alias("query")), names))


@query("SELECT concat('ex-', id) AS id, id AS source_run_id, md5(text) AS inputs FROM runs_docs WHERE n_chars < 1000", ("runs_docs",))
def e13_examples_from_runs(spark, d):
    runs = view(spark, d, "runs_docs").withColumns({"inputs": F.md5("text"), "outputs": F.lit(None).cast("string")})
    return E.examples_from_runs(runs, F.col("n_chars") < 1000).select("id", "source_run_id", "inputs")


@query("""SELECT count(*) AS run_count, count(error) AS failed, count(*) - count(error) AS successful, round(avg(CASE WHEN error IS NULL THEN 0.0 ELSE 1.0 END), 6) AS error_rate, round(quantile_cont(latency_s, 0.5), 6) AS latency_p50, round(quantile_cont(latency_s, 0.99), 6) AS latency_p99,
    sum(total_tokens)::BIGINT AS total_tokens, round(sum(CAST(total_cost AS DECIMAL(38, 12))), 4)::DOUBLE AS total_cost, strftime(max(start_time), '%Y-%m-%d %H:%M:%S') AS last_run,
    (SELECT string_agg(concat(run_type, '=', CAST(n AS STRING)), ',' ORDER BY run_type) FROM (SELECT run_type, count(*) AS n FROM runs_events GROUP BY run_type)) AS run_types FROM runs_events""")
def f6_run_stats(spark, d):
    s = M.run_stats(view(spark, d, "runs_events"))
    kinds = F.array_join(F.transform("run_types", lambda x: F.concat_ws("=", x["run_type"], x["n"].cast("string"))), ",")
    return rounded(s.withColumns({"last_run": F.date_format("last_run_start_time", "yyyy-MM-dd HH:mm:ss"), "run_types": kinds}).drop("last_run_start_time"), total_cost=4)


@query("SELECT round(quantile_cont(t, 0.5), 6) AS first_token_p50, round(quantile_cont(t, 0.99), 6) AS first_token_p99 FROM (SELECT CASE WHEN run_type = 'llm' THEN latency_s / 4 END AS t FROM runs_events)")
def f6_first_token(spark, d):
    runs = view(spark, d, "runs_events").withColumn("first_token_s", F.when(F.col("run_type") == "llm", F.col("latency_s") / 4))
    return rounded(M.run_stats(runs).select("first_token_p50", "first_token_p99"))


@query("""SELECT name, coalesce(run_count, 0) AS run_count, error_rate, total_cost, latency_p50, latency_p99, total_tokens FROM (SELECT DISTINCT concat('prj/', lower(c_mktsegment)) AS name FROM customer UNION SELECT concat('prj/', lower(r_name)) FROM region) p LEFT JOIN (SELECT project AS name, count(*) AS run_count,
    round(avg(CASE WHEN error IS NULL THEN 0.0 ELSE 1.0 END), 6) AS error_rate, round(sum(CAST(total_cost AS DECIMAL(38, 12))), 4)::DOUBLE AS total_cost, round(quantile_cont(latency_s, 0.5), 6) AS latency_p50, round(quantile_cont(latency_s, 0.99), 6) AS latency_p99, sum(total_tokens)::BIGINT AS total_tokens FROM runs_trace GROUP BY project) USING (name)""", TRACE)
def f7_project_stats(spark, d):
    names = view(spark, d, "customer").select(F.concat(F.lit("prj/"), F.lower("c_mktsegment")).alias("name")).union(view(spark, d, "region").select(F.concat(F.lit("prj/"), F.lower("r_name")))).distinct()
    return rounded(M.project_stats(names, view(spark, d, "runs_trace")).drop("last_run_start_time"), total_cost=4)


@query("SELECT split_part(tag, ':', 1) AS key, list_sort(list_distinct(list(substr(tag, instr(tag, ':') + 1)))) AS values FROM (SELECT unnest([tag_len, tag_env]) AS tag FROM runs_events) WHERE tag IS NOT NULL GROUP BY 1")
def f8_tag_discovery(spark, d):
    return D.discover_tags(events(spark, d))


@query("SELECT DISTINCT unnest(json_keys(props)) AS key FROM runs_events")
def f9_metadata_keys(spark, d):
    return D.discover_metadata_keys(events(spark, d))


def _payload():
    """A nested payload of each event, as JSON text."""
    inner = F.struct(F.col("latency_s").alias("seconds"), F.array("name", "run_type").alias("names"), F.struct(F.col("tag_env").alias("env")).alias("deep"))
    return F.to_json(F.struct(F.from_json("props", "struct<k: bigint>").alias("meta"), inner.alias("run"), F.col("error").alias("error")))


_LEAVES = """SELECT id, path, value FROM (SELECT id, 'meta.k' AS path, json_extract_string(props, '$.k') AS value FROM runs_events UNION ALL SELECT id, 'run.names', concat('["', name, '","', run_type, '"]') FROM runs_events
    UNION ALL SELECT id, 'run.deep.env', concat('"', tag_env, '"') FROM runs_events WHERE tag_env IS NOT NULL UNION ALL SELECT id, 'error', concat('"', error, '"') FROM runs_events WHERE error IS NOT NULL UNION ALL SELECT id, 'run.deep', '{}' FROM runs_events WHERE tag_env IS NULL)"""


@query(_LEAVES)
def c3_flatten(spark, d):
    runs = view(spark, d, "runs_events").withColumn("payload", _payload())
    return D.flatten_json(runs, "id", "payload").where(F.col("path") != "run.seconds").select("id", "path", F.to_json("value").alias("value"))


@query(_LEAVES)
def k2_flatten_in_sql(spark, d):
    """Flattening as a table function."""
    register_flatten(spark)
    runs = view(spark, d, "runs_events").withColumn("payload", _payload())
    return spark.sql("SELECT r.id, f.path, to_json(f.value) AS value FROM {runs} r, LATERAL runlake_flatten(r.payload) f WHERE f.path <> 'run.seconds'", runs=runs)


@query("""SELECT path, type, count(*) AS n FROM (SELECT unnest(['meta.k', 'run.names', 'run.seconds']) AS path, unnest(['int', 'list', 'float']) AS type FROM runs_events UNION ALL SELECT 'run.deep.env', 'str' FROM runs_events WHERE tag_env IS NOT NULL
    UNION ALL SELECT 'error', 'str' FROM runs_events WHERE error IS NOT NULL UNION ALL SELECT 'run.deep', 'dict' FROM runs_events WHERE tag_env IS NULL) GROUP BY ALL""")
def c4_value_types(spark, d):
    runs = view(spark, d, "runs_events").withColumn("payload", _payload())
    return D.flatten_json(runs, "id", "payload").groupBy("path", C.value_type("value").alias("type")).agg(F.count("*").alias("n"))


@query("""SELECT path, type, present_count, round(present_count * 100.0 / (SELECT count(*) FROM runs_events), 1) AS present_pct, number_min, number_max, round(number_avg, 6) AS number_avg, number_p50, length_min, length_max, round(length_avg, 6) AS length_avg, length_p50 FROM (
    SELECT 'meta.k' AS path, 'int' AS type, count(*) AS present_count, min(k) AS number_min, max(k) AS number_max, avg(k) AS number_avg, quantile_cont(k, 0.5) AS number_p50, CAST(NULL AS INT) AS length_min, CAST(NULL AS INT) AS length_max, CAST(NULL AS DOUBLE) AS length_avg, CAST(NULL AS DOUBLE) AS length_p50 FROM (SELECT CAST(json_extract(props, '$.k') AS DOUBLE) AS k FROM runs_events)
    UNION ALL SELECT 'error', 'str', count(*), NULL, NULL, NULL, NULL, min(length(error)), max(length(error)), avg(length(error)), quantile_cont(length(error), 0.5) FROM runs_events WHERE error IS NOT NULL
    UNION ALL SELECT 'run.names', 'list', count(*), NULL, NULL, NULL, NULL, 2, 2, 2, 2 FROM runs_events)""")
def f10_field_profile(spark, d):
    runs = view(spark, d, "runs_events").withColumn("payload", _payload())
    leaves = D.flatten_json(runs, "id", "payload").where(P.path_within("path", ["meta", "error", "run.names"]))
    return rounded(D.profile_fields(leaves, runs.count()).drop("number_sum", "sample"))


@query(f"""{language_sql("runs_docs", "text")} SELECT project, language, sum(n)::BIGINT AS n, round(sum(n) * 100.0 / any_value(a), 1) AS pct FROM (SELECT project, CASE WHEN r <= 3 THEN language ELSE 'others' END AS language, n, a FROM (SELECT project, language, count(*) AS n, sum(count(*)) OVER (PARTITION BY project) AS a,
    row_number() OVER (PARTITION BY project ORDER BY count(*) DESC, language) AS r FROM detected WHERE language IS NOT NULL GROUP BY project, language)) GROUP BY project, language""", ("runs_docs",))
def f11_language_distribution(spark, d):
    return language_distribution(view(spark, d, "runs_docs"), ["project"], "text")


@query("""SELECT path, type, present_count FROM (VALUES ('meta', 'dict'), ('meta.k', 'int'), ('run', 'dict'), ('run.seconds', 'float'), ('run.names', 'list'), ('run.names[]', 'str'), ('run.deep', 'dict')) v(path, type), (SELECT count(*) AS present_count FROM runs_events)
    UNION ALL SELECT 'run.deep.env', 'str', count(*) FROM runs_events WHERE tag_env IS NOT NULL UNION ALL SELECT 'error', 'str', count(*) FROM runs_events WHERE error IS NOT NULL UNION ALL SELECT 'flip', 'mixed', count(*) FROM runs_events""")
def f12_schema_inference(spark, d):
    flip = F.when(F.length("id") % 2 == 0, F.concat(F.lit('"'), "id", F.lit('"'))).otherwise(F.col("id"))
    runs = view(spark, d, "runs_events").withColumn("payload", F.concat(F.left(_payload(), F.length(_payload()) - 1), F.lit(',"flip":'), flip, F.lit("}")))
    return D.infer_schema(runs, "id", "payload").drop("sample")


@query("SELECT project, count(*) AS run_count, strftime(min(start_time), '%Y-%m-%d %H:%M:%S') AS oldest, strftime(max(start_time), '%Y-%m-%d %H:%M:%S') AS newest FROM runs_events GROUP BY project")
def f13_ingest_metadata(spark, d):
    """Read from what appends have published: events in two batches that overlap."""
    path, runs = new_path(spark, "stored"), view(spark, d, "runs_events").select("id", "start_time", "project")
    for part in (F.col("id").cast("long") % 3 != 0, F.col("id").cast("long") % 3 != 1):
        append_runs(runs.where(part), path, [F.asc("start_time")])
    return store.metadata(spark, path).select("project", "run_count", *(F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) for c in ("oldest", "newest")))


@query("SELECT project, count(*) AS run_count, sum(length(props))::BIGINT AS chars, project NOT IN ('svc/0', 'svc/1', 'svc/2') AS orphan FROM runs_events GROUP BY project")
def f14_stored_projects(spark, d):
    runs = view(spark, d, "runs_events")
    return D.stored_projects(runs, runs.select(F.col("project").alias("name")).distinct().where(F.col("name") < "svc/3"), F.col("props"))


@query("SELECT regexp_extract(error, '^(\\w+Error)', 1) AS kind, count(*) AS n FROM runs_trace WHERE error IS NOT NULL GROUP BY 1 ORDER BY n DESC, kind LIMIT 5", TRACE)
def f15_error_patterns(spark, d):
    return M.error_patterns(view(spark, d, "runs_trace"))


@query("SELECT error, count(*) AS n FROM runs_trace WHERE error IS NOT NULL GROUP BY error ORDER BY n DESC, error LIMIT 5", TRACE)
def f15_error_counts(spark, d):
    return M.error_counts(view(spark, d, "runs_trace"))


@query("SELECT count(*) AS total, count(*) - count(error) AS successful, count(error) AS failed, round((count(*) - count(error)) * 100.0 / count(*), 6) AS success_pct FROM runs_trace", TRACE)
def f16_success_report(spark, d):
    return rounded(M.success_report(view(spark, d, "runs_trace")))


@query("SELECT name, count(*) AS n, round(avg(total_cost), 6) AS avg_cost, round(sum(CAST(total_cost AS DECIMAL(38, 12))), 4)::DOUBLE AS total_cost FROM runs_trace_llm GROUP BY name", LLM)
def f17_cost_by_name(spark, d):
    return rounded(M.cost_by_name(view(spark, d, "runs_trace_llm")), total_cost=4)


@query("SELECT project, count(*) FILTER (WHERE service_tier = 'flex') AS attributed_runs, count(*) AS total_runs, round(coalesce(sum(CAST(total_cost AS DECIMAL(38, 12))) FILTER (WHERE service_tier = 'flex'), 0), 4)::DOUBLE AS attributed_cost, round(sum(CAST(total_cost AS DECIMAL(38, 12))), 4)::DOUBLE AS total_cost FROM runs_trace_llm GROUP BY project", LLM)
def f18_attribution_coverage(spark, d):
    return rounded(M.attribution_coverage(view(spark, d, "runs_trace_llm"), F.when(F.col("service_tier") == "flex", "flex")), 4)


@query("SELECT key, count(score) AS n, round(avg(score), 6) AS avg_score FROM feedback GROUP BY key", ("feedback",))
def f19_feedback_averages(spark, d):
    return rounded(M.feedback_averages(view(spark, d, "feedback")))


@query("""SELECT * FROM (SELECT project AS name, count(*) AS run_count, 0.0 AS error_rate, round(quantile_cont(n_chars / 1000, 0.5), 6) AS latency_p50, round(quantile_cont(n_chars / 1000, 0.99), 6) AS latency_p99, sum(n_chars)::BIGINT AS total_tokens, round(sum(n_chars) / 1000, 3) AS total_cost FROM runs_docs GROUP BY project)
    LEFT JOIN (SELECT d.project AS name, key, count(score) AS n, round(avg(score), 6) AS avg_score FROM feedback f JOIN runs_docs d ON d.id = f.run_id GROUP BY ALL) USING (name)""", ("runs_docs", "feedback"))
def f19_experiment_results(spark, d):
    runs = view(spark, d, "runs_docs").withColumns({"parent_run_id": F.lit(None).cast("string"), "start_time": F.lit(None).cast("timestamp"), "latency_s": F.col("n_chars") / 1000, "total_tokens": F.col("n_chars"), "total_cost": F.col("n_chars") / 1000})
    names = runs.select(F.col("project").alias("name")).distinct()
    return rounded(M.experiment_results(names, runs, view(spark, d, "feedback")), total_cost=3)


@query("SELECT l_returnflag AS value, count(*) AS n FROM lineitem GROUP BY 1", ())
def f20_payload_items(spark, d):
    packed = view(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.to_json(F.struct(F.collect_list(F.struct(F.col("l_returnflag").alias("flag"), F.col("l_linenumber").alias("line"))).alias("items"))).alias("payload"))
    return payloads.count_items(payloads.items(packed, ["id"], "payload", "$.items", "struct<flag: string, line: int>"), F.col("item.flag"))


@query("SELECT DISTINCT strftime(date_trunc('minute', start_time), '%Y-%m-%d %H:%M') AS minute, project, name FROM runs_events")
def f20_distinct_items(spark, d):
    runs = view(spark, d, "runs_events")
    return payloads.distinct_items(runs, F.date_format(F.date_trunc("MINUTE", "start_time"), "yyyy-MM-dd HH:mm").alias("minute"), F.col("project"), F.col("name"))


@query("SELECT id, length(text) AS chars FROM runs_docs ORDER BY chars DESC, id LIMIT 10", ("runs_docs",))
def f21_largest_payloads(spark, d):
    return payloads.largest_payloads(view(spark, d, "runs_docs"), F.col("text"))


@query("SELECT count(*) AS n FROM runs_events WHERE error IS NOT NULL")
def f22_count_only(spark, d):
    return view(spark, d, "runs_events").where(P.failed()).agg(F.count("*").alias("n"))


@query("SELECT id, row_key FROM runs_trace_llm QUALIFY row_number() OVER (PARTITION BY id ORDER BY start_time DESC, row_key) = 1", LLM)
def f23_distinct_by_id(spark, d):
    return sampling.distinct_by_id(view(spark, d, "runs_trace_llm"), [F.desc("start_time"), F.asc("row_key")]).select("id", "row_key")


@query("SELECT substr(tag_len, 5) AS stratum, id FROM runs_events WHERE tag_len IN ('len:short', 'len:long') QUALIFY row_number() OVER (PARTITION BY tag_len ORDER BY start_time DESC, id) <= 10")
def g1_stratified_sample(spark, d):
    return sampling.stratified(events(spark, d), {"len": C.group_value("tag", "len")}, 10, values={"len": ["short", "long"]}).select("stratum", "id")


@query("SELECT concat(substr(tag_len, 5), ':', substr(tag_env, 5)) AS stratum, id FROM runs_events WHERE tag_len IN ('len:short', 'len:long') AND tag_env IN ('env:dev', 'env:prod') QUALIFY row_number() OVER (PARTITION BY tag_len, tag_env ORDER BY start_time DESC, id) <= 5")
def g2_stratified_product(spark, d):
    strata = {"len": C.group_value("tag", "len"), "env": C.group_value("tag", "env")}
    return sampling.stratified(events(spark, d), strata, 5, values={"len": ["short", "long"], "env": ["dev", "prod"]}).select("stratum", "id")


@query("SELECT project, id FROM runs_events QUALIFY row_number() OVER (PARTITION BY project ORDER BY start_time DESC, id) = 1")
def g4_latest_per_project(spark, d):
    return sampling.latest(view(spark, d, "runs_events"), "project").select("project", "id")


@query(f", q AS ({exclusive(3, 4, 'project', 'runs_events')}) SELECT project, round(q, 6) AS p75 FROM q")
def g6_exclusive_quartile(spark, d):
    return rounded(M.exclusive_quantiles(view(spark, d, "runs_events"), ["project"], "latency_s", {"p75": (3, 4)}))


@query("""SELECT project, lang, sum(n)::BIGINT AS n, round(sum(n) * 100.0 / any_value(a), 1) AS pct FROM (SELECT project, CASE WHEN r <= 2 THEN lang ELSE 'others' END AS lang, n, a FROM (SELECT project, lang, count(*) AS n, sum(count(*)) OVER (PARTITION BY project) AS a, row_number() OVER (PARTITION BY project ORDER BY count(*) DESC, lang) AS r FROM runs_docs GROUP BY project, lang)) GROUP BY project, lang""", ("runs_docs",))
def g7_top_and_others(spark, d):
    counts = view(spark, d, "runs_docs").groupBy("project", "lang").agg(F.count("*").alias("n"))
    return D.top_and_others(counts, ["project"], "lang", 2)


@query("SELECT trace_id, id, name FROM runs_chat QUALIFY row_number() OVER (PARTITION BY trace_id ORDER BY turn DESC, id) = 1", ("runs_chat",))
def g5_last_turn(spark, d):
    return sampling.top_per(view(spark, d, "runs_chat"), ["trace_id"], 1, [F.desc("turn"), F.asc("id")]).select("trace_id", "id", "name")


@query("SELECT project, service_tier, sum(total_tokens)::BIGINT AS total_tokens, count(*) AS run_count FROM runs_trace GROUP BY ALL HAVING sum(total_tokens) > 0", TRACE)
def d19_active_only(spark, d):
    cube = usage.usage_cube(view(spark, d, "runs_trace").withColumn("start_time", F.lit(None).cast("timestamp")), breakdown=("project", "service_tier"), active_only=True)
    return cube.select("project", "service_tier", "total_tokens", "run_count")


@query("SELECT project, row_key FROM runs_trace QUALIFY row_number() OVER (PARTITION BY project ORDER BY latency_s DESC, row_key) <= 7", TRACE)
def g3_per_project_limit(spark, d):
    return sampling.top_per(view(spark, d, "runs_trace"), ["project"], 7, [F.desc("latency_s"), F.asc("row_key")]).select("project", "row_key")
