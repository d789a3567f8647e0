"""Views of the given tables as runs, traces, feedback and examples; the same SQL text runs in Spark and DuckDB."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runlake.operators.text import LOOKED_AT, SHORTEST, SIZES, WORDS

#: "Now" of the fixtures.
NOW = datetime(2024, 1, 31)

VIEWS = {
    "runs_events": """
SELECT CAST(event_id AS STRING) AS id, concat('svc/', CAST(user_id % 5 AS STRING)) AS project, event_type AS name,
 CASE WHEN event_type IN ('click','view') THEN 'llm' WHEN event_type='purchase' THEN 'tool' ELSE 'chain' END AS run_type,
 ts AS start_time, value/10 AS latency_s,
 CASE WHEN event_type='error' THEN concat('ValueError: user ', CAST(user_id AS STRING)) END AS error,
 CASE WHEN value<20 THEN 'len:short' WHEN value<80 THEN 'len:medium' ELSE 'len:long' END AS tag_len,
 CASE WHEN user_id % 3 = 0 THEN 'env:prod' WHEN user_id % 3 = 1 THEN 'env:dev' END AS tag_env, props,
 CAST(NULL AS STRING) AS parent_run_id, CAST(event_id AS STRING) AS trace_id, CAST(floor(value) AS BIGINT) AS total_tokens, value/1000 AS total_cost
FROM events""",
    "runs_trace_llm": """
SELECT concat('l', CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING)) AS id,
 concat('o', CAST(l_orderkey AS STRING)) AS trace_id, concat('o', CAST(l_orderkey AS STRING)) AS parent_run_id,
 'llm' AS run_type, p_type AS name, concat('prj/', lower(c_mktsegment)) AS project,
 l_shipdate AS start_time, l_quantity/10 AS latency_s,
 CASE WHEN l_returnflag='R' THEN concat('ReturnError: line ', CAST(l_linenumber AS STRING)) END AS error,
 CASE p_size % 8 WHEN 0 THEN 'gpt-4o' WHEN 1 THEN 'claude-3' WHEN 2 THEN 'gemini-2' WHEN 3 THEN 'meta-llama/llama-3'
   WHEN 4 THEN 'groq/qwen-3' WHEN 5 THEN 'acme-7b' WHEN 6 THEN 'o3-mini' ELSE 'unknown' END AS model,
 concat('gw', CAST(s_nationkey % 4 AS STRING)) AS gateway,
 CASE WHEN l_linestatus='O' THEN 'flex' ELSE 'unknown' END AS service_tier,
 CAST(l_quantity*70 AS BIGINT) AS prompt_tokens, CAST(l_quantity*30 AS BIGINT) AS completion_tokens,
 CAST(l_quantity*70 AS BIGINT)+CAST(l_quantity*30 AS BIGINT) AS total_tokens,
 CASE WHEN l_returnflag='A' THEN 0.0 ELSE l_extendedprice*0.7/1000000 END AS prompt_cost,
 CASE WHEN l_returnflag='A' THEN 0.0 ELSE l_extendedprice*0.3/1000000 END AS completion_cost,
 CASE WHEN l_returnflag='A' THEN 0.0 ELSE l_extendedprice/1000000 END AS total_cost,
 concat_ws('-', CAST(l_orderkey AS STRING), CAST(l_linenumber AS STRING), CAST(l_partkey AS STRING),
           CAST(l_suppkey AS STRING), CAST(l_extendedprice AS STRING)) AS row_key,
 CAST(NULL AS STRING) AS channel_id
FROM lineitem JOIN orders ON l_orderkey=o_orderkey JOIN customer ON o_custkey=c_custkey
JOIN part ON l_partkey=p_partkey JOIN supplier ON l_suppkey=s_suppkey""",
    "runs_trace_root": """
SELECT concat('o', CAST(o_orderkey AS STRING)) AS id, concat('o', CAST(o_orderkey AS STRING)) AS trace_id,
 CAST(NULL AS STRING) AS parent_run_id, 'chain' AS run_type, o_orderpriority AS name,
 concat('prj/', lower(c_mktsegment)) AS project, o_orderdate AS start_time, o_totalprice/10000 AS latency_s,
 CASE WHEN o_orderstatus='P' THEN 'TimeoutError: pending' END AS error,
 'unknown' AS model, 'unknown' AS gateway, 'unknown' AS service_tier,
 CAST(0 AS BIGINT) AS prompt_tokens, CAST(0 AS BIGINT) AS completion_tokens, CAST(0 AS BIGINT) AS total_tokens,
 CAST(0 AS DOUBLE) AS prompt_cost, CAST(0 AS DOUBLE) AS completion_cost, CAST(0 AS DOUBLE) AS total_cost,
 concat('o', CAST(o_orderkey AS STRING)) AS row_key, concat('room-', CAST(o_custkey % 10 AS STRING)) AS channel_id
FROM orders JOIN customer ON o_custkey=c_custkey""",
    "runs_trace": "SELECT * FROM runs_trace_root UNION ALL BY NAME SELECT * FROM runs_trace_llm",
    "feedback": "SELECT CAST(doc_id AS STRING) AS run_id, 'quality' AS key, CAST(quality AS DOUBLE) AS score FROM labels UNION ALL SELECT CAST(doc_id AS STRING), 'toxic', CAST(toxic AS DOUBLE) FROM labels",
    "runs_docs": "SELECT CAST(doc_id AS STRING) AS id, source AS project, lang, text, n_chars, CAST(NULL AS STRING) AS error FROM documents",
    "runs_chat": "SELECT concat('c', CAST(conv_id AS STRING)) AS trace_id, concat('c', CAST(conv_id AS STRING), '-', CAST(turn AS STRING)) AS id, turn, role AS name, text FROM conversations",
    "examples": "SELECT CAST(item_id AS STRING) AS id, text FROM benchmark",
    "prices": "SELECT * FROM (VALUES ('gpt-4o', 2.5, 10.0), ('gpt-4o+flex', 1.25, 5.0), ('claude-3', 3.0, 15.0), ('gemini-2', 0.1, 0.4), ('acme-7b', 0.2, 0.2)) AS p(model, input_per_million, output_per_million)",
}
_TABLES = ("lineitem", "orders", "customer", "part", "supplier", "nation", "region", "events", "documents", "labels", "conversations", "benchmark", "pages", "embeddings")
_NEEDS = {"runs_trace": ("runs_trace_root", "runs_trace_llm")}


def sql_of(name: str) -> str:
    """WITH clauses of a view and of those it is made of, for DuckDB."""
    return ", ".join(f"{n} AS ({VIEWS[n]})" for n in (*_NEEDS.get(name, ()), name))


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view as a DataFrame; `name` may be a table too. Timestamps without zone become UTC timestamps."""
    if name in _TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if name in _NEEDS:
        a, b = (view(spark, sf_dir, n) for n in _NEEDS[name])
        return a.unionByName(b)
    sql = VIEWS[name].replace("BY NAME", "")
    words = set(sql.replace("\n", " ").replace(",", " ").split())
    frames = {t: view(spark, sf_dir, t) for t in _TABLES if t in words}
    for t in frames:
        sql = sql.replace(f"FROM {t}", f"FROM {{{t}}}").replace(f"JOIN {t} ", f"JOIN {{{t}}} ")
    out = spark.sql(sql, **frames) if frames else spark.sql(sql)
    return out.withColumns({f.name: F.col(f.name).cast("timestamp") for f in out.schema if f.dataType.typeName() == "timestamp_ntz"})


def with_maps(events: DataFrame) -> DataFrame:
    """`runs_events` with `tags` and `metadata`."""
    tags = F.array_compact(F.array("tag_len", "tag_env"))
    return events.withColumns({"tags": tags, "metadata": F.from_json("props", "map<string,string>")})


def language_sql(rows: str, text: str) -> str:
    """Further clauses of a WITH, the last of which, `detected`, is the view `rows` with the `language` of its column `text`, in DuckDB."""
    lists = ", ".join(f"('{code}', '{words.replace(chr(39), chr(39) * 2)}')" for code, words in sorted(WORDS.items()))
    grams = "SELECT {0}, unnest(list_transform(range(1, length({1}) - {2} + 2), lambda i: substr({1}, CAST(i AS INT), {2}))) AS gram FROM {3}"
    of_words = " UNION ALL ".join(grams.format("code, n", "w", k, "lang_words") for k in SIZES)
    of_texts = " UNION ALL ".join(grams.format("nth", "padded", k, "lang_texts") for k in SIZES)
    padded = f"concat(' ', array_to_string(list_filter(string_split_regex(lower(left({text}, {LOOKED_AT})), '[^\\p{{L}}\\p{{M}}]+'), lambda w: w <> ''), ' '), ' ')"
    return f""", lang_words AS (SELECT code, concat(' ', unnest(string_split(words, ' ')), ' ') AS w, 600 // (generate_subscripts(string_split(words, ' '), 1) + 4) + 1 AS n FROM (VALUES {lists}) v(code, words)),
    lang_counts AS (SELECT code, gram, sum(n) AS n FROM ({of_words}) WHERE gram <> ' ' GROUP BY ALL), lang_every AS (SELECT DISTINCT gram FROM lang_counts),
    lang_totals AS (SELECT code, sum(n) + (SELECT count(*) FROM lang_every) AS total FROM lang_counts GROUP BY code),
    lang_profile AS (SELECT e.gram, t.code, CAST(round(1000 * ln((coalesce(c.n, 0) + 1) / t.total)) AS BIGINT) AS score FROM lang_every e CROSS JOIN lang_totals t LEFT JOIN lang_counts c ON c.gram = e.gram AND c.code = t.code),
    lang_rows AS (SELECT *, row_number() OVER () AS nth FROM {rows}), lang_texts AS (SELECT nth, {padded} AS padded FROM lang_rows WHERE length({text}) >= {SHORTEST}),
    lang_grams AS (SELECT nth, gram, count(*) AS often FROM ({of_texts}) GROUP BY ALL),
    lang_sums AS (SELECT nth, code, sum(often * score) AS score FROM lang_grams JOIN lang_profile USING (gram) GROUP BY ALL),
    lang_best AS (SELECT nth, code FROM lang_sums QUALIFY row_number() OVER (PARTITION BY nth ORDER BY score DESC, code) = 1),
    detected AS (SELECT r.* EXCLUDE (nth), b.code AS language FROM lang_rows r LEFT JOIN lang_best b USING (nth))"""
