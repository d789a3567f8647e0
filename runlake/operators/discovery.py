"""What fields, tags, metadata keys and types runs have."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runlake.functions.columns import tag_key, tag_rest, value_type
from runlake.operators.metrics import continuous, ranked_values
from runlake.operators.sampling import top_per

#: Levels of nested objects that are opened.
FLATTEN_DEPTH, SCHEMA_DEPTH = 5, 8


def tag_values(df: DataFrame) -> DataFrame:
    """(key, value) of all tags in the form key:value, each pair once; a key may have any number of values."""
    tags = df.select(F.explode("tags").alias("tag")).where(F.col("tag").contains(":"))
    return tags.select(tag_key("tag").alias("key"), tag_rest("tag").alias("value")).distinct()


def discover_tags(df: DataFrame, most: int | None = None) -> DataFrame:
    """key, values: of tags in the form key:value, the distinct values of each key in order; `most` keeps so many of a key, the first in order."""
    pairs = tag_values(df)
    if most is not None:
        pairs = top_per(pairs, ["key"], most, [F.asc("value")])
    return pairs.groupBy("key").agg(F.array_sort(F.collect_list("value")).alias("values")).orderBy("key")


def discover_metadata_keys(df: DataFrame) -> DataFrame:
    return df.select(F.explode(F.map_keys("metadata")).alias("key")).distinct().orderBy("key")


def flatten_json(df: DataFrame, key: str, text: str, max_depth: int = FLATTEN_DEPTH) -> DataFrame:
    """(key, path, value VARIANT): leaves of a JSON object under dotted paths.

    Lists and empty objects are leaves; an object below `max_depth` levels disappears. Text that is no JSON has none.
    Each text is parsed once. Rows pass through one explode a level: objects give their fields, leaves go through as they are.
    """
    kind = F.schema_of_variant("value")
    inner = F.coalesce(kind.startswith("OBJECT") & (kind != "OBJECT<>"), F.lit(False))
    level = df.select(F.col(key).alias("__key"), F.lit("").alias("path"), F.try_parse_json(text).alias("value")).withColumn("inner", inner).where("inner")
    for _ in range(max_depth):
        level = df.sparkSession.sql(
            "SELECT t.__key, CASE WHEN e.key IS NULL THEN t.path WHEN t.path = '' THEN e.key ELSE concat(t.path, '.', e.key) END AS path, CASE WHEN e.key IS NULL THEN t.value ELSE e.value END AS value "
            "FROM {level} t, LATERAL variant_explode_outer(CASE WHEN t.inner THEN t.value END) e",
            level=level,
        ).withColumn("inner", inner)
    return level.where("NOT inner").select(F.col("__key").alias(key), "path", "value")


def profile_fields(leaves: DataFrame, total: int, key: str = "id") -> DataFrame:
    """By path of `leaves` (key, path, value), each path once for a key: type of the first value that is not null, presence, and the figures of lengths or numbers."""
    kind = value_type("value")
    number = F.when(kind.isin("int", "float"), F.variant_get("value", "$", "double"))
    length = F.when(kind == "str", F.length(F.variant_get("value", "$", "string"))).when(kind == "list", F.size(F.variant_get("value", "$", "array<variant>")))
    own = leaves.select(key, "path", kind.alias("kind"), number.isNotNull().alias("is_number"), F.coalesce(number, length).alias("x"), F.to_json("value").alias("text")).where(F.col("kind") != "null")
    # counted once by value; a value has a number or a length, never both
    counted = own.groupBy("path", "is_number", "x").agg(F.count("*").alias("n"))
    figures = []
    for name, mine in (("number", F.col("is_number")), ("length", ~F.col("is_number"))):
        x, n = F.when(mine, F.col("x")), F.when(mine & F.col("x").isNotNull(), F.col("n"))
        figures += [F.min(x).alias(f"{name}_min"), F.max(x).alias(f"{name}_max"), (F.sum(x * n) / F.sum(n)).alias(f"{name}_avg")]
    total_x = F.sum(F.when(F.col("is_number"), F.col("x") * F.col("n"))).alias("number_sum")
    first = own.groupBy("path").agg(F.min_by(F.struct("kind", "text"), key).alias("first"))
    out = counted.groupBy("path").agg(F.sum("n").alias("present_count"), *figures, total_x).join(first, "path")
    medians = ranked_values(counted, ["path", "is_number"], "x", {"p50": continuous(0.5)}, "n").groupBy("path").agg(F.max(F.when(F.col("is_number"), F.col("p50"))).alias("number_p50"), F.max(F.when(~F.col("is_number"), F.col("p50"))).alias("length_p50"))
    out = out.join(medians, "path", "left").withColumns({"present_pct": F.round(F.col("present_count") * 100.0 / total, 1), "type": F.col("first.kind"), "sample": F.col("first.text")})
    names = [f"{c}_{f}" for c in ("number", "length") for f in ("min", "max", "avg", "p50")]
    return out.select("path", "type", "present_count", *names, "number_sum", "sample", "present_pct").orderBy("path")


#: What counts in the schema text of a VARIANT: quoted names, brackets, and types that elements of a list may have been merged to.
_MARKS = "`(?:[^`]|``)*`|ARRAY<|OBJECT<|>|DECIMAL|DOUBLE|VARIANT"


def _merged(schema: Column) -> Column:
    """Whether a schema text may stand for lists whose elements differ in type: numbers of both kinds and unlike types share one text."""
    start = F.struct(F.lit("").alias("open"), F.lit(False).alias("found"))

    def step(state: Column, mark: Column) -> Column:
        opened = F.when(mark == "ARRAY<", F.concat(state.open, F.lit("a"))).when(mark == "OBJECT<", F.concat(state.open, F.lit("o"))).when(mark == ">", F.left(state.open, F.length(state.open) - 1)).otherwise(state.open)
        return F.struct(opened.alias("open"), (state.found | (mark.isin("DECIMAL", "DOUBLE", "VARIANT") & state.open.contains("a"))).alias("found"))

    return schema.rlike("(?s)ARRAY<.*(DECIMAL|DOUBLE|VARIANT)") & F.aggregate(F.regexp_extract_all(schema, F.lit(_MARKS), F.lit(0)), start, step)["found"]


def _kinds_of_payload(df: DataFrame, key: str, text: str) -> DataFrame:
    """(kind, n, first): payloads with the same types under the same paths are one kind, of which the payload of the smallest key is kept."""
    whole = F.schema_of_variant(F.try_parse_json("text"))
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text")).withColumn("schema", whole).where(F.col("schema").isNotNull())
    # digits do not tell decimals apart, but for those after the point; a text with quoted names is left as it is
    plain = F.when(F.col("schema").contains("`"), F.col("schema")).otherwise(F.regexp_replace("schema", "DECIMAL\\([0-9]+,[1-9][0-9]*\\)", "DECIMAL"))
    kind = F.when(_merged(F.col("schema")), F.concat(F.lit("#"), F.md5("text"))).otherwise(F.md5(plain))
    return rows.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"), F.min(F.struct(F.col("key").isNull().alias("none"), "key", "text")).alias("first"))


def infer_schema(df: DataFrame, key: str, text: str, max_depth: int = SCHEMA_DEPTH, sample: int = 50) -> DataFrame:
    """path, type, present_count, sample: every path of JSON values, [] standing for the elements of a list; 'mixed' where types differ.

    The sample is the JSON text of the value of the smallest key, cut to `sample` signs. Rows are one run each.
    Rows are summed up by the schema of their payload, in one pass and before the shuffle; only one payload of each schema
    is opened level by level. Lists that may mix types are told apart by their whole text. Payloads that all differ in
    their schemas are all opened.
    """
    opened = _kinds_of_payload(df, key, text).select("kind", "n", "first.key", F.lit("").alias("path"), F.try_parse_json("first.text").alias("value"), F.lit(False).alias("done"))
    for depth in range(max_depth):
        # a value stays as it is and, the first time, is opened too
        stays = F.array(F.lit(False)) if depth == 0 else F.when(F.col("done"), F.array(F.lit(True))).otherwise(F.array(F.lit(True), F.lit(False)))
        opened = df.sparkSession.sql(
            "SELECT t.kind, t.n, t.key, CASE WHEN t.stays THEN t.path WHEN e.key IS NULL THEN concat(t.path, '[]') WHEN t.path = '' THEN e.key ELSE concat(t.path, '.', e.key) END AS path, CASE WHEN t.stays THEN t.value ELSE e.value END AS value, t.stays AS done "
            "FROM {level} t, LATERAL variant_explode_outer(CASE WHEN NOT t.stays THEN t.value END) e WHERE t.stays OR e.value IS NOT NULL",
            level=opened.select("*", F.explode(stays).alias("stays")),
        )
    values = opened.select("kind", "n", "key", "path", value_type("value").alias("type"), F.left(F.to_json("value"), F.lit(sample)).alias("text")).where(F.col("type") != "null")
    # the elements of a list share a path within a payload
    payloads = values.groupBy("path", "kind", "n", "key").agg(F.min("type").alias("low"), F.max("type").alias("high"), F.min("text").alias("text"))
    known = payloads.groupBy("path").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("present_count"), F.min(F.struct(F.col("key").isNull().alias("none"), "key", "text")).alias("first"))
    return known.select("path", F.when(F.col("low") != F.col("high"), "mixed").otherwise(F.col("low")).alias("type"), "present_count", F.col("first.text").alias("sample")).orderBy("path")


def top_and_others(counts: DataFrame, keys: list[str], name: str, n: int = 3) -> DataFrame:
    """The `n` most frequent names of each key, the rest as 'others', with percentages."""
    w = Window.partitionBy(*keys).orderBy(F.desc("n"), name)
    ranked = counts.withColumns({"rank": F.row_number().over(w), "all": F.sum("n").over(Window.partitionBy(*keys))})
    kept = ranked.groupBy(*keys, F.when(F.col("rank") <= n, F.col(name)).otherwise("others").alias(name)).agg(F.sum("n").alias("n"), F.first("all").alias("all"))
    return kept.select(*keys, name, "n", F.round(F.col("n") * 100.0 / F.col("all"), 1).alias("pct"))


def project_metadata(runs: DataFrame) -> DataFrame:
    """By project: how many runs are stored, of which times."""
    return runs.groupBy("project").agg(F.count("*").alias("run_count"), F.min("start_time").alias("oldest"), F.max("start_time").alias("newest"))


def stored_projects(runs: DataFrame, projects: DataFrame, row_text: Column) -> DataFrame:
    """Stored projects with their size; orphans are those no longer in `projects` (name)."""
    sized = runs.groupBy("project").agg(F.count("*").alias("run_count"), F.sum(F.length(row_text)).alias("chars"))
    known = projects.select(F.col("name").alias("project"), F.lit(False).alias("orphan"))
    return sized.join(known, "project", "left").withColumn("orphan", F.coalesce("orphan", F.lit(True)))
