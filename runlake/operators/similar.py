"""Similar names by an inverted index: no query is compared with names that share nothing with it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runlake.functions.columns import name_tokens
from runlake.operators.sampling import top_per
from runlake.sources.shared import new_path

#: A query that has enough names of at least this Jaccard similarity needs no others; sets that are so similar share a part among their rarest ones.
ENOUGH = (2, 5)
#: A part that more names hold is looked up by what kinds of names hold it, not name by name. It changes work, not results.
COMMON = 500


def _written(df: DataFrame, what: str) -> DataFrame:
    path = new_path(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _substrings(c: Column, length: int) -> Column:
    starts = F.when(F.length(c) >= length, F.sequence(F.lit(1), F.length(c) - length + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.substr(c, i, F.lit(length)))


def own_grams(c: Column) -> Column:
    """Distinct substrings of three signs, or all of a shorter text: a text is contained in another only if each of these is."""
    return F.when(F.length(c) < 3, F.array(c)).otherwise(F.array_distinct(_substrings(c, 3)))


def all_grams(c: Column) -> Column:
    """All that may be among the own grams of a text contained in this one, but for the empty text."""
    return F.array_distinct(F.concat(*(_substrings(c, k) for k in (1, 2, 3))))


def containment(asked: DataFrame, known: DataFrame, top: int) -> DataFrame:
    """(query, name) of which one may contain the other: they share the rarest gram of the shorter one."""
    q_low, n_low = F.lower("query"), F.lower("name")
    of_names = known.select("name", F.explode(all_grams(n_low)).alias("gram"))
    often = _written(of_names.groupBy("gram").agg(F.count("*").alias("often")), "grams")

    def keyed(df: DataFrame, name: str, low: Column) -> DataFrame:
        grams = df.select(name, F.explode(own_grams(low)).alias("gram")).join(often, "gram", "left")
        return grams.groupBy(name).agg(F.min_by("gram", F.struct(F.coalesce("often", F.lit(0)), "gram")).alias("gram"))

    # every text contains the empty one; of its names, which are alike, the first are enough
    first = known.orderBy("name").limit(top + 1).select("name", F.lit("").alias("gram"))
    inside = keyed(asked, "query", q_low).join(of_names.unionByName(first), "gram").where(F.contains(n_low, q_low))
    of_queries = asked.select("query", F.explode(F.concat(all_grams(q_low), F.array(F.lit("")))).alias("gram"))
    around = keyed(known, "name", n_low).join(of_queries, "gram").where(F.contains(q_low, n_low))
    return inside.select("query", "name").unionByName(around.select("query", "name"))


def _parts(df: DataFrame, name: str, often: DataFrame | None = None) -> DataFrame:
    """(name, part, size[, nth]): the distinct parts of each name; with `often`, numbered from the rarest on."""
    parts = df.select(name, F.array_distinct(name_tokens(name)).alias("parts")).select(name, F.size("parts").alias("size"), F.explode("parts").alias("part"))
    if often is None:
        return parts
    rarest = Window.partitionBy(name).orderBy("often", "part")
    return parts.join(often, "part", "left").fillna(0, ["often"]).withColumn("nth", F.row_number().over(rarest))


def suggest_names(queries: DataFrame, names: DataFrame, top: int = 5) -> DataFrame:
    """For each of the queries (query) the `top` most similar names (name): 1 if one contains the other, else the Jaccard similarity of their parts; equal names and 0 are left out.

    Small letters count as capitals, ties go by name, null names and queries take no part. Containment is looked up by
    the rarest three signs. Parts are looked up in two steps: names of a similarity of at least ENOUGH by the rarest
    parts of both; for queries that have too few of these, every name of a rare part, and of common parts the first
    names of each kind, which is the set of their common parts and their number of parts: names of one kind differ
    for a query by their rare parts only, so the others of a kind cannot come before the first ones.
    """
    asked = _written(queries.select("query").where("query IS NOT NULL").distinct(), "asked")
    known = _written(names.select("name").where("name IS NOT NULL").distinct(), "names")
    often = _written(_parts(known, "name").groupBy("part").agg(F.count("*").alias("often")), "parts")
    of_names, of_queries = (_written(_parts(df, c, often), f"parts-{c}") for df, c in ((known, "name"), (asked, "query")))
    parts_q, parts_n = F.array_distinct(name_tokens("query")), F.array_distinct(name_tokens("name"))
    shared = F.size(F.array_intersect(parts_q, parts_n))
    jaccard = F.coalesce(shared / F.nullif(F.size(parts_q) + F.size(parts_n) - shared, F.lit(0)), F.lit(0.0))
    q_low, n_low = F.lower("query"), F.lower("name")

    def scored(pairs: DataFrame) -> DataFrame:
        score = F.when(F.contains(n_low, q_low) | F.contains(q_low, n_low), 1.0).otherwise(jaccard)
        return pairs.distinct().where(q_low != n_low).withColumn("score", score).where("score > 0")

    def best(found: DataFrame) -> DataFrame:
        return top_per(found, ["query"], top, [F.desc("score"), F.asc("name")]).select("query", "name", "score")

    some, of = ENOUGH
    prefix = F.col("nth") <= F.col("size") - F.ceil(F.col("size") * some / of) + 1
    q, n = of_queries.where(prefix), of_names.where(prefix)
    near = q.select("query", "part", F.col("size").alias("q_size")).join(n.select("name", "part", "size"), "part").where(F.least("q_size", "size") * of >= F.greatest("q_size", "size") * some)
    contained = containment(asked, known, top)
    first = _written(best(scored(near.select("query", "name").unionByName(contained)).where(F.col("score") >= some / of)), "near")
    full = first.groupBy("query").count().where(F.col("count") >= top).select("query")
    q = of_queries.join(full, "query", "left_anti").select("query", "part")
    kinds = of_names.where(F.col("often") > COMMON).groupBy("name", "size").agg(F.array_sort(F.collect_list("part")).alias("kind"))
    heads = top_per(kinds, ["kind", "size"], top + 1, [F.asc("name")]).select("name", F.explode("kind").alias("part"))
    rare = of_names.where(F.col("often") <= COMMON).select("name", "part")
    more = q.join(rare, "part").unionByName(q.join(heads, "part")).select("query", "name")
    rest = first.join(full, "query", "left_anti").select("query", "name")
    return first.join(full, "query", "left_semi").unionByName(best(scored(more.unionByName(rest))))
