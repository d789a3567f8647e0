"""Connected components by alternating star contractions, as joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Tables


def components(links: DataFrame, tables: Tables | None = None) -> DataFrame:
    """(doc, comp) for every document of `links` (a, b): comp is the smallest document reachable.

    Each round hangs the neighbours of a document on its smallest neighbour, first the larger ones, then the
    others, until every component is a star. The rounds grow with the logarithm of a component's size;
    each writes one of `tables`, so a lost executor costs one round. Minima are aggregated
    before they are joined, so a document with very many links is no hot group.
    """
    tables = tables or Tables(links.sparkSession, "components")
    edges = tables.written(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = tables.written(small.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "edges")
        now = edges.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))).first()
        if now == seen:
            break
        seen = now
    roots = edges.select(F.col("v").alias("doc")).distinct()
    return edges.select(F.col("u").alias("doc"), F.col("v").alias("comp")).unionByName(roots.select("doc", F.col("doc").alias("comp")))
