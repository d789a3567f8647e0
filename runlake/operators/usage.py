"""Token and cost usage by time bucket, group and breakdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlake.functions.columns import money_sum, provider, time_bucket

BREAKDOWNS = ("model", "project", "provider", "gateway", "service_tier")
_SUMS = ("total_tokens", "prompt_tokens", "completion_tokens", "total_cost", "prompt_cost", "completion_cost")


def usage_cube(runs: DataFrame, interval: str = "day", group: Column | None = None, breakdown: tuple[str, ...] = (), active_only: bool = False) -> DataFrame:
    """Sums of tokens and costs and the number of runs by time bucket, group ('ungrouped' where it is missing) and breakdowns.

    One partial aggregation before one shuffle, whatever the number of breakdowns.
    """
    if unknown := set(breakdown) - set(BREAKDOWNS):
        raise ValueError(f"no such breakdowns: {sorted(unknown)}")
    group = F.lit("all") if group is None else F.coalesce(F.nullif(group, F.lit("")), F.lit("ungrouped"))
    keys = [time_bucket("start_time", interval).alias("time"), group.alias("group_value")]
    keys += [provider("model", "gateway").alias("provider") if b == "provider" else F.col(b) for b in breakdown]
    out = runs.groupBy(*keys).agg(*((money_sum if c.endswith("_cost") else F.sum)(F.coalesce(F.col(c), F.lit(0))).alias(c) for c in _SUMS), F.count("*").alias("run_count"))
    if active_only:
        out = out.where(F.col("total_tokens") > 0)
    return out.orderBy("time", "group_value", *breakdown)


def usage_totals(runs: DataFrame, interval: str, dimensions: list[str]) -> DataFrame:
    """Usage with subtotals: a row with nulls for each level of `dimensions` under a time bucket."""
    return runs.withColumn("time", time_bucket("start_time", interval)).rollup("time", *dimensions).agg(F.sum("total_tokens").alias("total_tokens"), money_sum("total_cost").alias("total_cost"), F.count("*").alias("run_count"))


def usage_summary(cube: DataFrame) -> DataFrame:
    """One row: totals, active buckets, groups, and the most and the average number of groups in a bucket; zeros for no rows."""
    buckets = cube.groupBy("time").agg(F.countDistinct("group_value").alias("groups"))
    figures = buckets.agg(F.struct(F.count("*").alias("active_buckets"), F.coalesce(F.max("groups"), F.lit(0)).alias("max_concurrent"), F.coalesce(F.avg("groups"), F.lit(0.0)).alias("avg_concurrent")).alias("figures"))
    totals = cube.agg(F.coalesce(F.sum("total_tokens"), F.lit(0)).alias("total_tokens"), F.coalesce(F.sum("total_cost"), F.lit(0)).alias("total_cost"), F.coalesce(F.sum("run_count"), F.lit(0)).alias("run_count"), F.countDistinct("group_value").alias("unique_groups"))
    return totals.withColumn("figures", figures.scalar()).select(*totals.columns, "figures.*")
