"""Grouped metrics of runs: counts, error rates, latency quantiles, tokens and costs."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runlake.functions.columns import money_sum

#: Metrics of `grouped_metrics` and how each is made of a group's runs; the exclusive quantiles come apart.
METRICS = ("count", "error_rate", "avg_latency", "p50_latency", "p95_latency", "p99_latency", "total_tokens", "avg_cost")
EXCLUSIVE = {"p95_latency": (19, 20), "p99_latency": (99, 100)}


def exclusive(i: int, n: int) -> Callable[[Column], tuple[Column, Column]]:
    """The quantile i/n by the exclusive method, for `ranked_values`.

    With m = count + 1 and j = floor(i * m / n) held within 1 and count - 1, it lies between the j-th and
    the next value, at i * m - j * n parts of n, and may lie beyond both.
    """

    def place(count: Column) -> tuple[Column, Column]:
        m = count + 1
        j = F.greatest(F.lit(1), F.least(count - 1, F.floor(F.lit(i) * m / F.lit(n))))
        return j, (F.lit(i) * m - j * n) / F.lit(float(n))

    return place


def continuous(p: float) -> Callable[[Column], tuple[Column, Column]]:
    """The quantile p between the values at both sides of place (count - 1) * p, for `ranked_values`."""

    def place(count: Column) -> tuple[Column, Column]:
        at = (count - 1) * F.lit(float(p))
        j = F.greatest(F.lit(1), F.least(count - 1, F.floor(at) + 1))
        return j, at - (j - 1)

    return place


def _bin(x: Column) -> Column:
    """A whole number that never falls where `x` grows: bins of half a percent of a value's size."""
    return F.when(F.isnan(x), F.lit(1 << 40)).otherwise(F.floor(F.signum(x) * F.log1p(F.abs(x) * 1e6) * 200))


def ranked_values(df: DataFrame, keys: list[str], value: str, wanted: dict[str, Callable[[Column], tuple[Column, Column]]], times: str | None = None) -> DataFrame:
    """`keys` and a column for each wanted quantile of `value`, exactly; null values do not count, one value is its own quantile. A row counts as often as its column `times` says.

    A quantile lies between the j-th and the next value of a group. Values are counted by group and value, by
    group and bin of values from that, and only the bins that hold a wanted rank are sorted: no group is sorted
    or held as a whole. Keys may be null, and no keys make one group.
    """
    # conditions that would be pushed below one use of the counts but not the other would make the rows twice
    known = F.col(value).isNotNull() if times is None else F.when(F.col(value).isNotNull(), F.col(times)) > 0
    own = df.where(known).select(*keys, F.col(value).cast("double").alias("__x"), (F.col(times) if times else F.lit(1)).alias("__t"))
    counted = own.groupBy(*keys, "__x").agg(F.sum("__t").alias("__n")).withColumn("__bin", _bin(F.col("__x")))
    group = Window.partitionBy(*keys)
    up_to = group.orderBy("__bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    bins = counted.groupBy(*keys, "__bin").agg(F.sum("__n").alias("__m"))
    bins = bins.withColumns({"__after": F.sum("__m").over(up_to), "__all": F.sum("__m").over(group)}).withColumn("__before", F.col("__after") - F.col("__m"))
    places = {name: place(F.col("__all")) for name, place in wanted.items()}
    ranks = [rank for j, _ in places.values() for rank in (j, j + 1)]
    held = reduce(or_, ((F.col("__before") < rank) & (F.col("__after") >= rank) for rank in ranks), F.col("__all") == 1)
    chosen = bins.where(held).select(*(F.col(k).alias(f"__{k}") for k in keys), F.col("__bin").alias("__of"), "__before", "__all")
    same = reduce(and_, (F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys), F.col("__bin").eqNullSafe(F.col("__of")))
    inside = Window.partitionBy(*keys, "__bin").orderBy("__x").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = counted.join(chosen, same).withColumn("__high", F.col("__before") + F.sum("__n").over(inside)).withColumn("__low", F.col("__high") - F.col("__n"))
    out = []
    for name, (j, part) in places.items():
        low, high = (F.max(F.when((F.col("__low") < rank) & (F.col("__high") >= rank), F.col("__x"))) for rank in (j, j + 1))
        share = F.max(part)
        out.append(F.when(F.max("__all") == 1, F.max("__x")).when(low == high, low).otherwise(low * (1 - share) + high * share).alias(name))
    return rows.groupBy(*keys).agg(*out)


def exclusive_quantiles(df: DataFrame, keys: list[str], value: str, wanted: dict[str, tuple[int, int]]) -> DataFrame:
    """`keys` and a column for each wanted quantile i/n by the exclusive method."""
    return ranked_values(df, keys, value, {name: exclusive(i, n) for name, (i, n) in wanted.items()})


def grouped_metrics(df: DataFrame, keys: dict[str, Column], metrics: Iterable[str] = METRICS, approximate: bool = False) -> DataFrame:
    """Metrics of runs (error, latency_s, total_tokens, total_cost) by any number of keys; rows without a key are dropped.

    `approximate` takes the quantiles from a mergeable sketch in the same pass.
    """
    metrics = list(metrics)
    if unknown := set(metrics) - set(METRICS):
        raise ValueError(f"no such metrics: {sorted(unknown)}")
    names = list(keys)
    own = df.select(*(c.alias(n) for n, c in keys.items()), "error", "latency_s", "total_tokens", "total_cost")
    for n in names:
        own = own.where(F.col(n).isNotNull() & (F.col(n).cast("string") != ""))
    made = {
        "count": F.count("*"),
        "error_rate": F.avg(F.col("error").isNotNull().cast("double")),
        "avg_latency": F.coalesce(F.avg("latency_s"), F.lit(0.0)),
        "total_tokens": F.sum(F.coalesce("total_tokens", F.lit(0))),
        "avg_cost": F.coalesce(F.avg("total_cost").cast("double"), F.lit(0.0)),
    }
    quantiles = {"p50_latency": continuous(0.5)} | {m: exclusive(*EXCLUSIVE[m]) for m in EXCLUSIVE}
    if approximate:
        shares = {"p50_latency": 0.5} | {m: i / n for m, (i, n) in EXCLUSIVE.items()}
        made |= {m: F.coalesce(F.percentile_approx("latency_s", p, 10_000), F.lit(0.0)) for m, p in shares.items()}
    # a count comes along, so that a group always has a row
    out = own.groupBy(*names).agg(F.count("*").alias("__rows"), *(made[m].alias(m) for m in metrics if m in made))
    asked = {m: quantiles[m] for m in metrics if m in quantiles and not approximate}
    if asked:
        out = out.join(ranked_values(own, names, "latency_s", asked), names, "left").fillna(0.0, list(asked))
    return out.select(*names, *metrics).orderBy(*names)


#: Quantiles of run and project figures.
LATENCIES = {"latency_p50": continuous(0.5), "latency_p99": continuous(0.99)}


def run_stats(df: DataFrame) -> DataFrame:
    """One row over all runs given: counts, error rate, quantiles of latency and of the time to the first token, tokens, cost, last run, and runs by type."""
    by_type = df.groupBy("run_type").agg(F.count("*").alias("n"))
    types = by_type.agg(F.array_sort(F.collect_list(F.struct("run_type", "n"))).alias("run_types"))
    total = df.agg(
        F.count("*").alias("run_count"),
        F.count("error").alias("failed"),
        F.count_if(F.col("error").isNull()).alias("successful"),
        F.avg(F.col("error").isNotNull().cast("double")).alias("error_rate"),
        F.sum("total_tokens").alias("total_tokens"),
        money_sum("total_cost").alias("total_cost"),
        F.max("start_time").alias("last_run_start_time"),
    )
    quantiles = [(ranked_values(df, [], "latency_s", LATENCIES), list(LATENCIES))]
    if "first_token_s" in df.columns:
        named = {n.replace("latency", "first_token"): f for n, f in LATENCIES.items()}
        quantiles.append((ranked_values(df, [], "first_token_s", named), list(named)))
    return total.select("*", *(q.select(n).scalar().alias(n) for q, names in quantiles for n in names), types.scalar().alias("run_types"))


def project_stats(projects: DataFrame, runs: DataFrame) -> DataFrame:
    """`projects` (name) with the figures of their runs; a project without runs has none."""
    runs = runs.withColumn("name", F.col("project"))
    figures = runs.groupBy("name").agg(
        F.count("*").alias("run_count"),
        F.avg(F.col("error").isNotNull().cast("double")).alias("error_rate"),
        money_sum("total_cost").alias("total_cost"),
        F.max("start_time").alias("last_run_start_time"),
        F.sum("total_tokens").alias("total_tokens"),
    )
    latencies = ranked_values(runs, ["name"], "latency_s", LATENCIES)
    out = projects.join(figures, "name", "left").join(latencies, "name", "left")
    return out.withColumn("run_count", F.coalesce("run_count", F.lit(0)))


def experiment_results(experiments: DataFrame, runs: DataFrame, feedback: DataFrame) -> DataFrame:
    """`experiments` (name) with the figures of their root runs (project stats) and the average of each feedback key on any of their runs, in long form (key, n, avg_score); one row without a key where there is no feedback."""
    stats = project_stats(experiments, runs.where(F.col("parent_run_id").isNull())).drop("last_run_start_time")
    scores = feedback.join(runs.select(F.col("id").alias("run_id"), F.col("project").alias("name")), "run_id").groupBy("name", "key").agg(F.count("score").alias("n"), F.avg("score").alias("avg_score"))
    return stats.join(scores, "name", "left")


def error_counts(df: DataFrame, top: int = 5) -> DataFrame:
    """The most frequent error texts."""
    return df.where(F.col("error").isNotNull()).groupBy("error").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "error").limit(top)


def error_patterns(df: DataFrame, top: int = 5) -> DataFrame:
    """The most frequent kinds of errors, by the word ending in Error that a message begins with."""
    kind = F.regexp_extract("error", "^(\\w+Error)", 1)
    return df.where(kind != "").groupBy(kind.alias("kind")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "kind").limit(top)


def success_report(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("total"), F.count_if(F.col("error").isNull()).alias("successful"), F.count("error").alias("failed"), (F.count_if(F.col("error").isNull()) * 100.0 / F.nullif(F.count("*"), F.lit(0))).alias("success_pct"))


def cost_by_name(df: DataFrame) -> DataFrame:
    return df.groupBy("name").agg(F.count("*").alias("n"), F.avg("total_cost").alias("avg_cost"), money_sum("total_cost").alias("total_cost")).orderBy(F.desc("total_cost"), "name")


def attribution_coverage(df: DataFrame, key: Column) -> DataFrame:
    """By project, runs and cost with a value of `key` (lower bound) against all (upper bound)."""
    known = F.coalesce(key, F.lit("")) != ""
    cost = F.coalesce(F.col("total_cost"), F.lit(0))
    return df.groupBy("project").agg(F.count_if(known).alias("attributed_runs"), F.count("*").alias("total_runs"), money_sum(F.when(known, cost).otherwise(F.lit(0))).alias("attributed_cost"), money_sum(cost).alias("total_cost"))


def feedback_averages(feedback: DataFrame) -> DataFrame:
    return feedback.groupBy("key").agg(F.count("score").alias("n"), F.avg("score").alias("avg_score"))
