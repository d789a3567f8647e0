"""Listings of projects, datasets, examples, prompts and feedback, and finding an entity by name or id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlake.functions.columns import looks_like_uuid
from runlake.operators.predicates import all_of
from runlake.operators.sampling import page
from runlake.operators.similar import suggest_names  # noqa: F401  (it finds entities, too)


def contains_metadata(wanted: dict[str, str], metadata: str = "metadata") -> Column:
    return all_of(*(F.coalesce(F.col(metadata)[k] == v, F.lit(False)) for k, v in wanted.items()))


def list_entities(df: DataFrame, *, where: Column | None = None, ids: list[str] | None = None, name_contains: str | None = None, order: list[Column], offset: int = 0, limit: int = 0, fields: list[str] | None = None) -> DataFrame:
    """A listing: filtered, in a total order, one page of it, only the fields named (unknown ones are passed over)."""
    if where is not None:
        df = df.where(where)
    if ids is not None:
        df = df.where(F.col("id").isin(ids))
    if name_contains is not None:
        df = df.where(F.col("name").contains(name_contains))
    out = page(df, order, offset, limit)
    return prune(out, fields) if fields else out


def prune(df: DataFrame, fields: list[str]) -> DataFrame:
    return df.select(*(c for c in dict.fromkeys(f.strip() for f in fields) if c in df.columns))


def resolve(wanted: DataFrame, entities: DataFrame) -> DataFrame:
    """`wanted` (query) with the id of the entity (id, name) it means: a UUID is an id; else a name, else an id."""
    by_name = entities.groupBy(F.col("name").alias("query")).agg(F.min("id").alias("named"))
    by_id = entities.select(F.col("id").alias("query"), F.col("id").alias("identified")).distinct()
    out = wanted.join(by_name, "query", "left").join(by_id, "query", "left")
    return out.select("query", F.when(looks_like_uuid("query"), F.col("identified")).otherwise(F.coalesce("named", "identified")).alias("id"))


def examples_from_runs(runs: DataFrame, where: Column) -> DataFrame:
    """Runs that meet the condition, as dataset examples."""
    return runs.where(where).select(F.concat(F.lit("ex-"), F.col("id")).alias("id"), "inputs", "outputs", F.col("id").alias("source_run_id"))


def runs_of_examples(examples: DataFrame, runs: DataFrame) -> DataFrame:
    """Runs of an experiment with the example each answers."""
    return examples.select(F.col("id").alias("reference_example_id"), F.col("inputs").alias("example_inputs")).join(runs, "reference_example_id")


def experiments_of_dataset(projects: DataFrame, datasets: DataFrame) -> DataFrame:
    """Projects (with `reference_dataset_id`) that are experiments on one of `datasets` (id)."""
    return projects.join(datasets.select(F.col("id").alias("reference_dataset_id")), "reference_dataset_id", "left_semi")
