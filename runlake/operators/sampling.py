"""Samples, limits, sorts and pages; every order is total, so results do not depend on the partitioning."""

from __future__ import annotations

from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NEWEST = ("start_time", "id")


def newest_first() -> list[Column]:
    return [F.desc("start_time"), F.asc("id")]


def top_per(df: DataFrame, keys: list[str], n: int, order: list[Column] | None = None) -> DataFrame:
    """The first `n` rows of each key; Spark keeps only n rows a key before the shuffle (WindowGroupLimit)."""
    w = Window.partitionBy(*keys).orderBy(*(order or newest_first()))
    return df.withColumn("__rank", F.row_number().over(w)).where(F.col("__rank") <= n).drop("__rank")


def recent_sample(df: DataFrame, n: int) -> DataFrame:
    """The `n` newest runs; 0 is all."""
    return df.orderBy(*newest_first()).limit(n) if n else df


def limit_per_project(df: DataFrame, n: int) -> DataFrame:
    return top_per(df, ["project"], n) if n else df


def latest(df: DataFrame, by: str | None = None) -> DataFrame:
    """The newest run, overall or for each value of a column."""
    return top_per(df, [by], 1) if by else recent_sample(df, 1)


def stratified(df: DataFrame, strata: dict[str, Column], per_stratum: int, combinations: list[tuple[str, ...]] | None = None, values: dict[str, list[str]] | None = None, seed: int | None = None) -> DataFrame:
    """At most `per_stratum` runs of each wanted stratum, with its label (values joined by ':').

    Strata are the given combinations, else the product of the given values of each dimension. Newest runs
    are taken, or with a seed those with the smallest seeded hash of their id.
    """
    if combinations is None:
        if values is None or set(values) != set(strata):
            raise ValueError("give combinations, or values of every dimension")
        combinations = list(product(*(values[d] for d in strata)))
    if any(len(c) != len(strata) for c in combinations):
        raise ValueError(f"a combination needs {len(strata)} values")
    label = F.concat_ws(":", *strata.values())
    wanted = reduce(lambda a, b: a & b, (c.isNotNull() for c in strata.values())) & label.isin([":".join(c) for c in combinations])
    order = newest_first() if seed is None else [F.xxhash64("id", F.lit(seed)), F.asc("id")]
    return top_per(df.where(wanted).withColumn("stratum", label), ["stratum"], per_stratum, order)


def sort_by(df: DataFrame, key: str, allowed: dict[str, Column], tie: str = "id") -> DataFrame:
    """Sorted by a named key, descending with a leading '-'; ties by `tie`."""
    name = key.lstrip("-")
    if name not in allowed:
        raise ValueError(f"cannot sort by {name!r}; there are {sorted(allowed)}")
    return df.orderBy(allowed[name].desc() if key.startswith("-") else allowed[name].asc(), tie)


def page(df: DataFrame, order: list[Column], offset: int = 0, limit: int = 0) -> DataFrame:
    out = df.orderBy(*order).offset(offset)
    return out.limit(limit) if limit else out


def as_of(versions: DataFrame, moment: Column, key: str = "id", modified: str = "modified_at", tie: str = "version") -> DataFrame:
    """The newest version of each key that is not younger than `moment`."""
    return top_per(versions.where(F.col(modified) <= moment), [key], 1, [F.desc(modified), F.desc(tie)])


def distinct_by_id(df: DataFrame, order: list[Column], key: str = "id") -> DataFrame:
    """One row of each id, the first by `order`."""
    return top_per(df, [key], 1, order)
