"""Prices: estimates for runs without a cost, coverage, effective prices, matches in a catalogue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlake.functions.columns import money_sum

#: Rows of a price table that is broadcast; a larger one is joined by a shuffle.
BROADCAST_ROWS = 100_000


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def estimate_costs(runs: DataFrame, prices: DataFrame) -> DataFrame:
    """`runs` with the costs of runs that have tokens but no cost filled in; a price for model+tier goes before the model's."""
    prices = _small(prices.select(F.lower("model").alias("__key"), F.struct("input_per_million", "output_per_million").alias("__price")))
    tiered = prices.select(F.col("__key").alias("__tier_key"), F.col("__price").alias("__tier_price"))
    out = runs.withColumns({"__key": F.lower("model"), "__tier_key": F.concat(F.lower("model"), F.lit("+"), F.lower("service_tier"))}).join(tiered, "__tier_key", "left").join(prices, "__key", "left")
    price, wanted = F.coalesce("__tier_price", "__price"), (F.coalesce("total_cost", F.lit(0)) == 0) & (F.col("total_tokens") > 0)
    made = {"prompt_cost": F.col("prompt_tokens") * price["input_per_million"] / 1e6, "completion_cost": F.col("completion_tokens") * price["output_per_million"] / 1e6}
    made["total_cost"] = made["prompt_cost"] + made["completion_cost"]
    return out.withColumns({c: F.when(wanted & price.isNotNull(), v).otherwise(F.col(c)) for c, v in made.items()}).drop("__key", "__tier_key", "__price", "__tier_price").select(*runs.columns)


def pricing_coverage(runs: DataFrame) -> DataFrame:
    """By model: runs, tokens, cost, whether it is priced, and whether a price is missing (tokens but no cost)."""
    out = runs.groupBy("model").agg(F.count("*").alias("run_count"), F.sum("total_tokens").alias("total_tokens"), money_sum("total_cost").alias("total_cost"))
    priced = (F.col("total_cost") > 0) | (F.col("total_tokens") == 0)
    return out.withColumns({"has_pricing": priced, "missing": (F.col("total_tokens") > 0) & (F.col("total_cost") == 0)}).orderBy(F.desc("total_tokens"), "model")


def effective_prices(runs: DataFrame, catalogue: DataFrame | None = None) -> DataFrame:
    """Price per million tokens of each model as paid; where nothing was paid the catalogue's, else 0."""
    out = runs.groupBy("model").agg(*(F.sum(c).alias(c) for c in ("prompt_cost", "completion_cost", "prompt_tokens", "completion_tokens")))
    paid = {f"{k}_per_million": F.round(F.col(f"{a}_cost") / F.nullif(F.col(f"{a}_tokens"), F.lit(0)) * 1e6, 4) for k, a in (("input", "prompt"), ("output", "completion"))}
    out = out.select("model", *(F.nullif(c, F.lit(0.0)).alias(n) for n, c in paid.items()))
    if catalogue is not None:
        found = match_catalogue(out.select("model"), catalogue)
        out = out.alias("o").join(found.alias("f"), "model", "left").select("model", *(F.coalesce(F.col(f"o.{n}"), F.col(f"f.{n}")).alias(n) for n in paid))
    return out.fillna(0.0)


def candidate_names(model: Column) -> Column:
    """Names under which a catalogue may list a model, best first."""
    bare = ~model.contains("/")
    out = F.array(model)
    more = F.when(bare & model.startswith("llama"), F.array(F.concat(F.lit("meta-llama/"), model), F.concat(F.lit("meta-llama/"), model, F.lit("-instruct"))))
    more = more.when(bare & model.startswith("qwen"), F.array(F.concat(F.lit("qwen/"), model))).when(bare & model.startswith("gpt"), F.array(F.concat(F.lit("openai/"), model))).otherwise(F.array().cast("array<string>"))
    versatile = F.when(model.contains("-versatile"), F.array(F.concat(F.lit("meta-llama/"), F.replace(model, F.lit("-versatile"), F.lit("")), F.lit("-instruct")))).otherwise(F.array().cast("array<string>"))
    return F.concat(out, more, versatile)


def match_catalogue(models: DataFrame, catalogue: DataFrame) -> DataFrame:
    """model, catalogue_id, input_per_million, output_per_million of the first candidate name in the catalogue, in any case."""
    names = models.select("model").distinct().select("model", F.posexplode(candidate_names(F.col("model"))).alias("pos", "name"))
    found = names.join(_small(catalogue.withColumn("__id", F.lower("id"))), F.lower("name") == F.col("__id"))
    best = found.groupBy("model").agg(F.min_by(F.struct("id", "input_per_million", "output_per_million"), "pos").alias("b"))
    return best.select("model", F.col("b.id").alias("catalogue_id"), "b.input_per_million", "b.output_per_million")
