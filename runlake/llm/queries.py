"""Queries of the corpus operators over their whole tables: (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

import json

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_bucket, small_batches, table
from .chunks import dedup_substrings
from .cross_polytope import finite, nearest_neighbours
from .decontaminate import find_matches
from .licenses import oracle_sql as licenses_sql
from .licenses import scan
from .lines import drop_recurring_lines
from .lines import oracle_sql as lines_sql
from .manifest import manifest
from .manifest import oracle_sql as manifest_sql
from .ngram_join import join_components
from .packing import pack_documents
from .quality import classify
from .repeats import dedup_repeats
from .topk_search import quantized, top_k
from .toxicity import score as toxicity_score
from .whitening import integers, whiten


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return join_components(table(spark, sf_dir, "documents"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return dedup_substrings(table(spark, sf_dir, "documents"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_recurring_lines(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_lines", "n_dropped", "text")


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    bucket = crc_bucket("doc_id", 3)
    out = classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), bucket != 1)
    return out.select("doc_id", (bucket == 1).alias("held_out"), "score", "predicted")


def op5_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = quantized(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return top_k(vectors, vectors.where(F.col("vec_id") % 100 == 0), k=10)


def tokenizer_file(name: str = "word_bpe_49k.json") -> tuple[str, str]:
    """A tokenizer's file as text, and its split pattern."""
    with open(public_tokenizers.path(name), encoding="utf-8") as f:
        text = f.read()
    return text, json.loads(text)["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return pack_documents(table(spark, sf_dir, "documents"), *tokenizer_file())


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return dedup_repeats(table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return find_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: their source and language are the folders, their id the name."""
    path = F.concat_ws("/", F.lit("documents"), "source", "lang", F.col("doc_id").cast("string"))
    out = scan(table(spark, sf_dir, "documents").select(path.alias("path"), "text"))
    return out.withColumn("doc_id", F.element_at(F.split("path", "/"), -1).try_cast("long"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    bucket = crc_bucket("doc_id", 5)
    out = toxicity_score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), bucket != 0)
    return out.select("doc_id", (bucket == 0).alias("held_out"), "score", "predicted")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(table(spark, sf_dir, "documents"))


def op12_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = finite(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return nearest_neighbours(vectors, vectors.where(F.col("vec_id") % 100 == 0), k=10)


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(integers(table(spark, sf_dir, "embeddings"), "vec_id", "embedding"), most=16)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_line_dedup": op3_line_dedup,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_topk_search": op5_topk_search,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_suffix_array_dedup": op7_suffix_array_dedup,
    "op8_decontamination": op8_decontamination,
    "op9_license_scan": op9_license_scan,
    "op10_toxicity": op10_toxicity,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_nearest_neighbours": op12_nearest_neighbours,
    "op13_embedding_whitening": op13_embedding_whitening,
    "pipeline": pipeline,
}

ORACLES: dict[str, str] = {
    "op3_line_dedup": lines_sql(),
    "op11_merkle_manifest": manifest_sql(),
    "op9_license_scan": f"""SELECT *, CAST(list_last(string_split(path, '/')) AS BIGINT) AS doc_id FROM ({licenses_sql("concat_ws('/', 'documents', source, lang, CAST(doc_id AS VARCHAR))")})""",
}
