"""A corpus pipeline of five stages, each written as Parquet and read again as the next one's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runlake.llm.common import crc_bucket, small_batches, table, written
from runlake.llm.decontaminate import clean
from runlake.llm.lines import drop_recurring_lines
from runlake.llm.ngram_join import join_components
from runlake.llm.packing import pack_documents
from runlake.llm.quality import with_scores
from runlake.llm.queries import tokenizer_file


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; labels are learned from the documents at hand, but for one fold."""
    small_batches(spark)
    scored = with_scores(docs, table(spark, sf_dir, "labels"), crc_bucket("doc_id", 3) != 1)
    return scored.where(F.col("__score") >= 0.5).select(*docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without recurring lines; one whose every line recurs from an earlier document goes."""
    out = drop_recurring_lines(docs, counts=("__lines", "__dropped"))
    out = out.where((F.col("__dropped") == 0) | (F.trim("text") != ""))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("__dropped") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every component of near-duplicates the document with the smallest id; documents without an id stay."""
    small_batches(spark)
    gone = join_components(docs).where(F.col("component_id") != F.col("doc_id")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item within its edit budget."""
    small_batches(spark)
    return clean(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its sequence and place."""
    small_batches(spark)
    return pack_documents(docs, *tokenizer_file())


STAGES = [
    ("quality classifier", keep_good),
    ("line dedup", drop_lines),
    ("n-gram Jaccard join", one_of_each_group),
    ("benchmark decontamination", drop_leaks),
    ("best-fit packing", packed),
]

#: No SQL expresses the classifier, the packing or the tokens; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over `documents`."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, f"stage{i}")
    return docs
