"""Stages keep columns whose names the operators use themselves."""

import corpus_pipeline

SMALL = "/root/testdata/sf0.001"


def test_stages_keep_columns_of_any_name(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    docs = docs.selectExpr("*", "doc_id + 1 AS score", "'a' AS predicted", "7 AS n_lines", "8 AS n_dropped", "9 AS component_id", "array(1) AS bucket")
    odd = docs.limit(2).selectExpr("CAST(NULL AS BIGINT) AS doc_id", "CAST(NULL AS STRING) AS text", *docs.columns[2:])
    docs = docs.unionByName(odd)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SMALL)
        assert out.columns == docs.columns and [t for _, t in out.dtypes] == [t for _, t in docs.dtypes]
        docs = out.cache()
        assert docs.where("n_dropped <> 8 OR n_lines <> 7 OR component_id <> 9 OR score <> doc_id + 1").count() == 0
    assert corpus_pipeline.packed(spark, docs, SMALL).count() >= docs.count()


def test_stages_on_no_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SMALL).count() == 0
