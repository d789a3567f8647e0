"""The stages, each on its own input, against plain versions; and every query on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from runlake.llm import decontaminate, ngram_join
from runlake.llm.common import table

SMALL = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, SMALL, "documents")
    columns = docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SMALL).cache()
        seen[name] = (docs, out)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == columns and 0 < out.count() <= docs.count()
        docs = out
    before, after = seen["quality classifier"]
    labels = table(spark, SMALL, "labels").toPandas().set_index("doc_id").quality
    kept = {r.doc_id for r in after.select("doc_id").collect()}
    good = [i for i in labels.index if labels[i] == 1]
    assert sum(i in kept for i in good) > 0.97 * len(good)
    before, after = seen["n-gram Jaccard join"]
    groups = ngram_join.join_components(before).toPandas()
    assert {r.doc_id for r in after.select("doc_id").collect()} == set(groups.component_id)
    before, after = seen["benchmark decontamination"]
    leaks = {r.doc_id for r in decontaminate.find_matches(before, table(spark, SMALL, "benchmark")).collect()}
    assert {r.doc_id for r in after.select("doc_id").collect()} == {r.doc_id for r in before.select("doc_id").collect()} - leaks
    before, after = seen["best-fit packing"]
    assert {r.doc_id for r in after.select("doc_id").collect()} == {r.doc_id for r in before.select("doc_id").collect()}


@pytest.mark.parametrize("name", sorted(n for n in entry.queries() if n.startswith("op") or n == "pipeline"))
def test_query_runs(spark, name):
    assert entry.queries()[name](spark, SMALL).count() > 0


@pytest.mark.parametrize("name", sorted(n for n in entry.oracle_sql() if n.startswith("op")))
def test_query_against_sql(spark, name):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{SMALL}/documents.parquet'")
    df = entry.queries()[name](spark, SMALL)
    columns = sorted(df.columns)
    found = c.execute(entry.oracle_sql()[name])
    names = [x[0] for x in found.description]
    assert sorted(names) == columns
    at = [names.index(x) for x in columns]
    assert sorted(tuple(map(str, (r[x] for x in columns))) for r in df.collect()) == sorted(tuple(str(r[i]) for i in at) for r in found.fetchall())
