"""Telling a batch's rows apart and comparing them with stored ones shuffles them once; orders, ids and projects of every kind."""

from pyspark.sql import functions as F

from runlake.sources import jsonl, store

SCHEMA = "id string, project string, n int"


def test_rows_are_shuffled_once(spark):
    """The batch and the stored ids go through one exchange each; a second one of the batch moved all of it again."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        staged, stored = spark.range(100).selectExpr("string(id) id", "string(id % 3) project", "int(id) n"), spark.range(50).selectExpr("string(id) id", "string(id % 3) project")
        plan = store._fresh(staged, [F.desc("n")], stored)._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert plan.count("Exchange hashpartitioning") == 2


def test_rows_without_a_project_or_an_id_and_orders_bound_to_the_batch(spark, tmp_path):
    path = str(tmp_path / "runs")
    one = spark.createDataFrame([("1", None, 2), ("1", None, 1), ("1", "a", 3), (None, "b", 0)], SCHEMA)
    assert sorted((r.id, str(r.project), r.n) for r in jsonl.append_runs(one, path, [F.asc("n")]).collect()) == [("1", "None", 1), ("1", "a", 3)]
    two = spark.createDataFrame([("1", None, 0), ("2", None, 5), ("2", None, 6), ("1", "a", 9), ("1", "b", 1), ("1", "b", 2)], SCHEMA)
    assert sorted((r.id, str(r.project), r.n) for r in jsonl.append_runs(two, path, [two["n"].desc()]).collect()) == [("1", "b", 2), ("2", "None", 6)]
    assert jsonl.append_runs(two, path, [F.asc("n")]).count() == 0
    assert spark.read.parquet(path).count() == 4
