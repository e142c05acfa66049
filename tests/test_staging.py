from pyspark.sql import functions as F
from test_documents import FILE, one

from vellum.operators.nodes import text_rows
from vellum.operators.rewrite import reachable
from vellum.plans.staging import dealt, stage_documents


def test_rows_of_one_file_are_dealt_to_several_tasks(spark, tmp_path):
    spark.range(5_000).coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    spark.range(30).coalesce(1).write.parquet(f"{tmp_path}/nation.parquet")
    rows = dealt(spark, str(tmp_path), "part")
    assert rows.rdd.getNumPartitions() == 5 and rows.agg(F.count("id"), F.sum("id")).first() == (5_000, 12_497_500)
    assert dealt(spark, str(tmp_path), "nation").rdd.getNumPartitions() == 1


def test_staged_documents_are_not_broadcast(spark):
    a, b = (stage_documents(spark.range(100).select(F.col("id").cast("string").alias("doc_id"), F.lit(b"same").alias(c))) for c in "ab")
    got = a.join(b.groupBy("doc_id").agg(F.max("b").alias("b")), "doc_id", "left")
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString() and got.count() == 100


def test_documents_are_proven_where_they_lie(spark):
    docs = one(spark).union(one(spark, FILE.replace(b"/Root 7", b"/Root 9")))
    assert [r.sound for r in reachable(docs).collect()] == [True, False]
    assert text_rows(docs, proven=True).count() == text_rows(one(spark)).count() > 0
    assert "Exchange" not in reachable(docs)._jdf.queryExecution().executedPlan().toString()
