from pyspark.sql import functions as F

from vellum.operators import documents, graph
from vellum.plans.staging import ship
from vellum.sources import mint


def test_documents_whose_names_are_merged_are_parsed_once(spark):
    ship(spark)
    leaf = F.concat(F.lit("<< /Names [(same) 5 0 R "), mint.literal(F.concat(F.lit("own"), F.col("id").cast("string"))), F.lit(" 6 0 R (same) 7 0 R] >>"))
    body = F.array(mint.obj(1, "<< /Type /Catalog /Names 2 0 R >>"), mint.obj(2, "<< /Dests 3 0 R /JavaScript << /Names [(same) (x)] >> >>"), mint.obj(3, "<< /Kids [4 0 R] >>"), mint.obj(4, leaf))
    docs = spark.range(4).select(F.col("id").cast("string").alias("doc_id"), mint.document(body).alias("content"))
    got = documents.merged_names(graph.name_entries(docs), F.floor(F.col("doc_id").cast("int") / 2), F.col("doc_id").cast("long"))
    assert "MapInArrow" not in got._jdf.queryExecution().executedPlan().toString()
    rows = sorted((r.merged, r.part, r.kind, r.ord, r.name, r.target, r.value) for r in got.collect())
    of = lambda i, first: [(i // 2, i, "Dests", 0, "same" if first else "same#doc2", 5, None), (i // 2, i, "Dests", 1, f"own{i}", 6, None), (i // 2, i, "Dests", 2, f"same#doc{2 - first}", 7, None), (i // 2, i, "JavaScript", 0, "same" if first else "same#doc2", None, "x")]
    assert rows == sorted(of(0, True) + of(1, False) + of(2, True) + of(3, False))
