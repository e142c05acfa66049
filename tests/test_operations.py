from pyspark.sql import functions as F

from vellum.operators import documents
from vellum.operators.graph import pages
from vellum.operators.nodes import text_rows
from vellum.sources import mint
from vellum.sources.scan import dangling, objects, xref_entries


def test_merged_documents_keep_order_boxes_and_references(spark):
    rows = spark.createDataFrame([(d, i, f"{d}{i}") for d in ("b", "a") for i in range(6)], "d string, i long, t string")
    objs = objects(mint.paged(rows, "d", "i", mint.show(F.col("t"))))
    docs = documents.merge(objs, F.lit("all"), F.when(F.col("doc_id") == "a", 0).otherwise(1))
    merged = objects(docs)
    tree = pages(merged)
    texts = text_rows(docs).drop("page_index").join(tree.select("doc_id", F.col("num").alias("page"), "page_index", "media_box"), ["doc_id", "page"])
    got = texts.orderBy("page_index").collect()
    assert [r.text for r in got] == [f"{d}{i}" for d in ("a", "b") for i in range(6)]
    assert {r.media_box for r in got} == {"[0 0 612 792]"} and dangling(merged).count() == 0


def test_empty_inputs(spark):
    docs = spark.createDataFrame([], "doc_id string, content binary")
    assert pages(objects(docs)).count() == 0 and documents.byte_range_status(docs).count() == 0
    assert documents.merge(objects(docs), F.lit("all"), F.col("doc_id")).count() == 0


def test_xref_sections(spark):
    body = b"%PDF-1.4\nxref\n0 2\n0000000000 65535 f \n0000000010 00000 n \n5 1\n0000000050 00001 n \ntrailer\n<<>>\nxref\n1 1\n0000000099 00000 n \ntrailer\n<<>>\n%%EOF"
    rows = xref_entries(spark.createDataFrame([("d", bytearray(body))], "doc_id string, content binary"))
    assert sorted((r.num, r.gen, r.offset, r.section) for r in rows.collect()) == [(1, 0, 10, 0), (1, 0, 99, 1), (5, 1, 50, 0)]
    assert sorted((r.num, r.offset) for r in documents.xref_in_force(rows).collect()) == [(1, 99), (5, 50)]


def test_transform_errors(spark):
    rows = spark.createDataFrame([("[0 0 10 10]", 90, 1.0), ("[0 0 10 10]", 45, 1.0), ("[0 0 0 10]", 0, 1.0), ("[0 0 10 10]", 0, 0.0), ("[0 0 10 10]", -90, 0.5)], "media_box string, t int, s double").withColumn("rotate", F.lit(None).cast("string"))
    got = documents.transformed(rows, F.col("t"), None, F.col("s")).collect()
    assert [r.error is None for r in got] == [True, False, False, False, True]
    assert got[0].rotate == 90 and got[4].rotate == 270 and got[4].box == [0.0, 0.0, 5.0, 5.0]
