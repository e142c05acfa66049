from pyspark.sql import functions as F
from test_documents import made

from vellum.operators import graph
from vellum.plans import catalogue_documents
from vellum.sources.scan import objects


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_pages_have_their_own_entries_beside_what_they_inherit(spark):
    docs = made(spark, b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [4 0 R 3 0 R 4 0 R] /Turn 7 /MediaBox [0 0 9 9] >>", b"<< /Type /Page /Turn 90 /Box [1 2] >>", b"<< /Type /Page /Box [3 4] /Other 1 >>")
    one = graph.pages(docs, own=("Turn", "Box"))
    assert "Exchange" not in _plan(one) and one.drop("entries").columns == graph.pages(docs).columns
    for source in (docs, objects(docs)):
        got = [(r.page_index, r.num, r.media_box, r.entries) for r in graph.pages(source, own=("Turn", "Box")).orderBy("page_index").collect()]
        assert got == [(0, 4, "[0 0 9 9]", {"Box": "[3 4]"}), (1, 3, "[0 0 9 9]", {"Turn": "90", "Box": "[1 2]"}), (2, 4, "[0 0 9 9]", {"Box": "[3 4]"})]


def test_parts_turned_and_cropped_are_not_shuffled_by_document(spark, tmp_path):
    rows = spark.createDataFrame([(1, 9, 900.5), (2, 7, 3.0), (3, 3, 900.0)], "p_partkey long, p_size int, p_retailprice double")
    rows.write.parquet(f"{tmp_path}/part.parquet")
    got = catalogue_documents.page_transforms(spark, str(tmp_path))
    assert "hashpartitioning" not in _plan(got) and _plan(got).count("MapInArrow") == 1
    assert sorted(map(tuple, got.collect())) == [(1, 270, 8.0, 1800.0, None), (2, -1, None, None, "rotation is not a multiple of 90"), (3, -1, None, None, "box has no area")]
