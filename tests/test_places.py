from pyspark.sql import functions as F
from test_documents import FILE, MENU

from vellum.operators import reports
from vellum.plans import catalogue_rows
from vellum.plans.staging import ship
from vellum.sources.scan import objects, xref_summary
from vellum.sources.write import packed


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_where_objects_stand_is_said_from_one_pass_without_a_shuffle(spark):
    ship(spark)
    broken = FILE + b"99 0 obj\n<< /Type /XRef /W [1 2] /Length 2 >>\nstream\nab\nendstream\nendobj\n"
    late = b"%PDF-1.7\n1 0 obj\n<< /Type /XRef % c\n /W [1 2 1] /Size 1 /Filter 2 0 R /Length 4 >>\nstream\n\0\0\0\0\nendstream\nendobj\n2 0 obj\n/AHx\nendobj\n"
    rows = [("f", FILE), ("p", packed(MENU, "/Root 7 0 R")), ("b", broken), ("l", late), ("h", FILE.replace(b"/Root 7", b"/XRefStm 9 /Root 7")), ("e", b""), ("x", b"no document"), ("n", None)]
    docs = spark.createDataFrame([(k, None if v is None else bytearray(v)) for k, v in rows], "doc_id string, content binary")
    one = reports.structure(docs)
    assert _plan(one).count("MapInArrow") == 1 and "Exchange" not in _plan(one)
    other = reports.structure(docs, objects(docs)).join(xref_summary(docs), "doc_id").select(one.columns)
    got = {r.doc_id: r for r in one.collect()}
    assert got == {r.doc_id: r for r in other.collect()} and set(got) == set("fpblh")
    assert got["p"].in_object_streams == 4 and got["h"].writer == "hybrid_xref_stream" and "no usable /W" in got["b"].error


def test_parts_with_hybrid_references_are_not_shuffled_by_document(spark, tmp_path):
    rows = spark.range(5).select(F.col("id").alias("p_partkey"), F.lit("a (b) \\ c").alias("p_name"))
    rows.write.parquet(f"{tmp_path}/part.parquet")
    got = catalogue_rows.hybrid_references(spark, str(tmp_path))
    assert "hashpartitioning" not in _plan(got) and _plan(got).count("MapInArrow") == 1
    assert {r.doc_id: (r.has_hybrid, r.writer, r.fits) for r in got.collect()} == {i: (i % 3 < 2, "hybrid_xref_stream" if i % 3 < 2 else "xref_stream", i % 3 != 1) for i in range(5)}
