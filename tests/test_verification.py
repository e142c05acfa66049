from pyspark.sql import functions as F

from vellum.operators.verification import verify_pages
from vellum.plans.staging import ship
from vellum.sources import mint

WANTED = "doc_id string, page_count long, texts array<string>"


def test_pages_are_held_against_what_was_asked(spark):
    ship(spark)
    top, tree = mint.obj(1, "<< /Type /Catalog /Pages 2 0 R >>"), mint.obj(2, "<< /Type /Pages /Kids [3 0 R] >>")
    of = lambda doc_id, *objs: spark.range(1).select(F.lit(doc_id).alias("doc_id"), mint.document(F.array(top, tree, *objs)).alias("content"))
    shown = mint.obj(4, mint.stream(mint.show(F.lit("hi"))))
    docs = (
        of("array", mint.obj(3, "<< /Type /Page /Contents 8 0 R /Resources << >> >>"), shown, mint.obj(8, "[4 0 R]"))
        .union(of("bare", mint.obj(3, "<< /Type /Page >>"), shown))
        .union(of("lost", mint.obj(3, "<< /Type /Page /Contents 9 0 R /Note (7 0 R) >>"), shown))
        .union(spark.createDataFrame([("none", bytearray(b"no objects")), ("null", None)], "doc_id string, content binary"))
        .withColumns({c: F.lit(1) for c in ("num", "dangling", "missing")})
    )
    wanted = spark.createDataFrame([("array", 1, ["hi", None, "", "hi"]), ("array", None, ["oh", "ah"]), ("bare", 2, None), ("lost", 0, []), ("none", 1, ["hi"]), ("other", 1, ["hi"])], WANTED)
    columns = ("page_count", "page_count_ok", "content_ok", "resources_ok", "missing", "dangling", "ok")
    told = lambda rows: {r.doc_id: tuple(r[c] for c in columns) for r in rows.collect()}
    assert told(verify_pages(docs, wanted, need_content=True, need_resources=True)) == {
        "array": (1, True, True, True, ["ah", "oh"], 0, False),
        "bare": (1, False, False, False, [], 0, False),
        "lost": (1, True, False, False, [], 1, False),
        "none": (0, False, True, True, ["hi"], 0, False),
        "null": (0, True, True, True, [], 0, True),
    }
    free = told(verify_pages(docs, spark.createDataFrame([], WANTED)))
    assert {d: v[-1] for d, v in free.items()} == {"array": True, "bare": True, "lost": False, "none": True, "null": True}
    assert verify_pages(docs.limit(0), wanted).count() == 0


def test_documents_are_parsed_once_and_their_objects_are_not_shuffled(spark):
    ship(spark)
    docs = spark.range(3).select(F.col("id").cast("string").alias("doc_id"), mint.document(F.array(mint.obj(1, "<< /Type /Catalog /Of 5 0 R /To [6 0 R 5 0 R] >>"))).alias("content"))
    rows = verify_pages(docs, spark.createDataFrame([], WANTED))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan and "num#" not in plan
    assert {(r.page_count, r.dangling) for r in rows.collect()} == {(0, 3)}
