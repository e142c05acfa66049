from pyspark.sql import functions as F

from vellum.operators import changes, mutations
from vellum.plans.staging import ship
from vellum.sources import mint
from vellum.sources.scan import document_objects


def _docs(spark):
    ship(spark)
    body = F.array(
        mint.obj(1, "<< /Type /Catalog /AcroForm 9 0 R >>"), mint.obj(2, "<< /T (t) /FT /Tx /V (old) >>"), mint.obj(3, "<< /T (twice) /FT /Tx >>"), mint.obj(4, "<< /T (twice) /FT /Tx >>"),
        mint.obj(5, "<< /T (free) /FT /Ch /Ff 262144 /Opt [(a)] >>"), mint.obj(9, "<< /Fields [2 0 R 3 0 R 4 0 R 5 0 R] /NeedAppearances false >>"),
    )
    return spark.range(3).select(F.col("id").cast("string").alias("doc_id"), mint.document(body).alias("content"))


def test_fields_are_set_in_one_pass_where_a_document_meets_its_wishes(spark):
    wanted = spark.createDataFrame([("0", "t", "new"), ("0", "free", "z"), ("0", "no", "x"), ("1", "twice", "x"), ("2", "t", None), ("7", "t", "x")], "doc_id string, name string, value string")
    got = changes.set_fields(_docs(spark), wanted)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Broadcast" not in plan and "parquet" not in plan.lower()
    rows = {(r.doc_id, r.name): r for r in got.collect()}
    assert {k: r.status for k, r in rows.items()} == {("0", "t"): "ok", ("0", "free"): "ok", ("0", "no"): "no_field", ("1", "twice"): "ambiguous_field", ("2", "t"): "ok", ("7", "t"): "no_field"}
    own = {r["num"]: r["entries"] for r in document_objects(bytes(rows["0", "t"].content))}
    assert (own[2]["V"], own[5]["V"], own[9]["NeedAppearances"], own[1]["AcroForm"]) == ("(new)", "(z)", "true", "9 0 R")
    assert "V" not in document_objects(bytes(rows["2", "t"].content))[1]["entries"] and rows["1", "twice"].content is None


def test_fields_are_made_and_removed_in_one_pass_where_a_document_meets_its_wishes(spark):
    ship(spark)
    body = F.array(mint.obj(1, "<< /Type /Catalog /Pages 2 0 R /AcroForm << /Fields [4 0 R] /DA (x) >> >>"), mint.obj(2, "<< /Type /Pages /Kids [3 0 R] >>"), mint.obj(3, "<< /Type /Page /Annots [ 4 0 R ] >>"), mint.obj(4, "<< /T (old) /FT /Tx /Subtype /Widget >>"))
    docs = spark.range(2).select(F.col("id").cast("string").alias("doc_id"), mint.document(body).alias("content"))
    wanted = spark.createDataFrame([("0", "b", 0, [0.0, 0.0, 1.5, 2.0], "v"), ("0", "a", 0, [0.0, 0.0, 1.0, 2.0], None), ("1", "a", 0, [0.0, 0.0, 1.0, 2.0], "v"), ("1", "c", 5, [0.0, 0.0, 1.0, 2.0], "v"), ("9", "a", 0, [0.0, 0.0, 1.0, 2.0], "v")], "doc_id string, name string, page_index int, rect array<double>, value string")
    made = mutations.create_fields(docs, wanted)
    left = mutations.remove_fields(docs, spark.createDataFrame([("0", "old"), ("1", "none"), ("9", "old")], "doc_id string, name string"))
    for got in (made, left):
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert plan.count("MapInArrow") == 1 and "Broadcast" not in plan and "parquet" not in plan.lower()
    rows = {(r.doc_id, r.name): r for r in made.collect()}
    assert {k: r.status for k, r in rows.items()} == {("0", "a"): "ok", ("0", "b"): "ok", ("1", "a"): "other_wish_refused", ("1", "c"): "page_out_of_range", ("9", "a"): "no_catalog"}
    own = {r["num"]: r["head"] for r in document_objects(bytes(rows["0", "a"].content))}
    assert own[5] == "<< /FT /Tx /Subtype /Widget /T (a) /Rect [0 0 1 2] /P 3 0 R >>" and own[6] == "<< /FT /Tx /Subtype /Widget /T (b) /Rect [0 0 1.5 2] /P 3 0 R /V (v) >>"
    assert "/Annots [4 0 R 5 0 R 6 0 R]" in own[3] and "<< /DA (x) /Fields [4 0 R 5 0 R 6 0 R] /NeedAppearances true >>" in own[1]
    rows = {r.doc_id: r for r in left.collect()}
    assert {k: r.status for k, r in rows.items()} == {"0": "ok", "1": "no_field", "9": "no_field"}
    own = {r["num"]: r["head"] for r in document_objects(bytes(rows["0"].content))}
    assert set(own) == {1, 2, 3} and "4 0 R" not in own[3] and "/Fields []" in own[1]
