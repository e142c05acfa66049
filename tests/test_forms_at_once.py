from pyspark.sql import functions as F

from vellum.operators import changes, mutations
from vellum.operators.xfa import dataset_fields, packet_bytes, packets, semantics
from vellum.plans.staging import ship
from vellum.sources import mint


def _docs(spark):
    ship(spark)
    data = F.concat(F.lit("<datasets><data><f><a>1</a><b>2</b><c>"), F.repeat(F.lit("x-"), F.col("id").cast("int")), F.lit("</c></f></data></datasets>"))
    template = F.when(F.col("id") == 3, "<template><subform name='x' layout='flowed'/></template>").otherwise("<template>x</template>")
    body = F.array(mint.obj(1, "<< /Type /Catalog /AcroForm << /XFA [(template) 2 0 R (datasets) 3 0 R] >> >>"), mint.obj(2, mint.stream(template)), mint.obj(3, mint.stream(data)))
    return spark.range(4).select(F.col("id").cast("string").alias("doc_id"), mint.document(body).alias("content"))


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_packet_is_replaced_where_its_document_is_parsed(spark):
    docs = _docs(spark)
    got = mutations.replace_in_packets(docs, "x", "y&", at=1)
    assert "Exchange" not in _plan(got) and _plan(got).count("MapInArrow") == 1 and "parquet" not in _plan(got).lower()
    rows = {r.doc_id: (r.status, r.matches, r.packet) for r in got.collect()}
    assert rows == {"0": ("match_index_out_of_range", 1, None), "1": ("ok", 2, 1), "2": ("ok", 3, 1), "3": ("ok", 4, 1)} and got.schema["matches"].dataType.simpleString() == "bigint"
    read = packet_bytes(got.where("content is not null"), "status", "matches").where("packet = 1").collect()
    assert {r.doc_id: (r.matches, bytes(r.data).split(b"<c>")[1].split(b"<")[0]) for r in read} == {"1": (2, b"y&-"), "2": (3, b"y&-x-"), "3": (4, b"y&-x-x-")}
    of = lambda **k: {r.doc_id: (r.status, r.matches) for r in mutations.replace_in_packets(docs, "x", "z", **k).collect()}
    assert of(kind="template")["1"] == ("ok", 1) and of(label="datasets")["2"] == ("multiple_matches", 2) and of(kind="config")["1"] == ("no_matches", 0)


def test_wishes_for_one_packet_are_met_together_in_one_pass(spark):
    docs = _docs(spark)
    wanted = spark.createDataFrame([("1", "f.a", "<new>"), ("1", "f.b", "other"), ("1", "f.z", "none"), ("3", "f.a", "x"), ("7", "f.a", "x")], "doc_id string, path string, value string")
    got = changes.set_data(docs, wanted)
    assert _plan(got).count("MapInArrow") == 1
    rows = got.collect()
    assert {(r.doc_id, r.path): r.status for r in rows} == {("1", "f.a"): "ok", ("1", "f.b"): "ok", ("1", "f.z"): "no_field", ("3", "f.a"): "not_editable", ("7", "f.a"): "not_editable"}
    read = dataset_fields(got.where("path = 'f.a'").where("content is not null"), "status").collect()
    assert {(r.path, r.value, r.status) for r in read} == {("f.a", "<new>", "ok"), ("f.b", "other", "ok"), ("f.c", "x-", "ok")}


def test_what_may_be_edited_is_told_alike_by_rows_and_by_documents(spark):
    docs = _docs(spark)
    assert {r.doc_id: r.editable for r in semantics(packets(docs)).collect()} == {"0": True, "1": True, "2": True, "3": False}
    wanted = docs.select("doc_id", F.lit("f.a").alias("path"), F.lit("1").alias("value"))
    assert {r.doc_id: r.status for r in changes.set_data(docs, wanted).collect()} == {"0": "ok", "1": "ok", "2": "ok", "3": "not_editable"}
