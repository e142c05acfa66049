import random

import duckdb
import pytest
from pyspark.sql import functions as F
from test_documents import FILE, made, one, stream

from vellum.operators import edits, splices
from vellum.operators.nodes import text_rows
from vellum.operators.rewrite import reachable
from vellum.sources.write import canonical, packed


def docs_of(spark, rows):
    return spark.createDataFrame([(k, bytearray(v)) for k, v in rows], "doc_id string, content binary")


def test_a_surgical_edit_leaves_other_bytes_alone(spark):
    row = edits.edit(one(spark), "leek-soup (hot)", "a much longer soup", mode="surgical").first()
    assert row.status == "ok" and bytes(row.content) != FILE
    at = FILE.index(b"(leek")
    assert bytes(row.content)[: FILE.index(b"/Length 41")] == FILE[: FILE.index(b"/Length 41")]
    end = FILE.index(b" Tj", at)
    assert FILE[end : FILE.index(b"xref\n")] in bytes(row.content)
    assert [r.text for r in text_rows(one(spark, row.content)).orderBy("place").collect()] == ["a much longer soup", "tea, endobj, cake"]


def test_splices_of_several_streams_and_a_length_by_reference(spark):
    docs = one(spark)
    wanted = [(FILE.index(b"tea"), b"tea", b"coffee with a very long name, longer than one hundred bytes, so that the length gets a further digit in its place"), (FILE.index(b"hot"), b"hot", b""), (FILE.index(b"leek"), b"leek", b"le")]
    got = splices.splice(docs, spark.createDataFrame([("d", a, bytearray(o), bytearray(n)) for a, o, n in wanted], "doc_id string, at long, old binary, new binary")).first()
    assert got.error is None and reachable(one(spark, got.content)).first().sound
    assert [r.text for r in text_rows(one(spark, got.content)).orderBy("place").collect()] == ["le-soup ()", wanted[0][2].decode() + ", endobj, cake"]


@pytest.mark.parametrize(("at", "old", "error"), [(b"Kids", b"Kids", "outside_stream"), (b"tea", b"tee", "the bytes are not those to be replaced")])
def test_splices_that_are_refused(spark, at, old, error):
    rows = [("d", FILE.index(at), bytearray(old), bytearray(b"new"))]
    assert splices.splice(one(spark), spark.createDataFrame(rows, "doc_id string, at long, old binary, new binary")).first().error == error


def test_filtered_shared_overlapping_and_packed_are_refused(spark):
    hexed = stream(b"<28> 41", b"/Filter /ASCIIHexDecode")
    shared = b"<< /Length 5 0 R >>\nstream\nBT (one) Tj ET\nendstream"
    files = {"f": canonical([(1, 0, b"<< /Type /Catalog >>"), (2, 0, hexed)], "/Root 1 0 R"), "s": canonical([(1, 0, b"<< /Type /Catalog >>"), (2, 0, shared), (3, 0, shared), (5, 0, b"14")], "/Root 1 0 R"), "o": FILE, "p": packed([(1, 0, b"<< /Type /Catalog >>"), (2, 0, stream(b"BT (one) Tj ET"))], "/Root 1 0 R")}
    asked = [("f", files["f"].index(b"<28>"), b"<28>", b"x"), ("s", files["s"].index(b"one"), b"one", b"three"), ("o", FILE.index(b"tea"), b"tea", b"x"), ("o", FILE.index(b"ea,"), b"ea,", b"x"), ("p", files["p"].index(b"one"), b"one", b"two")]
    got = splices.splice(docs_of(spark, files.items()), spark.createDataFrame([(d, a, bytearray(o), bytearray(n)) for d, a, o, n in asked], "doc_id string, at long, old binary, new binary"))
    assert {r.doc_id: (r.error, r.content) for r in got.collect()} == {"f": ("filtered_stream", None), "s": ("shared_length", None), "o": ("splices overlap", None), "p": ("cross references stand in a stream", None)}


def test_containment_equals_sql_on_many_spans_of_one_document(spark):
    rng = random.Random(8)
    at, streams = 0, []
    for i in range(3000):
        at += rng.randint(1, 90)
        size = rng.choice([0, 5, 60, 400, 90_000 if i % 500 == 0 else 7])
        streams.append(("d", i, at, size))
        at += size
    spans = [("d", s := rng.randint(0, at), s + rng.choice([0, 1, 9, 200]), i) for i in range(100_000)]
    spans += [("d", a, a + n, 100_000 + i) for _, i, a, n in streams] + [("other", 5, 6, 200_000)]
    a, b = spark.createDataFrame(spans, "doc_id string, start long, end long, id long"), spark.createDataFrame(streams, "doc_id string, num int, at long, size long")
    got = splices.containing(a, b, bucket=5_000).groupBy().agg(F.count("stream"), F.sum(F.col("id") * (F.coalesce("stream", F.lit(-1)) + 2)), F.count(F.lit(1))).first()
    c = duckdb.connect()
    c.register("a", a.toPandas())
    c.register("b", b.toPandas())
    sql = 'SELECT count(s), sum(id * (coalesce(s, -1) + 2)), count(*) FROM (SELECT a.id, min(num) AS s FROM a LEFT JOIN b ON a.doc_id = b.doc_id AND b."at" <= a.start AND a."end" <= b."at" + b.size GROUP BY a.id)'
    assert tuple(got) == tuple(int(x) for x in c.execute(sql).fetchone())


def test_edits_go_where_they_are_asked_to(spark):
    plain, soup = made(spark, b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [3 0 R] >>", b"<< /Type /Page /Resources << >> /Contents [4 0 R] >>", stream(b"BT (soup) Tj ET")).first().content, "soup"
    body = [(1, 0, b"<< /Type /Catalog /Pages 2 0 R >>"), (2, 0, b"<< /Type /Pages /Kids [3 0 R] >>"), (3, 0, b"<< /Type /Page /Resources << >> /Contents [4 0 R] >>"), (4, 0, stream(b"BT (soup) Tj ET"))]
    zipped = packed(body, "/Root 1 0 R")
    rows = [(f"{m}|{k}", c, m, None, None) for m in ("auto", "surgical", "preserve-structure", "canonical") for k, c in (("t", plain), ("x", zipped))]
    docs = spark.createDataFrame([(a, bytearray(b), m, s, p) for a, b, m, s, p in rows], "doc_id string, content binary, mode string, signature string, password string")
    got = {r.doc_id: r for r in edits.edit_as_asked(docs, soup, "stew").collect()}
    assert {k: r.status for k, r in got.items()} == {k: "ok" if k != "surgical|x" else "cross references stand in a stream" for k in got} and len(got) == 8
    assert b"/ObjStm" in bytes(got["preserve-structure|x"].content) and b"/ObjStm" not in bytes(got["canonical|x"].content)
