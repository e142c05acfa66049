import pytest
from pyspark.sql import functions as F
from test_documents import FILE

from vellum.operators.adapters import PDF, Adapter, Formats, formats
from vellum.operators.nodes import Selector


def line_nodes(docs):
    """A format of lines behind a mark: the document, then each line."""
    lines = docs.select("doc_id", F.posexplode(F.split(F.decode("content", "UTF-8"), "\n")).alias("seq", "value"))
    kind = F.when(F.col("seq") == 0, "lines.document").otherwise("lines.line")
    return lines.select("doc_id", F.col("seq").alias("node_id"), kind.alias("kind"), "value", F.create_map(F.lit("length"), F.length("value").cast("string")).alias("meta"), F.lit(0).alias("num"), "seq")


def upper(docs, old, new):
    return docs.select("doc_id", F.lit("ok").alias("status"), F.encode(F.replace(F.decode("content", "UTF-8"), F.lit(old), F.lit(new)), "UTF-8").alias("content"))


def test_documents_of_several_formats(spark):
    rows = [("p", FILE), ("l", b"LINES1\ntea\nleek"), ("k", b"LINES\nx"), ("u", b"what"), ("e", b""), ("n", None)]
    docs = spark.createDataFrame([(k, None if v is None else bytearray(v)) for k, v in rows], "doc_id string, content binary")
    known = Formats(PDF, Adapter("lines", b"LINES", line_nodes, upper)).register(Adapter("numbered", b"LINES1", line_nodes))
    assert {r.doc_id: r.f for r in docs.select("doc_id", known.format_of(F.col("content")).alias("f")).collect()} == {"p": "pdf", "l": "numbered", "k": "lines", "u": None, "e": None, "n": None}
    every = known.nodes(docs)
    assert {(r.doc_id, r.format, r.n) for r in every.groupBy("doc_id", "format").agg(F.count(F.lit(1)).alias("n")).collect()} == {("p", "pdf", 5), ("l", "numbered", 3), ("k", "lines", 2)}
    assert [(r.doc_id, r.value) for r in Selector().kind("lines.line").text("leek").query(every).collect()] == [("l", "leek")]
    got = {r.doc_id: (r.format, r.status, r.content is not None) for r in known.edit(docs, "x", "y").collect()}
    assert got == {"p": ("pdf", "no_matches", False), "l": ("numbered", "not_editable", False), "k": ("lines", "ok", True), "u": (None, "unknown_format", False), "e": (None, "unknown_format", False), "n": (None, "unknown_format", False)}


def test_nodes_are_selected_by_name(spark):
    docs = spark.createDataFrame([("p", bytearray(FILE)), ("l", bytearray(b"LINES\ntea\nleek")), ("k", bytearray(b"LINES\nleek\nleek"))], "doc_id string, content binary")
    plain = Formats(PDF).nodes(docs)
    named = lambda d: line_nodes(d).withColumn("name", F.when(F.col("seq") > 0, F.concat(F.lit("line of "), "value")))
    every = Formats(PDF, Adapter("lines", b"LINES", named)).nodes(docs)
    leeks = Selector().named("line of leek")
    assert sorted((r.doc_id, r.node_id) for r in leeks.query_all(every).collect()) == [("k", 1), ("k", 2), ("l", 2)]
    assert [(r.doc_id, r.node_id) for r in leeks.match_index(1).query(every).collect()] == [("k", 2)]
    assert {r.doc_id: (r.matches, r.status) for r in leeks.find_one(every).collect()} == {"p": (0, "no_matches"), "l": (1, "ok"), "k": (2, "multiple_matches")}
    assert leeks.kind("lines.document").query(every).count() == leeks.query(plain).count() == leeks.query(line_nodes(docs)).count() == 0


def test_formats_are_known_once():
    with pytest.raises(ValueError):
        formats().register(Adapter("pdf", b"other", line_nodes))
    with pytest.raises(ValueError):
        formats().register(Adapter("other", b"%PDF-", line_nodes))
    with pytest.raises(ValueError):
        formats().register(Adapter("other", b"", line_nodes))
