from pyspark.sql import functions as F

from vellum.operators import nodes
from vellum.operators.verification import verify_pages
from vellum.plans.staging import ship
from vellum.sources import mint
from vellum.sources.scan import document_objects, sound
from vellum.sources.write import canonical


def _file(*texts: bytes, own: bytes = b"", change: bytes = b"") -> bytes:
    return canonical([*mint._pages([b"BT /F 1 Tf 2 3 Td (%b) Tj ET\n" % t for t in texts], [own] * len(texts), 4), (99, 0, b"<< /Of 98 0 R >>" + change)], "/Root 1 0 R ")


def test_documents_of_one_shape_are_walked_once(monkeypatch):
    walked = []
    monkeypatch.setattr(nodes, "_PLANS", {})
    of = nodes.Texts.__init__
    monkeypatch.setattr(nodes.Texts, "__init__", lambda self, *a: (walked.append(1), of(self, *a))[1])
    for texts in ((b"a", b"b\\)"), (b"longer by far", b"")):
        own = nodes.Pages(_file(*texts))
        assert list(own.texts()) == list(enumerate(t.decode().replace("\\", "") for t in texts)) and own.sound()
        assert (own.count, own.content, own.resources, own.loose) == (2, True, True, 1)
    assert len(walked) == 1
    assert not nodes.Pages(_file(b"a", own=b"/Contents []")).content and nodes.Pages(_file(b"a", b"b", own=b"/Annots [97 0 R]")).loose == 3
    assert nodes.Pages(_file(b"a", change=b" /Type /ObjStm")).loose == 1 and len(walked) > 1


def test_a_table_that_is_not_as_written_is_held_against_all_objects():
    data = _file(b"a", b"b")
    told = lambda d: sound(d, document_objects(d))
    assert told(data) and told(data.replace(b" n \n", b" n\r\n")) and not told(data.replace(b"/Root 1 0", b"/Root 5 0")) and not told(data.replace(b"(a)", b"(ab)"))
    assert not told(data.replace(b"%%EOF", b"")) and told(data.replace(b"1 0 obj", b"1 0 obj ", 1).replace(b"1 0 obj \n", b"1 0 obj\n", 1))


def test_pages_are_held_against_wishes_by_one_row_a_document(spark):
    ship(spark)
    docs = mint.paged(spark.range(4), "id", "id", mint.show(F.col("id").cast("string")))
    wanted = spark.createDataFrame([("1", 1, ["1", "x"]), ("1", 2, ["1", "x", None]), ("2", 1, [])], "doc_id string, page_count long, texts array<string>")
    rows = verify_pages(docs, wanted)
    assert rows._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 2
    assert {r.doc_id: (r.page_count_ok, r.missing) for r in rows.collect()} == {"0": (True, []), "1": (False, ["x"]), "2": (True, []), "3": (True, [])}
