from test_documents import made, one, stream, xml_form  # noqa: F401

from vellum.operators import changes
from vellum.operators.graph import annotations, form_fields, pages
from vellum.operators.nodes import text_rows
from vellum.operators.xfa import dataset_fields
from vellum.sources.scan import document_objects, objects

FORM = (
    b"<< /Type /Catalog /AcroForm << /Fields [2 0 R 3 0 R 4 0 R 5 0 R 6 0 R] >> >>", b"<< /T (text) /FT /Tx /V (old) >>", b"<< /T (one) /FT /Ch /Opt [[(x) (Ex)] (y)] >>", b"<< /T (many) /FT /Ch /Ff 2097152 /Opt [(a) (b) (c)] >>",
    b"<< /T (box) /FT /Btn /AP << /N << /On 1 0 R /Off 1 0 R >> >> >>", b"<< /T (rich) /FT /Tx /RV (r) >>",
)


def test_fields_are_set(spark):
    cases = [("text", "new (1) - é", "ok", "new (1) - é"), ("one", "Ex", "ok", "x"), ("one", "z", "no_such_option", None), ("many", '["c", "a"]', "ok", None), ("many", '["a", "a"]', "value_twice", None), ("box", "On", "ok", "On"), ("box", "Up", "no_such_state", None), ("rich", "x", "not_fillable", None), ("none", "x", "no_field", None)]
    content = made(spark, *FORM).first().content
    docs = spark.createDataFrame([(str(i), content) for i in range(len(cases))], "doc_id string, content binary")
    got = changes.set_fields(docs, spark.createDataFrame([(str(i), n, v) for i, (n, v, *_) in enumerate(cases)], "doc_id string, name string, value string")).collect()
    written = spark.createDataFrame([(r.doc_id, r.content) for r in got if r.content is not None], "doc_id string, content binary")
    values = {(r.doc_id, r.name): r.value for r in form_fields(written).collect()}
    for row in got:
        name, _, status, found = cases[int(row.doc_id)]
        assert (row.name, row.status) == (name, status)
        if status == "ok":
            assert values[row.doc_id, name] == found
            entries = {r["num"]: r["entries"] for r in document_objects(bytes(row.content))}
            assert entries[1]["AcroForm/NeedAppearances"] == "true"
            if name == "many":
                assert entries[4]["I"] == "[0 2]" and entries[4]["V"] == "[(a) (c)]"


def test_notes_are_set(spark):
    docs = made(spark, b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [3 0 R] >>", b"<< /Type /Page /Annots [4 0 R] >>", b"<< /Type /Annot /Subtype /Text /Contents (old) /AP << /N 1 0 R >> >>")
    row = changes.set_contents(docs, spark.createDataFrame([("d", 0, "new")], "doc_id string, annotation_index int, contents string")).first()
    objs = objects(one(spark, bytes(row.content)))
    assert row.status == "ok" and annotations(objs, pages(objs)).first().contents == "new" and "AP" not in objs.where("num = 4").first().entries


def test_pages_are_turned_and_scaled(spark):
    docs = made(spark, b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [3 0 R] /MediaBox [0 0 10 20] /Resources << >> >>", b"<< /Type /Page /Contents 4 0 R /Rotate 270 >>", stream(b"BT (x) Tj ET"))
    ask = lambda *row: spark.createDataFrame([("d", 0, *row)], "doc_id string, page_index int, turn int, crop array<double>, scale double")
    row = changes.transform_pages(docs, ask(180, [1.0, 1.0, 5.0, 5.0], 2.0)).first()
    after = one(spark, bytes(row.content))
    page = objects(after).where("num = 3").first().entries
    assert (row.status, page["Rotate"], page["MediaBox"], page["CropBox"]) == ("ok", "90", "[0 0 20 40]", "[2 2 10 10]")
    assert text_rows(after).first().text == "x" and bytes(objects(after).where("num = 4").first().raw).startswith(b"q 2.0 0 0 2.0 0 0 cm")
    assert changes.transform_pages(docs, ask(45, None, None)).first().status == "rotation is not a multiple of 90"


def test_data_is_set(spark):
    body = b"<datasets><data><f><a>1</a><b>2</b></f></data></datasets>"
    docs = made(spark, b"<< /Type /Catalog /AcroForm << /XFA [(datasets) 2 0 R] >> >>", stream(body))
    set_ = lambda path: changes.set_data(docs, spark.createDataFrame([("d", path, "x & <y>")], "doc_id string, path string, value string")).first()
    row = set_("f.b")
    assert row.status == "ok" and {r.path: r.value for r in dataset_fields(objects(one(spark, bytes(row.content)))).collect()} == {"f.a": "1", "f.b": "x & <y>"}
    assert set_("f").status == "no_field"


WIDGET = b"<< /Parent 2 0 R /Subtype /Widget /AS /Off /AP << /N << /%s 9 0 R /Off 9 0 R >> >> >>"


def test_kids_and_parents_follow_and_conflicts_are_refused(spark):
    body = [
        b"<< /Type /Catalog /AcroForm << /Fields [2 0 R 5 0 R 7 0 R] >> >>", b"<< /T (g) /FT /Btn /Ff 32768 /V /a /Kids [3 0 R 4 0 R] >>", WIDGET % b"a", WIDGET % b"b",
        b"<< /T (t) /FT /Tx /Kids [6 0 R] >>", b"<< /Parent 5 0 R /Subtype /Widget >>", b"<< /T (p) /FT /Tx /Kids [8 0 R] >>", b"<< /T (k) /Parent 7 0 R /FT /Tx /Subtype /Widget >>", stream(b""),
    ]
    cases = {
        "1": ([("g", "b")], ["ok"], {3: "/Off", 4: "/b"}), "2": ([("g", "Off")], ["ok"], {3: "/Off", 4: "/Off"}), "3": ([("g", "c")], ["no_such_state"], None), "4": ([("g", "true")], ["ambiguous_button_states"], None),
        "5": ([("g", "a"), ("g", "b")], ["conflicting_changes"] * 2, None), "6": ([("p.k", "y"), ("t", "x")], ["ok", "ok"], {5: "(x)", 6: "(x)", 7: "(y)", 8: "(y)"}), "7": ([("p", "z"), ("p.k", "y")], ["other_kid_name", "ok"], {8: "(y)"}),
    }
    content = made(spark, *body).first().content
    docs = spark.createDataFrame([(k, content) for k in cases], "doc_id string, content binary")
    got = changes.set_fields(docs, spark.createDataFrame([(k, *w) for k, (wishes, *_) in cases.items() for w in wishes], "doc_id string, name string, value string")).collect()
    for k, (_, statuses, found) in cases.items():
        rows = sorted((r.name, r.status, r.content) for r in got if r.doc_id == k)
        assert [r[1] for r in rows] == statuses and all((c is not None) == (s == "ok") for _, s, c in rows)
        if found:
            own = {r["num"]: r["entries"] for r in document_objects(bytes(next(c for _, _, c in rows if c)))}
            assert {n: own[n].get("AS") or own[n].get("V") for n in found} == found and own[1]["AcroForm/NeedAppearances"] == "true"


def test_multiple_choices_are_compared_with_what_was_written(spark):
    body = [b"<< /Type /Catalog /AcroForm << /Fields [2 0 R] >> >>", b"<< /T (m) /FT /Ch /Ff 2097152 /Opt [[(1) (one)] [(2) (two)] (3)] >>"]
    wanted = spark.createDataFrame([("d", "m", '["3", "one"]')], "doc_id string, name string, value string")
    row = changes.set_fields(made(spark, *body), wanted).first()
    entries = document_objects(bytes(row.content))[1]["entries"]
    assert (row.status, entries["V"], entries["I"]) == ("ok", "[(1) (3)]", "[0 2]")


def test_values_within_quoted_attributes_do_not_end_tags():
    assert changes._with_value(b"<a><b q='x>y' r=\">\">old</b></a>", "a.b", "n<w") == b"<a><b q='x>y' r=\">\">n&lt;w</b></a>"
