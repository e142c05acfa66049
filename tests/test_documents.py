import pytest
from pyspark.sql import functions as F

from vellum.operators import documents, edits, facts, graph, reports, xfa
from vellum.operators.nodes import TEXT, Selector, nodes, text_rows
from vellum.operators.rewrite import reachable
from vellum.sources import mint
from vellum.sources.scan import dangling, document_objects, markers, objects, read, refs, streams, trailers, xref_entries, xref_summary
from vellum.sources.syntax import renumbered, value
from vellum.sources.write import canonical, packed

MENU = [
    (2, 0, b"<< /Kids [11 0 R] /Count 1 /Type /Pages /Resources << >> >>"),
    (7, 0, b"<< /Pages 2 0 R /Type /Catalog /Names << /Dests << /Names [(soup) [11 0 R /Fit]] >> >> >>"),
    (11, 0, b"<< /Contents [21 0 R 20 0 R] /Parent 2 0 R /Gone 404 0 R /Type /Page /MediaBox [0 0 90 120] >>"),
    (20, 0, b"<< /Marker (keep) /Length 30 0 R >>\nstream\nBT (tea, endobj, cake) Tj ET\nendstream"),
    (21, 3, b"<< /Length 41 /Marker (keep) >>\nstream\nBT (leek\\055soup \\(hot\\)) Tj ET  %  served\nendstream"),
    (30, 0, b"28"),
]
FILE = canonical(MENU, "/Root 7 0 R /Info 30 0 R")


def one(spark, content=FILE):
    return spark.createDataFrame([("d", bytearray(content))], "doc_id string, content binary")


def made(spark, *objects_, root=1, write=canonical):
    return one(spark, write([(i + 1, 0, o) for i, o in enumerate(objects_)], f"/Root {root} 0 R"))


def stream(data, entries=b""):
    return b"<< /Length %d %s >>\nstream\n" % (len(data), entries) + data + b"\nendstream"


def test_hand_written_document(spark):
    objs = objects(one(spark))
    assert [(r.num, r.gen) for r in objs.orderBy("num").collect()] == [(2, 0), (7, 0), (11, 0), (20, 0), (21, 3), (30, 0)]
    assert [r.text for r in text_rows(one(spark)).orderBy("place").collect()] == ["leek-soup (hot)", "tea, endobj, cake"]
    assert [(r.src, r.dst) for r in dangling(objs).collect()] == [(11, 404)]
    rows = nodes(one(spark)).orderBy("node_id").collect()
    assert [r.kind.rpartition(".")[2] for r in rows] == ["document", "stream", "stream", "text_show", "text_show"]
    assert rows[-1].meta["page_object_number"] == "11" and rows[-1].meta["inherited_resources"] == "true"
    assert [r.page_index for r in graph.pages(objs).collect()] == [0]
    assert reachable(one(spark)).first().sound


def test_entries_are_those_of_the_top_level():
    head = b"<< /Resources << /Font << /F1 << /Type /Font >> >> >> /Type /Page /A (x\\)y) /B [1 0 R << /C 1 >> (s)] % /Type /No\n /AB 7 /H <41 4> /Type2 null >> endobj"
    got, end, after, word = value(head, 0)
    assert (got["Type"], got["A="], got["B/#"], got["B/[1]/C"], got["AB"], got["H="]) == ("/Page", "x)y", "3", "1", "7", "A@")
    assert got["Resources/Font/F1/Type"] == "/Font" and word == b"endobj" and head[:end].rstrip()[-2:] == b">>" and after == len(head)


@pytest.mark.parametrize("text", [b"(upstream)", b"(endobj)", b"(" + b"x" * 100_000 + b")", b"(a (b) c)", b"<" + b"61" * 50_000 + b">", b"(/Encrypt)", b"[" * 5_000 + b"]" * 5_000])
def test_strings_and_depth_do_not_mislead(spark, text):
    docs = made(spark, b"<< /Type /Catalog /T " + text + b" >>", b"<< /A 1 >>", stream(b"BT (x) Tj ET"), b"[0]")
    objs = objects(docs)
    assert objs.count() == 4 and objs.where("raw is not null").count() == 1 and objs.where("error is not null").count() == 0
    assert reports.validate(docs).first().valid and not markers(docs).first().has_encrypt


def test_broken_objects_are_named_and_the_rest_is_found(spark):
    body = b"%PDF-1.4\n1 0 obj\n<< /A (open >>\nendobj\n2 0 obj\n<< /B [1 >>\nendobj\n3 0 obj\n<< /C 1 >>\nendobj\n4 0 obj\n<< /D 1 >>\nstream\nabc\n%%EOF"
    got = {r.num: r.error for r in objects(one(spark, body)).collect()}
    assert got == {1: "no endobj", 2: "a dictionary or array is not closed", 3: None, 4: "no endstream"}


def test_later_object_is_in_force():
    rows = document_objects(b"%PDF-1.4\n5 0 obj\n(old)\nendobj\n5 0 obj\n(new)\nendobj\n5 1 obj\n(other)\nendobj\n")
    assert sorted((r["gen"], r["head"]) for r in rows) == [(0, "(new)"), (1, "(other)")]


def test_object_streams_and_cross_reference_streams(spark):
    content = packed(MENU, "/Root 7 0 R")
    objs = objects(one(spark, content))
    inside = {r.num for r in objs.where("container is not null").collect()}
    assert inside == {2, 7, 11, 30} and reachable(one(spark, content)).first().sound
    assert [r.text for r in text_rows(one(spark, content)).orderBy("place").collect()] == ["leek-soup (hot)", "tea, endobj, cake"]
    summary = xref_summary(one(spark, content)).first()
    assert summary.has_stream and summary.has_object_stream and not summary.has_table and summary.error is None
    assert {r.num for r in xref_entries(one(spark, content)).where("container is not null").collect()} == inside
    assert trailers(one(spark, content)).first().entries["Root"] == "7 0 R"
    assert reports.structure(one(spark, content), objs).first().in_object_streams == 4


def test_object_of_the_file_comes_before_one_of_an_object_stream(spark):
    member = b"1 0 9 4\n(in) (nine)"
    docs = made(spark, b"(out)", stream(member, b"/Type /ObjStm /N 2 /First 8"))
    assert {r.num: r.head for r in objects(docs).where("raw is null").collect()} == {1: "(out)", 9: "(nine)"}


@pytest.mark.parametrize("entries, error", [(b"/W [1 2]", "no usable /W"), (b"/W [1 1 1] /Size 9", "data ends"), (b"/W [1 1 1] /Index [0 1 2]", "no usable /Index"), (b"/W [1 1 1] /Size 1", "trailing data")])
def test_broken_cross_reference_streams_say_why(spark, entries, error):
    docs = made(spark, stream(b"\1\2\3\1\2\3", b"/Type /XRef " + entries))
    assert error in xref_summary(docs).first().error


def test_filters_and_parameters_by_reference(spark):
    docs = made(spark, b"[/AHx /LZW]", b"[null << /EarlyChange 0 >>]", stream(b"", b""))
    from vellum.functions.codecs import encode

    data = encode(bytes(range(256)) * 9, ["ASCIIHexDecode", "LZWDecode"], [{}, {"EarlyChange": 0}])
    docs = made(spark, b"[/AHx /LZW]", b"[null << /EarlyChange 0 >>]", stream(data, b"/Filter 1 0 R /DecodeParms 2 0 R"))
    assert bytes(streams(objects(docs)).first().data) == bytes(range(256)) * 9


@pytest.mark.parametrize("entries", [b"/Filter [/Fl /Fl] /DecodeParms << /Predictor 2 >>", b"/Filter /Fl /DecodeParms [null null]", b"/Filter /Fl /DecodeParms << /K 1 >>", b"/Filter /AHx /DecodeParms << /Columns 1 >>", b"/Filter /LZW /DecodeParms << /EarlyChange 2 >>", b"/Filter /Fl /DecodeParms 9"])
def test_parameters_that_do_not_fit_are_refused(spark, entries):
    row = streams(objects(made(spark, stream(b"x", entries)))).first()
    assert row.data is None and "parameter" in row.decode_error.lower() or "EarlyChange" in row.decode_error


FONTS = (
    b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [3 0 R] /Resources 4 0 R >>", b"<< /Type /Page /Parent 2 0 R /Contents 6 0 R >>", b"<< /Font 5 0 R >>",
    b"<< /W << /Type /Font /Subtype /TrueType /Encoding /WinAnsiEncoding /FirstChar 97 /Widths [5 5 7] >> /D 9 0 R /C 7 0 R /H << /Subtype /Type1 /BaseFont /ABCDEF+Helvetica >> >>",
    stream(b"BT /W 12 Tf 3 4 Td (a\\200) Tj /D 8 Tf <4142> Tj /C 1 Tf <00010102> Tj [<0001> 3 <0102>] TJ /H 1 Tf (`it') Tj (b) Tj /W 9 Tf (ab) Tj ET"), b"<< /Subtype /Type0 /ToUnicode 8 0 R /Encoding /Identity-H /DescendantFonts [10 0 R] >>",
    stream(b"1 beginbfchar <0001> <0041> endbfchar 1 beginbfrange <0101> <0103> [<0042> <00430044> (E)] endbfrange"), b"<< /Subtype /Type1 /Encoding << /BaseEncoding /MacRomanEncoding /Differences [65 /Aacute /uni20AC] >> >>", b"<< /DW 1000 /W [1 [500] 257 258 500] >>",
)


def test_texts_are_what_their_fonts_say(spark):
    rows = text_rows(made(spark, *FONTS)).orderBy("seq").collect()
    assert [(r.text, r.encoding) for r in rows] == [
        ("a€", "literal-font-encoding"), ("Á€", "hex-font-encoding"), ("ACD", "hex-cmap"), ("ACD", "tj-array-cmap"), ("‘it’", "literal-font-encoding"), ("b", "literal-font-encoding"), ("ab", "literal-font-encoding"),
    ]
    assert (rows[0].x, rows[0].y, rows[0].font_size, rows[0].font) == (3.0, 4.0, 12.0, "W")


@pytest.mark.parametrize(
    "old, new, status, left",
    [
        ("ab", "ba", "ok", "ba"), ("ab", "bc", "reflow_required", None), ("ab", "zz", "width_unproven", None), ("b", "☃", "font_encoding_unrepresentable", None), ("a€", "x", "width_unproven", None), ("ab", "a", "ok", "a"), ("ACD", "A", "multiple_matches", None),
    ],
)
def test_edits_within_fonts(spark, old, new, status, left):
    row = edits.edit(made(spark, *FONTS), old, new).first()
    assert row.status == status
    if left:
        assert left in [r.text for r in text_rows(one(spark, bytes(row.content))).collect()]


def test_edit_through_a_character_map(spark):
    row = edits.edit(made(spark, *FONTS), "ACD", "CDA", Selector().meta("operator", "Tj")).first()
    assert row.status == "verification_failed"  # the old text stands in the array still
    row = edits.edit(made(spark, *FONTS), "ACD", "CDA", Selector().meta("operator", "Tj"), verify=("reparse", "new-selectable")).first()
    assert row.status == "ok" and row.proof == "width_proven"
    assert edits.edit(made(spark, *FONTS), "ACD", "ACDA", Selector().meta("operator", "Tj")).first().status == "reflow_required"
    assert edits.edit(made(spark, *FONTS), "ab", "a", layout="preserve-width").first().status == "preserve_width_not_proven"
    with pytest.raises(ValueError):
        edits.edit(made(spark, *FONTS), "ab", "a", verify=("magic",))


FORMS = (
    b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [3 0 R 4 0 R] /Resources << /XObject << /X 6 0 R >> >> >>", b"<< /Type /Page /Parent 2 0 R /Contents 5 0 R >>", b"<< /Type /Page /Parent 2 0 R /Contents 5 0 R >>",
    stream(b"BT (page) Tj ET /X Do /None Do"), stream(b"BT (stamp) Tj ET /X Do /Y Do", b"/Type /XObject /Subtype /Form /Resources << /XObject << /X 6 0 R /Y 7 0 R >> >>"), stream(b"BT (deep) Tj ET", b"/Type /XObject /Subtype /Form"), stream(b"BT (loose) Tj ET"),
)


def test_forms_are_shown_where_they_are_invoked(spark):
    rows = nodes(made(spark, *FORMS)).where(F.col("kind") == TEXT).orderBy("node_id").collect()
    assert [(r.value, r.meta.get("page_object_number"), r.meta.get("form_depth")) for r in rows] == [
        ("page", "3", None), ("stamp", "3", "1"), ("deep", "3", "2"), ("page", "4", None), ("stamp", "4", "1"), ("deep", "4", "2"), ("loose", None, None),
    ]
    assert rows[1].meta["form_invocation_count"] == "2" and rows[1].meta["form_invoked_page_object_numbers"] == "[3 4]"
    assert edits.edit(made(spark, *FORMS), "stamp", "x", Selector().match_index(0)).first().status == "shared_form_xobject"


def test_selectors(spark):
    rows = nodes(one(spark))
    assert Selector().kind(TEXT).match_index(1).query(rows).first().value == "tea, endobj, cake"
    assert Selector().kind(TEXT).match_index(5).query(rows).count() == 0
    assert Selector().kind(TEXT).find_one(rows).first().status == "multiple_matches"
    assert Selector().kind(TEXT).match_index(9).find_one(rows).first().status == "match_index_out_of_range"
    assert Selector().text("<nil>").query_all(rows).count() == 3  # nodes without a value


def test_edit_keeps_everything_else(spark):
    row = edits.edit(one(spark), "leek-soup (hot)", "a (b) - c").first()
    assert row.status == "ok" and row.new_selectable and row.reparse
    after = one(spark, bytes(row.content))
    objs = objects(after)
    assert [r.text for r in text_rows(after).orderBy("place").collect()] == ["a (b) - c", "tea, endobj, cake"]
    assert {r.num: (r.gen, r.entries.get("Marker")) for r in objs.where("raw is not null").collect()} == {20: (0, "(keep)"), 21: (3, "(keep)")}
    last = trailers(after).first()
    assert (last.entries["Root"], last.entries["Info"]) == ("7 0 R", "30 0 R") and xref_entries(after).count() == len(MENU)
    assert edits.edit(one(spark, packed(MENU, "/Root 7 0 R")), "tea, endobj, cake", "x").first().status == "ok"


def test_edit_of_missing_text_is_refused(spark):
    row = edits.edit(one(spark), "nothing", "x").first()
    assert (row.status, row.content) == ("no_matches", None)


def test_a_table_that_points_elsewhere_is_not_sound(spark):
    assert not reachable(one(spark, FILE.replace(b"7 0 obj", b"7 0  obj"))).first().sound
    assert not reachable(one(spark, FILE.replace(b"/Root 7", b"/Root 9"))).first().sound


def test_read_takes_documents_alone(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(FILE)
    (tmp_path / "b.pdf").write_bytes(b"no document")
    assert read(spark, str(tmp_path)).count() == 1


def test_unknown_filter_and_broken_data(spark):
    docs = spark.createDataFrame([("d", "/Filter /FooDecode"), ("e", "/Filter /FlateDecode")], "doc_id string, f string")
    docs = docs.select("doc_id", mint.document(F.array(mint.obj(1, mint.stream(F.lit("abc"), F.col("f"))))).alias("content"))
    got = {r.doc_id: (r.capability, r.data, r.decode_error is not None) for r in streams(objects(docs)).collect()}
    assert got == {"d": ("unsupported_target", None, True), "e": ("editable_reversible", None, True)}


def test_circles_end(spark):
    assert graph.pages(objects(made(spark, b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [2 0 R 3 0 R] >>", b"<< /Type /Page >>"))).count() == 1
    names = made(spark, b"<< /Type /Catalog /Names << /Dests 2 0 R >> >>", b"<< /Kids [2 0 R] >>")
    assert graph.name_entries(objects(names)).first().error == "a circle of names"


def test_name_trees_of_any_depth(spark):
    docs = made(spark, b"<< /Type /Catalog /Names 2 0 R >>", b"<< /Dests 3 0 R >>", b"<< /Kids [4 0 R] >>", b"<< /Kids [6 0 R 5 0 R] >>", b"<< /Names [(c\\057d) 1 0 R] >>", b"<< /Names [(a) [1 0 R /Fit] <62> (x)] >>")
    got = [(r.name, r.target) for r in graph.name_entries(objects(docs)).orderBy("ord").collect()]
    assert got == [("a", None), ("b", None), ("c/d", 1)]


def test_form_fields_say_what_can_be_filled(spark):
    docs = made(
        spark, b"<< /Type /Catalog /AcroForm 2 0 R >>", b"<< /Fields [3 0 R 4 0 R 5 0 R 6 0 R 3 0 R] >>", b"<< /T (name) /FT /Tx /V (old) /Rect [0 0 1 1] /Ff 3 >>", b"<< /T (pick) /FT /Ch /Ff 2097152 /Opt [(a) [(b) (Bee)]] >>",
        b"<< /T (box) /FT /Btn /AP << /N << /On 9 0 R /Off 9 0 R >> >> >>", b"<< /T (up) /FT /Tx /A << /S /JavaScript >> /Kids [7 0 R] >>", b"<< /T (down) /Parent 6 0 R >>",
    )
    got = {r.name: r for r in graph.form_fields(objects(docs)).collect()}
    assert sorted(got) == ["box", "name", "pick", "up", "up.down"]
    assert (got["name"].flag_names, got["name"].appearance_status, got["name"].fillable) == (["read_only", "required"], "approximate_supported", False)
    assert [tuple(o) for o in got["pick"].options] == [("a", "a"), ("b", "Bee")] and got["pick"].type_flag_names == ["multi_select"] and got["pick"].fillable
    assert got["box"].button_states == ["Off", "On"] and got["box"].appearance_status == "existing_button_state_only"
    assert got["up"].fill_blockers == ["field_action", "field_javascript_action", "named_non_widget_kid"] and got["up.down"].type == "Tx"


def test_annotations_come_once_and_direct_ones_too(spark):
    docs = made(
        spark, b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [3 0 R 4 0 R] >>", b"<< /Type /Page /Annots [6 0 R << /Subtype /Link /Rect [0 0 2 2] /Contents (here) >>] >>", b"<< /Type /Page /Annots [6 0 R 5 0 R] >>",
        b"<< /Type /Annot /Subtype /Text /Contents (second) /Rect [0 0 5 5] /F 6 /RC (r) >>", b"<< /Type /Annot /Subtype /Ink /Contents (first\\054) >>",
    )
    objs = objects(docs)
    got = graph.annotations(objs, graph.pages(objs)).orderBy("annotation_index").collect()
    assert [(r.num, r.page_index, r.contents, r.appearance_status) for r in got] == [(5, 1, "second", "unsafe"), (6, 0, "first,", "unsupported"), (None, 0, "here", "approximate_supported")]
    assert got[0].flag_names == ["hidden", "print"]


def test_labels_and_outlines(spark):
    docs = made(
        spark, b"<< /Type /Catalog /PageLabels << /Nums [0 << /S /r >> 2 4 0 R] >> /Outlines 2 0 R >>", b"<< /First 3 0 R >>", b"<< /Title (one) /Next 5 0 R /First 6 0 R /Dest [9 0 R /Fit] >>", b"<< /S /D /P (A\\055) /St 7 >>", b"<< /Title (two) /Next 3 0 R >>", b"<< /Title (below) >>",
    )
    objs = objects(docs)
    assert [tuple(r)[1:] for r in graph.page_labels(objs).orderBy("first_page").collect()] == [(0, "r", None, 1), (2, "D", "A-", 7)]
    assert [(r.title, r.depth) for r in graph.outlines(objs).orderBy("ord").collect()] == [("one", 0), ("below", 1), ("two", 0)]


def test_validate_names_the_reason(spark):
    docs = spark.createDataFrame([("a", bytearray(FILE)), ("b", bytearray(FILE[:-6])), ("c", bytearray(b"x%%EOF")), ("d", bytearray(b"%PDF-1.4\n1 0 obj\n<<>>\n%%EOF"))], "doc_id string, content binary")
    got = {r.doc_id: (r.valid, r.error) for r in reports.validate(docs).collect()}
    assert got == {"a": (True, None), "b": (False, "no end mark"), "c": (False, "not a document"), "d": (False, "no endobj")}


def test_full_profile(spark):
    row = reports.full_profile(one(spark)).first()
    assert (row.valid, row.recommendation, row.editable, row.pages, row.text_shows, row.streams) == (True, "canonical", True, 1, 2, 2)
    docs = made(spark, b"<< /Type /Catalog /AcroForm << /XFA (x) >> >>", stream(b"x", b"/Filter /Foo"))
    row = reports.full_profile(docs).first()
    assert row.recommendation == "preserve-structure" and row.reasons == ["xml_form", "unsupported_streams:1"]


def xml_form(spark, *packets):
    labels = b" ".join(b"(%s) %d 0 R" % (label, i + 2) for i, (label, _) in enumerate(packets))
    return objects(made(spark, b"<< /Type /Catalog /AcroForm << /XFA [" + labels + b"] >> >>", *[stream(x) for _, x in packets]))


def test_xml_packets(spark):
    objs = xml_form(spark, (b"template", b"<t:template xmlns:t='x'><subform name='f' layout='Flowed'><occur max='3'/><field name='a'/></subform></t:template>"), (b"datasets", b"<datasets><data><f><a> 1 </a><b/></f></data></datasets>"), (b"odd", b'<!DOCTYPE a [<!ENTITY e "x">]><a>&e;</a>'))
    got = xfa.packets(objs).orderBy("packet").collect()
    assert [(r.kind, r.unsafe) for r in got] == [("template", False), ("datasets", False), ("unknown", True)]
    assert [tuple(r)[3:] for r in xfa.dataset_fields(objs).collect()] == [("f.a", "1")]
    assert [r.reason for r in xfa.dynamic_markers(objs).orderBy("at").collect()] == ["flowed layout", "repeatable content"]
    assert xfa.semantics(objs).first().classification == "dynamic_rendering_required"
    rows = xfa.mapped_fields(xfa.template_fields(objs).select("doc_id", "field", "path"), xfa.dataset_fields(objs).select("doc_id", "path", "value"))
    assert [(r.field, r.value, r.match) for r in rows.collect()] == [("a", "1", "path")]
    static = xml_form(spark, (b"datasets", b"<datasets><data><a>1</a></data></datasets>"))
    assert xfa.semantics(static).first().editable and xfa.semantics(objects(one(spark))).first().classification == "none"


def test_references_are_moved_outside_strings_alone():
    assert renumbered("<< /A 5 0 R /B (see 5 0 R) /C [6 0 R 7 0 R] /D 5 >>", {6: 60, 7: None}, 10) == "<< /A 15 0 R /B (see 5 0 R) /C [60 0 R null] /D 5 >>"


def test_references_within_strings_are_none(spark):
    assert [(r.src, r.dst) for r in refs(objects(made(spark, b"<< /A (9 0 R) /B 2 0 R >>", b"null"))).collect()] == [(1, 2)]


def catalog_with(title, field, label):
    return (
        b"<< /Type /Catalog /Pages 2 0 R /Lang (%s) /Outlines 5 0 R /PageLabels << /Nums [1 << /S /%s >>] >> /Names << /Dests << /Names [(n) 3 0 R] >> >> /AcroForm << /Fields [7 0 R] /DA (%s) /NeedAppearances %s >> >>" % (title, label, title, b"true" if title == b"b" else b"false"),
        b"<< /Type /Pages /Kids [3 0 R 4 0 R] /MediaBox [0 0 9 9] >>", b"<< /Type /Page /Parent 2 0 R >>", b"<< /Type /Page /Parent 2 0 R >>", b"<< /First 6 0 R >>", b"<< /Title (%s) /Dest [4 0 R /Fit] >>" % title, b"<< /T (%s) /FT /Tx >>" % field,
    )


def test_merged_catalogs(spark):
    docs = made(spark, *catalog_with("ä".encode(), b"x", b"D")).unionByName(made(spark, *catalog_with(b"b", b"y", b"r")).withColumn("doc_id", F.lit("e")))
    merged = documents.merge(objects(docs), F.lit("all"), F.when(F.col("doc_id") == "d", 0).otherwise(1))
    objs = objects(merged)
    assert reachable(merged).first().sound and dangling(objs).count() == 0 and graph.pages(objs).count() == 4
    assert [r.name for r in graph.name_entries(objs).orderBy("ord").collect()] == ["n", "n#doc2"]
    assert [(r.first_page, r.style) for r in graph.page_labels(objs).orderBy("first_page").collect()] == [(1, "D"), (3, "r")]
    assert [r.title for r in graph.outlines(objs).orderBy("ord").collect()] == ["ä", "b"]
    assert [r.name for r in graph.form_fields(objs).orderBy("ord").collect()] == ["x", "y"]
    top = objs.where("num = 1").first().entries
    assert (top["Lang="], top["AcroForm/NeedAppearances"], top["AcroForm/DA="]) == ("ä", "true", "ä")


def test_pages_extracted_and_inserted(spark):
    rows = spark.createDataFrame([(d, i, f"{d}{i}") for d in ("b", "a") for i in range(3)], "d string, i long, t string")
    objs = objects(mint.paged(rows, "d", "i", mint.show(F.col("t"))))
    texts = lambda docs: [r.text for r in text_rows(docs).orderBy("doc_id", "page").collect()]
    assert texts(documents.extract(objs, [2, 0, 2]).where("doc_id = 'a'")) == ["a2", "a0", "a2"]
    into = spark.createDataFrame([("a", 1, "b")], "doc_id string, at int, source string")
    assert texts(documents.insert(objs, into)) == ["a0", "b0", "b1", "b2", "a1", "a2"]
    with pytest.raises(ValueError):
        documents.extract(objs, [])
    several = [("a", 3, "b", 2, [2, 0, 2]), ("a", 3, "a", 1, []), ("b", 0, "a", 1, None)]
    schema = "doc_id string, at int, source string, ord int, pages array<int>"
    got = documents.insert(objs, spark.createDataFrame(several, schema))
    assert texts(got.where("doc_id = 'a'")) == ["a0", "a1", "a2", "a0", "a1", "a2", "b2", "b0", "b2"]
    assert texts(got.where("doc_id = 'b'")) == ["a0", "a1", "a2", "b0", "b1", "b2"]
    for wrong in ([("a", 4, "b", 1, None)], [("a", -1, "b", 1, None)], [("a", None, "b", 1, None)], [("a", 0, "gone", 1, None)], [("a", 0, "b", 1, [3])], [("a", 0, "b", 1, None), ("a", 1, "b", 2, None)]):
        assert documents.inserted(objs, spark.createDataFrame(wrong, schema)).count() == 0


def test_widths_are_those_of_the_font_in_use(spark):
    fonts = (b"<< /Type /Font /FirstChar 65 /Widths [3 4] >>", b"<< /Type /Font /Subtype /Type0 /Encoding /Identity-H /DescendantFonts [8 0 R] >>", b"<< /DW 9 /W [66 [5]] >>", b"<< /Type /Font >>")
    show = b"BT /F1 1 Tf (AB) Tj (AC) Tj /F2 1 Tf <00420043> Tj <0042> Tj () Tj /F3 1 Tf (A) Tj ET"
    page = b"<< /Type /Page /Parent 2 0 R /Contents 4 0 R /Resources << /Font << /F1 6 0 R /F2 7 0 R /F3 9 0 R >> >> >>"
    docs = made(spark, b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [3 0 R] /Count 1 >>", page, stream(show), b"null", *fonts)
    assert [(r.width, r.known) for r in reports.text_widths(docs).orderBy("seq").collect()] == [(7, True), (None, True), (14, True), (5, True), (0, True), (None, False)]
    assert reports.width_changes(docs).first().status == "width_unproven"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_inspect_is_one_pass_and_one_shuffle(spark):
    docs = spark.createDataFrame([("d", bytearray(FILE)), ("n", None), ("e", bytearray(b"")), ("c", bytearray(FILE[:-6]))], "doc_id string, content binary")
    got = facts.inspect(docs)
    assert plan_of(got).count("MapInArrow") == 1 and plan_of(got).count("Exchange hash") == 1
    rows = {r.doc_id: r for r in got.collect()}
    d = rows["d"]
    assert (d.nodes, d.header, d["size"], d.pages, d.parse_error, d.streams[0].num, d.stream_filters.editable, d.xref.has_table, d.security) == (5, "%PDF-1.7", len(FILE), 1, None, 20, 2, True, None)
    assert [(k, rows[k].nodes, rows[k].parse_error, rows[k].streams) for k in "nec"] == [("n", 0, "not a document", None), ("e", 0, "not a document", None), ("c", 0, "no end mark", None)]
    for walked in (graph.pages(docs), graph.form_fields(docs), xfa.packets(docs), graph.name_entries(docs)):
        assert plan_of(walked).count("MapInArrow") == 1 and "Exchange" not in plan_of(walked)
    assert sorted(map(tuple, graph.pages(docs).drop("inherited").collect())) == sorted(map(tuple, graph.pages(objects(docs)).drop("inherited").collect()))


def test_referenced_arrays_of_pages_fields_and_notes(spark):
    docs = made(spark, b"<< /Type /Catalog /Pages 2 0 R /AcroForm << /Fields 9 0 R >> >>", b"<< /Type /Pages /Kids 8 0 R /Resources << >> >>", b"<< /Type /Page /Contents 6 0 R /Annots 7 0 R >>", stream(b"BT (there) Tj ET"), b"<< /Type /Annot /Subtype /Text /Contents (note) >>", b"[4 0 R]", b"[5 0 R]", b"[3 0 R]", b"[10 0 R]", b"<< /FT /Tx /T (a) /V (x) >>")
    assert [(r.text, r.page_index) for r in text_rows(docs).collect()] == [("there", 0)]
    assert [r.name for r in graph.form_fields(docs).collect()] == ["a"] == [r.name for r in graph.form_fields(objects(docs)).collect()]
    objs = objects(docs)
    assert [(r.contents, r.page_index) for r in graph.annotations(objs, graph.pages(docs)).collect()] == [("note", 0)]


def test_borders_that_can_not_be_drawn(spark):
    cases = {
        "/Square /BS << /W 2 /S /D /D [3 0] >>": None, "/Square /BS << /W -1 >>": "unsupported_bs_width", "/Circle /BS << /S /U >>": "unsupported_bs_border_style", "/Link /BS << /S /U >>": None, "/Link /BS 9 0 R": "unsupported_bs_border_style",
        "/Square /BS << /S /D /D [-1] >>": "unsupported_bs_dash_array", "/Link /Border [0 0 1]": None, "/Link /Border [0 0]": "unsupported_border", "/Link /Border [0 0 -1]": "unsupported_border", "/Text /BS << /W -1 >>": None, "/Square /BS << /S /B >>": "unsupported_bs_border_style", "/Square /BS << /W (x) >>": "unsupported_bs_width",
    }
    objs = objects(made(spark, b"<< /Type /Catalog >>", *[f"<< /Type /Annot /Rect [0 0 1 1] /Subtype {c} >>".encode() for c in cases]))
    got = {r.num: (r.appearance_status, r.appearance_blockers) for r in graph.annotations(objs, graph.pages(objs)).collect()}
    assert got == {i + 2: ("unsupported", [why]) if why else ("approximate_supported", []) for i, why in enumerate(cases.values())}


def test_what_is_quiet_and_what_is_not_visible(spark):
    docs = made(spark, b"<< /Type /Catalog /AcroForm << /XFA [(template) 2 0 R (config) 3 0 R] >> >>", stream(b"<template><subform><field name='a' presence='Hidden'/><field name='b' presence='visible'/></subform></template>"), stream(b"<config><dynamicRender> STATIC </dynamicRender><dynamicRender>0</dynamicRender><dynamicRender>required</dynamicRender></config>"))
    assert [(r.packet, r.reason) for r in xfa.dynamic_markers(docs).collect()] == [(1, "dynamic rendering")]
    assert sorted((r.packet, r.path, r.reason) for r in xfa.dynamic_markers(docs, extended=True).collect()) == [(0, "template.subform.field", "presence Hidden"), (1, "config.dynamicRender", "dynamic rendering")]
