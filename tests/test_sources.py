import hashlib

import pytest
from test_documents import made, one

from vellum.operators import reports, security
from vellum.sources.ocr import alto_items, from_alto, from_json
from vellum.sources.write import canonical


def test_alto():
    data = b"<alto><Page><P><String CONTENT='a' HPOS='1' VPOS='2' WIDTH='3' HEIGHT='4' WC='0.5'/></P></Page><String CONTENT='no'/><Page><String CONTENT='b' HPOS='0' VPOS='0' WIDTH='1' HEIGHT='1'/></Page></alto>"
    assert alto_items(data) == [(0, 0, "a", 1.0, 2.0, 4.0, 6.0, 0.5, None), (1, 1, "b", 0.0, 0.0, 1.0, 1.0, 0.0, None)]
    bad = (b"", b"<a>", b"<a/>", b"<Page><String CONTENT='x'/></Page>", b"<Page><String CONTENT='x' HPOS='0' VPOS='0' WIDTH='1' HEIGHT='1' WC='2'/></Page>", b"<!DOCTYPE a><a/>")
    assert all(alto_items(x)[0][-1] for x in bad)


def test_json_and_alto_tables(spark):
    box = '"box": {"x_min": 0, "y_min": 0, "x_max": 2, "y_max": 1}'
    files = [("a", f'[{{"page_index": 0, "text": "x", {box}, "confidence": 0.5}}]'), ("b", f'{{"items": [{{"page_index": 1, "text": "y", {box}}}]}}'), ("c", "[]"), ("d", "7"), ("e", "")]
    rows = spark.createDataFrame([(k, bytearray(v.encode())) for k, v in files], "doc_id string, content binary")
    assert {r.doc_id: (r.text, r.error) for r in from_json(rows).collect()} == {"a": ("x", None), "b": ("y", "a key is missing"), "c": (None, "no items"), "d": (None, "no items"), "e": (None, "no items")}
    assert from_alto(rows).where("error is not null").count() == 5


def test_security(spark):
    standard = b"<< /Filter /Standard /V 4 /R 4 /Length 128 /P -44 /CF << /StdCF << /CFM /AESV2 >> >> >>"
    docs = one(spark, canonical([(1, 0, b"<< /Type /Catalog >>"), (2, 0, standard)], "/Root 1 0 R /Encrypt 2 0 R"))
    row = security.encryption(docs).first()
    assert (row["filter"], row.version, row.revision, row.length, row.permissions, row.crypt_filters) == ("Standard", 4, 4, 128, -44, ["StdCF:AESV2"])
    assert security.check(docs).first().refusal == "password_required"
    docs = one(spark, canonical([(1, 0, b"<< /Type /Catalog >>")], "/Root 1 0 R /Encrypt << /Filter /Own >>"))
    assert security.check(docs).first().refusal == "unsupported_encryption"
    signed = made(spark, b"<< /Type /Catalog >>", b"<< /Type /Sig /ByteRange [0 1 2 3] >>")
    assert security.check(signed).first().refusal == "signed" and security.check(signed, invalidate=True).first().refusal is None


def test_digests_over_any_number_of_ranges(spark):
    text = b"%PDF-1.7 abcdefgh"
    files = {"one": b"[9 3]", "three": b"[0 1 9 2 15 2]", "none": b"[]", "odd": b"[0 1 2]", "back": b"[5 3 4 1]", "out": b"[0 999]", "minus": b"[0 -1]", "huge": b"[0 99999999999999999999]", "gone": b""}
    rows = spark.createDataFrame([(k, bytearray(text + (b" /ByteRange " + v if v else b""))) for k, v in files.items()], "doc_id string, content binary")
    for name in reports.DIGESTS:
        got = {r.doc_id: (r.covered, r.digest) for r in reports.byte_range_digests(rows, name).collect()}
        of = lambda x: (len(x), hashlib.new(name, x).hexdigest())  # noqa: B023, E731
        assert got == {"one": of(b"abc"), "three": of(b"%abgh")} | dict.fromkeys(("odd", "back", "out", "minus", "huge"), (None, None))
    with pytest.raises(ValueError):
        reports.byte_range_digests(rows, "md5")
