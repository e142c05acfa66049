import time
import zlib
from copy import copy

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from vellum.functions import codecs, fonts
from vellum.functions.content import decode_literal, literal_end, text_shows
from vellum.sources.scan import document_objects

DATA = st.binary(max_size=3000) | st.lists(st.sampled_from([b"a", b"ab", b"\0" * 40]), max_size=200).map(b"".join)


@pytest.mark.parametrize("name", codecs.REVERSIBLE)
@given(data=DATA)
@settings(max_examples=60, deadline=None)
def test_codecs_give_back_what_they_take(name, data):
    assert codecs.DECODERS[name](codecs.ENCODERS[name](data)) == data


def test_lzw_survives_a_full_table():
    data = bytes(range(256)) * 40 + zlib.compress(b"x" * 9) * 300
    assert codecs.lzw_decode(codecs.lzw_encode(data)) == data
    assert codecs.lzw_decode(codecs.lzw_encode(data, 0), 0) == data


@given(rows=st.integers(1, 9), columns=st.integers(1, 9), data=st.data())
def test_png_rows(rows, columns, data):
    plain = data.draw(st.binary(min_size=rows * columns, max_size=rows * columns))
    assert codecs.png_rows(codecs.png_plain(plain, columns), columns) == plain


def test_png_filters_by_hand():
    assert codecs.png_rows(bytes([1, 1, 1, 1, 2, 1, 1, 1, 3, 0, 0, 0, 4, 1, 0, 0]), 3) == bytes([1, 2, 3, 2, 3, 4, 1, 2, 3, 2, 2, 3])


@pytest.mark.parametrize("bad", [("ASCIIHexDecode", b"41"), ("RunLengthDecode", b"\x05ab"), ("LZWDecode", b"\x80"), ("FlateDecode", b"x")])
def test_broken_data_is_refused(bad):
    with pytest.raises((ValueError, zlib.error)):
        codecs.DECODERS[bad[0]](bad[1])


def test_hex_rules():
    assert codecs.hex_decode(b"4 1\n4>zz") == b"A@"


def test_literals():
    assert decode_literal(rb"a\(b\)\055\\\n\7x\0419" + b"\\\r\nz") == b"a(b)-\\\n\x07x!9z"
    assert literal_end(b"(a(b)\\)c)d", 0) == 9 and literal_end(b"(a", 0) == -1


def test_text_shows():
    data = b"BT (a(b)) Tj <4142> Tj [(x) -20 (y)] TJ (q) ' % (no) Tj\n <4> Tj [(x) /N] TJ 1 2 (z) \" /F (n) Tf (lost) re (end) Tj /X1 Do"
    assert [(o, t) for o, t, *_ in text_shows(data)] == [("Tj", b"a(b)"), ("Tj", b"AB"), ("TJ", b"xy"), ("'", b"q"), ('"', b"z"), ("Tj", b"end"), ("Do", b"X1")]


def test_text_state():
    data = b"/F 1 Tf BT /G 9 Tf 5 7 Td 2 TL (a) ' (b) Tj 1 -3 TD (c) Tj T* (d) Tj 1 0 0 1 50 60 Tm 3 Tr (e) Tj ET (f) Tj BT (g) Tj (h) 4 Tj (i) \" ET"
    got = [(t, s.font, s.size, s.x, s.y, s.mode) for _, t, _, _, _, s in ((*x[:5], copy(x[5])) for x in text_shows(data))]
    assert got == [(b"a", "G", 9, 5, 5, 0), (b"b", "G", 9, 5, 5, 0), (b"c", "G", 9, 6, 2, 0), (b"d", "G", 9, 6, -1, 0), (b"e", "G", 9, 50, 60, 3), (b"f", None, None, 0, 0, 0), (b"g", None, None, 0, 0, 0)]


@pytest.mark.parametrize("bits", [1, 2, 4, 8, 16, 32])
@given(rows=st.integers(0, 4), columns=st.integers(1, 9), colors=st.integers(1, 4), data=st.data())
@settings(max_examples=40, deadline=None)
def test_predictors_give_back_rows(bits, rows, columns, colors, data):
    size = -(-columns * colors * bits // 8)
    plain = data.draw(st.binary(min_size=rows * size, max_size=rows * size))
    assert codecs.png_rows(codecs.png_plain(plain, columns, colors, bits), columns, colors, bits) == plain
    used = columns * colors * bits
    if used % 8:  # bits beside the last number are no part of it
        plain = b"".join((int.from_bytes(plain[i : i + size], "big") >> (size * 8 - used) << (size * 8 - used)).to_bytes(size, "big") for i in range(0, len(plain), size))
    assert codecs.tiff_rows(codecs.tiff_rows(plain, columns, colors, bits, back=False), columns, colors, bits) == plain


def test_predictors_by_hand():
    assert codecs.tiff_rows(bytes([1, 10, 1, 10, 5, 250]), 3, 2) == bytes([1, 10, 2, 20, 7, 14])
    assert codecs.png_rows(bytes([1, 1, 2, 3, 4, 5, 6]), 2, 3) == bytes([1, 2, 3, 5, 7, 9])
    with pytest.raises(ValueError):
        codecs.decode(zlib.compress(b"ab"), ["FlateDecode"], [{"Predictor": 7}])
    with pytest.raises(ValueError):
        codecs.decode(zlib.compress(b"abc"), ["FlateDecode"], [{"Predictor": 2, "Columns": 2}])


def test_character_maps():
    known = fonts.cmap(b"2 beginbfchar <01> <0041> <0102> <00420043> <03> <0044> endbfchar 2 beginbfrange <10> <12> <0061> <20> <22> [<0078> <0079>] endbfrange")
    assert known == {"01": "A", "0102": "BC", "10": "a", "11": "b", "12": "c", "20": "x", "21": "y"}
    assert fonts.by_cmap(b"\x01\x01\x02\x10", known) == "ABCa" and fonts.by_cmap(b"\x99", known) is None and fonts.by_cmap(b"", known) is None
    assert fonts.to_codes("BCAx", known) == b"\x01\x02\x01\x20" and fonts.to_codes("Z", known) is None


def test_glyph_names():
    assert [fonts.glyph(n) for n in ("a", "Aacute", "ccedilla", "uni20AC", "u1F600", "emdash", "nothing", "zcaron")] == ["a", "Á", "ç", "€", "😀", "—", "", "ž"]
    standard = fonts.base_encoding("StandardEncoding")
    assert (standard[39], standard[96], standard[65], standard[174], standard[128]) == ("’", "‘", "A", "ﬁ", "") and fonts.base_encoding("Other") is None


def test_widths():
    simple = fonts.widths({"FirstChar": "65", "Widths": "[1 2]", "MissingWidth": "9"}, {}, [("open", "["), ("word", "1"), ("word", "2"), ("close", "]")])
    assert fonts.width(b"AB", simple) == 3 and fonts.width(b"AZ", simple) == 10
    assert fonts.proof(b"A", b"B", simple) == "reflow_required" and fonts.proof(b"A", b"A", None) == "unknown"
    words = [("open", "["), ("word", "1"), ("open", "["), ("word", "5"), ("word", "6"), ("close", "]"), ("word", "9"), ("word", "10"), ("word", "7"), ("close", "]")]
    by_number = fonts.widths({"Subtype": "/Type0", "Encoding": "/Identity-H"}, {"DW": "3"}, words)
    assert fonts.width(bytes([0, 1, 0, 2, 0, 9, 0, 10, 1, 0]), by_number) == 5 + 6 + 7 + 7 + 3


@pytest.mark.parametrize("body", [b"<< /T (never closed >>\nendobj\n", b"<< /T 1 >>\n", b"<< /T ( >>\nendobj\n", b"<< /T [ << 1 0 R\n", b") ( \\( endobj\n"])
def test_broken_files_take_linear_time(body):
    data = b"%PDF-1.7\n" + b"".join(b"%d 0 obj\n" % i + body for i in range(8000))
    for tail in (b"", b")" * 8000):
        began = time.process_time()
        rows = document_objects(data + tail)
        assert rows and time.process_time() - began < 2
    whole = document_objects(b"1 0 obj\n<< /A (x\n2 0 obj) /B 1 >>\nendobj\n3 0 obj\n<< /C 2 >>\n4 0 obj\n<< /D 3 >>\nendobj\n")
    assert [(r["num"], r["error"], r["entries"].get("B"), r["entries"].get("C"), r["entries"].get("D")) for r in whole] == [(1, None, "1", None, None), (3, "no endobj", None, "2", None), (4, None, None, None, "3")]


def test_references_to_arrays_are_followed():
    data = b"1 0 obj\n<< /Kids 2 0 R /Fields 3 0 R /Names 5 0 R /AcroForm << /Fields 2 0 R >> >>\nendobj\n2 0 obj\n[7 0 R 8 0 R]\nendobj\n3 0 obj\n2 0 R\nendobj\n5 0 obj\n<< /A 1 >>\nendobj\n"
    own = document_objects(data)[0]["entries"]
    assert (own["Kids"], own["Names"], own["AcroForm/Fields"], own["Kids/#"]) == ("[7 0 R 8 0 R]", "5 0 R", "[7 0 R 8 0 R]", "2")
