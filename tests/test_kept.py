from test_documents import FILE

from vellum.functions.content import text_shows
from vellum.sources.scan import document_objects, trailer
from vellum.sources.syntax import items, kept_value, object_value, tokens, value


def test_a_dictionary_that_was_read_before_is_kept_but_not_shared():
    kept_value.cache_clear()
    data = b"1 0 obj\n<< /Type /Page /Kids [2 0 R] /T (a \\) b) % > endobj \n >>\nendobj\n"
    first, again = object_value(data, 7), object_value(data, 7)
    assert first == again == value(data, 7) and kept_value.cache_info().hits == 1
    first[0]["Type"] = "/Other"
    assert object_value(data, 7)[0]["Type"] == "/Page"


def test_pieces_that_only_seem_to_end_are_read_whole():
    for body in (b"<< /A (1 endobj 2) /B 3 >>\nendobj\n", b"<< /A (1 stream (2)) >>\nstream\nx", b"<< /A % endobj \n 5 >> endobj ", b"<< /A /xendobj /endobj 3 >> endobj ", b"<< /A ( endobj ", b"[1 2 obj 3] endobj ", b"5 endobj", b""):
        assert object_value(body, 0) == value(body, 0)


def test_trailers_are_kept_only_at_the_end_of_a_file():
    end = b"trailer\n<< /Size 3 /Root 7 0 R >>\nstartxref\n%d\n%%%%EOF\n"
    assert trailer(end % 9, []) == trailer(end % 10, []) == {"Size": "3", "Root": "7 0 R"}
    assert trailer(end % 9 + b"<< /Root 8 0 R >>", [])["Root"] == "8 0 R"


def test_tokens_are_those_of_before():
    data = b" %c\n%d\n<</A(x\\)(y)z)/B<4 1>(p\\(q)%e"
    assert [t for t, _, _ in tokens(data)] == [b"<<", b"/A", b"(x\\)(y)z)", b"/B", b"<4 1>", b"(p\\(q)"]
    assert list(tokens(b"%abc")) == list(tokens(b" \n")) == [] and [t for t, _, _ in tokens(b"1 (2")] == [b"1"]
    listed = items("[(a) /B 5 0 R]")
    listed.append(("word", "x"))
    assert items("[(a) /B 5 0 R]") == [("open", "["), ("text", "a"), ("name", "B"), ("ref", "5"), ("close", "]")]
    assert [(c, e - s) for _, c, _, s, e, _ in text_shows(b"BT (a\\(b) Tj ((c)) Tj [(d) 3 <65>] TJ (f")] == [(b"a(b", 6), (b"(c)", 5), (b"de", 12)]


def test_objects_of_a_document_read_twice_are_equal():
    a = document_objects(FILE)
    a[0]["entries"]["Type"] = "/Changed"
    b, c = document_objects(FILE), document_objects(FILE + b" ")
    assert b == c and b[0]["entries"].get("Type") != "/Changed"
