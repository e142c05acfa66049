"""Documents made from table rows, in column expressions: each is a body of numbered objects with a cross-reference table."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.sources.write import canonical, packed, written


def literal(text: Column) -> Column:
    """A string in parentheses, escaped so that only a decoder gives it back."""
    for plain, escaped in (("\\", "\\\\"), ("(", "\\("), (")", "\\)"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("-", "\\055")):
        text = F.replace(text, F.lit(plain), F.lit(escaped))
    return F.concat(F.lit("("), text, F.lit(")"))


def raw_literal(text: Column) -> Column:
    """literal(), as raw values are held: a character for each byte."""
    return F.decode(F.encode(literal(text), "UTF-8"), "ISO-8859-1")


def show(text: Column, font: str = "F1", array: Column | None = None) -> Column:
    """One text-show; where `array` is true, as an array of one string."""
    plain = F.concat(F.lit(f"BT /{font} 12 Tf 72 720 Td "), literal(text), F.lit(" Tj ET\n"))
    if array is None:
        return plain
    return F.when(array, F.concat(F.lit(f"BT /{font} 12 Tf 72 720 Td ["), literal(text), F.lit("] TJ ET\n"))).otherwise(plain)


def stream(content: Column, entries: Column | str = "") -> Column:
    """A stream object's body. content: text or bytes; entries: further dictionary entries."""
    content = content.cast("binary")
    head = F.concat(F.lit("<< /Length "), F.octet_length(content).cast("string"), F.lit(" "), F.lit(entries) if isinstance(entries, str) else entries, F.lit(" >>\nstream\n"))
    return F.concat(head.cast("binary"), content, F.lit("\nendstream").cast("binary"))


def document(objects: Column, root: Column | int = 1, extra: Column | str = "", pack: Column | bool = False) -> Column:
    """The file. objects: an array of obj() in file order; a number may come twice, the later one counts. pack: in object streams."""
    of = lambda x: x if isinstance(x, Column) else F.lit(x)
    return written(objects, F.concat(F.lit("/Root "), of(root).cast("string"), F.lit(" 0 R "), of(extra)), of(pack))


def obj(num: Column | int, body: Column | str, gen: Column | int = 0) -> Column:
    of = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(of(num).cast("int").alias("num"), of(gen).cast("int").alias("gen"), of(body).cast("binary").alias("body"))


def one_page(df: DataFrame, doc_id: Column, contents: list[Column], entries: Column | str = "", pack: Column | bool = False) -> DataFrame:
    """doc_id, content: a document of one page for each row, with one content stream for each of contents."""
    refs = " ".join(f"{4 + i} 0 R" for i in range(len(contents)))
    objects = F.array(
        obj(1, "<< /Type /Catalog /Pages 2 0 R >>"),
        obj(2, "<< /Type /Pages /Kids [3 0 R] /Count 1 /MediaBox [0 0 612 792] /Resources << >> >>"),
        obj(3, f"<< /Type /Page /Parent 2 0 R /Contents [{refs}] >>"),
        *[obj(4 + i, stream(c, entries)) for i, c in enumerate(contents)],
    )
    return df.select(doc_id.cast("string").alias("doc_id"), document(objects, pack=pack).alias("content"))


def paged(df: DataFrame, doc_id: str, order: str, contents: Column, page_entries: Column | str = "", fan: int = 4, pack: bool = False) -> DataFrame:
    """One document for each doc_id, with a page for each row in the given order, under a tree of two levels of nodes.

    Objects: 1 catalog, 2 root of pages; node k has number 10 + 3 * fan * k, its pages and their contents follow.
    """
    rows = df.select(
        F.col(doc_id).cast("string").alias("doc_id"),
        F.struct(F.col(order).cast("long").alias("at"), contents.cast("binary").alias("text"), (F.lit(page_entries) if isinstance(page_entries, str) else page_entries).cast("binary").alias("entries")).alias("row"),
    )
    grouped = rows.groupBy("doc_id").agg(F.sort_array(F.collect_list("row")).alias("rows"))

    @F.arrow_udf("binary")
    def files(rows: pa.Array) -> pa.Array:
        _, texts, entries = (c.to_pylist() for c in rows.flatten().flatten())
        out, at = [], 0
        for n in rows.value_lengths().to_pylist():
            out.append((packed if pack else canonical)(_pages(texts[at : at + n], entries[at : at + n], fan), "/Root 1 0 R "))
            at += n
        return pa.array(out, pa.binary())

    return grouped.select("doc_id", files("rows").alias("content"))


def _pages(texts: list[bytes], entries: list[bytes], fan: int) -> list[tuple[int, int, bytes]]:
    """The objects of paged(), in file order."""
    n = len(texts)
    nodes = [10 + 3 * fan * k for k in range(-(-n // fan))]
    pages = [nodes[i // fan] + 1 + i % fan * 2 for i in range(n)]
    kids = lambda numbers: b" ".join([b"%d 0 R" % x for x in numbers])
    return [
        (1, 0, b"<< /Type /Catalog /Pages 2 0 R >>"),
        (2, 0, b"<< /Type /Pages /MediaBox [0 0 612 792] /Resources << >> /Kids [%b] /Count %d >>" % (kids(nodes), n)),
        *[(node, 0, b"<< /Type /Pages /Parent 2 0 R /Kids [%b] >>" % kids(pages[k * fan : k * fan + fan])) for k, node in enumerate(nodes)],
        *[(page, 0, b"<< /Type /Page /Parent %d 0 R /Contents %d 0 R %b >>" % (nodes[i // fan], page + 1, entries[i])) for i, page in enumerate(pages)],
        *[(page + 1, 0, b"<< /Length %d  >>\nstream\n%b\nendstream" % (len(text), text)) for page, text in zip(pages, texts, strict=True)],
    ]
