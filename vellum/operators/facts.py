"""Everything that a report needs of documents from one pass over their bytes.

A document is parsed once and leaves as rows of several kinds: one for itself, one for each of its objects, pages, fields,
annotated places and text-shows. `tag` says the kind, a column of that name holds what there is to say. A relation is a filter on the tag,
and a report over one document is an aggregate by doc_id: all its rows come from one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from vellum.functions.codecs import capability, filter_chain
from vellum.operators.graph import FIELDS, PAGES, walk_fields, walk_pages
from vellum.operators.nodes import TEXTS, Texts
from vellum.sources.scan import MARKERS, entry, marked, name, references_of, revisions_and_objects

#: What is said of each kind of row.
KINDS = {
    "document": "header string, size long, error string, " + ", ".join(f"{k} boolean" for k in MARKERS) + ", has_table boolean, has_stream boolean, has_hybrid boolean, has_object_stream boolean, table_offset long, xref_error string",
    "object": "num int, gen int, offset long, head string, entries map<string,string>, is_stream boolean, container int, error string",
    "page": PAGES,
    "field": FIELDS,
    "text": TEXTS.removeprefix("doc_id string, "),
}
#: Rows that leave a task at a time.
ROWS = 2_000


def told(data: bytes) -> Iterator[tuple[str, dict | tuple]]:
    """(tag, what it says) of one document."""
    every, force = revisions_and_objects(data)
    error = "not a document" if data[:5] != b"%PDF-" else "no end mark" if b"%%EOF" not in data[-1024:] else min((r["error"] for r in every if r["error"]), default=None)
    refs = references_of(data, every)[1]
    yield "document", {"header": data[:8].decode("latin-1"), "size": len(data), "error": error} | marked(data) | {("xref_error" if k == "error" else k): v for k, v in refs.items()}
    for r in force:
        yield "object", {k: r[k] for k in ("num", "gen", "offset", "head", "container", "error")} | {"entries": list(r["entries"].items()), "is_stream": r["raw"] is not None}
    nodes = {r["num"]: r["entries"] for r in force}
    yield from (("page", row) for row in walk_pages(nodes))
    yield from (("field", row) for row in walk_fields(nodes))
    yield from (("text", row) for row in Texts(data, force).texts(False))


def facts(docs: DataFrame, tags: tuple[str, ...] = tuple(KINDS)) -> DataFrame:
    """doc_id, tag and a column for each of tags, of docs(doc_id, content); a null content is an empty document."""
    types = {t: T.StructType.fromDDL(KINDS[t]) for t in tags}
    kinds = {t: pa.struct(list(to_arrow_schema(types[t]))) for t in tags}
    names = {t: types[t].names for t in tags}
    schema = T.StructType.fromDDL("doc_id string, tag string")
    for t in tags:
        schema = schema.add(t, types[t])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def batch() -> pa.RecordBatch:
            own = [pa.array([row if tag == t else None for _, tag, row in held], k) for t, k in kinds.items()]
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in held], pa.string()), pa.array([r[1] for r in held], pa.string()), *own], ["doc_id", "tag", *tags])

        for got in batches:
            for doc_id, data in zip(got.column("doc_id").to_pylist(), got.column("content").to_pylist(), strict=True):
                for tag, row in told(data or b""):
                    if tag in kinds:
                        held.append((doc_id, tag, row if isinstance(row, dict) else dict(zip(names[tag], row, strict=True))))
                    if len(held) >= ROWS:
                        yield batch()
                        held = []
        yield batch()

    return docs.select("doc_id", "content").mapInArrow(rows, schema)


def relation(rows: DataFrame, tag: str) -> DataFrame:
    """The rows of one kind; of objects, raw is empty where there is a stream, for its bytes are not among the facts."""
    own = rows.where(F.col("tag") == tag).select("doc_id", f"{tag}.*")
    return own.withColumn("raw", F.when(F.col("is_stream"), F.lit(b""))) if tag == "object" else own


def inspect(docs: DataFrame) -> DataFrame:
    """What stands in each document, from one pass: doc_id, format, nodes, header, size, pages, parse_error, boundaries, xref, streams, stream_filters, security.

    nodes counts the document, its streams and text-shows; 0 where it can't be read at all: parse_error says why (no
    document, no end mark, encrypted, signed, an XML form, or what is wrong with an object). Of broken cross-reference streams the document itself is left: one node.
    stream_filters: total, editable, pass_through and unsupported; a stream whose filters or parameters are refused counts as that alone.
    """
    rows = facts(docs, ("document", "object", "page", "text"))
    doc, entries = F.first("document", ignorenulls=True), F.col("object.entries")
    type_ = F.coalesce(entries["Type"], F.lit(""))
    own = F.col("object.is_stream") & ~type_.isin("/ObjStm", "/XRef")
    chain = filter_chain(entries["Filter"])
    kind = F.when(entries["DecodeParms!"].isNotNull(), "unsupported_target").otherwise(capability(chain))
    stream = F.struct(F.col("object.num").alias("num"), F.array_join(chain, " ").alias("filter"), kind.alias("capability"))
    of = lambda *names: F.count(F.when(own & kind.isin(*names), 1))
    got = rows.groupBy("doc_id").agg(
        doc.alias("d"), F.count("page").alias("pages"), F.count("text").alias("texts"), F.array_sort(F.collect_list(F.when(own, stream))).alias("streams"),
        F.struct(F.count(F.when(own, 1)).alias("total"), of("identity_pass_through", "editable_reversible").alias("editable"), of("pass_through_image").alias("pass_through"), of("unsupported_target").alias("unsupported")).alias("f"),
    )
    d = lambda k: F.col(f"d.{k}")
    error = F.when(d("error").isin("not a document", "no end mark"), d("error")).when(d("has_encrypt"), "encrypted").when(d("has_signature"), "signed").when(d("has_xfa"), "xml_form")
    cut = F.when(error.isNull() & d("xref_error").isNotNull(), d("xref_error"))
    error = F.coalesce(error, cut, d("error"))
    nodes = F.when(cut.isNotNull(), 1).when(error.isNotNull(), 0).otherwise(1 + F.size("streams") + F.col("texts"))
    none = F.lit(None)
    return got.select(
        "doc_id", F.lit("pdf").alias("format"), nodes.cast("long").alias("nodes"), d("header").alias("header"), d("size").alias("size"), "pages", error.alias("parse_error"),
        F.struct(*[d(k).alias(k) for k in MARKERS]).alias("boundaries"), F.struct(*[d(k).alias(k) for k in ("has_table", "has_stream", "has_hybrid", "has_object_stream", "table_offset")]).alias("xref"),
        F.when(nodes > 1, F.col("streams")).otherwise(none).alias("streams"), F.when(nodes > 1, F.col("f")).otherwise(none).alias("stream_filters"),
        F.when(d("has_encrypt") | d("has_signature"), F.struct(d("has_encrypt").alias("encrypted"), d("has_signature").alias("signed"))).alias("security"),
    )
