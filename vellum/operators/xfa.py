"""XML forms: packets, what they hold, which of them need a renderer, and which data a template's fields mean."""

from __future__ import annotations

import re
import xml.parsers.expat
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellum.operators.graph import Nodes, below, by_document, only, root
from vellum.sources.scan import document_objects, entry, name, stream_bytes, streams
from vellum.sources.syntax import KEPT, KEPT_BYTES, items

#: Fixed names of packets.
KINDS = ("template", "datasets", "config", "localeSet", "connectionSet", "sourceSet", "xdc", "xfdf", "xdp")


#: Fixed values of dynamicRender that need no renderer.
QUIET = ("", "0", "false", "forbidden", "static", "none")


def _packets(nodes: Nodes) -> Iterator[tuple]:
    form = below(nodes, root(nodes), "AcroForm")
    if "XFA=" in form:
        yield 0, None, None, form["XFA="]
        return
    parts, label, order = items(form.get("XFA")), None, 0
    for i, (kind, value) in enumerate(parts):
        if kind == "text" and label is None and i + 1 < len(parts) and parts[i + 1][0] in ("ref", "text"):
            label = value
        elif kind in ("ref", "text"):
            yield order, label, int(value) if kind == "ref" else None, value if kind == "text" else None
            label, order = None, order + 1


_FACTS = "root string, error string, unsafe boolean, fields array<struct<path:string,value:string>>, template array<struct<field:string,path:string>>, markers array<struct<path:string,reason:string>>, presence array<struct<path:string,reason:string>>"


def facts(data: bytes) -> dict:
    """What one pass over a packet's XML tells: its root, leaves of data, fields of templates, and signs of dynamic layout.

    Names are without prefixes. Paths of data leave `datasets` and `data` out; without `datasets` they are whole. XML
    with a document type is unsafe and read no further.
    """
    out: dict = {"root": None, "error": None, "unsafe": False, "fields": [], "template": [], "markers": [], "presence": []}
    stack: list[dict] = []
    parser = xml.parsers.expat.ParserCreate()
    local = lambda tag: tag.rpartition(":")[2]

    def refuse(*_):
        out["unsafe"] = True
        raise ValueError("a document type is not allowed")

    def begin(tag, attributes):
        tag = local(tag)
        own = {local(k): v.strip() for k, v in attributes.items()}
        out["root"] = out["root"] or tag
        up = stack[-1] if stack else {"template": False, "datasets": False, "tag": "", "path": [], "data": []}
        if stack:
            up["leaf"] = False
        template, datasets = up["template"] or tag == "template", up["datasets"] or tag == "datasets"
        skip = tag == "datasets" or (tag == "data" and up["tag"] == "datasets")
        if template and tag == "field" and own.get("name"):
            out["template"].append((own["name"], ".".join([*(s["form"] for s in stack if s["form"]), own["name"]])))
        if up["template"]:
            reason = None
            if tag == "subform" and own.get("layout", "").lower() == "flowed":
                reason = "flowed layout"
            elif tag == "occur" and any(own.get(k, "1") != "1" for k in ("min", "max", "initial")):
                reason = "repeatable content"
            elif tag in ("break", "breakBefore", "breakAfter", "overflow"):
                reason = "pagination"
            if reason:
                out["markers"].append((".".join([*(s["tag"] for s in stack), tag]), reason))
            if own.get("presence", "visible").lower() not in ("", "visible"):
                out["presence"].append((".".join([*(s["tag"] for s in stack), tag]), f"presence {own['presence']}"))
        stack.append({"tag": tag, "template": template, "datasets": datasets, "leaf": True, "text": [], "form": own.get("name", "") if template and tag == "subform" else "", "data": up["data"] + [tag] * (not skip)})

    def end(_):
        own = stack.pop()
        value = "".join(own["text"]).strip()
        if own["tag"] == "dynamicRender" and value.lower() not in QUIET:
            out["markers"].append((".".join([*(s["tag"] for s in stack), own["tag"]]), "dynamic rendering"))
        if own["leaf"] and value and not own["template"] and own["data"]:
            out["fields"].append((".".join(own["data"]), value))

    parser.StartElementHandler, parser.EndElementHandler, parser.StartDoctypeDeclHandler = begin, end, refuse
    parser.CharacterDataHandler = lambda s: stack[-1]["text"].append(s) if stack else None
    try:
        parser.Parse(data, True)
    except (xml.parsers.expat.ExpatError, ValueError) as e:
        out["error"] = str(e)
    return out


@lru_cache(maxsize=KEPT)
def _kept_facts(data: bytes) -> dict:
    return facts(data)


def packet_facts(data: bytes) -> dict:
    """facts() of a packet, not to be changed. Templates and the like may have been read before; data are a document's own."""
    return _kept_facts(data) if len(data) <= KEPT_BYTES and b"datasets" not in data[:KEPT_BYTES // 5] else facts(data)


def kind_of(label: str | None, told: dict) -> str:
    """As packets() says it, of one packet."""
    label = re.sub(r"^[^:]*:|^/+|/+$", "", (label or "").strip(" "))
    if label:
        return label if label in KINDS else "unknown"
    if told["error"] is not None or told["unsafe"] or told["root"] is None:
        return "unknown"
    return told["root"] if told["root"] in KINDS else "xml"


def may_be_edited(held: list[tuple[str, str | None, dict]]) -> bool:
    """As semantics() says it, of the packets of one document: (kind, decode error, facts) of each."""
    kinds = [kind if kind in ("template", "datasets") else told["root"] or "" for kind, _, told in held]
    good = all(wrong is None and told["error"] is None and not told["unsafe"] for _, wrong, told in held)
    return good and "datasets" in kinds and set(kinds) <= {"template", "datasets"} and not any(told["markers"] for _, _, told in held)


def _read(batches: Iterator[pa.RecordBatch], keep: tuple[str, ...] = ()) -> Iterator[pa.RecordBatch]:
    pairs = lambda a, b: pa.list_(pa.struct([(a, pa.string()), (b, pa.string())]))
    kinds = {"root": pa.string(), "error": pa.string(), "unsafe": pa.bool_(), "fields": pairs("path", "value"), "template": pairs("field", "path"), "markers": pairs("path", "reason"), "presence": pairs("path", "reason")}
    same = ("doc_id", "packet", "label", "num", "decode_error", "size")
    for batch in batches:
        found = [packet_facts(d or b"") for d in batch.column("data").to_pylist()]
        keys = {c: [f.name for f in t.value_type] for c, t in kinds.items() if pa.types.is_list(t)}
        columns = [pa.array([[dict(zip(keys[c], x, strict=True)) for x in f[c]] if c in keys else f[c] for f in found], t) for c, t in kinds.items()]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in same), *columns, *(batch.column(c) for c in keep)], [*same, *kinds, *keep])


def document_packets(objs: list[dict]) -> Iterator[tuple]:
    """(packet, label, num, decode error, bytes) of the packets of one document's objects."""
    rows = {r["num"]: r for r in objs}
    for packet, label, num, text in _packets({n: r["entries"] for n, r in rows.items()}):
        data, error = stream_bytes(rows[num]) if num in rows else (None, None)
        yield packet, label, num, error, text.encode() if data is None and text is not None else data


def _of_documents(batches: Iterator[pa.RecordBatch], keep: tuple[str, ...] = ()) -> Iterator[pa.RecordBatch]:
    """The packets of documents, with their bytes."""
    kinds = {"doc_id": pa.string(), "packet": pa.int32(), "label": pa.string(), "num": pa.int32(), "decode_error": pa.string(), "size": pa.int64(), "data": pa.binary()}
    for batch in batches:
        out: list[tuple] = []
        of: list[int] = []
        for i, (doc_id, content) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("content").to_pylist(), strict=True)):
            for packet, label, num, error, data in document_packets(document_objects(content or b"")):
                out.append((doc_id, packet, label, num, error, None if data is None else len(data), data))
                of.append(i)
        yield pa.RecordBatch.from_arrays([*(pa.array([o[i] for o in out], t) for i, t in enumerate(kinds.values())), *(batch.column(c).take(pa.array(of, pa.int64())) for c in keep)], [*kinds, *keep])


def _with_kept(columns: str, docs: DataFrame, keep: tuple[str, ...]) -> str:
    return ", ".join([columns, *(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)])


def packet_bytes(docs: DataFrame, *keep: str) -> DataFrame:
    """doc_id, packet, label, num, decode_error, size, data of the packets of docs(doc_id, content), and what keep names of their document."""
    columns = "doc_id string, packet int, label string, num int, decode_error string, size long, data binary"
    return docs.select("doc_id", "content", *keep).mapInArrow(lambda b: _of_documents(b, keep), _with_kept(columns, docs, keep))


def packets(objs: DataFrame, *keep: str) -> DataFrame:
    """doc_id, packet (its place), label, kind, num, size, decode_error and what is in it: root, error, unsafe, fields, template, markers.

    A label decides the kind, else the root element; what can't be decoded is listed with its error. Of documents(doc_id,
    content), packets are read where a document is parsed; of objects parsed before, they are joined with their streams; packets
    stay what they are. keep: columns of documents that their packets have too.
    """
    if "packet" in objs.columns:
        return objs
    columns = f"doc_id string, packet int, label string, num int, decode_error string, size long, {_FACTS}"
    if "content" in objs.columns:
        read = objs.select("doc_id", "content", *keep).mapInArrow(lambda b: _read(_of_documents(b, keep), keep), _with_kept(columns, objs, keep))
    else:

        def part(objs: DataFrame) -> DataFrame:
            tree = objs.where(entry("Root!").isNotNull() | (name("Type") == "Catalog") | entry("XFA").isNotNull())
            return tree.select("doc_id", "num", only("Root!", "Type", "AcroForm", "XFA", "XFA=", under=("AcroForm/",)).alias("entries"))

        found = by_document(objs, part, _packets, "packet int, label string, num int, text string")
        asked = found.where("num is not null").select("doc_id", "num").distinct()
        data = streams(objs.join(asked, ["doc_id", "num"], "left_semi")).select("doc_id", "num", "data", "decode_error")
        rows = found.join(data, ["doc_id", "num"], "left").select("doc_id", "packet", "label", "num", F.coalesce("data", F.encode("text", "UTF-8")).alias("data"), "decode_error")
        rows = rows.select("doc_id", "packet", "label", "num", "decode_error", F.octet_length("data").cast("long").alias("size"), "data")
        read = rows.mapInArrow(_read, columns)
    of = lambda token: F.when(token.isin(*KINDS), token)
    label = F.regexp_replace(F.trim(F.coalesce("label", F.lit(""))), r"^[^:]*:|^/+|/+$", "")
    kind = F.when(label != "", F.coalesce(of(label), F.lit("unknown"))).when(F.col("error").isNotNull() | F.col("unsafe") | F.col("root").isNull(), "unknown").otherwise(F.coalesce(of(F.col("root")), F.lit("xml")))
    return read.withColumn("kind", kind)


#: Packets whose leaves are data.
DATA = ("datasets", "xdp", "xml")


def dataset_fields(objs: DataFrame, *keep: str) -> DataFrame:
    """doc_id, packet, at, path, value of the leaves of the data packets, those without text left out, and what keep names of their document."""
    rows = packets(objs, *keep).where(F.col("kind").isin(*DATA) & ~F.col("unsafe") & F.col("error").isNull())
    return rows.select("doc_id", "packet", *keep, F.posexplode("fields").alias("at", "f")).select("doc_id", "packet", "at", "f.path", "f.value", *keep)


def template_fields(objs: DataFrame) -> DataFrame:
    """doc_id, packet, at, field, path of the named fields of the template packets; path leads through the named subforms."""
    rows = packets(objs).where("kind in ('template', 'xdp', 'xml') and not unsafe and error is null")
    return rows.select("doc_id", "packet", F.posexplode("template").alias("at", "f")).select("doc_id", "packet", "at", "f.field", "f.path")


def dynamic_markers(objs: DataFrame, extended: bool = False) -> DataFrame:
    """doc_id, packet, at, path, reason: what in a packet needs a renderer; extended: and then what of its template isn't visible, which alone makes no form dynamic."""
    found = F.concat("markers", "presence") if extended else F.col("markers")
    return packets(objs).select("doc_id", "packet", F.posexplode(found).alias("at", "m")).select("doc_id", "packet", "at", "m.path", "m.reason")


def semantics(objs: DataFrame) -> DataFrame:
    """doc_id, packets, classification, editable, reasons of each document: none, dynamic_rendering_required, static_datasets_template or unknown."""
    rows = packets(objs)
    kind = F.when(F.col("kind").isin("template", "datasets"), F.col("kind")).otherwise(F.coalesce("root", F.lit("")))
    good = F.col("decode_error").isNull() & F.col("error").isNull() & ~F.col("unsafe") & kind.isin("template", "datasets")
    per = rows.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("packets"), F.sum(F.size("markers")).alias("n_markers"), F.min(good).alias("static"), F.max(kind == "datasets").alias("has_data"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.transform("markers", lambda m: m["reason"]))))).alias("reasons"),
    )
    every = objs.select("doc_id").distinct().join(per, "doc_id", "left")
    label = F.when(F.col("packets").isNull(), "none").when(F.col("n_markers") > 0, "dynamic_rendering_required").when(F.col("static"), "static_datasets_template").otherwise("unknown")
    return every.select("doc_id", F.coalesce("packets", F.lit(0)).alias("packets"), label.alias("classification"), ((label == "static_datasets_template") & F.col("has_data")).alias("editable"), F.coalesce("reasons", F.array().cast("array<string>")).alias("reasons"))


def mapped_fields(template: DataFrame, dataset: DataFrame) -> DataFrame:
    """template(doc_id, field, path) with the dataset's value: by name or path where that is unique, else by a unique last part.

    dataset(doc_id, path, value). The sides that values come from are cut to paths that occur once first.
    """
    leaf = F.element_at(F.split("path", r"\."), -1)
    once = lambda key: dataset.groupBy("doc_id", key).agg(F.count(F.lit(1)).alias("n"), F.first(F.struct("path", "value")).alias("v")).where("n = 1").drop("n")
    by_path, by_leaf = once(F.col("path").alias("_k")), once(leaf.alias("_k"))
    rows = template.select("*", F.row_number().over(Window.partitionBy("doc_id").orderBy("field", "path")).alias("_r"))
    sides = [(rows["field"], by_path, "a"), (rows["path"], by_path, "b"), (rows["field"], by_leaf, "c")]
    for key, side, to in sides:
        right = side.select(F.col("doc_id").alias(f"_d{to}"), F.col("_k").alias(f"_k{to}"), F.col("v").alias(to))
        rows = rows.join(right, (rows["doc_id"] == right[f"_d{to}"]) & (key == right[f"_k{to}"]), "left").drop(f"_d{to}", f"_k{to}")
    how = F.when(F.col("a").isNotNull() | F.col("b").isNotNull(), "path").when(F.col("c").isNotNull(), "leaf").otherwise("none")
    found = F.coalesce("a", "b", "c")
    return rows.select("doc_id", "field", "path", found["path"].alias("dataset_path"), found["value"].alias("value"), how.alias("match"))


def of_kind(rows: DataFrame, kind: str | None = None, label: str | None = None) -> DataFrame:
    """Packets of a kind and a label; what is None is not looked at."""
    if kind is not None:
        rows = rows.where(F.col("kind") == kind)
    return rows if label is None else rows.where(F.col("label").eqNullSafe(F.lit(label)))

