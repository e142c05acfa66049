"""Recognised text from outside: ALTO files and JSON, as rows of page, text, box and confidence."""

from __future__ import annotations

import xml.parsers.expat
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ITEMS = "doc_id string, item int, page_index int, text string, x_min double, y_min double, x_max double, y_max double, confidence double, error string"
_NAMES = [x.split()[0] for x in ITEMS.split(", ")]
_KINDS = (pa.string(), pa.int32(), pa.int32(), pa.string(), *[pa.float64()] * 5, pa.string())


def alto_items(data: bytes) -> list[tuple]:
    """(item, page, text, left, top, right, bottom, confidence, error) of the strings within pages; one row with the error of a file that has any."""
    out: list[tuple] = []
    state = {"page": -1, "depth": 0}
    parser = xml.parsers.expat.ParserCreate()

    def begin(tag, attributes):
        local = tag.rpartition(":")[2]
        state["depth"] += state["depth"] > 0
        if local == "Page":
            state["page"], state["depth"] = state["page"] + 1, 1
        elif local == "String" and state["depth"]:
            own = {k.rpartition(":")[2]: v for k, v in attributes.items()}
            x, y, w, h = (float(own[k]) for k in ("HPOS", "VPOS", "WIDTH", "HEIGHT"))
            confidence = float(own.get("WC") or 0)
            if not 0 <= confidence <= 1:
                raise ValueError("confidence is out of range")
            out.append((len(out), state["page"], own["CONTENT"], x, y, x + w, y + h, confidence, None))

    def end(_):
        state["depth"] -= state["depth"] > 0

    def refuse(*_):
        raise ValueError("a document type is not allowed")

    parser.StartElementHandler, parser.EndElementHandler, parser.StartDoctypeDeclHandler = begin, end, refuse
    try:
        parser.Parse(data, True)
    except (xml.parsers.expat.ExpatError, ValueError) as e:
        return [(0, None, None, None, None, None, None, None, str(e))]
    except KeyError as e:
        return [(0, None, None, None, None, None, None, None, f"no {e.args[0]}")]
    return out or [(0, None, None, None, None, None, None, None, "no recognised text")]


def _alto(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(doc_id, *r) for doc_id, data in zip(batch.column("doc_id").to_pylist(), batch.column("content").to_pylist(), strict=True) for r in alto_items(data or b"")]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(_KINDS)], _NAMES)


def from_alto(files: DataFrame) -> DataFrame:
    """files(doc_id, content) of ALTO XML as items; a file with a fault has one row, which says it."""
    return files.select("doc_id", "content").mapInArrow(_alto, ITEMS)


def from_json(files: DataFrame) -> DataFrame:
    """files(doc_id, content): an array of items, or an object that has them as `items`; keys page_index, text, box, confidence, all needed.

    A file that is neither, or has none, has one row with its fault; so has an item that lacks a key.
    """
    item = "page_index: int, text: string, box: struct<x_min: double, y_min: double, x_max: double, y_max: double>, confidence: double"
    text = F.trim(F.col("content").cast("string"))
    rows = files.select("doc_id", F.when(text.startswith("["), F.from_json(text, f"array<struct<{item}>>")).when(text.startswith("{"), F.from_json(text, f"struct<items: array<struct<{item}>>>")["items"]).alias("items"))
    found = rows.where("size(items) > 0").select("doc_id", F.posexplode("items").alias("item", "x"))
    whole = F.col("x.page_index").isNotNull() & F.col("x.text").isNotNull() & F.col("x.box").isNotNull() & F.col("x.confidence").isNotNull()
    for side in ("x_min", "y_min", "x_max", "y_max"):
        whole = whole & F.col(f"x.box.{side}").isNotNull()
    own = found.select("doc_id", "item", "x.page_index", "x.text", *[F.col(f"x.box.{s}") for s in ("x_min", "y_min", "x_max", "y_max")], "x.confidence", F.when(~whole, "a key is missing").alias("error"))
    none = rows.where("items is null or size(items) = 0").select("doc_id", F.lit(0).alias("item"), *[F.lit(None).cast(k).alias(c) for c, k in (("page_index", "int"), ("text", "string"), ("x_min", "double"), ("y_min", "double"), ("x_max", "double"), ("y_max", "double"), ("confidence", "double"))], F.lit("no items").alias("error"))
    return own.unionByName(none)
