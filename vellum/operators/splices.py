"""Surgical edits: bytes of a document replaced where they stand, everything else left as it is.

What is to be replaced is a relation of splices. Each lies in one stream, whose /Length grows with it; all offsets that the cross
references name move by the sizes that change before them, a prefix sum over the splices of a document. These are splices
too, and one small function cuts and joins the bytes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions.codecs import chain_names
from vellum.plans.staging import stage_documents as stage
from vellum.sources.scan import TABLE_LINE, TABLE_RUN, TABLE_START, document_objects
from vellum.sources.syntax import reference

_LENGTH = re.compile(rb"/Length[\0\t\n\f\r ]+(\d{1,12})(?=[^\d])(?![\0\t\n\f\r ]+\d{1,5}[\0\t\n\f\r ]+R)")
_NUMBER = re.compile(rb"\d+[\0\t\n\f\r ]+\d+[\0\t\n\f\r ]+obj[\0\t\n\f\r ]+(\d{1,12})")
_NAMED = re.compile(rb"(startxref|/Prev)[\0\t\n\f\r ]+(\d{1,18})")
#: Bytes of a document within which spans and streams meet.
BUCKET = 1 << 16
PLACES = "doc_id string, kind string, num int, at long, size long, raw string, filtered boolean"


def _places(data: bytes) -> Iterator[tuple]:
    """(kind, stream, at, size, text, filtered): streams, the digits of their lengths, and the offsets that cross references, startxref and /Prev name."""
    rows = {(r["num"], r["gen"]): r for r in document_objects(data)}
    for r in rows.values():
        if r["raw"] is None:
            continue
        if r["entries"].get("Type") == "/XRef":
            yield "refused", r["num"], 0, 0, "cross references stand in a stream", None
        yield "stream", r["num"], r["data_start"], len(r["raw"]), None, bool(chain_names(r["entries"].get("Filter")))
        other = rows.get(reference(r["entries"].get("Length")))
        if other is not None:
            found = [m] if (m := _NUMBER.match(data, other["offset"])) else []
        else:
            found = [m for m in _LENGTH.finditer(data, r["offset"], r["data_start"]) if m[1].decode() == r["entries"].get("Length")]
        if len(found) == 1:
            yield "length", r["num"], found[0].start(1), len(found[0][1]), found[0][1].decode(), None
    for m in TABLE_START.finditer(data):
        at = m.end()
        while run := TABLE_RUN.match(data, at):
            at = run.end()
            for _ in range(int(run[2])):
                line = TABLE_LINE.match(data, at)
                if not line:
                    break
                at = line.end()
                if line[3] == b"n":
                    yield "offset", None, line.start(1), 10, line[1].decode(), None
    named = list(_NAMED.finditer(data))
    for i, m in enumerate(named):
        last = i == len(named) - 1 and m[1] == b"startxref"  # nothing that has an offset follows
        yield "startxref" if last else "offset_text", None, m.start(2), len(m[2]), m[2].decode(), None


def places(docs: DataFrame) -> DataFrame:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.bool_())
        for batch in batches:
            out = [(d, *p) for d, data in zip(batch.column("doc_id").to_pylist(), batch.column("content").to_pylist(), strict=True) for p in _places(data or b"")]
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate(kinds)], ["doc_id", "kind", "num", "at", "size", "raw", "filtered"])

    return docs.select("doc_id", "content").mapInArrow(rows, PLACES)


def containing(spans: DataFrame, streams: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """spans(doc_id, start, end, ...) with stream: the number of the first stream whose data hold the span, null where none does.

    streams(doc_id, num, at, size) don't overlap within a document. Both sides are dealt by document and place; where a span
    begins, the stream that began last is the only one that may hold it. So work grows with spans and streams, not with their pairs, and a
    document of many spans is many groups.
    """
    columns = spans.columns
    row = F.struct(*[F.col(c) for c in columns])
    low, high = F.floor(F.col("at") / bucket), F.floor((F.col("at") + F.col("size")) / bucket)
    held = streams.select("doc_id", F.explode(F.sequence(low, high)).alias("bucket"), F.col("at").alias("place"), F.lit(0).alias("side"), F.struct("num", "at", (F.col("at") + F.col("size")).alias("stop")).alias("s"), F.lit(None).cast(spans.select(row).schema[0].dataType).alias("row"))
    asked = spans.select("doc_id", F.floor(F.col("start") / bucket).alias("bucket"), F.col("start").alias("place"), F.lit(1).alias("side"), F.lit(None).cast(held.schema["s"].dataType).alias("s"), row.alias("row"))
    last = F.last("s", ignorenulls=True).over(Window.partitionBy("doc_id", "bucket").orderBy("place", "side").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    found = held.unionByName(asked).withColumn("s", last).where("side = 1")
    return found.select("row.*", F.when((F.col("s.at") <= F.col("row.start")) & (F.col("row.end") <= F.col("s.stop")), F.col("s.num")).alias("stream"))


def _cut(content: Column, splices: Column) -> Column:
    """Struct of content and error: the splices (at, old, new), by place, put in; they must not overlap, and the bytes must be the old ones."""

    @F.pandas_udf("content binary, error string")
    def apply(c: pd.Series, s: pd.Series) -> pd.DataFrame:
        out = []
        for data, rows in zip(c, s, strict=True):
            parts, at, error = [], 0, None
            for r in rows:
                if r["at"] < at:
                    error = error or "splices overlap"
                elif data[r["at"] : r["at"] + len(r["old"])] != bytes(r["old"]):
                    error = error or "the bytes are not those to be replaced"
                else:
                    parts += [data[at : r["at"]], bytes(r["new"])]
                    at = r["at"] + len(r["old"])
            out.append((None, error) if error else (b"".join([*parts, data[at:]]), None))
        return pd.DataFrame(out, columns=["content", "error"])

    return apply(content, splices)


def splice(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """doc_id, content, error: the documents that wanted(doc_id, at, old, new) has rows for, with the bytes `old` at `at` replaced.

    Splices lie in streams without filters whose length stands in digits of its own; several may meet in one stream and in one
    document. A document with one that can't be made is left alone, and error says why: outside_stream, filtered_stream,
    no_length, shared_length, offset_grows (of an earlier section's), or what _places() and _cut() say.
    """
    wanted = stage(wanted.select("doc_id", F.col("at").cast("long").alias("at"), "old", "new"))
    docs = docs.join(wanted.select("doc_id").distinct(), "doc_id", "left_semi")
    there = stage(places(docs))
    streams = there.where("kind = 'stream'")
    spans = wanted.withColumns({"start": F.col("at"), "end": F.col("at") + F.octet_length("old")})
    inside = stage(containing(spans, streams).select("doc_id", "at", "old", "new", "stream"))
    growth = F.octet_length("new").cast("long") - F.octet_length("old")
    by_stream = inside.groupBy("doc_id", F.col("stream").alias("num")).agg(F.sum(growth).alias("by"))
    lengths = there.where("kind = 'length'").select("doc_id", "num", F.col("at").alias("l_at"), "raw").withColumn("users", F.count(F.lit(1)).over(Window.partitionBy("doc_id", "l_at")))
    fixed = by_stream.join(streams.select("doc_id", "num", "filtered"), ["doc_id", "num"], "left").join(lengths, ["doc_id", "num"], "left")
    new_length = (F.col("raw").cast("long") + F.col("by")).cast("string")
    fixed = stage(fixed.withColumn("new", new_length).withColumn("error", F.when(F.col("num").isNull(), "outside_stream").when(F.col("filtered"), "filtered_stream").when(F.col("raw").isNull(), "no_length").when((F.col("users") > 1) & (F.col("by") != 0), "shared_length")))
    text = lambda c: c.cast("binary")
    sized = inside.select("doc_id", "at", "old", "new").unionByName(fixed.where("error is null").select("doc_id", F.col("l_at").alias("at"), text(F.col("raw")).alias("old"), text(F.col("new")).alias("new")))
    # Offsets move by all that grows before the place they name.
    moves = sized.select("doc_id", F.col("at").alias("place"), F.lit(1).alias("side"), growth.alias("by"), F.lit(None).cast("string").alias("kind"), F.lit(None).cast("long").alias("at"), F.lit(None).cast("string").alias("raw"))
    named = there.where("kind in ('offset', 'offset_text', 'startxref')").select("doc_id", F.col("raw").cast("long").alias("place"), F.lit(0).alias("side"), F.lit(0).cast("long").alias("by"), "kind", "at", "raw")
    before = F.sum("by").over(Window.partitionBy("doc_id").orderBy("place", "side").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    moved = moves.unionByName(named).withColumn("to", (F.col("place") + before).cast("string")).where("side = 0")
    moved = moved.withColumn("to", F.when(F.col("kind") == "offset", F.lpad("to", 10, "0")).otherwise(F.col("to")))
    moved = stage(moved.withColumn("error", F.when((F.col("kind") == "offset_text") & (F.length("to") != F.length("raw")), "offset_grows")))
    every = sized.unionByName(moved.where("to != raw").select("doc_id", "at", text(F.col("raw")).alias("old"), text(F.col("to")).alias("new")))
    errors = fixed.select("doc_id", "error").unionByName(moved.select("doc_id", "error")).unionByName(there.where("kind = 'refused'").select("doc_id", F.col("raw").alias("error"))).groupBy("doc_id").agg(F.min("error").alias("refused"))
    listed = every.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("at", "old", "new"))).alias("splices"))
    got = docs.select("doc_id", "content").join(listed, "doc_id").join(errors, "doc_id", "left").withColumn("c", _cut(F.col("content"), F.col("splices")))
    error = F.coalesce("refused", "c.error")
    return got.select("doc_id", F.when(error.isNull(), F.col("c.content")).alias("content"), error.alias("error"))


def text_splices(plans: DataFrame, docs: DataFrame) -> DataFrame:
    """doc_id, at, old, new of the accepted plans of edits.plan(): where the operand of the text-show stands in the file."""
    good = plans.where("status = 'ok'").select("doc_id", "num", "start", "end", "operand")
    starts = places(docs).where("kind = 'stream'").select("doc_id", "num", F.col("at").alias("data_start"))
    at = F.col("data_start") + F.col("start")
    rows = good.join(starts, ["doc_id", "num"]).join(docs.select("doc_id", "content"), "doc_id")
    old = F.substring(F.col("content"), (at + 1).cast("int"), (F.col("end") - F.col("start")).cast("int"))
    return rows.select("doc_id", at.alias("at"), old.alias("old"), F.col("operand").alias("new"))
