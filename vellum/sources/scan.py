"""From document bytes to relations of objects, references and streams.

Python reads a document once and says where its objects and streams are and what their dictionaries hold, those of
object streams included; a number that comes twice is settled there too, so nothing is shuffled. Everything after that
is columns.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.functions.codecs import capability, chain_names, decode, decoded, filter_chain, parameters
from vellum.functions.content import Strings
from vellum.sources.syntax import KEPT, KEPT_BYTES, SPACE, items, kept_value, object_value, reference, tokens, value
from vellum.sources.write import cross_references

_OBJECT = re.compile(rb"^(\d{1,9})[ \t\r\n\f\0]+(\d{1,5})[ \t\r\n\f\0]+obj\b", re.M)
_NUMBER_OBJECT = re.compile(rb"^(\d{1,9})[ \t\r\n\f\0]+(\d{1,5})[ \t\r\n\f\0]+obj[ \t\r\n\f\0]+(\d{1,12})[ \t\r\n\f\0]+endobj", re.M)
_TAIL = re.compile(rb"startxref[ \t\r\n]+\d+[ \t\r\n]+%%EOF[ \t\r\n]*")
_KINDS = {
    "doc_id": pa.string(), "num": pa.int32(), "gen": pa.int32(), "offset": pa.int64(), "head": pa.string(), "entries": pa.map_(pa.string(), pa.string()), "raw": pa.binary(), "data_start": pa.int64(),
    "container": pa.int32(), "parms": pa.list_(pa.map_(pa.string(), pa.int32())), "error": pa.string(),
}
_SCHEMA = pa.schema(list(_KINDS.items()))
OBJECTS = "doc_id string, num int, gen int, offset long, head string, entries map<string,string>, raw binary, data_start long, container int, parms array<map<string,int>>, error string"


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id (the path) and content of each file that begins like a document."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.col("path").alias("doc_id"), "content").where(detected(F.col("content")))


def detected(content: Column) -> Column:
    return F.substring(content, 1, 5) == F.lit(b"%PDF-")


def _extent(data: bytes, start: int, length: int | None) -> tuple[int, str | None]:
    """Where a stream's data ends: after its length if `endstream` follows, else before the next `endstream`."""
    if length is not None and data[start + length : start + length + 20].lstrip(SPACE)[:9] == b"endstream":
        return start + length, None
    stop = data.find(b"endstream", start)
    if stop < 0:
        return len(data), "no endstream"
    while stop > start and data[stop - 1 : stop] in (b"\n", b"\r"):
        stop -= 1
    return stop, None


#: Keys that say how a stream's bytes are decoded; most have none of them.
FILTERS = frozenset(("Filter", "DecodeParms", "DP"))
#: Keys whose values are arrays by the format; one that is a reference to an array stands for it.
ARRAYS = ("Kids", "Fields", "Contents", "Annots", "Names", "Nums", "Opt", "Rect", "MediaBox", "CropBox", "XFA", "Widths", "DescendantFonts")
#: Keys whose references are followed where a document is parsed; most objects have none of them.
_OF_STREAMS, _OF_FORMS = ("Filter", "DecodeParms"), ("AcroForm/Fields", "AcroForm/XFA")
_FOLLOWED = (*_OF_STREAMS, *ARRAYS, *_OF_FORMS)
#: What an object's value ends with, unless it stands within a string or a name.
_WORD = re.compile(rb"endobj|stream")
_STREAM_END = b"\nendstream\nendobj"


def _followed(entries: dict[str, str]) -> tuple[str, ...]:
    """The keys of _FOLLOWED whose values are references."""
    return tuple(k for k in _FOLLOWED if reference(entries.get(k)))


def _shape(num: int, gen: int, head: str, entries: dict[str, str], is_stream: bool) -> tuple | None:
    """All that an object adds to its document's tree, a stream's bytes and their length left out; None if those matter to it."""
    if not entries.keys().isdisjoint(FILTERS) or "ToUnicode" in entries or entries.get("Type") in ("/ObjStm", "/XRef"):
        return None
    if is_stream and head.count("/Length ") == 1:
        head = re.sub(r"/Length \d+", "/Length", head)
    return num, gen, is_stream, head


def _size(length: str) -> int | None:
    return int(length) if re.fullmatch(r"\d{1,12}", length) else None


@lru_cache(maxsize=2 * KEPT)
def _kept_object(piece: bytes) -> tuple | None:
    """Number, generation, place, text, entries, end of the value, whether a stream follows, its length, _followed() and _shape() of a piece that begins behind an object and ends a byte behind a _WORD.

    None where that word doesn't end the object's value, or the piece alone doesn't tell.
    """
    m = _OBJECT.search(piece)
    if m is None or piece[:1].isdigit():
        return None
    entries, head_end, after, word = value(piece, m.end())
    head = piece[m.end() : head_end].strip(SPACE).decode("latin-1")
    if word != b"endobj" and not (word == b"stream" and head.startswith("<<")):
        return None
    shape = _shape(int(m[1]), int(m[2]), head, entries, word == b"stream")
    return int(m[1]), int(m[2]), m.start(), head, entries, after, word == b"stream", _size(entries.get("Length", "")), _followed(entries), shape


def _found(data: bytes) -> Iterator[dict]:
    """The objects that stand in the file itself, in its order."""
    numbers: dict[tuple[int, int], int] | None = None
    at, ends = 0, Strings(data)
    while True:
        w = _WORD.search(data, at, at + KEPT_BYTES)
        kept = _kept_object(data[at : w.end() + 1]) if w is not None else None
        if kept is not None and kept[5] == w.end() - at:
            num, gen, begin, head, entries, _, is_stream, size, follow, shape = kept
            row = {"num": num, "gen": gen, "offset": at + begin, "head": head, "entries": dict(entries), "raw": None, "data_start": None, "container": None, "error": None, "follow": follow, "shape": shape}
            after = w.end()
            if not is_stream:
                at = after
                yield row
                continue
            if size is not None and data[after : after + 1] == b"\n" and data.startswith(_STREAM_END, after + 1 + size):
                row["raw"], row["data_start"] = data[after + 1 : after + 1 + size], after + 1
                at = after + 1 + size + len(_STREAM_END)
                yield row
                continue
            word, behind, row["shape"] = b"stream", at, None
        else:
            if w is None and data.find(b"obj", at) < 0:
                return
            m = _OBJECT.search(data, at)
            if m is None:
                return
            behind = m.end()
            entries, head_end, after, word = object_value(data, behind, ends)
            row = {"num": int(m[1]), "gen": int(m[2]), "offset": m.start(), "head": data[behind:head_end].strip(SPACE).decode("latin-1"), "entries": entries, "raw": None, "data_start": None, "container": None, "error": None, "follow": _followed(entries), "shape": None}
        if word == b"stream" and row["head"].startswith("<<"):
            start = after + (2 if data[after : after + 2] == b"\r\n" else data[after : after + 1] in (b"\n", b"\r"))
            length = entries.get("Length", "")
            if ref := reference(length):
                if numbers is None:
                    numbers = {(int(n[1]), int(n[2])): int(n[3]) for n in _NUMBER_OBJECT.finditer(data)}
                size = numbers.get(ref)
            else:
                size = _size(length)
            stop, row["error"] = _extent(data, start, size)
            row |= {"raw": data[start:stop], "data_start": start}
            end = data.find(b"endobj", stop)
            row["error"] = row["error"] or ("no endobj" if end < 0 else None)
            at = end + 6 if end >= 0 else max(stop, behind)
        elif word.endswith(b"!") and word != b"obj!":
            row["error"], at = "a dictionary or array is not closed", after
        elif word == b"endobj":
            at = after
        else:
            row["error"], at = "no endobj", behind
        yield row


def _resolved(rows: dict[tuple[int, int], dict]) -> None:
    """Filters of streams and their parameters that are references become what they refer to, and so do references to arrays; a circle stays a reference."""
    for row in rows.values():
        for key in row["follow"]:
            if row["raw"] is None and key in _OF_STREAMS:
                continue
            # The form's own arrays stand one dictionary further down where the catalog holds the form itself.
            for _ in range(1 if key in _OF_FORMS else 8):
                target = rows.get(reference(row["entries"].get(key)))
                if target is None or (key not in _OF_STREAMS and not target["head"].startswith("[")):
                    break
                row["entries"] |= {key: target["head"]} | {f"{key}/{k}": v for k, v in target["entries"].items()}


def _members(row: dict) -> Iterator[dict]:
    """The objects within an object stream; one that can't be read is passed over."""
    entries = row["entries"]
    chain = chain_names(entries.get("Filter"))
    parms, error = parameters(entries, chain)
    try:
        data = b"" if error else decode(row["raw"], chain, parms)
        n, first = int(entries.get("N", "")), int(entries.get("First", ""))
        header = [int(x) for x in data[:first].split()]
    except (ValueError, KeyError, zlib.error) as e:
        error = str(e) or "broken"
    if error or n < 0 or first > len(data) or len(header) < 2 * n:
        row["error"] = row["error"] or f"object stream: {error or 'malformed header'}"
        return
    begins = header[1 : 2 * n : 2] + [len(data) - first]
    for i, number in enumerate(header[0 : 2 * n : 2]):
        body = data[first + begins[i] : first + begins[i + 1]].strip(SPACE)
        own, end, _, word = value(body, 0)
        if body and not word and end == len(body) and 0 <= number < 2**31:
            yield {"num": number, "gen": 0, "offset": row["offset"], "head": body.decode("latin-1"), "entries": own, "raw": None, "data_start": None, "container": row["num"], "error": None, "follow": _followed(own), "shape": None}


def _trailer_value(data: bytes, at: int) -> dict[str, str]:
    """The entries of the dictionary at `at`; kept where nothing but the end of the file follows it."""
    stop = data.find(b"startxref", at, at + KEPT_BYTES)
    return dict(kept_value(data[at:stop])[0]) if stop >= 0 and _TAIL.fullmatch(data, stop) else value(data, at)[0]


def trailer(data: bytes, rows: list[dict]) -> dict[str, str]:
    """The last trailer's entries; without one those of the cross-reference stream that startxref names, or of the last one."""
    at = data.rfind(b"trailer")
    if at >= 0 and (entries := _trailer_value(data, at + 7)):
        return entries
    found = [r for r in rows if r["raw"] is not None and r["entries"].get("Type") == "/XRef"]
    start = re.search(rb"startxref[\0\t\n\f\r ]+(\d+)", data[max(0, data.rfind(b"startxref")) :])
    named = [r for r in found if start and r["offset"] == int(start[1])]
    return max(named or found, key=lambda r: r["offset"])["entries"] if found else {}


def document_shape(data: bytes, rows: list[dict]) -> tuple | None:
    """What documents whose trees are the same have in common, from the objects of the file itself; None if bytes of streams matter to it."""
    at = data.rfind(b"trailer")
    stop = data.find(b"startxref", at, at + KEPT_BYTES) if at >= 0 else -1
    shapes = [r["shape"] for r in rows]
    if stop < 0 or not rows or None in shapes or not _TAIL.fullmatch(data, stop):
        return None
    return data[at:stop], *shapes


def found_objects(data: bytes) -> list[dict]:
    """The objects of the file itself, earlier revisions included; references to filters and arrays are not followed yet."""
    return list(_found(data))


def document_objects(data: bytes, revisions: bool = False) -> list[dict]:
    """The objects in force: of a number that comes twice the later one, and one of the file before one in an object stream."""
    every, force = revisions_and_objects(data)
    return every if revisions else force


def revisions_and_objects(data: bytes, every: list[dict] | None = None) -> tuple[list[dict], list[dict]]:
    """All objects that the bytes hold, earlier revisions included, and those in force; every: those of the file itself, where they are known already."""
    if every is None:
        every = list(_found(data))
    force = {(r["num"], r["gen"]): r for r in every}
    _resolved(force)
    packed = [r for r in force.values() if r["raw"] is not None and r["entries"].get("Type") == "/ObjStm"]
    for row in packed:
        for member in _members(row):
            force.setdefault((member["num"], 0), member)
    if packed:
        _resolved(force)
    last = trailer(data, every)
    if top := force.get(reference(last.get("Root"))):
        top["entries"] |= {"Root!": "true"} | {f"Trailer!{k}": last[k] for k in ("Info", "ID") if k in last}
    for row in force.values():
        if row["raw"] is None:
            continue
        if row["entries"].keys().isdisjoint(FILTERS):
            row["parms"] = []
        else:
            row["parms"], wrong = parameters(row["entries"], chain_names(row["entries"].get("Filter")))
            if wrong:
                row["entries"]["DecodeParms!"] = wrong
    return every, list(force.values())


def stream_bytes(row: dict) -> tuple[bytes | None, str | None]:
    """The decoded bytes of a stream's row, or what is wrong; neither of an object without a stream."""
    if row["raw"] is None or row["entries"].keys().isdisjoint(FILTERS):
        return row["raw"], None
    if "DecodeParms!" in row["entries"]:
        return None, row["entries"]["DecodeParms!"]
    try:
        return decode(row["raw"], chain_names(row["entries"].get("Filter")), row["parms"]), None
    except KeyError as e:
        return None, f"unsupported filter {e.args[0]}"
    except (ValueError, zlib.error) as e:
        return None, str(e)


def _trailers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for data in batch.column("content").to_pylist():
            data = data or b""
            start = data.rfind(b"startxref")
            m = re.match(rb"startxref[\0\t\n\f\r ]+(\d{1,18})", data[start : start + 40]) if start >= 0 else None
            version = re.match(rb"%PDF-(\d\.\d)", data)
            out.append((list(trailer(data, [] if b"trailer" in data else document_objects(data)).items()), int(m[1]) if m else None, version[1].decode() if version else None, b"%%EOF" in data))
        kinds = (pa.map_(pa.string(), pa.string()), pa.int64(), pa.string(), pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array([r[i] for r in out], k) for i, k in enumerate(kinds))], ["doc_id", "entries", "startxref", "version", "has_end"])


def trailers(docs: DataFrame) -> DataFrame:
    """doc_id, entries of the trailer, startxref, version, has_end of each document."""
    return docs.select("doc_id", "content").mapInArrow(_trailers, "doc_id string, entries map<string,string>, startxref long, version string, has_end boolean")


def _objects(batches: Iterator[pa.RecordBatch], revisions: bool) -> Iterator[pa.RecordBatch]:
    rows: list[dict] = []
    size = 0

    def batch_of() -> pa.RecordBatch:
        pick = lambda c: [r.get(c) for r in rows]
        special = {"entries": [list(r["entries"].items()) for r in rows], "parms": [None if r.get("parms") is None else [list(m.items()) for m in r["parms"]] for r in rows]}
        return pa.RecordBatch.from_arrays([pa.array(special.get(c) or pick(c), t) for c, t in _KINDS.items()], schema=_SCHEMA)

    for batch in batches:
        for doc_id, data in zip(batch.column("doc_id").to_pylist(), batch.column("content").to_pylist(), strict=True):
            rows += [r | {"doc_id": doc_id} for r in document_objects(data or b"", revisions)]
            size += len(data or b"")
            if size > 2_000_000 or len(rows) > 5_000:
                yield batch_of()
                rows, size = [], 0
    yield batch_of()


def object_rows(docs: DataFrame) -> DataFrame:
    """Every object that the bytes hold, earlier revisions included."""
    return docs.select("doc_id", "content").mapInArrow(lambda b: _objects(b, True), OBJECTS)


def objects(docs: DataFrame) -> DataFrame:
    """The objects in force. entries: the dictionary by path; container: the object stream it stands in; error: what is wrong with it."""
    return docs.select("doc_id", "content").mapInArrow(lambda b: _objects(b, False), OBJECTS)


def entry(key: str) -> Column:
    """The raw value of a dictionary's key, or of one further down by its path (`Resources/Font`); null without it."""
    return F.col("entries")[key]


def name(key: str) -> Column:
    """The name that is a key's value; empty if it is none."""
    return F.regexp_extract(F.coalesce(entry(key), F.lit("")), r"^/(.*)", 1)


def text(key: str) -> Column:
    """The text of the string that is a key's value; null if it is none."""
    return F.col("entries")[f"{key}="]


def number(key: str) -> Column:
    return F.expr(f"try_cast(entries['{key}'] as int)")


def ref_numbers(raw: Column) -> Column:
    """The object numbers that a raw value refers to, in order. It must hold no strings."""
    return F.transform(F.regexp_extract_all(F.coalesce(raw, F.lit("")), F.lit(r"(\d+)\s+\d+\s+R\b"), F.lit(1)), lambda x: x.cast("int"))


def array_items(raw: Column) -> Column:
    """What an array's raw value holds, as structs of kind (text, name, ref, open, close, word) and value."""

    @F.pandas_udf("array<struct<kind:string,value:string>>")
    def apply(values):
        return values.map(lambda v: [{"kind": k, "value": x} for k, x in items(v)])

    return apply(raw)


def references(head: str | None) -> list[int]:
    """The numbers of the objects that an object's text refers to."""
    if "R" not in (head or ""):
        return []
    return list(_kept_references(head)) if len(head) <= KEPT_BYTES else _listed_references(head)


def _listed_references(head: str) -> list[int]:
    return [int(x) for kind, x in items(head) if kind == "ref" and re.fullmatch(r"\d{1,9}", x)]


@lru_cache(maxsize=KEPT)
def _kept_references(head: str) -> tuple[int, ...]:
    return tuple(_listed_references(head))


def _references(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [
            (doc_id, num, x)
            for doc_id, num, head in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "num", "head")), strict=True)
            for x in references(head)
        ]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), *(pa.array([r[i] for r in rows], pa.int32()) for i in (1, 2))], ["doc_id", "src", "dst"])


def refs(objs: DataFrame) -> DataFrame:
    """doc_id, src, dst: each reference from one object to another; what looks like one within a string is none."""
    return objs.select("doc_id", "num", "head").mapInArrow(_references, "doc_id string, src int, dst int")


def dangling(objs: DataFrame) -> DataFrame:
    """References to objects that are not there."""
    here = objs.select("doc_id", F.col("num").alias("dst"))
    return refs(objs).join(here, ["doc_id", "dst"], "left_anti")


def streams(objs: DataFrame) -> DataFrame:
    """Streams with their filters, what these allow, and their decoded bytes or the error of decoding."""
    found = objs.where("raw is not null").withColumn("chain", filter_chain(entry("Filter")))
    found = found.withColumns({"capability": capability(F.col("chain")), "_d": decoded(F.col("raw"), F.col("chain"), F.col("parms"), entry("DecodeParms!"))})
    return found.withColumns({"data": F.col("_d.data"), "decode_error": F.col("_d.error")}).drop("_d")


#: Names whose presence is a boundary; fixed by the format.
MARKERS = {
    "has_encrypt": {"/Encrypt"}, "has_signature": {"/ByteRange"}, "has_acroform": {"/AcroForm"}, "has_xfa": {"/XFA"}, "has_annotations": {"/Annot", "/Annots"}, "has_font_markers": {"/Font"},
    "has_cmap_markers": {"begincmap", "beginbfchar", "beginbfrange"}, "has_tounicode_cmap": {"/ToUnicode"}, "has_cid_font_markers": {"/CIDFontType0", "/CIDFontType2"},
}
_WORDS = re.compile(rb"/(?:Encrypt|ByteRange|AcroForm|XFA|Annots?|Font|ToUnicode|CIDFontType[02])(?![A-Za-z0-9])|begincmap|beginbfchar|beginbfrange")


def marked(data: bytes) -> dict[str, bool]:
    """Which of MARKERS a document has, outside strings and comments; only one in which a word stands at all is taken to pieces for that."""
    seen = {t.decode("latin-1") for t in _outside(data)} if _WORDS.search(data) else set()
    return {k: not seen.isdisjoint(v) for k, v in MARKERS.items()}


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = []
        for data in batch.column("content").to_pylist():
            sets.append(marked(data or b""))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array([s[k] for s in sets], pa.bool_()) for k in MARKERS)], ["doc_id", *MARKERS])


def _outside(data: bytes) -> Iterator[bytes]:
    """Tokens of the whole file; behind a string that is not closed, parentheses are signs like others."""
    end = 0
    for token, _, end in tokens(data):
        yield token
    opened = data.find(b"(", end)
    if opened >= 0:
        yield from (t for t, _, _ in tokens(data[opened:].translate(None, b"()")))


def markers(docs: DataFrame) -> DataFrame:
    """doc_id and whether the bytes name encryption, signatures, forms, XML forms, annotations, fonts and character maps, outside strings and comments."""
    return docs.select("doc_id", "content").mapInArrow(_marked, "doc_id string, " + ", ".join(f"{k} boolean" for k in MARKERS))


TABLE_START = re.compile(rb"(?:^|[\r\n])xref[ \t]*[\r\n]+")
TABLE_RUN = re.compile(rb"[\r\n ]*(\d{1,9})[ \t]+(\d{1,9})[ \t]*[\r\n]+")
TABLE_LINE = re.compile(rb"[\r\n ]*(\d{10}) (\d{5}) ([nf])")
#: Lines as the format has them, of 20 bytes each.
_TABLE_LINES = re.compile(rb"(?:\d{10} \d{5} [nf](?: \n| \r|\r\n))*+")
_TABLE_AFTER = re.compile(rb"xref[ \t]*[\r\n]+")


def table_starts(data: bytes) -> list[int]:
    """Where the runs of each table of cross references begin: the ends of TABLE_START."""
    out, done, at = [], -1, data.find(b"xref")
    while at >= 0:
        if (at == 0 or (at > done and data[at - 1] in b"\r\n")) and (m := _TABLE_AFTER.match(data, at)):
            out.append(m.end())
            done = m.end()
        at = data.find(b"xref", at + 4)
    return out


def _table_rows(data: bytes, starts: list[int]) -> Iterator[tuple]:
    """(section, num, gen, offset, container, index) of the entries in use of all tables; section 0 is the first in the file. starts: where their runs begin."""
    for section, at in enumerate(starts):
        while run := TABLE_RUN.match(data, at):
            at = run.end()
            first, count = int(run[1]), int(run[2])
            if count and _TABLE_LINES.match(data, at, at + 20 * count).end() == at + 20 * count:
                for i, line in enumerate(TABLE_LINE.findall(data, at, at + 20 * count)):
                    if line[2] == b"n":
                        yield section, first + i, int(line[1]), int(line[0]), None, None
                at += 20 * count
                continue
            for i in range(count):
                line = TABLE_LINE.match(data, at)
                if not line:
                    break
                at = line.end()
                if line[3] == b"n":
                    yield section, first + i, int(line[2]), int(line[1]), None, None


def xref_stream_rows(row: dict) -> list[tuple[int, int, int, int]]:
    """(num, type, second, third field) of a cross-reference stream; ValueError says what is wrong with it."""
    entries = row["entries"]
    chain = chain_names(entries.get("Filter"))
    parms, wrong = parameters(entries, chain)
    if wrong:
        raise ValueError(wrong)
    data = decode(row["raw"], chain, parms)
    numbers = lambda key: [int(x) for kind, x in items(entries.get(key)) if kind == "word" and re.fullmatch(r"-?\d+", x)]
    widths = numbers("W")
    if len(widths) != 3 or not all(0 <= w <= 8 for w in widths) or not sum(widths):
        raise ValueError("no usable /W")
    index = numbers("Index") if "Index" in entries else [0, int(entries.get("Size", "-1"))]
    if len(index) % 2 or any(x < 0 for x in index):
        raise ValueError("no usable /Index or /Size")
    out, at = [], 0
    for first, count in zip(index[::2], index[1::2], strict=True):
        if at + count * sum(widths) > len(data):
            raise ValueError("data ends before all entries")
        for i in range(count):
            fields = []
            for w in widths:
                fields.append(int.from_bytes(data[at : at + w], "big"))
                at += w
            kind = fields[0] if widths[0] else 1
            if kind > 2:
                raise ValueError(f"entry of unknown type {kind}")
            out.append((first + i, kind, *fields[1:]))
    if data[at:].strip(SPACE):
        raise ValueError("trailing data")
    return out


def _of_type(every: list[dict], kind: str) -> list[dict]:
    return [r for r in every if r["raw"] is not None and r["entries"].get("Type") == kind]


def _reference_rows(data: bytes, starts: list[int], streams_: list[dict]) -> tuple[list[tuple], str | None]:
    """The entries of tables and cross-reference streams, and what is wrong with the streams."""
    rows, error = list(_table_rows(data, starts)), None
    tables = 1 + max((r[0] for r in rows), default=-1) if streams_ else 0
    for i, row in enumerate(streams_):
        try:
            for num, kind, a, b in xref_stream_rows(row):
                if kind:
                    rows.append((tables + i, num, b, a, None, None) if kind == 1 else (tables + i, num, 0, row["offset"], a, b))
        except (ValueError, KeyError, zlib.error) as e:
            error = error or f"cross-reference stream: {e}"
    return rows, error


def references_of(data: bytes, every: list[dict] | None = None) -> tuple[list[tuple], dict]:
    """The entries of tables and cross-reference streams, and what there is of them; every: all objects, where they are known already."""
    if every is None:
        every = list(_found(data)) if b"/XRef" in data or b"/ObjStm" in data else []
    last, streams_ = table_starts(data), _of_type(every, "/XRef")
    rows, error = _reference_rows(data, last, streams_)
    hybrid = trailer(data, []).get("XRefStm") if b"trailer" in data else None
    if hybrid is not None and not (hybrid.isdigit() and int(hybrid) in {r["offset"] for r in streams_}):
        error = error or "/XRefStm is not the place of a cross-reference stream"
    offset = data.rfind(b"xref", 0, last[-1]) if last else None
    return rows, {"has_table": bool(last), "has_stream": bool(streams_), "has_hybrid": hybrid is not None, "has_object_stream": bool(_of_type(every, "/ObjStm")), "table_offset": offset, "error": error}


def _as_written(data: bytes, every: list[dict]) -> bool:
    """Whether the file has the one table that canonical() writes for these objects, and a root; what hasn't may be sound too."""
    entries = {r["num"]: (r["offset"], r["gen"]) for r in every if r["shape"] is not None and r["container"] is None}
    at = data.rfind(b"trailer")
    if not entries or len(entries) < len(every) or at < 0 or data.count(b"xref") != 2 or data.find(b"startxref", at) < 0:
        return False
    table = cross_references(entries)
    root = reference(_trailer_value(data, at + 7).get("Root"))
    return data.startswith(b"\n" + table, at - len(table) - 1) and root is not None and root[0] in entries and b"%%EOF" in data


def sound(data: bytes, every: list[dict]) -> bool:
    """Whether the cross references lead to every object of every (those in force), nowhere else, and the trailer to a root that is there."""
    if _as_written(data, every):
        return True
    of_xref = {r["num"] for r in _of_type(every, "/XRef")}
    there = [r for r in every if r["raw"] is None or r["entries"].get("Type") != "/XRef"] if of_xref else every
    listed: dict[int, tuple] = {}
    streams_ = _of_type(list(_found(data)), "/XRef") if b"/XRef" in data else []
    for section, num, _, offset, container, _ in _reference_rows(data, table_starts(data), streams_)[0]:
        if num not in listed or section >= listed[num][0]:
            listed[num] = (section, offset, container)
    numbers = {r["num"] for r in there}
    judged = [r for r in there if r["num"] not in of_xref] if of_xref else there
    if not judged or not listed.keys() <= numbers | of_xref:
        return False
    for r in judged:
        _, offset, container = listed.get(r["num"], (None, None, None))
        if container != r["container"] if r["container"] is not None else offset != r["offset"]:
            return False
    root = re.match(r"\d+", trailer(data, [] if b"trailer" in data else every).get("Root", ""))
    return root is not None and int(root[0]) in numbers and b"%%EOF" in data


def _sound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        held = [sound(data or b"", document_objects(data or b"")) for data in batch.column("content").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(held, pa.bool_())], ["doc_id", "sound"])


def reachable(docs: DataFrame) -> DataFrame:
    """doc_id, sound of each document; see sound()."""
    return docs.select("doc_id", "content").mapInArrow(_sound, "doc_id string, sound boolean")


def _xref(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = (pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
    for batch in batches:
        rows = [(doc_id, *r) for doc_id, data in zip(batch.column("doc_id").to_pylist(), batch.column("content").to_pylist(), strict=True) for r in references_of(data or b"")[0]]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), *(pa.array([r[i + 1] for r in rows], k) for i, k in enumerate(kinds))], ["doc_id", "section", "num", "gen", "offset", "container", "index"])


def xref_entries(docs: DataFrame) -> DataFrame:
    """doc_id, section, num, gen, offset, container, index: entries in use, tables first, then streams; container and index of those in object streams."""
    return docs.select("doc_id", "content").mapInArrow(_xref, "doc_id string, section int, num long, gen int, offset long, container long, index long")


_SUMMARY = {"has_table": pa.bool_(), "has_stream": pa.bool_(), "has_hybrid": pa.bool_(), "has_object_stream": pa.bool_(), "table_offset": pa.int64(), "error": pa.string()}
_SUMMARY_COLUMNS = "has_table boolean, has_stream boolean, has_hybrid boolean, has_object_stream boolean, table_offset long, error string"


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [references_of(data or b"")[1] for data in batch.column("content").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array([f[k] for f in found], t) for k, t in _SUMMARY.items())], ["doc_id", *_SUMMARY])


def xref_summary(docs: DataFrame) -> DataFrame:
    """doc_id, has_table, has_stream, has_hybrid, has_object_stream, table_offset (of the last), error of each document's cross references."""
    return docs.select("doc_id", "content").mapInArrow(_summaries, f"doc_id string, {_SUMMARY_COLUMNS}")


def places(data: bytes) -> dict | None:
    """How many objects are in force and where they stand, with what references_of() says of the cross references; None without objects."""
    every = list(_found(data))
    summary = references_of(data, every)[1]
    force = revisions_and_objects(data, every)[1]
    if not force:
        return None
    inside = sum(r["container"] is not None for r in force)
    xref = sum(r["container"] is None and r["raw"] is not None and r["entries"].get("Type") == "/XRef" for r in force)
    return {"total": len(force), "normal": len(force) - inside - xref, "in_object_streams": inside, "xref_streams": xref} | summary


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = dict.fromkeys(("total", "normal", "in_object_streams", "xref_streams"), pa.int64()) | _SUMMARY
    for batch in batches:
        found = [(doc_id, p) for doc_id, data in zip(batch.column("doc_id").to_pylist(), batch.column("content").to_pylist(), strict=True) if (p := places(data or b"")) is not None]
        yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in found], pa.string()), *(pa.array([p[k] for _, p in found], t) for k, t in kinds.items())], ["doc_id", *kinds])


def object_places(docs: DataFrame) -> DataFrame:
    """doc_id, total, normal, in_object_streams, xref_streams and what xref_summary() says, of each document that has objects, which is parsed once."""
    return docs.select("doc_id", "content").mapInArrow(_placed, f"doc_id string, total long, normal long, in_object_streams long, xref_streams long, {_SUMMARY_COLUMNS}")
