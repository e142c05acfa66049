"""Documents written anew with some of their objects changed, and proof that a reader finds every object where the file says."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions.codecs import chain_names, encode
from vellum.operators.graph import name
from vellum.sources.mint import document
from vellum.sources.scan import document_objects, entry, reachable, references, sound, stream_bytes  # noqa: F401
from vellum.sources.syntax import rebuilt
from vellum.sources.write import canonical, packed

CHANGES = "doc_id string, num int, sets map<string,string>, data binary"
_BODY = "doc_id string, num int, gen int, body binary, error string"


def _body(head: str | None, entries: dict, raw: bytes | None, parms: list | None, changes: dict, data: bytes | None) -> tuple[bytes, str | None]:
    """An object as it is to be written, and what is wrong with that."""
    error = None
    if data is not None and raw is not None and changes.pop("Raw!", None):
        raw = data
    elif data is not None and raw is not None:
        try:
            raw = encode(data, chain_names(changes.get("Filter", entries.get("Filter"))), [dict(p) for p in parms] if parms and "Filter" not in changes else None)
        except (KeyError, ValueError) as e:
            error = f"can't be encoded: {e}"
    if raw is None:
        return (rebuilt(entries, changes) if changes else head or "null").encode("latin-1", "replace"), error
    return rebuilt(entries, changes | {"Length": str(len(raw))}).encode("latin-1", "replace") + b"\nstream\n" + raw + b"\nendstream", error


def _bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each object as it is to be written: head or changed dictionary, and stream."""
    for batch in batches:
        out, errors = [], []
        for head, entries, raw, parms, sets, data in zip(*(batch.column(c).to_pylist() for c in ("head", "entries", "raw", "parms", "sets", "data")), strict=True):
            body, error = _body(head, dict(entries or ()), raw, parms, dict(sets or ()), data)
            out.append(body)
            errors.append(error)
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "num", "gen")), pa.array(out, pa.binary()), pa.array(errors, pa.string())], ["doc_id", "num", "gen", "body", "error"])


def rewrite(objs: DataFrame, changes: DataFrame, every: bool = False, pack: bool = False) -> DataFrame:
    """doc_id, content, error: the documents that changes(doc_id, num, sets, data) has rows for, or every one, written anew.

    sets: raw values by key, null to take a key away; data: a stream's new content, encoded as its filters say, or as it is
    where sets has `Raw!`. At most one change an object. Objects of object streams stand for themselves afterwards, unless packed again; the root,
    /Info and /ID of the trailer stay.
    """
    kept = objs.where(~((name("Type").isin("ObjStm", "XRef")) & F.col("raw").isNotNull()))
    if not every:
        kept = kept.join(changes.select("doc_id").distinct(), "doc_id", "left_semi")
    rows = kept.select("doc_id", "num", "gen", "head", "entries", "raw", "parms").join(changes.select("doc_id", "num", "sets", "data"), ["doc_id", "num"], "left")
    bodies = rows.select("doc_id", "num", "gen", "head", "entries", "raw", "parms", "sets", "data").mapInArrow(_bodies, _BODY)
    grouped = bodies.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("num", "gen", "body"))).alias("objects"), F.max("error").alias("error"))
    extra = F.concat(*[F.coalesce(F.concat(F.lit(f" /{k} "), entry(f"Trailer!{k}")), F.lit("")) for k in ("Info", "ID")])
    top = kept.where(entry("Root!").isNotNull() | (name("Type") == "Catalog")).select("doc_id", F.struct(F.when(entry("Root!").isNotNull(), 0).otherwise(1).alias("n"), "num", extra.alias("extra")).alias("t"))
    top = top.groupBy("doc_id").agg(F.min("t").alias("t"))
    joined = grouped.join(top, "doc_id", "left")
    return joined.select("doc_id", document(F.col("objects"), F.coalesce("t.num", F.lit(1)), F.coalesce("t.extra", F.lit("")), pack).alias("content"), "error")


def anew(objs: list[dict], wishes: list[dict], of: Callable[[bytes, dict], bytes | None] | None = None, pack: bool = False) -> tuple[bytes | None, str | None]:
    """A document's bytes with its wishes met, and the greatest error; no bytes of what holds no objects."""
    by_number = {w["num"]: w for w in wishes}
    bodies, errors, tops = [], [], []
    for r in objs:
        kind = r["entries"].get("Type")
        if r["raw"] is not None and kind in ("/ObjStm", "/XRef"):
            continue
        wish = by_number.get(r["num"], {})
        new = wish.get("data")
        if of is not None and wish and new is None and r["raw"] is not None and (old := stream_bytes(r)[0]) is not None:
            new = of(old, wish)
        body, error = _body(r["head"], r["entries"], r["raw"], r.get("parms"), dict(wish.get("sets") or ()), new)
        bodies.append((r["num"], r["gen"], body))
        errors += [error] if error else []
        if "Root!" in r["entries"] or kind == "/Catalog":
            extra = "".join(f" /{k} {r['entries'][f'Trailer!{k}']}" for k in ("Info", "ID") if f"Trailer!{k}" in r["entries"])
            tops.append(("Root!" not in r["entries"], r["num"], extra))
    _, root, extra = min(tops, default=(True, 1, ""))
    return (packed if pack else canonical)(sorted(bodies), f"/Root {root} 0 R {extra}") if bodies else None, max(errors, default=None)


def rewritten(docs: DataFrame, changes: DataFrame, of: Callable[[bytes, dict], bytes | None] | None = None, pack: bool = False) -> DataFrame:
    """doc_id, content, error, sound, loose: rewrite() of documents, each parsed and written where it meets its changes; objects are not shuffled.

    changes(doc_id, num and any of sets, data): as there. of: makes a stream's new content of the old one and of the row of
    changes as a dictionary, where that has no data. What is written is read again: sound says whether its references lead to
    all objects, loose how many lead to none. One row of docs a document.
    """
    kinds = {"doc_id": pa.string(), "content": pa.binary(), "error": pa.string(), "sound": pa.bool_(), "loose": pa.int64()}

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for doc_id, data, wishes in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "content", "wishes")), strict=True):
                made, error = anew(document_objects(data or b""), wishes, of, pack)
                if made is not None:
                    again = document_objects(made)
                    here = {r["num"] for r in again}
                    out.append((doc_id, made, error, sound(made, again), sum(n not in here for r in again for n in references(r["head"]))))
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate(kinds.values())], list(kinds))

    wishes = changes.groupBy("doc_id").agg(F.collect_list(F.struct(*[c for c in changes.columns if c != "doc_id"])).alias("wishes"))
    return docs.select("doc_id", "content").join(wishes, "doc_id").select("doc_id", "content", "wishes").mapInArrow(write, "doc_id string, content binary, error string, sound boolean, loose long")


def change(doc_id: Column, num: Column, sets: Column | None = None, data: Column | None = None) -> list[Column]:
    """The columns of a change."""
    none = F.lit(None)
    return [doc_id.alias("doc_id"), num.alias("num"), (none.cast("map<string,string>") if sets is None else sets).alias("sets"), (none.cast("binary") if data is None else data).alias("data")]
