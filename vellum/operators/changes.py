"""Changes of forms, notes, pages and XML data: planned as columns, written by rewrite(), read back and compared."""

from __future__ import annotations

import re
import xml.parsers.expat
from collections import Counter
from collections.abc import Callable, Iterator
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.operators.documents import numbers, transformed
from vellum.operators.graph import Nodes, annotations, has_bit, may_be_filled, name, option_list, pages, target, walk_fields
from vellum.operators.rewrite import anew, reachable, rewritten
from vellum.operators.xfa import DATA, document_packets, kind_of, may_be_edited, packet_facts
from vellum.plans.staging import stage_documents as stage
from vellum.sources.mint import raw_literal
from vellum.sources.scan import document_objects, entry, objects, sound
from vellum.sources.syntax import items, literal_of


def verified(plans: DataFrame, written: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """plans(doc_id, *keys, expected, status) with content where the written document is sound and says what was expected; else verification_failed."""
    whole = written if "sound" in written.columns else written.join(reachable(written), "doc_id", "left")
    got = plans.join(whole, "doc_id", "left").join(after, ["doc_id", *keys], "left")
    fine = F.coalesce(F.col("sound") & F.col("error").isNull() & F.col("found").eqNullSafe(F.col("expected")), F.lit(False))
    status = F.when((F.col("status") == "ok") & ~fine, "verification_failed").otherwise(F.col("status"))
    return got.select("doc_id", *keys, status.alias("status"), F.when(status == "ok", F.col("content")).alias("content"))


def is_redrawn(nodes: Nodes) -> bool:
    """Whether viewers are told to draw the fields anew."""
    return any(e.get("AcroForm/NeedAppearances", e.get("NeedAppearances")) == "true" for e in nodes.values())


def _redrawn(nodes: Nodes) -> dict[int, dict[str, str]]:
    """What is set, by object, to tell viewers to draw a document's fields anew."""
    sets: dict[int, dict[str, str]] = {}
    for num, own in nodes.items():
        if "Root!" in own or own.get("Type") == "/Catalog":
            raw = own.get("AcroForm")
            if (form := target(raw)) is not None:
                sets.setdefault(form, {})["NeedAppearances"] = "true"
            elif raw is not None:
                there = "AcroForm/NeedAppearances" in own
                sets.setdefault(num, {})["AcroForm"] = re.sub(r"/NeedAppearances\s+\w+", "/NeedAppearances true", raw) if there else re.sub(r">>$", " /NeedAppearances true >>", raw)
    return sets


def set_fields(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """doc_id, name, status, content: fields of documents set: wanted(doc_id, name, value), name whole.

    Text is set as it is. A choice takes an option's export or display text that is the only one of its kind, or any
    text where it can be edited; several, where it allows that, as a JSON array. A button takes the name of one of its
    states, or Off. Kids, and a parent of one kid, follow (see _kids()). Wishes that would change one object twice are
    all refused before anything is written: conflicting_changes. Viewers are told to draw the fields anew; that, the
    values, and all exports and indexes of a multiple choice must be found in what was written.
    """
    several = F.when(F.ltrim("value").startswith("["), F.from_json("value", "array<string>"))
    wishes = wanted.groupBy("doc_id").agg(F.collect_list(F.struct("name", "value", several.alias("several"))).alias("wishes"))
    held = docs.select("doc_id", "content").join(wishes.hint("merge"), "doc_id", "right")
    return held.select("doc_id", "content", "wishes").mapInArrow(lambda b: met(b, "name", _with_fields), "doc_id string, name string, status string, content binary")


def met(batches: Iterator[pa.RecordBatch], key: str, meet: Callable[[bytes, list[dict]], list[tuple[str, bytes | None]]]) -> Iterator[pa.RecordBatch]:
    """doc_id, key, status and new bytes for each of the wishes that documents come with."""
    kinds = {"doc_id": pa.string(), key: pa.string(), "status": pa.string(), "content": pa.binary()}
    for batch in batches:
        out = [(d, w[key], *told) for d, c, wishes in zip(*(batch.column(k).to_pylist() for k in ("doc_id", "content", "wishes")), strict=True) for w, told in zip(wishes, meet(c or b"", wishes), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate(kinds.values())], list(kinds))


def numbers_of(raw: str | None) -> list[int]:
    return [int(n) for n in re.findall(r"(\d+)\s+\d+\s+R\b", raw or "")]


def raw_text(text: str | None) -> str | None:
    return None if text is None else literal_of(text.encode()).decode("latin-1")


def field_value(own: dict[str, str]) -> str | tuple | None:
    """A field's value: a text or a name, or the texts of a list with their indexes."""
    raw = own.get("V", "")
    if raw.startswith("["):
        return [x for kind, x in items(raw) if kind == "text"], [int(n) for n in re.findall(r"\d+", own.get("I", ""))]
    return own.get("V=", raw[1:] or None if raw[:1] == "/" else None)


def _wish(field: tuple, wish: dict) -> tuple:
    """Status, raw value, what is expected, further entries of the field's own object: one wish for one field that is there."""
    _, _, _, kind, own, flags, _, blockers, states, proof, _ = field
    asked, choice, multi = wish["value"], kind == "Ch", kind == "Ch" and has_bit(flags, 22)
    choices = option_list(own.get("Opt")) if choice else []
    if not may_be_filled(own, kind, flags, blockers, choices, proof):
        return "not_fillable", None, None, {}
    listed = wish["several"] if multi else [asked]
    if listed is None:
        return "not_a_list", None, None, {}
    if multi and len(set(listed)) < len(listed):
        return "value_twice", None, None, {}
    found = [[(i, export) for i, (export, display) in enumerate(choices) if v is not None and v in (export, display)] for v in listed]
    picked = sorted(x for m in found if len(m) == 1 for x in m)
    whole = choice and len(picked) == len(listed)
    if choice and not whole and (multi or not has_bit(flags, 19)):
        return "no_such_option", None, None, {}
    exports, indexes = [e for _, e in picked], [i for i, _ in picked]
    if multi:
        return "ok", "[" + " ".join(map(raw_text, exports)) + "]", (exports, indexes), {"I": "[" + " ".join(map(str, indexes)) + "]"}
    if choice:
        export = exports[0] if whole else asked
        return "ok", raw_text(export), export, {}
    if kind != "Btn":
        return "ok", raw_text(asked), asked, {}
    state, kids = "Off" if asked in OFF else asked, numbers_of(own.get("Kids"))
    if not kids and asked is not None and asked not in OFF and asked not in states:
        return "no_such_state", None, None, {}
    raw = None if state is None else f"/{state}"
    return "ok", raw, state, {} if kids else {"AS": raw}


#: What turns a button off.
OFF = ("Off", "false")


def _kids(nodes: Nodes, field: tuple, asked: str | None, raw: str | None) -> tuple[list[tuple[int, dict]], str | None]:
    """What a wish changes in the kids of a field and in a parent that has it alone, and the first error.

    Text and choices are set in kids that are unnamed widgets or have the field's own name; of radio buttons the kid
    with the state asked for is on and the others off.
    """
    _, num, name, kind, own, *_ = field
    kids, button, off = numbers_of(own.get("Kids")), kind == "Btn", asked in OFF
    on = {k: list(dict.fromkeys(x[5:] for x in nodes.get(k, {}) if re.fullmatch(r"AP/N/[^/=#!]+", x) and x != "AP/N/Off")) for k in kids} if button else {}
    hit = sum(on[k][:1] == [asked] for k in kids) if button else 0
    out, errors = [], []
    for k in kids:
        there, error = nodes.get(k), None
        if there is None:
            error = "unresolved_kid"
        elif button:
            if len(on[k]) != 1 or asked in ("", "true", "On"):
                error = "ambiguous_button_states"
            elif not off and hit != 1:
                error = "duplicate_button_state" if hit else "no_such_state"
        elif "Kids" in there:
            error = "kids_of_kids"
        elif "T=" not in there and there.get("Subtype") != "/Widget":
            error = "unnamed_kid_is_no_widget"
        elif "T=" in there and there["T="] not in (own.get("T="), name):
            error = "other_kid_name"
        errors += [error] if error else []
        out.append((k, {"AS": f"/{asked}" if not off and on[k][:1] == [asked] else "/Off"} if button else {"V": raw}))
    above = numbers_of(own.get("Parent"))[:1]
    if not button and not kids and above and above[0] in nodes and numbers_of(nodes[above[0]].get("Kids")) == [num] and "FT" in nodes[above[0]]:
        out.append((above[0], {"V": raw}))
    return out, min(errors, default=None)


def _with_fields(content: bytes, wishes: list[dict]) -> list[tuple[str, bytes | None]]:
    """Status and new bytes for each wish of set_fields() of one document, which is planned, written and read back here."""
    objs = document_objects(content)
    nodes = {r["num"]: r["entries"] for r in objs}
    fields: dict[str, list[tuple]] = {}
    for field in walk_fields(nodes):
        fields.setdefault(field[2], []).append(field)
    states, expected, plans = [], [], []
    for w in wishes:
        own = fields.get(w["name"], ())
        status, raw, want, more = _wish(own[0], w) if len(own) == 1 else ("ambiguous_field" if own else "no_field", None, None, {})
        changed: list[tuple[int, dict]] = []
        if status == "ok":
            changed, error = _kids(nodes, own[0], w["value"], raw)
            changed.append((own[0][1], {"V": raw} | more))
            status = error or status
        states.append(status)
        expected.append(want)
        plans.append(changed if status == "ok" else [])
    often = Counter(num for plan in plans for num, _ in plan)
    states = ["conflicting_changes" if any(often[num] > 1 for num, _ in plan) else s for s, plan in zip(states, plans, strict=True)]
    if "ok" not in states:
        return [(s, None) for s in states]
    sets = _redrawn(nodes)
    for status, plan in zip(states, plans, strict=True):
        for num, own in plan if status == "ok" else ():
            sets[num] = sets.get(num, {}) | own
    written, error = anew(objs, [{"num": n, "sets": own} for n, own in sets.items()])
    again = document_objects(written)
    after = {r["num"]: r["entries"] for r in again}
    found = {f[2]: field_value(f[4]) for f in walk_fields(after)}
    fine = error is None and is_redrawn(after) and sound(written, again)
    return [(s, None) if s != "ok" else ("ok", written) if fine and w["name"] in found and found[w["name"]] == want else ("verification_failed", None) for s, w, want in zip(states, wishes, expected, strict=True)]


def set_contents(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """doc_id, annotation_index, status, content: a note's text set and its drawn form taken away: wanted(doc_id, annotation_index, contents).

    Notes that stand in a page's list itself, and those with rich text, are left alone.
    """
    rows = wanted.select("doc_id", "annotation_index", F.col("contents").alias("expected")).join(annotations(docs.select("doc_id", "content")).drop("contents"), ["doc_id", "annotation_index"], "left")
    status = F.when(F.col("subtype").isNull(), "no_annotation").when(F.col("num").isNull(), "direct_annotation").when(F.array_contains("appearance_blockers", "rich_text_content"), "rich_text").otherwise("ok")
    plans = stage(rows.select("doc_id", "annotation_index", "num", "expected", status.alias("status")))
    sets = F.create_map(F.lit("Contents"), raw_literal(F.col("expected")), F.lit("AP"), F.lit(None).cast("string"))
    written = stage(rewritten(docs, plans.where("status = 'ok'").select("doc_id", "num", sets.alias("sets"))))
    after = annotations(written).select("doc_id", "annotation_index", F.col("contents").alias("found"))
    return verified(plans.drop("num"), written, after, ["annotation_index"])


def transform_pages(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """doc_id, status, content: pages turned, cropped and scaled: wanted(doc_id, page_index, turn, crop array<double>, scale), what is null stays.

    A document with a wish that can't be met is left alone; status is the first reason. A scaled page's content must
    be unfiltered and its own: it is wrapped in the matrix.
    """
    objs = stage(objects(docs).select("doc_id", "num", "entries", F.when(F.col("raw").isNotNull(), F.lit(True)).alias("raw")))
    asked = pages(docs.select("doc_id", "content")).join(wanted.select("doc_id", "page_index", "turn", "crop", "scale"), ["doc_id", "page_index"])
    size = F.coalesce("scale", F.lit(1.0))
    rows = transformed(asked, F.coalesce("turn", F.lit(0)), F.col("crop"), size).withColumn("old_box", numbers(F.col("media_box")))
    content = objs.where("raw is not null").select("doc_id", F.col("num").alias("c"), (F.size(F.regexp_extract_all(F.coalesce(entry("Filter"), F.lit("")), F.lit(r"/(\w+)"))) > 0).alias("filtered"))
    listed = objs.where(name("Type") == "Page").select("doc_id", "num", F.explode(F.transform(F.regexp_extract_all(F.coalesce(entry("Contents"), F.lit("")), F.lit(r"(\d+)\s+\d+\s+R\b"), F.lit(1)), lambda x: x.cast("int"))).alias("c"))
    scaled = rows.where(size != 1.0).select("doc_id", "num", size.alias("s")).join(listed, ["doc_id", "num"]).join(content, ["doc_id", "c"])
    users = listed.groupBy("doc_id", "c").agg(F.count(F.lit(1)).alias("users"))
    scaled = stage(scaled.join(users, ["doc_id", "c"]))
    bad = scaled.groupBy("doc_id").agg(F.max("filtered").alias("filtered"), F.max("users").alias("users"))
    errors = rows.groupBy("doc_id").agg(F.min("error").alias("error")).join(bad, "doc_id", "left")
    plans = stage(errors.select("doc_id", F.when(F.col("error").isNotNull(), F.col("error")).when(F.col("filtered"), "filtered content can't be scaled").when(F.col("users") > 1, "content is shared").otherwise("ok").alias("status")))
    good = plans.where("status = 'ok'").select("doc_id")
    box = lambda c: F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: F.regexp_replace(x.cast("string"), r"\.0$", "")), " "), F.lit("]"))
    sets = F.map_filter(F.create_map(F.lit("Rotate"), F.col("rotate").cast("string"), F.lit("MediaBox"), F.when(size != 1.0, box(F.transform("old_box", lambda x: x * size))), F.lit("CropBox"), F.when(F.col("crop").isNotNull(), box(F.col("box")))), lambda _, v: v.isNotNull())
    own = rows.join(good, "doc_id", "left_semi").select("doc_id", "num", sets.alias("sets"), F.lit(None).cast("binary").alias("before"))
    before = F.concat(F.lit("q "), F.col("s").cast("string"), F.lit(" 0 0 "), F.col("s").cast("string"), F.lit(" 0 0 cm\n")).cast("binary")
    wrapped = scaled.join(good, "doc_id", "left_semi").select("doc_id", F.col("c").alias("num"), F.lit(None).cast("map<string,string>").alias("sets"), before.alias("before"))
    written = stage(rewritten(docs, own.unionByName(wrapped), lambda old, w: w["before"] + old + b"\nQ"))
    got = plans.join(written, "doc_id", "left")
    status = F.when((F.col("status") == "ok") & ~F.coalesce(F.col("sound"), F.lit(False)), "verification_failed").otherwise(F.col("status"))
    return got.select("doc_id", status.alias("status"), F.when(status == "ok", F.col("content")).alias("content"))


#: A tag to its end; a quoted value may hold what ends one elsewhere.
_TAG = re.compile(rb"<(?:[^>\"']|\"[^\"]*\"|'[^']*')*>", re.S)


def _with_value(data: bytes, path: str, new: str) -> bytes | None:
    """XML with the text of the leaf at a path of data replaced; None unless there is exactly one."""
    stack: list[list] = []
    found: list[tuple[int, int]] = []
    parser = xml.parsers.expat.ParserCreate()

    def begin(tag, _):
        local = tag.rpartition(":")[2]
        up = stack[-1] if stack else ["", [], False, 0]
        up[2] = True
        own = up[1] if local == "datasets" or (local == "data" and up[0] == "datasets") else [*up[1], local]
        stack.append([local, own, False, _TAG.match(data, parser.CurrentByteIndex).end()])

    def end(_):
        _, own, inner, start = stack.pop()
        if not inner and ".".join(own) == path and data[start - 2 : start - 1] != b"/":
            found.append((start, parser.CurrentByteIndex))

    parser.StartElementHandler, parser.EndElementHandler = begin, end
    parser.Parse(data, True)
    if len(found) != 1:
        return None
    (a, b), text = found[0], escape(new).encode()
    return data[:a] + text + data[b:]


def set_data(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """doc_id, path, status, content: a leaf of the XML data set: wanted(doc_id, path, value); only in forms that need no renderer."""
    wishes = wanted.groupBy("doc_id").agg(F.collect_list(F.struct("path", "value")).alias("wishes"))
    held = docs.select("doc_id", "content").join(wishes.hint("merge"), "doc_id", "right")
    return held.select("doc_id", "content", "wishes").mapInArrow(lambda b: met(b, "path", _with_data), "doc_id string, path string, status string, content binary")


def _leaves(held: list[tuple]) -> dict[str, list[tuple]]:
    """(packet, value) of the leaves of data, by path, of packets as document_packets() gives them and what is in each."""
    found: dict[str, list[tuple]] = {}
    for (packet, label, *_), told in held:
        if kind_of(label, told) in DATA and not told["unsafe"] and told["error"] is None:
            for path, value in told["fields"]:
                found.setdefault(path, []).append((packet, value))
    return found


def _with_data(content: bytes, wishes: list[dict]) -> list[tuple[str, bytes | None]]:
    """Status and new bytes for each wish of set_data() of one document, which is planned, written and read back here."""
    objs = document_objects(content)
    held = [(p, packet_facts(p[4] or b"")) for p in document_packets(objs)]
    there, parts = _leaves(held), {p[0]: p for p, _ in held}
    editable = may_be_edited([(kind_of(p[1], told), p[3], told) for p, told in held])
    states, changed = [], {}
    for w in wishes:
        at = there.get(w["path"], ())
        num = parts[at[0][0]][2] if at else None
        state = "not_editable" if not editable else "no_field" if not at else "ambiguous_field" if len(at) > 1 else "not_a_stream" if num is None else "ok"
        states.append(state)
        if state == "ok":
            data = changed.get(num, parts[at[0][0]][4])
            changed[num] = _with_value(data, w["path"], w["value"]) or data
    if not changed:
        return [(s, None) for s in states]
    written, error = anew(objs, [{"num": n, "data": d} for n, d in changed.items()])
    again = document_objects(written)
    # The packets that were not changed say what they said.
    found = _leaves([(p, packet_facts(p[4] or b"")) for p in document_packets(again) if p[2] in changed])
    fine = error is None and sound(written, again)
    return [(s, None) if s != "ok" else ("ok", written) if fine and found.get(w["path"], [(None, None)])[0][1] == w["value"] else ("verification_failed", None) for s, w in zip(states, wishes, strict=True)]
