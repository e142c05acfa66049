"""The node table of documents and selectors over it.

What a text-show says depends on its document's pages, forms and fonts, so a document is read at once, where it lies;
nothing is shuffled for it. Everything after that is columns.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions.codecs import REVERSIBLE, chain_names, decode, parameters
from vellum.functions.content import text_shows
from vellum.functions.fonts import cmap, encoding, one_text, widths
from vellum.operators.graph import below, page_list, refs_in, target
from vellum.sources.scan import FILTERS, document_objects, document_shape, found_objects, name, objects, references, revisions_and_objects, sound, streams
from vellum.sources.syntax import KEPT, items

DOCUMENT, STREAM, TEXT = "pdf.document", "pdf.stream", "pdf.content.text_show"
#: Forms within forms that are followed.
FORM_DEPTH = 4


def cmap_of(data: Column) -> Column:
    """The character map that a stream's bytes hold: code in hex digits -> text."""

    @F.pandas_udf("map<string,string>")
    def apply(data: pd.Series) -> pd.Series:
        return data.map(lambda d: None if d is None else cmap(bytes(d)))

    return apply(data)


class Texts:
    """The text-shows of one document: its streams in the order in which pages show them, decoded as their fonts say."""

    def __init__(self, data: bytes, objects: list[dict] | None = None):
        self.rows = {r["num"]: r for r in (document_objects(data) if objects is None else objects)}
        self.nodes = {n: r["entries"] for n, r in self.rows.items()}
        self.read: dict[int, bytes | None] = {}
        self.known: dict[int, dict] = {}
        self.pages = list(page_list(self.nodes))
        maps = [m for e in self.nodes.values() if "ToUnicode" in e and (to := target(e.get("ToUnicode"))) is not None and (m := cmap(self.stream(to) or b""))]
        self.single = maps[0] if len(maps) == 1 else None

    def stream(self, num: int) -> bytes | None:
        """A stream's decoded bytes; None if it is none, or can't be read."""
        if num not in self.read:
            row, out = self.rows.get(num), None
            if row is not None and row["raw"] is not None and row["entries"].keys().isdisjoint(FILTERS):
                out = row["raw"]
            elif row is not None and row["raw"] is not None:
                chain = chain_names(row["entries"].get("Filter"))
                parms, wrong = parameters(row["entries"], chain)
                try:
                    out = None if wrong or not set(chain) <= set(REVERSIBLE) else decode(row["raw"], chain, parms)
                except Exception:  # whatever is wrong with the data, it has no text  # noqa: BLE001
                    out = None
            self.read[num] = out
        return self.read[num]

    def fonts(self, owner: int | None) -> dict[str, tuple]:
        """(character map, characters by code, widths, number) by name of the fonts that an object's resources list."""
        if owner not in self.known:
            own = below(self.nodes, below(self.nodes, self.nodes.get(owner, {}), "Resources"), "Font")
            self.known[owner] = {key: self.font(own, key) for key in own if not set(key) & set("/=#!")}
        return self.known[owner]

    def font(self, listed: dict[str, str], key: str) -> tuple:
        own = below(self.nodes, listed, key)
        other = self.nodes.get(target(own.get("Encoding")))
        if other is not None:
            own = {k: v for k, v in own.items() if not k.startswith("Encoding")} | {"Encoding": "<<>>"} | {f"Encoding/{k}": v for k, v in other.items()}
        map_ = cmap(self.stream(target(own.get("ToUnicode")) or -1) or b"") or (self.single if "Encoding" not in own else None)
        child = self.nodes.get(next((int(n) for kind, n in items(own.get("DescendantFonts")) if kind == "ref"), -1), {})
        wide = child.get("W") if own.get("Subtype") == "/Type0" else own.get("Widths")
        if (at := target(wide)) is not None:
            wide = self.rows[at]["head"] if at in self.rows else None
        return map_ or None, encoding(own, items(own.get("Encoding/Differences"))), widths(own, child, items(wide)), target(listed.get(key))

    def contexts(self) -> Iterator[tuple]:
        """(stream, page index, page, owner of the resources, form, depth, whether they are inherited): pages by number, forms where they are invoked, the other streams last."""
        shown = set()
        for index, page, own in sorted(self.pages, key=lambda p: p[1]):
            if "resources_of" not in own:
                continue
            owner = int(own["resources_of"])
            for num in refs_in(self.nodes[page].get("Contents")):
                if self.nodes.get(num, {}).get("Subtype") != "/Image" and self.stream(num) is not None:
                    shown.add(num)
                    yield num, index, page, owner, None, 0, owner != page
                    yield from self.forms(num, index, page, owner, 1, (), shown)
        for num in sorted(self.rows):
            e = self.nodes[num]
            if num not in shown and e.get("Type") not in ("/ObjStm", "/XRef") and e.get("Subtype") != "/Image" and self.stream(num) is not None:
                yield num, None, None, None, None, 0, None

    def forms(self, num: int, index: int, page: int, owner: int, depth: int, above: tuple, shown: set) -> Iterator[tuple]:
        if depth > FORM_DEPTH:
            return
        if b"Do" not in self.stream(num):
            return
        listed = below(self.nodes, below(self.nodes, self.nodes.get(owner, {}), "Resources"), "XObject")
        for key in dict.fromkeys(codes.decode("latin-1") for op, codes, *_ in text_shows(self.stream(num)) if op == "Do"):
            form = target(listed.get(key))
            own = self.nodes.get(form, {})
            if form in above or own.get("Type") != "/XObject" or own.get("Subtype") != "/Form" or self.stream(form) is None:
                continue
            has = "Resources" in own
            shown.add(form)
            yield form, index, page, form if has else owner, form, depth, not has
            yield from self.forms(form, index, page, form if has else owner, depth + 1, (*above, form), shown)

    def texts(self, with_fonts: bool) -> Iterator[dict]:
        every = list(self.contexts())
        pages_of: dict[int, list[int]] = {}
        for c in every:
            if c[4] is not None:
                pages_of.setdefault(c[4], []).append(c[2])
        for place, (num, index, page, owner, form, depth, inherited) in enumerate(every):
            known = self.fonts(owner) if owner is not None else {}
            shared = pages_of.get(form, ()) if form is not None else ()
            for seq, (operator, codes, kind, start, end, s) in enumerate(text_shows(self.stream(num))):
                if operator == "Do":
                    continue
                map_, table, wide, font_num = known.get(s.font, (None, None, None, None))
                text, kind = one_text(codes, kind, map_, table)
                if text is None:
                    continue
                out = {"num": num, "seq": seq, "place": place, "text": text, "operator": operator, "encoding": kind, "start": start, "end": end, "font": s.font, "font_size": s.size, "x": s.x, "y": s.y, "render_mode": s.mode}
                out |= {"page_index": index, "page": page, "form": form, "depth": depth, "inherited": inherited, "font_num": font_num, "invocations": len(shared) if len(shared) > 1 else None, "invoked_pages": sorted(set(shared)) if len(shared) > 1 else None}
                if with_fonts:
                    wide = wide or ({}, None, 0)
                    out |= {"codes": codes, "cmap": list((map_ or {}).items()), "table": table, "widths": list(wide[0].items()), "other_width": wide[1], "code_size": wide[2]}
                yield out


#: What pages there are and which streams they show, by the shape of a document; documents of one origin have few shapes.
_PLANS: dict[tuple, tuple] = {}


class Pages:
    """A document's pages, and the texts that they show.

    count; content: whether each shows a stream that is there; resources: whether each has or inherits some; loose: references to
    objects that are not there. Of documents of one shape the tree is walked once.
    """

    def __init__(self, data: bytes):
        self.data, self.found = data, found_objects(data)
        key = document_shape(data, self.found)
        if key is not None and any(b"Do" in r["raw"] for r in self.found if r["raw"] is not None):
            key = None
        plan = _PLANS.get(key)
        self.every: list[dict] | None = None
        if plan is None:
            plan = self._plan()
            if key is not None:
                if len(_PLANS) >= KEPT:
                    _PLANS.clear()
                _PLANS[key] = plan
        self.count, self.content, self.resources, self.loose, self.shown = plan

    def _plan(self) -> tuple:
        self.every = revisions_and_objects(self.data, self.found)[1]
        texts = Texts(self.data, self.every)
        place = {id(r): i for i, r in enumerate(self.found)}
        there = {n for n, r in texts.rows.items() if r["raw"] is not None}
        content = all(any(n in there for n in _numbers(texts.nodes[num].get("Contents", ""))) for _, num, _ in texts.pages)
        resources = all("resources_of" in own for _, _, own in texts.pages)
        loose = sum(dst not in texts.nodes for r in self.every for dst in references(r["head"]))
        shown = [(place.get(id(texts.rows[num])), num, index, texts.fonts(owner) if owner is not None else {}) for num, index, _, owner, *_ in texts.contexts()]
        self.read = texts.stream
        return len(texts.pages), content, resources, loose, shown

    def sound(self) -> bool:
        return sound(self.data, list({(r["num"], r["gen"]): r for r in self.found}.values()) if self.every is None else self.every)

    def texts(self) -> Iterator[tuple[int | None, str]]:
        """(page index, text) of the text-shows in the order of text_rows()."""
        for at, num, index, known in self.shown:
            for operator, codes, kind, _, _, s in text_shows(self.found[at]["raw"] if self.every is None else self.read(num)):
                if operator != "Do":
                    map_, table, _, _ = known.get(s.font, (None, None, None, None))
                    text, _ = one_text(codes, kind, map_, table)
                    if text is not None:
                        yield index, text


def _numbers(raw: str) -> list[int]:
    return [int(n) for n in re.findall(r"(\d+)\s+\d+\s+R\b", raw)]


def _page_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[tuple] = []
        for doc_id, data in zip(batch.column("doc_id").to_pylist(), batch.column("content").to_pylist(), strict=True):
            own = Pages(data or b"")
            shown = sorted(((i, t) for i, t in own.texts() if i is not None), key=lambda x: x[0]) if own.count and own.sound() else []
            if shown:
                out.append((doc_id, [t for _, t in shown]))
        yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.list_(pa.string()))], ["doc_id", "texts"])


def page_texts(docs: DataFrame) -> DataFrame:
    """doc_id, texts: what the pages of docs(doc_id, content) show, page after page, of documents whose cross references lead to all objects.

    Texts that no page shows are left out, and so are documents without any others.
    """
    return docs.select("doc_id", "content").mapInArrow(_page_texts, "doc_id string, texts array<string>")


_TEXT = {
    "doc_id": pa.string(), "num": pa.int32(), "seq": pa.int32(), "place": pa.int32(), "text": pa.string(), "operator": pa.string(), "encoding": pa.string(), "start": pa.int64(), "end": pa.int64(), "font": pa.string(), "font_size": pa.float64(),
    "x": pa.float64(), "y": pa.float64(), "render_mode": pa.int32(), "page_index": pa.int32(), "page": pa.int32(), "form": pa.int32(), "depth": pa.int32(), "inherited": pa.bool_(), "font_num": pa.int32(), "invocations": pa.int32(), "invoked_pages": pa.list_(pa.int32()),
}
_FONT = {"codes": pa.binary(), "cmap": pa.map_(pa.string(), pa.string()), "table": pa.list_(pa.string()), "widths": pa.map_(pa.int32(), pa.int32()), "other_width": pa.int32(), "code_size": pa.int32()}
TEXTS = (
    "doc_id string, num int, seq int, place int, text string, operator string, encoding string, start long, `end` long, font string, font_size double, x double, y double, render_mode int, "
    "page_index int, page int, form int, depth int, inherited boolean, font_num int, invocations int, invoked_pages array<int>"
)
FONTS = "codes binary, cmap map<string,string>, table array<string>, widths map<int,int>, other_width int, code_size int"


def _texts(batches: Iterator[pa.RecordBatch], with_fonts: bool, only: str | None, proven: bool, every: bool = False) -> Iterator[pa.RecordBatch]:
    kinds = _TEXT | (_FONT if with_fonts else {})
    rows: list[dict] = []
    size = 0
    batch_of = lambda: pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in rows], t) for c, t in kinds.items()], schema=pa.schema(list(kinds.items())))
    for batch in batches:
        for doc_id, data in zip(batch.column("doc_id").to_pylist(), batch.column("content").to_pylist(), strict=True):
            data = data or b""
            own = document_objects(data)
            before = len(rows)
            if not proven or sound(data, own):
                rows += [r | {"doc_id": doc_id} for r in Texts(data, own).texts(with_fonts) if only is None or r["text"] == only]
            if every and len(rows) == before:
                rows.append({"doc_id": doc_id})
            size += len(data)
            if size > 2_000_000 or len(rows) > 5_000:
                yield batch_of()
                rows.clear()
                size = 0
    yield batch_of()


def text_rows(docs: DataFrame, with_fonts: bool = False, only: str | None = None, proven: bool = False, every: bool = False) -> DataFrame:
    """Text-shows of docs(doc_id, content): stream (num), place in it (seq), text as the font says, page, form, text state.

    place counts a document's streams in the order in which pages, by number, show them; a form's text comes once for
    each time that it is invoked, text of streams that no page shows comes last, without a page. A form on its own
    path, or below FORM_DEPTH others, is not followed. with_fonts: codes and what the font has; only: just this text;
    proven: just documents whose cross references lead to all objects; every: a row of nulls for a document without any.
    """
    return docs.select("doc_id", "content").mapInArrow(lambda b: _texts(b, with_fonts, only, proven, every), TEXTS + (f", {FONTS}" if with_fonts else ""))


def plain_number(x: Column) -> Column:
    """A number as text without a fraction of zero."""
    return F.regexp_replace(x.cast("string"), r"\.0$", "")


def _present(*pairs: tuple[str, Column]) -> Column:
    """A map of these keys, without those that are null."""
    return F.map_filter(F.map_from_arrays(F.array(*[F.lit(k) for k, _ in pairs]), F.array(*[v for _, v in pairs])), lambda _, v: v.isNotNull())


def text_meta() -> Column:
    """What selectors compare of a row of text_rows()."""
    return _present(
        ("operator", F.col("operator")), ("encoding", F.col("encoding")), ("font", F.col("font")), ("font_size", plain_number(F.col("font_size"))), ("text_x", plain_number(F.col("x"))), ("text_y", plain_number(F.col("y"))),
        ("font_context", F.when(F.col("page").isNotNull(), F.when(F.col("form").isNull(), "page").otherwise("form_xobject"))), ("page_object_number", F.col("page").cast("string")), ("form_object_number", F.col("form").cast("string")),
        ("form_depth", F.when(F.col("form").isNotNull(), F.col("depth").cast("string"))), ("inherited_resources", F.col("inherited").cast("string")), ("shared_form_xobject", F.when(F.col("invocations").isNotNull(), F.lit("true"))),
        ("form_invocation_count", F.col("invocations").cast("string")), ("form_invoked_page_object_numbers", F.concat(F.lit("["), F.array_join("invoked_pages", " "), F.lit("]"))),
    )


def nodes(docs: DataFrame) -> DataFrame:
    """doc_id, node_id, kind, value, meta, num, seq: the document, its streams by number, then text by page, stream and place.

    Text of streams that no page shows comes last, by stream. meta holds what selectors compare, as text.
    """
    kind = lambda k: F.lit(k).alias("kind")
    none = F.lit(None)
    top = docs.select("doc_id", kind(DOCUMENT), F.lit(0).alias("a"), F.lit(0).alias("b"), F.lit(0).alias("d"), none.cast("string").alias("value"), F.lit(0).alias("num"), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")).alias("meta"))
    own = streams(objects(docs).where(~name("Type").isin("ObjStm", "XRef"))).select(
        "doc_id", kind(STREAM), F.lit(1).alias("a"), F.col("num").alias("b"), F.lit(0).alias("d"), none.cast("string").alias("value"), "num",
        _present(
            ("filter_capability", F.col("capability")), ("filter", F.array_join("chain", " ")), ("object_number", F.col("num").cast("string")), ("object_generation", F.col("gen").cast("string")),
            ("filter_editable", F.col("capability").isin("identity_pass_through", "editable_reversible").cast("string")), ("filter_pass_through", (F.col("capability") == "pass_through_image").cast("string")), ("image_xobject", F.when(name("Subtype") == "Image", F.lit("true"))),
        ).alias("meta"),
    )
    texts = text_rows(docs).select(
        "doc_id", kind(TEXT), F.lit(2).alias("a"), F.col("place").alias("b"), F.col("seq").alias("d"), F.col("text").alias("value"), "num", text_meta().alias("meta"),
    )
    order = Window.partitionBy("doc_id").orderBy("a", "b", "d")
    every = top.unionByName(own).unionByName(texts)
    return every.select("doc_id", (F.row_number().over(order) - 1).alias("node_id"), "kind", "value", "meta", "num", F.col("d").alias("seq"))


@dataclass(frozen=True)
class Selector:
    """Equalities on kind, name, text and meta, all of which must hold, and which of a document's matches is meant.

    Rows without a column name are nodes without names: none of them has the one that is asked for.
    """

    of_kind: str | None = None
    of_text: str | Column | None = None
    of_meta: dict = field(default_factory=dict)
    at: int | None = None
    of_name: str | None = None

    def kind(self, kind: str) -> Selector:
        return replace(self, of_kind=kind)

    def named(self, name: str) -> Selector:
        return replace(self, of_name=name)

    def text(self, text: str | Column) -> Selector:
        return replace(self, of_text=text)

    def meta(self, key: str, value: str) -> Selector:
        return replace(self, of_meta=self.of_meta | {key: value})

    def match_index(self, at: int) -> Selector:
        return replace(self, at=at)

    def condition(self, named: bool = False) -> Column:
        """named: whether the rows have a column name."""
        out = F.lit(True)
        if self.of_name is not None:
            out = out & (F.col("name").eqNullSafe(F.lit(self.of_name)) if named else F.lit(False))
        if self.of_kind is not None:
            out = out & (F.col("kind") == self.of_kind)
        if self.of_text is not None:
            text = F.lit(self.of_text) if isinstance(self.of_text, str) else self.of_text
            out = out & F.coalesce("value", F.lit("<nil>")).eqNullSafe(text)
        for key, value in self.of_meta.items():
            out = out & F.col("meta")[key].eqNullSafe(F.lit(value))
        return out

    def query_all(self, rows: DataFrame) -> DataFrame:
        """All matches, whatever match_index says."""
        return rows.where(self.condition("name" in rows.columns))

    def query(self, rows: DataFrame) -> DataFrame:
        """The matches, or with match_index the one at that place in each document; none where there are too few."""
        found = self.query_all(rows)
        if self.at is None:
            return found
        place = F.row_number().over(Window.partitionBy("doc_id").orderBy("node_id")) - 1
        return found.withColumn("_at", place).where(F.col("_at") == self.at).drop("_at")

    def find_one(self, rows: DataFrame) -> DataFrame:
        """doc_id, matches, status and the node: exactly one match, or the one at match_index, else an error."""
        match = F.struct("node_id", "value", "num", "seq")
        hit = F.when(self.condition("name" in rows.columns), match)
        got = rows.groupBy("doc_id").agg(F.count(hit).alias("matches"), F.array_sort(F.collect_list(hit)).alias("_all"))
        at = 0 if self.at is None else self.at
        one = F.when(F.lit(self.at is not None) | (F.col("matches") == 1), F.get("_all", F.lit(at)))
        status = F.when(F.col("matches") == 0, "no_matches").when(F.lit(self.at is None) & (F.col("matches") > 1), "multiple_matches")
        status = status.when(F.col("matches") <= at, "match_index_out_of_range").otherwise("ok")
        return got.select("doc_id", "matches", status.alias("status"), one.alias("node"))
