"""Trees within documents: pages, names, labels, outlines and forms.

A short walk puts the nodes of a tree in order. Of documents (doc_id, content) it is taken where a document is parsed, and
nothing is shuffled; of objects that were parsed before, the few entries that make up the tree meet in one row of their
document. All that can be said of a node by itself is columns.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from vellum.sources.scan import array_items, document_objects, entry, name, number, ref_numbers, text
from vellum.sources.syntax import KEPT, KEPT_BYTES, items, reference, string_text

#: What a page takes from the nodes above it where it has none of its own.
INHERITED = ("Resources", "MediaBox", "CropBox", "Rotate", "ArtBox", "BleedBox", "TrimBox")
Nodes = dict[int, dict[str, str]]
_NUMBERS = re.compile(r"(\d+)\s+\d+\s+R\b")
_DIRECT = re.compile(r"Annots/\[(\d+)\]/Subtype")


def only(*keys: str, under: tuple[str, ...] = ()) -> Column:
    """The entries of these keys, and those whose path begins with one of `under`."""
    keep = lambda k, _: k.isin(*keys) | (F.lit(False) if not under else F.exists(F.array(*map(F.lit, under)), lambda u: F.startswith(k, u)))
    return F.map_filter("entries", keep)


def by_document(source: DataFrame, part: Callable[[DataFrame], DataFrame], walk: Callable[[Nodes], Iterator[tuple]], columns: str) -> DataFrame:
    """What walk() yields from the nodes of each document, as a table of doc_id and `columns`.

    source: documents(doc_id, content), or objects of documents; part: those objects (num, entries) that the walk may need.
    """
    schema = to_arrow_schema(T.StructType.fromDDL(f"doc_id string, {columns}"))
    whole = "content" in source.columns

    def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple] = []
            for doc_id, held in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                nodes = {r["num"]: r["entries"] for r in document_objects(held or b"")} if whole else {n["num"]: dict(n["entries"]) for n in held}
                found += [(doc_id, *row) for row in walk(nodes)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], f.type) for i, f in enumerate(schema)], schema=schema)

    held = source.select("doc_id", "content") if whole else part(source).groupBy("doc_id").agg(F.collect_list(F.struct("num", "entries")).alias("nodes"))
    return held.mapInArrow(walked, f"doc_id string, {columns}")


def target(raw: str | None) -> int | None:
    ref = reference(raw)
    return ref[0] if ref else None


def root(nodes: Nodes) -> dict[str, str]:
    """The catalog: what the trailer names, else the first of that type."""
    named = [n for n, e in nodes.items() if "Root!" in e] or sorted(n for n, e in nodes.items() if e.get("Type") == "/Catalog")
    return nodes[named[0]] if named else {}


def below(nodes: Nodes, entries: dict[str, str], key: str) -> dict[str, str]:
    """The dictionary that is a key's value, direct or by reference."""
    own = target(entries.get(key))
    if own is not None:
        return nodes.get(own, {})
    return {k[len(key) + 1 :]: v for k, v in entries.items() if k.startswith(f"{key}/")}


def _numbers_in(raw: str | None) -> tuple[int, ...]:
    return tuple(int(n) for kind, n in items(raw) if kind == "ref")


_kept_numbers = lru_cache(maxsize=KEPT)(_numbers_in)


def refs_in(raw: str | None) -> tuple[int, ...]:
    """The numbers that an array's raw value refers to, at any depth."""
    return _kept_numbers(raw) if raw is None or len(raw) <= KEPT_BYTES else _numbers_in(raw)


def page_list(nodes: Nodes) -> Iterator[tuple[int, int, dict[str, str]]]:
    """(index, number, what it has or inherits) of the pages, in the order of the tree."""
    index = 0
    stack: list[tuple] = [(target(root(nodes).get("Pages")), {}, frozenset())]
    while stack:
        num, above, path = stack.pop()
        if num in path or num not in nodes:
            continue
        own = nodes[num]
        got = above
        if not own.keys().isdisjoint(INHERITED):
            got = above | {k: own[k] for k in INHERITED if k in own}
            if "Resources" in own:
                got["resources_of"] = str(num)
        if own.get("Type") == "/Page":
            yield index, num, got
            index += 1
            continue
        path = path | {num}
        stack += [(kid, got, path) for kid in reversed(refs_in(own.get("Kids")))]


PAGES = "page_index int, num int, media_box string, crop_box string, rotate string, resources_of int, inherited map<string,string>"


def walk_pages(nodes: Nodes) -> Iterator[tuple]:
    for index, num, got in page_list(nodes):
        yield index, num, got.get("MediaBox"), got.get("CropBox"), got.get("Rotate"), int(got["resources_of"]) if "resources_of" in got else None, got


def pages(objs: DataFrame, own: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, page_index, num, media_box, crop_box, rotate, resources_of and all inherited: pages in the order of the tree.

    A node that comes again on its own path, or is not there, ends that path. resources_of is the object whose
    /Resources hold for the page. own: keys whose values a page itself has, which are there as entries then.
    """

    def part(objs: DataFrame) -> DataFrame:
        tree = objs.where(entry("Root!").isNotNull() | name("Type").isin("Catalog", "Pages", "Page"))
        return tree.select("doc_id", "num", only("Root!", "Type", "Pages", "Kids", *INHERITED, *own).alias("entries"))

    def walk(nodes: Nodes) -> Iterator[tuple]:
        for row in walk_pages(nodes):
            yield *row, {k: nodes[row[1]][k] for k in own if k in nodes[row[1]]}

    return by_document(objs, part, walk, f"{PAGES}, entries map<string,string>") if own else by_document(objs, part, walk_pages, PAGES)


def names_in(nodes: Nodes, trees: dict[str, str], kind: str) -> Iterator[tuple[str, str, str | None]]:
    """(name, kind of its value, value) of one of the catalog's name trees, in order; a node that comes again on its own path is an error."""
    stack: list[tuple] = [(below(nodes, trees, kind), frozenset())]
    while stack:
        node, path = stack.pop()
        pairs, depth, key = [], 0, None
        for what, value in items(node.get("Names"))[1:-1]:
            if depth == 0 and key is None:
                if what != "text":
                    yield "", "error", "a name is no string"
                    return
                key = value
                continue
            depth += (what == "open") - (what == "close")
            if depth == 0:
                pairs.append((key, what if what != "close" else "direct", value))
                key = None
        if key is not None:
            yield "", "error", "a name without a value"
            return
        yield from pairs
        for kid in reversed([int(n) for what, n in items(node.get("Kids")) if what == "ref"]):
            if kid in path:
                yield "", "error", "a circle of names"
                return
            stack.append((nodes.get(kid, {}), path | {kid}))


KINDS = ("Dests", "EmbeddedFiles", "JavaScript")


def _names(nodes: Nodes) -> Iterator[tuple]:
    trees = below(nodes, root(nodes), "Names")
    for kind in KINDS:
        for i, (key, what, value) in enumerate(names_in(nodes, trees, kind)):
            yield kind, i, key, int(value) if what == "ref" else None, value if what not in ("ref", "error") else None, value if what == "error" else None


def name_entries(objs: DataFrame) -> DataFrame:
    """doc_id, kind, ord, name, target (object number), value (a direct one), error of the name trees, however deep."""

    def part(objs: DataFrame) -> DataFrame:
        tree = objs.where(entry("Root!").isNotNull() | name("Type").isin("Catalog") | F.greatest(*[entry(k).isNotNull() for k in ("Names", "Kids", *KINDS)]))
        return tree.where("raw is null").select("doc_id", "num", only("Root!", "Type", "Names", "Kids", *KINDS, under=("Names/", *[f"{k}/" for k in KINDS])).alias("entries"))

    return by_document(objs, part, _names, "kind string, ord int, name string, target int, value string, error string")


def _labels(nodes: Nodes) -> Iterator[tuple]:
    stack: list[tuple] = [(below(nodes, root(nodes), "PageLabels"), frozenset())]
    while stack:
        node, path = stack.pop()
        at = [k for k in node if k.startswith("Nums/[")]
        flat = items(node.get("Nums"))[1:-1]
        depth, place, key = 0, 0, None
        for what, value in flat:
            if depth == 0 and key is None and what == "word":
                key, place = int(value), place + 1
                continue
            depth += (what == "open") - (what == "close")
            if depth == 0 and key is not None:
                prefix = f"Nums/[{place}]/"
                own = nodes.get(int(value), {}) if what == "ref" else {k[len(prefix) :]: node[k] for k in at if k.startswith(prefix)}
                yield key, own.get("S", "")[1:] or None, own.get("P="), int(own["St"]) if own.get("St", "").isdigit() else 1
                key, place = None, place + 1
        stack += [(nodes.get(kid, {}), path | {kid}) for kid in reversed([int(n) for what, n in items(node.get("Kids")) if what == "ref"]) if kid not in path]


def page_labels(objs: DataFrame) -> DataFrame:
    """doc_id, first_page, style, prefix, start of the number tree of page labels."""

    def part(objs: DataFrame) -> DataFrame:
        tree = objs.where("raw is null").where(entry("Root!").isNotNull() | (name("Type") == "Catalog") | entry("Nums").isNotNull() | entry("Kids").isNotNull() | entry("S").isNotNull())
        return tree.select("doc_id", "num", only("Root!", "Type", "PageLabels", "Nums", "Kids", "S", "P=", "St", under=("PageLabels/", "Nums/")).alias("entries"))

    return by_document(objs, part, _labels, "first_page int, style string, prefix string, start int")


def _outline(nodes: Nodes) -> Iterator[tuple]:
    stack: list[tuple] = [(target(below(nodes, root(nodes), "Outlines").get("First")), None, 0)]
    seen: set[int] = set()
    order = 0
    while stack:
        num, parent, depth = stack.pop()
        if num is None or num in seen or num not in nodes:
            continue
        seen.add(num)
        own = nodes[num]
        yield order, num, parent, depth, own.get("Title="), own.get("Dest"), own.get("Dest=")
        order += 1
        stack += [(target(own.get("Next")), parent, depth), (target(own.get("First")), num, depth + 1)]


def outlines(objs: DataFrame) -> DataFrame:
    """doc_id, ord, num, parent, depth, title, dest, dest_name of the outline, in the order of reading."""

    def part(objs: DataFrame) -> DataFrame:
        tree = objs.where(entry("Root!").isNotNull() | (name("Type") == "Catalog") | entry("Title").isNotNull() | entry("First").isNotNull())
        return tree.select("doc_id", "num", only("Root!", "Type", "Outlines", "First", "Next", "Title=", "Dest", "Dest=", under=("Outlines/",)).alias("entries"))

    return by_document(objs, part, _outline, "ord int, num int, parent int, depth int, title string, dest string, dest_name string")


_FIELD = ("T=", "FT", "TU=", "TM=", "V", "V=", "DV", "DV=", "Ff", "Kids", "Fields", "RV", "A", "AA", "Subtype", "Opt", "I", "MaxLen", "Rect", "AP")


def _actions(own: dict[str, str], of: str) -> list[str]:
    script = any((k.startswith(("A/", "AA/")) and k.endswith("/S")) and v == "/JavaScript" for k, v in own.items())
    return [x for x, there in ((f"{of}_action", "A" in own), (f"{of}_additional_actions", "AA" in own), (f"{of}_javascript_action", script)) if there]


def _states(own: dict[str, str]) -> list[str]:
    """The names of a button's normal appearances."""
    return sorted({k[5:].split("/")[0] for k in own if k.startswith("AP/N/")} - {"#"})


FIELDS = "ord int, num int, name string, type string, entries map<string,string>, flags int, kid_count int, other_blockers array<string>, button_states array<string>, proof boolean, rect boolean"


def walk_fields(nodes: Nodes) -> Iterator[tuple]:
    form = below(nodes, root(nodes), "AcroForm")
    seen: set[int] = set()
    order = 0
    refs = lambda e, key: [int(n) for what, n in items(e.get(key)) if what == "ref"]
    stack: list[tuple] = [(n, (), None, None) for n in reversed(refs(form, "Fields"))]
    while stack:
        num, above, kind, flags = stack.pop()
        if num in seen or num not in nodes:
            continue
        seen.add(num)
        own = nodes[num]
        kind, flags = own.get("FT", kind), own.get("Ff", flags)
        if "T=" in own:
            above = (*above, own["T="])
            kids = [nodes.get(k) for k in refs(own, "Kids")]
            shape = [x for k in kids for x in (["unresolved_kid"] if k is None else ["nested_kids"] * ("Kids" in k) + ["named_non_widget_kid"] * ("T=" in k and k.get("Subtype") != "/Widget"))]
            blockers = _actions(own, "field") + [x for k in kids if k is not None for x in _actions(k, "widget")] + shape
            parts = [_states(own)] + [_states(k or {}) for k in kids]
            proof = bool(parts[0]) or (len(parts) > 1 and all(parts[1:]))
            rect = all("Rect" in (k or {}) for k in kids) if kids else "Rect" in own
            yield order, num, ".".join(above), (kind or "/")[1:], own, int(flags) if flags and flags.lstrip("+-").isdigit() else None, len(kids), blockers, sorted({s for p in parts for s in p}), proof, rect
            order += 1
        stack += [(n, above, kind, flags) for n in reversed(refs(own, "Fields") + refs(own, "Kids"))]


#: Fixed names of the bits of a field's flags: for all types, then by type.
COMMON_FLAGS = {1: "read_only", 2: "required", 3: "no_export"}
TYPE_FLAGS = {
    "Tx": {13: "multiline", 14: "password", 21: "file_select", 23: "do_not_spell_check", 24: "do_not_scroll", 25: "comb", 26: "rich_text"},
    "Btn": {15: "no_toggle_to_off", 16: "radio", 17: "pushbutton", 26: "radios_in_unison"},
    "Ch": {18: "combo", 19: "edit", 20: "sort", 22: "multi_select", 23: "do_not_spell_check", 27: "commit_on_sel_change"},
}
#: Fixed names of the bits of an annotation's flags.
ANNOTATION_FLAGS = {1: "invisible", 2: "hidden", 3: "print", 4: "no_zoom", 5: "no_rotate", 6: "no_view", 7: "read_only", 8: "locked", 9: "toggle_no_view", 10: "locked_contents"}


def bit(flags: Column, n: int) -> Column:
    return F.lit(1 << (n - 1)).bitwiseAND(F.coalesce(flags, F.lit(0))) != 0


def has_bit(flags: int | None, n: int) -> bool:
    return bool((flags or 0) & 1 << (n - 1))


def flag_names(flags: Column, bits: dict[int, str]) -> Column:
    return F.array_compact(F.array(*[F.when(bit(flags, n), F.lit(x)) for n, x in bits.items()]))


def options(raw: Column) -> Column:
    """A choice's options as structs of export and display text: strings, or pairs of them."""

    @F.pandas_udf("array<struct<export:string,display:string>>")
    def apply(values):
        return values.map(lambda raw: [{"export": e, "display": d} for e, d in option_list(raw)])

    return apply(F.coalesce(raw, F.lit("")))


def option_list(raw: str | None) -> list[tuple[str, str]]:
    """options() of one choice."""
    out, pair = [], None
    for kind, x in items(raw)[1:-1]:
        if kind == "open":
            pair = []
        elif kind == "close" and pair:
            out.append((pair[0], pair[-1]))
            pair = None
        elif kind == "text":
            out.append((x, x)) if pair is None else pair.append(x)
    return out


def may_be_filled(own: dict[str, str], kind: str, flags: int | None, blockers: list[str], choices: list, proof: bool) -> bool:
    """Whether described() says of a field that filling it is supported."""
    if "RV" in own or has_bit(flags, 26) or blockers:
        return False
    if kind == "Ch" and has_bit(flags, 22) and not choices:
        return False
    return kind in ("Tx", "Ch") or (kind == "Btn" and proof)


def form_fields(objs: DataFrame) -> DataFrame:
    """Every named field of the form, those above before those below: doc_id, ord, num, name and what there is to say of it.

    A name is that of all above joined by dots; type and flags are inherited; a field that several refer to comes once.
    appearance_status and fill_status say what an edit could do, the blockers why it could not.
    """

    def part(objs: DataFrame) -> DataFrame:
        tree = objs.where(entry("Root!").isNotNull() | (name("Type") == "Catalog") | entry("T").isNotNull() | entry("Kids").isNotNull() | entry("Fields").isNotNull() | (name("Subtype") == "Widget"))
        return tree.where("raw is null").select("doc_id", "num", only("Root!", "Type", "AcroForm", *_FIELD, under=("AcroForm/", "A/", "AA/", "AP/N")).alias("entries"))

    return described(by_document(objs, part, walk_fields, FIELDS))


def described(found: DataFrame) -> DataFrame:
    """What there is to say of fields that walk_fields() found."""
    rich = F.when(entry("RV").isNotNull(), F.array(F.lit("rich_text_value"))).when(bit(F.col("flags"), 26), F.array(F.lit("rich_text_flag"))).otherwise(F.array().cast("array<string>"))
    found = found.withColumn("rich", rich).withColumn("options", F.when(F.col("type") == "Ch", options(entry("Opt"))))
    fill = F.array_distinct(F.concat("rich", "other_blockers"))
    kind, multi = F.col("type"), bit(F.col("flags"), 22)
    one = lambda x: F.array(F.lit(x))
    none = F.array().cast("array<string>")
    no_type = F.when(kind == "", one("unknown_field_type")).otherwise(one("unsupported_field_type"))
    known = kind.isin("Tx", "Ch")
    said = lambda status, why: F.struct(F.lit(status).alias("status"), why.alias("blockers"))
    appearance = (
        F.when(known & (F.size("rich") > 0), said("unsafe", F.col("rich")))
        .when(known & F.col("rect"), said("approximate_supported", none))
        .when(known, said("unsupported", one("missing_widget_rect")))
        .when((kind == "Btn") & F.col("proof"), said("existing_button_state_only", none))
        .when(kind == "Btn", said("unsupported", one("button_appearance_synthesis_not_supported")))
        .otherwise(said("unsupported", no_type))
    )
    filled = (
        F.when(F.size(fill) > 0, said("unsafe", fill))
        .when((kind == "Ch") & multi & (F.size("options") == 0), said("unsupported", one("multi_select_missing_options")))
        .when(known | ((kind == "Btn") & F.col("proof")), said("supported", none))
        .when(kind == "Btn", said("unsupported", one("missing_or_ambiguous_button_appearance_states")))
        .otherwise(said("unsupported", no_type))
    )
    typed = F.lit(None).cast("array<string>")
    for k, bits in TYPE_FLAGS.items():
        typed = F.when(kind == k, flag_names(F.col("flags"), bits)).otherwise(typed)
    value = lambda key: F.coalesce(text(key), F.nullif(name(key), F.lit("")))
    return found.withColumns({"_a": appearance, "_f": filled}).select(
        "doc_id", "ord", "num", "name", "type", text("TU").alias("alternate_name"), text("TM").alias("mapping_name"), value("V").alias("value"), value("DV").alias("default_value"), "flags",
        flag_names(F.col("flags"), COMMON_FLAGS).alias("flag_names"), typed.alias("type_flag_names"), "kid_count", "options", "button_states",
        F.col("_a.status").alias("appearance_status"), F.col("_a.blockers").alias("appearance_blockers"), F.col("_f.status").alias("fill_status"), F.col("_f.blockers").alias("fill_blockers"),
        ((F.col("_f.status") == "supported") & ~bit(F.col("flags"), 1)).alias("fillable"),
        F.when(F.coalesce(entry("V"), F.lit("")).startswith("["), F.transform(F.filter(array_items(F.coalesce(entry("V"), F.lit(""))), lambda x: x["kind"] == "text"), lambda x: x["value"])).alias("values"),
        F.transform(F.regexp_extract_all(entry("I"), F.lit(r"(\d+)"), F.lit(1)), lambda x: x.cast("int")).alias("indexes"),
    )


def border_blocker(subtype: Column) -> Column:
    """Why the border of a link, square or circle can't be drawn; null if it can. Values that are references are none that can."""
    number_ = r"[-+]?(?:\d+\.?\d*|\.\d+)"
    plain = lambda c: c.rlike(rf"^\[\s*(?:{number_}\s*)*\]$")
    listed = lambda c: F.transform(F.regexp_extract_all(c, F.lit(f"({number_})"), F.lit(1)), lambda x: x.cast("double"))
    width, style, dash, border = entry("BS/W"), F.coalesce(entry("BS/S"), F.lit("/S")), entry("BS/D"), entry("Border")
    bad_dash = ~plain(dash) | F.exists(listed(dash), lambda x: x < 0) | ~F.exists(listed(dash), lambda x: x > 0)
    styled = (
        F.when(~entry("BS").startswith("<<"), "unsupported_bs_border_style")
        .when(~F.coalesce(width, F.lit("0")).rlike(f"^{number_}$") | F.coalesce(width, F.lit("0")).startswith("-"), "unsupported_bs_width")
        .when(~style.isin("/S", "/D", "/U") | ((style == "/U") & (subtype != "Link")), "unsupported_bs_border_style")
        .when((style == "/D") & dash.isNotNull() & bad_dash, "unsupported_bs_dash_array")
    )
    plain_border = ~plain(border) | (F.size(listed(border)) != 3) | (F.get(listed(border), F.lit(2)) < 0)
    return F.when(entry("BS").isNotNull() & subtype.isin("Link", "Square", "Circle"), styled).when((subtype == "Link") & border.isNotNull() & plain_border, "unsupported_border")


NOTES = "annotation_index int, page_index int, num int, entries map<string,string>"


def _marked(own: dict[str, str]) -> bool:
    return own.get("Type") == "/Annot" or (own.get("Subtype", "").startswith("/") and own.get("Rect", "").startswith("["))


def walk_notes(nodes: Nodes) -> Iterator[tuple]:
    here: dict[int, list[int]] = {}
    for index, num, _ in page_list(nodes):
        here.setdefault(num, []).append(index)
    first: dict[int, int] = {}
    direct: list[tuple] = []
    for page, own in nodes.items():
        if "Annots" not in own:
            continue
        for num in map(int, _NUMBERS.findall(own["Annots"])) if page in here else ():
            first[num] = min(first.get(num, here[page][0]), here[page][0])
        for at in {int(m[1]) for k in own if (m := _DIRECT.fullmatch(k))}:
            prefix = f"Annots/[{at}]/"
            note = {k.replace(prefix, ""): v for k, v in own.items() if k.startswith(prefix)}
            direct += [(page, at, index, note) for index in here.get(page, [None]) if _marked(note)]
    rows = [(first.get(num), num, own) for num, own in sorted(nodes.items()) if _marked(own)]
    rows += [(index, None, note) for _, _, index, note in sorted(direct, key=lambda d: d[:2])]
    for i, row in enumerate(rows):
        yield i, *row


def annotations(objs: DataFrame, page_rows: DataFrame | None = None) -> DataFrame:
    """doc_id, annotation_index, page_index, num, subtype, contents, rect, flags and what they allow.

    Annotations with a number of their own come first, by number, each once, on the first page that lists it; then
    those that stand in a page's list itself. Of documents(doc_id, content) they are found where a document is parsed, of
    objects by joins with page_rows, their pages().
    """
    if "content" in objs.columns:
        return _noted(by_document(objs, lambda o: o, walk_notes, NOTES))
    marked = lambda p: (entry(f"{p}Type") == "/Annot") | (F.coalesce(entry(f"{p}Subtype"), F.lit("")).startswith("/") & F.coalesce(entry(f"{p}Rect"), F.lit("")).startswith("["))
    here = page_rows.select("doc_id", F.col("num").alias("page"), "page_index")
    lists = objs.where(entry("Annots").isNotNull()).select("doc_id", F.col("num").alias("page"), "entries")
    first = lists.select("doc_id", "page", F.explode(ref_numbers(entry("Annots"))).alias("num")).join(here, ["doc_id", "page"]).groupBy("doc_id", "num").agg(F.min("page_index").alias("page_index"))
    own = objs.where(marked("")).select("doc_id", "num", "entries").join(first, ["doc_id", "num"], "left").select("doc_id", F.lit(0).alias("a"), F.col("num").alias("b"), F.lit(0).alias("c"), "num", "page_index", "entries")
    at = F.transform(F.filter(F.map_keys("entries"), lambda k: k.rlike(r"^Annots/\[\d+\]/Subtype$")), lambda k: F.regexp_extract(k, r"\[(\d+)\]", 1).cast("int"))
    direct = lists.select("doc_id", "page", "entries", F.explode(at).alias("c"))
    prefix = F.concat(F.lit("Annots/["), F.col("c").cast("string"), F.lit("]/"))
    direct = direct.withColumn("entries", F.transform_keys(F.map_filter("entries", lambda k, _: F.startswith(k, prefix)), lambda k, _: F.replace(k, prefix, F.lit(""))))
    direct = direct.where(marked("")).join(here, ["doc_id", "page"], "left").select("doc_id", F.lit(1).alias("a"), F.col("page").alias("b"), "c", F.lit(None).cast("int").alias("num"), "page_index", "entries")
    index = F.row_number().over(Window.partitionBy("doc_id").orderBy("a", "b", "c")) - 1
    return _noted(own.unionByName(direct).withColumn("annotation_index", index))


def _noted(found: DataFrame) -> DataFrame:
    """What there is to say of annotations(doc_id, annotation_index, page_index, num, entries)."""
    rect = F.transform(F.regexp_extract_all(F.coalesce(entry("Rect"), F.lit("")), F.lit(r"([-+]?(?:\d+\.?\d*|\.\d+))"), F.lit(1)), lambda x: x.cast("double"))
    script = F.exists(F.map_keys("entries"), lambda k: (k == "A/S") & (F.col("entries")[k] == "/JavaScript"))
    unsafe = F.array_compact(F.array(*[F.when(c, F.lit(x)) for c, x in ((entry("RC").isNotNull(), "rich_text_content"), (script, "javascript_action"), (entry("AA").isNotNull(), "additional_actions"))]))
    basic = name("Subtype").isin("Text", "FreeText", "Link", "Square", "Circle", "Highlight", "Underline", "StrikeOut")
    area = (F.size(rect) == 4) & (F.get(rect, F.lit(2)) > F.get(rect, F.lit(0))) & (F.get(rect, F.lit(3)) > F.get(rect, F.lit(1)))
    area = F.coalesce(area, F.lit(False))
    reason = F.when(~basic, "unsupported_subtype").when(~area, "missing_usable_rect").otherwise(border_blocker(name("Subtype")))
    status = F.when(F.size(unsafe) > 0, "unsafe").when(reason.isNotNull(), "unsupported").otherwise("approximate_supported")
    blockers = F.when(F.size(unsafe) > 0, unsafe).when(reason.isNotNull(), F.array(reason)).otherwise(F.array().cast("array<string>"))
    return found.select(
        "doc_id", "annotation_index", "page_index", "num", name("Subtype").alias("subtype"), text("Contents").alias("contents"), text("NM").alias("name"), text("M").alias("modified"), rect.alias("rect"),
        number("F").alias("flags"), flag_names(number("F"), ANNOTATION_FLAGS).alias("flag_names"), status.alias("appearance_status"), blockers.alias("appearance_blockers"),
    )


def string_of(raw: Column) -> Column:
    """The text of a raw string value."""

    @F.pandas_udf("string")
    def apply(values):
        return values.map(lambda v: None if v is None else string_text(v.encode("latin-1")))

    return apply(raw)
