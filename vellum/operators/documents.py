"""Operations on whole documents: cross references, name trees, page copies and transforms, policies, plans."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.operators.graph import form_fields, name_entries, outlines, page_labels, pages
from vellum.plans.staging import stage_documents as stage
from vellum.sources.mint import document, obj, raw_literal
from vellum.sources.scan import document_objects, entry, name, refs
from vellum.sources.syntax import items, rebuilt, reference, renumbered
from vellum.sources.write import canonical

#: What a merged catalog takes from the first document.
FIRST = ("Metadata", "OpenAction", "ViewerPreferences", "PageMode", "PageLayout", "Lang", "MarkInfo")


def xref_in_force(entries: DataFrame) -> DataFrame:
    """Of entries for the same object, that of the last section."""
    return entries.groupBy("doc_id", "num", "gen").agg(F.max_by("offset", "section").alias("offset"), F.count(F.lit(1)).alias("sections"))


def merged_names(entries: DataFrame, group: Column, part: Column) -> DataFrame:
    """Names of several documents in one tree of a kind: the first keeps its name, a later one gets its document's ordinal among the merged."""
    # Names are read twice, so they are written first: else all documents would be parsed twice.
    rows = stage(entries.select("*", group.alias("merged"), part.alias("part")))
    # Documents are numbered among themselves, names beside them: no task ranks all names of a merged document.
    parts = rows.select("merged", "part").distinct().withColumn("_n", F.row_number().over(Window.partitionBy("merged").orderBy("part")))
    first = F.row_number().over(Window.partitionBy("merged", "kind", "name").orderBy("part", "ord")) == 1
    rows = rows.withColumn("_first", first).join(parts, ["merged", "part"])
    return rows.select("merged", "part", "doc_id", "kind", "ord", F.when(F.col("_first"), F.col("name")).otherwise(F.concat("name", F.lit("#doc"), F.col("_n").cast("string"))).alias("name"), "target", "value")


def _closure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What can be reached from the starting objects of each document, themselves included."""
    for batch in batches:
        ids, nums = [], []
        for doc_id, edges, starts in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "edges", "starts")), strict=True):
            to: dict[int, list[int]] = {}
            for e in edges or ():
                to.setdefault(e["src"], []).append(e["dst"])
            seen, stack = set(starts), list(starts)
            while stack:
                for n in to.get(stack.pop(), ()):
                    if n not in seen:
                        seen.add(n)
                        stack.append(n)
            ids += [doc_id] * len(seen)
            nums += sorted(seen)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(nums, pa.int32())], ["doc_id", "num"])


def reached(objs: DataFrame, starts: DataFrame) -> DataFrame:
    """doc_id, num: the objects that starts(doc_id, num) refer to, and so on; catalogs and nodes of page trees are not gone through."""
    tree = objs.where(name("Type").isin("Catalog", "Pages")).select("doc_id", F.col("num").alias("dst"))
    edges = refs(objs).join(tree, ["doc_id", "dst"], "left_anti").groupBy("doc_id").agg(F.collect_list(F.struct("src", "dst")).alias("edges"))
    begin = starts.groupBy("doc_id").agg(F.collect_set("num").alias("starts"))
    return begin.join(edges, "doc_id", "left").select("doc_id", "edges", "starts").mapInArrow(_closure, "doc_id string, num int")


def lineage(objs: DataFrame, placed: DataFrame) -> DataFrame:
    """placed(merged, position, doc_id, page_index) with num and output_page_index: which page comes from where."""
    index = F.row_number().over(Window.partitionBy("merged").orderBy("position", "doc_id", "page_index")) - 1
    return placed.join(pages(objs).select("doc_id", "page_index", "num", "inherited"), ["doc_id", "page_index"]).withColumn("output_page_index", index)


def _copied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bodies with their references moved; a page gets its new parent and what it inherits."""
    for batch in batches:
        out = []
        for head, entries, raw, delta, moved, inherited in zip(*(batch.column(c).to_pylist() for c in ("head", "entries", "raw", "delta", "moved", "inherited")), strict=True):
            to = dict(moved or ())
            if inherited is not None:
                own = dict(inherited)
                own.pop("resources_of", None)
                body = rebuilt(own | {k: v for k, v in dict(entries).items() if k not in ("Parent",)}, {})
                body = renumbered(body, to, delta)[:-2] + "/Parent 2 0 R >>"
            else:
                body = renumbered(head or "null", to, delta)
            data = body.encode("latin-1", "replace")
            out.append(data if raw is None else data + b"\nstream\n" + raw + b"\nendstream")
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("merged", "new")), pa.array(out, pa.binary())], ["merged", "new", "body"])


def compose(objs: DataFrame, placed: DataFrame) -> DataFrame:
    """doc_id, content: documents made of pages: placed(merged, position, doc_id, page_index), a page as often as it is placed.

    Objects that the pages need come with them, moved up by what the documents before hold; references to a page lead to
    its first copy, or to null if it has none. The catalog has the first document's entries, the names of all (a name
    that comes again gets its document's ordinal), labels and outline items of the copied pages, and all form fields.
    """
    objs, own = stage(objs), stage(lineage(objs, placed))
    sizes = objs.groupBy("doc_id").agg(F.max("num").alias("top"))
    parts = own.groupBy("merged", "doc_id").agg(F.min("position").alias("position")).join(sizes, "doc_id")
    before = Window.partitionBy("merged").orderBy("position", "doc_id")
    parts = parts.withColumn("delta", (F.coalesce(F.sum("top").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + 10).cast("int"))
    ends = parts.groupBy("merged").agg(F.max(F.col("delta") + F.col("top")).alias("end"))
    own = stage(own.join(ends, "merged")).withColumn("new", (F.col("end") + 1 + F.col("output_page_index")).cast("int"))
    copies = own.groupBy("merged", "doc_id", "num").agg(F.min("new").alias("new"))
    every = objs.where(name("Type") == "Page").select("doc_id", "num").join(parts.select("merged", "doc_id"), "doc_id").join(copies, ["merged", "doc_id", "num"], "left")
    moved = every.groupBy("merged", "doc_id").agg(F.map_from_entries(F.collect_list(F.struct("num", "new"))).alias("moved"))
    parts = stage(parts.join(moved, ["merged", "doc_id"], "left"))

    top = objs.where(entry("Root!").isNotNull() | (name("Type") == "Catalog")).select("doc_id", F.col("entries").alias("catalog"))
    named, labelled, listed = stage(name_entries(objs).where("error is null")), page_labels(objs), stage(outlines(objs).where("depth = 0"))
    form = stage(form_parts(objs, top))
    starts = own.select("doc_id", "num").union(named.where("target is not null").select("doc_id", "target")).union(listed.select("doc_id", "num")).union(form.select("doc_id", F.explode("fields")))
    needed = stage(reached(objs, starts))
    bodies = objs.where(~name("Type").isin("Catalog", "Pages", "Page")).join(needed, ["doc_id", "num"], "left_semi").join(parts.select("merged", "doc_id", "delta", "moved"), "doc_id")
    listed = stage(linked_outlines(listed, parts, ends))
    bodies = bodies.join(listed.select("merged", "doc_id", "num", F.lit(True).alias("item")), ["merged", "doc_id", "num"], "left").where("item is null")
    columns = ["merged", "new", "head", "entries", "raw", "delta", "moved", "inherited"]
    rows = bodies.select("merged", (F.col("num") + F.col("delta")).alias("new"), "head", "entries", "raw", "delta", "moved", F.lit(None).cast("map<string,string>").alias("inherited"))
    sheets = own.join(objs.select("doc_id", "num", "head", "entries", "raw"), ["doc_id", "num"]).join(parts.select("merged", "doc_id", "delta", "moved"), ["merged", "doc_id"])
    copied = rows.select(*columns).unionByName(sheets.select(*columns)).mapInArrow(_copied, "merged string, new int, body binary")
    items = listed.select("merged", F.col("new"), F.encode("body", "ISO-8859-1").alias("body"))
    objects = copied.unionByName(items).groupBy("merged").agg(F.array_sort(F.collect_list(obj(F.col("new"), F.col("body")))).alias("objects"))

    kids = own.groupBy("merged").agg(F.transform(F.array_sort(F.collect_list(F.struct("output_page_index", "new"))), lambda p: F.concat(p["new"].cast("string"), F.lit(" 0 R"))).alias("kids"))
    catalog = catalogs(parts, top, merged_names(named.join(parts.select("doc_id", F.col("merged").alias("_m"), F.col("position").alias("_p")), "doc_id"), F.col("_m"), F.col("_p")), labelled, own, form, listed)
    pages_node = F.concat(F.lit("<< /Type /Pages /Kids ["), F.array_join("kids", " "), F.lit("] /Count "), F.size("kids").cast("string"), F.lit(" >>"))
    whole = objects.join(kids, "merged").join(catalog, "merged", "left")
    first = F.concat(F.lit("<< /Type /Catalog /Pages 2 0 R "), F.coalesce("extra", F.lit("")), F.lit(">>"))
    return dense(whole.select(F.col("merged").alias("doc_id"), document(F.concat(F.array(obj(1, F.encode(first, "ISO-8859-1")), obj(2, pages_node)), "objects")).alias("content")))


def visited(rows: dict[int, dict], starts: list[int]) -> dict[int, int]:
    """Numbers from 1 in the order in which a walk along the references first comes to an object: depth first, references of a value in their order."""
    new: dict[int, int] = {}
    stack = list(reversed(starts))
    while stack:
        num = stack.pop()
        if num in new or num not in rows:
            continue
        new[num] = len(new) + 1
        stack += [int(x) for kind, x in reversed(items(rows[num]["head"])) if kind == "ref"]
    return new


def _densely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for data in batch.column("content").to_pylist():
            rows = {r["num"]: r for r in document_objects(data or b"")}
            tops = {n: r["entries"] for n, r in rows.items() if "Root!" in r["entries"]}
            named = {k: own[f"Trailer!{k}"] for own in tops.values() for k in ("Info", "ID") if f"Trailer!{k}" in own}
            new = visited(rows, [*tops, *[ref[0] for v in named.values() if (ref := reference(v))]])
            moved = {n: new.get(n) for n in rows} | {int(x): None for r in rows.values() for kind, x in items(r["head"]) if kind == "ref" and int(x) not in rows}
            body = lambda r: renumbered(r["head"] or "null", moved, 0).encode("latin-1") + (b"" if r["raw"] is None else b"\nstream\n" + r["raw"] + b"\nendstream")
            extra = " ".join(f"/{k} {renumbered(v, moved, 0)}" for k, v in named.items())
            out.append(canonical([(k, 0, body(rows[n])) for n, k in new.items()], f"/Root {new[next(iter(tops))]} 0 R {extra}") if tops else data)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.binary())], ["doc_id", "content"])


def dense(docs: DataFrame) -> DataFrame:
    """doc_id, content: documents whose objects are numbered from 1 without gaps, in the order of the first visit from the root on, then from /Info.

    What nothing leads to goes, and references to what is not there become null. A document without a root stays as it is.
    """
    return docs.select("doc_id", "content").mapInArrow(_densely, "doc_id string, content binary")


def _moved(raw: Column, delta: Column, moved: Column) -> Column:
    @F.pandas_udf("string")
    def apply(values, deltas, maps):
        return values.combine(deltas, lambda v, d: (v, d)).combine(maps, lambda vd, m: None if vd[0] is None else renumbered(vd[0], dict(m) if m is not None else {}, int(vd[1])))

    return apply(raw, delta, moved)


def form_parts(objs: DataFrame, top: DataFrame) -> DataFrame:
    """doc_id, form (entries of the form's dictionary), fields (its top fields' numbers)."""
    ref = F.nullif(F.regexp_extract(F.coalesce(F.col("catalog")["AcroForm"], F.lit("")), r"^(\d{1,9})\s+\d+\s+R$", 1), F.lit("")).cast("int")
    direct = F.transform_keys(F.map_filter("catalog", lambda k, _: F.startswith(k, F.lit("AcroForm/"))), lambda k, _: F.substring(k, F.lit(10), F.length(k)))
    rows = top.where(F.col("catalog")["AcroForm"].isNotNull()).select("doc_id", ref.alias("num"), direct.alias("direct"))
    rows = rows.join(objs.select("doc_id", "num", "entries"), ["doc_id", "num"], "left").select("doc_id", F.coalesce("entries", "direct").alias("form"))
    fields = F.transform(F.regexp_extract_all(F.coalesce(F.col("form")["Fields"], F.lit("")), F.lit(r"(\d+)\s+\d+\s+R\b"), F.lit(1)), lambda x: x.cast("int"))
    return rows.select("doc_id", "form", fields.alias("fields"))


def linked_outlines(items: DataFrame, parts: DataFrame, ends: DataFrame) -> DataFrame:
    """Top items of all documents of each merged one, in order, each with the one before and after it: merged, doc_id, num, new, body, place, root, count."""
    rows = items.join(parts.select("merged", "doc_id", "position", "delta", "moved"), "doc_id").withColumn("new", (F.col("num") + F.col("delta")).cast("int"))
    order = Window.partitionBy("merged").orderBy("position", "doc_id", "ord")
    rows = rows.withColumns({"prev": F.lag("new").over(order), "next": F.lead("new").over(order), "place": F.row_number().over(order)})
    dest = F.coalesce(F.concat(F.lit(" /Dest "), _moved(F.col("dest"), F.col("delta"), F.col("moved"))), F.lit(""))
    ref = lambda key, c: F.coalesce(F.concat(F.lit(f" /{key} "), F.col(c).cast("string"), F.lit(" 0 R")), F.lit(""))
    body = F.concat(F.lit("<< /Title "), raw_literal(F.coalesce("title", F.lit(""))), dest, ref("Prev", "prev"), ref("Next", "next"), F.lit(" /Parent 3 0 R >>"))
    return rows.select("merged", "doc_id", "num", "new", body.alias("body"), "place").unionByName(
        rows.groupBy("merged").agg(
            F.lit("").alias("doc_id"), F.lit(3).alias("new"),
            F.concat(F.lit("<< /Type /Outlines /First "), F.min_by("new", "place").cast("string"), F.lit(" 0 R /Last "), F.max_by("new", "place").cast("string"), F.lit(" 0 R /Count "), F.count(F.lit(1)).cast("string"), F.lit(" >>")).alias("body"),
            F.lit(0).alias("place"),
        ).select("merged", "doc_id", F.lit(3).alias("num"), "new", "body", "place")
    )


def catalogs(parts: DataFrame, top: DataFrame, names: DataFrame, labels: DataFrame, own: DataFrame, form: DataFrame, outline: DataFrame) -> DataFrame:
    """merged, extra: the entries of each merged catalog beside its type and pages."""
    place = parts.select("merged", "doc_id", "position", "delta", "moved")
    first = place.join(top, "doc_id").groupBy("merged").agg(F.min_by(F.struct("catalog", "delta", "moved"), F.struct("position", "doc_id")).alias("f"))
    kept = F.concat_ws(" ", *[F.concat(F.lit(f"/{k} "), _moved(F.col("f.catalog")[k], F.col("f.delta"), F.col("f.moved"))) for k in FIRST])
    out = first.select("merged", kept.alias("first"))

    value = F.coalesce(_moved(F.concat(F.col("target").cast("string"), F.lit(" 0 R")), F.col("delta"), F.col("moved")), F.lit("null"))
    pairs = names.join(place.select("merged", "doc_id", "delta", "moved"), ["merged", "doc_id"]).select("merged", "kind", F.struct("name", F.concat(raw_literal(F.col("name")), F.lit(" "), value).alias("pair")).alias("p"))
    trees = pairs.groupBy("merged", "kind").agg(F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["pair"]), " ").alias("pairs"))
    trees = trees.groupBy("merged").agg(F.concat(F.lit("/Names << "), F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("/"), "kind", F.lit(" << /Names ["), "pairs", F.lit("] >>")))), " "), F.lit(" >>")).alias("names"))

    text = F.concat(F.lit("<< "), F.coalesce(F.concat(F.lit("/S /"), "style", F.lit(" ")), F.lit("")), F.coalesce(F.concat(F.lit("/P "), raw_literal(F.col("prefix")), F.lit(" ")), F.lit("")), F.lit("/St "), F.col("start").cast("string"), F.lit(" >>"))
    there = labels.join(own.select("merged", "position", "doc_id", F.col("page_index").alias("first_page"), "output_page_index"), ["doc_id", "first_page"])
    there = there.groupBy("merged", "output_page_index").agg(F.max_by(text, F.struct("position", "doc_id")).alias("label"))
    nums = there.groupBy("merged").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("output_page_index", "label"))), lambda x: F.concat(x["output_page_index"].cast("string"), F.lit(" "), x["label"])), " ").alias("n"))
    nums = nums.select("merged", F.concat(F.lit("/PageLabels << /Nums ["), "n", F.lit("] >>")).alias("labels"))

    forms = place.join(form, "doc_id")
    keys = forms.select("merged", "position", "doc_id", "delta", "moved", F.explode(F.map_filter("form", lambda k, _: ~k.rlike(r"[/=#!]") & (k != "Fields"))).alias("key", "raw"))
    keys = keys.groupBy("merged", "key").agg(F.min_by(_plain_struct(), F.struct("position", "doc_id")).alias("x"), F.max(F.col("raw") == "true").alias("any"))
    raw = F.when((F.col("key") == "NeedAppearances") & F.col("any"), "true").otherwise(_moved(F.col("x.raw"), F.col("x.delta"), F.col("x.moved")))
    keys = keys.groupBy("merged").agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("/"), "key", F.lit(" "), raw))), " ").alias("keys"))
    fields = forms.select("merged", "position", "doc_id", F.transform("fields", lambda n: F.concat((n + F.col("delta")).cast("string"), F.lit(" 0 R"))).alias("f"))
    fields = fields.groupBy("merged").agg(F.array_join(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("position", "doc_id", "f"))), lambda x: x["f"])), " ").alias("fields"))
    forms = fields.join(keys, "merged", "left").select("merged", F.concat(F.lit("/AcroForm << /Fields ["), "fields", F.lit("] "), F.coalesce("keys", F.lit("")), F.lit(" >>")).alias("form"))

    outline = outline.where("place = 0").select("merged", F.lit("/Outlines 3 0 R").alias("outline"))
    for more in (trees, nums, forms, outline):
        out = out.join(more, "merged", "left")
    return out.select("merged", F.concat(F.concat_ws(" ", "first", "names", "labels", "form", "outline"), F.lit(" ")).alias("extra"))


def _plain_struct() -> Column:
    return F.struct("raw", "delta", "moved")


def merge(objs: DataFrame, group: Column, order: Column) -> DataFrame:
    """doc_id, content: the documents of each group as one, all pages in the documents' order."""
    placed = pages(objs).select(group.cast("string").alias("merged"), order.cast("long").alias("position"), "doc_id", "page_index")
    return compose(objs, placed)


def extract(objs: DataFrame, wanted: list[int]) -> DataFrame:
    """doc_id, content: each document's pages of these indexes, in this order and as often; only documents that have them all."""
    if not wanted:
        raise ValueError("no pages are asked for")
    at = F.explode(F.array(*[F.struct(F.lit(i).cast("long").alias("position"), F.lit(p).alias("page_index")) for i, p in enumerate(wanted)])).alias("x")
    asked = objs.select("doc_id").distinct().select("doc_id", at).select("doc_id", "x.*").join(pages(objs).select("doc_id", "page_index"), ["doc_id", "page_index"])
    whole = asked.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(wanted)).select("doc_id")
    return compose(objs, asked.join(whole, "doc_id", "left_semi").select(F.col("doc_id").alias("merged"), "position", "doc_id", "page_index"))


def inserted(objs: DataFrame, into: DataFrame) -> DataFrame:
    """merged, position, doc_id, page_index: where pages lie after others are put in: into(doc_id, at, source), see insert()."""
    empty = F.array().cast("array<int>")
    listed = stage(pages(objs).groupBy("doc_id").agg(F.array_sort(F.collect_list("page_index")).alias("every")))
    place, chosen = (F.col(c) if c in into.columns else F.lit(None) for c in ("ord", "pages"))
    asked = into.select(F.col("doc_id").alias("merged"), "at", F.col("source").alias("doc_id"), place.cast("long").alias("ord"), F.coalesce(chosen.cast("array<int>"), empty).alias("pages"))
    asked = asked.join(listed, "doc_id", "left").withColumn("pages", F.when(F.size("pages") > 0, F.col("pages")).otherwise(F.col("every")))
    fine = F.col("every").isNotNull() & (F.size(F.array_except("pages", "every")) == 0) & F.col("at").between(0, F.col("n"))
    own = listed.select(F.col("doc_id").alias("merged"), F.size("every").alias("n"))
    good = asked.join(own, "merged").groupBy("merged").agg(F.min(F.coalesce(fine, F.lit(False))).alias("fine"), F.min("at").alias("at"), F.max("at").alias("last")).where("fine and at = last").select("merged", "at")
    here = good.join(listed.withColumnRenamed("doc_id", "merged"), "merged").select("merged", F.col("merged").alias("doc_id"), "at", F.explode("every").alias("page_index"))
    here = here.select("merged", F.when(F.col("page_index") < F.col("at"), 0).otherwise(2**40).cast("long").alias("position"), "doc_id", "page_index")
    new = asked.join(good.select("merged"), "merged", "left_semi").select("merged", "ord", "doc_id", F.posexplode("pages").alias("i", "page_index"))
    position = F.row_number().over(Window.partitionBy("merged").orderBy(F.col("ord").asc_nulls_last(), "doc_id", "i")).cast("long")
    return here.unionByName(new.select("merged", position.alias("position"), "doc_id", "page_index"))


def insert(objs: DataFrame, into: DataFrame) -> DataFrame:
    """doc_id, content: documents with pages of others put in: into(doc_id, at, source), at from 0 to the number of pages.

    A document may have several sources, in the order of the column ord, if there is one. The column pages, if there is one,
    names a source's pages, in this order and as often; null or none means all. Documents whose `at` is out of range or differs between
    rows, or one of whose sources isn't there or lacks a page, are left out.
    """
    return compose(objs, inserted(objs, into))


def numbers(value: Column) -> Column:
    """The numbers of an array's raw value."""
    return F.transform(F.regexp_extract_all(F.coalesce(value, F.lit("")), F.lit(r"([-+]?(?:\d+\.?\d*|\.\d+))"), F.lit(1)), lambda x: x.cast("double"))


def transformed(page_rows: DataFrame, rotate: Column | None = None, crop: Column | None = None, scale: Column | None = None) -> DataFrame:
    """page_rows(doc_id, page_index, media_box, rotate) with rotate, box and error after turning, cropping and scaling.

    A turn must be a multiple of 90 degrees, a crop must have an area, a scale must be positive.
    """
    turn, size = F.lit(0) if rotate is None else rotate, F.lit(1.0) if scale is None else scale
    box = numbers(F.col("media_box")) if crop is None else F.coalesce(crop, numbers(F.col("media_box")))
    error = (
        F.when(turn % 90 != 0, "rotation is not a multiple of 90")
        .when((box[2] <= box[0]) | (box[3] <= box[1]), "box has no area")
        .when(size <= 0, "scale is not positive")
    )
    done = {"error": error, "rotate": F.when(error.isNull(), F.pmod(F.coalesce(F.col("rotate").try_cast("int"), F.lit(0)) + turn, F.lit(360)).cast("int")), "box": F.when(error.isNull(), F.transform(box, lambda x: x * size))}
    return page_rows.withColumns(done)


def ocr_plan(items: DataFrame, page_counts: DataFrame) -> DataFrame:
    """items(doc_id, page_index, text, box, confidence) with status: accepted, or the first rule that an item breaks."""
    box = F.col("box")
    status = (
        F.when(F.col("pages").isNull(), "no_document")
        .when((F.col("page_index") < 0) | (F.col("page_index") >= F.col("pages")), "page_out_of_range")
        .when(F.trim(F.coalesce("text", F.lit(""))) == "", "no_text")
        .when(~F.col("confidence").between(0, 1), "confidence_out_of_range")
        .when((box["x_max"] <= box["x_min"]) | (box["y_max"] <= box["y_min"]), "box_without_area")
        .otherwise("accepted")
    )
    return items.join(page_counts.select("doc_id", "pages"), "doc_id", "left").withColumn("status", status)


def fallback_policy(mode: Column, used: Column, explicit: Column) -> Column:
    """Whether a report may use a fallback: none with none, or a known one that was asked for explicitly."""
    known = ("overlay", "ocr_text_layer")
    return (
        F.when(~mode.isin("none", *known), "unknown_policy")
        .when((mode == "none") & (used == "none"), "accepted")
        .when(mode == "none", "fallback_not_allowed")
        .when(~explicit, "fallback_not_explicit")
        .when(used.isin("none", mode), "accepted")
        .otherwise("other_fallback_used")
    )


def byte_range_status(docs: DataFrame) -> DataFrame:
    """doc_id, status of each document's /ByteRange: pairs of offset and length, in order, apart and inside the file."""
    text = F.decode("content", "ISO-8859-1")
    r = F.transform(F.regexp_extract_all(F.regexp_extract(text, r"/ByteRange\s*\[([^\]]*)\]", 1), F.lit(r"(-?\d+)"), F.lit(1)), lambda x: x.cast("long"))
    rows = docs.select("doc_id", F.octet_length("content").alias("length"), r.alias("r")).where("size(r) > 0")
    pairs = F.transform(F.sequence(F.lit(0), F.size("r") - 2, F.lit(2)), lambda i: F.struct(F.get("r", i).alias("a"), (F.get("r", i) + F.get("r", i + 1)).alias("b"), F.get("r", i + 1).alias("n")))
    rows = rows.withColumn("p", F.when(F.size("r") % 2 == 0, pairs))
    p = F.col("p")
    status = (
        F.when(p.isNull(), "odd_count")
        .when(F.exists(p, lambda x: (x["a"] < 0) | (x["n"] < 0)), "negative")
        .when(F.exists(p, lambda x: x["b"] > F.col("length")), "outside_file")
        .when(F.exists(F.transform(p, lambda x, i: (i > 0) & (x["a"] < F.get(p, i - 1)["b"])), lambda x: x), "overlap")
        .when(F.aggregate(p, F.lit(0).cast("long"), lambda s, x: s + x["n"]) == 0, "empty")
        .otherwise("ok")
    )
    return rows.select("doc_id", status.alias("status"))


def choice_status(objs: DataFrame) -> DataFrame:
    """doc_id, num, options, selected of choice fields of objects or documents: the value must be one option's export or display text, once."""
    rows = form_fields(objs).where("type = 'Ch'").select("doc_id", "num", F.col("value").alias("v"), F.col("options").alias("o"))
    found = F.filter(F.transform("o", lambda x, i: F.when((x["export"] == F.col("v")) | (x["display"] == F.col("v")), i)), lambda i: i.isNotNull())
    return rows.select("doc_id", "num", F.size("o").alias("options"), F.when(F.size(found) == 1, found[0]).alias("selected"))
