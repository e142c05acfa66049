"""Reports over documents: validity, profile, signed bytes, character maps and widths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions.codecs import capability, filter_chain
from vellum.operators.facts import facts, relation
from vellum.operators.graph import annotations, described
from vellum.operators.nodes import cmap_of, text_rows
from vellum.plans.staging import stage_documents as stage
from vellum.sources.scan import MARKERS, detected, entry, markers, name, number, object_places, object_rows, objects, streams, xref_summary


def validate(docs: DataFrame) -> DataFrame:
    """doc_id, valid, error, warnings: the first reason against a document, and which boundaries it has."""
    end = F.decode(F.substring(F.col("content"), F.greatest(F.lit(1), F.octet_length("content") - 1023), F.lit(1024)), "ISO-8859-1").contains("%%EOF")
    whole = docs.select("doc_id", F.when(~detected(F.col("content")), "not a document").when(~end, "no end mark").alias("error"))
    broken = object_rows(docs).where("error is not null").groupBy("doc_id").agg(F.min("error").alias("object_error"))
    signs = markers(docs)
    warn = F.array_compact(F.array(*[F.when(F.col(c), F.lit(w)) for c, w in (("has_encrypt", "encrypted"), ("has_signature", "signed"), ("has_acroform", "has a form"))]))
    rows = whole.join(broken, "doc_id", "left").join(signs.select("doc_id", warn.alias("warnings")), "doc_id")
    error = F.coalesce("error", "object_error")
    return rows.select("doc_id", error.isNull().alias("valid"), error.alias("error"), "warnings")


def profile(docs: DataFrame) -> DataFrame:
    """doc_id, pages, streams, text_shows, text_bytes."""
    objs = objects(docs)
    own = objs.groupBy("doc_id").agg(F.count(F.when(name("Type") == "Page", 1)).alias("pages"), F.count("raw").alias("streams"))
    texts = text_rows(docs).groupBy("doc_id").agg(F.count(F.lit(1)).alias("text_shows"), F.sum(F.octet_length("text")).alias("text_bytes"))
    return own.join(texts, "doc_id", "left").fillna(0, ["text_shows", "text_bytes"])


def stream_counts(objs: DataFrame) -> DataFrame:
    """doc_id, total, editable, pass_through, unsupported, filter_counts and capability_counts (name -> number) of the streams."""
    chain = filter_chain(entry("Filter"))
    own = objs.where("raw is not null").where(~name("Type").isin("ObjStm", "XRef"))
    rows = own.select("doc_id", F.array_join(chain, " ").alias("filter"), capability(chain).alias("capability"), entry("DecodeParms!").isNotNull().alias("bad"))
    of = lambda *names: F.count(F.when(F.col("capability").isin(*names), 1))
    unsupported = F.count(F.when((F.col("capability") == "unsupported_target") | F.col("bad"), 1))
    total = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("total"), of("identity_pass_through", "editable_reversible").alias("editable"), of("pass_through_image").alias("pass_through"), unsupported.alias("unsupported"))

    def by(key: str, out: str) -> DataFrame:
        counted = rows.where(F.col(key) != "").groupBy("doc_id", key).agg(F.count(F.lit(1)).alias("n"))
        return counted.groupBy("doc_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, "n")))).alias(out))

    return total.join(by("filter", "filter_counts"), "doc_id", "left").join(by("capability", "capability_counts"), "doc_id", "left")


def structure(docs: DataFrame, objs: DataFrame | None = None) -> DataFrame:
    """doc_id, total, normal, in_object_streams, xref_streams, writer, needs_canonical: where objects stand, and which writer keeps them there.

    Documents are parsed once, where they lie, and have what xref_summary() says too; of objects that were parsed before, they meet them by a
    join. A document without objects has no row.
    """
    writer = F.when(F.col("has_hybrid"), "hybrid_xref_stream").when(F.col("has_stream"), "xref_stream").otherwise("canonical")
    said = {"writer": writer, "needs_canonical": F.col("has_stream") | F.col("has_object_stream")}
    if objs is None:
        return object_places(docs).withColumns(said)
    kind = F.when(F.col("container").isNotNull(), "stream").when((name("Type") == "XRef") & F.col("raw").isNotNull(), "xref").otherwise("normal")
    of = lambda k: F.count(F.when(kind == k, 1))
    rows = objs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("total"), of("normal").alias("normal"), of("stream").alias("in_object_streams"), of("xref").alias("xref_streams"))
    return rows.join(xref_summary(docs), "doc_id").select("doc_id", "total", "normal", "in_object_streams", "xref_streams", *(c.alias(k) for k, c in said.items()))


def recommendation(valid: Column, signed: Column, blocked: Column) -> Column:
    """How a document is best rewritten. blocked: streams that can't be read, encryption or an XML form."""
    return F.when(~valid, "preserve-structure").when(signed, "surgical").when(blocked, "preserve-structure").otherwise("canonical")


def full_profile(docs: DataFrame) -> DataFrame:
    """doc_id, valid, recommendation, reasons, editable, fields, fillable, annotations, pages, text_shows and stream counts of each document, which is parsed once."""
    found = stage(facts(docs))
    objs = relation(found, "object")
    checked = relation(found, "document").select("doc_id", F.col("error").isNull().alias("valid"), *MARKERS)
    own = objs.groupBy("doc_id").agg(F.count(F.when(name("Type") == "Page", 1)).alias("pages"))
    texts = relation(found, "text").groupBy("doc_id").agg(F.count(F.lit(1)).alias("text_shows"))
    forms = described(relation(found, "field")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("fields"), F.count(F.when(F.col("fillable"), 1)).alias("fillable"))
    notes = annotations(objs, relation(found, "page")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("annotations"))
    rows = checked
    for more in (stream_counts(objs), own, texts, forms, notes):
        rows = rows.join(more, "doc_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    blocked = F.col("has_encrypt") | F.col("has_xfa") | (zero("unsupported") > 0)
    reasons = F.array_compact(
        F.array(
            F.when(F.col("has_encrypt"), F.lit("encrypted")), F.when(F.col("has_signature"), F.lit("signed")), F.when(F.col("has_xfa"), F.lit("xml_form")), F.when(F.col("has_cid_font_markers"), F.lit("fonts_by_character_number")),
            F.when(zero("unsupported") > 0, F.concat(F.lit("unsupported_streams:"), F.col("unsupported").cast("string"))),
        )
    )
    return rows.select(
        "doc_id", "valid", recommendation(F.col("valid"), F.col("has_signature"), blocked).alias("recommendation"), reasons.alias("reasons"), (F.col("valid") & (zero("text_shows") > 0)).alias("editable"),
        zero("fields").alias("fields"), zero("fillable").alias("fillable"), zero("annotations").alias("annotations"), zero("pages").alias("pages"), zero("text_shows").alias("text_shows"), zero("total").alias("streams"),
    )


#: The digests that byte_range_digests() knows.
DIGESTS = {"sha1": F.sha1} | {f"sha{n}": (lambda c, n=n: F.sha2(c, n)) for n in (224, 256, 384, 512)}


def byte_range_digests(docs: DataFrame, algorithm: str = "sha256") -> DataFrame:
    """doc_id, covered, digest of the bytes in the parts that /ByteRange names, however many, one after the other.

    algorithm: one of DIGESTS. No row without ranges; where their number is odd, or one leaves the file or overlaps the one before, the
    digest and covered are null.
    """
    if algorithm not in DIGESTS:
        raise ValueError(f"unknown digest {algorithm}")
    found = F.regexp_extract_all(F.regexp_extract(F.decode("content", "ISO-8859-1"), r"/ByteRange\s*\[([^\]]*)\]", 1), F.lit(r"(-?\d+)"), F.lit(1))
    rows = docs.select("doc_id", "content", F.transform(found, lambda x: x.try_cast("long")).alias("r")).where("size(r) > 0")
    pairs = F.transform(F.sequence(F.lit(0), F.floor(F.size("r") / 2).cast("int") - 1), lambda i: F.struct(F.get("r", 2 * i).alias("at"), F.get("r", 2 * i + 1).alias("n")))
    rows = rows.withColumn("p", F.when(F.size("r") % 2 == 0, pairs)).withColumn("before", F.concat(F.array(F.lit(0).cast("long")), F.transform("p", lambda x: x["at"] + x["n"])))
    fine = F.forall(F.arrays_zip("p", F.slice("before", 1, F.size("p")).alias("before")), lambda x: (x["p"]["at"] >= x["before"]) & (x["p"]["n"] >= 0) & (x["p"]["at"] + x["p"]["n"] <= F.octet_length("content")))
    covered = F.aggregate("p", F.lit(b""), lambda all_, x: F.concat(all_, F.substring(F.col("content"), x["at"].cast("int") + 1, x["n"].cast("int"))))
    rows = rows.withColumn("covered", F.when(F.coalesce(fine, F.lit(False)), covered))
    return rows.select("doc_id", F.octet_length("covered").cast("long").alias("covered"), DIGESTS[algorithm](F.col("covered")).alias("digest"))


def cmap_entries(objs: DataFrame) -> DataFrame:
    """doc_id, num, code, target of the entries of the character maps that streams hold: single characters and ranges."""
    maps = streams(objs).where("data is not null").select("doc_id", "num", F.explode(cmap_of(F.col("data"))).alias("code", "target"))
    return maps.select("doc_id", "num", F.conv("code", 16, 10).cast("long").alias("code"), "target")


def text_widths(docs: DataFrame) -> DataFrame:
    """doc_id, num, seq, place, text, width, known: how wide each text-show is, in the widths of its own font.

    A code has as many bytes as the font's codes have; one without a width of its own has the font's default. width is null
    where there is neither, or where the font says nothing of widths (known is false then).
    """
    rows = text_rows(docs, with_fonts=True).withColumn("size", F.nullif("code_size", F.lit(0)))
    count = F.octet_length("codes") / F.col("size")
    code = lambda i: F.conv(F.hex(F.substring(F.col("codes"), i * F.col("size") + 1, F.col("size"))), 16, 10).cast("int")
    each = F.transform(F.sequence(F.lit(0), count.cast("int") - 1), lambda i: F.coalesce(F.try_element_at("widths", code(i)), F.col("other_width")))
    whole = F.when(count == 0, 0).when(count == F.floor(count), F.aggregate(each, F.lit(0).cast("long"), lambda a, x: a + x))
    return rows.select("doc_id", "num", "seq", "place", "text", whole.cast("long").alias("width"), F.col("size").isNotNull().alias("known"))


def width_changes(docs: DataFrame) -> DataFrame:
    """doc_id, old_width, new_width, status: each document's first text-show, by stream and place in it, against its second one.

    status is unknown where the font of one says nothing of widths, width_unproven where a code has none or there is no second one.
    """
    rows = text_widths(docs).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("num", "seq", "place", "width", "known"))).alias("t"))
    at = lambda i, c: F.get("t", F.lit(i))[c]
    rows = rows.select("doc_id", at(0, "width").alias("old_width"), at(1, "width").alias("new_width"), (at(0, "known") & F.coalesce(at(1, "known"), F.lit(True))).alias("known"))
    change = F.col("new_width") - F.col("old_width")
    status = F.when(~F.col("known"), "unknown").when(change.isNull(), "width_unproven").when(change == 0, "width_proven").when(change < 0, "width_narrower").otherwise("reflow_required")
    return rows.select("doc_id", "old_width", "new_width", status.alias("status"))
