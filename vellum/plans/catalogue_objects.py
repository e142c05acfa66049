"""Queries of what stands in documents: packed objects, filters, fonts, forms, labels, outlines, notes, XML forms. Minted, parsed and answered as in `catalogue`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.functions.codecs import encoded
from vellum.operators import changes, documents, facts, graph, reports, security, xfa
from vellum.operators.nodes import text_rows
from vellum.plans.shared import page_texts
from vellum.plans.staging import dealt, table
from vellum.plans.staging import stage_documents as stage
from vellum.sources import mint
from vellum.sources.ocr import from_alto, from_json
from vellum.sources.scan import objects, streams


def _docs(rows: DataFrame, key: str, *bodies: Column | str) -> DataFrame:
    """A document for each row, of objects numbered from 1."""
    return rows.select(F.col(key).cast("string").alias("doc_id"), mint.document(F.array(*[mint.obj(i + 1, b) for i, b in enumerate(bodies)])).alias("content"))


def _long(c: str = "doc_id") -> Column:
    return F.col(c).cast("long").alias("doc_id")


def _joined(c: str) -> Column:
    return F.array_join(c, " ").alias(c)


def packed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as documents whose objects lie in object streams, found through a cross-reference stream."""
    turns = table(spark, sf_dir, "conversations")
    return page_texts(mint.paged(turns, "conv_id", "turn", mint.show(F.coalesce("text", F.lit(""))), pack=True))


def structure_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, every other one packed: where their objects stand."""
    docs = table(spark, sf_dir, "documents")
    rows = reports.structure(mint.one_page(docs, F.col("doc_id"), [mint.show(F.coalesce("text", F.lit("")))], pack=F.pmod("doc_id", F.lit(2)) == 1))
    return rows.groupBy("writer", "has_table", "has_object_stream", "needs_canonical").agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in ("total", "normal", "in_object_streams", "xref_streams")])


def indirect_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as streams whose length, filters and parameters stand in objects of their own."""
    docs = table(spark, sf_dir, "documents").withColumn("chain", F.array(F.lit("ASCIIHexDecode"), F.lit("LZWDecode")))
    early = F.pmod("doc_id", F.lit(2)).cast("int")
    parms = F.array(F.create_map().cast("map<string,int>"), F.create_map(F.lit("EarlyChange"), early))
    docs = docs.withColumn("data", encoded(F.coalesce("text", F.lit("")).cast("binary"), F.col("chain"), parms))
    body = F.concat(F.lit("<< /Length 3 0 R /Filter 4 0 R /DecodeParms 5 0 R >>\nstream\n").cast("binary"), F.col("data"), F.lit("\nendstream").cast("binary"))
    minted = _docs(docs, "doc_id", "<< /Type /Catalog >>", body, F.octet_length("data").cast("string"), "[/AHx /LZW]", F.concat(F.lit("[null << /EarlyChange "), early.cast("string"), F.lit(" >>]")))
    return streams(objects(minted)).select(_long(), F.md5("data").alias("digest"))


def predictor_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as rows of two columns of two numbers, under predictors 2, 12 and 15."""
    docs = table(spark, sf_dir, "documents")
    text = F.coalesce("text", F.lit(""))
    whole = F.concat(text, F.repeat(F.lit(" "), F.pmod(-F.octet_length(text), F.lit(4)).cast("int")))
    kind = F.element_at(F.array(F.lit(2), F.lit(12), F.lit(15)), (F.pmod("doc_id", F.lit(3)) + 1).cast("int"))
    shape = F.create_map(F.lit("Predictor"), kind, F.lit("Columns"), F.lit(2), F.lit("Colors"), F.lit(2))
    data = encoded(whole.cast("binary"), F.array(F.lit("FlateDecode")), F.array(shape))
    names = F.concat(F.lit("/Filter [/Fl] /DecodeParms [<< /Columns 2 /Colors 2 /Predictor "), kind.cast("string"), F.lit(" >>]"))
    minted = _docs(docs, "doc_id", "<< /Type /Catalog >>", mint.stream(data, names))
    return streams(objects(minted)).select(_long(), F.md5("data").alias("digest"))


_PAGE = ("<< /Type /Catalog /Pages 2 0 R >>", "<< /Type /Pages /Kids [3 0 R] /Count 1 /Resources << /Font << /F1 5 0 R >> >> >>", "<< /Type /Page /Parent 2 0 R /Contents 4 0 R >>")


def tounicode_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts' names in a font whose codes are one above the characters, two bytes each, with a character map."""
    parts = dealt(spark, sf_dir, "part")
    codes = F.array_join(F.transform(F.split("p_name", ""), lambda c: F.lpad(F.hex(F.ascii(c) + 1), 4, "0")), "")
    shown = F.concat(F.lit("BT /F1 9 Tf 10 20 Td <"), codes, F.lit("> Tj ET"))
    cmap = "/CIDInit /ProcSet findresource begin 1 begincodespacerange <0000> <FFFF> endcodespacerange\n1 beginbfrange <0021> <0080> <0020> endbfrange"
    rows = text_rows(_docs(parts, "p_partkey", *_PAGE, mint.stream(shown), "<< /Type /Font /Subtype /Type0 /Encoding /Identity-H /ToUnicode 6 0 R >>", mint.stream(F.lit(cmap))).repartition(8))
    return rows.select(_long(), "text", "encoding", "font", "x", "y")


def font_encoding_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts' brands in a simple font in which the number sign is a currency sign and B has an accent."""
    parts = dealt(spark, sf_dir, "part")
    font = "<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding << /BaseEncoding /WinAnsiEncoding /Differences [35 /Euro 66 /Aacute] >> >>"
    rows = text_rows(_docs(parts, "p_partkey", *_PAGE, mint.stream(mint.show(F.col("p_brand"))), font))
    return rows.select(_long(), "text", "encoding")


def form_invocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' segments in a form that both pages show, the second one twice over another form."""
    customers = dealt(spark, sf_dir, "customer")
    pages = ("<< /Type /Catalog /Pages 2 0 R >>", "<< /Type /Pages /Kids [3 0 R 4 0 R] /Count 2 /Resources << /XObject << /Mark 7 0 R /Twice 8 0 R >> >> >>", "<< /Type /Page /Parent 2 0 R /Contents 5 0 R >>", "<< /Type /Page /Parent 2 0 R /Contents 6 0 R >>")
    form = "/Type /XObject /Subtype /Form"
    minted = _docs(customers, "c_custkey", *pages, mint.stream(F.lit("/Mark Do")), mint.stream(F.lit("/Mark Do /Twice Do")), mint.stream(mint.show(F.col("c_mktsegment")), form), mint.stream(F.lit("/Mark Do"), form))
    rows = text_rows(minted)
    return rows.select(_long(), "text", "page_index", "depth", F.col("invocations").alias("invoked"), F.array_join("invoked_pages", " ").alias("pages"))


def page_label_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' documents with labels from page 0 and from a page by nation."""
    customers = dealt(spark, sf_dir, "customer")
    own = F.concat(F.lit("<< /Type /Catalog /PageLabels 2 0 R >>"))
    later = F.concat(F.lit("<< /Nums ["), (F.col("c_nationkey") + 1).cast("string"), F.lit(" << /S /D /P "), mint.literal(F.col("c_name")), F.lit(" /St "), (F.col("c_custkey") % 9 + 1).cast("string"), F.lit(" >>] >>"))
    rows = graph.page_labels(_docs(customers, "c_custkey", own, "<< /Kids [3 0 R 4 0 R] >>", "<< /Nums [0 << /S /r >>] >>", later))
    return rows.select(_long(), "first_page", "style", "prefix", "start")


def outline_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' documents with an outline: a name, the segment below it, the phone after it."""
    customers = dealt(spark, sf_dir, "customer")
    item = lambda title, more: F.concat(F.lit("<< /Title "), mint.literal(F.col(title).cast("string")), F.lit(f" {more} >>"))
    minted = _docs(customers, "c_custkey", "<< /Type /Catalog /Outlines 2 0 R >>", "<< /Type /Outlines /First 3 0 R /Last 5 0 R >>", item("c_name", "/First 4 0 R /Next 5 0 R"), item("c_mktsegment", "/Parent 3 0 R"), item("c_nationkey", "/Prev 3 0 R"))
    return graph.outlines(minted).select(_long(), "ord", "depth", "title")


def merged_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers' documents of one page merged by nation: names, labels, outlines and fields of all, in order, read back from the merged files."""
    suppliers = dealt(spark, sf_dir, "supplier")
    key = F.concat_ws("/", F.col("s_nationkey").cast("string"), F.col("s_suppkey").cast("string"))
    tag = lambda before, c, after: F.concat(F.lit(before), mint.literal(F.col(c)), F.lit(after))
    top = F.concat(F.lit("<< /Type /Catalog /Pages 2 0 R /Outlines 4 0 R /PageLabels << /Nums [0 << /S /D >>] >> /AcroForm << /Fields [6 0 R] >> "), tag("/Names << /Dests << /Names [", "s_name", " 3 0 R (same) 3 0 R] >> >> >>"))
    minted = _docs(suppliers.withColumn("key", key), "key", top, "<< /Type /Pages /Kids [3 0 R] >>", "<< /Type /Page /Parent 2 0 R >>", "<< /First 5 0 R >>", tag("<< /Title ", "s_name", " >>"), tag("<< /FT /Tx /T ", "s_name", " >>"))
    objs = stage(objects(minted))
    part = lambda i: F.split_part("doc_id", F.lit("/"), F.lit(i))
    merged = stage(documents.merge(objs, part(1), part(2).cast("long")))
    again = stage(objects(merged))
    listed = lambda rows, c: rows.groupBy("doc_id").agg(F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", c))), lambda x: x[c]), "|")).alias(c))
    titles, fields = listed(graph.outlines(again), "title"), listed(graph.form_fields(again), "name")
    names = graph.name_entries(again).groupBy("doc_id").agg(F.count(F.lit(1)).alias("names"), F.count(F.when(F.col("name").startswith("same#doc"), 1)).alias("renamed"))
    labels = graph.page_labels(again).groupBy("doc_id").agg(F.count(F.lit(1)).alias("labels"))
    return titles.join(fields, "doc_id").join(names, "doc_id").join(labels, "doc_id").select(_long(), F.col("title").alias("titles"), F.col("name").alias("fields"), "names", "renamed", "labels")


def annotation_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as notes, the even ones in the page's list itself, the odd ones twice in the lists; flags by event."""
    events = dealt(spark, sf_dir, "events")
    note = F.concat(F.lit("<< /Type /Annot /Subtype /Square /Rect [0 0 "), (F.col("event_id") % 3).cast("string"), F.lit(" 9] /F "), (F.col("event_id") % 1024).cast("string"), F.lit(" /Contents "), mint.literal(F.col("event_type")), F.lit(" >>"))
    even = F.col("event_id") % 2 == 0
    first = F.concat(F.lit("<< /Type /Page /Parent 2 0 R /Annots ["), F.when(even, note).otherwise("5 0 R"), F.lit("] >>"))
    second = F.concat(F.lit("<< /Type /Page /Parent 2 0 R /Annots ["), F.when(even, "").otherwise("5 0 R"), F.lit("] >>"))
    minted = _docs(events, "event_id", "<< /Type /Catalog /Pages 2 0 R >>", "<< /Type /Pages /Kids [4 0 R 3 0 R] >>", first, second, F.when(even, "null").otherwise(note))
    rows = graph.annotations(minted)
    return rows.groupBy("contents", "page_index", "appearance_status", F.col("num").isNull().alias("direct")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("flag_names")).alias("flags"))


def field_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as fields of several kinds and flags: what could be filled, and why others could not."""
    orders = dealt(spark, sf_dir, "orders")
    kinds = ("/FT /Tx /Rect [0 0 1 1]", "/FT /Tx /RV (r)", "/FT /Ch /Ff 2097152", "/FT /Ch /Opt [(a) (b)] /Ff 1", "/FT /Btn", "/FT /Btn /AP << /N << /On 1 0 R >> >>", "/FT /Sig", "/FT /Tx /AA << /K << /S /JavaScript >> >>")
    own = F.element_at(F.array(*map(F.lit, kinds)), (F.col("o_orderkey") % len(kinds) + 1).cast("int"))
    minted = _docs(orders, "o_orderkey", "<< /Type /Catalog /AcroForm << /Fields [2 0 R] >> >>", F.concat(F.lit("<< /T (f) "), own, F.lit(" >>")))
    rows = graph.form_fields(minted)
    return rows.groupBy("type", "appearance_status", "fill_status", _joined("fill_blockers"), "fillable").agg(F.count(F.lit(1)).alias("n"))


def xfa_semantics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders' XML forms: static, flowing, of an unknown kind, or none."""
    orders = dealt(spark, sf_dir, "orders")
    kind = F.col("o_orderkey") % 4
    template = F.concat(F.lit("<template><subform name='a' layout='"), F.when(kind == 1, "flowed").otherwise("paginate"), F.lit("'><field name='b'/></subform></template>"))
    data = F.concat(F.lit("<datasets><data><a><b>"), F.col("o_orderkey").cast("string"), F.lit("</b></a></data></datasets>"))
    label = F.when(kind == 2, "odd").otherwise("datasets")
    top = F.when(kind == 3, "<< /Type /Catalog >>").otherwise(F.concat(F.lit("<< /Type /Catalog /AcroForm << /XFA [(template) 2 0 R ("), label, F.lit(") 3 0 R] >> >>")))
    data = F.when(kind == 2, F.lit("<other/>")).otherwise(data)
    rows = xfa.semantics(_docs(orders, "o_orderkey", top, mint.stream(template), mint.stream(data)))
    return rows.groupBy("classification", "editable", "packets", _joined("reasons")).agg(F.count(F.lit(1)).alias("n"))


def inspect_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as pages with a text each, by doc_id plain, with an image, with an unknown filter, cut short, encrypted, with an XML form or signed: what inspect() says of them."""
    docs = table(spark, sf_dir, "documents")
    kind = F.pmod("doc_id", F.lit(7))
    other = F.when(kind == 1, "/Filter /DCTDecode").when(kind == 2, "/Filter /FooDecode").otherwise("")
    top = F.concat(F.lit("<< /Type /Catalog /Pages 2 0 R "), F.when(kind == 5, "/AcroForm << /XFA (x) >> ").otherwise(""), F.lit(">>"))
    page = [mint.obj(1, top), mint.obj(2, "<< /Type /Pages /Kids [3 0 R] /Count 1 /Resources << >> >>"), mint.obj(3, "<< /Type /Page /Parent 2 0 R /Contents [4 0 R] >>"), mint.obj(4, mint.stream(mint.show(F.coalesce("text", F.lit("")))))]
    more = F.when(kind.isin(1, 2), F.array(mint.obj(5, mint.stream(F.lit("x"), other)))).when(kind == 6, F.array(mint.obj(5, "<< /Type /Sig /ByteRange [0 1 2 3] >>"))).otherwise(F.array().cast("array<struct<num:int,gen:int,body:binary>>"))
    whole = mint.document(F.concat(F.array(*page), more), extra=F.when(kind == 4, " /Encrypt << /Filter /Standard >>").otherwise(""))
    content = F.when(kind == 3, F.substring(whole, F.lit(1), F.octet_length(whole) - 6)).otherwise(whole)
    rows = facts.inspect(docs.select(F.col("doc_id").cast("string").alias("doc_id"), content.alias("content")))
    zero = lambda k: F.coalesce(F.col(f"stream_filters.{k}"), F.lit(0)).alias(k)
    return rows.select(
        _long(), "format", "nodes", "header", "pages", "parse_error", zero("total"), zero("editable"), zero("pass_through"), zero("unsupported"), F.array_join(F.transform("streams", lambda s: s["filter"]), ",").alias("filters"),
        F.col("xref.has_table").alias("has_table"), F.col("boundaries.has_xfa").alias("has_xfa"), F.coalesce("security.encrypted", F.lit(False)).alias("encrypted"), F.coalesce("security.signed", F.lit(False)).alias("signed"),
    )


def profile_recommendation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that are signed, cut short, hold streams that can't be read, or are plain: how they are best rewritten."""
    docs = table(spark, sf_dir, "documents")
    kind = F.pmod("doc_id", F.lit(4))
    signed = F.when(kind == 1, "/ByteRange [0 1 2 3] ").otherwise("")
    bodies = [F.concat(F.lit("<< /Type /Catalog /Pages 2 0 R "), signed, F.lit(">>")), "<< /Type /Pages /Kids [3 0 R] /Resources << >> >>", "<< /Type /Page /Parent 2 0 R /Contents 4 0 R >>", mint.stream(mint.show(F.coalesce("text", F.lit("")))), mint.stream(F.lit("x"), F.when(kind == 2, "/Filter /FooDecode").otherwise(F.lit("")))]
    minted = _docs(docs, "doc_id", *bodies)
    cut = F.pmod(F.col("doc_id").cast("long"), F.lit(4)) == 3
    minted = stage(minted.withColumn("content", F.when(cut, F.substring(F.col("content"), F.lit(1), F.octet_length("content") - 6)).otherwise(F.col("content"))))
    rows = reports.full_profile(minted)
    return rows.groupBy("valid", "recommendation", _joined("reasons"), "editable", "pages", "text_shows", "streams").agg(F.count(F.lit(1)).alias("n"))


def edit_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' fields set to their segment, every third one under a name that is not there; read back from what was written."""
    customers = dealt(spark, sf_dir, "customer")
    minted = stage(_docs(customers, "c_custkey", "<< /Type /Catalog /AcroForm << /Fields [2 0 R] >> >>", F.concat(F.lit("<< /FT /Tx /T (segment) /V "), mint.literal(F.col("c_name")), F.lit(" >>"))))
    wanted = customers.select(F.col("c_custkey").cast("string").alias("doc_id"), F.when(F.col("c_custkey") % 3 == 0, "other").otherwise("segment").alias("name"), F.col("c_mktsegment").alias("value"))
    got = stage(changes.set_fields(minted, wanted))
    value = graph.form_fields(got.where("content is not null").select("doc_id", "content")).select("doc_id", "value")
    return got.select("doc_id", "status").join(value, "doc_id", "left").select(_long(), "status", "value")


def edit_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' notes set to their segment; rich ones are left alone."""
    customers = dealt(spark, sf_dir, "customer")
    rich = F.when(F.col("c_custkey") % 4 == 0, "/RC (rich) ").otherwise("")
    note = F.concat(F.lit("<< /Type /Annot /Subtype /Text /Rect [0 0 1 1] "), rich, F.lit("/Contents "), mint.literal(F.col("c_name")), F.lit(" >>"))
    minted = stage(_docs(customers, "c_custkey", "<< /Type /Catalog /Pages 2 0 R >>", "<< /Type /Pages /Kids [3 0 R] >>", "<< /Type /Page /Parent 2 0 R /Annots [4 0 R] >>", note))
    wanted = customers.select(F.col("c_custkey").cast("string").alias("doc_id"), F.lit(0).alias("annotation_index"), F.col("c_mktsegment").alias("contents"))
    got = stage(changes.set_contents(minted, wanted))
    text = graph.annotations(got.where("content is not null").select("doc_id", "content")).select("doc_id", "contents")
    return got.select("doc_id", "status").join(text, "doc_id", "left").select(_long(), "status", "contents")


def edit_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders' XML data: the status becomes the priority, but for flowing forms; read back from what was written."""
    orders = dealt(spark, sf_dir, "orders")
    layout = F.when(F.col("o_orderkey") % 5 == 0, "flowed").otherwise("paginate")
    template = F.concat(F.lit("<template><subform name='o' layout='"), layout, F.lit("'/></template>"))
    data = F.concat(F.lit("<datasets><data><o><key>"), F.col("o_orderkey").cast("string"), F.lit("</key><status>"), F.col("o_orderstatus"), F.lit("</status></o></data></datasets>"))
    minted = _docs(orders, "o_orderkey", "<< /Type /Catalog /AcroForm << /XFA [(template) 2 0 R (datasets) 3 0 R] >> >>", mint.stream(template), mint.stream(data, "/Marker (keep)"))
    wanted = orders.select(F.col("o_orderkey").cast("string").alias("doc_id"), F.lit("o.status").alias("path"), F.col("o_orderpriority").alias("value"))
    got = stage(changes.set_data(minted, wanted))
    # Values are read back with what was said of their documents; the others have none.
    value = xfa.dataset_fields(got.where("content is not null"), "status").where("path = 'o.status'").select("status", "value")
    rows = value.unionByName(got.where("content is null").select("status", F.lit(None).cast("string").alias("value")))
    return rows.groupBy("status", "value").agg(F.count(F.lit(1)).alias("n"))


def edit_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as pages, turned by size times 30 degrees and scaled by two: boxes and turns read back from what was written."""
    parts = dealt(spark, sf_dir, "part")
    box = F.concat(F.lit("<< /Type /Page /Parent 2 0 R /Contents 4 0 R /MediaBox [0 0 100 "), (F.col("p_size") + 1).cast("string"), F.lit("] >>"))
    minted = stage(_docs(parts, "p_partkey", "<< /Type /Catalog /Pages 2 0 R >>", "<< /Type /Pages /Kids [3 0 R] >>", box, mint.stream(mint.show(F.col("p_name")))))
    wanted = parts.select(F.col("p_partkey").cast("string").alias("doc_id"), F.lit(0).alias("page_index"), (F.col("p_size") * 30).cast("int").alias("turn"), F.lit(None).cast("array<double>").alias("crop"), F.lit(2.0).alias("scale"))
    got = stage(changes.transform_pages(minted, wanted))
    tree = graph.pages(got.where("content is not null").select("doc_id", "content")).select("doc_id", "rotate", "media_box")
    return got.select("doc_id", "status").join(tree, "doc_id", "left").groupBy("status", "rotate", "media_box").agg(F.count(F.lit(1)).alias("n"))


def ocr_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as ALTO files of a page for each, and as JSON: the recognised text and boxes of both, side by side."""
    orders = dealt(spark, sf_dir, "orders")
    n = lambda c: F.col(c).cast("string")
    width = (F.col("o_orderkey") % 50 + 1).cast("string")
    string = F.concat(F.lit("<String CONTENT='"), F.col("o_orderpriority"), F.lit("' HPOS='10' VPOS='20' WIDTH='"), width, F.lit("' HEIGHT='5' WC='0.5'/>"))
    alto = F.concat(F.lit("<alto><Layout><Page/><Page><TextLine>"), string, F.lit("</TextLine></Page></Layout></alto>"))
    right = (F.col("o_orderkey") % 50 + 11).cast("string")
    json = F.concat(F.lit('{"items": [{"page_index": 1, "text": "'), F.col("o_orderpriority"), F.lit('", "box": {"x_min": 10, "y_min": 20, "x_max": '), right, F.lit(', "y_max": 25}, "confidence": 0.5}]}'))
    files = lambda c: orders.select(n("o_orderkey").alias("doc_id"), c.cast("binary").alias("content"))
    both = from_alto(files(alto)).withColumn("kind", F.lit("alto")).unionByName(from_json(files(json)).withColumn("kind", F.lit("json")))
    return both.where("error is null").select(_long(), "kind", "page_index", "text", "x_min", "y_min", "x_max", "y_max", "confidence")


def security_refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that are encrypted in two ways, signed, or free: why they can't be edited, and what the encryption is."""
    docs = table(spark, sf_dir, "documents")
    kind = F.pmod("doc_id", F.lit(4))
    extra = F.when(kind == 1, " /Encrypt << /Filter /Standard /V 2 /R 3 /Length 128 /P -44 >>").when(kind == 2, " /Encrypt << /Filter /Other /V 1 >>").otherwise("")
    top = F.when(kind == 3, "<< /Type /Catalog /ByteRange [0 1 2 3] >>").otherwise("<< /Type /Catalog >>")
    minted = stage(docs.select(F.col("doc_id").cast("string").alias("doc_id"), mint.document(F.array(mint.obj(1, top), mint.obj(2, mint.stream(F.coalesce("text", F.lit(""))))), 1, extra).alias("content")))
    rows = security.check(minted).join(security.encryption(minted), "doc_id", "left")
    known = [F.coalesce(c, F.lit(-1)).alias(c) for c in ("version", "revision", "length", "permissions")]
    return rows.groupBy("refusal", "filter", *known).agg(F.count(F.lit(1)).alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        packed_pages, structure_kinds, indirect_parameters, predictor_shapes, tounicode_text, font_encoding_text, form_invocations, page_label_rows, outline_rows, merged_catalog, annotation_flags, field_status, xfa_semantics,
        inspect_report, profile_recommendation, edit_fields, edit_notes, edit_data, edit_pages, ocr_sources, security_refusals,
    )
}

ORACLES = {
    "packed_pages": "SELECT conv_id AS doc_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS page_index, md5(text) AS digest FROM conversations",
    "structure_kinds": """SELECT CASE WHEN p THEN 'xref_stream' ELSE 'canonical' END AS writer, NOT p AS has_table, p AS has_object_stream, p AS needs_canonical, count(*) AS n, sum(CASE WHEN p THEN 6 ELSE 4 END)::BIGINT AS total,
        sum(CASE WHEN p THEN 2 ELSE 4 END)::BIGINT AS normal, sum(CASE WHEN p THEN 3 ELSE 0 END)::BIGINT AS in_object_streams, sum(CASE WHEN p THEN 1 ELSE 0 END)::BIGINT AS xref_streams FROM (SELECT doc_id % 2 = 1 AS p FROM documents) GROUP BY p""",
    "indirect_parameters": "SELECT doc_id, md5(coalesce(text, '')) AS digest FROM documents",
    "predictor_shapes": "SELECT doc_id, md5(coalesce(text, '') || repeat(' ', ((4 - strlen(coalesce(text, '')) % 4) % 4)::INT)) AS digest FROM documents",
    "tounicode_text": "SELECT p_partkey AS doc_id, p_name AS text, 'hex-cmap' AS encoding, 'F1' AS font, 10.0::DOUBLE AS x, 20.0::DOUBLE AS y FROM part",
    "font_encoding_text": "SELECT p_partkey AS doc_id, replace(replace(p_brand, '#', '€'), 'B', 'Á') AS text, 'literal-font-encoding' AS encoding FROM part",
    "form_invocations": """SELECT c_custkey AS doc_id, c_mktsegment AS text, p::INT AS page_index, d::INT AS depth, 3::INT AS invoked, '3 4' AS pages
        FROM customer, (SELECT unnest([0, 1, 1]) AS p, unnest([1, 1, 2]) AS d)""",
    "page_label_rows": """SELECT c_custkey AS doc_id, 0::INT AS first_page, 'r' AS style, NULL AS prefix, 1::INT AS start FROM customer
        UNION ALL SELECT c_custkey, (c_nationkey + 1)::INT, 'D', c_name, (c_custkey % 9 + 1)::INT FROM customer""",
    "outline_rows": """SELECT c_custkey AS doc_id, 0::INT AS ord, 0::INT AS depth, c_name AS title FROM customer UNION ALL SELECT c_custkey, 1, 1, c_mktsegment FROM customer UNION ALL SELECT c_custkey, 2, 0, c_nationkey::VARCHAR FROM customer""",
    "merged_catalog": """SELECT s_nationkey::BIGINT AS doc_id, md5(string_agg(s_name, '|' ORDER BY s_suppkey)) AS titles, md5(string_agg(s_name, '|' ORDER BY s_suppkey)) AS fields, 2 * count(*) AS names, count(*) - 1 AS renamed, count(*) AS labels
        FROM supplier GROUP BY 1""",
    "annotation_flags": """SELECT event_type AS contents, (CASE WHEN event_id % 2 = 0 THEN 1 ELSE 0 END)::INT AS page_index, CASE WHEN event_id % 3 = 0 THEN 'unsupported' ELSE 'approximate_supported' END AS appearance_status, event_id % 2 = 0 AS direct,
        count(*) AS n, sum(bit_count((event_id % 1024)::BIGINT))::BIGINT AS flags FROM events GROUP BY ALL""",
    "field_status": """WITH k AS (SELECT unnest(range(0, 8)) AS i, unnest(['Tx', 'Tx', 'Ch', 'Ch', 'Btn', 'Btn', 'Sig', 'Tx']) AS type,
          unnest(['approximate_supported', 'unsafe', 'unsupported', 'unsupported', 'unsupported', 'existing_button_state_only', 'unsupported', 'unsupported']) AS appearance_status,
          unnest(['supported', 'unsafe', 'unsupported', 'supported', 'unsupported', 'supported', 'unsupported', 'unsafe']) AS fill_status,
          unnest(['', 'rich_text_value', 'multi_select_missing_options', '', 'missing_or_ambiguous_button_appearance_states', '', 'unsupported_field_type', 'field_additional_actions field_javascript_action']) AS fill_blockers,
          unnest([true, false, false, false, false, true, false, false]) AS fillable)
        SELECT type, appearance_status, fill_status, fill_blockers, fillable, count(*) AS n FROM orders JOIN k ON o_orderkey % 8 = i GROUP BY ALL""",
    "xfa_semantics": """SELECT ['static_datasets_template', 'dynamic_rendering_required', 'unknown', 'none'][(o_orderkey % 4 + 1)::INT] AS classification, o_orderkey % 4 = 0 AS editable, (CASE WHEN o_orderkey % 4 = 3 THEN 0 ELSE 2 END)::BIGINT AS packets,
        CASE WHEN o_orderkey % 4 = 1 THEN 'flowed layout' ELSE '' END AS reasons, count(*) AS n FROM orders GROUP BY ALL""",
    "inspect_report": """WITH d AS (SELECT doc_id, (doc_id % 7)::INT AS k FROM documents)
        SELECT doc_id, 'pdf' AS format, [3, 4, 4, 0, 0, 0, 0][k + 1]::BIGINT AS nodes, '%PDF-1.7' AS header, 1::BIGINT AS pages, [NULL, NULL, NULL, 'no end mark', 'encrypted', 'xml_form', 'signed'][k + 1] AS parse_error,
          [1, 2, 2, 0, 0, 0, 0][k + 1]::BIGINT AS total, (CASE WHEN k < 3 THEN 1 ELSE 0 END)::BIGINT AS editable, (k = 1)::BIGINT AS pass_through, (k = 2)::BIGINT AS unsupported,
          ['', ',DCTDecode', ',FooDecode', NULL, NULL, NULL, NULL][k + 1] AS filters, TRUE AS has_table, k = 5 AS has_xfa, k = 4 AS encrypted, k = 6 AS signed FROM d""",
    "profile_recommendation": """SELECT doc_id % 4 <> 3 AS valid, ['canonical', 'surgical', 'preserve-structure', 'preserve-structure'][(doc_id % 4 + 1)::INT] AS recommendation, ['', 'signed', 'unsupported_streams:1', ''][(doc_id % 4 + 1)::INT] AS reasons,
        doc_id % 4 <> 3 AS editable, 1::BIGINT AS pages, 1::BIGINT AS text_shows, 2::BIGINT AS streams, count(*) AS n FROM documents GROUP BY ALL""",
    "edit_fields": "SELECT c_custkey AS doc_id, CASE WHEN c_custkey % 3 = 0 THEN 'no_field' ELSE 'ok' END AS status, CASE WHEN c_custkey % 3 <> 0 THEN c_mktsegment END AS value FROM customer",
    "edit_notes": "SELECT c_custkey AS doc_id, CASE WHEN c_custkey % 4 = 0 THEN 'rich_text' ELSE 'ok' END AS status, CASE WHEN c_custkey % 4 <> 0 THEN c_mktsegment END AS contents FROM customer",
    "edit_data": "SELECT CASE WHEN o_orderkey % 5 = 0 THEN 'not_editable' ELSE 'ok' END AS status, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderpriority END AS value, count(*) AS n FROM orders GROUP BY ALL",
    "edit_pages": """SELECT CASE WHEN p_size * 30 % 90 <> 0 THEN 'rotation is not a multiple of 90' ELSE 'ok' END AS status, CASE WHEN p_size * 30 % 90 = 0 THEN (p_size * 30 % 360)::VARCHAR END AS rotate,
        CASE WHEN p_size * 30 % 90 = 0 THEN '[0 0 200 ' || (2 * (p_size + 1)) || ']' END AS media_box, count(*) AS n FROM part GROUP BY ALL""",
    "ocr_sources": """SELECT o_orderkey AS doc_id, kind, 1::INT AS page_index, o_orderpriority AS text, 10.0::DOUBLE AS x_min, 20.0::DOUBLE AS y_min, (o_orderkey % 50 + 11)::DOUBLE AS x_max, 25.0::DOUBLE AS y_max, 0.5::DOUBLE AS confidence
        FROM orders, (SELECT unnest(['alto', 'json']) AS kind)""",
    "security_refusals": """SELECT [NULL, 'password_required', 'unsupported_encryption', 'signed'][(doc_id % 4 + 1)::INT] AS refusal, [NULL, 'Standard', 'Other', NULL][(doc_id % 4 + 1)::INT] AS "filter", [-1, 2, 1, -1][(doc_id % 4 + 1)::INT]::INT AS version,
        (CASE WHEN doc_id % 4 = 1 THEN 3 ELSE -1 END)::INT AS revision, (CASE WHEN doc_id % 4 = 1 THEN 128 ELSE -1 END)::INT AS length, (CASE WHEN doc_id % 4 = 1 THEN -44 ELSE -1 END)::INT AS permissions, count(*) AS n FROM documents GROUP BY ALL""",
}
