"""The registered queries of the document graph.

Every query mints documents from whole tables, parses the minted bytes, and answers from what the parser found; only
doc_id and content pass from the minting to the parser. `ORACLES` has the same rows from the tables themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.functions.codecs import encoded
from vellum.operators import documents, edits, graph, reports, xfa
from vellum.operators.nodes import TEXT, Selector, nodes, text_rows
from vellum.operators.nodes import page_texts as shown_texts
from vellum.plans import catalogue_changes, catalogue_documents, catalogue_objects, catalogue_rows
from vellum.plans.shared import page_texts
from vellum.plans.staging import dealt, table
from vellum.plans.staging import stage_documents as stage
from vellum.sources import mint
from vellum.sources.scan import dangling, entry, name, object_rows, objects, ref_numbers, streams, text

CHAINS = ("", "ASCIIHexDecode", "ASCII85Decode", "RunLengthDecode", "FlateDecode", "LZWDecode", "ASCIIHexDecode FlateDecode")


def _texts(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Documents of one page with a text-show for each column, parsed back: doc_id and texts, in order."""
    docs = table(spark, sf_dir, "documents")
    shown = [mint.show(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in columns]
    minted = mint.one_page(docs, F.col("doc_id"), [F.concat(*shown)])
    rows = text_rows(minted)
    texts = F.array_sort(F.collect_list(F.struct("seq", "text")))
    return rows.groupBy("doc_id").agg(F.transform(texts, lambda t: t["text"]).alias("texts"))


def text_nodes_per_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _texts(spark, sf_dir, "lang", "text")
    text = F.get("texts", F.lit(1))
    return rows.groupBy(F.get("texts", F.lit(0)).alias("lang")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(text)).alias("bytes"))


def roundtrip_literal(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _texts(spark, sf_dir, "text")
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.md5(F.get("texts", F.lit(0))).alias("digest"))


def _chained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A raw stream of each document's text under one of seven chains of filters, by doc_id."""
    docs = table(spark, sf_dir, "documents")
    chain = F.filter(F.split(F.element_at(F.array(*map(F.lit, CHAINS)), (F.pmod("doc_id", F.lit(len(CHAINS))) + 1).cast("int")), " "), lambda x: x != "")
    docs = docs.withColumn("chain", chain).withColumn("data", encoded(F.coalesce("text", F.lit("")).cast("binary"), F.col("chain")))
    names = F.concat(F.lit("/Filter ["), F.array_join(F.transform("chain", lambda c: F.concat(F.lit("/"), c)), " "), F.lit("]"))
    body = mint.stream(F.col("data"), names)
    minted = docs.select(F.col("doc_id").cast("string").alias("doc_id"), mint.document(F.array(mint.obj(1, "<< /Type /Catalog >>"), mint.obj(2, body))).alias("content"))
    return streams(objects(minted))


def roundtrip_codecs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _chained(spark, sf_dir)
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.array_join("chain", " ").alias("chain"), F.md5("data").alias("digest"), F.octet_length("data").cast("long").alias("size"))


def roundtrip_predictor(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("chain", F.array(F.lit("FlateDecode")))
    data = encoded(F.coalesce("text", F.lit("")).cast("binary"), F.col("chain"), F.array(F.create_map(F.lit("Predictor"), F.lit(12))))
    body = mint.stream(data, "/Filter /FlateDecode /DecodeParms << /Predictor 12 /Columns 1 >>")
    minted = docs.select(F.col("doc_id").cast("string").alias("doc_id"), mint.document(F.array(mint.obj(1, "<< /Type /Catalog >>"), mint.obj(2, body))).alias("content"))
    rows = streams(objects(minted))
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.md5("data").alias("digest"))


def stream_capability_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    kinds = ("", "/Filter /FlateDecode", "/Filter /DCTDecode", "/Filter [/FlateDecode /JPXDecode]", "/Filter /FooDecode", "/Filter [/AHx /Fl]")
    names = F.element_at(F.array(*map(F.lit, kinds)), (F.pmod("doc_id", F.lit(len(kinds))) + 1).cast("int"))
    body = mint.stream(F.coalesce("text", F.lit("")), names)
    minted = docs.select(F.col("doc_id").cast("string").alias("doc_id"), mint.document(F.array(mint.obj(1, "<< /Type /Catalog >>"), mint.obj(2, body))).alias("content"))
    return streams(objects(minted)).groupBy("capability").agg(F.count(F.lit(1)).alias("n"))


def select_by_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = dealt(spark, sf_dir, "customer")
    minted = mint.one_page(customers, F.col("c_custkey"), [mint.show(F.col("c_mktsegment")), mint.show(F.col("c_name"))])
    found = Selector().kind(TEXT).text("BUILDING").query_all(nodes(minted))
    return found.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("value").alias("text"))


def _turns(spark: SparkSession, sf_dir: str, text: Column, entries: Column | str = "") -> DataFrame:
    return mint.paged(table(spark, sf_dir, "conversations"), "conv_id", "turn", text, entries)


def select_match_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = nodes(_turns(spark, sf_dir, mint.show(F.coalesce("text", F.lit("")))))
    found = Selector().kind(TEXT).match_index(1).query(rows)
    return found.select(F.col("doc_id").cast("long").alias("doc_id"), F.md5("value").alias("digest"))


def find_one_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = nodes(_turns(spark, sf_dir, mint.show(F.coalesce("role", F.lit("")))))
    found = Selector().kind(TEXT).text("user").find_one(rows)
    return found.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("matches").cast("long").alias("matches"), "status")


def select_by_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = mint.show(F.coalesce("text", F.lit("")), array=F.col("turn") % 2 == 1)
    found = Selector().kind(TEXT).meta("operator", "TJ").query_all(nodes(_turns(spark, sf_dir, shown)))
    return found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("value")).alias("bytes")).select(F.col("doc_id").cast("long").alias("doc_id"), "n", "bytes")


def page_tree_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_texts(_turns(spark, sf_dir, mint.show(F.coalesce("text", F.lit("")))))


def inherited_mediabox(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = F.when(F.col("turn") % 3 == 0, F.lit("/MediaBox [0 0 200 300]")).otherwise("")
    rows = graph.pages(_turns(spark, sf_dir, mint.show(F.coalesce("role", F.lit(""))), own))
    return rows.groupBy("media_box").agg(F.count(F.lit(1)).alias("n"))


def extract_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages 2 and 0 of each document, in this order, where there are so many."""
    objs = stage(objects(_turns(spark, sf_dir, mint.show(F.coalesce("text", F.lit(""))))))
    return page_texts(stage(documents.extract(objs, [2, 0]))).select("doc_id", F.col("page_index").alias("position"), "digest")


def merge_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of each customer's order documents one after the other, an order a document of one page per line."""
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    key = F.concat(F.col("o_custkey").cast("string"), F.lit("/"), F.col("l_orderkey").cast("string"))
    shown = mint.show(F.concat_ws(" ", F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string")))
    docs = mint.paged(lines.withColumn("key", key), "key", "l_linenumber", shown)
    part = lambda i: F.split_part("doc_id", F.lit("/"), F.lit(i)).cast("long")
    # A document's texts are one row; those of a customer are put in order once they have met.
    rows = shown_texts(docs).groupBy(part(1).alias("custkey")).agg(F.sort_array(F.collect_list(F.struct(part(2).alias("orderkey"), "texts"))).alias("orders"))
    texts = F.flatten(F.transform("orders", lambda o: o["texts"]))
    return rows.select("custkey", F.size(texts).cast("long").alias("pages"), F.md5(F.array_join(texts, "|")).alias("digest"))


def dangling_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    missing = F.when(F.pmod("doc_id", F.lit(7)) == 0, F.lit("/Outlines 99 0 R")).otherwise("")
    body = F.concat(F.lit("<< /Type /Catalog /Names 2 0 R "), missing, F.lit(" >>"))
    minted = docs.select(F.col("doc_id").cast("string").alias("doc_id"), mint.document(F.array(mint.obj(1, body), mint.obj(2, mint.stream(F.coalesce("text", F.lit("")))))).alias("content"))
    rows = dangling(objects(minted))
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), "src", "dst")


def object_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's document has two revisions of one object; the later one is in force, the earlier one is counted."""
    orders = dealt(spark, sf_dir, "orders")
    old, new = (F.concat(F.lit("<< /Status "), mint.literal(x), F.lit(" >>")) for x in (F.lit("draft"), F.col("o_orderstatus")))
    minted = orders.select(F.col("o_orderkey").cast("string").alias("doc_id"), mint.document(F.array(mint.obj(1, "<< /Type /Catalog >>"), mint.obj(5, old), mint.obj(5, new))).alias("content"))
    rows = stage(object_rows(minted))
    every = rows.where("num = 5").groupBy("doc_id").agg(F.count(F.lit(1)).alias("revisions"), F.max_by("entries", "offset").alias("entries"))
    status = text("Status")
    return every.groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("n"), F.sum("revisions").alias("revisions"))


def edit_text_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replaces the role `user` where a conversation has it once; other edits are refused. Counts by status and checks."""
    got = edits.edit(_turns(spark, sf_dir, mint.show(F.coalesce("role", F.lit("")))), "user", "human - (edited)")
    checks = F.col("reparse") & F.col("old_gone") & F.col("new_selectable") & F.col("page_count_unchanged")
    return got.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(checks, 1)).alias("verified"), F.count("content").alias("written"))


def edit_codecs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same edit in filtered streams: each customer's segment, under a filter by key."""
    customers = dealt(spark, sf_dir, "customer")
    chain = F.filter(F.split(F.element_at(F.array(*map(F.lit, CHAINS)), (F.pmod("c_custkey", F.lit(len(CHAINS))) + 1).cast("int")), " "), lambda x: x != "")
    customers = customers.withColumn("chain", chain).withColumn("data", encoded(mint.show(F.col("c_mktsegment")).cast("binary"), F.col("chain")))
    names = F.concat(F.lit("/Filter ["), F.array_join(F.transform("chain", lambda c: F.concat(F.lit("/"), c)), " "), F.lit("]"))
    page = [mint.obj(1, "<< /Type /Catalog /Pages 2 0 R >>"), mint.obj(2, "<< /Type /Pages /Kids [3 0 R] /Count 1 >>"), mint.obj(3, "<< /Type /Page /Parent 2 0 R /Contents 4 0 R >>")]
    minted = stage(customers.select(F.col("c_custkey").cast("string").alias("doc_id"), mint.document(F.array(*page, mint.obj(4, mint.stream(F.col("data"), names)))).alias("content")))
    got = stage(edits.edit(minted, "BUILDING", "TOWER"))
    text = text_rows(got.where("content is not null").select("doc_id", "content")).select("doc_id", "text")
    return got.select("doc_id", "status").join(text, "doc_id", "left").groupBy("status", "text").agg(F.count(F.lit(1)).alias("n"))


def form_fields_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as forms: a parent field of type Tx and three children, named by their path, flags by key."""
    customers = dealt(spark, sf_dir, "customer")
    child = lambda n, key, value, more="": mint.obj(n, F.concat(F.lit(f"<< /Parent 3 0 R /T ({key}) /V "), mint.literal(value.cast("string")), F.lit(f" {more}>>")))
    flags = F.concat(F.lit("<< /FT /Tx /T (customer) /Kids [4 0 R 5 0 R 6 0 R] /Ff "), (F.col("c_custkey") % 8).cast("string"), F.lit(" >>"))
    objects_ = F.array(
        mint.obj(1, "<< /Type /Catalog /AcroForm << /Fields [3 0 R] >> >>"),
        mint.obj(3, flags),
        child(4, "name", F.col("c_name")),
        child(5, "segment", F.col("c_mktsegment")),
        child(6, "nation", F.col("c_nationkey"), "/Ff 4096 /RV (rich) "),
    )
    minted = customers.select(F.col("c_custkey").cast("string").alias("doc_id"), mint.document(objects_).alias("content"))
    rows = graph.form_fields(minted)
    listed = lambda c: F.array_join(c, " ")
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), "ord", "name", "type", "value", "flags", "kid_count", listed("flag_names").alias("flag_names"), listed("type_flag_names").alias("type_flag_names"), "fill_status", listed("fill_blockers").alias("fill_blockers"))


def annotation_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as notes on a page each; user by user."""
    events = dealt(spark, sf_dir, "events")
    note = F.concat(F.lit("<< /Type /Annot /Subtype /Text /Contents "), mint.literal(F.concat_ws(":", "event_type", F.col("user_id").cast("string"))), F.lit(" >>"))
    objects_ = F.array(
        mint.obj(1, "<< /Type /Catalog /Pages 2 0 R >>"),
        mint.obj(2, "<< /Type /Pages /Kids [3 0 R 4 0 R] /Count 2 >>"),
        mint.obj(3, F.concat(F.lit("<< /Type /Page /Parent 2 0 R "), F.when(F.col("event_id") % 2 == 0, "/Annots [5 0 R] ").otherwise(""), F.lit(">>"))),
        mint.obj(4, F.concat(F.lit("<< /Type /Page /Parent 2 0 R "), F.when(F.col("event_id") % 2 == 1, "/Annots [5 0 R] ").otherwise(""), F.lit(">>"))),
        mint.obj(5, note),
    )
    rows = graph.annotations(events.select(F.col("event_id").cast("string").alias("doc_id"), mint.document(objects_).alias("content")))
    kind = F.split_part("contents", F.lit(":"), F.lit(1))
    return rows.groupBy(kind.alias("event_type"), F.col("page_index").cast("long").alias("page_index")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.split_part("contents", F.lit(":"), F.lit(2)).cast("long")).alias("users"))


def xfa_dataset_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as XML forms, read back leaf by leaf."""
    orders = dealt(spark, sf_dir, "orders")
    tag = lambda k, c: F.concat(F.lit(f"<{k}>"), F.col(c).cast("string"), F.lit(f"</{k}>"))
    xml = F.concat(F.lit("<xfa:datasets xmlns:xfa='x'><xfa:data><order>"), tag("status", "o_orderstatus"), tag("priority", "o_orderpriority"), tag("customer", "o_custkey"), F.lit("</order></xfa:data></xfa:datasets>"))
    objects_ = F.array(mint.obj(1, "<< /Type /Catalog /AcroForm << /XFA [(datasets) 2 0 R] >> >>"), mint.obj(2, mint.stream(xml)))
    rows = xfa.dataset_fields(orders.select(F.col("o_orderkey").cast("string").alias("doc_id"), mint.document(objects_).alias("content")))
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), "at", "path", "value")


def validate_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents cut short where doc_id is a multiple of 5 lack the end mark; texts with a form name carry a warning."""
    docs = table(spark, sf_dir, "documents")
    objects_ = F.array(mint.obj(1, F.concat(F.lit("<< /Type /Catalog "), F.when(F.pmod("doc_id", F.lit(3)) == 0, "/AcroForm 9 0 R ").otherwise(""), F.lit(">>"))), mint.obj(2, mint.stream(F.coalesce("text", F.lit("")))))
    whole = mint.document(objects_)
    content = F.when(F.pmod("doc_id", F.lit(5)) == 0, F.substring(whole, F.lit(1), F.octet_length(whole) - 6)).otherwise(whole)
    minted = docs.select(F.col("doc_id").cast("string").alias("doc_id"), content.alias("content"))
    rows = reports.validate(minted)
    return rows.groupBy("valid", "error", F.size("warnings").cast("long").alias("warnings")).agg(F.count(F.lit(1)).alias("n"))


def profile_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reports.profile(_turns(spark, sf_dir, mint.show(F.coalesce("text", F.lit("")))))
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), "pages", "streams", "text_shows", "text_bytes")


def byte_range_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest of the bytes that a signature's range covers, here the text between two marks."""
    docs = table(spark, sf_dir, "documents")
    text = F.coalesce("text", F.lit(""))
    head = "%PDF-1.7\n1 0 obj\n<< /Type /Sig /ByteRange [0 0 "
    start = F.lit(len(head) + 10 + 1 + 10 + len("] >>\nendobj\n"))
    number = lambda n: F.lpad(n.cast("string"), 10, "0")
    content = F.concat(F.lit(head), number(start), F.lit(" "), number(F.octet_length(text)), F.lit("] >>\nendobj\n"), text).cast("binary")
    rows = reports.byte_range_digests(docs.select(F.col("doc_id").cast("string").alias("doc_id"), content.alias("content")))
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), "covered", "digest")


def cmap_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A character map of one range for each part, expanded to its entries."""
    parts = dealt(spark, sf_dir, "part")
    first = F.lpad(F.hex(F.col("p_partkey") % 200), 4, "0")
    last = F.lpad(F.hex(F.col("p_partkey") % 200 + F.col("p_size")), 4, "0")
    body = F.concat(F.lit("1 beginbfrange\n<"), first, F.lit("> <"), last, F.lit("> <0041>\nendbfrange\n"))
    minted = parts.select(F.col("p_partkey").cast("string").alias("doc_id"), mint.document(F.array(mint.obj(1, "<< /Type /Catalog >>"), mint.obj(2, mint.stream(body)))).alias("content"))
    rows = reports.cmap_entries(objects(minted))
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), "code", "target")


def width_proof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a part's name is as wide as its brand in a font of known widths: code modulo 7, plus 3."""
    parts = dealt(spark, sf_dir, "part")
    widths = " ".join(str(c % 7 + 3) for c in range(32, 127))
    font = f"<< /Type /Font /FirstChar 32 /LastChar 126 /Widths [{widths}] >>"
    page = "<< /Type /Page /Parent 5 0 R /Resources << /Font << /F1 2 0 R >> >> /Contents [3 0 R 4 0 R] >>"
    bodies = ("<< /Type /Catalog /Pages 5 0 R >>", font, mint.stream(mint.show(F.col("p_name"))), mint.stream(mint.show(F.col("p_brand"))), "<< /Type /Pages /Kids [6 0 R] /Count 1 >>", page)
    minted = parts.select(F.col("p_partkey").cast("string").alias("doc_id"), mint.document(F.array(*[mint.obj(i + 1, b) for i, b in enumerate(bodies)])).alias("content"))
    rows = reports.width_changes(minted)
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), "old_width", "new_width", "status")


QUERIES = {
    f.__name__: f
    for f in (
        text_nodes_per_lang, roundtrip_literal, roundtrip_codecs, roundtrip_predictor, stream_capability_counts, select_by_text, select_match_index, find_one_status, select_by_meta, page_tree_order,
        inherited_mediabox, extract_pages, merge_pages, dangling_refs, object_last_wins, edit_text_verify, edit_codecs, form_fields_flat, annotation_pages, xfa_dataset_fields, validate_status,
        profile_summary, byte_range_digest, cmap_expand, width_proof,
    )
}
QUERIES |= catalogue_documents.QUERIES | catalogue_objects.QUERIES | catalogue_changes.QUERIES | catalogue_rows.QUERIES
FLAGSHIP = "text_nodes_per_lang"

_CHAIN = "list_extract([" + ", ".join(f"'{c}'" for c in CHAINS) + f"], (KEY % {len(CHAINS)} + 1)::INT)"
ORACLES = {
    "text_nodes_per_lang": "SELECT coalesce(lang, '') AS lang, count(*) AS n, sum(strlen(coalesce(text, '')))::BIGINT AS bytes FROM documents GROUP BY 1",
    "roundtrip_literal": "SELECT doc_id, md5(coalesce(text, '')) AS digest FROM documents",
    "roundtrip_codecs": f"SELECT doc_id, {_CHAIN.replace('KEY', 'doc_id')} AS chain, md5(coalesce(text, '')) AS digest, strlen(coalesce(text, '')) AS size FROM documents",
    "roundtrip_predictor": "SELECT doc_id, md5(coalesce(text, '')) AS digest FROM documents",
    "stream_capability_counts": "SELECT CASE doc_id % 6 WHEN 0 THEN 'identity_pass_through' WHEN 1 THEN 'editable_reversible' WHEN 5 THEN 'editable_reversible' WHEN 4 THEN 'unsupported_target' ELSE 'pass_through_image' END AS capability, count(*) AS n FROM documents GROUP BY 1",
    "select_by_text": "SELECT c_custkey AS doc_id, c_mktsegment AS text FROM customer WHERE c_mktsegment = 'BUILDING'",
    "select_match_index": "SELECT conv_id AS doc_id, md5(text) AS digest FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations) WHERE r = 2",
    "find_one_status": "SELECT doc_id, matches, CASE WHEN matches = 0 THEN 'no_matches' WHEN matches = 1 THEN 'ok' ELSE 'multiple_matches' END AS status FROM (SELECT conv_id AS doc_id, count(*) FILTER (role = 'user') AS matches FROM conversations GROUP BY 1)",
    "select_by_meta": "SELECT conv_id AS doc_id, count(*) AS n, sum(strlen(text))::BIGINT AS bytes FROM conversations WHERE turn % 2 = 1 GROUP BY 1",
    "page_tree_order": "SELECT conv_id AS doc_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS page_index, md5(text) AS digest FROM conversations",
    "inherited_mediabox": "SELECT CASE WHEN turn % 3 = 0 THEN '[0 0 200 300]' ELSE '[0 0 612 792]' END AS media_box, count(*) AS n FROM conversations GROUP BY 1",
    "extract_pages": "WITH p AS (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations) SELECT conv_id AS doc_id, (CASE i WHEN 2 THEN 0 ELSE 1 END)::BIGINT AS position, md5(text) AS digest FROM p WHERE n >= 3 AND i IN (0, 2)",
    "merge_pages": "SELECT o_custkey AS custkey, count(*) AS pages, md5(string_agg(l_linenumber || ' ' || l_partkey, '|' ORDER BY l_orderkey, l_linenumber, l_partkey::VARCHAR)) AS digest FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1",
    "dangling_refs": "SELECT doc_id, 1::INT AS src, 99::INT AS dst FROM documents WHERE doc_id % 7 = 0",
    "object_last_wins": "SELECT o_orderstatus AS status, count(*) AS n, (2 * count(*))::BIGINT AS revisions FROM orders GROUP BY 1",
    "edit_text_verify": "WITH m AS (SELECT conv_id, count(*) FILTER (role = 'user') AS k FROM conversations GROUP BY 1) SELECT CASE WHEN k = 0 THEN 'no_matches' WHEN k = 1 THEN 'ok' ELSE 'multiple_matches' END AS status, count(*) AS n, count(*) FILTER (k = 1) AS verified, count(*) FILTER (k = 1) AS written FROM m GROUP BY 1",
    "edit_codecs": "SELECT CASE WHEN c_mktsegment = 'BUILDING' THEN 'ok' ELSE 'no_matches' END AS status, CASE WHEN c_mktsegment = 'BUILDING' THEN 'TOWER' END AS text, count(*) AS n FROM customer GROUP BY 1, 2",
    "form_fields_flat": "SELECT c_custkey AS doc_id, o::INT AS ord, k AS name, 'Tx' AS type, v AS value, f::INT AS flags, n::INT AS kid_count, array_to_string(list_filter([CASE WHEN f & 1 <> 0 THEN 'read_only' END, CASE WHEN f & 2 <> 0 THEN 'required' END, CASE WHEN f & 4 <> 0 THEN 'no_export' END], lambda x: x IS NOT NULL), ' ') AS flag_names, CASE WHEN f & 4096 <> 0 THEN 'multiline' ELSE '' END AS type_flag_names, CASE WHEN o IN (0, 3) THEN 'unsafe' ELSE 'supported' END AS fill_status, CASE o WHEN 0 THEN 'named_non_widget_kid' WHEN 3 THEN 'rich_text_value' ELSE '' END AS fill_blockers FROM (SELECT c_custkey, 0 AS o, 'customer' AS k, NULL AS v, c_custkey % 8 AS f, 3 AS n FROM customer UNION ALL SELECT c_custkey, 1, 'customer.name', c_name, c_custkey % 8, 0 FROM customer UNION ALL SELECT c_custkey, 2, 'customer.segment', c_mktsegment, c_custkey % 8, 0 FROM customer UNION ALL SELECT c_custkey, 3, 'customer.nation', c_nationkey::VARCHAR, 4096, 0 FROM customer)",
    "annotation_pages": "SELECT event_type, event_id % 2 AS page_index, count(*) AS n, sum(user_id)::BIGINT AS users FROM events GROUP BY 1, 2",
    "xfa_dataset_fields": """SELECT o_orderkey AS doc_id, "at"::INT AS "at", 'order.' || k AS path, v AS value FROM (SELECT o_orderkey, 0 AS "at", 'status' AS k, o_orderstatus AS v FROM orders UNION ALL SELECT o_orderkey, 1, 'priority', o_orderpriority FROM orders UNION ALL SELECT o_orderkey, 2, 'customer', o_custkey::VARCHAR FROM orders)""",
    "validate_status": "SELECT doc_id % 5 <> 0 AS valid, CASE WHEN doc_id % 5 = 0 THEN 'no end mark' END AS error, (CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END)::BIGINT AS warnings, count(*) AS n FROM documents GROUP BY 1, 2, 3",
    "profile_summary": "SELECT conv_id AS doc_id, count(*) AS pages, count(*) AS streams, count(*) AS text_shows, sum(strlen(text))::BIGINT AS text_bytes FROM conversations GROUP BY 1",
    "byte_range_digest": "SELECT doc_id, strlen(coalesce(text, ''))::BIGINT AS covered, sha256(coalesce(text, '')) AS digest FROM documents",
    "cmap_expand": "SELECT p_partkey AS doc_id, (p_partkey % 200 + i)::INT AS code, chr((65 + i)::INT) AS target FROM (SELECT p_partkey, unnest(range(0, p_size + 1)) AS i FROM part)",
    "width_proof": "WITH w AS (SELECT p_partkey AS doc_id, list_sum(list_transform(range(1, length(p_name) + 1), lambda i: ord(p_name[i]) % 7 + 3))::BIGINT AS a, list_sum(list_transform(range(1, length(p_brand) + 1), lambda i: ord(p_brand[i]) % 7 + 3))::BIGINT AS b FROM part) SELECT doc_id, a AS old_width, b AS new_width, CASE WHEN b = a THEN 'width_proven' WHEN b < a THEN 'width_narrower' ELSE 'reflow_required' END AS status FROM w",
} | catalogue_documents.ORACLES | catalogue_objects.ORACLES | catalogue_changes.ORACLES | catalogue_rows.ORACLES
