"""More queries of the document graph: whole documents and their policies. Minted, parsed and answered as in `catalogue`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.operators import documents, graph, xfa
from vellum.operators.verification import verify_pages
from vellum.plans.shared import page_texts
from vellum.plans.staging import dealt, table
from vellum.plans.staging import stage_documents as stage
from vellum.sources import mint
from vellum.sources.scan import entry, name, number, objects, xref_entries


def xref_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two cross-reference sections for each order: the second moves object 2 and adds object 3 by the total price."""
    orders = dealt(spark, sf_dir, "orders")
    pad = lambda c: F.lpad(c.cast("string"), 10, "0")
    price = F.floor("o_totalprice").cast("long") % 1_000_000
    first = F.concat(F.lit("%PDF-1.7\nxref\n0 3\n0000000000 65535 f \n0000000009 00000 n \n"), pad(F.col("o_custkey")), F.lit(" 00000 n \ntrailer\n<< >>\n"))
    second = F.concat(F.lit("xref\n2 2\n"), pad(price), F.lit(" 00000 n \n"), pad(F.col("o_orderkey")), F.lit(" 00000 n \ntrailer\n<< >>\n%%EOF"))
    docs = orders.select(F.col("o_orderkey").cast("string").alias("doc_id"), F.concat(first, second).cast("binary").alias("content"))
    rows = documents.xref_in_force(xref_entries(docs))
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("num").cast("int").alias("num"), "offset", "sections")


def name_tree_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document of names for each customer, merged by nation: the names are segments, so that they collide."""
    customers = dealt(spark, sf_dir, "customer")
    leaf = F.concat(F.lit("<< /Names ["), mint.literal(F.col("c_mktsegment")), F.lit(" 5 0 R "), mint.literal(F.col("c_name")), F.lit(" 6 0 R] >>"))
    body = F.array(
        mint.obj(1, "<< /Type /Catalog /Names 2 0 R >>"), mint.obj(2, "<< /Dests 3 0 R >>"), mint.obj(3, "<< /Kids [7 0 R] >>"), mint.obj(7, "<< /Kids [4 0 R] >>"), mint.obj(4, leaf), mint.obj(5, "[0]"), mint.obj(6, "[1]"),
    )
    ids = F.concat_ws("/", F.col("c_nationkey").cast("string"), F.col("c_custkey").cast("string"))
    docs = customers.select(ids.alias("doc_id"), mint.document(body).alias("content"))
    part = lambda i: F.split_part("doc_id", F.lit("/"), F.lit(i)).cast("long")
    rows = documents.merged_names(graph.name_entries(docs), part(1), part(2))
    return rows.select(F.col("merged").alias("nation"), F.col("part").alias("custkey"), "name", "target")


def merge_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations' documents merged four at a time into real documents, which are parsed again."""
    turns = table(spark, sf_dir, "conversations")
    objs = stage(objects(mint.paged(turns, "conv_id", "turn", mint.show(F.coalesce("text", F.lit(""))))))
    group = F.floor(F.col("doc_id").cast("long") / 4).cast("string")
    merged = stage(documents.merge(objs, group, F.col("doc_id").cast("long")))
    texts = page_texts(merged, "text")
    boxes = graph.pages(merged).groupBy("doc_id").agg(F.count(F.when(F.col("media_box") == "[0 0 612 792]", 1)).alias("boxes"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("page_index", "text"))), lambda r: F.md5(r["text"]))
    rows = texts.groupBy("doc_id").agg(F.count(F.lit(1)).alias("pages"), F.md5(F.array_join(listed, "|")).alias("digest"))
    return rows.join(boxes, "doc_id").select(F.col("doc_id").cast("long").alias("doc_id"), "pages", "boxes", "digest")


def page_transforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as pages: turned by size times 30 degrees, cropped to size by retail price, scaled by two."""
    parts = dealt(spark, sf_dir, "part")
    page = F.concat(F.lit("<< /Type /Page /Parent 2 0 R /Turn "), (F.col("p_size") * 30).cast("string"), F.lit(" /CropTo [0 0 "), (F.col("p_size") - 5).cast("string"), F.lit(" "), F.floor("p_retailprice").cast("string"), F.lit("] >>"))
    body = F.array(mint.obj(1, "<< /Type /Catalog /Pages 2 0 R >>"), mint.obj(2, "<< /Type /Pages /Kids [3 0 R] /MediaBox [0 0 612 792] >>"), mint.obj(3, page))
    pages = graph.pages(parts.select(F.col("p_partkey").cast("string").alias("doc_id"), mint.document(body).alias("content")), own=("Turn", "CropTo"))
    asked = pages.withColumns({"turn": number("Turn"), "crop": documents.numbers(entry("CropTo"))})
    rows = documents.transformed(asked, F.col("turn"), F.col("crop"), F.lit(2.0))
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("rotate", F.lit(-1)).alias("rotate"), F.get("box", F.lit(2)).alias("width"), F.get("box", F.lit(3)).alias("height"), "error")


def ocr_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as recognised text on the pages of conversations: page by user, confidence by value."""
    turns = table(spark, sf_dir, "conversations")
    counts = graph.pages(mint.paged(turns, "conv_id", "turn", mint.show(F.coalesce("role", F.lit(""))))).groupBy("doc_id").agg(F.count(F.lit(1)).alias("pages"))
    events = dealt(spark, sf_dir, "events")
    box = F.struct(F.lit(0.0).alias("x_min"), F.lit(0.0).alias("y_min"), (F.col("event_id") % 5).cast("double").alias("x_max"), F.lit(1.0).alias("y_max"))
    docs = counts.count()  # events are spread over all of them, as conversations are numbered without gaps
    items = events.select((F.col("event_id") % docs).cast("string").alias("doc_id"), (F.col("user_id") % 6 - 1).cast("int").alias("page_index"), F.when(F.col("event_id") % 11 > 0, F.col("event_type")).alias("text"), box.alias("box"), (F.col("event_id") % 13 / 10).alias("confidence"))
    return documents.ocr_plan(items, counts).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def fallback_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as documents that name a policy, the fallback used and whether it was asked for; judged from what is parsed."""
    modes, used = (F.element_at(F.array(*map(F.lit, names)), (F.col(c) % len(names) + 1).cast("int")) for names, c in ((("none", "overlay", "ocr_text_layer", "magic"), "event_id"), (("none", "overlay", "ocr_text_layer"), "user_id")))
    asked = F.when(F.col("event_id") % 3 == 0, "true").otherwise("false")
    body = F.concat(F.lit("<< /Type /Catalog /Policy << /Mode /"), modes, F.lit(" /Used /"), used, F.lit(" /Explicit "), asked, F.lit(" >> >>"))
    events = dealt(spark, sf_dir, "events")
    objs = objects(events.select(F.col("event_id").cast("string").alias("doc_id"), mint.document(F.array(mint.obj(1, body))).alias("content")))
    rows = objs.select(documents.fallback_policy(name("Policy/Mode"), name("Policy/Used"), entry("Policy/Explicit") == "true").alias("status"))
    return rows.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def byte_range_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges by doc_id: whole, overlapping, negative, outside, odd."""
    docs = table(spark, sf_dir, "documents")
    kinds = ("[0 10 20 5]", "[0 10 9 5]", "[0 -1 20 5]", "[0 10 20 5000000]", "[0 10 20]", "[0 0 5 0]")
    chosen = F.element_at(F.array(*map(F.lit, kinds)), (F.pmod("doc_id", F.lit(len(kinds))) + 1).cast("int"))
    content = mint.document(F.array(mint.obj(1, F.concat(F.lit("<< /Type /Sig /ByteRange "), chosen, F.lit(" >>"))), mint.obj(2, mint.stream(F.coalesce("text", F.lit(""))))))
    rows = documents.byte_range_status(docs.select(F.col("doc_id").cast("string").alias("doc_id"), content.alias("content")))
    return rows.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def choice_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders' priorities as a choice of five, by export or display text."""
    orders = dealt(spark, sf_dir, "orders")
    options = "".join(f"[({i}) ({p})]" for i, p in enumerate(("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")))
    value = F.when(F.col("o_orderkey") % 4 == 0, F.lit("nothing")).otherwise(F.col("o_orderpriority"))
    body = F.array(mint.obj(1, "<< /Type /Catalog /AcroForm << /Fields [2 0 R] >> >>"), mint.obj(2, F.concat(F.lit(f"<< /FT /Ch /T (p) /Opt [{options}] /V "), mint.literal(value), F.lit(" >>"))))
    rows = documents.choice_status(orders.select(F.col("o_orderkey").cast("string").alias("doc_id"), mint.document(body).alias("content")))
    return rows.groupBy("options", F.coalesce("selected", F.lit(-1)).alias("selected")).agg(F.count(F.lit(1)).alias("n"))


def xfa_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Template fields of orders' XML forms matched by path, or by a last part that only one field has."""
    orders = dealt(spark, sf_dir, "orders")
    tag = lambda k, c: F.concat(F.lit(f"<{k}>"), c.cast("string"), F.lit(f"</{k}>"))
    data = F.concat(F.lit("<datasets><data><order>"), tag("status", F.col("o_orderstatus")), tag("id", F.col("o_orderkey")), F.lit("</order><buyer>"), tag("id", F.col("o_custkey")), F.lit("</buyer></data></datasets>"))
    form = "<template><subform name='order'><field name='id'/><field name='status'/></subform><subform name='form'><field name='id'/></subform><field name='buyer.id'/></template>"
    body = F.array(mint.obj(1, "<< /Type /Catalog /AcroForm << /XFA [(template) 3 0 R (datasets) 2 0 R] >> >>"), mint.obj(2, mint.stream(data)), mint.obj(3, mint.stream(F.lit(form))))
    packets = stage(xfa.packets(orders.select(F.col("o_orderkey").cast("string").alias("doc_id"), mint.document(body).alias("content"))))
    rows = xfa.mapped_fields(xfa.template_fields(packets).select("doc_id", "field", "path"), xfa.dataset_fields(packets).select("doc_id", "path", "value"))
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), "field", "path", "value", "match")


def page_verification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders' documents of a page for each line, held against a count that is one off for some, and texts of which one may be missing.

    Every fifth order's pages refer to notes that are not there; the lines of returned goods have no content.
    """
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.concat_ws(" ", "l_partkey", "l_returnflag").alias("shown"), "l_returnflag")
    loose = F.when(F.col("l_orderkey") % 5 == 0, F.lit("/Annots [9999 0 R]")).otherwise("")
    hidden = F.when(F.col("l_returnflag") == "R", F.lit("/Contents [] ")).otherwise("")
    docs = mint.paged(lines, "l_orderkey", "l_linenumber", mint.show(F.col("shown")), F.concat(hidden, loose))
    # Grouped by the name that documents have, so that what is asked of one is dealt once.
    wanted = lines.groupBy(F.col("l_orderkey").cast("string").alias("doc_id")).agg(
        F.count(F.lit(1)).alias("lines"), F.max("l_orderkey").alias("l_orderkey"), F.collect_set("shown").alias("texts"),
    )
    extra = F.when(F.col("l_orderkey") % 4 == 0, F.array(F.lit("BY BALLOON"), F.lit(None).cast("string"))).otherwise(F.array(F.lit("")))
    wanted = wanted.select("doc_id", (F.col("lines") + (F.col("l_orderkey") % 3 == 0).cast("long")).alias("page_count"), F.concat("texts", extra).alias("texts"))
    rows = verify_pages(docs, wanted, need_content=True, need_resources=True)
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), "page_count", "page_count_ok", "content_ok", "resources_ok", F.array_join("missing", ",").alias("missing"), "dangling", "ok")


QUERIES = {f.__name__: f for f in (page_verification, xref_merge, name_tree_merge, merge_documents, page_transforms, ocr_plan, fallback_policy, byte_range_status, choice_selection, xfa_mapping)}

ORACLES = {
    "page_verification": """SELECT *, page_count_ok AND content_ok AND missing = '' AND dangling = 0 AS ok FROM (
        SELECT l_orderkey AS doc_id, count(*) AS page_count, l_orderkey % 3 <> 0 AS page_count_ok, NOT bool_or(l_returnflag = 'R') AS content_ok, true AS resources_ok,
          CASE WHEN l_orderkey % 4 = 0 THEN 'BY BALLOON' ELSE '' END AS missing, CASE WHEN l_orderkey % 5 = 0 THEN count(*) ELSE 0 END AS dangling FROM lineitem GROUP BY l_orderkey)""",
    "xref_merge": """SELECT o_orderkey AS doc_id, num::INT AS num, offset_ AS "offset", sections::BIGINT AS sections FROM (
        SELECT o_orderkey, 1 AS num, 9::BIGINT AS offset_, 1 AS sections FROM orders UNION ALL
        SELECT o_orderkey, 2, floor(o_totalprice)::BIGINT % 1000000, 2 FROM orders UNION ALL SELECT o_orderkey, 3, o_orderkey, 1 FROM orders)""",
    "name_tree_merge": """WITH n AS (SELECT c_nationkey AS nation, c_custkey, unnest([c_mktsegment, c_name]) AS name, unnest([5, 6]) AS target FROM customer),
        r AS (SELECT *, dense_rank() OVER (PARTITION BY nation ORDER BY c_custkey) AS k, row_number() OVER (PARTITION BY nation, name ORDER BY c_custkey, target) AS i FROM n)
        SELECT nation::BIGINT AS nation, c_custkey AS custkey, CASE WHEN i = 1 THEN name ELSE name || '#doc' || k END AS name, target::INT AS target FROM r""",
    "merge_documents": "SELECT (conv_id // 4)::BIGINT AS doc_id, count(*) AS pages, count(*) AS boxes, md5(string_agg(md5(text), '|' ORDER BY conv_id, turn)) AS digest FROM conversations GROUP BY 1",
    "page_transforms": """SELECT p_partkey AS doc_id, CASE WHEN error IS NULL THEN (p_size * 30 % 360)::INT ELSE -1 END AS rotate, CASE WHEN error IS NULL THEN 2.0::DOUBLE * (p_size - 5) END AS width,
        CASE WHEN error IS NULL THEN 2.0::DOUBLE * floor(p_retailprice) END AS height, error FROM (SELECT *, CASE WHEN p_size * 30 % 90 <> 0 THEN 'rotation is not a multiple of 90' WHEN p_size <= 5 THEN 'box has no area' END AS error FROM part)""",
    "ocr_plan": """WITH p AS (SELECT conv_id, count(*) AS pages FROM conversations GROUP BY 1),
        i AS (SELECT event_id, event_id % (SELECT count(DISTINCT conv_id) FROM conversations) AS d, user_id % 6 - 1 AS page, event_id % 11 > 0 AS has_text, event_id % 13 AS c, event_id % 5 AS w FROM events)
        SELECT CASE WHEN pages IS NULL THEN 'no_document' WHEN page < 0 OR page >= pages THEN 'page_out_of_range' WHEN NOT has_text THEN 'no_text' WHEN c > 10 THEN 'confidence_out_of_range'
          WHEN w = 0 THEN 'box_without_area' ELSE 'accepted' END AS status, count(*) AS n FROM i LEFT JOIN p ON d = conv_id GROUP BY 1""",
    "fallback_policy": """WITH e AS (SELECT ['none', 'overlay', 'ocr_text_layer', 'magic'][(event_id % 4 + 1)::INT] AS m, ['none', 'overlay', 'ocr_text_layer'][(user_id % 3 + 1)::INT] AS u, event_id % 3 = 0 AS x FROM events)
        SELECT CASE WHEN m = 'magic' THEN 'unknown_policy' WHEN m = 'none' AND u = 'none' THEN 'accepted' WHEN m = 'none' THEN 'fallback_not_allowed' WHEN NOT x THEN 'fallback_not_explicit'
          WHEN u IN ('none', m) THEN 'accepted' ELSE 'other_fallback_used' END AS status, count(*) AS n FROM e GROUP BY 1""",
    "byte_range_status": "SELECT ['ok', 'overlap', 'negative', 'outside_file', 'odd_count', 'empty'][(doc_id % 6 + 1)::INT] AS status, count(*) AS n FROM documents GROUP BY 1",
    "choice_selection": "SELECT 5::INT AS options, CASE WHEN o_orderkey % 4 > 0 THEN (list_position(['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW'], o_orderpriority) - 1)::INT ELSE -1 END AS selected, count(*) AS n FROM orders GROUP BY 1, 2",
    "xfa_mapping": """SELECT o_orderkey AS doc_id, f AS field, p AS path, v AS value, m AS match FROM (
        SELECT o_orderkey, 'id' AS f, 'order.id' AS p, o_orderkey::VARCHAR AS v, 'path' AS m FROM orders UNION ALL SELECT o_orderkey, 'status', 'order.status', o_orderstatus, 'path' FROM orders UNION ALL
        SELECT o_orderkey, 'id', 'form.id', NULL, 'none' FROM orders UNION ALL SELECT o_orderkey, 'buyer.id', 'buyer.id', o_custkey::VARCHAR, 'path' FROM orders)""",
}
