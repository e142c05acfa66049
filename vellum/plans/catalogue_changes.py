"""More queries of the document graph: edits in place and changes of objects. Minted, written, read back and answered as in `catalogue`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.operators import adapters, changes, documents, edits, graph, mutations, reports, splices
from vellum.operators.nodes import text_rows
from vellum.plans.staging import dealt, table
from vellum.plans.staging import stage_documents as stage
from vellum.sources import mint
from vellum.sources.scan import objects


def _docs(df: DataFrame, key: str, *bodies: Column | str, extra: Column | str = "") -> DataFrame:
    return df.select(F.col(key).cast("string").alias("doc_id"), mint.document(F.array(*[mint.obj(i + 1, b) for i, b in enumerate(bodies)]), extra=extra).alias("content"))


def _long() -> Column:
    return F.col("doc_id").cast("long").alias("doc_id")


_PAGE = ("<< /Type /Catalog /Pages 2 0 R >>", "<< /Type /Pages /Kids [3 0 R] /Count 1 >>", "<< /Type /Page /Parent 2 0 R /Resources << >> /Contents [4 0 R 5 0 R] >>")
_FORM = ("<< /Type /Catalog /Pages 2 0 R /AcroForm << /Fields [4 0 R] >> >>", "<< /Type /Pages /Kids [3 0 R] /Count 1 >>", "<< /Type /Page /Parent 2 0 R /Annots [4 0 R] >>")


def _written(got: DataFrame) -> DataFrame:
    return got.where("content is not null").select("doc_id", "content")


def surgical_edit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' segments replaced in place where they are BUILDING: texts read back, and whether all bytes behind the edited stream but the offsets are the old ones."""
    customers = dealt(spark, sf_dir, "customer")
    minted = stage(_docs(customers, "c_custkey", *_PAGE, mint.stream(mint.show(F.col("c_mktsegment"))), mint.stream(mint.show(F.col("c_name")))))
    got = stage(edits.edit(minted, "BUILDING", "a segment of a longer name", mode="surgical"))
    texts = text_rows(_written(got)).groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "seq", "text"))), lambda t: t["text"]), "|").alias("texts"))
    behind = lambda c: F.regexp_extract(F.decode(c, "ISO-8859-1"), r"(?s)(5 0 obj.*?xref)", 1)
    same = minted.select("doc_id", behind(F.col("content")).alias("before")).join(_written(got).select("doc_id", behind(F.col("content")).alias("after")), "doc_id").select("doc_id", (F.col("before") == F.col("after")).alias("same"))
    return got.select("doc_id", "status").join(texts, "doc_id", "left").join(same, "doc_id", "left").select(_long(), "status", "texts", "same")


def span_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans at the objects of documents of two streams: which stream holds them. A span begins where an object or its data do."""
    docs = table(spark, sf_dir, "documents")
    minted = stage(_docs(docs, "doc_id", "<< /Type /Catalog >>", mint.stream(F.concat(F.lit("."), F.coalesce("text", F.lit("")))), mint.stream(F.concat(F.lit("."), F.coalesce("lang", F.lit(""))))))
    there = splices.places(minted)
    starts = objects(minted).select("doc_id", F.explode(F.array_compact(F.array("offset", F.col("data_start")))).alias("start"))
    found = splices.containing(starts.withColumn("end", F.col("start") + 1), there.where("kind = 'stream'"))
    return found.groupBy(F.coalesce("stream", F.lit(0)).alias("stream")).agg(F.count(F.lit(1)).alias("n"))


_ASKED = {"mode": ("", "auto", "canonical", "surgical", "preserve-structure", "magic"), "signature": ("", "refuse", "invalidate", "preserve-incremental", "odd"), "password": ("", "p")}


def edit_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts' documents, plain, encrypted or signed, edited in every mode, with every wish about signatures, with and without a password."""
    parts = dealt(spark, sf_dir, "part")
    kind = F.floor(F.col("p_partkey") / 60) % 3
    pick = lambda k, by: F.element_at(F.array(*map(F.lit, _ASKED[k])), (F.floor(F.col("p_partkey") / by) % len(_ASKED[k]) + 1).cast("int"))
    signed = F.when(kind == 2, "<< /Type /Sig /ByteRange [0 1 2 3] >>").otherwise("null")
    minted = _docs(parts, "p_partkey", *_PAGE, mint.stream(mint.show(F.lit("old"))), mint.stream(mint.show(F.col("p_name"))), signed, extra=F.when(kind == 1, " /Encrypt << /Filter /Standard >>").otherwise(""))
    asked = parts.select(F.col("p_partkey").cast("string").alias("doc_id"), pick("mode", 1).alias("mode"), pick("signature", 6).alias("signature"), pick("password", 30).alias("password"))
    got = edits.edit_as_asked(minted.join(asked, "doc_id"), "old", "new")
    return got.groupBy("route", "status").agg(F.count(F.lit(1)).alias("n"), F.count("content").alias("written"))


def packet_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders' XML forms: the second `x` of the template and the data together becomes the priority, where there are so many."""
    orders = dealt(spark, sf_dir, "orders")
    tags = lambda n, name: F.concat(F.lit(f"<{name}>"), F.repeat(F.lit("-x"), n.cast("int")), F.lit(f"</{name}>"))
    minted = _docs(orders, "o_orderkey", "<< /Type /Catalog /AcroForm << /XFA [(template) 2 0 R (datasets) 3 0 R] >> >>", mint.stream(tags(F.col("o_orderkey") % 3, "t")), mint.stream(tags(F.col("o_custkey") % 3, "d")))
    got = stage(mutations.replace_in_packets(minted, "x", "y-&", at=1)).withColumnRenamed("packet", "hit")
    # Packets are read back with what was said of their documents; the others have no text.
    after = mutations.packet_bytes(got.where("content is not null"), "status", "matches", "hit").where("packet = hit").withColumn("text", F.decode("data", "UTF-8"))
    rows = after.select("doc_id", "status", "matches", "hit", "text").unionByName(got.where("content is null").select("doc_id", "status", "matches", "hit", F.lit(None).cast("string").alias("text")))
    return rows.select(_long(), "status", "matches", F.coalesce(F.col("hit").cast("long"), F.lit(-1)).alias("packet"), "text")


def radio_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as radio buttons with a widget for each of three types, set to the event's own; every fifth has a second wish, which clashes unless the first is refused."""
    events = dealt(spark, sf_dir, "events")
    kinds = ("view", "click", "purchase")
    kids = [f"<< /Parent 4 0 R /Subtype /Widget /AS /Off /AP << /N << /{k} 8 0 R /Off 8 0 R >> >> >>" for k in kinds]
    minted = _docs(events, "event_id", *_FORM[:3], "<< /T (kind) /FT /Btn /Ff 32768 /Kids [5 0 R 6 0 R 7 0 R] >>", *kids, mint.stream(F.lit("")))
    key = F.col("event_id").cast("string").alias("doc_id")
    wanted = events.select(key, F.lit("kind").alias("name"), F.col("event_type").alias("value")).unionByName(events.where("event_id % 5 = 0").select(key, F.lit("kind").alias("name"), F.lit("Off").alias("value")))
    got = stage(changes.set_fields(minted, wanted))
    # A document is set by one wish at most, so each written one is read back once, with its status.
    on = graph.by_document(_written(got), lambda o: o, lambda nodes: [(" ".join(v for n in (4, 5, 6, 7) if (v := nodes[n].get("AS", nodes[n].get("V"))) is not None),)], "states string")
    rows = on.select(F.lit("ok").alias("status"), "states").unionByName(got.where("content is null").select("status", F.lit(None).cast("string").alias("states")))
    return rows.groupBy("status", "states").agg(F.count(F.lit(1)).alias("n"))


def fields_made_and_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' forms get a field of their nation, if it is below 20, and lose the one they had: fields and values read back."""
    customers = dealt(spark, sf_dir, "customer")
    minted = _docs(customers, "c_custkey", *_FORM, F.concat(F.lit("<< /T (segment) /FT /Tx /Subtype /Widget /V "), mint.literal(F.col("c_mktsegment")), F.lit(" >>")))
    key = F.col("c_custkey").cast("string").alias("doc_id")
    box = F.array(F.lit(0.0), F.lit(0.0), F.lit(20.0) - F.col("c_nationkey"), F.lit(1.0))
    wanted = customers.select(key, F.lit("nation").alias("name"), F.lit(0).alias("page_index"), box.alias("rect"), F.col("c_nationkey").cast("string").alias("value"))
    made = stage(mutations.create_fields(minted, wanted))
    left = stage(mutations.remove_fields(_written(made), _written(made).select("doc_id", F.lit("segment").alias("name"))))
    fields = graph.form_fields(_written(left)).select("doc_id", F.concat_ws("=", F.col("num").cast("string"), "name", "value").alias("field"))
    return made.select("doc_id", F.col("status").alias("made")).join(left.select("doc_id", F.col("status").alias("removed")), "doc_id", "left").join(fields, "doc_id", "left").select(_long(), "made", "removed", "field")


def image_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as images, every third under a filter and every fifth no image, exchanged for the part's brand."""
    parts = dealt(spark, sf_dir, "part")
    kind = F.when(F.col("p_partkey") % 5 == 0, "/Subtype /Form").otherwise("/Subtype /Image")
    names = F.concat(kind, F.when(F.col("p_partkey") % 3 == 0, " /Filter /DCTDecode").otherwise(""))
    minted = _docs(parts, "p_partkey", "<< /Type /Catalog >>", mint.stream(F.col("p_name"), names))
    wanted = parts.select(F.col("p_partkey").cast("string").alias("doc_id"), F.lit(2).alias("num"), F.col("p_brand").cast("binary").alias("data"), F.create_map(F.lit("Width"), F.col("p_size").cast("string")).alias("sets"))
    got = stage(mutations.replace_streams(minted, wanted, images=True))
    after = objects(_written(got)).where("num = 2").select("doc_id", F.decode("raw", "UTF-8").alias("data"), F.col("entries")["Width"].cast("int").alias("width"))
    return got.select("doc_id", "status").join(after, "doc_id", "left").select(_long(), "status", "data", F.coalesce("width", F.lit(-1)).alias("width"))


def dense_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations merged four at a time: the numbers of the written objects are 1 to their count, and pages stand in the order of the first visit."""
    turns = table(spark, sf_dir, "conversations")
    objs = stage(objects(mint.paged(turns, "conv_id", "turn", mint.show(F.coalesce("text", F.lit(""))))))
    merged = stage(documents.merge(objs, F.floor(F.col("doc_id").cast("long") / 4).cast("string"), F.col("doc_id").cast("long")))
    again = objects(merged).groupBy("doc_id").agg(F.count(F.lit(1)).alias("objects"), F.max("num").cast("long").alias("last"), F.min("num").cast("long").alias("first"))
    rising = graph.pages(merged).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page_index", "num"))).alias("p"))
    rising = rising.select("doc_id", F.forall(F.sequence(F.lit(1), F.size("p") - 1, F.lit(1)), lambda i: F.get("p", i)["num"] > F.get("p", i - 1)["num"]).alias("rising"), F.size("p").alias("n"))
    return again.join(rising, "doc_id").select(_long(), "objects", "last", "first", (F.col("rising") | (F.col("n") == 1)).alias("rising"))


def range_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts' names under three ranges (the first, the third and the last letter), by SHA-1 and SHA-256; every fourth has ranges that can't be."""
    parts = dealt(spark, sf_dir, "part")
    head = "%PDF-1.7\n1 0 obj\n<< /ByteRange ["
    start = len(head) + 3 * 2 * 6 + len("] >>\nendobj\n")
    number = lambda c: F.concat(F.lpad(c.cast("string"), 5, "0"), F.lit(" "))
    at = lambda i: number(F.lit(start) + i)
    one = number(F.lit(1))
    last = F.when(F.col("p_partkey") % 4 == 0, number(F.lit(99_999))).otherwise(at(F.length("p_name") - 1))
    content = F.concat(F.lit(head), at(F.lit(0)), one, at(F.lit(2)), one, last, one, F.lit("] >>\nendobj\n"), "p_name").cast("binary")
    minted = parts.select(F.col("p_partkey").cast("string").alias("doc_id"), content.alias("content"))
    a, b = (reports.byte_range_digests(minted, x).select("doc_id", F.coalesce("covered", F.lit(-1).cast("long")).alias("covered"), F.col("digest").alias(x)) for x in ("sha1", "sha256"))
    return a.join(b.select("doc_id", "sha256"), "doc_id").select(_long(), "covered", "sha1", "sha256")


def format_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, two thirds of them files of the known format, the others their bare text: nodes by format, and how an edit of them ends."""
    docs = table(spark, sf_dir, "documents")
    made = _docs(docs, "doc_id", *_PAGE, mint.stream(mint.show(F.coalesce("lang", F.lit("")))), mint.stream(F.lit("")))
    rows = stage(made.join(docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("binary").alias("bare")), "doc_id").select("doc_id", F.when(F.pmod(F.col("doc_id").cast("long"), F.lit(3)) == 0, F.col("bare")).otherwise(F.col("content")).alias("content")))
    known = adapters.formats()
    nodes_ = known.nodes(rows).groupBy("doc_id").agg(F.count(F.lit(1)).alias("nodes"))
    got = known.edit(rows, "en", "fr").join(nodes_, "doc_id", "left")
    return got.groupBy(F.coalesce("format", F.lit("none")).alias("format"), "status", F.coalesce("nodes", F.lit(0)).alias("nodes")).agg(F.count(F.lit(1)).alias("n"))


QUERIES = {f.__name__: f for f in (format_nodes, range_digests, surgical_edit, span_streams, edit_routes, packet_replace, radio_groups, fields_made_and_removed, image_replace, dense_numbers)}

_MODE, _SIGNATURE, _PASSWORD = ("[" + ", ".join(f"'{x}'" for x in _ASKED[k]) + "]" for k in ("mode", "signature", "password"))
ORACLES = {
    "format_nodes": """SELECT CASE WHEN doc_id % 3 = 0 THEN 'none' ELSE 'pdf' END AS format, CASE WHEN doc_id % 3 = 0 THEN 'unknown_format' WHEN lang = 'en' THEN 'ok' ELSE 'no_matches' END AS status,
        (CASE WHEN doc_id % 3 = 0 THEN 0 ELSE 4 END)::BIGINT AS nodes, count(*) AS n FROM documents GROUP BY 1, 2, 3""",
    "range_digests": """WITH p AS (SELECT p_partkey AS doc_id, CASE WHEN p_partkey % 4 > 0 THEN p_name[1] || p_name[3] || p_name[-1] END AS x FROM part)
        SELECT doc_id, coalesce(length(x), -1) AS covered, sha1(x) AS sha1, sha256(x) AS sha256 FROM p""",
    "surgical_edit": """SELECT c_custkey AS doc_id, CASE WHEN c_mktsegment = 'BUILDING' THEN 'ok' ELSE 'no_matches' END AS status, CASE WHEN c_mktsegment = 'BUILDING' THEN 'a segment of a longer name|' || c_name END AS texts,
        CASE WHEN c_mktsegment = 'BUILDING' THEN TRUE END AS same FROM customer""",
    "span_streams": "SELECT unnest([0, 2, 3])::INT AS stream, unnest([3 * count(*), count(*), count(*)])::BIGINT AS n FROM documents",
    "edit_routes": f"""WITH p AS (SELECT {_MODE}[p_partkey % 6 + 1] AS m, {_SIGNATURE}[p_partkey // 6 % 5 + 1] AS s, {_PASSWORD}[p_partkey // 30 % 2 + 1] AS w, p_partkey // 60 % 3 AS k FROM part),
        r AS (SELECT CASE WHEN m = 'magic' THEN 'unsupported_mode' WHEN s = 'odd' THEN 'unsupported_signature_mode' WHEN s = 'preserve-incremental' AND m NOT IN ('', 'auto', 'canonical') THEN 'signature_mode_requires_canonical'
          WHEN s = 'preserve-incremental' THEN 'incremental_not_supported' WHEN m = 'preserve-structure' AND (w <> '' OR s = 'invalidate') THEN 'preserve_structure_takes_no_options'
          WHEN m = 'surgical' AND (w <> '' OR s <> '') THEN 'surgical_takes_no_options' WHEN k = 1 AND w <> '' THEN 'decryption_not_supported' WHEN k = 2 AND s = 'invalidate' THEN 'canonical'
          WHEN k = 1 THEN 'password_required' WHEN k = 2 THEN 'signed' WHEN m IN ('', 'auto', 'canonical') THEN 'canonical' ELSE m END AS route FROM p)
        SELECT route, CASE WHEN route IN ('canonical', 'surgical', 'preserve-structure') THEN 'ok' ELSE route END AS status, count(*) AS n, count(*) FILTER (route IN ('canonical', 'surgical', 'preserve-structure')) AS written FROM r GROUP BY 1, 2""",
    "packet_replace": """WITH o AS (SELECT o_orderkey, (o_orderkey % 3)::INT AS a, (o_custkey % 3)::INT AS b FROM orders)
        SELECT o_orderkey AS doc_id, CASE WHEN a + b = 0 THEN 'no_matches' WHEN a + b = 1 THEN 'match_index_out_of_range' ELSE 'ok' END AS status, (a + b)::BIGINT AS matches, (CASE WHEN a + b < 2 THEN -1 WHEN a = 2 THEN 0 ELSE 1 END)::BIGINT AS packet,
          CASE WHEN a + b < 2 THEN NULL WHEN a = 2 THEN '<t>-x-y-&</t>' WHEN a = 1 THEN '<d>-y-&' || repeat('-x', b - 1) || '</d>' ELSE '<d>-x-y-&</d>' END AS text FROM o""",
    "radio_groups": """WITH e AS (SELECT event_id % 5 = 0 AS two, event_type AS t FROM events),
        w AS (SELECT two, t, t AS asked FROM e UNION ALL SELECT two, t, 'Off' FROM e WHERE two),
        r AS (SELECT CASE WHEN asked NOT IN ('view', 'click', 'purchase', 'Off') THEN 'no_such_state' WHEN two AND t IN ('view', 'click', 'purchase') THEN 'conflicting_changes' ELSE 'ok' END AS status, asked FROM w)
        SELECT status, CASE WHEN status = 'ok' THEN '/' || asked || array_to_string(list_transform(['view', 'click', 'purchase'], lambda k: CASE WHEN k = asked THEN ' /' || k ELSE ' /Off' END), '') END AS states, count(*) AS n FROM r GROUP BY 1, 2""",
    "fields_made_and_removed": """SELECT c_custkey AS doc_id, CASE WHEN c_nationkey < 20 THEN 'ok' ELSE 'no_area' END AS made, CASE WHEN c_nationkey < 20 THEN 'ok' END AS removed,
        CASE WHEN c_nationkey < 20 THEN '5=nation=' || c_nationkey END AS field FROM customer""",
    "image_replace": """WITH p AS (SELECT *, CASE WHEN p_partkey % 5 = 0 THEN 'not_an_image' WHEN p_partkey % 3 = 0 THEN 'filtered_image' ELSE 'ok' END AS status FROM part)
        SELECT p_partkey AS doc_id, status, CASE WHEN status = 'ok' THEN p_brand END AS data, CASE WHEN status = 'ok' THEN p_size ELSE -1 END AS width FROM p""",
    "dense_numbers": "SELECT (conv_id // 4)::BIGINT AS doc_id, 2 + 2 * count(*) AS objects, 2 + 2 * count(*) AS last, 1::BIGINT AS first, TRUE AS rising FROM conversations GROUP BY 1",
}
