"""More queries of the document graph: text operators, fonts and widths, layouts and guarantees of edits, pages put in, catalogs, packets. Minted, parsed and answered as in `catalogue`."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellum.operators import documents, edits, reports, xfa
from vellum.operators.nodes import Selector, nodes, text_rows
from vellum.operators.rewrite import CHANGES, rewrite
from vellum.plans.staging import dealt, table
from vellum.plans.staging import stage_documents as stage
from vellum.sources import mint
from vellum.sources.scan import entry, name, objects, text


def _docs(df: DataFrame, key: str, *bodies: Column | str, extra: Column | str = "") -> DataFrame:
    return df.select(F.col(key).cast("string").alias("doc_id"), mint.document(F.array(*[mint.obj(i + 1, b) for i, b in enumerate(bodies)]), extra=extra).alias("content"))


def _long() -> Column:
    return F.col("doc_id").cast("long").alias("doc_id")


_TREE = ("<< /Type /Catalog /Pages 2 0 R >>", "<< /Type /Pages /Kids [3 0 R] /Count 1 >>")
_PAGE = (*_TREE, "<< /Type /Page /Parent 2 0 R /Resources << /Font << /F1 5 0 R >> >> /Contents [4 0 R] >>")


def _shifted(c: str, by: int, digits: int = 2) -> Column:
    """A show of a column in hex, of codes that lie so far above its characters."""
    codes = F.array_join(F.transform(F.split(c, ""), lambda x: F.lpad(F.hex(F.ascii(x) + by), digits, "0")), "")
    return F.concat(F.lit("BT /F1 12 Tf <"), codes, F.lit("> Tj ET"))


def show_operators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts' names and brands under every operator that shows text, with three more shows that are none: numbers behind the string, a name in an array, bytes without an encoding."""
    parts = dealt(spark, sf_dir, "part")
    n, b = mint.literal(F.col("p_name")), mint.literal(F.col("p_brand"))
    good = F.concat(F.lit("BT /F1 12 Tf 12 TL 72 720 Td "), n, F.lit(" Tj ["), b, F.lit(" -120 "), n, F.lit("] TJ "), b, F.lit(" ' 3 1 "), n, F.lit(' " '))
    body = F.concat(good, b, F.lit(" 7 Tj ["), b, F.lit(" /N] TJ [<C3A9> -1] TJ ET"))
    rows = text_rows(_docs(parts, "p_partkey", *_PAGE, mint.stream(body), "<< /Type /Font /Subtype /TrueType >>"))
    return rows.select(_long(), "operator", "text", "y")


def single_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts' brands in a font without a map or an encoding: the document's one map counts for it, but not where two fonts have maps."""
    parts = dealt(spark, sf_dir, "part")
    other = "<< /Type /Font /ToUnicode 7 0 R >>"
    cmap = "1 begincodespacerange <00> <FF> endcodespacerange\n1 beginbfrange <21> <80> <0020> endbfrange"
    second = F.when(F.col("p_partkey") % 2 == 1, other).otherwise("null")
    rows = text_rows(_docs(parts, "p_partkey", *_PAGE, mint.stream(_shifted("p_brand", 1)), "<< /Type /Font /Subtype /TrueType >>", other, mint.stream(F.lit(cmap)), second))
    return rows.select(_long(), "text", "encoding")


def map_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' BUILDING becomes HOUSES in codes of a map that has three codes for H and one for OU; codes of two bytes need a proof of widths, so every other one is refused."""
    customers = dealt(spark, sf_dir, "customer")
    odd = F.col("c_custkey") % 2 == 1
    hexes = lambda pad: "1 beginbfrange <{0}21> <{0}80> <0020> endbfrange\n3 beginbfchar <{0}03> <0048> <{0}01> <0048> <{0}02> <004F0055> endbfchar".format(pad)
    shown = F.when(odd, _shifted("c_mktsegment", 1, 4)).otherwise(_shifted("c_mktsegment", 1))
    minted = stage(_docs(customers, "c_custkey", *_PAGE, mint.stream(shown), "<< /Type /Font /Subtype /Type0 /ToUnicode 6 0 R >>", mint.stream(F.when(odd, hexes("00")).otherwise(hexes("")))))
    got = stage(edits.edit(minted, "BUILDING", "HOUSES"))
    after = text_rows(got.where("content is not null").select("doc_id", "content"), with_fonts=True).select("doc_id", "text", F.hex("codes").alias("codes"))
    return got.select("doc_id", "status").join(after, "doc_id", "left").select(_long(), "status", "text", "codes")


def layout_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BUILDING becomes BUILDINX in every layout. All characters are five wide but X, which is as wide as the customer's nation modulo 10.

    Every other customer has a simple font, the rest fonts of two bytes a code, whose widths are given as a list or as a range.
    """
    customers = dealt(spark, sf_dir, "customer").withColumn("x", (F.col("c_nationkey") % 10).cast("string"))
    odd = F.col("c_custkey") % 2 == 1
    listed = F.when(F.col("c_custkey") % 4 == 1, F.concat(F.lit("[88 ["), "x", F.lit("]]"))).otherwise(F.concat(F.lit("[88 88 "), "x", F.lit("]")))
    simple = F.concat(F.lit("<< /Type /Font /Subtype /TrueType /FirstChar 65 /Widths ["), F.repeat(F.lit("5 "), 23), "x", F.lit(" 5 5] >>"))
    font = F.when(odd, "<< /Type /Font /Subtype /Type0 /Encoding /Identity-H /DescendantFonts [6 0 R] /ToUnicode 7 0 R >>").otherwise(simple)
    below = F.when(odd, F.concat(F.lit("<< /Type /Font /Subtype /CIDFontType2 /DW 5 /W "), listed, F.lit(" >>"))).otherwise("null")
    shown = F.when(odd, _shifted("c_mktsegment", 0, 4)).otherwise(mint.show(F.col("c_mktsegment")))
    cmap = F.when(odd, mint.stream(F.lit("1 beginbfrange <0020> <007F> <0020> endbfrange"))).otherwise(F.lit("null").cast("binary"))
    minted = stage(_docs(customers, "c_custkey", *_PAGE, mint.stream(shown), font, below, cmap))
    plans = [edits.plan(minted, "BUILDING", "BUILDINX", layout=w).select(_long(), F.lit(w).alias("layout"), "status", "proof") for w in edits.LAYOUTS]
    return reduce(DataFrame.unionByName, plans)


def wide_font_widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a part's name is as wide as its brand in a font of two bytes a code: ten widths in a list, one for a range, a default."""
    parts = dealt(spark, sf_dir, "part")
    font = "<< /Type /Font /Subtype /Type0 /Encoding /Identity-H /DescendantFonts [6 0 R] >>"
    below = "<< /Type /Font /Subtype /CIDFontType2 /DW 7 /W [97 [3 4 5 6 7 8 9 10 11 12] 110 122 2] >>"
    shown = F.concat(_shifted("p_name", 0, 4), F.lit("\n"), _shifted("p_brand", 0, 4))
    rows = reports.width_changes(_docs(parts, "p_partkey", *_PAGE, mint.stream(shown), font, below))
    return rows.select(_long(), "old_width", "new_width", "status")


def edit_guarantees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first BUILDING of customers' documents becomes HOUSES, with all guarantees and with two: it stands there twice, once, or in a form that is shown twice."""
    customers = dealt(spark, sf_dir, "customer")
    kind = F.col("c_custkey") % 3
    shown = mint.show(F.col("c_mktsegment"))
    content = F.when(kind == 0, F.concat(shown, shown)).when(kind == 1, shown).otherwise("/Mark Do /Again Do")
    form = mint.stream(F.when(kind == 2, shown).otherwise(""), "/Type /XObject /Subtype /Form")
    page = "<< /Type /Page /Parent 2 0 R /Resources << /XObject << /Mark 5 0 R /Again 6 0 R >> >> /Contents [4 0 R] >>"
    again = mint.stream(F.when(kind == 2, "/Mark Do").otherwise(""), "/Type /XObject /Subtype /Form")
    minted = stage(_docs(customers, "c_custkey", *_TREE, page, mint.stream(content), form, again))
    asked = {"all": tuple(edits.INVARIANTS), "two": ("reparse", "new-selectable")}
    got = [edits.edit(minted, "BUILDING", "HOUSES", Selector().match_index(0), verify=v).select(_long(), F.lit(k).alias("asked"), "status", "new_selectable", "old_gone") for k, v in asked.items()]
    return reduce(DataFrame.unionByName, got)


def inserted_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even conversations get pages of the next one, every other time only its second and first page; out of range, or without those pages, they are left out. Which page comes from where, and its text."""
    turns = table(spark, sf_dir, "conversations")
    objs = stage(objects(mint.paged(turns, "conv_id", "turn", mint.show(F.coalesce("text", F.lit(""))))))
    own = F.col("conv_id")
    into = turns.select("conv_id").distinct().where(own % 2 == 0).select(
        own.cast("string").alias("doc_id"), (F.floor(own / 2) % 4).cast("int").alias("at"), (own + 1).cast("string").alias("source"), F.when(own % 4 == 0, F.array(F.lit(1), F.lit(0))).alias("pages"),
    )
    placed = stage(documents.inserted(objs, into))
    origin = documents.lineage(objs, placed).select(F.col("merged"), F.col("doc_id").cast("long").alias("source"), F.col("page_index").alias("source_page"), F.col("output_page_index").alias("page_index"))
    shown = text_rows(stage(documents.compose(objs, placed))).select(F.col("doc_id").alias("merged"), "page_index", F.md5("text").alias("digest"))
    return origin.join(shown, ["merged", "page_index"], "left").select(F.col("merged").cast("long").alias("doc_id"), "page_index", "source", "source_page", "digest")


def first_catalog_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers' documents merged by nation: language and page mode are those of the first one, even if it has none; fields need drawing if those of any do."""
    suppliers = dealt(spark, sf_dir, "supplier")
    some = lambda key, value: F.when(F.col("s_suppkey") % key > 0, value).otherwise("")
    need = F.when(F.col("s_acctbal") < 0, "true").otherwise("false")
    top = F.concat(F.lit("<< /Type /Catalog /Pages 2 0 R /AcroForm << /Fields [4 0 R] /NeedAppearances "), need, F.lit(" >> "), some(3, F.concat(F.lit("/Lang "), mint.literal(F.col("s_name")))), some(2, F.lit(" /PageMode /UseOutlines")), F.lit(" >>"))
    rows = suppliers.withColumn("key", F.concat_ws("/", F.col("s_nationkey").cast("string"), F.col("s_suppkey").cast("string")))
    objs = stage(objects(_docs(rows, "key", top, "<< /Type /Pages /Kids [3 0 R] >>", "<< /Type /Page /Parent 2 0 R >>", "<< /T (f) /FT /Tx >>")))
    part = lambda i: F.split_part("doc_id", F.lit("/"), F.lit(i))
    again = objects(stage(documents.merge(objs, part(1), part(2).cast("long")))).where(name("Type") == "Catalog")
    return again.select(_long(), text("Lang").alias("lang"), F.nullif(name("PageMode"), F.lit("")).alias("page_mode"), entry("AcroForm/NeedAppearances").alias("need"))


def packet_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders' data packets, found by their label: whole, with a document type, broken or empty; and packets without a label that are found by their root."""
    orders = dealt(spark, sf_dir, "orders")
    by = lambda n, c, *values: F.element_at(F.array(*map(F.lit, values)), (F.col(c) % n + 1).cast("int"))
    data = by(4, "o_orderkey", "<?xml version='1.0'?><datasets><a>1</a></datasets>", "<!DOCTYPE datasets><datasets/>", "<datasets><a></datasets>", "")
    plain = by(3, "o_custkey", "<x:xdp xmlns:x='u'/>", "<other/>", "<xdp><")
    minted = _docs(orders, "o_orderkey", "<< /Type /Catalog /AcroForm << /XFA [(datasets) 2 0 R 3 0 R] >> >>", mint.stream(data), mint.stream(plain))
    rows = stage(xfa.packets(minted))
    found = xfa.of_kind(rows, "datasets", "datasets").unionByName(xfa.of_kind(rows, "xdp"))
    return found.select(_long(), "packet", "kind", "root", F.col("error").isNull().alias("whole"), "unsafe")


def form_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' forms: a text field, another that is read-only for nations above 12, and a note for every other customer."""
    customers = dealt(spark, sf_dir, "customer")
    noted = F.col("c_custkey") % 2 == 0
    note = F.when(noted, "/Annots [6 0 R]").otherwise("")
    page = F.concat(F.lit("<< /Type /Page /Parent 2 0 R "), note, F.lit(" >>"))
    flags = F.when(F.col("c_nationkey") > 12, "1").otherwise("0")
    kinds = ("<< /Type /Catalog /Pages 2 0 R /AcroForm << /Fields [4 0 R 5 0 R] >> >>", _TREE[1], page, "<< /T (a) /FT /Tx /V () >>", F.concat(F.lit("<< /T (b) /FT /Tx /V () /Ff "), flags, F.lit(" >>")), F.when(noted, "<< /Subtype /Text /Rect [0 0 9 9] /Contents (x) >>").otherwise("null"))
    rows = reports.full_profile(_docs(customers, "c_custkey", *kinds))
    return rows.select(_long(), "fields", "fillable", "annotations")


def hybrid_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts' files with a table and a stream of cross references beside it: a third name another place than the stream's, a third none."""
    parts = dealt(spark, sf_dir, "part")
    named = F.when(F.col("p_partkey") % 3 == 0, " /XRefStm 9").when(F.col("p_partkey") % 3 == 1, " /XRefStm 10").otherwise("")
    refs = mint.stream(F.unhex(F.lit("00000000")), "/Type /XRef /W [1 2 1] /Size 1")
    minted = parts.select(F.col("p_partkey").cast("string").alias("doc_id"), mint.document(F.array(mint.obj(2, refs), mint.obj(1, F.concat(F.lit("<< /Type /Catalog /Of "), mint.literal(F.col("p_name")), F.lit(" >>")))), extra=named).alias("content"))
    return reports.structure(minted).select(_long(), "has_hybrid", "writer", F.col("error").isNull().alias("fits"))


def node_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes 0 and 1 of conversations, and the one behind their streams, which is the first text: ids without gaps."""
    turns = table(spark, sf_dir, "conversations")
    sizes = turns.groupBy(F.col("conv_id").cast("string").alias("doc_id")).agg(F.count(F.lit(1)).alias("n"))
    rows = nodes(mint.paged(turns, "conv_id", "turn", mint.show(F.coalesce("text", F.lit(""))))).join(sizes, "doc_id")
    chosen = rows.where(F.col("node_id").isin(0, 1) | (F.col("node_id") == F.col("n") + 1))
    return chosen.select(_long(), F.col("node_id").cast("long").alias("node_id"), F.substring_index("kind", ".", -1).alias("kind"), F.md5("value").alias("digest"), F.col("meta")["object_number"].alias("object_number"))


def canonical_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' documents, minted with their objects in another order and one number taken twice, written anew: objects by number, the ones in force alone."""
    customers = dealt(spark, sf_dir, "customer")
    bodies = F.array(mint.obj(7, "<< /Old true >>"), mint.obj(3, mint.literal(F.col("c_name"))), mint.obj(1, "<< /Type /Catalog >>"), mint.obj(7, mint.literal(F.col("c_mktsegment"))), mint.obj(2, F.col("c_nationkey").cast("string")))
    minted = customers.select(F.col("c_custkey").cast("string").alias("doc_id"), mint.document(bodies).alias("content"))
    none = spark.createDataFrame([], CHANGES)
    again = objects(stage(rewrite(stage(objects(minted)), none, every=True)))
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("offset"))
    return again.select(_long(), "num", place.alias("place"), F.regexp_replace("head", r"\\055", "-").alias("value"))


QUERIES = {
    f.__name__: f
    for f in (
        show_operators, single_map, map_edits, layout_plans, wide_font_widths, edit_guarantees, inserted_pages, first_catalog_entries, packet_diagnostics, form_summary, hybrid_references, node_by_id, canonical_order,
    )
}

_WIDE = "list_sum(list_transform(range(1, length({0}) + 1), lambda i: CASE WHEN ord({0}[i]) BETWEEN 97 AND 106 THEN ord({0}[i]) - 94 WHEN ord({0}[i]) BETWEEN 110 AND 122 THEN 2 ELSE 7 END))::BIGINT"

ORACLES = {
    "show_operators": """SELECT p_partkey AS doc_id, o AS operator, CASE o WHEN 'Tj' THEN p_name WHEN 'TJ' THEN p_brand || p_name WHEN '''' THEN p_brand ELSE p_name END AS text, y::DOUBLE AS y
        FROM part, (SELECT unnest(['Tj', 'TJ', '''', '"']) AS o, unnest([720, 720, 708, 696]) AS y)""",
    "single_map": """SELECT p_partkey AS doc_id, CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE array_to_string(list_transform(range(1, length(p_brand) + 1), lambda i: chr(ord(p_brand[i]) + 1)), '') END AS text,
        CASE WHEN p_partkey % 2 = 0 THEN 'hex-cmap' ELSE 'hex' END AS encoding FROM part""",
    "map_edits": """SELECT c_custkey AS doc_id, CASE WHEN c_mktsegment <> 'BUILDING' THEN 'no_matches' WHEN c_custkey % 2 = 1 THEN 'cmap_multibyte_requires_width_proof' ELSE 'ok' END AS status,
        CASE WHEN c_mktsegment = 'BUILDING' AND c_custkey % 2 = 0 THEN 'HOUSES' END AS text, CASE WHEN c_mktsegment = 'BUILDING' AND c_custkey % 2 = 0 THEN '0102544654' END AS codes FROM customer""",
    "layout_plans": """WITH c AS (SELECT c_custkey, c_custkey % 2 = 1 AS odd, CASE WHEN c_mktsegment <> 'BUILDING' THEN NULL WHEN c_nationkey % 10 = 5 THEN 'width_proven' WHEN c_nationkey % 10 < 5 THEN 'width_narrower' ELSE 'reflow_required' END AS proof FROM customer)
        SELECT c_custkey AS doc_id, layout, proof, CASE WHEN proof IS NULL THEN 'no_matches' WHEN layout = 'reflow-line' THEN 'reflow_line_unsupported' WHEN proof = 'reflow_required' THEN proof
          WHEN odd AND proof <> 'width_proven' THEN 'cmap_multibyte_requires_width_proof' WHEN layout = 'preserve-width' AND proof <> 'width_proven' THEN 'preserve_width_not_proven' ELSE 'ok' END AS status
        FROM c, (SELECT unnest(['allow-width-change', 'preserve-width', 'reflow-line']) AS layout)""",
    "wide_font_widths": f"""SELECT doc_id, a AS old_width, b AS new_width, CASE WHEN a = b THEN 'width_proven' WHEN b < a THEN 'width_narrower' ELSE 'reflow_required' END AS status
        FROM (SELECT p_partkey AS doc_id, {_WIDE.format("p_name")} AS a, {_WIDE.format("p_brand")} AS b FROM part)""",
    "edit_guarantees": """SELECT c_custkey AS doc_id, asked, CASE WHEN c_mktsegment <> 'BUILDING' THEN 'no_matches' WHEN c_custkey % 3 = 2 THEN 'shared_form_xobject' WHEN c_custkey % 3 = 0 AND asked = 'all' THEN 'verification_failed' ELSE 'ok' END AS status,
        c_mktsegment = 'BUILDING' AND c_custkey % 3 < 2 AS new_selectable, c_mktsegment = 'BUILDING' AND c_custkey % 3 = 1 AS old_gone FROM customer, (SELECT unnest(['all', 'two']) AS asked)""",
    "inserted_pages": """WITH t AS (SELECT conv_id, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS p, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations),
        d AS (SELECT DISTINCT conv_id, n, conv_id // 2 % 4 AS at_ FROM t WHERE conv_id % 2 = 0), s AS (SELECT DISTINCT conv_id - 1 AS conv_id, n AS sn FROM t),
        k AS (SELECT * FROM d JOIN s USING (conv_id) WHERE at_ <= n AND (conv_id % 4 <> 0 OR sn > 1)),
        r AS (SELECT k.conv_id AS doc_id, k.conv_id AS source, p, CASE WHEN p < at_ THEN 0 ELSE 2 END AS a, p AS b, text FROM k JOIN t USING (conv_id) UNION ALL
          SELECT k.conv_id, k.conv_id + 1, p, 1, CASE WHEN k.conv_id % 4 = 0 THEN 1 - p ELSE p END, text FROM k JOIN t ON t.conv_id = k.conv_id + 1 WHERE k.conv_id % 4 <> 0 OR p < 2)
        SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY a, b) - 1)::INT AS page_index, source, p::INT AS source_page, md5(text) AS digest FROM r""",
    "first_catalog_entries": """SELECT s_nationkey::BIGINT AS doc_id, arg_min(CASE WHEN s_suppkey % 3 > 0 THEN {'v': s_name} ELSE {'v': NULL} END, s_suppkey).v AS lang, arg_min(CASE WHEN s_suppkey % 2 > 0 THEN {'v': 'UseOutlines'} ELSE {'v': NULL} END, s_suppkey).v AS page_mode,
        bool_or(s_acctbal < 0)::VARCHAR AS need FROM supplier GROUP BY 1""",
    "packet_diagnostics": """SELECT o_orderkey AS doc_id, 0::INT AS packet, 'datasets' AS kind, CASE WHEN o_orderkey % 4 IN (0, 2) THEN 'datasets' END AS root, o_orderkey % 4 = 0 AS whole, o_orderkey % 4 = 1 AS unsafe FROM orders
        UNION ALL SELECT o_orderkey, 1, 'xdp', 'xdp', true, false FROM orders WHERE o_custkey % 3 = 0""",
    "form_summary": "SELECT c_custkey AS doc_id, 2::BIGINT AS fields, CASE WHEN c_nationkey > 12 THEN 1 ELSE 2 END::BIGINT AS fillable, CASE WHEN c_custkey % 2 = 0 THEN 1 ELSE 0 END::BIGINT AS annotations FROM customer",
    "hybrid_references": "SELECT p_partkey AS doc_id, p_partkey % 3 < 2 AS has_hybrid, CASE WHEN p_partkey % 3 < 2 THEN 'hybrid_xref_stream' ELSE 'xref_stream' END AS writer, p_partkey % 3 <> 1 AS fits FROM part",
    "node_by_id": """WITH t AS (SELECT conv_id AS doc_id, count(*) AS n, arg_min(coalesce(text, ''), turn) AS text FROM conversations GROUP BY 1)
        SELECT doc_id, 0::BIGINT AS node_id, 'document' AS kind, NULL AS digest, NULL AS object_number FROM t UNION ALL SELECT doc_id, 1, 'stream', NULL, '12' FROM t UNION ALL SELECT doc_id, n + 1, 'text_show', md5(text), NULL FROM t""",
    "canonical_order": """SELECT c_custkey AS doc_id, unnest([1, 2, 3, 7])::INT AS num, unnest([1, 2, 3, 4])::INT AS place, unnest(['<< /Type /Catalog >>', c_nationkey::VARCHAR, '(' || c_name || ')', '(' || c_mktsegment || ')']) AS value FROM customer""",
}
