from pyspark.sql import functions as F

from vellum.operators.edits import plan
from vellum.operators.graph import annotations, pages
from vellum.operators.nodes import Selector
from vellum.operators.rewrite import change, rewrite, rewritten
from vellum.plans.staging import ship
from vellum.sources import mint
from vellum.sources.scan import objects


def _docs(spark):
    ship(spark)
    shown = mint.show(F.lit("old"))
    return spark.range(3).select(
        F.col("id").cast("string").alias("doc_id"),
        mint.document(
            F.array(
                mint.obj(1, "<< /Type /Catalog /Pages 2 0 R >>"),
                mint.obj(2, "<< /Type /Pages /Kids [3 0 R] /Resources << >> >>"),
                mint.obj(3, "<< /Type /Page /Parent 2 0 R /Contents 4 0 R /Annots [<< /Subtype /Text /Rect [0 0 1 1] /Contents (direct) >> 6 0 R 5 0 R] >>"),
                mint.obj(4, mint.stream(F.when(F.col("id") == 0, F.concat(shown, shown)).when(F.col("id") == 1, shown).otherwise(""))),
                mint.obj(5, "<< /Type /Annot /Contents (five) >>"),
                mint.obj(6, "<< /Type /Annot /Contents (six) >>"),
            )
        ).alias("content"),
    )


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_notes_of_documents_are_found_without_a_shuffle(spark):
    docs = _docs(spark)
    objs = objects(docs)
    one, other = annotations(docs), annotations(objs, pages(objs))
    assert "Exchange" not in _plan(one)
    assert sorted(map(str, one.collect())) == sorted(map(str, other.collect())) and one.count() == 9


def test_documents_are_written_anew_where_they_are_parsed(spark):
    docs = _docs(spark)
    wanted = spark.createDataFrame([("0", 5, {"Contents": "(new)"}, None), ("1", 4, None, bytearray(b"BT ET"))], "doc_id string, num int, sets map<string,string>, data binary")
    one = rewritten(docs, wanted)
    assert _plan(one).count("MapInArrow") == 1
    other = rewrite(objects(docs), wanted.select(*change(F.col("doc_id"), F.col("num"), F.col("sets"), F.col("data"))))
    of = lambda df: {r.doc_id: (bytes(r.content), r.error) for r in df.collect()}
    assert of(one) == of(other) and set(of(one)) == {"0", "1"} and [(r.sound, r.loose) for r in one.collect()] == [(True, 0)] * 2
    again = rewritten(docs, wanted.select("doc_id", F.lit(4).alias("num")), lambda old, w: old + b"%")
    assert {bytes(r.raw)[-1:] for r in objects(again).where("num = 4").collect()} == {b"%"}


def test_an_edit_is_planned_from_one_pass(spark):
    docs = _docs(spark)
    got = lambda **k: {r.doc_id: (r.status, r.matches, r.seq) for r in plan(docs, "old", "new", **k).collect()}
    assert got() == {"0": ("multiple_matches", 2, None), "1": ("ok", 1, 0), "2": ("no_matches", 0, None)}
    assert got(selector=Selector().match_index(1)) == {"0": ("ok", 2, 1), "1": ("match_index_out_of_range", 1, None), "2": ("no_matches", 0, None)}
    assert got(selector=Selector().meta("operator", "TJ"))["0"][0] == "no_matches"
    assert _plan(plan(docs, "old", "new")).count("MapInArrow") == 1
