import re

import corpus_pipeline
import numpy as np
from support import SMALL, same_rows
from helpers import awkward, near_components, removed
from pyspark.sql import functions as F

from vellum.llm import queries, sql
from vellum.llm.common import ship


def documents(spark, rows):
    ship(spark)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return docs.withColumn("n_chars", F.length("text").cast("long")).withColumn("extra", F.lit(1))


def test_stages_keep_their_promises(spark):
    steps = dict(corpus_pipeline.STAGES)
    docs = documents(spark, awkward())
    kept = steps["toxicity"](spark, docs, SMALL)
    assert tuple(kept.columns) == corpus_pipeline.COLUMNS and kept.count() >= docs.count() - 1
    kept = steps["near copies"](spark, docs, SMALL)
    roots = near_components([r[:2] for r in awkward()], 5, 80)
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(d for d, r in roots.items() if d == r)
    cut = steps["repeated spans"](spark, docs, SMALL).collect()
    assert sorted(r.n_chars for r in cut) == sorted(len(r.text) for r in cut) and len(cut) == len(awkward())
    assert sum(len(r.text.encode()) for r in cut) <= sum(n - gone for n, gone, *_ in removed([r[1] for r in awkward()]))
    mixed = steps["source mix"](spark, docs, SMALL)
    assert tuple(mixed.columns) == corpus_pipeline.COLUMNS
    packed = steps["packing"](spark, docs, SMALL).toPandas()
    assert (packed.groupby("sequence_id").length.sum() <= 1024).all()


def test_stages_take_empty_tables(spark):
    for _, step in corpus_pipeline.STAGES:
        assert step(spark, documents(spark, []), SMALL).count() == 0


def test_stages_take_rows_that_share_an_id(spark):
    """Equal ids with other texts, repeated rows, and null ids: each row is judged on its own text, but near copies are of documents."""
    steps = dict(corpus_pipeline.STAGES)
    long = next(r[1] for r in awkward() if r[0] == 13)
    rows = [(1, "an apple a day keeps the doctor away", "en", "a"), (1, "another text of the same id altogether", "en", "a"), (2, "once more with feeling and with care", "en", "b"), (2, "once more with feeling and with care", "en", "b")]
    rows += [(3, "an apple a day keeps the doctor away", "en", None), (None, long, "en", "a"), (None, None, None, None), (4, long[:400], "en", "b"), (5, "", None, None)]
    docs = documents(spark, rows)
    texts = lambda df: sorted((str(r.doc_id), r.text or "") for r in df.collect())
    every = sorted((str(r[0]), r[1] or "") for r in rows)
    assert texts(steps["toxicity"](spark, docs, SMALL)) == every
    kept = texts(steps["near copies"](spark, docs, SMALL))
    once = list(every)
    once.remove(("2", rows[2][1]))
    once.remove(("3", rows[4][1]))
    assert kept == once
    got = steps["repeated spans"](spark, docs, SMALL).collect()
    sizes = sorted((str(r[0]), n - gone) for r, (n, gone, *_) in zip(rows, removed([r[1] for r in rows]), strict=True))
    assert sorted((str(r.doc_id), len(r.text.encode())) for r in got) == sizes
    mixed = texts(steps["source mix"](spark, docs, SMALL))
    assert set(mixed) <= set(every) and all(mixed.count(m) <= 3 * every.count(m) for m in mixed)
    packed = steps["packing"](spark, docs, SMALL).collect()
    ends = [p for p in packed if p.start + p.length == p.doc_tokens]
    assert sorted(str(p.doc_id) for p in ends) == [e[0] for e in every]


def test_run(spark):
    out = corpus_pipeline.run(spark, SMALL).toPandas()
    assert len(out) and [len(i) for i in out.ids] == list(out.length)
    assert all(np.cumsum([0, *x.length])[-1] <= 1024 for _, x in out.groupby("sequence_id"))


def test_queries_are_numbered_and_whole():
    numbers = sorted(int(re.match(r"op(\d+)_", q)[1]) for q in queries.QUERIES)
    assert numbers == list(range(1, 14))


def test_sql(spark, duck):
    for name, oracle in queries.ORACLES.items():
        got, expected = queries.QUERIES[name](spark, SMALL).toPandas(), duck.execute(oracle).fetchdf()
        # pandas makes whole numbers with nulls floating ones on one side alone
        same_rows(got.astype({c: "Int64" for c in got if str(expected[c].dtype) == "Int64"}), expected)
    assert "documents" in sql.OP6
