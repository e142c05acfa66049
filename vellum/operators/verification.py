"""Whether a written document is what an operation on pages was to make: parsed again, counted, and searched for text."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.operators.nodes import Pages
from vellum.plans.staging import stage_documents as stage

_FACTS = {"doc_id": pa.string(), "texts": pa.list_(pa.string()), "page_count": pa.int64(), "content": pa.bool_(), "resources": pa.bool_(), "dangling": pa.int64()}


def _facts(data: bytes) -> tuple:
    """A document's texts, each once, and what its pages are."""
    own = Pages(data)
    return list({t for _, t in own.texts()}), own.count, own.content if own.count else None, own.resources if own.count else None, own.loose


def _checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(doc_id, *_facts(data or b"")) for doc_id, data in zip(batch.column("doc_id").to_pylist(), batch.column("content").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(_FACTS.values())], list(_FACTS))


def verify_pages(docs: DataFrame, wanted: DataFrame, need_content: bool = False, need_resources: bool = False) -> DataFrame:
    """A row for each of docs(doc_id, content): what wanted(doc_id, page_count, texts) asks of it, and whether it holds.

    page_count, page_count_ok (no count, or one below 1, asks nothing), content_ok (each page shows a stream that is there; asked by
    need_content), resources_ok (each page has or inherits resources; asked by need_resources), missing (sorted texts that no text-show has; null, empty
    and repeated texts are asked for once or not at all), dangling (references to objects that are not there) and ok, all of it together. Documents that
    wanted doesn't name are only held against the rest; several rows of wanted for one document are asked together, of their
    counts the greatest. A document without objects has no pages. An empty table gives an empty result.
    """
    # Each document is parsed once, where it lies; what is shuffled is a row of its facts and texts, and one of what is asked of it.
    told = stage(docs.select("doc_id", "content").mapInArrow(_checked, "doc_id string, texts array<string>, page_count long, content boolean, resources boolean, dangling long"))
    asked = wanted.groupBy("doc_id").agg(F.max("page_count").alias("asked_count"), F.flatten(F.collect_list("texts")).alias("asked")).hint("merge")
    rows = told.join(asked, "doc_id", "left")
    missing = F.array_sort(F.array_except(F.filter("asked", lambda t: t != ""), "texts"))
    count = F.coalesce("page_count", F.lit(0))
    checks = {
        "page_count_ok": F.coalesce((F.col("asked_count") < 1) | (F.col("asked_count") == count), F.lit(True)),
        "content_ok": F.lit(not need_content) | F.coalesce("content", F.lit(True)),
        "resources_ok": F.lit(not need_resources) | F.coalesce("resources", F.lit(True)),
        "missing": F.coalesce(missing, F.array().cast("array<string>")),
        "dangling": F.coalesce("dangling", F.lit(0)),
    }
    rows = rows.select("doc_id", count.alias("page_count"), *(c.alias(n) for n, c in checks.items()))
    good = F.col("page_count_ok") & F.col("content_ok") & F.col("resources_ok") & (F.size("missing") == 0) & (F.col("dangling") == 0)
    return rows.withColumn("ok", good)
