"""What several queries of the document graph answer from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.operators.nodes import text_rows


def page_texts(docs: DataFrame, *keep: str) -> DataFrame:
    """doc_id, page_index and the digest of its text, of documents whose cross references lead to all objects; doc_id as it is with keep."""
    rows = text_rows(docs, proven=True).where("page_index is not null")
    if keep:
        return rows.select("doc_id", "page_index", *keep)
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("page_index").cast("long").alias("page_index"), F.md5("text").alias("digest"))
