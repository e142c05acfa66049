"""Formats of documents: each has an adapter that knows its files by their first bytes and makes them nodes.

Rows are split by format and united again, so selectors work over documents of several formats at once.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.operators import edits
from vellum.operators.nodes import nodes

NODES = ("doc_id", "node_id", "kind", "value", "meta", "num", "seq")


@dataclass(frozen=True)
class Adapter:
    """nodes: of docs(doc_id, content), a table of NODES, with name where nodes have names; edit: (docs, old, new) -> doc_id, status, content, if the format can be edited."""

    name: str
    prefix: bytes
    nodes: Callable[[DataFrame], DataFrame]
    edit: Callable[[DataFrame, str, str], DataFrame] | None = None


class Formats:
    """The adapters that are known; of prefixes that begin alike the longer one decides."""

    def __init__(self, *adapters: Adapter):
        self.adapters: dict[str, Adapter] = {}
        for a in adapters:
            self.register(a)

    def register(self, adapter: Adapter) -> Formats:
        if not adapter.prefix:
            raise ValueError("a format needs a prefix")
        if adapter.name in self.adapters or any(a.prefix == adapter.prefix for a in self.adapters.values()):
            raise ValueError(f"the format {adapter.name} or its prefix is known already")
        self.adapters[adapter.name] = adapter
        return self

    def format_of(self, content: Column) -> Column:
        """The name of the format; null if none knows the bytes."""
        out = F.lit(None).cast("string")
        for a in sorted(self.adapters.values(), key=lambda a: len(a.prefix)):
            out = F.when(F.substring(content, 1, len(a.prefix)) == F.lit(a.prefix), F.lit(a.name)).otherwise(out)
        return out

    def _split(self, docs: DataFrame, each: Callable[[Adapter, DataFrame], DataFrame | None]) -> DataFrame:
        known = docs.select("doc_id", "content", self.format_of(F.col("content")).alias("format"))
        parts = [(a.name, each(a, known.where(F.col("format") == a.name).select("doc_id", "content"))) for a in self.adapters.values()]
        return reduce(DataFrame.unionByName, [p.withColumn("format", F.lit(n)) for n, p in parts if p is not None])

    def nodes(self, docs: DataFrame) -> DataFrame:
        """NODES, name and format of the documents whose format is known; name is null where the format has none."""

        def named(a: Adapter, d: DataFrame) -> DataFrame:
            rows = a.nodes(d)
            return rows.select(*NODES, (F.col("name") if "name" in rows.columns else F.lit(None)).cast("string").alias("name"))

        return self._split(docs, named)

    def edit(self, docs: DataFrame, old: str, new: str) -> DataFrame:
        """doc_id, format, status, content: a text replaced in documents of every format that can be edited; unknown_format and not_editable say why not."""
        made = self._split(docs, lambda a, d: d.select("doc_id", F.lit("not_editable").alias("status"), F.lit(None).cast("binary").alias("content")) if a.edit is None else a.edit(d, old, new).select("doc_id", "status", "content"))
        other = docs.where(self.format_of(F.col("content")).isNull()).select("doc_id", F.lit("unknown_format").alias("status"), F.lit(None).cast("binary").alias("content"), F.lit(None).cast("string").alias("format"))
        return made.unionByName(other).select("doc_id", "format", "status", "content")


PDF = Adapter("pdf", b"%PDF-", nodes, edits.edit)


def formats() -> Formats:
    """The formats that come with the library."""
    return Formats(PDF)
