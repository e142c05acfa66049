"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.plans.staging import ship, stage, table  # noqa: F401

#: A word is a run of bytes other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: The longest list of ids that is broadcast (8 bytes each); longer ones are joined by a shuffle.
MAX_BROADCAST_IDS = 2_000_000


def bucket_of(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo modulus: the split into learned and held-out rows. Null ids count as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def held_out(doc_id: Column, modulus: int = 3, remainder: int = 1) -> Column:
    return bucket_of(doc_id, modulus) == remainder


def components(edges: DataFrame, rounds: int = 60, jumps: int = 2) -> DataFrame:
    """Connected components of edges(a long, b long): rows (node, root), root the smallest id that node reaches.

    Each round, every node is hooked to the smallest of its neighbours and itself, hooks of hooks are followed `jumps`
    times, and the links are contracted: those within one root are gone for good, equal ones become one. So the links
    are joined whole once, whatever the number of rounds.
    """
    links = stage(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct())
    labels = stage(links.select(F.col("a").alias("node")).union(links.select("b")).distinct().select("node", F.col("node").alias("root")))
    for _ in range(rounds):
        if links.isEmpty():
            return labels
        hook = stage(links.select(F.col("a").alias("v"), F.col("a").alias("to")).union(links.select("b", "a")).groupBy("v").agg(F.min("to").alias("to")))
        for _ in range(jumps):
            hook = stage(hook.join(hook.select(F.col("v").alias("to"), F.col("to").alias("next")), "to").select("v", F.col("next").alias("to")))
        a, b = (hook.select(F.col("v").alias(c), F.col("to").alias(f"to_{c}")) for c in ("a", "b"))
        near, far = F.least("to_a", "to_b"), F.greatest("to_a", "to_b")
        links = stage(links.join(a, "a").join(b, "b").select(near.alias("a"), far.alias("b")).where("a < b").distinct())
        labels = stage(labels.join(hook, labels["root"] == hook["v"], "left").select("node", F.coalesce("to", "root").alias("root")))
    raise RuntimeError(f"links are left after {rounds} rounds; raise the number of rounds")
