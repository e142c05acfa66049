"""From raw documents to packed sequences, stage by stage.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept. All but the last return
the columns of documents: doc_id, text, lang, source, n_chars; extra columns are left out. Nulls are allowed in every
column, an empty table gives an empty result, and rows that share a doc_id are told apart by what they hold.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm import mixing, nearcopies, packing, repeats, toxicity
from vellum.llm.common import ship, stage, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is at least 0.7 go; the classifier is fitted on the table labels.

    Each row is scored by its whole text alone, so equal texts stay or go together; null counts as empty.
    """
    docs = docs.select(*COLUMNS)
    scored = toxicity.with_scores(docs, table(spark, sf_dir, "labels"), cut=0.7, out="_toxicity")
    return scored.where("_toxicity < 0.7").select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of 80 % equal five-word shingles stays, that of the smallest doc_id.

    Texts without a word are linked with nothing and stay, as do rows with a null doc_id. Rows that share a doc_id are one
    document: they stay or go together, but of those with one text too a single one stays.
    """
    ship(spark)
    return nearcopies.without_near_copies(docs.select(*COLUMNS), k=5, percent=80)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of 200-byte strings that start elsewhere too go; no document does, though its text may become empty.

    Strings are judged on the input: rows with one text, under one doc_id or two or none, all lose it. Null becomes an empty text.
    """
    ship(spark)
    cut = repeats.without_repeats(docs.select(*COLUMNS), carry=("lang", "source"))
    return cut.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.length("kept_text").cast("long").alias("n_chars"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in their target weights; a document may come up to three times.

    A null source is one of its own, the last. Documents without a word have no size. Reruns draw alike, ties included.
    """
    ship(spark)
    return mixing.mixed(docs.select(*COLUMNS))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens with their ids, their sequence and their place in it.

    Equal rows are packed each; a null or empty text is its end mark alone. Which of several pieces of one length goes where
    depends on the input's partitions.
    """
    ship(spark)
    return packing.pack(docs.select(*COLUMNS))


STAGES = [
    ("toxicity", drop_toxic),
    ("near copies", drop_near_copies),
    ("repeated spans", cut_repeats),
    ("source mix", mix_sources),
    ("packing", pack_sequences),
]

#: SQL can't express trained models, hashes of our own or tokenizers; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
