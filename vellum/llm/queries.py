"""One query per operator, with production parameters, over whole tables; `ORACLES` has SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm import codes, cotrain, language, leaks, mixing, nearcopies, neighbours, packing, repeats, resample, rules, scoring, sql, toxicity
from vellum.llm.common import table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_repeated_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.without_repeats(table(spark, sf_dir, "documents"), with_text=False)


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.languages(table(spark, sf_dir, "documents")).drop("shares")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), keep_ids=False)


def op5_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cotrain.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearcopies.near_copies(table(spark, sf_dir, "documents"), k=3, percent=85, bands=24, rows=5)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.quality(table(spark, sf_dir, "documents")).drop("rejected_by")


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(table(spark, sf_dir, "documents"))


def op9_vantage_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op10_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.held_out_score(table(spark, sf_dir, "documents"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.compress(table(spark, sf_dir, "embeddings")).drop("label")


def op12_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = leaks.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    listed = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), listed.alias("items_sha256"), "contaminated")


def op13_target_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("n_words")


_ALL = (
    op1_toxicity,
    op2_repeated_spans,
    op3_language,
    op4_packing,
    op5_cotraining,
    op6_near_copies,
    op7_quality_rules,
    op8_source_mix,
    op9_vantage_neighbours,
    op10_lm_scores,
    op11_vector_codes,
    op12_benchmark_leaks,
    op13_target_resampling,
)
QUERIES = {f.__name__: f for f in _ALL}
ORACLES = {"op6_near_copies": sql.OP6, "op7_quality_rules": sql.OP7, "op9_vantage_neighbours": sql.OP9, "op11_vector_codes": sql.op11(), "op12_benchmark_leaks": sql.OP12, "op13_target_resampling": sql.OP13}
