"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Every source is cut into blocks of about BLOCK_WORDS words by a seeded hash of the document. A source's quota is a
number of whole passes over its blocks and, for the rest, the first blocks of a seeded permutation, the last of them in
part. The block quotas of all sources are split down a binary tree of output shards: at each node the left half of the
shards draws, without replacement, as many blocks as its share, from a multivariate hypergeometric distribution over
the sources. Each leaf finds its own way down the tree, whose draws are seeded by the node, so leaves are worked out
side by side; a leaf thus holds exact quotas by source and takes the next disjoint blocks of each permutation.
What the mix takes of a document is what the shards draw of its block.

The driver holds one number a source. Blocks and draws are tables, as many rows as there are blocks and passes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.llm.common import MAX_BROADCAST_IDS, WORD, ship, stage

WEIGHTS = (5.0, 2.0, 1.0)
#: Words in a block, and in an output shard, about; a source has LEAST_BLOCKS at least.
BLOCK_WORDS, SHARD_WORDS, LEAST_BLOCKS = 500_000, 5_000_000, 256


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: float = 3.0) -> DataFrame:
    """sizes(source, source_size) with at (the source's place), weight and target.

    Shares of the total size by weight, none above cap times its size; the excess is shared again by weight. Sources are
    ordered by code point, null last; each round settles all that are above, so there are few.
    """
    at = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1).cast("long")  # a row a source
    cycle = F.array(*map(F.lit, weights))
    rows = sizes.withColumn("at", at).withColumn("weight", F.element_at(cycle, (F.col("at") % len(weights) + 1).cast("int")))
    rows = rows.withColumn("target", F.when(F.col("source_size") <= 0, F.lit(0.0)))
    rows = stage(rows)
    total = float(rows.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0])
    while True:
        settled, left_weight = rows.agg(F.coalesce(F.sum("target"), F.lit(0.0)), F.coalesce(F.sum(F.when(F.col("target").isNull(), F.col("weight"))), F.lit(0.0))).first()
        if not left_weight:
            return rows
        share = F.lit((total - settled) / left_weight) * F.col("weight")
        above = F.col("target").isNull() & (share > cap * F.col("source_size"))
        if rows.where(above).isEmpty():
            return rows.withColumn("target", F.coalesce("target", share))
        rows = stage(rows.withColumn("target", F.when(above, cap * F.col("source_size")).otherwise(F.col("target"))))


def leaf(counts: np.ndarray, shards: int, shard: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(first, number) of the blocks of each source that a shard holds: the way from the root of the tree down to it.

    A node's draw depends on its place and the seed alone, so every leaf below sees the same one.
    """
    first, low, high = np.zeros_like(counts), 0, shards
    while high - low > 1:
        middle = low + (high - low) // 2
        total = int(counts.sum())
        rng = np.random.default_rng([seed, low, high])
        drawn = rng.multivariate_hypergeometric(counts, total * (middle - low) // (high - low), method="marginals") if total else counts * 0
        if shard < middle:
            counts, high = drawn, middle
        else:
            first, counts, low = first + drawn, counts - drawn, middle
    return first, counts


def _leaves(batches: Iterator[pa.RecordBatch], places: list[int], counts: list[int], shards: int, seed: int) -> Iterator[pa.RecordBatch]:
    """(at, unit, shard): the blocks of each source that the shards draw."""
    quotas, at = np.array(counts, np.int64), np.array(places, np.int64)
    for batch in batches:
        for shard in batch.column("id").to_pylist():
            first, number = leaf(quotas, shards, shard, seed)
            own = np.repeat(at, number)
            begins = np.repeat(first - (np.cumsum(number) - number), number)
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(np.arange(len(own)) + begins), pa.array(np.full(len(own), shard, np.int64))], ["at", "unit", "shard"])


def sized(docs: DataFrame, seed: int, size: Column | None) -> DataFrame:
    """docs with _mix_size and _mix_hash. Rows of equal id and text have one hash."""
    text = F.col("text") if "text" in docs.columns else F.lit(None).cast("string")
    return docs.withColumns({"_mix_size": word_count(F.col("text")) if size is None else size, "_mix_hash": F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce(text, F.lit("")), F.lit(seed))})


def in_blocks(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """rows with the place of their source, its size and target, and their block."""
    own = sources.select(F.struct("source").alias("_mix_s"), "at", "source_size", "target", "n_blocks")
    small = sources.limit(MAX_BROADCAST_IDS + 1).count() <= MAX_BROADCAST_IDS  # a row a source
    rows = rows.withColumn("_mix_s", F.struct("source")).join(F.broadcast(own) if small else own, "_mix_s").drop("_mix_s")
    return rows.withColumn("_mix_block", F.pmod("_mix_hash", F.col("n_blocks")))


def plan(small: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: float = 3.0, block_words: int = BLOCK_WORDS, least: int = LEAST_BLOCKS, shards: int | None = None, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """(sources, draws) from small(source, _mix_size, _mix_hash): draws(at, block, pass, part, shard) has a row for each time that a block is drawn.

    part is null where the whole block is drawn, else the words of it.
    """
    sizes = small.groupBy("source").agg(F.sum("_mix_size").alias("source_size"))
    sources = source_targets(sizes, weights, cap).withColumn("n_blocks", F.greatest(F.lit(least), F.ceil(F.col("source_size") / block_words)).cast("long"))
    passes = F.when(F.col("source_size") > 0, F.floor(F.least(F.col("target") / F.col("source_size"), F.lit(cap)))).otherwise(0).cast("int")
    sources = stage(sources.withColumn("passes", passes).withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size")))
    blocks = in_blocks(small, sources).groupBy("at", F.col("_mix_block").alias("block")).agg(F.sum("_mix_size").alias("n"))
    blocks = blocks.join(sources.select("at", "passes", "rest"), "at")
    order = Window.partitionBy("at").orderBy(F.xxhash64("block", F.lit(seed)), "block")  # blocks, not documents: few rows a source
    blocks = blocks.withColumns({"ord": F.row_number().over(order) - 1, "before": F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n"), "m": F.count(F.lit(1)).over(Window.partitionBy("at"))})
    some = (F.col("before") < F.col("rest")) & (F.col("n") > 0)
    last = F.when(F.col("before") + F.col("n") <= F.col("rest"), F.lit(None)).otherwise(F.col("rest") - F.col("before"))
    whole = F.when(F.col("passes") > 0, F.transform(F.sequence(F.lit(0), F.greatest(F.col("passes") - 1, F.lit(0))), lambda p: F.struct(p.alias("pass"), F.lit(None).cast("double").alias("part"), (p * F.col("m") + F.col("ord")).cast("long").alias("unit"))))
    none = F.array().cast("array<struct<pass:int,part:double,unit:long>>")
    partial = F.when(some, F.array(F.struct(F.col("passes").alias("pass"), last.cast("double").alias("part"), F.lit(-1).cast("long").alias("unit")))).otherwise(none)
    units = blocks.select("at", "block", "ord", "m", "passes", F.explode(F.concat(F.coalesce(whole, none), partial)).alias("u")).select("at", "block", "u.*", "ord", "m", "passes")
    # The blocks of the last pass follow on those of the whole ones, without gaps.
    rank = F.row_number().over(Window.partitionBy("at", F.col("unit") < 0).orderBy("ord")) - 1
    units = stage(units.withColumn("unit", F.when(F.col("unit") < 0, F.col("passes") * F.col("m") + rank).otherwise(F.col("unit"))).select("at", "block", "pass", "part", "unit"))
    counts = sorted((r[0], r[1]) for r in units.groupBy("at").count().collect())  # one number a source
    total = sum(r[0] or 0 for r in sources.agg(F.sum("source_size")).collect())
    shards = shards or max(1, -(-int(total) // SHARD_WORDS))
    places, numbers = [c[0] for c in counts], [c[1] for c in counts]
    leaves = small.sparkSession.range(shards).mapInArrow(lambda b: _leaves(b, places, numbers, shards, seed), "at long, unit long, shard long")
    return sources, stage(units.join(leaves, ["at", "unit"]).select("at", "block", "pass", "part", "shard"))


def by_block(rows: DataFrame, draws: DataFrame, how: str) -> DataFrame:
    """rows joined with draws on their block."""
    own = draws.withColumnRenamed("block", "_mix_block")
    small = draws.limit(MAX_BROADCAST_IDS + 1).count() <= MAX_BROADCAST_IDS
    return rows.join(F.broadcast(own) if small else own, ["at", "_mix_block"], how)


def upto(*keys: str) -> Column:
    """Words up to and with a document, in the order of its block."""
    return F.sum("_mix_size").over(Window.partitionBy(*keys).orderBy("_mix_hash", "doc_id").rowsBetween(Window.unboundedPreceding, 0))


def taken(docs: DataFrame, seed: int = 7, size: Column | None = None, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken (words the mix takes, repeats counted), source, shards (of each time): one row per row of docs.

    size: words by default. Null texts and texts without words have size 0 and are drawn with their block at no
    cost. Null sources are one source, ordered last. Rows of equal id and text are kept or repeated alike, but for those
    that a block's cut parts. An empty table gives an empty result. Extra columns are left out.
    """
    ship(docs.sparkSession)
    small = stage(sized(docs.select("doc_id", "text", "source"), seed, size).drop("text"))
    sources, draws = plan(small, seed=seed, **options)
    per = draws.groupBy("at", "block").agg(F.max("part").alias("part"), F.array_sort(F.collect_list(F.when(F.col("part").isNull(), F.col("shard")))).alias("whole"), F.max(F.when(F.col("part").isNotNull(), F.col("shard"))).alias("last"))
    rows = by_block(in_blocks(small, sources), per, "left")
    # A document of the block that is drawn in part belongs to the draw if most of it lies before the cut.
    cut = rows.where("part is not null").withColumn("extra", upto("at", "_mix_block") - F.col("_mix_size") / 2 <= F.col("part"))
    every = rows.where("part is null").withColumn("extra", F.lit(False)).unionByName(cut)
    shards = F.concat(F.coalesce("whole", F.array().cast("array<long>")), F.when(F.col("extra"), F.array("last")).otherwise(F.array().cast("array<long>")))
    return every.withColumn("shards", shards).select("doc_id", F.col("_mix_size").alias("size"), "source_size", "target", (F.col("_mix_size") * F.size("shards")).cast("long").alias("taken"), "source", "shards")


def mixed(docs: DataFrame, seed: int = 7, size: Column | None = None, **options) -> DataFrame:
    """The mix itself: the columns of docs, each row as often as it is drawn, dealt to shards and shuffled within each. Names that begin with `_mix` are ours."""
    ship(docs.sparkSession)
    whole = sized(docs, seed, size)
    sources, draws = plan(stage(whole.select("source", "_mix_size", "_mix_hash")), seed=seed, **options)
    own = sources.select("source", F.col("at").alias("_mix_at"), F.col("n_blocks").alias("_mix_n"))
    named = draws.join(own.withColumnRenamed("_mix_at", "at"), "at").select("source", F.col("_mix_n"), F.col("block").alias("_mix_block"), F.col("pass").alias("_mix_pass"), F.col("part").alias("_mix_part"), F.col("shard").alias("_mix_shard"))
    named = named.select(F.struct("source").alias("_mix_s"), *named.columns[1:])
    per = own.select(F.struct("source").alias("_mix_s"), F.col("_mix_n"))
    few = per.limit(MAX_BROADCAST_IDS + 1).count() <= MAX_BROADCAST_IDS  # a row a source
    rows = whole.withColumn("_mix_s", F.struct("source")).join(F.broadcast(per) if few else per, "_mix_s").withColumn("_mix_block", F.pmod("_mix_hash", F.col("_mix_n"))).drop("_mix_n")
    small = draws.limit(MAX_BROADCAST_IDS + 1).count() <= MAX_BROADCAST_IDS
    right = named.drop("_mix_n")
    rows = rows.join(F.broadcast(right) if small else right, ["_mix_s", "_mix_block"])
    part = rows.where("_mix_part is not null").withColumn("_mix_upto", upto("_mix_s", "_mix_block", "_mix_pass")).where("_mix_upto - _mix_size / 2 <= _mix_part").drop("_mix_upto")
    return (
        rows.where("_mix_part is null").unionByName(part)
        .withColumn("_mix_order", F.xxhash64("_mix_hash", "_mix_pass", F.lit(seed)))
        .repartition("_mix_shard")
        .sortWithinPartitions("_mix_shard", "_mix_order")
        .select(*docs.columns)
    )
