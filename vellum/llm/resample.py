"""Resampling documents towards a target: importance weights from hashed features, and an exact weighted selection.

Features are words and pairs of neighbours, hashed to buckets by crc32. Bucket counts of the corpus and of the target give a
gain for each bucket; a document's weight is the mean gain of its features, and a Gumbel draw of its id is added, so that the
highest scores are a draw without replacement with the weights' odds. Buckets of a batch are arrays: crc32 is linear, so that
of a pair comes from those of its words by table look-ups.

The cutoff is found by weighted medians of medians: partitions give the median of their keys that are left and how many
are; the median of those, weighted by the sizes, has at least a quarter of all keys left on either side, and one side
goes. Keys are counted, never gathered; only the winners are sorted, by ranges.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import stage
from vellum.llm.texts import LETTERS, Rows, flat, resident

BUCKETS, SHARE, MIN_WORDS, SEED = 10_000, 25, 20, 7
#: Bytes of text whose words are looked up at a time; longer texts come in pieces.
PIECE = 1 << 20
#: The longest word whose pairs are hashed by tables.
LONGEST = 63
#: So few keys end the rounds: they are ordered on the driver.
LAST = 4_096


def _zeros() -> np.ndarray:
    """What a crc becomes when n zero bytes follow, for each of its four bytes: (n, byte, value)."""
    one = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        one = np.where(one & 1, (one >> 1) ^ np.uint32(0xEDB88320), one >> 1)
    out = np.zeros((LONGEST + 2, 4, 256), np.uint32)
    out[0] = np.arange(256, dtype=np.uint32)[None] << (8 * np.arange(4, dtype=np.uint32))[:, None]
    for n in range(1, len(out)):
        out[n] = one[out[n - 1] & 0xFF] ^ (out[n - 1] >> 8)
    return out


class Features:
    """Buckets of the features of texts."""

    def __init__(self):
        self.zeros = _zeros()
        self.rows = Rows(lambda words: np.array([(zlib.crc32(w), zlib.crc32(b" " + w), len(w)) for w in words], np.int64).reshape(-1, 3), 3, kind=np.int64)

    def _pieces(self, plain: bytes, at: list[int]) -> Iterator[tuple[int, list[bytes], bool]]:
        """(text, words, whether the first word is the last one of the piece before, again)."""
        for k, (a, b) in enumerate(zip(at, at[1:], strict=False)):
            before: list[bytes] = []
            while a < b:
                stop = plain.find(b" ", a + PIECE, b) if b - a > PIECE else b
                stop = b if stop < 0 else stop
                words = plain[a:stop].split()
                yield k, before + words, bool(before)
                before, a = words[-1:] or before, stop

    def __call__(self, column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(texts of words, buckets of words, texts of pairs, buckets of pairs), some texts at a time."""
        data, at = flat(column)
        words: list[bytes] = []
        runs: list[tuple[int, int, bool]] = []
        size = 0
        for k, got, again in self._pieces(data.tobytes().translate(LETTERS), at.tolist()):
            words += got
            runs.append((k, len(got), again))
            size += sum(map(len, got)) + len(got)
            if size > PIECE:
                yield self._buckets(words, runs)
                words, runs, size = [], [], 0
        if runs:
            yield self._buckets(words, runs)

    def _buckets(self, words: list[bytes], runs: list[tuple[int, int, bool]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        n = np.array([r[1] for r in runs])
        text = np.repeat([r[0] for r in runs], n)
        begins = np.zeros(len(words) + 1, bool)
        begins[np.cumsum(n) - n] = True
        own = np.ones(len(words) + 1, bool)
        own[(np.cumsum(n) - n)[[r[2] for r in runs]]] = False  # a word that is there again is no feature again
        crc, spaced, length = self.rows(words).T if words else np.zeros((3, 0), np.int64)
        second = np.flatnonzero(~begins[:-1])
        a, b, more = crc[second - 1], spaced[second], np.minimum(length[second], LONGEST) + 1
        pair = b.copy()
        for byte in range(4):
            pair ^= self.zeros[more, byte, (a >> (8 * byte)) & 0xFF]
        for i in np.flatnonzero(length[second] > LONGEST).tolist():
            pair[i] = zlib.crc32(words[second[i] - 1] + b" " + words[second[i]])
        return text[own[:-1]], crc[own[:-1]] % BUCKETS, text[second], pair % BUCKETS


def features() -> Features:
    return resident("features", Features)


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """bucket, n of the task's features."""
    total = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for _, words, _, pairs in features()(batch.column("text")):
            total += np.bincount(words, minlength=BUCKETS) + np.bincount(pairs, minlength=BUCKETS)
    there = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), pa.array(total[there], pa.int64())], ["bucket", "n"])


def bucket_counts(texts: DataFrame) -> np.ndarray:
    found = texts.select("text").mapInArrow(counted, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(BUCKETS, np.int64)
    for r in found:
        out[r.bucket] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln of how much likelier a bucket is in the target), each count and one more."""
    s, t, all_s, all_t = source.astype(float), target.astype(float), float(source.sum()), float(target.sum())
    return np.floor(1000 * np.log((t + 1) * (all_s + BUCKETS) / ((s + 1) * (all_t + BUCKETS)))).astype(np.int64)


def weighed(batches: Iterator[pa.RecordBatch], gain: np.ndarray) -> Iterator[pa.RecordBatch]:
    """doc_id, n_words, n_features, weight: the floored mean gain of the features, 0 without any."""
    for batch in batches:
        n_words, n_features, total = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
        for a, words, b, pairs in features()(batch.column("text")):
            n_words += np.bincount(a, minlength=batch.num_rows)
            n_features += np.bincount(a, minlength=batch.num_rows) + np.bincount(b, minlength=batch.num_rows)
            for text, bucket in ((a, words), (b, pairs)):
                if len(text):  # texts come in order: sums between their borders are exact
                    ends = np.cumsum(gain[bucket])[np.append(np.flatnonzero(np.diff(text)), len(text) - 1)]
                    total[text[np.append(True, np.diff(text) > 0)]] += np.diff(ends, prepend=0)
        weight = np.where(n_features > 0, total // np.maximum(n_features, 1), 0)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in (n_words, n_features, weight))], ["doc_id", "n_words", "n_features", "weight"])


#: The order of a draw, smallest first: scores from above, smaller ids, null ids last, then rows that differ otherwise; the row's number makes keys unique.
KEY = ("-score", "cast(doc_id is null as bigint)", "coalesce(doc_id, 0L)", "-weight", "n_features", "row")
KEYS = tuple(f"k{i}" for i in range(len(KEY)))
Key = tuple[int, ...]


def below(columns: list, key: Key) -> tuple:
    """(smaller than the key, equal to it) for keys given by columns, of arrays or of Spark."""
    less, same = columns[0] < key[0], columns[0] == key[0]
    for c, k in zip(columns[1:], key[1:], strict=True):
        less, same = less | (same & (c < k)), same & (c == k)
    return less, same


def medians(batches: Iterator[pa.RecordBatch], low: Key | None, pivot: Key | None, high: Key | None) -> Iterator[pa.RecordBatch]:
    """side, n and median of the task's keys between low and high, on either side of the pivot: -1 below it, 1 above; without a pivot all are above."""
    kept = []
    for batch in batches:
        columns = [batch.column(c).to_numpy() for c in KEYS]
        left = np.ones(batch.num_rows, bool)
        if low is not None:
            left &= ~np.logical_or(*below(columns, low))
        if high is not None:
            left &= below(columns, high)[0]
        kept.append([c[left] for c in columns])
    columns = [np.concatenate([b[i] for b in kept]) if kept else np.zeros(0, np.int64) for i in range(len(KEYS))]
    less, same = below(columns, pivot) if pivot is not None else (np.zeros(len(columns[0]), bool),) * 2
    out: list[tuple] = []
    for side, mine in ((-1, less), (1, ~less & ~same)):
        rows = np.flatnonzero(mine)
        if len(rows):
            order = np.lexsort([c[rows] for c in reversed(columns)])
            middle = rows[order[(len(rows) - 1) // 2]]
            out.append((side, len(rows), [int(c[middle]) for c in columns]))
    kinds = (pa.int32(), pa.int64(), pa.list_(pa.int64()))
    yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate(kinds)], ["side", "n", "median"])


def cutoff(keys: DataFrame, count: int, last: int = LAST) -> Key | None:
    """The key at place `count`, from 1, in the order of keys(k0, k1, ...), all different; None if there are not so many."""

    def asked(low: Key | None, pivot: Key | None, high: Key | None) -> dict[int, list[tuple[Key, int]]]:
        sides: dict[int, list] = {-1: [], 1: []}
        for r in keys.mapInArrow(lambda b: medians(b, low, pivot, high), "side int, n long, median array<long>").collect():
            sides[r.side].append((tuple(r["median"]), r.n))
        return sides

    low = high = None
    left = asked(low, None, high)[1]
    if count < 1 or count > sum(n for _, n in left):
        return None
    while (size := sum(n for _, n in left)) > last:
        reached, pivot = 0, None
        for median, n in sorted(left):
            reached, pivot = reached + n, median
            if 2 * reached >= size:
                break
        sides = asked(low, pivot, high)
        smaller = sum(n for _, n in sides[-1])
        if count == smaller + 1:
            return pivot
        if count <= smaller:
            high, left = pivot, sides[-1]
        else:
            low, left, count = pivot, sides[1], count - smaller - 1
    inside = keys
    columns = [F.col(k) for k in KEYS]
    if low is not None:
        less, same = below(columns, low)
        inside = inside.where(~(less | same))
    if high is not None:
        inside = inside.where(below(columns, high)[0])
    return sorted(tuple(r) for r in inside.select(*KEYS).collect())[count - 1]


def ranked(rows: DataFrame, order: list[Column]) -> DataFrame:
    """rows with their rank, from 1, in an order without ties: sorted by ranges, each range counted on from those before."""
    placed = stage(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    sizes = sorted(placed.groupBy(part.alias("part")).count().collect())  # one number a partition
    before = np.cumsum([0] + [n for _, n in sizes])
    starts = rows.sparkSession.createDataFrame(pa.table({"_part": pa.array([p for p, _ in sizes], pa.int64()), "_before": pa.array(before[: len(sizes)], pa.int64())}))
    rank = F.col("_before") + F.col("_at").bitwiseAND(F.lit(2**33 - 1)) + 1
    return placed.join(starts, part == F.col("_part")).withColumn("rank", rank).drop("_at", "_part", "_before")


def draw_of(doc_id: Column, seed: int) -> Column:
    """The thousandfold of a Gumbel variate, as a whole number, from the id and the seed alone; a null id counts as empty text."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296.0)))


def resample(docs: DataFrame, target: DataFrame, share: int = SHARE, min_words: int = MIN_WORDS, seed: int = SEED, last: int = LAST) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank of docs(doc_id, text): rank is null but for the documents drawn.

    Of the N documents with at least min_words words, floor(share * N / 100) with the highest scores are drawn, ties to the
    smaller doc_id (a null one last), then to the larger weight and the fewer features; rows equal in all of that are alike, and each is a
    document of its own. Null and empty texts have no features and weight 0. With an empty target the gains are those
    of a target without features; an empty table of documents gives an empty result.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    gain = spark.sparkContext.broadcast(gains(bucket_counts(docs), bucket_counts(target)))
    rows = docs.mapInArrow(lambda b: weighed(b, gain.value), "doc_id long, n_words long, n_features long, weight long")
    rows = stage(rows.withColumn("score", F.col("weight") + draw_of(F.col("doc_id"), seed)).withColumn("row", F.monotonically_increasing_id()))
    able = F.col("n_words") >= min_words
    keys = rows.where(able).select(*[F.expr(e).alias(k) for e, k in zip(KEY, KEYS, strict=True)])
    at = cutoff(keys, share * rows.where(able).count() // 100, last)
    columns = ["doc_id", "n_words", "n_features", "weight", "score"]
    if at is None:
        return rows.select(*columns, F.lit(None).cast("long").alias("rank"))
    order = [F.expr(e) for e in KEY]
    less, same = below(order, at)
    won = able & (less | same)
    return ranked(rows.where(won), order).select(*columns, "rank").unionByName(rows.where(~won).select(*columns, F.lit(None).cast("long").alias("rank")))
