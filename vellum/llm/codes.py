"""Vectors as short codes: product codebooks learned and applied in whole numbers.

A vector's components become integers and are cut into parts; each part is named by the nearest entry of its codebook.
Parts and entries are padded with zeros to a power of two and go through an integer Walsh-Hadamard transform. It scales
every squared distance by its size exactly, and its coefficients, in the order of their sign changes, gather the
large differences first: the sum so far never falls, so an entry whose sum is beyond a distance already reached is
out for good. No floating point takes part once components are integers.

Codebooks are learned in rounds. In a round, each task assigns its rows and adds up its parts by entry; Spark adds up the
tasks' sums. The driver holds the codebooks alone: parts x entries x width numbers.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import stage

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Rows compared with a codebook at a time, and coefficients between two eliminations.
BLOCK, STEP = 256, 4
#: Sums travel in limbs of so many bits: 2 ** 22 tasks of 2 ** ROWS_BITS rows add up within 64 bits.
LIMB, ROWS_BITS = 40, 34


def walsh(x: np.ndarray) -> np.ndarray:
    """The Walsh-Hadamard transform of the last axis, whose length is a power of two."""
    shape, step = x.shape, 1
    while step < shape[-1]:
        pair = x.reshape(*shape[:-1], shape[-1] // (2 * step), 2, step)
        a, b = pair[..., 0, :], pair[..., 1, :]
        x = np.stack([a + b, a - b], axis=-2).reshape(shape)
        step *= 2
    return x


def sequency(size: int) -> np.ndarray:
    """The coefficients of walsh() in the order of their functions' sign changes."""
    return np.argsort((np.diff(walsh(np.eye(size, dtype=np.int64)), axis=0) != 0).sum(axis=0))


def transformed(x: np.ndarray) -> np.ndarray:
    """Coefficients in sequency order of the last axis, padded with zeros to a power of two."""
    size = 1 << max(0, x.shape[-1] - 1).bit_length()
    pad = np.zeros((*x.shape[:-1], size - x.shape[-1]), x.dtype)
    return walsh(np.concatenate([x, pad], axis=-1))[..., sequency(size)]


def nearest(points: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, distance scaled by the number of coefficients) of the nearest entry, ties to the lower index; both come transformed."""
    size = points.shape[1]
    sums = np.zeros((len(points), len(entries)), points.dtype)
    at = min(STEP, size)
    for k in range(at):
        d = points[:, k, None] - entries[None, :, k]
        sums += d * d
    # The entry that leads so far gives a distance that is reached; what is beyond it already can't be the nearest.
    lead = entries[sums.argmin(axis=1)]
    limit = ((points - lead) ** 2).sum(axis=1)
    row, entry = np.nonzero(sums <= limit[:, None])
    left = sums[row, entry]
    while at < size:
        for k in range(at, min(at + STEP, size)):
            d = points[row, k] - entries[entry, k]
            left = left + d * d
        at += STEP
        alive = left <= limit[row]
        row, entry, left = row[alive], entry[alive], left[alive]
    # Survivors stand by row, then by entry; the leading one is always among them.
    first = np.searchsorted(row, np.arange(len(points)))
    least = np.minimum.reduceat(left, first)
    hit = np.flatnonzero(left == least[row])
    return entry[hit[np.searchsorted(row[hit], np.arange(len(points)))]], least


class Coder:
    """Codebooks (parts x entries x width), transformed once, and what they make of vectors."""

    def __init__(self, books: np.ndarray):
        self.books, self.kind = books, books.dtype
        self.entries = [transformed(b) for b in books]

    def integers(self, column: pa.Array) -> np.ndarray:
        """floor(SCALE * x) of a list column, padded with zeros to the width of the codebooks: rows x parts x width."""
        parts, _, width = self.books.shape
        counts, values = column.value_lengths().to_numpy(zero_copy_only=False), column.flatten().to_numpy(zero_copy_only=False)
        if self.kind == object:
            values = np.array([int(x) * SCALE if abs(x) >= 2**53 else math.floor(x * SCALE) for x in values.tolist()], object)
        else:
            values = np.floor(values * SCALE).astype(np.int64)
        out = np.zeros((len(column), parts * width), self.kind)
        out[np.repeat(np.arange(len(column)), counts), np.arange(len(values)) - np.repeat(np.cumsum(counts) - counts, counts)] = values
        return out.reshape(len(column), parts, width)

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry of each part, squared distance of each part) of rows x parts x width."""
        codes, errors = np.zeros(x.shape[:2], np.int64), np.zeros(x.shape[:2], self.kind)
        for p, entries in enumerate(self.entries):
            for i in range(0, len(x), BLOCK):
                codes[i : i + BLOCK, p], scaled = nearest(transformed(x[i : i + BLOCK, p]), entries)
                errors[i : i + BLOCK, p] = scaled // entries.shape[1]
        return codes, errors


def summed(batches: Iterator[pa.RecordBatch], coder: Coder, limbs: int) -> Iterator[pa.RecordBatch]:
    """part, entry, n, sums: how many of the task's parts fall to each entry, and their sums in limbs, position by position."""
    parts, size, width = coder.books.shape
    counts, sums = np.zeros((parts, size), np.int64), np.zeros((parts, size, width), coder.kind)
    for batch in batches:
        x = coder.integers(batch.column("point"))
        codes, _ = coder.assign(x)
        for p in range(parts if len(x) else 0):
            order = np.argsort(codes[:, p], kind="stable")
            entry, first, n = np.unique(codes[order, p], return_index=True, return_counts=True)
            counts[p, entry] += n
            sums[p, entry] += np.add.reduceat(x[order, p], first, axis=0)
    p, e = np.nonzero(counts)
    low = [(sums[p, e] >> (LIMB * i)) & (2**LIMB - 1) for i in range(limbs - 1)] + [sums[p, e] >> (LIMB * (limbs - 1))]
    rows = np.stack(low, axis=-1).reshape(len(p), -1).tolist() if len(p) else []
    kinds = (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()))
    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip((p, e, counts[p, e], rows), kinds, strict=True)], ["part", "entry", "n", "sums"])


def coded(batches: Iterator[pa.RecordBatch], coder: Coder) -> Iterator[pa.RecordBatch]:
    """The batch's other columns with code and error (null where it takes more than 64 bits)."""
    for batch in batches:
        codes, errors = coder.assign(coder.integers(batch.column("point")))
        code = [r.tobytes().hex() for r in codes.astype(np.uint8)]
        error = [e if e < 2**63 else None for e in errors.sum(axis=1).tolist()]
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(code, pa.string()), pa.array(error, pa.int64())], ["vec_id", "label", "code", "error"])


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, label, point: rows whose vector is there and has nothing but finite numbers."""
    point = F.transform("embedding", lambda x: x.cast("double"))
    fine = F.forall("point", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", point.alias("point")).where(F.col("point").isNotNull() & fine)


def learned(rows: DataFrame, parts: int, entries: int, rounds: int) -> Coder:
    """The codebooks of usable rows after so many rounds; without rows they have no entries."""
    top = F.greatest(F.abs(F.array_max("point")), F.abs(F.array_min("point")))
    longest, largest = rows.agg(F.max(F.size("point")), F.max(top)).first()
    width = -(-(longest or 0) // parts)
    bound = (int(largest or 0) + 1) * SCALE + 1
    size = 1 << max(0, width - 1).bit_length()
    kind = np.int64 if size * max(width, 1) * (2 * bound) ** 2 < 2**62 and bound < 2 ** (62 - ROWS_BITS) else object
    limbs = max(1, -(-(bound.bit_length() + ROWS_BITS) // LIMB))
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "point").limit(entries).select("point").toArrow().column(0).combine_chunks()
    start = Coder(np.zeros((parts, 0, width), kind)).integers(first)
    books = np.ascontiguousarray(start.transpose(1, 0, 2))
    context = rows.sparkSession.sparkContext
    for _ in range(rounds if books.shape[1] else 0):
        sent = context.broadcast(Coder(books))
        task = lambda b, sent=sent: summed(b, sent.value, limbs)
        found = rows.select("point").mapInArrow(task, "part int, entry int, n long, sums array<long>").groupBy("part", "entry")
        totals = found.agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[i]) for i in range(width * limbs)]).alias("sums")).collect()
        for r in totals:
            whole = [sum(v << (LIMB * i) for i, v in enumerate(r.sums[j : j + limbs])) for j in range(0, width * limbs, limbs)]
            books[r.part, r.entry] = [v // r.n for v in whole]
        sent.unpersist()
    return Coder(books)


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, label, code, error, label_error, codebooks_sha256 of vectors(vec_id, embedding, label).

    Rows whose vector is null, or holds a null or non-finite component, are dropped. A component x counts as
    floor(1024 * x). Vectors shorter than the longest, and a longest one that the parts don't divide, count as if
    zeros followed (an empty one is all zeros). The codebooks begin with the vectors of the smallest vec_ids (null ids last,
    equal ids by their components); with fewer rows than entries, codebooks have as many entries as there are rows.
    Repeated rows each count and are each returned. label_error is the sum of error over equal labels, null labels together.
    Numbers of any size are reckoned exactly; an error of more than 64 bits is null, and so is a label's sum over one.
    An empty table gives an empty result.
    """
    rows = usable(vectors)
    coder = learned(rows, parts, entries, rounds)
    digest = hashlib.sha256(",".join(str(int(x)) for x in coder.books.ravel()).encode()).hexdigest()
    label = rows.schema["label"].dataType.simpleString()
    if not coder.books.shape[1]:
        empty = rows.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"))
        return empty.where(F.lit(False)).withColumn("codebooks_sha256", F.lit(digest))
    sent = rows.sparkSession.sparkContext.broadcast(coder)
    out = stage(rows.mapInArrow(lambda b: coded(b, sent.value), f"vec_id long, label {label}, code string, error long"))
    whole = F.when(F.count("error") == F.count(F.lit(1)), F.sum(F.col("error").cast("decimal(38,0)")))
    by_label = out.groupBy(F.col("label").alias("_of")).agg(whole.alias("_w")).select("_of", F.expr("try_cast(_w as bigint)").alias("label_error"))
    joined = out.join(by_label, F.col("label").eqNullSafe(F.col("_of")), "left")
    return joined.select("vec_id", "label", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
