"""Packing documents into sequences: cutting stock by column generation over a histogram of piece lengths.

A document is cut into full pieces and a rest. Pieces of one length are alike, so the problem is a histogram of at
most `capacity` lengths, whatever the number of documents. A linear program over patterns (which lengths share a
sequence) is solved by column generation: the basis gives a price for each length, a knapsack dynamic program finds
the pattern worth most at these prices, and it enters the basis. Patterns are used as often as the program says,
rounded down; what remains is filled by subset sums. Documents are ranked within each length, and ranks map to
patterns by intervals, so that only the histogram and the patterns meet on the driver.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellum.llm.common import stage
from vellum.llm.texts import Memo, resident

#: White space beside a space, or a space at either end: such a text isn't cut at its spaces.
_ODD = re.compile(r"\s | \s|^ | $")
#: Rows of offsets (partition, length) that are broadcast; beyond that Spark joins them by a shuffle.
MAX_OFFSETS = 2_000_000


def special_tokens(path: str) -> dict[str, int]:
    """The added tokens that a tokenizer file names, with their ids."""
    with open(path, encoding="utf-8") as f:
        return {t["content"]: t["id"] for t in json.load(f).get("added_tokens", ())}


def encoder(path: str, ranks: str | None = None, special: dict[str, int] | None = None):
    """text -> bytes of its ids, little-endian, 32 bits each.

    Between words a single space always begins a token, so a text can be cut there, and each distinct piece
    is encoded once. Texts with other white space beside a space are taken whole, as are those in which a special token
    is spelt. `ranks`, the same vocabulary as ranks, is quicker and smaller: the tokenizer file is not loaded then.
    """
    special = special_tokens(path) if special is None else special
    if ranks:
        import tiktoken

        with open(ranks, "rb") as f:
            known = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        model = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=known, special_tokens=special)
        plain = lambda text: array("I", model.encode_ordinary(text)).tobytes()
        whole = lambda text: array("I", model.encode(text, allowed_special="all")).tobytes()
    else:
        from tokenizers import Tokenizer

        model = Tokenizer.from_file(path)
        whole = plain = lambda text: np.array(model.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    memo = Memo(plain)

    def encode(text: str) -> bytes:
        if any(s in text for s in special):
            return whole(text)
        if _ODD.search(text):
            return plain(text)
        first, *rest = text.split(" ")
        return memo[first] + b"".join([memo[" " + w] for w in rest])

    return encode


def pieces(batches: Iterator[pa.RecordBatch], path: str, ranks: str | None, special: dict[str, int], capacity: int, end_id: int, keep_ids: bool) -> Iterator[pa.RecordBatch]:
    """Pieces of each document, with their place among the pieces of the same length in this partition."""
    encode = resident(f"encoder {path} {ranks}", lambda: encoder(path, ranks, special))
    part, seen = TaskContext.get().partitionId(), [0] * (capacity + 1)
    end = np.array([end_id], "<u4").tobytes()
    for batch in batches:
        out: dict[str, list] = {c: [] for c in ("row", "start", "length", "ids_crc32", "doc_tokens", "place")}
        ids: list[bytes] = []
        for row, text in enumerate(batch.column("text").to_pylist()):
            data = (encode(text) if text else b"") + end
            total = len(data) // 4
            for start in range(0, total, capacity):
                length = min(capacity, total - start)
                piece = data[4 * start : 4 * (start + length)]
                for c, v in zip(out, (row, start, length, zlib.crc32(piece), total, seen[length]), strict=True):
                    out[c].append(v)
                if keep_ids:
                    ids.append(piece)
                seen[length] += 1
        rows = pa.array(out.pop("row"), pa.int64())
        arrays = [batch.column("doc_id").take(rows), *(pa.array(v, pa.int64()) for v in out.values()), pa.array([part] * len(rows), pa.int32())]
        names = ["doc_id", *out, "part"]
        if keep_ids:
            flat = np.frombuffer(b"".join(ids), "<i4")
            at = np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])]).astype(np.int32)
            arrays.append(pa.ListArray.from_arrays(pa.array(at), pa.array(flat)))
            names.append("ids")
        yield pa.RecordBatch.from_arrays(arrays, names)


def knapsack(prices: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, dict[int, int]]:
    """The pattern of greatest worth: best[c] over all capacities c, each from the best choice of a last item."""
    best, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    use = np.flatnonzero(prices > 1e-12)
    s, p = sizes[use], prices[use]
    order = np.argsort(s)
    s, p, use = s[order], p[order], use[order]
    fits = np.searchsorted(s, np.arange(capacity + 1), "right")
    for c in range(1, capacity + 1):
        best[c], choice[c] = best[c - 1], -1
        if k := fits[c]:
            worth = best[c - s[:k]] + p[:k]
            j = int(worth.argmax())
            if worth[j] > best[c] + 1e-12:
                best[c], choice[c] = worth[j], j
    pattern: dict[int, int] = {}
    c = capacity
    while c > 0:
        if choice[c] < 0:
            c -= 1
        else:
            i = int(use[choice[c]])
            pattern[i] = pattern.get(i, 0) + 1
            c -= int(s[choice[c]])
    return float(best[capacity]), pattern


def fullest(left: dict[int, float], capacity: int) -> dict[int, int]:
    """The longest piece that is left and the subset of the others that comes nearest to full, by subset sums as bits."""
    first = max(left)
    room, reach, steps = capacity - first, 1, []
    mask = (1 << (room + 1)) - 1
    for s in sorted(left, reverse=True):
        for _ in range(int(min(left[s] - (s == first), room // s))):
            grown = (reach | (reach << s)) & mask
            if grown == reach:
                break
            steps.append((s, reach))
            reach = grown
        if reach >> room & 1:
            break
    at, pattern = reach.bit_length() - 1, {first: 1}
    for s, before in reversed(steps):
        if not before >> at & 1:
            pattern[s] = pattern.get(s, 0) + 1
            at -= s
    return pattern


def first_basis(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> tuple[list[dict[int, int]], np.ndarray, list[int]]:
    """Patterns that each use up one length, their use, and the order in which lengths are used up: by that they are triangular, so they are a feasible basis."""
    at = {int(s): i for i, s in enumerate(sizes)}
    left = {int(s): float(d) for s, d in zip(sizes, demand, strict=True)}
    patterns: list[dict[int, int]] = [{} for _ in sizes]
    use, order = np.zeros(len(sizes)), []
    while left:
        pattern = fullest(left, capacity)
        times, gone = min((left[s] / n, s) for s, n in pattern.items())
        patterns[at[gone]] = {at[s]: n for s, n in pattern.items()}
        use[at[gone]] = times
        order.append(at[gone])
        for s, n in pattern.items():
            left[s] -= n * times
        del left[gone]
        for s in [s for s in pattern if s in left and left[s] < 1e-9]:  # used up at the same time
            patterns[at[s]] = {at[s]: capacity // s}
            order.append(at[s])
            del left[s]
    return patterns, use, order


def triangular_inverse(patterns: list[dict[int, int]], order: list[int]) -> np.ndarray:
    """The inverse of the basis, by forward substitution: a pattern holds only lengths that are used up with it or later."""
    m = len(patterns)
    rows: list[list[tuple[int, int]]] = [[] for _ in range(m)]  # of each length, the patterns that hold it
    for j, pattern in enumerate(patterns):
        for i, n in pattern.items():
            rows[i].append((j, n))
    inverse = np.zeros((m, m))
    for i in order:
        row = np.zeros(m)
        row[i] = 1.0
        for j, n in rows[i]:
            if j != i:
                row -= n * inverse[j]
        inverse[i] = row / patterns[i][i]
    return inverse


def column_generation(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 300) -> tuple[list[tuple[dict[int, int], float]], dict[str, float]]:
    """Patterns and how often each is used, from the linear program, and a report: columns that entered, the use, a bound from below.

    It stops when no pattern is worth more than a sequence, which is the optimum, or after `rounds` columns: any basis
    on the way is a valid, if looser, solution. The prices give the bound: no packing takes less than their sum over the worth
    of the best pattern.
    """
    patterns, use, order = first_basis(sizes, demand, capacity)
    inverse = triangular_inverse(patterns, order)
    entered, bound = 0, float((sizes * demand).sum()) / capacity
    for _ in range(rounds):
        prices = inverse.sum(axis=0)
        worth, pattern = knapsack(prices, sizes, capacity)
        if worth > 0:
            bound = max(bound, float(np.maximum(prices, 0) @ demand) / worth)
        if worth <= 1 + 1e-7 or use.sum() <= bound * (1 + 1e-6):
            break
        column = sum(n * inverse[:, i] for i, n in pattern.items())
        ratio = np.where(column > 1e-9, use / np.where(column > 1e-9, column, 1), np.inf)
        leave = int(ratio.argmin())
        if not np.isfinite(ratio[leave]):
            break
        step = ratio[leave]
        use = np.maximum(use - step * column, 0)
        use[leave] = step
        row = inverse[leave] / column[leave]
        inverse -= np.outer(column, row)
        inverse[leave] = row
        patterns[leave] = pattern
        entered += 1
    return [(p, float(u)) for p, u in zip(patterns, use, strict=True)], {"columns": entered, "use": float(use.sum()), "bound": bound}


def fill_up(counts: dict[int, int], capacity: int) -> list[dict[int, int]]:
    """Sequences for what rounding left, each the fullest that is left."""
    left = {int(s): int(n) for s, n in counts.items() if n > 0}
    made = []
    while left:
        made.append(pattern := fullest(left, capacity))
        for s, n in pattern.items():
            left[s] -= n
            if not left[s]:
                del left[s]
    return made


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """(lengths and how many of each, number of sequences filled like this), all pieces placed exactly once."""
    left = dict(histogram)
    made: list[tuple[dict[int, int], int]] = []
    if left.get(capacity):
        made.append(({capacity: 1}, left.pop(capacity)))
    lengths = sorted(int(s) for s, n in left.items() if n)
    if lengths:
        sizes = np.array(lengths)
        for pattern, use in column_generation(sizes, np.array([left[s] for s in lengths], float), capacity)[0]:
            times = int(min([use + 1e-9, *(left[lengths[i]] // n for i, n in pattern.items())]))
            if times > 0:
                made.append(({lengths[i]: n for i, n in pattern.items()}, times))
                for i, n in pattern.items():
                    left[lengths[i]] -= n * times
        made += [(p, 1) for p in fill_up(left, capacity)]
    return made


def intervals(made: list[tuple[dict[int, int], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, end rank, pieces in a sequence, first sequence, offset): which ranks of a length fill which sequences."""
    rows, rank, sequence = [], {}, 0
    for pattern, times in made:
        offset = 0
        for length, n in sorted(pattern.items(), reverse=True):
            lo = rank.get(length, 0)
            rank[length] = lo + n * times
            rows.append((length, lo, rank[length], n, sequence, offset))
            offset += n * length
        sequence += times
    return rows


def pack(docs: DataFrame, tokenizer: str | None = None, ranks: str | None = None, capacity: int = 1024, end_id: int = 0, keep_ids: bool = True) -> DataFrame:
    """Pieces of all documents with sequence_id and offset; ids array<int> with keep_ids.

    doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids]. A document's ids are those of its text
    (null: none) and end_id; it is cut after every `capacity` ids. Equal rows are packed each. A sequence is padded to
    capacity by whoever writes it out. A null doc_id is kept. Extra columns are left out; an empty table
    gives an empty result. Which equal-length piece goes where depends on how the input is partitioned.
    """
    path = tokenizer or public_tokenizers.path("byte_bpe_50k.json")
    ranks = ranks or (None if tokenizer else public_tokenizers.path("byte_bpe_50k.tiktoken"))
    special = special_tokens(path)
    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, place long, part int" + ", ids array<int>" * keep_ids
    cut = stage(docs.select("doc_id", "text").mapInArrow(lambda b: pieces(b, path, ranks, special, capacity, end_id, keep_ids), schema))
    counts = cut.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("n")).collect()}  # at most `capacity` rows
    upto = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = stage(counts.select("part", "length", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("before")))
    small = offsets.limit(MAX_OFFSETS + 1).count() <= MAX_OFFSETS
    ranked = cut.join(F.broadcast(offsets) if small else offsets, ["part", "length"]).withColumn("rank", F.col("before") + F.col("place"))
    rows = intervals(plan(histogram, capacity))
    # A few intervals for each of at most `capacity` lengths and as many patterns: at most capacity**2 rows.
    where = docs.sparkSession.createDataFrame(rows, "length long, lo long, hi long, n long, sequence long, base long")
    placed = ranked.join(F.broadcast(where), "length").where("rank >= lo and rank < hi")
    slot = F.col("rank") - F.col("lo")
    return placed.select(
        "doc_id",
        "start",
        "length",
        "ids_crc32",
        "doc_tokens",
        (F.col("sequence") + F.floor(slot / F.col("n"))).cast("long").alias("sequence_id"),
        (F.col("base") + slot % F.col("n") * F.col("length")).alias("offset"),
        *["ids"] * keep_ids,
    )
