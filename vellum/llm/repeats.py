"""Suffix-array deduplication with a run-length compressed Burrows-Wheeler transform.

A byte goes if a string of `span` bytes that covers it also starts anywhere else, in the same text or another.

1. Every window of `span` bytes has a least k-gram hash; consecutive windows with the same one form a run. Equal windows
   have equal least hashes, so a run can only repeat in runs of the same hash: the hash is the key that brings the
   runs of all texts together, a run's bytes need not travel to find out whether they could repeat.
2. Runs whose hash occurs once are unique. Where all runs of a hash have the same 128-bit blake2b digest of their bytes,
   each of them repeats whole. Only runs of hashes with different contents (the edges of copies) and runs that may repeat inside themselves go on.
3. Their distinct contents are indexed: the suffix array of a batch of contents gives the Burrows-Wheeler transform;
   only the suffixes at the ends of its runs of equal letters are kept as samples. From the samples' common
   prefixes the matching statistics of every position are streamed (they fall by one from position to position
   until the next sample), and windows whose longest match has `span` bytes are marked.
4. Contents of one hash beyond a batch's bound (a passage in a large part of all documents, each time in other
   surroundings) are not gathered in one task: their windows are compared by blake2b digests, counted by Spark.

Keys that only bring candidates together are 64-bit hashes; what decides is bytes, or a digest for which no two inputs are known.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import stage
from vellum.llm.texts import U64, chunks, flat, mix, resident

SPAN, GRAM = 200, 32
#: Bytes of distinct contents of one hash that one task may gather.
GATHERED = 16_000_000
#: Bytes of contents in one index.
BATCH = 100_000
#: Bytes of text that are hashed at once; a longer text is taken whole.
CHUNK = 250_000

#: What a row is known by: its id and 128 bits of its text's SHA-256.
ROW = ("_id", "_t1", "_t2")

_rng = np.random.default_rng(20240229)
_LETTERS = _rng.integers(0, 2**63, 256).astype(U64) * U64(2) + U64(1)
_BASE = int(_rng.integers(0, 2**61)) * 4 + 3


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of an odd base and of its inverse, modulo 2**64."""
    made = resident("powers", dict)
    if not made or len(made["both"][0]) < n:
        both = []
        for b in (_BASE, pow(_BASE, -1, 2**64)):
            p = np.full(n + 1, U64(b % 2**64))
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        made["both"] = (both[0], both[1])
    return made["both"]


def digests(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The 128-bit blake2b digests of ranges of bytes, as pairs of numbers."""
    view = memoryview(np.ascontiguousarray(data))
    made = [hashlib.blake2b(view[a:b], digest_size=16).digest() for a, b in zip(start.tolist(), end.tolist(), strict=True)]
    return np.frombuffer(b"".join(made), np.int64).reshape(-1, 2)


class Hasher:
    """Polynomial hashes of all substrings of one length, by differences of one prefix sum; unequal ones may meet."""

    def __init__(self, data: np.ndarray):
        up, self.down = powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, U64)
        np.cumsum(_LETTERS[data] * up[: len(data)], out=self.sums[1:])

    def grams(self, k: int) -> np.ndarray:
        n = len(self.sums) - k
        return mix((self.sums[k:] - self.sums[:-k]) * self.down[:n])


def sliding(x: np.ndarray, w: int, of: np.ufunc) -> np.ndarray:
    """of (minimum or maximum) over each w neighbours, by blockwise prefixes and suffixes."""
    n = len(x)
    blocks = -(-n // w)
    padded = np.full(blocks * w, x[-1], x.dtype)
    padded[:n] = x
    padded = padded.reshape(blocks, w)
    before = of.accumulate(padded, axis=1).ravel()
    after = of.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return of(after[: n - w + 1], before[w - 1 : n])


def runs(data: np.ndarray, at: np.ndarray, span: int = SPAN, k: int = GRAM) -> dict[str, np.ndarray]:
    """Runs of windows with the same least k-gram: text, start in the text, windows, hash, digest (and more of it), and whether the run may repeat inside itself."""
    w = span - k + 1
    lengths = np.diff(at)
    none = {c: np.zeros(0, t) for c, t in (("text", np.int64), ("start", np.int64), ("windows", np.int64), ("hash", np.int64), ("digest", np.int64), ("more", np.int64), ("inner", bool))}
    if len(data) < span or not (lengths >= span).any():
        return none
    hasher = Hasher(data)
    grams = hasher.grams(k)
    least = sliding(grams, w, np.minimum)
    step = np.zeros(len(least) + 1, np.int8)
    long_ = np.flatnonzero(lengths >= span)
    np.add.at(step, at[long_], 1)
    np.add.at(step, at[long_ + 1] - span + 1, -1)
    places = np.flatnonzero(np.cumsum(step[:-1]))
    values = least[places]
    cut = np.flatnonzero((np.diff(places) != 1) | (values[1:] != values[:-1])) + 1
    first, last = np.concatenate([[0], cut]), np.concatenate([cut - 1, [len(places) - 1]])
    start, end = places[first], places[last]
    # Places of least k-grams; two equal ones close together lie in the windows of one run.
    top = sliding(np.concatenate([np.zeros(w - 1, U64), np.where(np.cumsum(step[:-1]) > 0, least, U64(0)), np.zeros(w - 1, U64)]), w, np.maximum)
    least_at = np.flatnonzero(top[: len(grams)] == grams)
    twice = np.flatnonzero((grams[least_at[1:]] == grams[least_at[:-1]]) & (np.diff(least_at) <= w))
    inner = np.zeros(len(start), bool)
    if len(twice):
        p = least_at[twice]
        text = np.searchsorted(at, p, "right") - 1
        s = np.minimum(p, at[text + 1] - span)
        run = np.searchsorted(start, s, "right") - 1
        good = (run >= 0) & (s >= at[text])
        run = run[good]
        inner[run[(s[good] <= end[run])]] = True
    text = np.searchsorted(at, start, "right") - 1
    digest = digests(data, start, end + span)
    return {
        "text": text,
        "start": start - at[text],
        "windows": end - start + 1,
        "hash": values[first].view(np.int64),
        "digest": digest[:, 0],
        "more": digest[:, 1],
        "inner": inner,
    }


def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, at = flat(batch.column("text"))
        for i, j in chunks(at, CHUNK):
            found = runs(data[at[i] : at[j]], at[i : j + 1] - at[i])
            rows = pa.array(found["text"] + i)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).take(rows) for c in ROW), *(pa.array(found[c]) for c in ("hash", "digest", "more")), *(pa.array(found[c].astype(np.int32)) for c in ("start", "windows")), pa.array(found["inner"])],
                [*ROW, "hash", "digest", "more", "start", "windows", "inner"],
            )


class RunIndex:
    """Run-length compressed Burrows-Wheeler transform of contents, with suffixes sampled at both ends of each run.

    Contents end in unequal terminators, the earlier the smaller. `before` and `after` hold the positions sampled at
    the first and the last suffix of every run, and their common prefix with the suffix next to them outside the run.
    """

    def __init__(self, contents: list[bytes]):
        self.data = np.frombuffer(b"".join(contents), np.uint8)
        self.at = np.concatenate([[0], np.cumsum([len(c) for c in contents])]).astype(np.int64)
        n = len(self.data)
        ends = np.repeat(self.at[1:], np.diff(self.at))
        levels = self._ranks(ends)
        order = np.argsort(levels[-1][1] * np.int64(n + 1) + np.arange(n), kind="stable")
        letter = np.full(n, -1, np.int32)
        letter[1:] = self.data[:-1]
        letter[self.at[:-1][np.diff(self.at) > 0]] = -1
        bwt = letter[order]
        edge = (bwt[1:] != bwt[:-1]) | (bwt[1:] < 0)
        heads = np.flatnonzero(np.concatenate([[True], edge]))
        tails = np.flatnonzero(np.concatenate([edge, [True]]))
        self.letters, self.lengths = bwt[heads], np.diff(np.concatenate([heads, [n]]))
        self.before = order[heads], self._common(order[heads], np.where(heads > 0, order[heads - 1], -1), levels, ends)
        self.after = order[tails], self._common(order[tails], np.where(tails < n - 1, order[np.minimum(tails + 1, n - 1)], -1), levels, ends)

    def _ranks(self, ends: np.ndarray) -> list[tuple[int, np.ndarray]]:
        """Ranks of all suffixes by their first 7, 14, 28, ... bytes; what ends sooner comes first."""
        n = len(self.data)
        left = ends - np.arange(n)
        key = np.zeros(n, U64)
        padded = np.concatenate([self.data, np.zeros(8, np.uint8)])
        for j in range(7):
            key = (key << U64(8)) | np.where(left > j, padded[j : j + n], 0).astype(U64)
        key = (key << U64(8)) | np.minimum(left, 7).astype(U64)
        rank = np.unique(key, return_inverse=True)[1].astype(np.int64)
        levels, h, most = [(7, rank)], 7, int(left.max()) if n else 0
        while h < most:
            nxt = np.zeros(n, np.int64)
            inside = np.flatnonzero(left > h)
            nxt[inside] = rank[inside + h] + 1
            rank = np.unique(rank * np.int64(n + 1) + nxt, return_inverse=True)[1].astype(np.int64)
            h *= 2
            levels.append((h, rank))
            if int(rank.max()) == n - 1:
                break
        return levels

    def _common(self, p: np.ndarray, q: np.ndarray, levels, ends: np.ndarray) -> np.ndarray:
        """Common prefix of the suffixes at p and q, within their contents; 0 where q is -1."""
        n = len(self.data)
        safe = np.maximum(q, 0)
        most = np.where(q < 0, 0, np.minimum(ends[p] - p, ends[safe] - safe))
        out = np.zeros(len(p), np.int64)
        for h, rank in reversed(levels):
            for _ in range(2 if h == levels[-1][0] else 1):
                a, b = np.minimum(p + out, n - 1), np.minimum(safe + out, n - 1)
                out += h * ((out + h <= most) & (rank[a] == rank[b]))
        open_ = np.ones(len(p), bool)
        for _ in range(7):
            a, b = np.minimum(p + out, n - 1), np.minimum(safe + out, n - 1)
            open_ &= (out < most) & (self.data[a] == self.data[b])
            out += open_
        return out

    def matching_statistics(self) -> np.ndarray:
        """At each position, the longest prefix of its suffix that also starts at another position."""
        n = len(self.data)
        best = np.zeros(n, np.int64)
        for places, common in (self.before, self.after):
            upto, sampled = np.zeros(n, np.int64), np.zeros(n, np.int64)
            upto[places] = places
            sampled[places] = common
            last = np.maximum.accumulate(upto)
            best = np.maximum(best, sampled[last] - (np.arange(n) - last))
        return best


def repeated_windows(contents: list[bytes], counts: list[int], span: int = SPAN) -> list[list[tuple[int, int]]]:
    """For each content, the runs (first, number) of windows that occur elsewhere too; a content counted twice repeats whole."""
    index = RunIndex(contents)
    hit = index.matching_statistics() >= span
    out = []
    for c, count, a, b in zip(contents, counts, index.at[:-1], index.at[1:], strict=True):
        if count > 1:
            out.append([(0, len(c) - span + 1)])
            continue
        x = np.concatenate([[False], hit[a : b - span + 1], [False]])
        flips = np.flatnonzero(x[1:] != x[:-1])
        out.append(list(zip(flips[::2].tolist(), (flips[1::2] - flips[::2]).tolist(), strict=True)))
    return out


def indexed(batches: Iterator[pa.RecordBatch], span: int, size: int = BATCH) -> Iterator[pa.RecordBatch]:
    """Marks of contents, which come sorted by hash; a hash's contents all go to one index."""
    key, rows, held = None, [], 0

    def marks():
        out = {"hash": [], "digest": [], "more": [], "first": [], "number": []}
        for (h, d, e, _, _), found in zip(rows, repeated_windows([r[3] for r in rows], [r[4] for r in rows], span), strict=True):
            for first, number in found:
                for name, v in zip(out, (h, d, e, first, number), strict=True):
                    out[name].append(v)
        return pa.RecordBatch.from_pydict(out, schema=pa.schema([("hash", pa.int64()), ("digest", pa.int64()), ("more", pa.int64()), ("first", pa.int32()), ("number", pa.int32())]))

    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("hash", "digest", "more", "content", "n")), strict=True):
            if row[0] != key and held >= size:
                yield marks()
                rows, held = [], 0
            key = row[0]
            rows.append(row)
            held += len(row[3])
    if rows:
        yield marks()


def window_digests(batches: Iterator[pa.RecordBatch], span: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for *key, content, n in zip(*(batch.column(c).to_pylist() for c in ("hash", "digest", "more", "content", "n")), strict=True):
            first = np.arange(len(content) - span + 1)
            own = digests(np.frombuffer(content, np.uint8), first, first + span)
            same = [pa.array(np.full(len(first), k)) for k in key]
            yield pa.RecordBatch.from_arrays([*same, pa.array(first.astype(np.int32)), pa.array(own[:, 0]), pa.array(own[:, 1]), pa.array(np.full(len(first), n))], ["hash", "digest", "more", "first", "a", "b", "n"])


def slices(batches: Iterator[pa.RecordBatch], span: int) -> Iterator[pa.RecordBatch]:
    """The contents of the runs that a text is asked for."""
    schema = pa.schema([("hash", pa.int64()), ("digest", pa.int64()), ("more", pa.int64()), ("content", pa.binary())])
    for batch in batches:
        data, at = flat(batch.column("text"))
        data = memoryview(np.ascontiguousarray(data))
        out: dict[str, list] = {c: [] for c in schema.names}
        for begin, asked in zip(at, batch.column("asked").to_pylist(), strict=False):
            for a in asked:
                for c in ("hash", "digest", "more"):
                    out[c].append(a[c])
                out["content"].append(bytes(data[begin + a["start"] : begin + a["start"] + a["windows"] + span - 1]))
        yield pa.RecordBatch.from_pydict(out, schema=schema)


def cut(batches: Iterator[pa.RecordBatch], span: int, extra: list[str], with_text: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, at = flat(batch.column("text"))
        data = memoryview(np.ascontiguousarray(data))
        sizes, removed, spans, digests, texts, gone = [], [], [], [], [], []
        for begin, end, marks in zip(at[:-1], at[1:], batch.column("marks").to_pylist(), strict=True):
            ranges: list[list[int]] = []
            for s, e in sorted((m["start"], m["start"] + m["windows"] + span - 1) for m in marks or ()):
                if ranges and s <= ranges[-1][1]:
                    ranges[-1][1] = max(ranges[-1][1], e)
                else:
                    ranges.append([s, e])
            at_, left = 0, []
            for s, e in ranges:
                left.append(data[begin + at_ : begin + s])
                at_ = e
            left.append(data[begin + at_ : end])
            whole = b"".join(left)
            sizes.append(int(end - begin))
            removed.append(int(end - begin) - len(whole))
            spans.append(len(ranges))
            digests.append(hashlib.sha256(whole).hexdigest())
            if with_text:
                texts.append(whole.decode("utf-8", "ignore"))
                gone.append([{"start": s, "end": e} for s, e in ranges])
        arrays = [*(batch.column(c) for c in extra), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digests)]
        names = [*extra, "n_bytes", "n_removed", "n_spans", "kept_sha256"]
        if with_text:
            arrays += [pa.array(texts), pa.array(gone, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]
            names += ["kept_text", "removed"]
        yield pa.RecordBatch.from_arrays(arrays, names)


def without_repeats(docs: DataFrame, with_text: bool = True, span: int = SPAN, gathered: int = GATHERED, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns to carry, n_bytes, n_removed, n_spans, kept_sha256 and, with_text, kept_text and the removed byte ranges.

    Texts are UTF-8 bytes, null counts as empty, and a text below `span` bytes stays whole. Two rows with the same text
    are copies of each other even where they share a doc_id; both lose all of it. kept_text leaves out characters that
    a cut splits; the digest is of the exact bytes. A null doc_id is allowed. Extra columns are left out; an empty table
    gives an empty result.
    """
    half = lambda i: F.conv(F.substring(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256), i, 16), 16, -10).cast("long")
    id_ = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)).cast("long"))
    keyed = docs.select("doc_id", *carry, "text", id_.alias("_id"), half(1).alias("_t1"), half(17).alias("_t2"))
    content = ["hash", "digest", "more"]
    found = stage(
        keyed.select(*ROW, "text").mapInArrow(scan, "_id long, _t1 long, _t2 long, hash long, digest long, more long, start int, windows int, inner boolean")
    )
    # Written first: a join whose sides both come straight from a shuffle is one that Spark splits where a hash is very frequent.
    least = [F.min(c).alias(f"lo_{c}") for c in content[1:]] + [F.max(c).alias(f"hi_{c}") for c in content[1:]]
    shared = stage(
        found.groupBy("hash")
        .agg(F.count(F.lit(1)).alias("n"), *least, F.max("inner").alias("in"))
        .where("n > 1 or in")
        .select("hash", F.expr("n > 1 and lo_digest = hi_digest and lo_more = hi_more").alias("whole"))
    )
    marked = stage(found.join(shared, "hash").select(*ROW, *content, "start", "windows", "whole"))
    whole = marked.where("whole").select(*ROW, "start", "windows")
    open_ = marked.where("not whole")
    # Each open content once: any run that has it can be asked for it.
    counted = open_.groupBy(*content).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*ROW, "start", "windows")).alias("one"))
    counted = stage(counted.select(*content, "n", "one.*"))
    asked = counted.groupBy(*ROW).agg(F.collect_list(F.struct(*content, "start", "windows")).alias("asked"))
    # Rows with equal id and text give the same contents again: the aggregate below keeps one.
    contents = keyed.select(*ROW, "text").join(asked, [*ROW])
    contents = contents.select("text", "asked").mapInArrow(lambda b: slices(b, span), "hash long, digest long, more long, content binary")
    contents = contents.groupBy(*content).agg(F.min("content").alias("content")).join(counted.select(*content, "n"), content)
    contents = stage(contents)
    sizes = contents.groupBy("hash").agg(F.sum(F.octet_length("content")).alias("size"))
    large = sizes.where(F.col("size") > gathered).select("hash")
    marks_of = "hash long, digest long, more long, first int, number int"
    if large.limit(1).count():
        by_hash = contents.join(large, "hash", "left_semi").mapInArrow(lambda b: window_digests(b, span), "hash long, digest long, more long, first int, a long, b long, n long")
        twice = by_hash.groupBy("hash", "a", "b").agg(F.sum("n").alias("m")).where("m > 1").select("hash", "a", "b")
        large_marks = by_hash.join(twice, ["hash", "a", "b"]).select(*content, "first", F.lit(1).alias("number"))
        contents = contents.join(large, "hash", "left_anti")
    else:
        large_marks = None
    marks = contents.repartition("hash").sortWithinPartitions("hash").mapInArrow(lambda b: indexed(b, span), marks_of)
    if large_marks is not None:
        marks = marks.unionByName(large_marks)
    parts = open_.join(marks, content).select(*ROW, (F.col("start") + F.col("first")).alias("start"), F.col("number").alias("windows"))
    by_text = whole.unionByName(parts).groupBy(*ROW).agg(F.collect_set(F.struct("start", "windows")).alias("marks"))
    kinds = dict(docs.dtypes)
    schema = "".join(f"`{c}` {kinds[c]}, " for c in ("doc_id", *carry)) + "n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    if with_text:
        schema += ", kept_text string, removed array<struct<start:long,end:long>>"
    joined = keyed.join(by_text, [*ROW], "left").select("doc_id", *carry, "text", "marks")
    return joined.mapInArrow(lambda b: cut(b, span, ["doc_id", *carry], with_text), schema)
