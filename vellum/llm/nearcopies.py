"""Near-duplicate detection with circulant MinHash, banding and exact Jaccard verification.

Signatures. Two permutations make all coordinates: the first spreads a shingle's hash over 32 bits, the second is
applied to that value shifted circularly by 0, 1, 2, ... and gives, by its minimum over the set, coordinate 0, 1, 2, ...

Links. Texts with the same set are one node. Nodes that share a band are joined through the band's smallest node, and
the connected groups of that graph are candidates; a group is cut into blocks of bounded size, and each pair of
blocks is one unit of work. Inside a unit a pivot is compared exactly with all others at once; members that already
hang together are not compared again, so a group of near copies takes few pivots, and members of different
components are all compared. The links found are at most the members of a unit: pairs within a group are never
listed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import MAX_BROADCAST_IDS, components, stage
from vellum.llm.texts import U64, lower_words, mix, word_hashes

#: Shingles in a block of a candidate group; a unit of work holds two blocks.
BLOCK = 500_000
_FIRST, _SECOND, _THIRD = U64(0x9E3779B97F4A7C15), np.uint32(0x85EBCA6B), np.uint32(0xC2B2AE35)


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; with fewer words, of the whole sequence; none without words."""
    n = len(hashes)
    if n == 0:
        return hashes
    k = min(k, n)
    acc = np.full(n - k + 1, k, U64)
    for j in range(k):
        acc = mix((acc + hashes[j : n - k + 1 + j]) * _FIRST)
    return np.unique(acc)


def signature(values: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    """Circulant MinHash: coordinate i is the least second permutation of (first permutation + i)."""
    first = (mix(values * _FIRST) >> U64(32)).astype(np.uint32)
    best = None
    for i in range(0, len(first), 1024):
        x = first[i : i + 1024, None] + shifts[None, :]
        x *= _SECOND
        x ^= x >> np.uint32(15)
        x *= _THIRD
        x ^= x >> np.uint32(13)
        low = x.min(axis=0)
        best = low if best is None else np.minimum(best, low)
    return best


def sketches(batches: Iterator[pa.RecordBatch], k: int, bands: int, rows: int) -> Iterator[pa.RecordBatch]:
    """doc_id, n, digest of the set and band keys of each text."""
    memo, shifts = word_hashes(), np.arange(bands * rows, dtype=np.uint32)
    weights = mix(np.arange(1, rows + 1, dtype=U64)) | U64(1)
    salt = mix(np.arange(1, bands + 1, dtype=U64) * U64(0x51ED2701))
    for batch in batches:
        n, digests, keys = [], [], []
        for text in batch.column("text").to_pylist():
            words = lower_words(text)
            values = shingles(np.fromiter(map(memo.__getitem__, words), U64, len(words)), k)
            n.append(len(values))
            if len(values):
                digests.append(hashlib.blake2b(values.tobytes(), digest_size=16).digest())
                signs = signature(values, shifts).reshape(bands, rows).astype(U64)
                keys.append(mix((signs * weights).sum(axis=1, dtype=U64) + salt).view(np.int64))
            else:
                digests.append(None)
                keys.append(np.zeros(0, np.int64))
        at = np.concatenate([[0], np.cumsum([len(x) for x in keys])]).astype(np.int32)
        flat = np.concatenate(keys) if keys else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.ListArray.from_arrays(pa.array(at), pa.array(flat))],
            ["doc_id", "n", "digest", "bands"],
        )


def full_sets(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """The whole shingle set of each candidate, once for every pair of blocks that it takes part in."""
    memo = word_hashes()
    for batch in batches:
        out = {"root": [], "i": [], "j": [], "rep": [], "values": []}
        size = 0
        for rep, root, blocks, text in zip(*(batch.column(c).to_pylist() for c in ("rep", "root", "blocks", "text")), strict=True):
            words = lower_words(text)
            values = shingles(np.fromiter(map(memo.__getitem__, words), U64, len(words)), k).tobytes()
            own = int(mix(np.array([rep], np.int64).view(U64))[0] % U64(blocks))
            for other in [own] if blocks == 1 else [b for b in range(blocks) if b != own]:
                for name, v in zip(out, (root, min(own, other), max(own, other), rep, values), strict=True):
                    out[name].append(v)
                size += len(values)
            if size > 4_000_000:
                yield _sets_batch(out)
                out, size = {c: [] for c in out}, 0
        yield _sets_batch(out)


def _sets_batch(out: dict) -> pa.RecordBatch:
    kinds = {"root": pa.int64(), "i": pa.int32(), "j": pa.int32(), "rep": pa.int64(), "values": pa.binary()}
    return pa.RecordBatch.from_pydict(out, schema=pa.schema(list(kinds.items())))


def links(reps: list[int], sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links that connect the same members as all pairs with 100 * intersection >= percent * union would."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    _, ids = np.unique(np.concatenate(sets), return_inverse=True)
    at = np.concatenate([[0], np.cumsum(sizes)])
    component, done, found = np.arange(n), np.zeros(n, bool), []
    seen = np.zeros(int(ids.max()) + 1, bool)
    pivot, counts = 0, np.ones(n, np.int64)
    while True:
        done[pivot] = True
        own = ids[at[pivot] : at[pivot + 1]]
        seen[own] = True
        both = np.add.reduceat(seen[ids], at[:-1], dtype=np.int64)
        seen[own] = False
        near = np.flatnonzero(100 * both >= percent * (sizes + sizes[pivot] - both))
        for other in np.unique(component[near], return_index=True)[1]:
            other = int(near[other])
            a, b = component[pivot], component[other]
            if a != b:
                found.append((reps[pivot], reps[other]))
                small, large = (a, b) if counts[a] < counts[b] else (b, a)
                component[component == small] = large
                counts[large] += counts[small]
                counts[small] = 0
        # Pairs of different components are all compared once the pivots include everything outside the largest.
        rest = np.flatnonzero(~done & (component != int(np.argmax(counts))))
        if not len(rest):
            return found
        pivot = int(rest[0])


def linked(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Links of each unit (root, i, j); rows come sorted by unit."""
    key, reps, sets = None, [], []
    edges: list[tuple[int, int]] = []

    def flush():
        if len(reps) > 1:
            edges.extend(links(reps, sets, percent))

    for batch in batches:
        for root, i, j, rep, values in zip(*(batch.column(c).to_pylist() for c in ("root", "i", "j", "rep", "values")), strict=True):
            if (root, i, j) != key:
                flush()
                key, reps, sets = (root, i, j), [], []
            reps.append(rep)
            sets.append(np.frombuffer(values, U64))
        if len(edges) > 50_000:
            yield _edges_batch(edges)
            edges.clear()
    flush()
    yield _edges_batch(edges)


def _edges_batch(edges: list[tuple[int, int]]) -> pa.RecordBatch:
    a = np.array(edges, np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(a[:, 0]), pa.array(a[:, 1])], ["a", "b"])


def near_copies(docs: DataFrame, k: int = 5, percent: int = 80, bands: int = 36, rows: int = 5, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of each row of docs(doc_id, text).

    Texts are linked where 100 * intersection >= percent * union of their sets of k-word shingles; a component's id is
    the smallest doc_id in it, and that document is kept. A pair at exactly percent shares no band with probability
    (1 - (percent/100)**rows)**bands, below one in a million by default. Null, empty and wordless texts have
    no shingles, link with nothing and are kept. Rows with a null doc_id link with nothing either. Rows that share a
    doc_id are one document for the links. Extra columns are left out; an empty table gives an empty result.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    made = stage(
        docs.mapInArrow(lambda b: sketches(b, k, bands, rows), "doc_id long, n long, digest binary, bands array<long>")
    )
    # Written first: a join whose sides both come straight from a shuffle is one that Spark splits where a set is very frequent.
    reps = stage(made.where("digest is not null and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("rep")))
    own = F.when(F.col("doc_id").isNotNull(), F.col("rep")).alias("rep")
    nodes = stage(made.join(reps, "digest", "left").select("doc_id", "n", own, F.when(F.col("doc_id") == F.col("rep"), F.col("bands")).alias("bands")))
    band = nodes.where("bands is not null").select("rep", F.explode("bands").alias("key"))
    shared = stage(band.groupBy("key").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).where("a <> z").select("key", "a"))
    groups = components(band.join(shared, "key").where("rep <> a").select(F.col("rep").alias("a"), F.col("a").alias("b")).distinct())
    sized = groups.withColumnRenamed("node", "rep").join(
        nodes.where("bands is not null").groupBy("rep").agg(F.max("n").alias("n")), "rep"
    )
    blocks = sized.groupBy("root").agg(F.ceil(F.sum("n") / block).cast("int").alias("blocks"))
    wanted = stage(sized.join(blocks, "root").select("rep", "root", "blocks"))
    few = wanted.limit(MAX_BROADCAST_IDS + 1).count() <= MAX_BROADCAST_IDS
    units = docs.join(F.broadcast(wanted) if few else wanted, F.col("doc_id") == F.col("rep")).select("rep", "root", "blocks", "text")
    units = units.mapInArrow(lambda b: full_sets(b, k), "root long, i int, j int, rep long, values binary")
    edges = units.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j", "rep").mapInArrow(lambda b: linked(b, percent), "a long, b long")
    # Rows that share a doc_id are one document: what its texts are linked with hangs together.
    with_id = nodes.where("doc_id is not null and rep is not null")
    several = with_id.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).where("a <> z").select("doc_id", "a")
    edges = edges.unionByName(with_id.join(several, "doc_id").select("a", F.col("rep").alias("b")).where("a <> b").distinct())
    roots = components(edges)
    return nodes.join(roots, nodes.rep == roots.node, "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.coalesce("root", "rep", "doc_id").alias("component_id"),
        (F.coalesce("root", "rep", "doc_id").eqNullSafe(F.col("doc_id"))).alias("kept"),
    )


def without_near_copies(docs: DataFrame, **options) -> DataFrame:
    """docs with all its columns, of each component of near copies only the row that is kept.

    Rows with a null doc_id stay. Of rows that share a doc_id and a text, one stays.
    """
    gone = stage(near_copies(docs, **options).where("not kept").select(F.col("doc_id").alias("_gone")).distinct())
    few = gone.limit(MAX_BROADCAST_IDS + 1).count() <= MAX_BROADCAST_IDS
    left = docs.join(F.broadcast(gone) if few else gone, F.col("doc_id").cast("long") == F.col("_gone"), "left_anti")
    again = docs.where("doc_id is not null").groupBy(F.col("doc_id").alias("_again")).count().where("count > 1").select("_again")
    again = stage(again)
    if not again.limit(1).count():
        return left
    match = left["doc_id"] == again["_again"]
    return left.join(again, match, "left_anti").unionByName(left.join(again, match, "left_semi").dropDuplicates(["doc_id", "text"]))
