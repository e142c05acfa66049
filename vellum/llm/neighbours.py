"""Nearest neighbours by vantage-point trees, one tree for each shard of the vectors.

A node keeps a vantage point and the median distance to it of the vectors below: those within the median go to
the inner child, the others to the outer one. A search skips a child if, by the triangle inequality, nothing in it
can be nearer than the worst neighbour so far; with factor f it skips where the bound times f is beyond it. Factor 1 is
exact, larger factors skip more. A unit of work is the vectors of one shard, which become a tree where they are, and one
slab of queries, both of bounded size; a tree is searched for many queries at once.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.llm.common import stage

LEAF = 512
#: Vectors in a shard and queries in a slab, on average; hashed ids keep all near it. Shards of many vectors are larger, up to
#: MOST_SHARD, since each of them is sent all queries.
SHARD, MOST_SHARD, SHARDS, SLAB = 8_000, 128_000, 120, 65_536
#: Queries that go down a tree at once.
TOGETHER = 1_024


def distances(points: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Euclidean distances, squares summed in the order of the dimensions, as an accumulation does."""
    d = points - to
    np.multiply(d, d, out=d)
    return np.sqrt(np.add.accumulate(d, axis=1, out=d)[:, -1])


class VantageTree:
    """Nodes in arrays: children below 0 are leaves, ranges of the permuted vectors."""

    def __init__(self, ids: np.ndarray, points: np.ndarray, seed: int = 1):
        self.ids, self.points = ids, points
        self.vantage, self.median, self.inner, self.outer, self.leaves = [], [], [], [], []
        rng = np.random.default_rng(seed)
        self.root = self._build(np.arange(len(ids)), rng)

    def _build(self, rows: np.ndarray, rng) -> int:
        if len(rows) <= LEAF:
            self.leaves.append(rows)
            return -len(self.leaves)
        at = int(rng.integers(len(rows)))
        vantage, rest = rows[at], np.delete(rows, at)
        d = distances(self.points[rest], self.points[vantage])
        median = float(np.median(d))
        near = d <= median
        if near.all():  # many equal vectors: no cut parts them
            near = np.arange(len(rest)) < len(rest) // 2
        node = len(self.vantage)
        self.vantage.append(int(vantage))
        self.median.append((float(d[near].min(initial=np.inf)), float(d[near].max(initial=0)), float(d[~near].min(initial=np.inf)), float(d[~near].max(initial=0))))
        self.inner.append(0)
        self.outer.append(0)
        self.inner[node] = self._build(rest[near], rng)
        self.outer[node] = self._build(rest[~near], rng)
        return node

    def search(self, query: np.ndarray, k: int, skip: int | None, factor: float = 1.0) -> list[tuple[float, int]]:
        """The k nearest (distance, id), without the id `skip`; ties to the smaller id."""
        best: list[tuple[float, int]] = []  # a heap of (-distance, -id)

        def offer(d: np.ndarray, rows: np.ndarray) -> None:
            limit = -best[0][0] if len(best) == k else np.inf
            for i in np.flatnonzero(d <= limit):
                own = int(self.ids[rows[i]])
                if own == skip:
                    continue
                item = (-float(d[i]), -own)
                if len(best) < k:
                    heapq.heappush(best, item)
                elif item > best[0]:
                    heapq.heapreplace(best, item)

        stack = [(0.0, self.root)]
        while stack:
            bound, node = stack.pop()
            # A grain of slack for rounding: the bound is a difference of two rounded distances.
            if len(best) == k and bound * factor * (1 - 1e-9) - 1e-12 > -best[0][0]:
                continue
            if node < 0:
                rows = self.leaves[-node - 1]
                offer(distances(self.points[rows], query), rows)
                continue
            row = np.array([self.vantage[node]])
            d = distances(self.points[row], query)
            offer(d, row)
            d, (a, b, c, e) = float(d[0]), self.median[node]
            inner, outer = max(bound, a - d, d - b), max(bound, c - d, d - e)
            pair = [(inner, self.inner[node]), (outer, self.outer[node])]
            stack += sorted(pair, key=lambda x: -x[0])  # the nearer child is popped first
        return sorted((-d, -i) for d, i in best)

    def _bounds(self, node: int, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distances of queries to a node's vantage point, and what they are at least to what lies in its children."""
        d, (a, b, c, e) = distances(queries, self.points[self.vantage[node]]), self.median[node]
        return d, np.maximum(a - d, d - b), np.maximum(c - d, d - e)

    def search_all(self, queries: np.ndarray, skip: np.ndarray, k: int, factor: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
        """(distances, ids) of the k nearest of each query, as search() gives them; infinite distances where there are fewer.

        Each query first looks into the leaf that it would fall into. Then all of them go down the tree together.
        """
        n = len(queries)
        near, ids = np.full((n, k), np.inf), np.full((n, k), np.iinfo(np.int64).max)
        sizes, lengths = np.einsum("ij,ij->i", self.points, self.points), np.einsum("ij,ij->i", queries, queries)
        first = np.zeros(n, np.int64)

        def offer(who: np.ndarray, d: np.ndarray, rows: np.ndarray) -> None:
            fits = d <= near[who, k - 1]
            who, d, own = who[fits], d[fits], self.ids[rows[fits]]
            if not len(who):
                return
            asked = np.unique(who)
            at = np.concatenate([who, np.repeat(asked, k)])
            d, own = np.concatenate([d, near[asked].ravel()]), np.concatenate([own, ids[asked].ravel()])
            order = np.lexsort((own, d, at))
            begins = np.searchsorted(at[order], asked)
            best = order[begins[:, None] + np.arange(k)]
            near[asked], ids[asked] = d[best], own[best]

        def leaf(node: int, who: np.ndarray) -> None:
            rows = self.leaves[-node - 1]
            if not len(rows) or not len(who):
                return
            # Squares by way of a product find who may be near enough; distances are then taken as they are defined.
            with np.errstate(over="ignore", invalid="ignore"):
                rough = lengths[who, None] + sizes[rows] - 2 * (queries[who] @ self.points[rows].T)
                grain = 1e-9 * (lengths[who] + sizes[rows].max())
                rough[self.ids[rows] == skip[who, None]] = np.inf
                limit = near[who, k - 1] ** 2
                if len(rows) > k:
                    limit = np.minimum(limit, np.partition(rough, k - 1, axis=1)[:, k - 1])
                q, r = np.nonzero(~(rough > (limit + grain)[:, None]) & (self.ids[rows] != skip[who, None]))
            for part in range(0, len(q), 1 << 17):
                a, b = who[q[part : part + (1 << 17)]], rows[r[part : part + (1 << 17)]]
                offer(a, distances(self.points[b], queries[a]), b)

        stack = [(self.root, np.arange(n))]
        while stack:
            node, who = stack.pop()
            if node < 0:
                first[who] = node
                leaf(node, who)
            elif len(who):
                _, inner, outer = self._bounds(node, queries[who])
                stack += [(self.inner[node], who[inner <= outer]), (self.outer[node], who[inner > outer])]
        stack = [(self.root, np.arange(n), np.zeros(n))]
        while stack:
            node, who, bound = stack.pop()
            left = ~(bound * factor * (1 - 1e-9) - 1e-12 > near[who, k - 1])
            who, bound = who[left], bound[left]
            if node < 0:
                leaf(node, who[first[who] != node])
            elif len(who):
                d, inner, outer = self._bounds(node, queries[who])
                row = self.vantage[node]
                other = skip[who] != self.ids[row]
                offer(who[other], d[other], np.full(other.sum(), row))
                pair = [(self.inner[node], who, np.maximum(bound, inner)), (self.outer[node], who, np.maximum(bound, outer))]
                stack += sorted(pair, key=lambda x: -x[2].mean())
        return near, ids


FOUND = "asked long, query_id long, vec_id long, score double"


def searched(vectors: pa.Table, queries: pa.Table, k: int, factor: float) -> pa.Table:
    """The k nearest of each query among the vectors of one shard."""
    out: dict[str, list[np.ndarray]] = {"asked": [], "query_id": [], "vec_id": [], "score": []}
    if len(vectors) and len(queries):
        matrix = lambda t: np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in t.column("point").chunks]).astype(np.float64).reshape(len(t), -1)
        tree = VantageTree(vectors.column("vec_id").to_numpy(), matrix(vectors))
        points, own, asked = matrix(queries), queries.column("vec_id").to_numpy(), queries.column("asked").to_numpy()
        for at in range(0, len(points), TOGETHER):
            part = slice(at, at + TOGETHER)
            near, ids = tree.search_all(points[part], own[part], k, factor)
            who, place = np.nonzero(near < np.inf)
            for c, v in zip(out, (asked[part][who], own[part][who], ids[who, place], near[who, place]), strict=True):
                out[c].append(v)
    kinds = {"asked": pa.int64(), "query_id": pa.int64(), "vec_id": pa.int64(), "score": pa.float64()}
    return pa.table({c: pa.array(np.concatenate(v) if v else [], kinds[c]) for c, v in out.items()})


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, point: vectors that are not null, zero or empty and whose components are all finite numbers."""
    point = F.transform("embedding", lambda x: x.cast("double"))
    fine = F.forall("point", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (
        vectors.select(F.col("vec_id").cast("long").alias("vec_id"), point.alias("point"))
        .where(F.col("vec_id").isNotNull() & F.col("point").isNotNull() & fine & F.exists("point", lambda x: x != 0))
    )


def nearest(vectors: DataFrame, queries: Column, k: int = 10, factor: float = 1.0, shard: int | None = None, block: int = SLAB) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest other rows of each row of vectors(vec_id, embedding) that `queries` selects.

    score is the Euclidean distance in double precision; ties go to the smaller vec_id. Rows with a null vec_id, and
    vectors that are null, empty, zero or hold a null or non-finite component, take no part; vectors of another length
    than the query's are no candidates. Rows with the same vec_id are one candidate each, none of them the
    query's own; where several of them are queries, each gets a list of its own, ranks from 1. With fewer candidates than k, all are returned; an empty table gives an empty result.
    """
    points = usable(vectors)
    n, asking = points.agg(F.count(F.lit(1)), F.count(F.when(queries, 1))).first()
    shard = shard or min(MOST_SHARD, max(SHARD, n // SHARDS))
    shards, slabs = max(1, -(-n // shard)), max(1, -(-asking // block))
    points = points.withColumn("wide", F.size("point"))
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    # Vectors of one length and shard meet each slab of queries of that length.
    unit = ("wide", "shard", "slab")
    held = points.select("wide", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int").alias("shard"), every(slabs).alias("slab"), "vec_id", "point")
    asked = points.where(queries).withColumn("asked", F.monotonically_increasing_id())  # tells queries of one vec_id apart
    asked = stage(asked.select("wide", F.pmod(F.xxhash64(F.col("vec_id"), F.lit(9)), F.lit(slabs)).cast("int").alias("slab"), "asked", "vec_id", "point"))
    asked = asked.select("wide", every(shards).alias("shard"), "slab", "asked", "vec_id", "point")
    deal = lambda rows: rows.repartition(shards * slabs, *unit).groupBy(*unit)
    found = deal(held).cogroup(deal(asked)).applyInArrow(lambda v, q: searched(v, q, k, factor), FOUND)
    rank = F.row_number().over(Window.partitionBy("asked").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
