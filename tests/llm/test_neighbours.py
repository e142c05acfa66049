import numpy as np
import pytest
from pyspark.sql import functions as F

from vellum.llm import neighbours
from vellum.llm.common import ship

SCHEMA = "vec_id long, embedding array<float>, label int, score double"


def vectors(n=700, seed=1):
    rng = np.random.default_rng(seed)
    rows = [(i, [float(x) for x in rng.normal(size=6).round(1)], 0, 1.0) for i in range(n)]
    rows += [(i, [1.0] * 6, 0, 1.0) for i in range(n, n + 30)]  # ties
    odd = [(5000, None), (5100, [0.0] * 6), (5200, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (5300, [float("nan")] * 6), (5400, [float("inf")] * 6), (5500, []), (5600, [1.0, 2.0])]
    return rows + [(i, v, 0, 1.0) for i, v in odd] + [(None, [1.0] * 6, 0, 1.0)]


def brute(rows, k):
    good = [(i, np.array(v, np.float32).astype(float)) for i, v, *_ in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    out = {}
    for q, p in good:
        if q % 100 == 0:
            out[q] = sorted((float(neighbours.distances(x[None, :], p)[0]), i) for i, x in good if i != q and len(x) == len(p))[:k]
    return out


@pytest.mark.parametrize(("shard", "block"), [(8000, 512), (50, 2)])
def test_factor_one_is_exact(spark, shard, block):
    ship(spark)
    rows = vectors()
    got = {}
    for r in neighbours.nearest(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 100 == 0, shard=shard, block=block).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.score, r.vec_id))
        assert r["rank"] == len(got[r.query_id])
    assert got == {q: v for q, v in brute(rows, 10).items() if v}


def test_pruning_skips_more_with_a_larger_factor_and_keeps_recall():
    rng = np.random.default_rng(2)
    points = rng.normal(size=(4000, 4))
    tree = neighbours.VantageTree(np.arange(4000), points)
    hits = 0
    for q in range(0, 4000, 200):
        exact = {i for _, i in tree.search(points[q], 10, q)}
        assert exact == {i for _, i in sorted((float(d), i) for i, d in enumerate(neighbours.distances(points, points[q])) if i != q)[:10]}
        hits += len(exact & {i for _, i in tree.search(points[q], 10, q, factor=1.5)})
    assert hits >= 0.9 * 200


def test_empty_table_and_few_candidates(spark):
    ship(spark)
    assert neighbours.nearest(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 100 == 0).count() == 0
    two = spark.createDataFrame([(0, [1.0, 0.0], 0, 1.0), (1, [0.0, 1.0], 0, 1.0)], SCHEMA)
    assert [(r.query_id, r["rank"], r.vec_id) for r in neighbours.nearest(two, F.col("vec_id") % 100 == 0).collect()] == [(0, 1, 1)]


def test_queries_of_one_id_have_lists_of_their_own(spark):
    ship(spark)
    rows = [(100, [float(x), 0.0], 0, 1.0) for x in (5, 50, 5)] + [(i, [float(i), 1.0], 0, 1.0) for i in range(1, 60)]
    got = neighbours.nearest(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 100 == 0, k=5).collect()
    lists = [sorted((round(float(np.hypot(i - x, 1)), 9), i) for i in range(1, 60))[:5] for x in (5, 50, 5)]
    assert sorted((r["rank"], round(r.score, 9), r.vec_id) for r in got) == sorted((k + 1, *pair) for one in lists for k, pair in enumerate(one))


def test_many_queries_at_once_give_what_each_gives_alone():
    rng = np.random.default_rng(5)
    points = np.repeat(rng.normal(size=(1500, 8)), 2, axis=0)  # every vector twice, so that ids decide
    ids = np.concatenate([np.arange(2900), np.full(100, 7)])
    tree = neighbours.VantageTree(ids, points)
    near, found = tree.search_all(points[:300], ids[:300], 10)
    for q in range(300):
        assert list(zip(near[q].tolist(), found[q].tolist(), strict=True)) == tree.search(points[q], 10, int(ids[q]))


def test_no_query_or_vector_is_broadcast(spark):
    ship(spark)
    rows = spark.range(3000).select(F.col("id").alias("vec_id"), F.array(F.rand(1), F.rand(2)).alias("embedding"))
    found = neighbours.nearest(rows, F.col("vec_id") % 100 == 0, shard=100, block=10)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString() and found.count() == 300
