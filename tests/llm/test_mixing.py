import numpy as np
import pytest
from helpers import awkward, frame

from vellum.llm import mixing


def goals(spark, sizes, weights=mixing.WEIGHTS):
    rows = spark.createDataFrame([(f"s{i}", n) for i, n in enumerate(sizes)], "source string, source_size long")
    return [r.target for r in mixing.source_targets(rows, weights).orderBy("source").collect()]


def test_targets(spark):
    assert goals(spark, [100, 100, 100]) == pytest.approx([187.5, 75, 37.5])
    assert goals(spark, [10, 1000, 1000])[0] == 30 and sum(goals(spark, [10, 1000, 1000])) == pytest.approx(2010)
    assert goals(spark, [0, 5]) == [0, 5] and goals(spark, []) == []


def test_leaves_split_quotas_exactly():
    counts = np.array([70, 1, 0, 29])
    for shards in (1, 2, 3, 8, 200):
        parts = [mixing.leaf(counts, shards, k, 1) for k in range(shards)]
        quotas = np.array([n for _, n in parts])
        assert (quotas.sum(axis=0) == counts).all() and (quotas >= 0).all() and np.ptp(quotas.sum(axis=1)) <= np.ceil(np.log2(max(shards, 2)))
        assert (np.array([f for f, _ in parts]) == np.cumsum(quotas, axis=0) - quotas).all()


def test_draws_are_disjoint_blocks_and_follow_the_tree(spark):
    rows = [(s, 10, int(h)) for s in ("a", "b", None) for h in np.random.default_rng(2).integers(0, 2**60, 300)]
    small = spark.createDataFrame(rows, "source string, _mix_size long, _mix_hash long")
    sources, draws = mixing.plan(small, shards=5, least=20)
    got = draws.collect()
    assert len(got) == len({(r.at, r.block, r["pass"]) for r in got}) and {r.shard for r in got} == set(range(5))
    counts = np.array([sum(r.at == i for r in got) for i in range(3)])
    for k in range(5):
        assert [sum(r.at == i and r.shard == k for r in got) for i in range(3)] == mixing.leaf(counts, 5, k, 7)[1].tolist()
    assert [(r.source, r.n_blocks) for r in sources.orderBy("at").collect()] == [("a", 20), ("b", 20), (None, 20)]


def test_blocks_grow_with_the_source(spark):
    small = spark.createDataFrame([("a", 1000, i * 7919) for i in range(2000)], "source string, _mix_size long, _mix_hash long")
    assert mixing.plan(small, block_words=5_000)[0].first().n_blocks == 400


def test_sizes_and_targets_are_those_of_sql(spark, duck):
    from support import SMALL

    got = mixing.taken(spark.read.parquet(f"{SMALL}/documents.parquet")).toPandas()
    sql = r"""WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
        s AS (SELECT source, sum(size) AS source_size, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w FROM d GROUP BY 1)
        SELECT doc_id, size, source_size, w, sum(source_size) OVER () AS dummy FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source"""
    exp = duck.execute(sql).df().sort_values("doc_id")
    got = got.sort_values("doc_id")
    assert got["size"].tolist() == exp["size"].tolist() and got["source_size"].tolist() == exp["source_size"].tolist()
    per = exp.assign(key=got["source"].fillna("~").to_numpy()).drop_duplicates("key")
    left, open_, goal = float(per["source_size"].sum()), set(per["key"]), {}
    while open_:  # the same sharing, one source after the other
        own = per[per["key"].isin(open_)]
        full = [r for r in own.itertuples() if left * r.w / own["w"].sum() > 3 * r.source_size]
        for r in full or own.itertuples():
            goal[r.key] = 3.0 * r.source_size if full else left * r.w / own["w"].sum()
        if not full:
            break
        left -= sum(goal[r.key] for r in full)
        open_ -= {r.key for r in full}
    assert got["target"].tolist() == pytest.approx([goal[k] for k in got["source"].fillna("~")])
    near = got.groupby(got["source"].fillna("~")).agg(t=("taken", "sum"), g=("target", "first"), most=("size", "max"))
    assert ((near["t"] - near["g"]).abs() <= near["most"] / 2 + 1).all()


def test_taken_words(spark):
    rows = awkward()
    got = mixing.taken(frame(spark)).collect()
    assert len(got) == len(rows)
    assert sorted(r.size for r in got) == sorted(len((r[1] or "").encode().split()) for r in rows)
    assert all(0 <= r.taken <= 3 * r["size"] for r in got)
    longest = max(r["size"] for r in got)
    for s in {r.source for r in got}:
        own = [r for r in got if r.source == s]
        assert abs(sum(r.taken for r in own) - own[0].target) <= longest / 2 + 1 and own[0].source_size == sum(r["size"] for r in own)
    again = mixing.taken(frame(spark).repartition(7)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_mix_has_each_row_as_often_as_taken(spark):
    docs = frame(spark)
    mixed = mixing.mixed(docs, shards=3)
    assert mixed.columns == docs.columns
    words = sum(len((r.text or "").encode().split()) for r in mixed.collect())
    got = mixing.taken(docs, shards=3).collect()
    assert words == sum(r.taken for r in got) and all(len(r.shards) * r["size"] == r.taken for r in got)


def test_empty_table(spark):
    assert mixing.taken(frame(spark, [])).count() == 0 and mixing.mixed(frame(spark, [])).count() == 0
