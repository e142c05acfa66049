import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from helpers import awkward, frame, prose
from pyspark.sql import functions as F
from support import SMALL, same_rows

from vellum.llm import queries, resample
from vellum.llm.common import ship


def features(text):
    w = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").encode().lower())
    return len(w), [zlib.crc32(x) % 10000 for x in w] + [zlib.crc32(a + b" " + b) % 10000 for a, b in zip(w, w[1:], strict=False)]


def brute(docs, target):
    """(doc_id, n_features, weight, score, rank) of each document."""
    held = [(d, *features(t)) for d, t in docs]
    s, t = Counter(x for _, _, f in held for x in f), Counter(x for _, text in target for x in features(text)[1])
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + 10000) / ((s[b] + 1) * (t.total() + 10000))))
    rows = []
    for d, n, f in held:
        weight = sum(map(gain, f)) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        rows.append((d, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((i for i, r in enumerate(rows) if r[1] >= 20), key=lambda i: (-rows[i][4], rows[i][0] is None, rows[i][0] or 0, -rows[i][3], rows[i][2]))
    rank = {i: k + 1 for k, i in enumerate(able[: 25 * len(able) // 100])}
    return sorted(((d, n, w, s, rank.get(i)) for i, (d, _, n, w, s) in enumerate(rows)), key=repr)


def answers(df):
    return sorted(((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in df.collect()), key=repr)


def documents():
    rows = awkward() + [(500 + i % 7, "same text again " * 10, "en", "a") for i in range(40)] + [(None, "without an id " * 9, "en", "a")] * 30
    return rows + [(600, "x" * 70 + " y " + "z" * 64 + " " + "q" * 63 + " " + "p" * 500, "en", "a")]


@pytest.mark.parametrize("last", [resample.LAST, 3])
def test_equals_brute_force_on_awkward_rows(spark, last):
    docs, target = documents(), [(1, "w1 w2 w3 the same"), (2, None), (3, ""), (4, "text again w7 w8"), (4, "text again w7 w8")]
    bench = spark.createDataFrame([(i, t, 1) for i, t in target], "item_id long, text string, bucket int")
    got = answers(resample.resample(frame(spark, docs).repartition(6), bench, last=last))
    assert got == brute([r[:2] for r in docs], target)


def test_buckets_of_long_texts_in_pieces(monkeypatch):
    monkeypatch.setattr(resample, "PIECE", 500)
    rng = __import__("random").Random(3)
    texts = [prose(rng, 900), None, "", "  ", prose(rng, 20) + " " * 2000 + prose(rng, 20), "w" * 3000 + " a", *[prose(rng, 5) for _ in range(60)]]
    got = [[] for _ in texts]
    for a, words, b, pairs in resample.Features()(pa.array(texts)):
        for text, bucket in [*zip(a.tolist(), words.tolist(), strict=True), *zip(b.tolist(), pairs.tolist(), strict=True)]:
            got[text].append(bucket)
    assert [sorted(g) for g in got] == [sorted(features(t)[1]) for t in texts]


def test_cutoff_is_the_key_at_its_place_in_any_partitioning(spark):
    ship(spark)
    rng = np.random.default_rng(4)
    rows = [(int(s), i % 2, i // 5, 0, 1, i) for i, s in enumerate(rng.integers(-40, 40, 3000))]
    keys = spark.createDataFrame(rows, ", ".join(f"{k} long" for k in resample.KEYS)).repartitionByRange(7, "k0").cache()  # partitions unlike each other
    for place in (1, 2, 700, 2999, 3000):
        assert resample.cutoff(keys, place, last=8) == sorted(rows)[place - 1]
    assert resample.cutoff(keys, 0) is None and resample.cutoff(keys, 3001) is None and resample.cutoff(keys.limit(0), 1) is None


def test_ranks_go_on_from_range_to_range(spark):
    ship(spark)
    rows = spark.range(5000).select((F.col("id") * 7919 % 5003).alias("v"))
    got = [(r["rank"], r.v) for r in resample.ranked(rows.repartition(5), [F.col("v")]).orderBy("rank").collect()]
    assert got == list(enumerate(sorted(i * 7919 % 5003 for i in range(5000)), 1))


def test_empty_tables(spark):
    ship(spark)
    none, docs = spark.createDataFrame([], "item_id long, text string"), [(i, "a b " * 12) for i in range(9)] + [(9, "short")]
    assert answers(resample.resample(spark.createDataFrame(docs, "doc_id long, text string"), none)) == brute(docs, [])
    assert resample.resample(spark.createDataFrame([], "doc_id long, text string"), none).count() == 0


def test_query_equals_sql(spark, duck):
    same_rows(queries.QUERIES["op13_target_resampling"](spark, SMALL).toPandas().astype({"rank": "Int64"}), duck.execute(queries.ORACLES["op13_target_resampling"]).df())
