import hashlib
import math
from fractions import Fraction

import numpy as np
import pytest
from support import SMALL, same_rows

from vellum.llm import codes, queries
from vellum.llm.common import ship

SCHEMA = "vec_id long, embedding array<double>, label int, error string, code int, point int, part int, n int"


def brute(rows, parts=4, entries=256, rounds=4):
    """(vec_id, code, error, label_error, digest) in plain whole numbers."""
    kept = [(i, v, label) for i, v, label, *_ in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = -(-max((len(v) for _, v, _ in kept), default=0) // parts)
    ints = [(i, [math.floor(Fraction(x) * 1024) for x in v] + [0] * (parts * width - len(v)), label) for i, v, label in kept]
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for _, v, _ in ints]
    start = sorted(range(len(ints)), key=lambda r: (ints[r][0] is None, ints[r][0] or 0, kept[r][1]))[:entries]
    books = [[list(cut[r][p]) for r in start] for p in range(parts)]

    def near(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            of = {}
            for c in cut:
                of.setdefault(near(c[p], books[p])[1], []).append(c[p])
            for k, members in of.items():
                books[p][k] = [sum(column) // len(members) for column in zip(*members, strict=True)]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    got = [(i, [near(c[p], books[p]) for p in range(parts)], label) for (i, _, label), c in zip(ints, cut, strict=True)]
    total = {}
    for _, n, label in got:
        total[label] = total.get(label, 0) + sum(d for d, _ in n)
    return [(i, bytes(k for _, k in n).hex(), sum(d for d, _ in n), total[label], digest) for i, n, label in got]


def answers(df):
    return sorted(((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in df.collect()), key=repr)


def frame(spark, rows):
    ship(spark)
    return spark.createDataFrame([(i, v, label, "x", 1, 2, 3, 4) for i, v, label in rows], SCHEMA)


def test_transform_keeps_scaled_distances():
    rng = np.random.default_rng(1)
    for width in (0, 1, 3, 8, 13):
        a, b = rng.integers(-999, 999, (2, 5, width))
        size = codes.transformed(a).shape[1]
        assert (((codes.transformed(a) - codes.transformed(b)) ** 2).sum(axis=1) == size * ((a - b) ** 2).sum(axis=1)).all()
    h = codes.walsh(np.eye(16, dtype=np.int64))[:, codes.sequency(16)]
    assert [(np.diff(c) != 0).sum() for c in h.T] == list(range(16))


@pytest.mark.parametrize("kind", [np.int64, object])
def test_nearest_equals_brute_force(kind):
    rng = np.random.default_rng(2)
    points, entries = rng.integers(-6, 6, (700, 5)).astype(kind), rng.integers(-6, 6, (90, 5)).astype(kind)  # many ties
    index, scaled = codes.nearest(codes.transformed(points), codes.transformed(entries))
    d = ((points[:, None].astype(np.int64) - entries[None].astype(np.int64)) ** 2).sum(axis=2)
    assert index.tolist() == d.argmin(axis=1).tolist()
    assert [int(x) for x in scaled] == (8 * d.min(axis=1)).tolist()


def test_codes_equal_brute_force_on_awkward_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=11).round(2)], [None, 1, 2, 2][i % 4]) for i in range(350)]
    rows += [(400 + i, [0.25] * 11, 1) for i in range(40)] + [(7, rows[7][1], 3), (8, [0.5] * 11, None), (None, [1.0] * 11, 2)]
    rows += [(501, None, 1), (502, [1.0, None], 1), (503, [float("nan")] * 11, 1), (504, [float("-inf")] * 11, None), (505, [], 2), (506, [1.5, -2.0], 2), (507, [0.0] * 11, 2), (508, [-0.0001] * 11, 9)]
    assert answers(codes.compress(frame(spark, rows).repartition(5))) == sorted(brute(rows), key=repr)


def test_few_rows_large_numbers_and_none(spark):
    rows = [(i, [i * 1.5, -1e30, 1e300 if i == 2 else 3.0, 4.0], 1) for i in range(5)] + [(9, [float(2**60), 1.0, 1.0, 1.0], 2)]
    expected = [(i, c, e if e < 2**63 else None, t if t < 2**63 else None, h) for i, c, e, t, h in brute(rows, rounds=1)]
    assert answers(codes.compress(frame(spark, rows), rounds=1)) == sorted(expected, key=repr)
    rows = [(i % 50, [float(i % 9) * 1e200, 1e100 * (i % 4), 0.0, float(i)], i % 3) for i in range(400)]
    expected = [(i, c, e if e < 2**63 else None, t if t < 2**63 else None, h) for i, c, e, t, h in brute(rows, entries=8)]
    assert answers(codes.compress(frame(spark, rows), entries=8)) == sorted(expected, key=repr)
    empty = codes.compress(frame(spark, []))
    assert empty.count() == 0
    assert codes.compress(frame(spark, [(1, None, 1)])).columns == ["vec_id", "label", "code", "error", "label_error", "codebooks_sha256"] == empty.columns
    assert [r.code for r in codes.compress(frame(spark, [(1, [], 1)])).collect()] == ["00000000"]


def test_query_equals_sql(spark, duck):
    same_rows(queries.QUERIES["op11_vector_codes"](spark, SMALL).toPandas(), duck.execute(queries.ORACLES["op11_vector_codes"]).df())
