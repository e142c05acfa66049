import re

import numpy as np
import pytest
from helpers import awkward, frame, prose
from support import SMALL, same_rows

from vellum.llm import leaks, queries
from vellum.llm.common import ship

ITEMS = "item_id long, text string, n_words int, spans int"


def words(text):
    return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").encode().lower())


def brute(docs, bench, window=10):
    """(doc_id, n_words, numbers of hit words, items) by trying every place."""
    grams = {}
    for item, text in bench:
        w = words(text)
        k = min(window, len(w))
        for i in range(len(w) - k + 1 if w else 0):
            grams.setdefault(tuple(w[i : i + k]), set()).add("" if item is None else str(item))
    sizes = {len(g) for g in grams}
    out = []
    for doc_id, text in docs:
        w, hit, items = words(text), set(), set()
        for k in sizes:
            for i in range(len(w) - k + 1):
                if found := grams.get(tuple(w[i : i + k])):
                    hit |= set(range(i, i + k))
                    items |= found
        out.append((doc_id, len(w), sorted(hit), sorted(items)))
    return out


def answers(df):
    rows = df.collect()
    assert all(r.n_hit == sum(s["end"] - s["first"] for s in r.spans) and r.contaminated == (r.n_hit > 0) for r in rows)
    assert all(a["end"] < b["first"] for r in rows for a, b in zip(r.spans, r.spans[1:], strict=False))
    return sorted(((r.doc_id, r.n_words, [i for s in r.spans for i in range(s["first"], s["end"])], r["items"]) for r in rows), key=repr)


def bench_rows():
    rng = np.random.default_rng(4)
    texts = [t for _, t, *_ in awkward()]
    long = texts[12].split()
    rows = [(1, " ".join(long[100:125])), (2, "Prefix, " + "; ".join(long[3000:3012]) + "!"), (3, texts[0]), (4, "one TWO"), (5, "one"), (6, None), (7, ""), (8, "-- ** --"), (None, "ünï"), (3, "w1 w2 w3")]
    rows += [(9, "The " * 12), (10, "The " * 9), (11, "x y"), (1, " ".join(long[100:125])), (12, "a b c d e f g h i j k l"), (13, "é" * 150), (14, "12 34")]
    return rows + [(100 + i, " ".join(long[j : j + 11])) for i, j in enumerate(rng.integers(0, 5900, 30).tolist())]


def documents():
    rows = awkward() + [(900, "a b c d e f g h i j k l m", "en", "a"), (901, "xa b c d e f g h i j", "en", "a"), (902, "b c d e f g h i j k", "en", "a"), (903, "w1\tw2\nw3 w1-w2-w3", "en", "a"), (904, "THE", None, None)]
    return rows + [(905, "ONE\x00two one,two", "en", "a"), (906, "onetwo", "en", "a"), (907, "12345 12 34", "en", "a"), (908, "q" * 300_000 + " one two " + "z" * 300_000, "en", "a")]


@pytest.mark.parametrize("group_bytes", [leaks.GROUP_BYTES, 600])
def test_equals_brute_force_on_awkward_rows(spark, group_bytes):
    docs = frame(spark, documents())
    bench = spark.createDataFrame([(i, t, 1, 2) for i, t in bench_rows()], ITEMS)
    assert answers(leaks.contamination(docs.repartition(3), bench, group_bytes=group_bytes)) == sorted(brute([r[:2] for r in documents()], bench_rows()), key=repr)


def test_search_equals_brute_force_at_every_length():
    rng = np.random.default_rng(5)
    letters = [bytes(rng.integers(97, 99, n).tolist()) for n in (1, 1, 2, 3, 5, 9, 30)]
    for trial in range(30):
        pieces = [b" ".join(rng.choice(letters, rng.integers(1, 14)).tolist()) for _ in range(rng.integers(1, 40))]
        text = b" ".join(rng.choice(letters, 900).tolist())
        windows = leaks.Windows(pieces, [str(i) for i in range(len(pieces))], window=4)
        data = leaks.Words(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
        place, which = windows.find(data.bytes)
        got = sorted((int(p), bytes(windows.bytes[windows.at[w] : windows.at[w] + windows.size[w]])) for p, w in zip(place, which, strict=True))
        grams = {b" " + b" ".join(w[i : i + min(4, len(w))]) + b" " for w in (p.split() for p in pieces) for i in range(max(1, len(w) - 3))}
        whole = b" " + text + b" "
        assert got == sorted((m.start(), g) for g in grams for m in re.finditer(b"(?=" + g + b")", whole)), trial


def test_long_items_are_cut_without_losing_windows(spark):
    ship(spark)
    rng = __import__("random").Random(6)
    item = " ".join(f"u{i}" for i in range(30_000))
    w = item.split()
    docs = [(i, prose(rng, 5) + " " + " ".join(w[a : a + 10])) for i, a in enumerate([0, 29_990, 12_345, *range(8_000, 8_400, 7)])] + [(99, " ".join(w[5:14])), (100, item)]
    got = answers(leaks.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string"), group_bytes=100_000))
    assert got == sorted(brute(docs, [(1, item)]), key=repr)


def test_empty_tables(spark):
    ship(spark)
    none, docs = spark.createDataFrame([], "item_id long, text string"), spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    assert answers(leaks.contamination(docs, none)) == [(1, 2, [], []), (2, 0, [], [])]
    assert leaks.contamination(docs.limit(0), spark.createDataFrame([(1, "a")], "item_id long, text string")).count() == 0


def test_query_equals_sql(spark, duck):
    same_rows(queries.QUERIES["op12_benchmark_leaks"](spark, SMALL).toPandas(), duck.execute(queries.ORACLES["op12_benchmark_leaks"]).df())
