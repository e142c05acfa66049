import random

import numpy as np
import pytest
from helpers import WORDS, awkward, frame, near_components, shingles

from vellum.llm import nearcopies
from vellum.llm.texts import U64


def variants(n, seed=3):
    """Chains of near copies: some link only by way of others."""
    rng = random.Random(seed)
    rows = []
    for group in range(4):
        words = [rng.choice(WORDS) for _ in range(80)]
        for i in range(n):
            words = list(words)
            for _ in range(rng.randint(0, 3)):
                words[rng.randrange(80)] = rng.choice(WORDS)
            rows.append((10_000 + group * 1000 + i, " ".join(words), "en", "a"))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("k", "percent", "block"), [(3, 85, 10**6), (5, 80, 10**6), (3, 85, 300)])
def test_components_and_sizes(spark, k, percent, block):
    rows = awkward() + variants(12)
    bands = 24 if k == 3 else 36
    got = nearcopies.near_copies(frame(spark, rows), k=k, percent=percent, bands=bands, rows=5, block=block).collect()
    assert len(got) == len(rows)
    roots = near_components([r[:2] for r in rows], k, percent)
    sizes = {r[0]: len(shingles(r[1], k)) for r in rows if r[0] is not None}
    for r in got:
        if r.doc_id is None:
            assert r.kept and r.component_id is None
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (sizes[r.doc_id], roots[r.doc_id], roots[r.doc_id] == r.doc_id)


def test_links_connect_what_all_pairs_connect():
    rng = np.random.default_rng(4)
    for _ in range(40):
        base = rng.integers(0, 2**60, 60).astype(U64)
        sets = [np.unique(np.concatenate([rng.choice(base, 50, replace=False), rng.integers(0, 2**60, rng.integers(0, 8)).astype(U64)])) for _ in range(15)]
        root = list(range(15))

        def join(pairs, root=root):
            for a, b in pairs:
                x, y = root[a], root[b]
                root[:] = [x if r == y else r for r in root]

        join([(a, b) for a in range(15) for b in range(a) if 100 * len(s := set(sets[a]) & set(sets[b])) >= 75 * (len(sets[a]) + len(sets[b]) - len(s))])
        whole, root[:] = list(root), range(15)
        join(nearcopies.links(list(range(15)), sets, 75))
        assert len({(a, b) for a, b in zip(whole, root, strict=True)}) == len(set(whole)) == len(set(root))


def test_circulant_signatures_estimate_similarity():
    rng = np.random.default_rng(5)
    a = rng.integers(0, 2**62, 1000).astype(U64)
    b = np.concatenate([a[:800], rng.integers(0, 2**62, 200).astype(U64)])
    shifts = np.arange(400, dtype=np.uint32)
    same = (nearcopies.signature(a, shifts) == nearcopies.signature(b, shifts)).mean()
    assert abs(same - 800 / 1200) < 0.1


def test_texts_of_one_id_hang_together(spark):
    rows = [(3, "a b c d e f g", "en", "a"), (5, "a b c d e f g", "en", "a"), (5, "h i j k l m n", "en", "a"), (7, "h i j k l m n", "en", "a"), (8, "o p q r s t u", "en", "a")]
    got = nearcopies.near_copies(frame(spark, rows), k=3, percent=85, bands=24, rows=5).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in got) == [(3, 3, True), (5, 3, False), (5, 3, False), (7, 3, False), (8, 8, True)]


def test_one_of_each_group_stays(spark):
    docs = frame(spark)
    left = nearcopies.without_near_copies(docs, k=3, percent=85, bands=24, rows=5)
    assert left.columns == docs.columns
    ids = [r.doc_id for r in left.collect()]
    assert ids.count(1) == 1 and 2 not in ids and 9 not in ids and None in ids and {4, 5, 6, 7, 8}.issubset(ids)


def test_empty_table(spark):
    assert nearcopies.near_copies(frame(spark, [])).count() == 0
    assert nearcopies.without_near_copies(frame(spark, [])).count() == 0
