import collections
import math

import pytest
from helpers import awkward, frame, learned

from vellum.llm import scoring
from vellum.llm.texts import lower_words


def stream(text):
    return b" ".join(lower_words(text)) + b"\n"


def brute(train, texts):
    """Method C with exclusion, a byte at a time."""
    seen = collections.defaultdict(collections.Counter)
    for t in train:
        x = b"\n" * 5 + stream(t)
        for i in range(5, len(x)):
            for d in range(6):
                seen[x[i - d : i]][x[i]] += 1
    out = []
    for t in texts:
        x, total = b"\n" * 5 + stream(t), 0.0
        for i in range(5, len(x)):
            gone = set()
            for d in range(5, -1, -1):
                own = {s: n for s, n in seen.get(x[i - d : i], {}).items() if s not in gone}
                if not own:
                    continue
                room = sum(own.values()) + len(own)
                if x[i] in own:
                    total += math.log10(own[x[i]] / room)
                    break
                total += math.log10(len(own) / room)
                gone |= set(own)
            else:
                total -= math.log10(256 - len(gone))
        out.append(total)
    return out


@pytest.mark.parametrize("options", [{}, {"head": 10}])
def test_scores_are_those_of_brute_force(spark, options):
    rows = awkward()
    train = [r[1] for r in rows if learned(r[0], 10, 0)]
    counts = collections.Counter(w for t in train for w in [*lower_words(t), b"\n"])
    n, v = sum(counts.values()), len(counts)
    expected = []
    for r, s in zip(rows, brute(train, [r[1] for r in rows]), strict=True):
        tokens = [*lower_words(r[1]), b"\n"]
        base = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens)
        expected.append((str(r[0]), not learned(r[0], 10, 0), len(tokens), sum(counts[w] > 0 for w in tokens), n, base, s))
    got = scoring.held_out_score(frame(spark, rows), **options).collect()
    assert len(got) == len(rows)
    key = lambda r: (r[0], r[2], round(r[6], 2))
    for g, e in zip(sorted(((str(r.doc_id), *r[1:]) for r in got), key=key), sorted(expected, key=key), strict=True):
        assert g[:5] == e[:5] and g[5] == pytest.approx(e[5], abs=1e-6) and g[6] == pytest.approx(e[6], abs=1e-3)


def test_a_smaller_trie_still_gives_probabilities(spark):
    rows = awkward()
    got = scoring.held_out_score(frame(spark, rows), nodes=300).collect()
    assert len(got) == len(rows) and all(r.score < 0 for r in got)


@pytest.mark.parametrize("nodes", [0, 40, 300])
def test_counts_beyond_the_broadcast_ones_still_count(spark, nodes):
    rows = awkward()
    rows += [(500 + i, t, "en", "a") for i, t in enumerate(["w1q w39 zzxq", "Ünï w12\u4e00 ÀBx", "w399w w7 one twx", "12 34 !? ##$", "brand new words"] * 4)]
    train = [r[1] for r in rows if learned(r[0], 10, 0)]
    expected = sorted((str(r[0]), round(s, 3)) for r, s in zip(rows, brute(train, [r[1] for r in rows]), strict=True))
    got = sorted((str(r.doc_id), round(r.score, 3)) for r in scoring.held_out_score(frame(spark, rows), nodes=nodes).collect())
    assert [g[0] for g in got] == [e[0] for e in expected]
    assert [g[1] for g in got] == pytest.approx([e[1] for e in expected], abs=3e-3)


def test_probabilities_of_a_context_sum_to_one(spark):
    import numpy as np

    text = [lower_words("abra cadabra abracad"), lower_words("bracket abrade")]
    code, _ = scoring.codes(text)
    deep, n = np.unique(code, return_counts=True)
    parts = [(np.full(len(k), d, np.int8), k, c) for d in range(6) for k, c in [_summed(deep & ((1 << 8 * (d + 1)) - 1), n)]]
    trie = scoring.Trie(*(np.concatenate([p[i] for p in parts]) for i in range(3)))
    for context in (b"\n\nabr", b"zzzzz", b"abrac", b" cada"):
        base = int.from_bytes(context, "big") << 8
        assert (10 ** trie.log_probabilities(base + np.arange(256))).sum() == pytest.approx(1, abs=1e-5)


def _summed(keys, n):
    import numpy as np

    unique, inverse = np.unique(keys, return_inverse=True)
    return unique, np.bincount(inverse, n).astype(np.int64)


def test_nothing_to_learn_from(spark):
    assert scoring.held_out_score(frame(spark, [])).count() == 0
    from pyspark.sql import functions as F

    got = scoring.score(frame(spark), F.lit(False)).collect()
    assert all(r.n_known == 0 and r.train_tokens == 0 for r in got)
    assert min(got, key=lambda r: r.n_tokens).score == pytest.approx(-math.log10(256))
