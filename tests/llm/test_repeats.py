import collections
import random

import numpy as np
import pytest
from helpers import awkward, frame, removed

from vellum.llm import repeats


def brute(texts, span):
    seen = collections.Counter(t[i : i + span] for t in texts for i in range(len(t) - span + 1))
    return [[seen[t[i : i + span]] > 1 for i in range(len(t) - span + 1)] for t in texts]


@pytest.mark.parametrize("seed", range(60))
def test_index_marks_what_brute_force_marks(seed):
    rng = random.Random(seed)
    letters = rng.choice([b"ab", b"abc", b"a", bytes(range(4))])
    base = [bytes(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(4)]
    span = rng.choice([1, 3, 8, 12, 17])
    contents = [b for b in (rng.choice(base)[rng.randint(0, 20) :] + rng.choice(base)[: rng.randint(0, 30)] for _ in range(8)) if len(b) >= span]
    if not contents:
        return
    for found, expected in zip(repeats.repeated_windows(contents, [1] * len(contents), span), brute(contents, span), strict=True):
        got = [False] * len(expected)
        for first, number in found:
            got[first : first + number] = [True] * number
        assert got == expected


def test_index_is_run_length_compressed_and_sampled_at_run_ends():
    index = repeats.RunIndex([b"abcabcabcabd" * 20] * 5)
    assert len(index.letters) < 60 < len(index.data) == index.lengths.sum()
    assert len(index.before[0]) == len(index.after[0]) == len(index.letters)


def test_equal_windows_share_a_hash_and_inner_repeats_are_told():
    rng = random.Random(2)
    texts = [b" ".join(rng.choice([b"lorem", b"ipsum", b"sit", b"x"]) for _ in range(rng.randint(0, 200))) for _ in range(20)]
    texts += [b"The " * 100, b"ab" * 150, texts[0], b"", b"x" * 199, b"x" * 201]
    data, at = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    found, seen, n = repeats.runs(data, at), {}, 0
    for t, s, w, h, inner in zip(*(found[c] for c in ("text", "start", "windows", "hash", "inner")), strict=True):
        windows = [texts[t][i : i + 200] for i in range(s, s + w)]
        assert all(seen.setdefault(x, h) == h and len(x) == 200 for x in windows)
        assert inner or len(set(windows)) == len(windows)
        n += w
    assert n == sum(max(0, len(t) - 199) for t in texts)


@pytest.mark.parametrize("gathered", [repeats.GATHERED, 1000])
def test_operator_removes_what_brute_force_removes(spark, gathered):
    got = repeats.without_repeats(frame(spark), with_text=True, gathered=gathered).collect()
    rows = awkward()
    expected = sorted((str(r[0]), *x) for r, x in zip(rows, removed([r[1] for r in rows]), strict=True))
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == expected
    for r in got:
        assert sum(x.end - x.start for x in r.removed) == r.n_removed


def cancelling():
    """Two texts without a common 200-byte string that form one run each, of one key, and whose polynomial hashes modulo 2**64 are equal for every base: letters swapped by the Thue-Morse sequence."""
    for seed in range(100):
        rng = random.Random(seed)
        fill = "".join(rng.choice("cdefghijklmnopqrstuvwxyz") for _ in range(63))
        texts = ["".join("ab"[bin(i).count("1") % 2 ^ swap] + fill for i in range(64)) for swap in (0, 1)]
        found = [repeats.runs(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)])) for t in texts]
        if all(len(f["hash"]) == 1 for f in found) and found[0]["hash"] == found[1]["hash"]:
            return texts
    raise AssertionError("no filler has the least gram")


@pytest.mark.parametrize("gathered", [repeats.GATHERED, 1000])
def test_hashes_that_cancel_remove_nothing_else(spark, gathered):
    texts = cancelling()
    noise = "".join(random.Random(6).choice("abcdefgh") for _ in range(700))
    rows = [(i, t, "en", "a") for i, t in enumerate([*texts, noise])]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.without_repeats(frame(spark, rows), gathered=gathered).collect()}
    assert got == dict(enumerate(removed([r[1] for r in rows])))
    a, b = (np.frombuffer(t.encode(), np.uint8) for t in texts)
    assert repeats.Hasher(a).grams(4096) == repeats.Hasher(b).grams(4096)
    assert (repeats.digests(a, np.array([0]), np.array([4096])) != repeats.digests(b, np.array([0]), np.array([4096]))).all()


def test_rows_without_ids_are_known_by_their_whole_texts(spark):
    rng = random.Random(7)
    texts = ["".join(rng.choice("abcdefghij") for _ in range(600)) for _ in range(8)]
    rows = [(None, t + texts[0][:250] * (i % 2), "en", "a") for i, t in enumerate(texts)] + [(None, texts[3], "en", "a"), (None, None, "en", "a"), (None, "", "en", "a")]
    got = sorted((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.without_repeats(frame(spark, rows)).collect())
    assert got == sorted(removed([r[1] for r in rows]))


def test_empty_table(spark):
    assert repeats.without_repeats(frame(spark, [])).count() == 0
