import collections
import math
import random
import zlib

import numpy as np
import pytest
from helpers import WORDS, awkward, frame, learned, prose

from vellum.llm import cotrain, language, toxicity
from vellum.llm.texts import lower_words

SYLLABLES = {"aa": ["ka", "lo", "mi", "ta", "re"], "bb": ["sch", "über", "ung", "ent", "ich"], "cc": ["zxo", "qua", "ñez", "ció", "ll"]}


def invented(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def labelled():
    """Texts of which toxic ones hold words with one of two stems; labels of held-out rows are wrong on purpose."""
    rng = random.Random(7)
    rows, labels = [], []
    for i in range(500):
        text, toxic = prose(rng, rng.randint(5, 60)).split(), i % 4 == 0
        if toxic:
            for _ in range(3):
                text.insert(rng.randrange(len(text)), rng.choice(["vile", "grub", "foulx"]) + rng.choice(["", "", "er", "ing"]))
        rows.append((i, " ".join(text), rng.choice(["en", "de"]), rng.choice(["a", "b"])))
        labels.append((i, 1, int(toxic) if learned(i) else 1 - int(toxic)))
    return rows, labels


def test_toxicity(spark, labelled):
    rows, labels = labelled
    docs = frame(spark, rows + [(1000 + i, *r[1:]) for i, r in enumerate(awkward())])
    marks = spark.createDataFrame([*labels, (None, 1, 1), (9999, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(docs, marks).collect()
    assert len(got) == len(rows) + len(awkward())
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) and r.held_out == (not learned(r.doc_id)) for r in got)
    truth = {r[0]: r[0] % 4 == 0 for r in rows if not learned(r[0])}
    by = {r.doc_id: r.predicted for r in got}
    assert np.mean([by[d] for d, t in truth.items() if t]) > 0.85 and np.mean([by[d] for d, t in truth.items() if not t]) < 0.05
    score = {}
    for r, text in zip(sorted(got, key=lambda r: r.doc_id), [r[1] for r in rows] + [r[1] for r in awkward()], strict=True):
        assert score.setdefault(text, r.score) == r.score  # the text alone decides


def test_toxicity_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    got = toxicity.toxicity(frame(spark), none).collect()
    assert len(got) == len(awkward()) and not any(r.predicted for r in got)
    assert toxicity.toxicity(frame(spark, []), none).count() == 0


def test_convolution_by_hand():
    rows = np.array([[[1.0], [10.0], [100.0]], [[2.0], [20.0], [200.0]]], np.float32)  # two words; a filter of width 1, one of width 2
    best, where = toxicity.pooled(rows, (1, 2), 1)
    assert best.tolist() == [2.0, 210.0] and where.tolist() == [1, 0]


def test_parts_of_long_texts_are_joined():
    settings = toxicity.Settings(buckets=64, epochs=1)
    model = toxicity.train([[b"a", b"b"], [b"c"]], np.array([1, 0]), settings)
    scorer = toxicity.Scorer(model)
    words = [b"w%d" % (i % 50) for i in range(50_001)]
    read = scorer.read(words)[0]
    rows = scorer.rows[scorer.ids(words)][:, : scorer.table.shape[1]].reshape(len(words), -1, settings.filters)
    best = toxicity.pooled(rows, settings.widths, settings.filters)[0]
    assert read == pytest.approx(float(np.maximum(best + model.bias, 0) @ model.weights + model.intercept), abs=1e-4)


def test_filters_hang_over_the_ends_of_a_text_alone():
    rng = np.random.default_rng(2)
    rows, inverse = rng.normal(-1, 1, (50, 6, 4)).astype(np.float32), rng.integers(0, 50, 401).astype(np.int32)
    whole = toxicity.pooled(rows[inverse], (1, 2, 3), 4)
    for most in (7, 100, 1000):
        best, where = toxicity.pooled_whole(rows, inverse, (1, 2, 3), 4, most)
        assert best.tolist() == whole[0].tolist() and where.tolist() == whole[1].tolist()


def test_a_short_toxic_passage_of_a_long_text_is_looked_at(spark, monkeypatch):
    rng = random.Random(12)
    ids = [i for i in range(40) if learned(i)]
    rows, n = [], 24_000  # 400 runs of 50 words, one every 60, used to be looked at
    runs = [r * (n - 50) // 399 for r in range(400)]
    at = next(p for p in range(n // 2, n) if all(not k <= p + j < k + 50 for j in range(3) for k in runs))
    for i in ids:
        words = rng.choices(WORDS, k=n)
        words[at : at + 3] = "vile grub foulx".split() if i % 2 else words[:3]
        rows.append((i, " ".join(words), "en", "a"))
    seen = []
    make, fix = toxicity.train, toxicity.calibrate
    monkeypatch.setattr(toxicity, "train", lambda texts, y, *a: seen.extend(zip(texts, y, strict=True)) or make(texts, y, *a))
    monkeypatch.setattr(toxicity, "calibrate", lambda m, texts, y, *a: seen.extend(zip(texts, y, strict=True)) or fix(m, texts, y, *a))
    toxicity.fit(frame(spark, rows), spark.createDataFrame([(i, i % 2) for i in ids], "doc_id long, toxic int"), settings=toxicity.Settings(epochs=1, steps=0))
    assert len(seen) == len(ids) and all(len(t) == n and (b"grub" in t) == y for t, y in seen)


def test_a_repeated_labelled_row_counts_once(spark):
    rows = [(i, ("vile " if i % 2 else "good ") + prose(random.Random(i), 9), "en", "a") for i in range(30)]
    marks = spark.createDataFrame([(i, i % 2) for i in range(30)], "doc_id long, toxic int")
    one, many = (toxicity.fit(frame(spark, r), marks) for r in (rows, rows + rows[:10] * 5))
    assert (one.weights == many.weights).all() and one.thresholds == many.thresholds


def test_scores_meet_the_cut_at_the_threshold():
    assert toxicity.at_cut(0.3, 0.3, 0.7) == 0.7 and toxicity.at_cut(0.0, 0.3, 0.7) == 0 and toxicity.at_cut(1.0, 0.3, 0.7) == pytest.approx(1)


def test_languages(spark):
    rng = random.Random(8)
    rows = [(i, invented(rng, lang := rng.choice(list(SYLLABLES)), rng.randint(4, 50)), lang, "a") for i in range(300)]
    rows += [(1000, None, "aa", None), (1001, "12 34 !!", "aa", "a"), (1002, "", None, "a"), (1003, invented(rng, "aa", 40) + " " + invented(rng, "bb", 60), None, "a")]
    got = {r.doc_id: r for r in language.languages(frame(spark, rows)).collect()}
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got.values())
    assert np.mean([got[r[0]].lang_pred == r[2] for r in rows[:300] if not learned(r[0])]) > 0.97
    assert [got[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3
    mixed = got[1003]
    assert set(mixed.shares) == {"aa", "bb"} and abs(mixed.shares["bb"] - 0.6) < 0.1 and mixed.lang_pred == "bb"


def test_languages_never_read_held_out_labels(spark):
    rng = random.Random(9)
    rows = [(i, invented(rng, "aa", 20), "aa" if learned(i) else "zz", "a") for i in range(60)]
    assert {r.lang_pred for r in language.languages(frame(spark, rows)).collect()} == {"aa"}
    assert {r.lang_pred for r in language.languages(frame(spark, [(1, "abc", None, None), (1, "abc", None, None)])).collect()} == {"und"}
    assert language.languages(frame(spark, [])).count() == 0


def test_mixture_finds_proportions():
    rng = np.random.default_rng(1)
    like = np.where(rng.random((3000, 1)) < 0.3, [[1.0, 0.01]], [[0.01, 1.0]])
    share, _ = language.mixture(like, np.ones(3000), np.array([0.5, 0.5]), rounds=50)
    assert abs(share[0] - 0.3) < 0.03


def test_cotraining(spark):
    rng = random.Random(10)
    rows, labels = [], []
    for i in range(400):
        good = i % 3 > 0
        words = [rng.choice(WORDS) for _ in range(rng.randint(20, 60))]
        rows.append((i, " ".join(words if good else [w + "###" for w in words]), "en", "x" if good else "y"))
        if i % 2:
            labels.append((i, int(good) if learned(i) else 1 - int(good), 0))
    marks = spark.createDataFrame([*labels, (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in cotrain.quality(frame(spark, rows + [(1000 + i, *r[1:]) for i, r in enumerate(awkward())]), marks).collect()}
    assert len(got) == len(rows) + len(awkward())
    assert np.mean([got[i].predicted == int(i % 3 > 0) for i in range(400) if not learned(i)]) > 0.97
    assert all(0 <= r.score <= 1 for r in got.values())


def test_cotraining_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in cotrain.quality(frame(spark), none).collect()} == {0.5}
    assert cotrain.quality(frame(spark, []), none).count() == 0


def test_lower_words_are_the_contracts_words():
    assert lower_words("A\tbÉ\x0b\x0cC d\x1ce ") == ["a".encode(), "bÉ".encode(), "c d\x1ce".encode()]
    assert zlib.crc32(b"12") % 3 in (0, 1, 2)


@pytest.mark.parametrize("seed", range(6))
def test_scores_are_those_of_a_word_by_word_convolution(seed):
    rng = np.random.default_rng(seed)
    s = toxicity.Settings(buckets=64, dim=4, filters=3)
    model = toxicity.Model(s, rng.normal(size=(64, 4)).astype(np.float32), rng.normal(size=(6, 4, 3)).astype(np.float32), rng.normal(size=9).astype(np.float32), rng.normal(size=9).astype(np.float32), 0.3)
    words = [f"w{rng.integers(30)}".encode() for _ in range(int(rng.integers(1, 12)))]
    vectors = [np.mean([model.embedding[f] for f in toxicity.features(w, 64)], axis=0) for w in words]
    best, first = [], 0
    for k, width in enumerate(s.widths):
        for f in range(s.filters):
            sums = []
            for start in range(-(width - 1), len(words)):
                sums.append(sum(float(vectors[start + j] @ model.filters[first + j, :, f]) for j in range(width) if 0 <= start + j < len(words)))
            best.append(max(0.0, max(sums) + float(model.bias[k * s.filters + f])))
        first += width
    assert toxicity.Scorer(model).read(words)[0] == pytest.approx(float(np.array(best) @ model.weights) + 0.3, abs=1e-3)


@pytest.mark.parametrize("seed", range(10))
def test_mixtures_are_those_of_a_patient_search(seed):
    rng = np.random.default_rng(seed)
    k, n = 4, int(rng.integers(5, 60))
    main, other = rng.choice(k, 2, replace=False)
    logs = rng.normal(-8, 1.5, (n, k))
    logs[np.arange(n), np.where(rng.random(n) < rng.choice([0.0, 0.3]), other, main)] += 4
    got, _ = language.proportions(logs, 4.0)
    like = np.exp(logs - logs.max(axis=1)[:, None])

    def fitted(chosen):
        share = np.full(len(chosen), 1 / len(chosen))
        for _ in range(3000):
            joint = like[:, chosen] * share
            share = (joint / joint.sum(axis=1)[:, None]).mean(axis=0)
        return float(np.log((like[:, chosen] * share).sum(axis=1)).sum()), share

    chosen = [int(logs.sum(axis=0).argmax())]
    value, share = fitted(chosen)
    while len(chosen) < k:
        tries = [(fitted([*chosen, c]), [*chosen, c]) for c in range(k) if c not in chosen]
        (v, part), own = max(tries, key=lambda t: t[0][0])
        if v - value <= 2.0 * np.log(n):
            break
        chosen, value, share = own, v, part
    assert int(got.argmax()) == chosen[int(share.argmax())]
    assert np.abs(got[chosen] - share).max() < 0.1 or abs(len(chosen) - int((got > 0).sum())) == 1


def test_platt_scaling_finds_slope_and_shift():
    rng = np.random.default_rng(4)
    x = rng.normal(0, 3, 20_000)
    y = (rng.random(20_000) < 1 / (1 + np.exp(-(0.7 * x - 1)))).astype(float)
    slope, shift = cotrain.platt(x, y)
    assert abs(slope - 0.7) < 0.05 and abs(shift + 1) < 0.1 and cotrain.platt(x[:0], y[:0]).tolist() == [1.0, 0.0]


def test_metadata_view_reads_no_text():
    assert cotrain.meta_features("a", "en", 100) == cotrain.meta_features("a", "en", 100) != cotrain.meta_features("b", "en", 100)
    assert len(cotrain.meta_features(None, None, 0)) == 5


def cotrained(rows, marks, rounds=3, step=0.1):
    """Score of each row by co-training with plain loops over all rows."""

    def shares(text, source, lang):
        words = lower_words(text)
        n = collections.Counter(f for w in words for f in cotrain.word_features(w))
        n[0] = sum(a == b for a, b in zip(words, words[1:], strict=False))
        text_view = {f: x * cotrain.UNIT // len(words) for f, x in n.items() if x}
        return text_view, {f: cotrain.UNIT // 5 * x for f, x in collections.Counter(cotrain.meta_features(source, lang, len(text or ""))).items()}

    def fit(members, view, size):
        """Log-odds from ((features, class), is given) pairs."""
        held = [[0.0] * size, [0.0] * size]
        own = [sum(c == k and not given for _, c, given in members) for k in (0, 1)]
        lent = [sum(c == k and given for _, c, given in members) for k in (0, 1)]
        for features, c, given in members:
            for f, x in features[view].items():
                held[c][f] += x / cotrain.UNIT * (cotrain.PSEUDO * own[c] / lent[c] if given else 1)
        whole = [sum(h) + cotrain.PRIOR * size for h in held]
        return [math.log((held[1][f] + cotrain.PRIOR) / whole[1]) - math.log((held[0][f] + cotrain.PRIOR) / whole[0]) for f in range(size)]

    label = {}
    for d, y in marks:
        if d is not None and y is not None:
            label[d] = max(y, label.get(d, 0))
    coded = [(d, shares(t, s, la)) for d, t, la, s in rows]
    crc = lambda d: zlib.crc32(b"" if d is None else str(d).encode()) % 9
    base = [(x, label[d], False) for d, x in coded if d in label and learned(d) and crc(d) not in (6, 8)]
    aside = [(x, label[d]) for d, x in coded if d in label and learned(d) and crc(d) in (6, 8)]
    pool = [x for d, x in coded if d not in label and learned(d)]
    sizes = (cotrain.BUCKETS, cotrain.META)
    logit = lambda x, view, w: sum(w[f] * (s / cotrain.UNIT) for f, s in x[view].items())
    views = [fit(base, v, sizes[v]) for v in (0, 1)]
    prior = sum(c for _, c, _ in base) / len(base)
    for r in range(1, rounds + 1):
        given = []
        for v in (0, 1):
            at = [math.floor(logit(x, v, views[v]) * cotrain.WIDTH) + cotrain.BINS // 2 for x in pool]
            order = sorted(at)
            middle = order[(len(order) + 1) // 2 - 1]
            low = min(order[math.ceil(len(order) * r * step * (1 - prior)) - 1], middle - 1)
            high = max(order[-math.ceil(len(order) * r * step * prior)], middle + 1)
            given.append([(x, int(a >= high), True) for x, a in zip(pool, at, strict=True) if a <= low or a >= high])
        views = [fit(base + given[1 - v], v, sizes[v]) for v in (0, 1)]
    model = cotrain.Model([np.array(w) for w in views])
    sides = [np.array([logit(x, v, views[v]) for x, _ in aside]) for v in (0, 1)]
    model = cotrain.calibrated(model, sides, np.array([float(c) for _, c in aside]))
    both = [[a * logit(x, v, views[v]) + b for v, (a, b) in enumerate(model.scales)] for _, x in coded]
    return [1 / (1 + math.exp(-(model.combine[0] * t + model.combine[1] * m + model.combine[2]))) for t, m in both]


def test_cotraining_against_brute_force(spark):
    rng = random.Random(12)
    rows, marks = [], [(None, 1), (3, None), (77777, 1)]
    for i in range(150):
        good = rng.random() < 0.7
        words = [rng.choice(WORDS) if good or rng.random() < 0.5 else rng.choice(["@@1", "buy!", "x#"]) for _ in range(rng.randint(1, 40))]
        rows.append((i, " ".join(words), rng.choice(["en", None]), "x" if good or rng.random() < 0.3 else "y"))
        if i % 2:
            marks += [(i, int(good))] * rng.randint(1, 2)
    rows += [(1000 + i, *r[1:]) for i, r in enumerate(awkward())] + rows[:3] + [(5, "another text", "en", "x"), (5, "buy! buy! buy!", None, "y"), (None, "buy!", None, None), (2000, "long " * 30_000, "en", "y")]
    got = cotrain.quality(frame(spark, rows), spark.createDataFrame(marks, "doc_id long, quality int")).collect()
    key = lambda d, s: (-1 if d is None else d, round(s, 9))
    assert sorted(key(r.doc_id, r.score) for r in got) == sorted(key(r[0], s) for r, s in zip(rows, cotrained(rows, marks), strict=True))
    assert all(r.held_out != learned(r.doc_id) and r.predicted == int(r.score >= 0.5) for r in got)


def test_sure_bins():
    bins = np.zeros(cotrain.BINS, np.int64)
    assert cotrain.sure_bins(bins, 0.1, 0.5) == (-1, cotrain.BINS)
    bins[100] = 1000  # a view that tells nothing apart gives nothing
    low, high = cotrain.sure_bins(bins, 0.1, 0.5)
    assert not bins[: low + 1].any() and not bins[high:].any()
    bins[[90, 110, 111]] = 10, 30, 40  # rows of one bin are not parted
    low, high = cotrain.sure_bins(bins, 0.1, 0.5)
    assert bins[: low + 1].sum() == 10 and bins[high:].sum() == 70
