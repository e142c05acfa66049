"""Convolutional toxicity classifier over hashed word embeddings, trained in numpy.

A word's embedding is the mean of those of its hashed features: the word, its first characters and its last ones, so
that unseen forms share what they can. Filters of several widths slide over the words; each keeps its greatest
value over the whole text, and a logistic layer reads these maxima. A filter is linear in each word, so after training
every word has, once and for all, its contribution to each filter and place: scoring a text is adding rows up and
taking maxima. Probabilities are Platt-scaled, and a threshold is calibrated by language; since lang is no input, each
text's language is guessed from its frequent words, and the score is moved monotonically so that the language's
threshold falls on `cut`.
"""

from __future__ import annotations

import uuid
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.llm.common import held_out, ship
from vellum.llm.texts import Shared, lower_words

#: Labelled rows that a classifier is fitted on, half of them toxic if there are so many: a bound on the driver's work.
FIT_ROWS = 6_000
#: Words of a text that are looked at together; a longer text is read in parts.
PART_WORDS = 50_000
STRIP = b".,;:!?*#%&$\"'()[]{}<>|-_/\\"


@dataclass
class Settings:
    buckets: int = 1 << 17
    dim: int = 8
    widths: tuple[int, ...] = (1, 2, 3)
    filters: int = 8
    epochs: int = 6
    steps: int = 30_000  # at least, as far as 40 epochs make them
    least_texts: int = 3
    rate: float = 0.1
    sure: float = 0.02
    seed: int = 5


def features(word: bytes, buckets: int) -> list[int]:
    """Buckets of the word and of its first 3 and 5 bytes."""
    w = word.strip(STRIP) or word
    return [zlib.crc32(w) % buckets, zlib.crc32(b"3" + w[:3]) % buckets, zlib.crc32(b"5" + w[:5]) % buckets]


@dataclass
class Model:
    settings: Settings
    embedding: np.ndarray  # buckets x dim
    filters: np.ndarray  # places (all of all widths) x dim x filters
    bias: np.ndarray  # widths * filters
    weights: np.ndarray
    intercept: float
    slope: float = 1.0
    shift: float = 0.0
    thresholds: dict[str, float] = field(default_factory=dict)
    languages: dict[bytes, dict[str, float]] = field(default_factory=dict)
    cut: float = 0.7


def pooled(rows: np.ndarray, widths: tuple[int, ...], filters: int, begins: bool = True, ends: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Maxima of each filter over a text, from its words' contributions (words x places x filters), and where they are.

    A filter may hang over either end of the text, where there is nothing to add; not over the end of a part that the
    text does not begin or end with.
    """
    n, first, out, where = len(rows), 0, [], []
    for width in widths:
        total = np.zeros((n + width - 1, filters), np.float32)
        for j in range(width):
            total[width - 1 - j : width - 1 - j + n] += rows[:, first + j]
        skip = 0 if begins else width - 1
        at = total[skip : None if ends else n].argmax(axis=0) + skip
        out.append(total[at, np.arange(filters)])
        where.append(at - (width - 1))
        first += width
    return np.concatenate(out), np.concatenate(where)


def parts(n: int, widths: tuple[int, ...], most: int = PART_WORDS) -> Iterator[tuple[int, int]]:
    """Where the parts of a text of n words begin and end; they overlap, so that no place of a filter is lost."""
    for i in range(0, n, most):
        yield max(0, i - max(widths) + 1), min(i + most, n)


def pooled_whole(rows: np.ndarray, inverse: np.ndarray, widths: tuple[int, ...], filters: int, most: int = PART_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """pooled() of the text rows[inverse], which is never held whole."""
    best, where = None, None
    for a, b in parts(len(inverse), widths, most):
        own, at = pooled(rows[inverse[a:b]], widths, filters, a == 0, b == len(inverse))
        best, where = (own, at) if best is None else (np.maximum(best, own), np.where(own > best, at + a, where))
    return best, where


def train(texts: list[list[bytes]], toxic: np.ndarray, settings: Settings) -> Model:
    """Adagrad on the logistic loss, classes balanced; the gradient of a maximum goes to the words under it alone.

    Texts that the model is sure of already are passed over, so later rounds go to the hard ones.
    """
    s = settings
    rng = np.random.default_rng(s.seed)
    memo: dict[bytes, list[int]] = {}
    coded = []
    for words in texts:
        unique: dict[bytes, int] = {}
        inverse = np.array([unique.setdefault(w, len(unique)) for w in words], np.int32)
        for w in unique:
            if w not in memo:
                memo[w] = features(w, s.buckets)
        coded.append((np.array([memo[w] for w in unique], np.int32).reshape(-1, 3), inverse))
    del memo
    places, k = sum(s.widths), len(s.widths)
    embedding = np.zeros((s.buckets, s.dim), np.float32)
    # Buckets of few texts stay at zero: they could only be learned by heart.
    texts_of = np.zeros(s.buckets, np.int32)
    for f, _ in coded:
        texts_of[np.unique(f)] += 1
    live = texts_of >= s.least_texts
    embedding[live] = rng.normal(0, 0.1, (int(live.sum()), s.dim))
    filters = rng.normal(0, 0.5, (places, s.dim, s.filters)).astype(np.float32)
    bias = np.full(k * s.filters, 0.1, np.float32)
    weights = np.abs(rng.normal(0, 0.3, k * s.filters)).astype(np.float32)
    weights[1::4] *= -1
    intercept, g_b = 0.0, 1e-2
    g_e, g_f, g_w = np.full(s.buckets, 1e-2, np.float32), np.full_like(filters, 1e-2), np.full_like(weights, 1e-2)
    begins = np.cumsum([0, *s.widths])
    share = max(1e-3, min(0.999, float(toxic.mean()))) if len(toxic) else 0.5
    for _ in range(max(s.epochs, min(40, s.steps // max(len(coded), 1)))):
        for i in rng.permutation(len(coded)):
            feats, inverse = coded[i]
            if not len(inverse):
                continue
            vectors = embedding[feats].mean(axis=1)
            rows = (vectors @ filters.transpose(1, 0, 2).reshape(s.dim, -1)).reshape(-1, places, s.filters)
            maxima, where = pooled_whole(rows, inverse, s.widths, s.filters)
            maxima = np.maximum(maxima + bias, 0)
            p = 1 / (1 + np.exp(-np.clip(float(maxima @ weights) + intercept, -30, 30)))
            error = p - float(toxic[i])
            if abs(error) < s.sure:
                continue
            error *= 0.5 / share if toxic[i] else 0.5 / (1 - share)
            up = error * weights
            g = error * maxima
            g_w += g * g
            weights -= s.rate * g / np.sqrt(g_w)
            g_b += error * error
            intercept -= s.rate * error / np.sqrt(g_b)
            for c in np.flatnonzero(maxima > 0):
                width, f = s.widths[c // s.filters], c % s.filters
                for j in range(width):
                    at = where[c] + j
                    if 0 <= at < len(inverse):
                        place = begins[c // s.filters] + j
                        u = inverse[at]
                        ids, down = feats[u][live[feats[u]]], up[c] * filters[place, :, f] / 3
                        grad = up[c] * vectors[u]
                        g_f[place, :, f] += grad * grad
                        filters[place, :, f] -= s.rate * grad / np.sqrt(g_f[place, :, f])
                        g_e[ids] += down @ down
                        embedding[ids] -= s.rate * down / np.sqrt(g_e[ids])[:, None]
    return Model(s, embedding, filters, bias, weights, intercept)


class Scorer:
    """Scores texts from a table of contributions, one row for each bucket; rows of words seen lately are kept."""

    def __init__(self, model: Model, words: int = 120_000):
        s = model.settings
        self.model, self.limit = model, words
        self.table = (model.embedding @ model.filters.transpose(1, 0, 2).reshape(s.dim, -1)).reshape(s.buckets, -1)
        self.langs = sorted({lang for v in model.languages.values() for lang in v})
        self.words: dict[bytes, int] = {}
        self.rows = np.zeros((8192, self.table.shape[1] + len(self.langs)), np.float32)

    def ids(self, words: list[bytes]) -> np.ndarray:
        got = list(map(self.words.get, words))
        if None in got:
            new = {w for w, i in zip(words, got, strict=True) if i is None}
            if len(self.words) + len(new) > self.limit:
                self.words, new = {}, set(words)
            first, new = len(self.words), list(new)
            while first + len(new) > len(self.rows):
                self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
            s = self.model.settings
            rows = self.table[np.array([features(w, s.buckets) for w in new])].mean(axis=1)
            self.rows[first : first + len(new), : rows.shape[1]] = rows
            self.rows[first : first + len(new), rows.shape[1] :] = 0
            for i, w in enumerate(new, first):
                self.words[w] = i
                for lang, v in self.model.languages.get(w, {}).items():
                    self.rows[i, rows.shape[1] + self.langs.index(lang)] = v
            got = list(map(self.words.get, words))
        return np.array(got, np.int64)

    def read(self, words: list[bytes]) -> tuple[float, str]:
        """The logit and the language of a text."""
        m, s = self.model, self.model.settings
        places, best, votes = sum(s.widths), np.full(len(m.bias), -np.inf), np.zeros(len(self.langs))
        for a, b in parts(len(words), s.widths):
            ids = self.ids(words[a:b])
            rows = self.rows[ids]
            votes += rows[:, self.table.shape[1] :].sum(axis=0)
            best = np.maximum(best, pooled(rows[:, : self.table.shape[1]].reshape(-1, places, s.filters), s.widths, s.filters, a == 0, b == len(words))[0])
        if not words:
            best = np.zeros(len(m.bias))
        logit = float(np.maximum(best + m.bias, 0) @ m.weights + m.intercept)
        return logit, self.langs[int(votes.argmax())] if votes.any() else ""

    def score(self, words: list[bytes]) -> float:
        m = self.model
        logit, lang = self.read(words)
        p = float(1 / (1 + np.exp(-np.clip(m.slope * logit + m.shift, -30, 30))))
        return at_cut(p, m.thresholds.get(lang, m.thresholds.get("", 0.5)), m.cut)


def at_cut(p: float, threshold: float, cut: float) -> float:
    """A monotone map of [0, 1] onto itself that takes threshold to cut."""
    return p * cut / threshold if p < threshold else cut + (p - threshold) * (1 - cut) / (1 - threshold)


def calibrate(model: Model, texts: list[list[bytes]], toxic: np.ndarray, langs: list[str]) -> Model:
    """Platt scaling, languages' frequent words, and for each language the threshold of the best F1, on texts not trained on."""
    counts: dict[str, Counter] = {}
    for words, lang in zip(texts, langs, strict=True):
        counts.setdefault(lang, Counter()).update(w for w in words if len(w) < 8)
    total = {lang: sum(c.values()) + 1 for lang, c in counts.items()}
    for lang, c in counts.items():
        for w, n in c.most_common(50):
            model.languages.setdefault(w, {})[lang] = n / total[lang]
    scorer = Scorer(model)
    read = [scorer.read(t) for t in texts]
    x = np.array([r[0] for r in read])
    a, b, y = 1.0, 0.0, toxic.astype(float)
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        a -= 0.05 * float(((p - y) * x).mean()) if len(x) else 0.0
        b -= 0.2 * float((p - y).mean()) if len(x) else 0.0
    model.slope, model.shift = max(a, 1e-3), b
    p = 1 / (1 + np.exp(-np.clip(model.slope * x + b, -30, 30)))
    guess = np.array([r[1] for r in read], object)
    # With few toxic texts, in all or in a language, the cut lies above everything clean.
    model.thresholds[""] = threshold(p, toxic, float(np.clip(p[toxic == 0].max(initial=0.5) * 1.02, 0.02, 0.98)))
    for lang in counts:
        own = guess == lang
        model.thresholds[lang] = threshold(p[own], toxic[own], model.thresholds[""])
    return model


def threshold(p: np.ndarray, y: np.ndarray, default: float, least: int = 20) -> float:
    """Between two neighbouring values, the cut with the best F1; of equal ones the middle. default with too few positives."""
    if y.sum() < least or y.sum() == len(y):
        return default
    order = np.argsort(-p, kind="stable")
    q, hits = p[order], np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(q) + 1) + y.sum())
    good = np.flatnonzero(f1 >= f1.max() - 1e-9)
    i, j = int(good[0]), int(good[-1])
    low = q[j + 1] if j + 1 < len(q) else 0.0
    return float(np.clip((q[i] + low) / 2, 0.02, 0.98))


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, settings: Settings | None = None) -> Model:
    """A model from at most `rows` labelled rows that are not held out, drawn by a hash of doc_id, half of them toxic if possible.

    Without a label of either class the model knows nothing and scores all texts alike, below the cut.
    """
    marked = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    key = F.xxhash64("doc_id", F.lit(3))
    # Ids first, so that only the drawn rows' texts are read together.
    drawn = None
    for toxic, n in ((1, rows // 2), (0, rows - rows // 2)):
        part = marked.where(~held_out(F.col("doc_id"))).where(F.col("toxic") == toxic).orderBy(key).limit(n)
        drawn = part if drawn is None else drawn.unionByName(part)
    known = docs.select("doc_id", "text", "lang").join(F.broadcast(drawn), "doc_id")
    known = known.groupBy("doc_id", "text").agg(F.min("lang").alias("lang"), F.max("toxic").alias("toxic"))  # a repeated row counts once
    # An id may stand for many texts: the bound is on rows.
    known = known.orderBy(F.xxhash64("doc_id", "text", F.lit(3))).limit(rows)
    found = sorted(known.collect(), key=lambda r: (zlib.crc32(str(r[0]).encode()), r[1] or ""))
    texts, same = [], {}  # one copy of each word
    for r in found:
        texts.append([same.setdefault(w, w) for w in lower_words(r[1])])
    y = np.array([r[3] for r in found], np.int64)
    langs = [r[2] or "" for r in found]
    settings = settings or Settings()
    if len(set(y.tolist())) < 2:
        model = train([], y[:0], settings)
        model.thresholds[""] = 0.9
        return model
    second = np.arange(len(found)) % 3 == 2
    model = train([t for t, s in zip(texts, second, strict=True) if not s], y[~second], settings)
    return calibrate(model, [t for t, s in zip(texts, second, strict=True) if s], y[second], [la for la, s in zip(langs, second, strict=True) if s])


def scored(batches: Iterator[pa.RecordBatch], shared: Shared, out: str) -> Iterator[pa.RecordBatch]:
    """The rows with their score as the last column."""
    scorer = shared.use(Scorer)
    for batch in batches:
        values = [scorer.score(lower_words(t)) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, pa.float64())], [*batch.schema.names, out])


def with_scores(docs: DataFrame, labels: DataFrame, cut: float = 0.7, rows: int = FIT_ROWS, out: str = "toxicity") -> DataFrame:
    """docs(doc_id, text, lang, ...) with all its columns and the score in a further one."""
    if out in docs.columns:
        raise ValueError(f"there is a column {out} already")
    ship(docs.sparkSession)
    model = fit(docs, labels, rows)
    model.cut = cut
    shared = Shared(docs.sparkSession, model, uuid.uuid4().hex)  # its size is fixed by the settings
    schema = T.StructType([*docs.schema.fields, T.StructField(out, T.DoubleType())])
    return docs.mapInArrow(lambda b: scored(b, shared, out), schema)


def toxicity(docs: DataFrame, labels: DataFrame, cut: float = 0.7, rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted (score >= cut) of each row of docs(doc_id, text, lang).

    Whole texts are scored; null counts as empty, and an empty text gets the score of a text without any filter's word.
    Only the text decides a score: equal texts score alike. Rows with a null doc_id are scored too. Extra columns are
    left out; an empty table gives an empty result.
    """
    out = with_scores(docs.select("doc_id", "text", "lang"), labels, cut, rows, "score")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))
