"""Quality classifier by co-training of a text view and a metadata view, over the whole corpus.

Both views are naive Bayes models, as in Blum and Mitchell's co-training. The text view knows the words of a text, their
shapes and repeated neighbours; the metadata view knows what is known of a page without reading it: source, language,
both together, and length. A view's logit is the mean log-odds of a row's features, and all that it learns are sums of
feature shares by class, so a fit is one aggregate, however many rows take part.

Both start from the labelled rows. In each round either view scores all unlabelled rows, those that it is surest of get a
label, and the other view is fitted again with them. Nothing is kept of a round but two models of fixed size and a histogram of
logits. At the end each view is Platt-scaled on labelled rows kept aside, and a logistic model of the two calibrated
logits scores all documents.
"""

from __future__ import annotations

import math
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import MAX_BROADCAST_IDS, bucket_of, held_out, stage
from vellum.llm.texts import Rows, Shared, lower_words, resident

#: Logits of labelled rows kept aside that the two views are calibrated on, drawn by a hash.
CALIBRATION_ROWS = 4_000
BUCKETS = 1 << 16
META = 1 << 12
#: A feature's share of a row in whole numbers, so that sums don't depend on their order.
UNIT = 1 << 20
#: What every feature holds before anything was seen, in rows.
PRIOR = 0.01
#: Pseudo-labelled rows of a class count as so much of the labelled ones, however many they are.
PSEUDO = 0.3
#: Bins of a logit's histogram: widths of 1/512 from -16 to 16.
BINS, WIDTH = 1 << 14, 512
#: Rows of a shuffled aggregate: labels of labelled rows, those given by the other view, and histograms.
LABELLED, GIVEN, HISTOGRAM = 0, 1, 2
_LETTERS = bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 256))
_FEATURES = "doc_id {}, words int, buckets binary, counts binary, meta binary"


def word_features(word: bytes) -> tuple[int, int]:
    """Buckets of a word and of its shape: runs of letters, digits and each other sign."""
    shape, last = [], None
    for c in word:
        kind = 97 if c in _LETTERS else 48 if 48 <= c <= 57 else c
        if kind != last:
            shape.append(kind)
        last = kind
    return zlib.crc32(word) % (BUCKETS - 4096) + 4096, zlib.crc32(bytes(shape)) % 4094 + 2


def text_features(words: list[bytes], rows) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text and how often each comes; bucket 0 counts words that repeat the one before."""
    repeats = sum(map(bytes.__eq__, words, words[1:]))
    at, n = np.unique(rows(words), return_counts=True) if words else (np.zeros(0), np.zeros(0))
    if repeats:
        at, n = np.concatenate([[0], at]), np.concatenate([[repeats], n])
    return at.astype(np.uint16), n.astype(np.uint32)


def meta_features(source: str | None, lang: str | None, length: int) -> list[int]:
    """Features of a page's columns; length is that of its text in characters."""
    size = int(2 * math.log2(length + 1))
    parts = [f"source {source}", f"lang {lang}", f"both {source} {lang}", f"length {size}", f"length {size // 4} of {source}"]
    return [zlib.crc32(p.encode()) % META for p in parts]


def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The features of each row: all that later passes read."""
    rows = resident("word and shape buckets", lambda: Rows(lambda words: np.array([word_features(w) for w in words]), 2, kind=np.int32))
    for batch in batches:
        out: list[list] = [[], [], [], []]
        for text, source, lang, length in zip(*(batch.column(c).to_pylist() for c in ("text", "source", "lang", "_length")), strict=True):
            words = lower_words(text)
            at, n = text_features(words, rows)
            for values, v in zip(out, (len(words), at.tobytes(), n.tobytes(), np.array(meta_features(source, lang, length), np.uint16).tobytes()), strict=True):
                values.append(v)
        kinds = (pa.int32(), pa.binary(), pa.binary(), pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(v, k) for v, k in zip(out, kinds, strict=True))], ["doc_id", "words", "buckets", "counts", "meta"])


@dataclass
class Model:
    """Log-odds of the features of both views; how their logits are calibrated and combined."""

    views: list[np.ndarray] = field(default_factory=lambda: [np.zeros(BUCKETS), np.zeros(META)])
    scales: np.ndarray = field(default_factory=lambda: np.array([[1.0, 0.0], [1.0, 0.0]]))  # slope and shift of each view's logit
    combine: np.ndarray = field(default_factory=lambda: np.zeros(3))  # weights of the two calibrated logits, and the intercept


@dataclass
class Shares:
    """Features of a batch, for each view: the row and the bucket of each, and its share in UNITs."""

    views: list[tuple[np.ndarray, np.ndarray, np.ndarray]]
    n: int

    @staticmethod
    def of(batch: pa.RecordBatch) -> Shares:
        cells = lambda name, kind: np.frombuffer(b"".join(batch.column(name).to_pylist()), kind).astype(np.int64)
        sizes = lambda name, width: pc.binary_length(batch.column(name)).to_numpy(zero_copy_only=False).astype(np.int64) // width
        row = np.arange(batch.num_rows)
        words = np.maximum(batch.column("words").to_numpy(zero_copy_only=False).astype(np.int64), 1)
        of = np.repeat(row, sizes("buckets", 2))
        text = of, cells("buckets", np.uint16), cells("counts", np.uint32) * UNIT // words[of]
        meta = np.repeat(row, sizes("meta", 2)), cells("meta", np.uint16)
        return Shares([text, (*meta, np.full(len(meta[0]), UNIT // 5))], batch.num_rows)

    def logits(self, model: Model) -> list[np.ndarray]:
        return [np.bincount(row, w[at] * (share / UNIT), self.n) for (row, at, share), w in zip(self.views, model.views, strict=True)]


def binned(logit: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(logit * WIDTH) + BINS // 2, 0, BINS - 1).astype(np.int64)


def tallied(batches: Iterator[pa.RecordBatch], shared: Shared | None) -> Iterator[pa.RecordBatch]:
    """What a task's rows add to the sums: kind, view, class, feature (-1: rows), total.

    Without a model, labelled rows by class; with a model, the unlabelled rows' histograms; with the bins where each view
    begins to be sure as well, the features of the rows that the other view is sure of.
    """
    model, cuts = shared.use(lambda x: x) if shared else (None, None)
    sizes = (BUCKETS + 1, META + 1)  # the last place counts rows
    sums = [np.zeros((2, n), np.int64) for n in sizes]
    bins = np.zeros((2, BINS), np.int64)
    for batch in batches:
        if not batch.num_rows:
            continue
        shares = Shares.of(batch)
        if model is None:
            given = [batch.column("quality").to_numpy(zero_copy_only=False)] * 2
        else:
            at = [binned(x) for x in shares.logits(model)]
            if cuts is None:
                for view in (0, 1):
                    bins[view] += np.bincount(at[view], minlength=BINS)
                continue
            sure = [np.where(a <= low, 0, np.where(a >= high, 1, -1)) for a, (low, high) in zip(at, cuts, strict=True)]
            given = sure[::-1]
        for view, (row, feature, share) in enumerate(shares.views):
            for c in (0, 1):
                mine = given[view] == c
                take = mine[row]
                # Exact in doubles: a batch's shares stay far below 2**53.
                sums[view][c, :-1] += np.bincount(feature[take], share[take], sizes[view] - 1).astype(np.int64)
                sums[view][c, -1] += int(mine.sum())
    parts = []
    for view in (0, 1):
        for c in (0, 1):
            at = np.flatnonzero(sums[view][c])
            parts.append((LABELLED if model is None else GIVEN, view, c, np.where(at == sizes[view] - 1, -1, at), sums[view][c, at]))
        at = np.flatnonzero(bins[view])
        parts.append((HISTOGRAM, view, 0, at, bins[view, at]))
    for kind, view, c, at, total in parts:
        if len(at):
            same = [pa.array(np.full(len(at), v, np.int32)) for v in (kind, view, c)]
            yield pa.RecordBatch.from_arrays([*same, pa.array(at.astype(np.int32)), pa.array(total)], ["kind", "view", "class", "feature", "total"])


def totals(rows: DataFrame, shared: Shared | None) -> tuple[list[np.ndarray], np.ndarray]:
    """Sums of shares by view, class and feature (the last place counts rows), and histograms by view: fixed in size."""
    told = rows.mapInArrow(lambda b: tallied(b, shared), "kind int, view int, class int, feature int, total long")
    got = told.groupBy("kind", "view", "class", "feature").agg(F.sum("total").alias("total")).toArrow()
    kind, view, c, at, total = (got.column(i).to_numpy() for i in range(5))
    sums, bins = [np.zeros((2, n + 1), np.int64) for n in (BUCKETS, META)], np.zeros((2, BINS), np.int64)
    for v in (0, 1):
        m = (kind != HISTOGRAM) & (view == v)
        sums[v][c[m], at[m]] = total[m]
        m = (kind == HISTOGRAM) & (view == v)
        bins[v, at[m]] = total[m]
    return sums, bins


def log_odds(labelled: np.ndarray, given: np.ndarray | None) -> np.ndarray:
    """Naive Bayes: log-odds of each feature from the sums of both classes; what the other view gave weighs PSEUDO of the labelled rows."""
    held = labelled[:, :-1] / UNIT
    if given is not None:
        per_row = given[:, :-1] / UNIT / np.maximum(given[:, -1:], 1)
        held = held + PSEUDO * labelled[:, -1:] * per_row
    p = (held + PRIOR) / (held.sum(axis=1, keepdims=True) + PRIOR * held.shape[1])
    return np.log(p[1]) - np.log(p[0])


def sure_bins(bins: np.ndarray, share: float, prior: float) -> tuple[int, int]:
    """Bins up to and from which a view is sure: the fewest whole bins at either end with `share` of all rows, split as the classes are.

    Rows of one bin are never parted; neither end reaches the median's bin, so that a view that tells nothing apart gives nothing.
    """
    total = int(bins.sum())
    if not total:
        return -1, BINS
    up = np.cumsum(bins)
    middle = int(np.searchsorted(up, (total + 1) // 2))
    low = int(np.searchsorted(up, math.ceil(total * share * (1 - prior))))
    high = int(np.searchsorted(up, total - math.ceil(total * share * prior), "right"))
    return min(low, middle - 1), max(high, middle + 1)


def platt(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Slope (above 0) and shift that make a probability of a logit, by Newton steps on smoothed labels."""
    if not len(x):
        return np.array([1.0, 0.0])
    goal = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
    spread = max(float(x.std()), 1e-6)
    z = np.stack([x / spread, np.ones(len(x))], axis=1)
    w = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        hessian = (z * (p * (1 - p))[:, None]).T @ z + 1e-3 * np.eye(2) * len(x) / 100
        w = w - np.linalg.solve(hessian, z.T @ (p - goal) + 1e-3 * w * len(x) / 100)
    return np.array([max(w[0] / spread, 1e-3), w[1]])


def calibrated(model: Model, logits: list[np.ndarray], y: np.ndarray) -> Model:
    """The model with its views scaled and combined as rows kept aside ask for."""
    scales = np.array([platt(x, y) for x in logits])
    x = np.stack([*(a * v + b for v, (a, b) in zip(logits, scales, strict=True)), np.ones(len(y))], axis=1)
    combine = np.array([0.5, 0.5, 0.0])
    for _ in range(500):
        p = 1 / (1 + np.exp(-np.clip(x @ combine, -30, 30)))
        if len(p):
            combine -= 0.1 * ((p - y) @ x / len(p)) / np.array([4.0, 4.0, 1.0])
    return Model(model.views, scales, combine)


def scored(batches: Iterator[pa.RecordBatch], shared: Shared, calibrate: bool) -> Iterator[pa.RecordBatch]:
    """Probabilities of quality 1, of both views together and of each; to calibrate, the views' bare logits with the label."""
    model = shared.use(lambda x: x)
    chance = lambda x: 1 / (1 + np.exp(-np.clip(x, -30, 30)))
    for batch in batches:
        t, m = Shares.of(batch).logits(model)
        if calibrate:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(t), pa.array(m), batch.column("quality")], ["doc_id", "t", "m", "quality"])
            continue
        t, m = (a * x + b for x, (a, b) in zip((t, m), model.scales, strict=True))
        both = model.combine[0] * t + model.combine[1] * m + model.combine[2]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(chance(x)) for x in (both, t, m))], ["doc_id", "score", "text_score", "meta_score"])


def quality(docs: DataFrame, labels: DataFrame, rounds: int = 3, step: float = 0.1) -> DataFrame:
    """doc_id, held_out, score, predicted, text_score, meta_score of each row of docs(doc_id, text, source, lang).

    score is the probability of quality 1. In round r either view labels about r * step of all unlabelled rows for the
    other. Held-out rows (crc32 of doc_id modulo 3 is 1) give no labels and get no pseudo-labels; labelled rows whose
    crc32 modulo 9 is 6 or 8 are kept aside to calibrate. An id may stand for many rows: each has the id's label, the greatest
    if there are several. Nulls count as empty text and as a source or language of their own; a null doc_id is
    unlabelled. Without labels of both classes every score is 0.5 and predicted 1. Equal rows get equal scores; extra columns are
    left out; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text", "source", "lang", F.coalesce(F.length("text"), F.lit(0)).alias("_length"))
    marked = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg((F.max("quality") > 0).cast("int").alias("quality"))
    kind = dict(docs.dtypes)["doc_id"]
    if marked.limit(MAX_BROADCAST_IDS + 1).count() <= MAX_BROADCAST_IDS:  # else features are shuffled, about two thirds of the texts' bytes
        marked = F.broadcast(marked)
    # Written once, with labels: each later pass reads a few bytes a distinct word instead of the text, and joins nothing.
    features = stage(docs.mapInArrow(coded, _FEATURES.format(kind)).join(marked, "doc_id", "left"))
    learned = features.where(~held_out(F.col("doc_id")))
    known, pool = learned.where("quality is not null"), learned.where("quality is null")
    aside = bucket_of(F.col("doc_id"), 9).isin(6, 8)
    share = lambda *value: Shared(spark, value if len(value) > 1 else value[0], uuid.uuid4().hex)
    labelled, _ = totals(known.where(~aside), None)
    model = Model()
    rows = labelled[0][:, -1]
    if rows.all():
        prior = float(rows[1] / rows.sum())
        model.views = [log_odds(x, None) for x in labelled]
        for r in range(1, rounds + 1):
            _, bins = totals(pool, share(model, None))
            given, _ = totals(pool, share(model, [sure_bins(b, r * step, prior) for b in bins]))
            model = Model([log_odds(x, g) for x, g in zip(labelled, given, strict=True)])
        to_calibrate = share(model)
        checked = known.where(aside).mapInArrow(lambda b: scored(b, to_calibrate, True), f"doc_id {kind}, t double, m double, quality int")
        got = checked.orderBy(F.xxhash64("doc_id", F.lit(17)), "t", "m").limit(CALIBRATION_ROWS).toArrow()
        t, m, y = (got.column(c).to_numpy().astype(float) for c in ("t", "m", "quality"))
        model = calibrated(model, [t, m], y)
    shared = share(model)
    out = features.mapInArrow(lambda b: scored(b, shared, False), f"doc_id {kind}, score double, text_score double, meta_score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "text_score", "meta_score")
