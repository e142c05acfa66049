"""Language identification as a mixture, fitted to each document by expectation-maximisation.

Each learned language gives every word a likelihood, from hashed byte trigrams of its letters. A document is a
mixture of languages; expectation-maximisation over its words estimates the proportions. The set of languages is
chosen by penalised likelihood: a language enters while it raises the likelihood by more than half of
penalty * log(words). The document's language is that of the largest proportion.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import held_out
from vellum.llm.texts import Rows, Shared

#: Labelled rows per language that the likelihoods are fitted on, drawn by a hash of doc_id.
FIT_ROWS = 1_500
#: Languages that can be told apart; a corpus with more is refused.
MAX_LANGUAGES = 500
BUCKETS = 1 << 16
UNKNOWN = "und"


def words_of(text: str | None) -> list[bytes]:
    return text.lower().encode("utf-8", "surrogatepass").split() if text else []


def letters(word: bytes) -> bytes:
    s = word.decode("utf-8", "replace")
    return (s if s.isalpha() else "".join(c for c in s if c.isalpha())).encode()


def grams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the trigrams of words given as letters, with a mark at either end, and how many each word has."""
    flat = np.frombuffer(b"".join([b" %b " % w for w in words]), np.uint8).astype(np.uint32)
    sizes = np.array([len(w) + 2 for w in words], np.int64)
    codes = (flat[:-2] << np.uint32(16)) | (flat[1:-1] << np.uint32(8)) | flat[2:] if len(flat) > 2 else np.zeros(0, np.uint32)
    buckets = ((codes * np.uint32(2654435761)) >> np.uint32(16)).astype(np.int64)
    ends = np.cumsum(sizes)
    inside = np.ones(len(buckets), bool)
    for back in (1, 2):
        at = ends - back
        inside[at[at < len(buckets)]] = False
    return buckets[inside], sizes - 2


class Likelihoods:
    """Log-likelihood of each language for words, and whether a word has a letter, as rows."""

    def __init__(self, model: tuple[list[str], np.ndarray]):
        self.langs, table = model
        self.table = np.concatenate([table, np.ones((len(table), 1), np.float32)], axis=1)
        self.rows = Rows(self._make, len(self.langs) + 1)

    def _make(self, words: list[bytes]) -> np.ndarray:
        own = [letters(w) for w in words]
        out = np.zeros((len(words), len(self.langs) + 1), np.float32)
        some = [i for i, w in enumerate(own) if w]
        if some:
            buckets, sizes = grams([own[i] for i in some])
            out[some] = np.add.reduceat(self.table[buckets], np.concatenate([[0], np.cumsum(sizes)[:-1]]))
        return out


def learn(counts: dict[str, Counter]) -> tuple[list[str], np.ndarray]:
    """Languages in order and the log-probabilities (buckets x languages) of their trigrams, smoothed."""
    langs = sorted(counts)
    table = np.zeros((BUCKETS, len(langs)), np.float32)
    for k, lang in enumerate(langs):
        own: Counter = Counter()
        for w, n in counts[lang].items():
            if x := letters(w):
                own[x] += n
        if own:
            buckets, sizes = grams(list(own))
            n = np.bincount(buckets, np.repeat(np.fromiter(own.values(), float), sizes), BUCKETS)
        else:
            n = np.zeros(BUCKETS)
        table[:, k] = np.log((n + 0.1) / (n.sum() + 0.1 * BUCKETS))
    return langs, table


def mixture(like: np.ndarray, counts: np.ndarray, start: np.ndarray, rounds: int = 12) -> tuple[np.ndarray, float]:
    """Proportions and log-likelihood of the mixture of the columns of like (words x languages, scaled) by EM."""
    share, total = start, counts.sum()
    for _ in range(rounds):
        joint = like * share
        each = joint.sum(axis=1)
        new = (counts / each) @ joint / total
        if np.abs(new - share).max() < 1e-3:
            share = new
            break
        share = new
    return share, float(counts @ np.log((like * share).sum(axis=1)))


def proportions(logs: np.ndarray, penalty: float) -> tuple[np.ndarray, float]:
    """Proportion of each language, zero outside the chosen set, and how sure the likelihoods are of the first one.

    logs: a row of log-likelihoods for each word of the document, repeated words repeated.
    """
    n, k = logs.shape
    alone = logs.sum(axis=0)
    order = np.argsort(-alone, kind="stable")
    share = np.zeros(k)
    best = int(order[0])
    share[best] = 1.0
    sure = 1.0 if k == 1 else float(1 / (1 + np.exp(-min(float(alone[best] - alone[order[1]]), 700.0))))
    if k == 1:
        return share, sure
    top = logs.max(axis=1)
    like = np.maximum(np.exp(logs - top[:, None]), 1e-9)
    price = 0.5 * penalty * np.log(max(n, 2))
    # No set does better than the best language of each word.
    single = float(np.log(like[:, best]).sum())
    if -single <= price:
        return share, sure
    ones = np.ones(n)
    part, full = mixture(like, ones, np.where(share > 0, 0.7, 0.3 / (k - 1)))
    # The likelihood is concave: wherever the mixture stopped, the best one is worth no more than the steepest way up from there.
    steepest = float((like / (like @ part)[:, None]).sum(axis=0).max()) - n
    if full + max(steepest, 0.0) - single <= price:
        return share, sure
    chosen, value = [best], single
    while len(chosen) < k:
        tries = []
        for other in (c for c in range(k) if c not in chosen):
            own = [*chosen, other]
            part, v = mixture(like[:, own], ones, np.full(len(own), 1 / len(own)))
            tries.append((v, -other, own, part))
        v, _, own, part = max(tries, key=lambda t: t[:2])
        if v - value <= price:
            break
        chosen, value = own, v
        share = np.zeros(k)
        share[own] = part
    return share, sure


def predicted(batches: Iterator[pa.RecordBatch], shared: Shared, penalty: float) -> Iterator[pa.RecordBatch]:
    model = shared.use(Likelihoods)
    names = model.langs
    for batch in batches:
        langs, scores, shares = [], [], []
        for text in batch.column("text").to_pylist():
            rows = model.rows(words_of(text)) if names else np.zeros((0, 1))
            rows = rows[rows[:, -1] > 0][:, :-1].astype(np.float64)
            if not len(rows):
                langs.append(UNKNOWN)
                scores.append(0.0)
                shares.append([])
                continue
            share, sure = proportions(rows, penalty)
            first = int(share.argmax())
            langs.append(names[first])
            scores.append(float(share[first]) * sure)
            shares.append([(names[i], float(share[i])) for i in np.flatnonzero(share > 0)])
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(shares, pa.map_(pa.string(), pa.float64()))],
            ["doc_id", "lang_pred", "score", "shares"],
        )


def fit(docs: DataFrame, rows: int = FIT_ROWS) -> tuple[list[str], np.ndarray]:
    """Likelihoods from about `rows` rows of each language among those not held out; from all where there are fewer."""
    known = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r[0]: r[1] for r in known.groupBy("lang").count().limit(MAX_LANGUAGES + 1).collect()}
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not sizes:
        return [], np.zeros((BUCKETS, 0), np.float32)
    share = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, rows / n))])
    drawn = known.where(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1_000_000)) < share[F.col("lang")] * 1_000_000)
    counted = drawn.select("lang", "text").mapInArrow(_counted, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    counts: dict[str, Counter] = {lang: Counter() for lang in sizes}
    for lang, word, n in counted.toLocalIterator(prefetchPartitions=True):
        counts[lang][bytes(word)] += n
    return learn(counts)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts: dict[str, Counter] = {}
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            counts.setdefault(lang, Counter()).update(words_of(text))
        rows = [(lang, w, n) for lang, c in counts.items() for w, n in c.items()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.int64())], ["lang", "word", "n"]
        )


def languages(docs: DataFrame, rows: int = FIT_ROWS, penalty: float = 4.0) -> DataFrame:
    """doc_id, held_out, lang_pred, score and shares (language -> proportion) of each row of docs(doc_id, text, lang).

    lang is read for learning alone. Null texts and texts without a letter are `und`, with score 0 and no shares, as
    is all text if nothing could be learned. Equal texts get equal results; ties go to the first language by name.
    Extra columns are left out; an empty table gives an empty result.
    """
    docs = docs.select("doc_id", "text", "lang")
    shared = Shared(docs.sparkSession, fit(docs, rows), uuid.uuid4().hex)  # BUCKETS x MAX_LANGUAGES numbers at most
    kind = dict(docs.dtypes)["doc_id"]
    out = docs.select("doc_id", "text").mapInArrow(
        lambda b: predicted(b, shared, penalty), f"doc_id {kind}, lang_pred string, score double, shares map<string,double>"
    )
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "shares")
