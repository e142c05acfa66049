"""Language-model scoring by prediction by partial matching over bytes, beside a unigram model of words.

The corpus gives the counts of all byte contexts of up to `DEPTH` bytes with the byte that follows, over the stream
of lower-cased words, each followed by a space, the last by an end mark. They are a trie: a context's suffix is its
parent. A byte has the probability that its longest known context gives it; if it never followed there, the context
escapes (method C: as often as it has different followers) to its suffix, where the followers of the longer context
are excluded, and so on down to the bytes never seen. A text's score is the sum of the logarithms, its code length.

Counts are summed by Spark over all training rows, and none is left out. Up to `nodes` nodes, the trie goes to the
executors whole. Of a larger one they get the `nodes` most frequent of the deepest followers with their logarithms; what
a text has besides is answered by shuffles from the full counts. Word counts alike: the `head` most frequent go to the
executors, the rest are joined by a shuffle.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
import xxhash

from vellum.llm.common import bucket_of, stage
from vellum.llm.texts import U64, Rows, Shared, lower_words, mix

DEPTH = 5
END = b"\n"  # never in a word
#: Most nodes, and most words, that are broadcast; the others are answered by shuffles.
NODES = 2_000_000
HEAD = 1_000_000
CHUNK = 2_000_000
#: Texts handled at once; their numbers stand above a code's 48 bits.
TEXTS = 1 << 14
#: Logarithms from the shuffle are summed as whole numbers of this part, so that their order does not matter.
UNIT = 1e-9


def word_hash(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word) - 2**63


END_HASH = word_hash(END)


def codes(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Each byte of the texts' streams with the DEPTH bytes before it, as one number, and how many each text has."""
    parts = [b" ".join(w) + END for w in texts]
    flat = np.frombuffer(b"".join([END * DEPTH + p for p in parts]), np.uint8).astype(np.int64)
    sizes = np.array([len(p) for p in parts], np.int64)
    code = np.zeros(len(flat) - DEPTH, np.int64)
    for j in range(DEPTH + 1):
        code = (code << 8) | flat[j : j + len(code)]
    keep = np.ones(len(code), bool)
    begins = np.cumsum(sizes + DEPTH)[:-1] - DEPTH  # windows that end in the next text's padding
    for j in range(DEPTH):
        keep[begins + j] = False
    return code[keep], sizes


def batched(texts: Iterable[str | None], size: int = CHUNK) -> Iterator[list[list[bytes]]]:
    """Words of texts, about size bytes of them at a time."""
    held, n = [], 0
    for t in map(lower_words, texts):
        held.append(t)
        n += len(t) * 7
        if n >= size or len(held) >= TEXTS:
            yield held
            held, n = [], 0
    if held:
        yield held


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of words (order -1) and of byte contexts with their follower (order DEPTH) in these rows."""
    words: Counter = Counter()

    def rows(order: int, keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), order, np.int8)), pa.array(keys), pa.array(n)], ["depth", "key", "n"])

    def flush() -> pa.RecordBatch:
        out = rows(-1, np.fromiter(map(word_hash, words), np.int64, len(words)), np.fromiter(words.values(), np.int64, len(words)))
        words.clear()
        return out

    for batch in batches:
        for part in batched(batch.column("text").to_pylist()):
            for w in part:
                words.update(w)
            words[END] += len(part)
            if len(words) > 300_000:
                yield flush()
            yield rows(DEPTH, *np.unique(codes(part)[0], return_counts=True))
    yield flush()


class Table:
    """Codes with a value each, hashed."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.slots = 1 << max(int(np.ceil(np.log2(max(2 * len(keys), 2)))), 4)
        self.table, self.value = np.full(self.slots, -1, np.int64), np.zeros(self.slots, np.float32)
        place, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            free = left[self.table[place[left]] == -1]
            self.table[place[free]] = keys[free]
            won = free[self.table[place[free]] == keys[free]]
            self.value[place[won]] = values[won]
            left = np.setdiff1d(left, won, assume_unique=True)
            place[left] = (place[left] + 1) & (self.slots - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(U64) * U64(0x9E3779B97F4A7C15)) >> U64(64 - self.slots.bit_length() + 1)).astype(np.int64)

    def look(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values (0 for codes that are not there), and where the codes are that are not there."""
        out = np.zeros(len(code), np.float64)
        place, left = self._slot(code), np.arange(len(code))
        missed = [np.zeros(0, np.int64)]
        while len(left):
            got = self.table[place[left]]
            hit = got == code[left]
            out[left[hit]] = self.value[place[left[hit]]]
            missed.append(left[got == -1])
            left = left[~hit & (got != -1)]
            place[left] = (place[left] + 1) & (self.slots - 1)
        return out, np.concatenate(missed)


class Trie:
    """Log10 probabilities from counts of (context, follower) at each depth."""

    def __init__(self, depth: np.ndarray, key: np.ndarray, n: np.ndarray):
        self.keys, self.logs, self.contexts = [], [], []
        counts = []
        for d in range(DEPTH + 1):
            own = depth == d
            order = np.argsort(key[own], kind="stable")
            k, c = key[own][order], n[own][order].astype(np.float64)
            context, first = np.unique(k >> 8, return_index=True)
            total = np.add.reduceat(c, first) if len(k) else np.zeros(0)
            kinds = np.diff(np.concatenate([first, [len(k)]])).astype(float) if len(k) else np.zeros(0)
            counts.append(c)
            self.keys.append(k)
            self.logs.append(np.log10(c))
            # Columns: log of the denominator and of the escape; the same in the parent, with these followers excluded.
            known = np.stack([np.log10(total + kinds), np.log10(kinds / (total + kinds)), total * 0, total * 0], axis=1) if len(k) else np.zeros((0, 4))
            if d and len(k):
                up, _ = self._find(self.keys[d - 1], k & ((1 << (8 * d)) - 1))
                gone = np.add.reduceat(counts[d - 1][up], first)
                at, _ = self._find(self.contexts[d - 1][0], context & ((1 << (8 * (d - 1))) - 1))
                total_up, kinds_up = self._totals[0][at] - gone, self._totals[1][at] - kinds
                some = kinds_up > 0
                room = np.where(some, total_up + kinds_up, 1.0)
                known[:, 2] = np.log10(room)
                known[:, 3] = np.where(some, np.log10(np.where(some, kinds_up, 1) / room), 0.0)
            self._totals = (total, kinds)
            self.contexts.append((context, known))
        seen = len(self.keys[0])
        self.floor = -np.log10(max(256 - seen, 1))
        # The deepest contexts answer most bytes at once, from a hash table.
        top, (context, known) = self.keys[DEPTH], self.contexts[DEPTH]
        at = self._find(context, top >> 8)[0] if len(top) else np.zeros(0, np.int64)
        logp = (self.logs[DEPTH] - known[at, 0]) if len(top) else np.zeros(0)
        self.deepest = Table(top, logp)

    @staticmethod
    def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(keys):
            return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return at, keys[at] == wanted

    def log_probabilities(self, code: np.ndarray) -> np.ndarray:
        out, miss = self.deepest.look(code)
        if len(miss):
            unique, inverse = np.unique(code[miss], return_inverse=True)
            out[miss] = self._escaping(unique)[inverse]
        return out

    def look(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As in Table; a whole trie has no code that is not there."""
        return self.log_probabilities(code), np.zeros(0, np.int64)

    def _escaping(self, code: np.ndarray) -> np.ndarray:
        """From the longest context down, for bytes that the deepest context doesn't hold."""
        out, left = np.zeros(len(code)), np.arange(len(code))
        above = np.zeros((len(code), 2))  # log denominator and escape under exclusion; valid where an upper context was known
        under = np.zeros(len(code), bool)
        for d in range(DEPTH, -1, -1):
            if not len(left):
                break
            c = code[left]
            at, known = self._find(self.contexts[d][0], (c >> 8) & ((1 << (8 * d)) - 1))
            place, found = self._find(self.keys[d], c & ((1 << (8 * (d + 1))) - 1))
            if not known.any():
                continue
            values = self.contexts[d][1][at]
            room = np.where(under[left], above[left, 0], values[:, 0])
            escape = np.where(under[left], above[left, 1], values[:, 1])
            out[left] += np.where(known, np.where(found, (self.logs[d][place] if len(self.logs[d]) else 0.0) - room, escape), 0.0)
            go = left[known & ~found]
            above[go] = values[known & ~found, 2:]
            under[go] = True
            left = left[~found]
        out[left] += self.floor
        return out


def scored(batches: Iterator[pa.RecordBatch], shared: Shared) -> Iterator[pa.RecordBatch]:
    """Per row: tokens, what the head words add to the base, the words outside the head; the score and the codes outside it."""
    known_codes, rows = shared.use(lambda v: (Trie(*v["trie"]) if "trie" in v else Table(*v["codes"]), Rows(_head(v["head"]), 1, kind=np.float64)))
    part, count = TaskContext.get().partitionId(), 0
    for batch in batches:
        at = 0
        for texts in batched(batch.column("text").to_pylist()):
            code, sizes = codes(texts)
            logs, miss = known_codes.look(code)
            scores = np.add.reduceat(logs, np.concatenate([[0], np.cumsum(sizes)[:-1]]))
            # A text's codes that are answered later, each once with how often it occurs.
            missed, often = np.unique((np.repeat(np.arange(len(sizes)), sizes)[miss] << 8 * (DEPTH + 1)) | code[miss], return_counts=True)
            ends = pa.array(np.searchsorted(missed, np.arange(len(sizes) + 1) << 8 * (DEPTH + 1)).astype(np.int32))
            missed &= (1 << 8 * (DEPTH + 1)) - 1
            tokens, known, base, tail, times = [], [], [], [], []
            for words in texts:
                values = rows([*words, END])[:, 0]
                head = values > 0
                tokens.append(len(words) + 1)
                known.append(int(head.sum()))
                base.append(float(np.log10(values[head] + 0.1).sum()))
                rest = Counter([words[i] for i in np.flatnonzero(~head[:-1])])
                tail.append([word_hash(w) for w in rest] + [END_HASH] * (not head[-1]))
                times.append([*rest.values()] + [1] * (not head[-1]))
            n = len(texts)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").slice(at, n),
                    pa.array((part << 33) + count + np.arange(n, dtype=np.int64)),
                    *(pa.array(x, pa.int64()) for x in (tokens, known)),
                    pa.array(base, pa.float64()),
                    pa.array(scores),
                    pa.array(tail, pa.list_(pa.int64())),
                    pa.array(times, pa.list_(pa.int64())),
                    pa.ListArray.from_arrays(ends, pa.array(missed, pa.int64())),
                    pa.ListArray.from_arrays(ends, pa.array(often, pa.int64())),
                ],
                ["doc_id", "row", "n_tokens", "known", "base", "score", "tail", "times", "codes", "often"],
            )
            count, at = count + n, at + n


def _head(head: tuple[np.ndarray, np.ndarray]):
    keys, counts = head

    def values(words: list[bytes]) -> np.ndarray:
        wanted = np.fromiter(map(word_hash, words), np.int64, len(words))
        at, found = Trie._find(keys, wanted)
        return np.where(found, counts[at] if len(counts) else 0, 0)[:, None]

    return values


def at_least(counts: DataFrame, most: int) -> int:
    """The least count such that no more than `most` rows have it; counts themselves never leave the executors."""
    by = counts.groupBy(F.least("n", F.lit(100_000)).alias("n")).agg(F.count(F.lit(1)).alias("m")).collect()  # 100,000 rows at most
    total, least = 0, 100_001
    for n, m in sorted(((r[0], r[1]) for r in by), reverse=True):
        if total + m > most:
            break
        total, least = total + m, n
    return least


def every(key: Column) -> Column:
    """A code's nodes at all depths: (depth, key)."""
    return F.explode(F.array(*[F.struct(F.lit(d).cast("byte").alias("depth"), key.bitwiseAND(F.lit((1 << 8 * (d + 1)) - 1)).alias("key")) for d in range(DEPTH + 1)]))


def known_contexts(trie: DataFrame) -> DataFrame:
    """Per (depth, context) of the counts: logs of the denominator and of the escape; the same in the parent, with these followers excluded.

    Whatever is joined here has at most 256 rows a key.
    """
    below = trie.select((F.col("depth") + 1).alias("depth"), F.col("key").alias("up"), F.col("n").alias("n_up"))
    nodes = trie.withColumn("up", F.expr("key & (shiftleft(1L, 8 * depth) - 1)")).join(below, ["depth", "up"], "left")
    found = nodes.groupBy("depth", F.shiftright("key", 8).alias("context")).agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds"), F.sum("n_up").alias("gone"))
    parent = found.select((F.col("depth") + 1).alias("depth"), F.col("context").alias("up"), F.col("total").alias("total_up"), F.col("kinds").alias("kinds_up"))
    found = found.withColumn("up", F.expr("CASE WHEN depth > 0 THEN context & (shiftleft(1L, 8 * (depth - 1)) - 1) END")).join(parent, ["depth", "up"], "left")
    left = F.col("kinds_up") - F.col("kinds")
    room = F.col("total_up") - F.col("gone") + left
    return found.select(
        "depth",
        "context",
        F.log10(F.col("total") + F.col("kinds")).alias("room"),
        F.log10(F.col("kinds") / (F.col("total") + F.col("kinds"))).alias("escape"),
        F.when(left > 0, F.log10(room)).otherwise(0.0).alias("room_up"),
        F.when(left > 0, F.log10(left / room)).otherwise(0.0).alias("escape_up"),
    )


def escaping(code: DataFrame, trie: DataFrame, contexts: DataFrame, floor: float) -> DataFrame:
    """(key, log) of distinct codes(key): Trie's probabilities from tables, a depth at a time; again at most 256 rows a key."""
    asked = code.select(every(F.col("key")).alias("x")).select("x.depth", "x.key").distinct().withColumn("context", F.shiftright("key", 8))
    asked = stage(asked.join(trie, ["depth", "key"], "left").join(contexts, ["depth", "context"], "left").drop("context"))
    # first: the log of the probability from this depth on; after: what comes below this depth, if the byte is not found at it.
    lower = None
    for d in range(DEPTH + 1):
        own = asked.where(F.col("depth") == d).drop("depth")
        if lower is None:
            own = own.withColumns({"first_below": F.lit(floor), "after": F.lit(floor)})
        else:
            own = own.withColumn("up", F.col("key").bitwiseAND(F.lit((1 << 8 * d) - 1))).join(lower, "up")
            own = own.withColumn("after", F.when(F.col("n_below").isNotNull(), F.log10("n_below") - F.col("room_up")).otherwise(F.col("escape_up") + F.col("after_below")))
        first = F.when(F.col("room").isNull(), F.col("first_below")).when(F.col("n").isNotNull(), F.log10("n") - F.col("room")).otherwise(F.col("escape") + F.col("after"))
        own = own.select("key", "n", first.alias("log"), "after")
        lower = own.select(F.col("key").alias("up"), F.col("n").alias("n_below"), F.col("log").alias("first_below"), F.col("after").alias("after_below"))
    return own.select("key", "log")


def score(docs: DataFrame, train: Column | None = None, nodes: int = NODES, head: int = HEAD) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of each row of docs(doc_id, text).

    Null text counts as empty: its one token is the end. train says which rows are learned from (all others are only
    scored); without any, bytes are uniform and base_score is 0 words known of 0. Rows are scored one by one, equal
    texts alike; a null doc_id is kept. Extra columns are left out; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    learned = docs if train is None else docs.where(train)
    raw = learned.select("text").mapInArrow(counted, "depth byte, key long, n long")
    counts = stage(raw.groupBy("depth", "key").agg(F.sum("n").alias("n")))
    words = counts.where("depth = -1").select("key", "n")
    total, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    deep = counts.where(F.col("depth") == DEPTH)
    trie = stage(deep.select(every(F.col("key")).alias("x"), "n").groupBy("x.depth", "x.key").agg(F.sum("n").alias("n")))
    whole = trie.count() <= nodes
    if whole:
        kept = trie.toArrow()  # at most `nodes` rows
        model = {"trie": tuple(kept.column(c).to_numpy() for c in ("depth", "key", "n"))}
    else:
        contexts = stage(known_contexts(trie))
        deepest = contexts.where(F.col("depth") == DEPTH).select("context", "room")
        exact = stage(deep.withColumn("context", F.shiftright("key", 8)).join(deepest, "context").select("key", "n", (F.log10("n") - F.col("room")).alias("log")))
        kept = exact.where(F.col("n") >= at_least(exact, nodes)).select("key", "log").toArrow()  # at most `nodes` rows
        model = {"codes": tuple(kept.column(c).to_numpy() for c in ("key", "log"))}
    top = words.where(F.col("n") >= at_least(words, head)).orderBy("key").toArrow()  # at most `head` rows
    model["head"] = tuple(top.column(c).to_numpy() for c in ("key", "n"))
    shared = Shared(spark, model, uuid.uuid4().hex)
    kind = dict(docs.dtypes)["doc_id"]
    made = stage(
        docs.mapInArrow(
            lambda b: scored(b, shared),
            f"doc_id {kind}, row long, n_tokens long, known long, base double, score double, tail array<long>, times array<long>, codes array<long>, often array<long>",
        )
    )
    rest = made.select("row", F.explode(F.arrays_zip("tail", "times")).alias("t")).select("row", "t.tail", "t.times")
    rest = rest.join(words, rest["tail"] == words["key"], "left").groupBy("row").agg(
        F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("more"),
        F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + 0.1)).alias("added"),
    )
    if whole:
        made = made.withColumn("escaped", F.lit(0.0))
    else:
        asked = made.select("row", F.explode(F.arrays_zip("codes", "often")).alias("c")).select("row", F.col("c.codes").alias("key"), "c.often")
        answers = exact.select("key", "log")
        floor = -float(np.log10(max(256 - trie.where("depth = 0").count(), 1)))
        answers = answers.unionByName(escaping(asked.select("key").distinct().join(answers, "key", "left_anti"), trie, contexts, floor))
        asked = asked.join(answers, "key").groupBy("row").agg((F.sum(F.col("often") * F.round(F.col("log") / UNIT).cast("long")) * UNIT).alias("escaped"))
        made = made.join(asked, "row", "left")
    room = float(np.log10(total + 0.1 * (distinct + 1)))
    return made.drop("tail", "times", "codes", "often").join(rest, "row", "left").select(
        "doc_id",
        "n_tokens",
        (F.col("known") + F.coalesce("more", F.lit(0))).cast("long").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("added", F.lit(0.0)) - F.col("n_tokens") * room).alias("base_score"),
        (F.col("score") + F.coalesce("escaped", F.lit(0.0))).alias("score"),
    )


def held_out_score(docs: DataFrame, **options) -> DataFrame:
    """score() learned from rows whose crc32 modulo 10 is not 0, with held_out for the others."""
    train = bucket_of(F.col("doc_id"), 10) != 0
    out = score(docs, train, **options)
    return out.select("doc_id", (bucket_of(F.col("doc_id"), 10) == 0).alias("held_out"), *out.columns[1:])
