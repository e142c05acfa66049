"""Benchmark decontamination by Wu-Manber search for all windows of all benchmark items at once.

Texts become words in lower case with one space between and around them, so a window of words is a string of bytes. Windows
are searched by classes of length. In a class whose shortest window has m bytes, a table says of each block of bytes how far
the search may move on when the block ends m bytes from where it stands; most blocks stand in no window, and the search
skips nearly m bytes. Where it may not move, the hash of the block and the first bytes select the windows to compare, byte for
byte. The search runs in many lanes of a text at once, as numpy arrays.

Items are cut into pieces that overlap by a window less a word, and pieces are dealt to groups of bounded size: a group is
broadcast, and documents pass it where they lie. Nothing is shuffled, whatever documents and items share.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import stage
from vellum.llm.texts import LETTERS, Shared, chunks, flat

WINDOW = 10
#: Bytes of items in a group and in a piece, on average and at most (a piece holds one window at least).
GROUP_BYTES, PIECE_BYTES = 8 << 20, 64 << 10
#: Bytes of documents that are searched at a time, and of a lane.
CHUNK, LANE = 2 << 20, 512
#: Lengths at which classes of windows begin.
CLASSES = (0, 8, 16, 32)
SPACE, END, TAIL = 32, 10, 8
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


class Words:
    """Texts as bytes: ` word word \\n` each, one after the other, and where their words and they themselves begin."""

    def __init__(self, data: np.ndarray, at: np.ndarray):
        plain = data.tobytes().translate(LETTERS)
        ends = at.tolist()
        out = np.frombuffer(b"".join([b" %b \n" % plain[a:b] for a, b in zip(ends, ends[1:], strict=False)]), np.uint8)
        blank = out == SPACE
        keep = np.ones(len(out), bool)
        keep[1:] = ~(blank[1:] & blank[:-1])
        out = out[keep]
        #: Bytes, with a tail that lets eight bytes be read anywhere.
        self.bytes = np.concatenate([out, np.zeros(TAIL, np.uint8)])
        #: The space before each word.
        self.words = np.flatnonzero((out[:-1] == SPACE) & (out[1:] != END))
        marks = np.flatnonzero(out == END)
        #: The number of the first word of each text, and of all words.
        self.first = np.searchsorted(self.words, np.concatenate([[0], marks + 1]))


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as a number."""
    return np.ndarray(len(data) - TAIL + 1, "<u8", data, strides=(1,))


class Class:
    """The windows of one class of length: at (places in `data`), size."""

    def __init__(self, data: np.ndarray, at: np.ndarray, size: np.ndarray):
        self.m = int(size.min())
        self.block = min(8, max(2, self.m // 2))
        self.mask = np.uint64(2 ** (8 * self.block) - 1)
        self.head = np.uint64(2 ** (8 * min(8, self.m)) - 1)
        self.down = np.uint64(64 - min(24, max(12, int(8 * len(data)).bit_length())))
        last = self.m - self.block
        read = eights(data)
        self.shift = np.full(1 << int(64 - self.down), last + 1, np.uint16)
        for j in range(last + 1):  # later blocks may overwrite earlier ones: they allow less
            self.shift[self._slot(read[at + j])] = last - j
        keys = self._keys(read[at + last], read[at])
        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]

    def _slot(self, eight: np.ndarray) -> np.ndarray:
        return ((eight & self.mask) * _SPREAD) >> self.down

    def _keys(self, block: np.ndarray, start: np.ndarray) -> np.ndarray:
        return ((block & self.mask) * _SPREAD) ^ (start & self.head)

    def candidates(self, read: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(place, number of the window in its class) where block and first bytes agree, in a text of n bytes."""
        at = np.arange(0, n - self.m + 1, LANE)
        end = np.minimum(at + LANE, n - self.m + 1)
        last, still = self.m - self.block, []
        while len(at):
            by = self.shift[self._slot(read[at + last])]
            stop = by == 0
            still.append(at[stop])
            at = at + np.where(stop, 1, by)
            going = at < end
            at, end = at[going], end[going]
        place = np.concatenate([*still, np.zeros(0, np.int64)])
        keys = self._keys(read[place + last], read[place])
        low, high = np.searchsorted(self.keys, keys, "left"), np.searchsorted(self.keys, keys, "right")
        n_each = high - low
        which = np.repeat(low, n_each) + np.arange(n_each.sum()) - np.repeat(np.cumsum(n_each) - n_each, n_each)
        return np.repeat(place, n_each), self.order[which]


class Windows:
    """All windows of pieces of items, each content once, ready to be searched for."""

    def __init__(self, pieces: list[bytes], items: list[str], window: int = WINDOW):
        self.names = sorted(set(items))
        number = {name: i for i, name in enumerate(self.names)}
        words = Words(np.frombuffer(b"".join(pieces), np.uint8), np.cumsum([0, *map(len, pieces)]))
        self.bytes = words.bytes
        ends = np.append(words.words[1:], len(self.bytes))
        per = np.diff(words.first)
        # Word i begins a window unless fewer than a window's words follow in its piece; of a shorter piece, the first word does.
        piece = np.repeat(np.arange(len(pieces)), per)
        behind = words.first[1:][piece] - np.arange(len(piece))
        first = np.flatnonzero((behind >= window) | (behind == per[piece]))
        count = np.minimum(window, behind[first])
        at = words.words[first]
        stop = ends[first + count - 1]
        # The last word of a piece is followed by its closing space, then by the end mark.
        closing = behind[first] == count
        marks = np.flatnonzero(self.bytes == END)
        stop[closing] = marks[piece[first[closing]]] - 1
        size = stop - at + 1
        item = np.array([number[x] for x in items], np.int64)[piece[first]]
        view = memoryview(self.bytes)
        digest = np.array([xxhash.xxh3_128_intdigest(view[a : a + s]).to_bytes(16, "big") for a, s in zip(at.tolist(), size.tolist(), strict=True)], "S16") if len(at) else np.zeros(0, "S16")
        # Equal contents become one window; the digest is taken together with the length.
        _, one, self.of = np.unique(np.rec.fromarrays([digest, size]), return_index=True, return_inverse=True)
        self.at, self.size, self.count = at[one], size[one], count[one]
        pairs = np.unique(np.stack([self.of.ravel(), item]), axis=1) if len(at) else np.zeros((2, 0), np.int64)
        self.item, self.item_at = pairs[1], np.searchsorted(pairs[0], np.arange(len(one) + 1))
        self.classes = []
        for low, high in zip(CLASSES, (*CLASSES[1:], 2**62), strict=True):
            mine = np.flatnonzero((self.size >= low) & (self.size < high))
            if len(mine):
                self.classes.append((mine, Class(self.bytes, self.at[mine], self.size[mine])))

    def find(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, window) of all occurrences in bytes that Words made."""
        n, read, own = len(text) - TAIL, eights(text), eights(self.bytes)
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for mine, of_length in self.classes:
            place, which = of_length.candidates(read, n)
            which = mine[which]
            fits = place + self.size[which] <= n
            place, which = place[fits], which[fits]
            done = 0
            while len(place):  # eight bytes at a time; the last eight may overlap those before
                size = self.size[which]
                step = np.clip(size - 8, 0, done)
                short = np.minimum(size, 8).astype(np.uint64) * np.uint64(8)
                mask = np.where(short == 64, ~np.uint64(0), (np.uint64(1) << (short % np.uint64(64))) - np.uint64(1))
                same = ((read[place + step] ^ own[self.at[which] + step]) & mask) == 0
                place, which, size = place[same], which[same], size[same]
                done += 8
                whole = size <= done
                found.append((place[whole], which[whole]))
                place, which = place[~whole], which[~whole]
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def hits(batch: pa.RecordBatch, windows: Windows) -> tuple[pa.Array, pa.Array, pa.Array]:
    """n_words, spans (of words that stand in an occurrence, from the first to before `end`) and items of each text of the batch; those found before are kept."""
    data, at = flat(batch.column("text"))
    before = [(batch.column(c).to_pylist() if c in batch.schema.names else [[]] * batch.num_rows) for c in ("spans", "items")]
    n_words, spans, items = [], [], []
    for i, j in chunks(at, CHUNK):
        words = Words(data[at[i] : at[j]], at[i : j + 1] - at[i])
        place, which = windows.find(words.bytes)
        n = len(words.words)
        text = np.searchsorted(words.first, np.searchsorted(words.words, place), "right") - 1
        cover = np.zeros(n + 1, np.int64)
        begin = np.searchsorted(words.words, place)
        np.add.at(cover, begin, 1)
        np.add.at(cover, begin + windows.count[which], -1)
        for k in range(i, j):
            for s in before[0][k]:
                cover[words.first[k - i] + s["first"]] += 1
                cover[words.first[k - i] + s["end"]] -= 1
        hit = np.cumsum(cover)[:n] > 0
        starts = np.zeros(n + 1, bool)
        starts[words.first] = True
        opens = np.flatnonzero(hit & (starts[:n] | ~np.append(False, hit[:-1])[:n]))
        closes = np.flatnonzero(hit & (starts[1:] | ~np.append(hit[1:], False)[:n])) + 1
        of = np.searchsorted(words.first, opens, "right") - 1
        got: dict[int, set] = {}
        pairs = np.unique(np.stack([text, which]), axis=1)
        for t, w in pairs.T.tolist():
            got.setdefault(t, set()).update(windows.item[windows.item_at[w] : windows.item_at[w + 1]].tolist())
        n_words += np.diff(words.first).tolist()
        mine: list[list] = [[] for _ in range(i, j)]
        for t, a, b in zip(of.tolist(), (opens - words.first[of]).tolist(), (closes - words.first[of]).tolist(), strict=True):
            mine[t].append({"first": a, "end": b})
        spans += mine
        items += [sorted({windows.names[x] for x in got.get(k - i, ())} | set(before[1][k])) for k in range(i, j)]
    return pa.array(n_words, pa.int64()), pa.array(spans, pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))), pa.array(items, pa.list_(pa.string()))


def searched(batches: Iterator[pa.RecordBatch], sent: Shared, window: int, last: bool) -> Iterator[pa.RecordBatch]:
    windows = sent.use(lambda group: Windows(*group, window))
    for batch in batches:
        columns = [batch.column("doc_id"), *hits(batch, windows)] + ([] if last else [batch.column("text")])
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "spans", "items", "text"][: len(columns)])


def cut(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Pieces of items: words with one space between; neighbours share all but one of a window's words."""
    for batch in batches:
        data, at = flat(batch.column("text"))
        out: list[tuple] = []
        for item, a, b in zip(batch.column("item_id").to_pylist(), at[:-1], at[1:], strict=True):
            words = data[a:b].tobytes().translate(LETTERS).split()
            i = 0
            while i < len(words):
                j, size = i, 0
                while j < len(words) and (size < PIECE_BYTES or j - i < window):
                    size += len(words[j]) + 1
                    j += 1
                out.append((item, b" ".join(words[i:j])))
                i = len(words) if j == len(words) else j - window + 1
        yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in ((0, pa.string()), (1, pa.binary()))], ["item_id", "piece"])


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, spans, items, contaminated of docs(doc_id, text), searched for what benchmark(item_id, text) holds.

    A window is `window` words of an item in a row, or all words of an item of fewer. spans are the runs of document words
    inside occurrences of windows, n_hit their number of words, items the ids of items with an occurring window, as text,
    each once and sorted. Null and empty texts have no words and no hits. Every row is one document, equal ids or not;
    rows of the benchmark with one item_id are one item with the windows of each; a null item_id counts as the empty id. Without
    items, nothing is contaminated; without documents, the result is empty. One window must fit a task's memory.
    """
    spark = docs.sparkSession
    cast = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text")
    pieces = stage(cast.mapInArrow(lambda b: cut(b, window), "item_id string, piece binary").distinct())
    groups = max(1, -(-(pieces.agg(F.sum(F.length("piece"))).first()[0] or 0) // group_bytes))
    rows = docs.select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    for g in range(groups):
        mine = pieces.where(F.pmod(F.xxhash64("item_id", "piece"), F.lit(groups)) == g).toArrow()
        sent = Shared(spark, (mine.column("piece").to_pylist(), mine.column("item_id").to_pylist()), f"windows {uuid.uuid4().hex}")
        last = g == groups - 1
        task = lambda b, sent=sent, last=last: searched(b, sent, window, last)
        rows = rows.mapInArrow(task, f"doc_id {kind}, n_words long, spans array<struct<first:long,end:long>>, items array<string>" + ("" if last else ", text string"))
        rows = rows if last else stage(rows)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["first"])
    return rows.select("doc_id", "n_words", n_hit.alias("n_hit"), "spans", "items", (F.size("spans") > 0).alias("contaminated"))
