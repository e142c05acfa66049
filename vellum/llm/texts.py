"""Numpy and Arrow views of text columns, for functions that run inside tasks."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

U64 = np.uint64
#: Words in one generation of a memo.
MEMO = 80_000

#: For bytes.translate(): ASCII letters in lower case, digits and what is not ASCII stay; all else becomes space.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 0x80 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))

_RESIDENT: dict = {}


def give_back() -> None:
    """Free memory goes back to the system: workers are reused, and what one task freed would stay with its worker."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not every C library has it
        pass


def resident(key: str, make):
    """What a worker keeps from task to task: one thing at a time, so that operators don't add up in its memory."""
    if key not in _RESIDENT:
        _RESIDENT.clear()
        give_back()
        _RESIDENT[key] = make()
        give_back()  # what making it took
    return _RESIDENT[key]


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text column one after the other, and where each text begins (one more than texts); null: empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def chunks(at: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about so many bytes in all; a longer text is a range of its own."""
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + size, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def lower_words(text: str | None) -> list[bytes]:
    """Words of the text with A-Z in lower case. bytes.split() knows exactly the ASCII white space, \\x09-\\x0D and space."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


class Memo(dict):
    """Word -> value, made by `make` at first sight; at most twice `limit` words, those not seen lately go first."""

    def __init__(self, make, limit: int = MEMO):
        super().__init__()
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, word):
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        value = self.old.get(word)
        if value is None:
            value = self.make(word)
        self[word] = value
        return value


def word_hashes() -> Memo:
    return resident("word hashes", lambda: Memo(xxhash.xxh3_64_intdigest))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> U64(32))
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    return x


class Rows:
    """Words -> rows of numbers, made in batches by `make`; emptied when it holds `limit` words."""

    def __init__(self, make, width: int, limit: int = 120_000, kind=np.float32):
        self.make, self.limit, self.at = make, limit, {}
        self.rows = np.zeros((8192, width), kind)

    def __call__(self, words: list[bytes]) -> np.ndarray:
        """One row for each word."""
        got = list(map(self.at.get, words))
        if None in got:
            new = list({w for w, i in zip(words, got, strict=True) if i is None})
            if len(self.at) + len(new) > self.limit:
                self.at, new = {}, list(set(words))
            first = len(self.at)
            while first + len(new) > len(self.rows):
                self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
            self.rows[first : first + len(new)] = self.make(new)
            self.at.update(zip(new, range(first, first + len(new)), strict=True))
            got = list(map(self.at.get, words))
        return self.rows[np.array(got, np.int64)]


class Shared:
    """A broadcast value, and what each worker makes of it once."""

    def __init__(self, spark, value, key: str):
        self.broadcast, self.key = spark.sparkContext.broadcast(value), key

    def use(self, make):
        return resident(self.key, lambda: make(self.broadcast.value))
