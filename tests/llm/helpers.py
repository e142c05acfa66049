"""Small tables with every awkward row, and brute-force versions of the operators."""

import collections
import hashlib
import random
import zlib

import numpy as np

WORDS = [f"w{i}" for i in range(400)]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def awkward(seed=1):
    """(doc_id, text, lang, source) with nulls, empty and long texts, copies, near copies and a repeated row."""
    rng = random.Random(seed)
    base = prose(rng, 120)
    words = base.split()
    near = " ".join([*words[:60], "new", *words[61:]])
    passage = prose(rng, 70)
    rows = [
        (1, base, "en", "a"), (2, base, "en", None), (3, near, None, "a"), (4, None, "en", "b"), (5, "", None, None), (6, " \n\t ", "de", "b"), (7, "one", "de", "b"), (8, "one two", "de", "b"),
        (9, "one two", "en", "c"), (10, prose(rng, 30) + " " + passage + " " + prose(rng, 30), "en", "c"), (11, prose(rng, 10) + " " + passage, "en", "c"), (12, "The " * 400, "en", "a"),
        (13, prose(rng, 6000), "en", "a"), (None, base, "en", "a"), (14, "é" * 150 + " Ünï ÀB ab", "fr", "a"), (15, base.upper(), "en", "a"), (16, "## $$ ** && %% || << >> ## **", "en", "a"), (1, base, "en", "a"),
        (17, "x\x00y " + passage + "\x00", "en", "c"), (18, "12 34 !!", "en", "b"),
    ]
    return rows + [(100 + i, prose(rng, rng.randint(1, 60)), rng.choice(["en", "de"]), rng.choice(["a", "b", "c"])) for i in range(20)]


SCHEMA = "doc_id long, text string, lang string, source string"


def frame(spark, rows=None):
    """With extra columns whose names operators use themselves."""
    from pyspark.sql import functions as F

    from vellum.llm.common import ship

    ship(spark)
    docs = spark.createDataFrame(awkward() if rows is None else rows, SCHEMA)
    return docs.withColumns({c: F.lit(i) for i, c in enumerate(("n", "score", "rank", "kept", "row", "key", "size", "part", "hash", "marks", "_words"))})


def removed(texts, span=200):
    """(bytes, bytes removed, runs removed, digest of the rest) of each text."""
    data = [(t or "").encode() for t in texts]
    seen = collections.Counter(d[i : i + span] for d in data for i in range(len(d) - span + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - span + 1):
            if seen[d[i : i + span]] > 1:
                gone[i : i + span] = True
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((len(d), int(gone.sum()), runs, hashlib.sha256(bytes(np.frombuffer(d, np.uint8)[~gone])).hexdigest()))
    return out


def shingles(text, k):
    w = (text or "").encode().lower().split()
    if not w:
        return set()
    return {tuple(w)} if len(w) < k else set(zip(*(w[j:] for j in range(k)), strict=False))


def near_components(rows, k, percent):
    """doc_id -> smallest doc_id that it reaches."""
    sets = [(d, shingles(t, k)) for d, t in rows if d is not None]
    root = {d: d for d, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, s) in enumerate(sets):
        for b, t in sets[:i]:
            if s and t and 100 * len(s & t) >= percent * len(s | t):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: find(d) for d in root}


def learned(doc_id, modulus=3, remainder=1):
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % modulus != remainder
