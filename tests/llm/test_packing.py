import base64
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from helpers import awkward, frame
from tokenizers import Tokenizer

from vellum.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def model():
    return Tokenizer.from_file(PATH)


@pytest.mark.parametrize("ranks", [None, public_tokenizers.path("byte_bpe_50k.tiktoken")])
def test_encoder_gives_the_tokenizers_ids(model, ranks):
    encode = packing.encoder(PATH, ranks)
    odd = ["a  b", " a", "a ", "a\n b", "it's don't'll x<|endoftext|>y", "   ", "\n\n", "a\tb c", "é 日本 12ab3 $$ !?", "a\x1c b", "a b c", "x　y z", "'s 't", "\x85 a\x85 b"]
    for text in odd + [r[1] for r in awkward() if r[1]]:
        assert encode(text) == np.array(model.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


@pytest.mark.parametrize("seed", range(6))
def test_plan_places_every_piece_once(seed):
    rng = random.Random(seed)
    capacity = rng.choice([16, 64, 1024])
    histogram = {}
    for _ in range(rng.choice([0, 1, 5, 300])):
        s = rng.randint(1, capacity)
        histogram[s] = histogram.get(s, 0) + rng.randint(1, 40)
    placed = {}
    for pattern, times in packing.plan(histogram, capacity):
        assert times > 0 and sum(s * n for s, n in pattern.items()) <= capacity
        for s, n in pattern.items():
            placed[s] = placed.get(s, 0) + n * times
    assert placed == histogram


def test_column_generation_reaches_the_bound():
    sizes, demand = np.array([300, 340, 400, 512, 724]), np.array([50.0, 40, 30, 20, 10])
    used, report = packing.column_generation(sizes, demand, 1024)
    total = np.zeros(5)
    for pattern, use in used:
        for i, n in pattern.items():
            total[i] += n * use
    assert np.allclose(total, demand) and report["use"] == pytest.approx(report["bound"], rel=1e-6)
    assert sum(u for _, u in used) < 1.05 * (sizes * demand).sum() / 1024


@pytest.mark.parametrize("seed", range(8))
def test_columns_enter_until_the_program_is_optimal(seed):
    rng = np.random.default_rng(seed)
    sizes = np.unique(rng.integers(150, 700, 14))
    demand = rng.integers(1, 60, len(sizes)).astype(float)
    used, report = packing.column_generation(sizes, demand, 1000)
    made = sum(u * np.bincount(list(p), list(p.values()), len(sizes)) for p, u in used)
    assert np.allclose(made, demand) and report["use"] <= report["bound"] * (1 + 1e-6)
    patterns, _, order = packing.first_basis(sizes, demand, 1000)
    basis = np.array([[p.get(i, 0) for p in patterns] for i in range(len(sizes))], float)
    assert np.allclose(packing.triangular_inverse(patterns, order) @ basis, np.eye(len(sizes)))


def test_padding_is_small():
    rng = np.random.default_rng(3)
    histogram = {int(s): int(n) for s, n in zip(*np.unique(np.minimum(rng.geometric(0.004, 20_000), 1023), return_counts=True), strict=True)}
    made = packing.plan(histogram, 1024)
    used = sum(s * n for s, n in histogram.items())
    assert sum(t for _, t in made) * 1024 <= used * 1.01


@pytest.mark.parametrize("keep_ids", [True, False])
def test_pieces_cover_documents_and_fill_sequences(spark, model, keep_ids):
    rows = awkward()
    got = packing.pack(frame(spark), keep_ids=keep_ids).toPandas()
    expected = []
    for doc_id, text, *_ in rows:
        ids = (model.encode(text, add_special_tokens=False).ids if text else []) + [0]
        for start in range(0, len(ids), 1024):
            piece = ids[start : start + 1024]
            expected.append((str(doc_id), start, len(piece), zlib.crc32(np.array(piece, "<u4").tobytes()), len(ids)))
    shown = got.assign(doc_id=got.doc_id.map(lambda x: "None" if x != x else str(int(x))))
    assert sorted(shown[["doc_id", "start", "length", "ids_crc32", "doc_tokens"]].itertuples(index=False, name=None)) == sorted(expected)
    for _, x in got.sort_values("offset").groupby("sequence_id"):
        assert list(x.offset) == [0, *np.cumsum(x.length)[:-1]] and x.length.sum() <= 1024
    if keep_ids:
        assert all(zlib.crc32(np.array(i, "<u4").tobytes()) == c for i, c in zip(got.ids, got.ids_crc32, strict=True))


def test_empty_table(spark):
    assert packing.pack(frame(spark, [])).count() == 0


def test_ranks_are_the_tokenizers_vocabulary(model):
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    assert len(ranks) == model.get_vocab_size() - 1
