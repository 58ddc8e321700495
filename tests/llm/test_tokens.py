"""Tokenizing operators next to the tokenizers library itself."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from cases import documents, rows
from tokenizers import Tokenizer

from panelworks.llm import bpe, wavelet
from panelworks.session import scratch_path

BYTE, WORD = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))


@pytest.fixture(scope="module")
def byte_level():
    return Tokenizer.from_file(BYTE)


def test_round_trip_edge_rows(spark, byte_level):
    got = bpe.digests(bpe.round_trip(documents(spark))).collect()
    want = []
    for i, text, _ in rows():
        ids = byte_level.encode(text or "", add_special_tokens=False).ids
        decoded = byte_level.decode(ids, skip_special_tokens=False)
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    assert sorted((tuple(r) for r in got), key=repr) == sorted(want, key=repr)


def test_fragments_of_random_text(byte_level):
    rng = random.Random(2)
    letters = ["a", "b", "s", "t", "l", "'", "'", " ", " ", "  ", "\n", "\t", "!", ".", "1", "2", "é", "—", "日", " ", "　", "́", "<|endoftext|>", "<|", "|>", "q", "X", "🙂", "\u0001"]
    own = bpe.loaded(BYTE)
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(4000)]
    data = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(d) for d in data])]).astype(np.int64)
    ids, place = own.encode(np.frombuffer(b"".join(data), np.uint8), offsets)
    for k, want in enumerate(byte_level.encode_batch(texts, add_special_tokens=False)):
        mine = ids[place[k] : place[k + 1]].tolist()
        assert mine == want.ids, repr(texts[k])
        assert own.decode(mine).decode() == byte_level.decode(want.ids, skip_special_tokens=False)


def test_decode_broken_characters(byte_level):
    own = bpe.loaded(BYTE)
    rng = random.Random(3)
    for _ in range(300):
        ids = [rng.randrange(256) for _ in range(rng.randint(0, 12))]
        assert own.decode(ids).decode() == byte_level.decode(ids, skip_special_tokens=False)


def test_cuts_lie_inside_no_token():
    own = bpe.loaded(BYTE)
    assert not (own.cut & own.inside.reshape(-1)).any() and own.cut.sum() > 1000


@pytest.mark.parametrize("most", [50, 4_000_000])
def test_shards_edge_rows(spark, most):
    tokenizer = Tokenizer.from_file(WORD)
    folder = scratch_path(spark, "shards")
    wavelet.write_shards(documents(spark), folder, most=most)
    shards = wavelet.read_shards(spark, folder)
    got = wavelet.digests(shards).collect()
    # ids in ascending order, null first; equal ids hold equal texts here but for the null ones
    given = sorted(rows(), key=lambda r: (r[0] is not None, r[0] or 0))
    want, place = [], 0
    for i, text, _ in given:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((i, place, len(ids), zlib.crc32(ids.tobytes())))
        place += len(ids)
    known = lambda rs: sorted((tuple(r) for r in rs if r[0] is not None), key=repr)
    assert known(got) == known(want)
    assert sorted(r[2:] for r in map(tuple, got) if r[0] is None) == sorted(r[2:] for r in want if r[0] is None)
    assert sum(r["n"] for r in shards.select("n").collect()) == place
    token = 2
    assert wavelet.occurrences(shards, [token, 49_000]).where("token = 2").count() >= len(given)


def test_words_of_random_text():
    rng = random.Random(4)
    letters = ["a", "b", "s", "t", "'", " ", "\n", "\t", "\x0b", "\x1c", "!", ".", "1", "é", "é", "́", "—", "日", " ", "　", "<|endoftext|>", "<|startoftext|>", "<|", "İ", "Σ", "ẞ"]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    tokenizer, own = Tokenizer.from_file(WORD), wavelet.loaded(WORD)
    data = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(d) for d in data])]).astype(np.int64)
    ids, place = own.encode(np.frombuffer(b"".join(data), np.uint8), offsets)
    for k, want in enumerate(tokenizer.encode_batch(texts, add_special_tokens=False)):
        assert ids[place[k] : place[k + 1]].tolist() == want.ids, repr(texts[k])


@pytest.mark.parametrize("n, top", [(0, 1), (1, 1), (5, 2), (700, 9), (5000, 49408), (1024, 1)])
def test_wavelet_matrix(n, top):
    ids = np.random.default_rng(n).integers(0, top, n).astype(np.uint32)
    matrix = wavelet.WaveletMatrix.build(ids)
    assert (matrix.all() == ids).all()
    if n:
        at = np.random.default_rng(1).integers(0, n, 50)
        assert (matrix.access(at) == ids[at]).all()
        for token in {*ids[:5].tolist(), 0, top - 1, top + 1, 10**6}:
            for low, high in ((0, n), (n // 3, n // 2)):
                assert matrix.count(token, low, high) == int((ids[low:high] == token).sum())
                assert matrix.find(token, low, high).tolist() == (np.nonzero(ids[low:high] == token)[0] + low).tolist()


def test_empty_tables(spark):
    none = documents(spark, [])
    assert bpe.digests(bpe.round_trip(none)).count() == 0
    folder = scratch_path(spark, "shards")
    wavelet.write_shards(none, folder)
    assert wavelet.digests(wavelet.read_shards(spark, folder)).count() == 0
