"""Byte-level BPE by forced-boundary splitting, and the decoding back to text.

A merge only ever makes a vocabulary token, so a pair of neighbouring bytes that
occurs inside no token is never merged across: the text can be cut there. The
fragments are encoded independently, each distinct short fragment once per
worker, and their ids are concatenated.

The tokenizer first splits text by a pattern, so a cut must leave that split as
it is. Cuts are made only behind a printable ASCII byte other than a space
(runs of white space look ahead), never before an apostrophe (contractions look
back) and never inside a character. Strings of added tokens are fragments of
their own, as the tokenizer takes them out first.
"""

from __future__ import annotations

import json
import os
import struct
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelworks.llm.common import blocks, in_arrow, packed

CACHE = 1_000_000  # distinct fragments kept by a worker
SHORT = 64  # bytes of the longest fragment that is kept


def byte_of_letter() -> dict[str, int]:
    """Letters that stand for bytes in a byte-level vocabulary: printable ones as themselves, the rest from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def alike(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One piece of each kind, and for every piece the place of its kind's piece among those.

    Pieces of up to 16 bytes are told apart by all their bytes and their length;
    every longer piece is a kind of its own.
    """
    size = end - start
    half = [np.zeros(len(start), np.uint64), np.zeros(len(start), np.uint64)]
    for k in range(16):
        there = np.nonzero(size > k)[0]
        half[k // 8][there] |= data[start[there] + k].astype(np.uint64) << np.uint64(8 * (k % 8))
    mixed = (half[0] * np.uint64(0x9E3779B97F4A7C15) ^ half[1]) * np.uint64(0xD6E8FEB86659FD93) + size.astype(np.uint64)
    mixed ^= mixed >> np.uint64(32)
    own = size > 16
    mixed[own] = np.arange(len(start), dtype=np.uint64)[own]
    _, first, kind = np.unique(mixed, return_index=True, return_inverse=True)
    of = first[kind]
    if not ((size == size[of]) & (half[0] == half[0][of]) & (half[1] == half[1][of]) & (~own | (of == np.arange(len(of))))).all():
        return np.arange(len(start)), np.arange(len(start))  # two kinds met in one hash: no kinds this time
    return first, kind


class PieceCache:
    """Ids of pieces of text; a piece is encoded once per worker while there is room for it."""

    def __init__(self, encode: Callable[[list[bytes]], dict[bytes, bytes]]):
        self.encode, self.known = encode, {}

    def ids(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces in one array, and the n+1 places where each piece starts in it."""
        first, kind = alike(data, start, end)
        whole = data.tobytes()
        parts = [whole[a:b] for a, b in zip(start[first].tolist(), end[first].tolist())]
        found = list(map(self.known.get, parts))
        missing = list({p: None for p, ids in zip(parts, found) if ids is None})
        if missing:
            fresh = self.encode(missing)
            found = [fresh[p] if ids is None else ids for p, ids in zip(parts, found)]
            if len(self.known) + len(fresh) > CACHE:
                self.known.clear()
            self.known |= {p: ids for p, ids in fresh.items() if len(p) <= SHORT}
        size = np.fromiter(map(len, found), np.int64, len(found)) // 4
        flat = np.frombuffer(b"".join(found), "<u4")
        place = np.cumsum(size) - size
        each = size[kind]
        ends = np.concatenate([[0], np.cumsum(each)])
        return flat[np.arange(ends[-1]) + np.repeat(place[kind] - ends[:-1], each)], ends


def coded(tokenizer, parts: list[bytes]) -> dict[bytes, bytes]:
    """Little-endian 32-bit ids of each part."""
    out = {}
    for start in range(0, len(parts), 10_000):
        some = parts[start : start + 10_000]
        found = tokenizer.encode_batch_fast([p.decode() for p in some], add_special_tokens=False)
        out |= {p: struct.pack(f"<{len(ids)}I", *ids) for p, ids in zip(some, (c.ids for c in found))}
    return out


class FragmentBpe:
    """One tokenizer of a worker: cut table, cache of encoded fragments, bytes of each token."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        letters = byte_of_letter()
        vocabulary = {i: bytes(letters[c] for c in token) for token, i in spec["model"]["vocab"].items()}
        self.added = [t["content"].encode() for t in spec["added_tokens"]]
        self.inside = np.zeros((256, 256), bool)
        for token in vocabulary.values():
            self.inside[list(token[:-1]), list(token[1:])] = True
        vocabulary |= {t["id"]: t["content"].encode() for t in spec["added_tokens"]}
        self.pieces = [vocabulary.get(i, b"") for i in range(max(vocabulary) + 1)]
        cut = ~self.inside
        before, after = np.arange(256), np.arange(256)
        cut[(before < 0x21) | (before > 0x7E), :] = False
        cut[:, (after & 0xC0) == 0x80] = False
        cut[:, ord("'")] = False
        self.cut = cut.reshape(-1)
        self.cache = PieceCache(lambda parts: coded(self.tokenizer, parts))

    def starts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """First byte of every fragment of the packed documents."""
        cuts = np.zeros(len(data) + 1, bool)
        cuts[1:-1] = self.cut[data[:-1].astype(np.uint16) << 8 | data[1:]]
        cuts[offsets] = True
        whole = data.tobytes()
        for word in self.added:
            at = whole.find(word)
            while at >= 0:
                end = at + len(word)
                border = offsets[np.searchsorted(offsets, at, "right") :][:1]
                if not len(border) or border[0] >= end:
                    cuts[at + 1 : end] = False
                    cuts[at] = cuts[end] = True
                    at = whole.find(word, end)
                else:
                    at = whole.find(word, at + 1)
        return np.nonzero(cuts[:-1])[0]

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all packed documents in one array, and the n+1 places where they start in it."""
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        start = self.starts(data, offsets)
        ids, ends = self.cache.ids(data, start, np.append(start[1:], len(data)))
        return ids, ends[np.searchsorted(start, offsets)]

    def decode(self, ids: list[int]) -> bytes:
        """UTF-8 of the decoded text; a broken character becomes the replacement character."""
        joined = b"".join(map(self.pieces.__getitem__, ids))
        return joined.decode("utf-8", "replace").encode()


@lru_cache(maxsize=4)
def loaded(path: str) -> FragmentBpe:
    return FragmentBpe(path)


def _round_trip(path: str):
    def fn(batches):
        bpe = loaded(path)
        for batch in batches:
            raw, at = packed(batch.column("text"))
            for a, b in blocks(at):
                ids, place = bpe.encode(raw[at[a] : at[b]], at[a : b + 1] - at[a])
                little = ids.tobytes()
                codes = [little[4 * i : 4 * j] for i, j in zip(place[:-1], place[1:])]
                texts = [bpe.decode(ids[i:j].tolist()) for i, j in zip(place[:-1], place[1:])]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(a, b - a), pa.array(codes, pa.binary()),
                     pa.array(texts, pa.binary()).cast(pa.string())], ["doc_id", "ids", "decoded"])
    return fn


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit) and decoded text of every row.

    A null text counts as empty: no ids, empty decoded text. Rows stay where
    they are: no shuffle, repeated rows repeat, a null doc_id is kept. A worker
    holds one batch of at most some megabytes at a time; one very long text is
    a batch of its own. Only doc_id and text are read.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    path = path or public_tokenizers.path("byte_bpe_50k.json")
    return in_arrow(docs.select("doc_id", "text"), _round_trip(path), f"doc_id {kind}, ids binary, decoded string")


def digests(coded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of a round trip."""
    return coded.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
