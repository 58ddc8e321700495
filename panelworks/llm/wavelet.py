"""Token ids as one wavelet matrix per shard, written and read as compressed files.

A shard holds the ids of a run of documents in ascending doc_id order. Its bit
planes, one per bit of the largest id from the highest down, are each stably
split into zeros and ones before the next; with a running count per 512 bits
they answer access, rank and select without the ids themselves.
"""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelworks.llm.bpe import PieceCache, coded
from panelworks.llm.common import blocks, in_arrow, packed
from panelworks.llm.textstats import LOWER, words

BLOCK = 512  # bits between two stored counts
SHARD_TOKENS = 4_000_000
END = 2


class WaveletMatrix:
    """Bit planes with rank and select over a sequence of unsigned ids."""

    def __init__(self, n: int, planes: list[np.ndarray], counts: list[np.ndarray], zeros: list[int]):
        self.n, self.planes, self.counts, self.zeros = n, planes, counts, zeros

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        depth = max(1, int(ids.max(initial=0)).bit_length())
        kind = np.uint16 if depth <= 16 else np.uint32
        planes, counts, zeros, rest = [], [], [], ids.astype(kind)
        for level in range(depth):
            ones = rest & kind(1 << (depth - 1 - level)) != 0
            bits = np.packbits(ones, bitorder="little")
            padded = np.zeros(-(-len(ids) // BLOCK) * BLOCK // 8, np.uint8)
            padded[: len(bits)] = bits
            plane = padded.view("<u8")
            per_block = np.bitwise_count(plane).reshape(-1, BLOCK // 64).sum(axis=1, dtype=np.uint32)
            planes.append(plane)
            counts.append(np.concatenate([[0], np.cumsum(per_block)]).astype("<u4"))
            rest = np.concatenate([rest[~ones], rest[ones]])
            zeros.append(int(len(ids) - counts[-1][-1]))
        return cls(len(ids), planes, counts, zeros)

    def _ones_before(self, level: int, at: np.ndarray) -> np.ndarray:
        """Number of ones in front of each place of a plane."""
        plane, block = self.planes[level], at // BLOCK
        total = self.counts[level][block].astype(np.int64)
        for word in range(BLOCK // 64):
            index = block * (BLOCK // 64) + word
            left = np.clip(at - index * 64, 0, 64)
            value = plane[np.minimum(index, len(plane) - 1)] if len(plane) else np.zeros(len(at), np.uint64)
            mask = np.where(left >= 64, ~np.uint64(0), (np.uint64(1) << np.minimum(left, 63).astype(np.uint64)) - np.uint64(1))
            total += np.bitwise_count(value & mask).astype(np.int64)
        return total

    def access(self, at) -> np.ndarray:
        """Ids at the given places."""
        at = np.atleast_1d(np.asarray(at, np.int64))
        out = np.zeros(len(at), np.uint32)
        for level, plane in enumerate(self.planes):
            bit = plane[at // 64] >> (at % 64).astype(np.uint64) & np.uint64(1)
            ones = self._ones_before(level, at)
            out = out << np.uint32(1) | bit.astype(np.uint32)
            at = np.where(bit == 1, self.zeros[level] + ones, at - ones)
        return out

    def _range(self, token: int, low: int, high: int) -> tuple[int, int]:
        """Where the occurrences of a token in [low, high) lie below the last plane."""
        depth = len(self.planes)
        if token < 0 or token >> depth:
            return 0, 0
        span = np.array([low, high], np.int64)
        for level in range(depth):
            ones = self._ones_before(level, span)
            span = self.zeros[level] + ones if token >> (depth - 1 - level) & 1 else span - ones
        return int(span[0]), int(span[1])

    def count(self, token: int, low: int = 0, high: int | None = None) -> int:
        """Occurrences of a token in [low, high)."""
        first, last = self._range(token, low, self.n if high is None else high)
        return last - first

    def _select(self, level: int, bit: int, nth: np.ndarray) -> np.ndarray:
        """Place of the nth (from 0) zero or one of a plane, by bisection over its counts and words."""
        low, high = np.zeros(len(nth), np.int64), np.full(len(nth), self.n, np.int64)
        while (low < high).any():
            middle = (low + high) // 2
            ones = self._ones_before(level, np.minimum(middle + 1, self.n))
            have = ones if bit else middle + 1 - ones
            low, high = np.where((have <= nth) & (low < high), middle + 1, low), np.where((have > nth) & (low < high), middle, high)
        return low

    def find(self, token: int, low: int = 0, high: int | None = None) -> np.ndarray:
        """Places of all occurrences of a token in [low, high), ascending."""
        first, last = self._range(token, low, self.n if high is None else high)
        at, depth = np.arange(first, last), len(self.planes)
        for level in reversed(range(depth)):
            bit = token >> (depth - 1 - level) & 1
            at = self._select(level, bit, at - self.zeros[level] if bit else at)
        return at

    def all(self) -> np.ndarray:
        """The whole sequence, put together from the lowest plane up."""
        kind = np.uint16 if len(self.planes) <= 16 else np.uint32
        out = np.zeros(self.n, kind)
        for level in reversed(range(len(self.planes))):
            ones = np.unpackbits(self.planes[level].view(np.uint8), count=self.n, bitorder="little").view(bool)
            higher = np.empty_like(out)
            higher[~ones] = out[: self.zeros[level]]
            higher[ones] = out[self.zeros[level] :] | kind(1 << (len(self.planes) - 1 - level))
            out = higher
        return out.astype(np.uint32)


# ASCII letters and digits, and ASCII signs but the apostrophe, which can bind to a letter behind it
_KIND = np.zeros(256, np.uint8)
_KIND[[*range(48, 58), *range(65, 91), *range(97, 123)]] = 1
_KIND[[b for b in range(33, 127) if not _KIND[b] and b != 39]] = 2
# runs of small ASCII and Latin-1 letters, one word each
_LETTERS = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+")


def pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of the words, cut further between ASCII letters or digits and ASCII signs."""
    start, end = words(data, offsets)
    kind = _KIND[data]
    cut = np.nonzero(kind[:-1] + kind[1:] == 3)[0]
    cut = cut[(kind[cut] > 0) & (kind[cut + 1] > 0)] + 1
    # a border between documents separates words already
    cut = cut[offsets[np.searchsorted(offsets, cut)] != cut]
    return np.sort(np.concatenate([start, cut])), np.sort(np.concatenate([end, cut]))


class WordBpe:
    """A tokenizer that drops white space and case: pieces of words are encoded apart, each distinct short one once."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        # small letters need no normalizing and no pattern: the same model behind a split at spaces
        spec = json.loads(self.tokenizer.to_str())
        split = {"type": "CharDelimiterSplit", "delimiter": " "}
        letters = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
        spec |= {"normalizer": None, "added_tokens": [], "pre_tokenizer": {"type": "Sequence", "pretokenizers": [split, letters]}}
        self.letters = Tokenizer.from_str(json.dumps(spec))
        suffix = self.tokenizer.model.end_of_word_suffix
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        if suffix:
            self.last[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True
        self.added = [t.content.lower().encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.cache = PieceCache(self._fresh)

    def _fresh(self, parts: list[bytes]) -> dict[bytes, bytes]:
        """Ids of each part. Runs of small letters go in lines of many, as each ends with the one id that ends a word."""
        plain = [p for p in parts if p.isalpha() and p.islower() or _LETTERS.fullmatch(p)]
        lines = [plain[a : a + 500] for a in range(0, len(plain), 500)]
        out: dict[bytes, bytes] = {}
        for line, found in zip(lines, self.letters.encode_batch_fast([b" ".join(x).decode() for x in lines], add_special_tokens=False)):
            ids = np.array(found.ids, "<u4")
            stop = (4 * (np.nonzero(self.last[ids])[0] + 1)).tolist()
            if len(stop) == len(line):
                little = ids.tobytes()
                out |= {p: little[a:b] for p, a, b in zip(line, [0, *stop], stop)}
        rest = [p for p in parts if p not in out]
        return out | coded(self.tokenizer, rest)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all packed documents in one array, and the n+1 places where they start in it."""
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        low = LOWER[data]
        whole = low.tobytes()
        if any(word in whole for word in self.added):  # told by case and taken out before anything else
            start, end = words(data, offsets)
        else:
            data, (start, end) = low, pieces(data, offsets)
        ids, ends = self.cache.ids(data, start, end)
        return ids, ends[np.searchsorted(start, offsets)]


@lru_cache(maxsize=4)
def loaded(path: str) -> WordBpe:
    return WordBpe(path)


_SHARD = ("shard long, n long, depth int, zeros binary, planes array<binary>, counts array<binary>, "
          "docs binary, known binary, ends binary")


def _build(path: str, end: int, most: int):
    def shard(number: int, place: int, docs: list, ids: list[np.ndarray]) -> pa.RecordBatch:
        every = np.concatenate([np.append(x, np.uint32(end)) for x in ids])
        ends = np.cumsum([len(x) + 1 for x in ids])
        matrix = WaveletMatrix.build(every)
        row = {
            "shard": place * 2**20 + number, "n": len(every), "depth": len(matrix.planes),
            "zeros": np.array(matrix.zeros, "<i8").tobytes(), "planes": [p.tobytes() for p in matrix.planes],
            "counts": [c.tobytes() for c in matrix.counts], "docs": np.array([d or 0 for d in docs], "<i8").tobytes(),
            "known": np.array([d is not None for d in docs], np.uint8).tobytes(), "ends": ends.astype("<i8").tobytes(),
        }
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.binary()), *[pa.binary()] * 3]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row.values(), kinds)], list(row))

    def fn(batches):
        bpe = loaded(path)
        docs, ids, held, number, place = [], [], 0, 0, None
        for batch in batches:
            raw, at = packed(batch.column("text"))
            names = batch.column("doc_id").to_pylist()
            place = batch.column("place")[0].as_py() if place is None and len(names) else place
            for a, b in blocks(at):
                ids_here, where = bpe.encode(raw[at[a] : at[b]], at[a : b + 1] - at[a])
                for k in range(b - a):
                    part = ids_here[where[k] : where[k + 1]]
                    if docs and held + len(part) + 1 > most:
                        yield shard(number, place, docs, ids)
                        docs, ids, held, number = [], [], 0, number + 1
                    docs.append(names[a + k])
                    ids.append(part)
                    held += len(part) + 1
        if docs:
            yield shard(number, place, docs, ids)
    return fn


def write_shards(docs: DataFrame, folder: str, path: str | None = None, end: int = END, most: int = SHARD_TOKENS) -> None:
    """Encode every text and write one zstd-compressed Parquet file per shard to ``folder``.

    Rows are dealt out by ranges of doc_id and ordered within a range, so shards
    in the order of their number hold ascending doc_ids (null first, equal ids
    by a hash of their text). A null text counts as empty: only the end id. A
    shard takes whole documents up to ``most`` ids, a longer document one shard.
    """
    rows = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange("doc_id")
    rows = rows.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    rows = rows.withColumn("place", F.spark_partition_id())
    path = path or public_tokenizers.path("word_bpe_49k.json")
    coded = in_arrow(rows, _build(path, end, most), _SHARD)
    coded.write.partitionBy("shard").option("compression", "zstd").parquet(folder)


def read_shards(spark: SparkSession, folder: str) -> DataFrame:
    """One row per shard file."""
    return spark.read.schema(_SHARD).parquet(folder)


def matrix_of(row) -> WaveletMatrix:
    return WaveletMatrix(
        row["n"], [np.frombuffer(p, "<u8") for p in row["planes"]], [np.frombuffer(c, "<u4") for c in row["counts"]],
        np.frombuffer(row["zeros"], "<i8").tolist())


def _each(batch: pa.RecordBatch):
    """Shards of a batch one by one, without a copy of the whole batch."""
    for k in range(batch.num_rows):
        yield batch.slice(k, 1).to_pylist()[0]


def _documents(batches):
    for batch in batches:
        for row in _each(batch):
            little = matrix_of(row).all().astype("<u4").tobytes()
            ends = np.frombuffer(row["ends"], "<i8")
            starts = np.concatenate([[0], ends[:-1]])
            known = np.frombuffer(row["known"], np.uint8).astype(bool)
            for a in range(0, len(ends), 2000):
                part = slice(a, a + 2000)
                ids = [little[4 * i : 4 * j] for i, j in zip(starts[part], ends[part])]
                names = pa.array(np.frombuffer(row["docs"], "<i8")[part], mask=~known[part])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["shard"]] * len(ids), pa.int64()), names, pa.array(starts[part]), pa.array(ids, pa.binary())],
                    ["shard", "doc_id", "place", "ids"])


def documents(shards: DataFrame) -> DataFrame:
    """shard, doc_id, place in the shard and ids of every document, from the bit planes."""
    return in_arrow(shards, _documents, "shard long, doc_id long, place long, ids binary")


def _occurrences(tokens: list[int]):
    def fn(batches):
        for batch in batches:
            for row in _each(batch):
                matrix = matrix_of(row)
                for token in tokens:
                    at = matrix.find(token)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(at), row["shard"])), pa.array(np.full(len(at), token, np.int64)), pa.array(at)],
                        ["shard", "token", "place"])
    return fn


def occurrences(shards: DataFrame, tokens: list[int]) -> DataFrame:
    """(shard, token, place) of every occurrence of the given tokens, by select on the planes."""
    return in_arrow(shards, _occurrences(tokens), "shard long, token long, place long")


def shard_starts(shards: DataFrame) -> DataFrame:
    """Number of ids in front of each shard; one small row per shard is ordered."""
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return shards.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shard_start"))


def digests(shards: DataFrame, most_broadcast: int = 1_000_000) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document of the shards.

    The starts, 16 bytes a shard, are broadcast up to ``most_broadcast`` shards
    (some 4e12 ids) and joined by a shuffle beyond that.
    """
    starts = shard_starts(shards)
    if shards.select("shard").count() <= most_broadcast:
        starts = F.broadcast(starts)
    return documents(shards).join(starts, "shard").select(
        "doc_id", (F.col("shard_start") + F.col("place")).alias("start"),
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
