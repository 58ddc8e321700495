"""Removal of repeated byte strings by a sparse, range-partitioned suffix array.

A byte goes when some ``LENGTH``-byte string over it also starts earlier. Every
such string holds an anchor: the leftmost of its ``GRAM``-byte substrings with
the smallest hash, chosen by the string's content alone. So two equal strings
have equal anchors at equal places, and it is enough to sort the suffixes (and
the reversed prefixes) that start at anchors.

1. Anchors that occur in one group of texts only are dropped: the groups'
   anchor hashes meet in packed arrays, not rows.
2. Each group settles its own repeats, so that a passage leaves it once.
3. The remaining suffixes are range-partitioned by Spark's sampled splitters on
   their leading bytes. A bucket sorts them by multikey quicksort, takes the
   common prefix lengths of neighbours, and reads off which strings are equal.
   Strings around an anchor at either end of a bucket may go on in the next
   one; the first of each is compared across buckets by a digest of its bytes.

Equal texts are settled before all this by their hashes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelworks.llm.common import blocks, importable, in_arrow, packed
from panelworks.session import materialise

LENGTH = 100
GRAM = 24
LEFT = LENGTH - GRAM  # most bytes of a string in front of its anchor
WIDE, WIDE_LEFT = -(-LENGTH // 8) * 8, -(-LEFT // 8) * 8  # rows of whole sort keys: sorted as they stand, without a copy
GROUP_BYTES = 8 << 20
CHUNK = 1 << 20
LAST = np.iinfo(np.int64).max
_LOW = np.uint64((1 << 24) - 1)


def gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """64-bit hash of the ``size`` bytes from each place on, by doubling."""
    def joined(a: np.ndarray, b: np.ndarray, salt: int) -> np.ndarray:
        mixed = a[: len(b)] * np.uint64(0x9E3779B97F4A7C15 + 2 * salt)
        mixed ^= mixed >> np.uint64(29)
        return mixed + b * np.uint64(0xD6E8FEB86659FD93)

    power, span, out, done = data.astype(np.uint64) + np.uint64(1), 1, None, 0
    while span <= size:
        if size & span:
            out = power if out is None else joined(out, power[done:], span + 1)
            done += span
        power = joined(power, power[span:], span)
        span *= 2
    out = out[: len(data) - size + 1] * np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(31))


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    span, low = 1, values
    while span * 2 <= width:
        low, span = np.minimum(low[:-span], low[span:]), span * 2
    n = len(values) - width + 1
    return np.minimum(low[:n], low[width - span : width - span + n])


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of packed texts: place, hash, and least and most bytes of its strings in front of it.

    Strings that start one after the other share an anchor; texts of any length
    are gone through in pieces, so an anchor can come twice with disjoint ranges.
    """
    turns = np.zeros(len(data) + 2, np.int32)
    begin, end = offsets[:-1], offsets[1:] - LENGTH + 1
    long_enough = end > begin
    np.add.at(turns, begin[long_enough], 1)
    np.add.at(turns, end[long_enough], -1)
    places, hashes, least, most = ([np.zeros(0, t)] for t in (np.int64, np.uint64, np.int64, np.int64))
    inside = 0
    for at in range(0, max(0, len(data) - LENGTH + 1), CHUNK):
        piece = data[at : at + CHUNK + LENGTH - 1]
        hashed = gram_hashes(piece, GRAM)
        low = sliding_min((hashed & ~_LOW) | np.arange(len(hashed), dtype=np.uint64), LENGTH - GRAM + 1)
        open_now = np.cumsum(turns[at : at + len(low)]) + inside
        inside = int(open_now[-1])
        start = np.nonzero(open_now > 0)[0]
        if not len(start):
            continue
        anchor = (low[start] & _LOW).astype(np.int64)
        new = np.ones(len(start), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1)
        first = np.nonzero(new)[0]
        last = np.append(first[1:], len(start)) - 1
        place = anchor[first]
        places.append(place + at)
        hashes.append(hashed[place])
        most.append(place - start[first])
        least.append(place - start[last])
    return tuple(np.concatenate(x) for x in (places, hashes, least, most))


def multikey_order(rows: np.ndarray) -> np.ndarray:
    """Order of byte rows by multikey quicksort, eight bytes a key: only ties go on to the next key."""
    n, width = rows.shape
    if width % 8:
        padded = np.zeros((n, -(-width // 8) * 8), np.uint8)
        padded[:, :width] = rows
        rows = padded
    keys = rows.view(">u8")
    order, group = np.arange(n), np.zeros(n, np.int64)
    tied = np.arange(n)  # places in the order that are not settled
    for k in range(keys.shape[1]):
        value = keys[order[tied], k].astype(np.uint64)
        inner = np.lexsort((value, group[tied]))
        order[tied] = order[tied[inner]]
        value, of = value[inner], group[tied]
        new = np.ones(len(tied), bool)
        new[1:] = (value[1:] != value[:-1]) | (of[1:] != of[:-1])
        group[tied] = tied[np.maximum.accumulate(np.where(new, np.arange(len(tied)), 0))]
        alone = new & np.append(new[1:], True)
        tied = tied[~alone]
        if not len(tied):
            break
    return order


def common_prefixes(rows: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Common prefix length of each sorted row with the one before it; -1 for the first."""
    out = np.full(len(rows), -1, np.int64)
    for at in range(1, len(rows), 1 << 16):
        now = order[at : at + (1 << 16)]
        differ = rows[now] != rows[order[at - 1 : at - 1 + len(now)]]
        out[at : at + len(now)] = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
    return out


def repeats(after: np.ndarray, before: np.ndarray, least: np.ndarray, most: np.ndarray, on_first=None) -> tuple[np.ndarray, ...]:
    """Which strings around the given anchors repeat an earlier one.

    Rows are in reading order: ``after`` holds the bytes from an anchor on,
    ``before`` those in front of it, backwards, both padded. A string with x
    bytes in front of its anchor (least <= x <= most) repeats when an earlier row
    has the same x bytes before and the same bytes after. Returns the least and
    most x that repeat, and the least and most that do not; (1, 0) for none.
    ``on_first`` is called with x and the rows whose string is new.
    """
    n = len(after)
    order_a, order_b = multikey_order(after), multikey_order(before)
    same_a, same_b = common_prefixes(after, order_a), common_prefixes(before, order_b)
    class_a, class_b = np.empty(n, np.int64), np.empty(n, np.int64)
    low_old, high_old, low_new, high_new = np.ones(n, int), np.zeros(n, int), np.ones(n, int), np.zeros(n, int)
    for x in range(int(least.min(initial=0)), int(most.max(initial=-1)) + 1):
        rows = np.nonzero((least <= x) & (x <= most))[0]
        if not len(rows):
            continue
        class_a[order_a] = np.cumsum(same_a < LENGTH - x)
        class_b[order_b] = np.cumsum(same_b < x)
        first = np.unique(class_a[rows] * (n + 1) + class_b[rows], return_index=True)[1]
        is_new = np.zeros(len(rows), bool)
        is_new[first] = True
        for which, low, high in ((rows[~is_new], low_old, high_old), (rows[is_new], low_new, high_new)):
            low[which] = np.where(low[which] > high[which], x, low[which])
            high[which] = x
        if on_first is not None:
            on_first(x, rows[is_new])
    return low_old, high_old, low_new, high_new


def _matrix(raw: np.ndarray, start: np.ndarray, size: np.ndarray, width: int, step: int = 1) -> np.ndarray:
    """Rows of ``size`` bytes from ``start`` on, forwards or backwards, padded with zeros."""
    out = np.zeros((len(start), width), np.uint8)
    column = np.arange(width)
    for a in range(0, len(start), 1 << 16):
        part = slice(a, a + (1 << 16))
        there = column < size[part, None]
        at = start[part, None] + step * column
        out[part][there] = raw[at[there]]
    return out


def _around(raw, place, least, most):
    return _matrix(raw, place, LENGTH - least, WIDE), _matrix(raw, place - 1, most, WIDE_LEFT, -1)


def _hashes_by_bucket(buckets: int):
    """Packed anchor hashes and groups of a batch of texts, one row per bucket of hashes."""
    def fn(batches):
        for batch in batches:
            raw, at = packed(batch.column("text"))
            groups = batch.column("g").to_numpy()
            parts = [(np.zeros(0, np.uint64), groups[:0])]
            for a, b in blocks(at):
                place, hashed, _, _ = anchors(raw[at[a] : at[b]], at[a : b + 1] - at[a])
                parts.append((hashed, groups[np.searchsorted(at, place + at[a], "right") - 1]))
            hashed, of = (np.concatenate(x) for x in zip(*parts))
            # an anchor's hash is the least of many, so its leading bits are uneven; the trailing ones are not
            bucket = ((hashed & np.uint64(0xFFFFFFFF)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
            order = np.lexsort((of, hashed, bucket))
            hashed, of, bucket = hashed[order], of[order], bucket[order]
            new = np.ones(len(order), bool)
            new[1:] = (hashed[1:] != hashed[:-1]) | (of[1:] != of[:-1])
            hashed, of, bucket = hashed[new], of[new], bucket[new]
            edge = np.searchsorted(bucket, np.arange(buckets + 1))
            full = np.nonzero(np.diff(edge))[0]
            yield pa.RecordBatch.from_arrays(
                [pa.array(full.astype(np.int32)),
                 pa.array([hashed[edge[b] : edge[b + 1]].tobytes() for b in full], pa.binary()),
                 pa.array([of[edge[b] : edge[b + 1]].astype("<i4").tobytes() for b in full], pa.binary())], ["q", "hashes", "groups"])
    return fn


def _shared(table: pa.Table) -> pa.Table:
    """For each group the packed hashes of a bucket that other groups have too."""
    hashed = np.frombuffer(b"".join(table.column("hashes").to_pylist()), np.uint64)
    of = np.frombuffer(b"".join(table.column("groups").to_pylist()), "<i4")
    order = np.lexsort((of, hashed))
    hashed, of = hashed[order], of[order]
    new = np.ones(len(order), bool)
    new[1:] = (hashed[1:] != hashed[:-1]) | (of[1:] != of[:-1])
    hashed, of = hashed[new], of[new]
    again = np.zeros(len(hashed), bool)
    same = hashed[1:] == hashed[:-1]
    again[1:] |= same
    again[:-1] |= same
    hashed, of = hashed[again], of[again]
    order = np.argsort(of, kind="stable")
    hashed, of = hashed[order], of[order]
    groups, edge = np.unique(of, return_index=True)
    edge = np.append(edge, len(of))
    return pa.table({"g": pa.array(groups.astype(np.int32)),
                     "hashes": pa.array([hashed[a:b].tobytes() for a, b in zip(edge[:-1], edge[1:])], pa.binary())})


_RECORD = ("k1 long, k2 long, doc long, low long, high long, place long, least int, most int, "
           "after binary, before binary")
_TYPES = [pa.int64()] * 6 + [pa.int32()] * 2 + [pa.binary()] * 2
_NAMES = ["k1", "k2", "doc", "low", "high", "place", "least", "most", "after", "before"]


def _rows(n: int, **columns) -> pa.Table:
    arrays = [pa.array(columns[c], t) if c in columns else pa.nulls(n, t) for c, t in zip(_NAMES, _TYPES)]
    return pa.Table.from_arrays(arrays, _NAMES)


def _settle(texts: pa.Table, shared: pa.Table) -> pa.Table:
    """Repeats inside one group as byte ranges, and the suffixes that other groups may have."""
    texts = texts.combine_chunks()
    doc, k1, k2 = (texts.column(c).to_numpy() for c in ("doc", "k1", "k2"))
    order = np.lexsort((k2, k1, doc))
    same = np.zeros(len(order), bool)
    same[1:] = (k1[order][1:] == k1[order][:-1]) & (k2[order][1:] == k2[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    # copies of a text count once, at the smallest id
    seen, keep = set(), []
    for i in order[~same].tolist():
        if (key := (k1[i], k2[i])) not in seen:
            seen.add(key)
            keep.append(i)
    keep = np.array(keep, int)
    doc, k1, k2 = doc[keep], k1[keep], k2[keep]
    column = texts.column("text")
    if len(keep) < texts.num_rows or (np.diff(keep) != 1).any():
        column = column.take(pa.array(keep))
    raw, at = packed(column.combine_chunks() if column.num_chunks != 1 else column.chunk(0))
    place, hashed, least, most = anchors(raw, at)
    of = np.searchsorted(at, place, "right") - 1
    blob = b"".join(shared.column("hashes").to_pylist()) if shared.num_rows else b""
    elsewhere = np.isin(hashed, np.frombuffer(blob, np.uint64))
    by_hash = np.argsort(hashed, kind="stable")
    twin = np.zeros(len(hashed), bool)
    near = hashed[by_hash][1:] == hashed[by_hash][:-1]
    twin[by_hash[1:]] |= near
    twin[by_hash[:-1]] |= near
    own = np.nonzero(twin)[0]
    parts = [_rows(0)]
    if len(own):
        low_old, high_old, low_new, high_new = repeats(*_around(raw, place[own], least[own], most[own]), least[own], most[own])
        old = np.nonzero(low_old <= high_old)[0]
        here, text = place[own][old], of[own][old]
        parts.append(_rows(len(old), k1=k1[text], k2=k2[text], low=here - high_old[old] - at[text],
                           high=here - low_old[old] + LENGTH - at[text]))
        least[own], most[own] = low_new, high_new
    out = np.nonzero(elsewhere & (least <= most))[0]
    if len(out):
        text, data = of[out], raw.tobytes()
        here, low, high = place[out], least[out], most[out]
        parts.append(_rows(
            len(out), k1=k1[text], k2=k2[text], doc=doc[text], place=here - at[text], least=low, most=high,
            after=[data[p : p + LENGTH - x] for p, x in zip(here.tolist(), low.tolist())],
            before=[data[p - x : p][::-1] for p, x in zip(here.tolist(), high.tolist())]))
    return pa.concat_tables(parts).combine_chunks()


_FOUND = "k1 long, k2 long, doc long, low long, high long, digest binary"


def _compare(batches):
    """Repeats among the sorted suffixes of one bucket, and the strings at its two ends."""
    held = list(batches)
    if not sum(b.num_rows for b in held):
        return
    table = pa.Table.from_batches(held).combine_chunks()
    doc, k1, k2, place = (table.column(c).to_numpy() for c in ("doc", "k1", "k2", "place"))
    order = np.lexsort((place, k2, k1, doc))
    table = table.take(pa.array(order))
    doc, k1, k2, place = doc[order], k1[order], k2[order], place[order]
    least, most = (table.column(c).to_numpy().astype(np.int64) for c in ("least", "most"))
    sides = []
    for name, width in (("after", WIDE), ("before", WIDE_LEFT)):
        column = table.column(name).combine_chunks()
        column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
        raw, at = packed(column.cast(pa.large_binary()).view(pa.large_string()))
        sides.append(_matrix(raw, at[:-1], np.diff(at), width))
    after, before = sides
    head = np.ascontiguousarray(after[:, :GRAM]).view(f"V{GRAM}").ravel()
    names = [bytes(h) for h in head]
    ends = {min(names), max(names)}
    at_end = np.array([n in ends for n in names])
    marks: list[tuple[int, int, bytes]] = []

    def first(x: int, rows: np.ndarray) -> None:
        for r in rows[at_end[rows]].tolist():
            string = before[r, :x][::-1].tobytes() + after[r, : LENGTH - x].tobytes()
            marks.append((r, x, hashlib.blake2b(string, digest_size=16).digest()))

    low_old, high_old, _, _ = repeats(after, before, least, most, first)
    old = np.nonzero(low_old <= high_old)[0]
    yield pa.RecordBatch.from_arrays(
        [pa.array(k1[old]), pa.array(k2[old]), pa.array(doc[old]), pa.array(place[old] - high_old[old]),
         pa.array(place[old] - low_old[old] + LENGTH), pa.nulls(len(old), pa.binary())],
        ["k1", "k2", "doc", "low", "high", "digest"])
    for a in range(0, len(marks), 50_000):
        part = marks[a : a + 50_000]
        r = np.array([m[0] for m in part])
        start = place[r] - np.array([m[1] for m in part])
        yield pa.RecordBatch.from_arrays(
            [pa.array(k1[r]), pa.array(k2[r]), pa.array(doc[r]), pa.array(start), pa.array(start + LENGTH),
             pa.array([m[2] for m in part], pa.binary())], ["k1", "k2", "doc", "low", "high", "digest"])


def _text_key() -> list[Column]:
    return [F.xxhash64("text").alias("k1"), (F.crc32(F.col("text").cast("binary")) * F.lit(1 << 31) + F.octet_length("text")).alias("k2")]


def repeated_ranges(texts: DataFrame, total_bytes: int) -> DataFrame:
    """(k1, k2, low, high): byte ranges to remove from the texts (k1, k2, doc, text), ranges may overlap."""
    spark = texts.sparkSession
    importable(spark)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    groups = max(tasks, total_bytes // GROUP_BYTES + 1)
    grouped = texts.withColumn("g", F.pmod(F.xxhash64("k1", F.lit(9)), F.lit(groups)).cast("int"))
    packs = in_arrow(grouped.select("text", "g"), _hashes_by_bucket(groups), "q int, hashes binary, groups binary")
    shared = packs.groupBy("q").applyInArrow(_shared, "g int, hashes binary")
    settled = grouped.groupBy("g").cogroup(shared.groupBy("g")).applyInArrow(_settle, _RECORD)
    settled = materialise(settled, "suffixes")
    suffixes = settled.where("after is not null").select("k1", "k2", "doc", "place", "least", "most", "after", "before")
    found = materialise(in_arrow(suffixes.repartitionByRange("after", "before"), _compare, _FOUND), "suffix-repeats")
    ends = found.where("digest is not null")
    order = F.struct("doc", "k1", "k2", "low")
    first = ends.groupBy("digest").agg(F.min(order).alias("first"))
    across = ends.join(first, "digest").where(order > F.col("first"))
    parts = [settled.where("after is null"), found.where("digest is null"), across]
    out = parts[0].select("k1", "k2", "low", "high")
    for part in parts[1:]:
        out = out.unionByName(part.select("k1", "k2", "low", "high"))
    return out


def _cut(keep_bytes: bool):
    """What is left of each text without its ranges, block by block."""
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]

    def fn(batches):
        for batch in batches:
            raw, at = packed(batch.column("text"))
            lows, highs = batch.column("lows"), batch.column("highs")
            for a, b in blocks(at):
                whole = raw[at[a] : at[b]].tobytes()
                removed, spans, digests, kept = [], [], [], []
                for i in range(a, b):
                    text = whole[at[i] - at[a] : at[i + 1] - at[a]]
                    if lows[i].is_valid:
                        low, high = (np.asarray(x[i].values.to_numpy(zero_copy_only=False), np.int64) for x in (lows, highs))
                        order = np.argsort(low, kind="stable")
                        low, high = low[order], np.maximum.accumulate(high[order])
                        new = np.ones(len(low), bool)
                        new[1:] = low[1:] > high[:-1]
                        start = low[new]
                        stop = high[np.append(np.nonzero(new)[0][1:], len(low)) - 1]
                        rest = b"".join([text[x:y] for x, y in zip([0, *stop.tolist()], [*start.tolist(), len(text)])])
                    else:
                        start, rest = (), text
                    removed.append(len(text) - len(rest))
                    spans.append(len(start))
                    digests.append(hashlib.sha256(rest).hexdigest())
                    if keep_bytes:
                        kept.append(rest)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(a, b - a), pa.array(np.diff(at[a : b + 1])), pa.array(removed, pa.int64()),
                     pa.array(spans, pa.int64()), pa.array(digests, pa.string()),
                     pa.array(kept, pa.binary()) if keep_bytes else pa.nulls(b - a, pa.binary())], names)
    return fn


def without_repeats(docs: DataFrame, most_listed: int = 1_000_000, keep_bytes: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and ``kept``, the kept bytes, of every row.

    Without ``keep_bytes`` the column ``kept`` is null and the bytes stay in their task.
    A null text counts as empty, and nothing is removed from a text of fewer
    than 100 bytes. A text that a smaller doc_id has as well goes as a whole; rows
    with the same id and text count as one document, and get the same result.
    Different texts under one id are told apart by their hashes, and a null id
    comes after all others. Ranges are of bytes, so what is kept need not be
    valid UTF-8. Texts with more copies than a millionth of the rows (64 at
    least) are at most ``most_listed``; they are broadcast by their hashes so
    that their copies are settled without a shuffle.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    keyed = rows.select("doc_id", "text", *_text_key())
    long_enough = F.octet_length("text") >= LENGTH
    copies = materialise(
        keyed.where(long_enough).groupBy("k1", "k2").agg(
            F.min("doc_id").alias("first"), F.count("*").alias("n"), F.max(F.octet_length("text")).alias("bytes")), "text-copies")
    total, number = copies.agg(F.sum("bytes"), F.sum("n")).first()
    empty, none = F.lit("").cast("binary"), F.lit(None).cast("binary")
    short = keyed.where(~long_enough).select(
        "doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"),
        F.lit(0).cast("long").alias("n_spans"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"),
        (F.col("text").cast("binary") if keep_bytes else none).alias("kept"))
    if not number:
        return short
    hot = copies.where(F.col("n") > max(64, number // most_listed)).select("k1", "k2", F.col("first").alias("hot_first"), F.lit(True).alias("hot"))
    marked = keyed.where(long_enough).join(F.broadcast(hot), ["k1", "k2"], "left")
    later = F.col("hot") & F.coalesce(F.col("doc_id") > F.col("hot_first"), F.col("doc_id").isNull() & F.col("hot_first").isNotNull())
    later = F.coalesce(later, F.lit(False))
    gone = marked.where(later).select(
        "doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.octet_length("text").cast("long").alias("n_removed"),
        F.lit(1).cast("long").alias("n_spans"), F.sha2(empty, 256).alias("kept_sha256"), (empty if keep_bytes else none).alias("kept"))
    rest = marked.where(~later).select("doc_id", "text", "k1", "k2", "hot")
    texts = rest.select("k1", "k2", F.coalesce("doc_id", F.lit(int(LAST))).alias("doc"), "text", "hot")
    # a frequent text's rows of one id, or without an id, count as one: each task sends one of them on
    frequent = texts.where("hot").groupBy("k1", "k2", "doc").agg(F.first("text").alias("text"))
    ranges = repeated_ranges(texts.where("hot is null").drop("hot").unionByName(frequent), int(total))
    lists = ranges.groupBy("k1", "k2").agg(F.collect_list("low").alias("lows"), F.collect_list("high").alias("highs"))
    known = copies.select("k1", "k2", "first").join(lists, ["k1", "k2"], "left")
    joined = rest.join(known, ["k1", "k2"])
    copy = F.coalesce(F.col("doc_id") > F.col("first"), F.col("doc_id").isNull() & F.col("first").isNotNull())
    cut = joined.select(
        "doc_id", "text", F.when(copy, F.array(F.lit(0).cast("long"))).otherwise(F.col("lows")).alias("lows"),
        F.when(copy, F.array(F.octet_length("text").cast("long"))).otherwise(F.col("highs")).alias("highs"))
    done = in_arrow(cut, _cut(keep_bytes), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return done.unionByName(gone).unionByName(short)
