"""Benchmark decontamination by template windows with slot checks.

Words are lower-cased and freed of punctuation at their ends; numbers, names
(capitalised words inside a sentence) and units behind a number become typed
placeholders; a capitalised word that opens a sentence is read both ways. Windows of eight such words are joined by their hash, and beside
them all windows by the words themselves, whatever their letter case. A filter of
fixed size, two megabytes whatever the tables hold, keeps most document windows
out of the shuffle before the join. Along one alignment of a document with an
item, every slot value of the item must always meet the same value of the
document. A value that meets two is torn: a template window that holds it does
not count. All others do, and so do windows equal word for word. A torn alignment
is no hit when only one template window is left, or only one window word for
word that holds a torn value, or one of each.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelworks.llm.common import blocks, in_arrow, packed, without
from panelworks.llm.textstats import LOWER, word_hashes, words
from panelworks.session import materialise

WINDOW = 8
LEAST = 5  # an item with fewer words has no template
SHORTEST = 4  # an item with fewer words is told from chance by nothing
FILTER_BITS = 24

# fixed values: units that are a slot when they follow a number
UNITS = (
    "kg g mg lb lbs oz ton tons tonnes km m cm mm mi mile miles ft foot feet inch inches yd yards meter meters metre metres "
    "s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years ms "
    "l ml liter liters litre litres gallon gallons usd eur gbp dollar dollars euro euros cent cents percent "
    "kmh mph kph hz khz mhz ghz kb mb gb tb w kw v volts amp amps degrees celsius fahrenheit"
).split()


def _mark(text: str) -> np.uint64:
    return np.uint64(xxhash.xxh64_intdigest(text.encode(), 3))


NUMBER, NAME, UNIT, QUANTITY = (_mark(f"\0{x}") for x in ("number", "name", "unit", "quantity"))
SLOTS = np.array([NUMBER, NAME, UNIT, QUANTITY], np.uint64)
_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_NUMERIC = _DIGIT.copy()
_NUMERIC[[ord(c) for c in ".,:/"]] = True
_END = np.zeros(256, bool)
_END[[ord(c) for c in ".!?:"]] = True


def lowered(data: np.ndarray) -> np.ndarray:
    """ASCII and Latin-1 capitals as small letters, of the same length in UTF-8."""
    low = LOWER[data]
    if len(low) > 1:
        latin = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        low[1:][latin] += 32
    return low


def _unit_hashes() -> np.ndarray:
    data = np.frombuffer(" ".join(UNITS).encode(), np.uint8)
    return np.unique(word_hashes(data, *words(data, np.array([0, len(data)]))))


_UNIT_HASHES = _unit_hashes()


def template(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Canonical hash, own hash and document of every word with a letter or digit, and whether it may be a name that opens a sentence."""
    start, end = words(data, offsets)
    alnum = _ALNUM[data]
    place = np.arange(len(data) + 1)
    # first such byte at or after each place, last one before each place
    after = np.minimum.accumulate(np.where(np.append(alnum, True), place, len(data))[::-1])[::-1]
    before = np.maximum.accumulate(np.where(np.insert(alnum, 0, True), place, 0))
    first, last = after[start], before[end]
    real = first < last
    ended = _END[data[end - 1]] if len(end) else np.zeros(0, bool)
    new_line = np.zeros(len(start), bool)
    if len(start) > 1:
        breaks = np.concatenate([[0], np.cumsum(data == 10)])
        new_line[1:] = breaks[start[1:]] > breaks[end[:-1]]
    owner = np.searchsorted(offsets, start, "right") - 1
    opens = np.ones(len(start), bool)
    opens[1:] = ended[:-1] | new_line[1:] | (owner[1:] != owner[:-1])
    start, end, owner, opens = first[real], last[real], owner[real], opens[real]
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), owner, real[:0]
    own = word_hashes(lowered(data), start, end)
    digits = np.concatenate([[0], np.cumsum(_DIGIT[data])])
    numeric = np.concatenate([[0], np.cumsum(_NUMERIC[data])])
    number = (digits[end] > digits[start]) & (numeric[end] - numeric[start] == end - start)
    quantity = ~number & _DIGIT[data[start]]
    lead, follow = data[start], data[np.minimum(start + 1, len(data) - 1)]
    capital = ((lead >= 65) & (lead <= 90)) | ((lead == 0xC3) & (follow >= 0x80) & (follow <= 0x9E) & (follow != 0x97))
    unit = np.zeros(len(start), bool)
    unit[1:] = number[:-1] & (owner[1:] == owner[:-1])
    unit &= np.isin(own, _UNIT_HASHES)
    canon = own.copy()
    canon[capital & ~opens] = NAME
    canon[unit] = UNIT
    canon[quantity] = QUANTITY
    canon[number] = NUMBER
    return canon, own, owner, capital & opens & ~(unit | quantity | number)


def _hashes(columns: Iterable[np.ndarray], n: int, size: int) -> np.ndarray:
    total = np.full(n, np.uint64(size))
    for column in columns:
        total = total * np.uint64(0x9E3779B97F4A7C15) + column
        total ^= total >> np.uint64(31)
    return total


def readings(canon: np.ndarray, own: np.ndarray, owner: np.ndarray, opener: np.ndarray, size: int,
             wanted_names: np.ndarray | None = None) -> Iterator[tuple]:
    """(exact, opened, starts, hashes, slots) of the windows of ``size`` words in one document, for each way to read them.

    Every window is read by its own words. One with slots is also read as a
    template, and so with its names left literal, as letter case may differ; a
    template counts when half its words or more are literal. Capitalised words
    that open a sentence are literal or names (``opened``): in every combination, or, with
    ``wanted_names``, only so that a window's names lie where one of these bit patterns has
    them. A match needs names at the same places, so the patterns of the items' windows are
    all a document needs. ``slots`` takes places in ``starts`` and gives which words of these
    windows it reads as slots.
    """
    n = len(own) - size + 1
    if n <= 0:
        return
    inside = owner[size - 1 :] == owner[:n]
    starts = np.nonzero(inside)[0]
    yield True, False, starts, _hashes((own[k : k + n] for k in range(size)), n, size)[starts], lambda at: np.zeros((len(at), size), bool)
    if size < LEAST:
        return
    names = canon == NAME
    for read, wanted in ((canon, None), (np.where(names, own, canon), names)):
        slot = np.isin(read, SLOTS)
        count = np.concatenate([[0], np.cumsum(slot)])
        count = (count[size:] - count[:-size])[:n]
        usable = inside & (count > 0) & (2 * count <= size)
        if wanted is not None:
            usable &= sliding_window_view(wanted, size).any(axis=1)
        starts = np.nonzero(usable)[0]
        masks = sliding_window_view(slot, size)
        yield False, False, starts, _hashes((read[starts + k] for k in range(size)), len(starts), size), lambda at, s=starts, m=masks: m[s[at]]
    slot = np.isin(canon, SLOTS)
    rank, count = (np.concatenate([[0], np.cumsum(x)]) for x in (opener, slot))
    openers, count = (rank[size:] - rank[:-size])[:n], (count[size:] - count[:-size])[:n]
    if wanted_names is not None:
        at = np.nonzero(inside & (openers > 0) & (2 * (count + 1) <= size))[0] if len(wanted_names) else count[:0]
        # windows by where their names and openers are: each combination is judged once
        code = np.zeros(len(at), np.int32)
        for k in range(size):
            code |= names[at + k].astype(np.int32) << k | opener[at + k].astype(np.int32) << (k + size)
        order = np.argsort(code, kind="stable")
        kinds, edge = np.unique(code[order], return_index=True)
        read: dict[int, list[np.ndarray]] = {}
        for kind, windows in zip(kinds.tolist(), np.split(at[order], edge[1:])):
            fixed, free = kind & ((1 << size) - 1), kind >> size
            for pattern in wanted_names.tolist():
                more = pattern & ~fixed  # the openers that this pattern reads as names
                if more and not (fixed & ~pattern or more & ~free):
                    read.setdefault(more, []).append(windows)
        masks = sliding_window_view(slot, size) if read else None
        for more, parts in read.items():
            starts = np.concatenate(parts)
            starts = starts[2 * (count[starts] + more.bit_count()) <= size]
            chosen = np.array([more >> k & 1 == 1 for k in range(size)])
            total = _hashes((np.full(len(starts), NAME) if chosen[k] else canon[starts + k] for k in range(size)), len(starts), size)
            yield False, True, starts, total, lambda at, s=starts, m=masks, c=chosen: m[s[at]] | c
        return
    having = [np.nonzero(inside & (openers >= k) & (2 * (count + 1) <= size))[0] for k in range(size + 1)]
    for choice in range(1, 1 << max((k for k in range(size + 1) if len(having[k])), default=0)):
        starts = having[choice.bit_length()]
        starts = starts[2 * (count[starts] + choice.bit_count()) <= size]
        if len(starts):
            chosen = np.stack([opener[starts + k] & (choice >> (rank[starts + k] - rank[starts]) & 1 == 1) for k in range(size)])
            total = _hashes((np.where(chosen[k], NAME, canon[starts + k]) for k in range(size)), len(starts), size)
            masks = chosen.T | sliding_window_view(slot, size)[starts]
            yield False, True, starts, total, lambda at, m=masks: m[at]


def _lists(values: list) -> pa.ListArray:
    counts = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(counts), pa.array(np.concatenate([np.zeros(0, np.int64), *values]).astype(np.int64)))


def _emit(sizes: list[int], chosen: np.ndarray | None, whole_items: bool, patterns: dict[int, np.ndarray] | None = None):
    """Windows of each text: all of an item's, or those of a document that pass the filter."""
    def fn(batches):
        for batch in batches:
            raw, at = packed(batch.column("text"))
            names = batch.column("id")
            for a, b in blocks(at):
                canon, own, owner, opener = template(raw[at[a] : at[b]], at[a : b + 1] - at[a])
                slot = np.isin(canon, SLOTS)
                first = np.searchsorted(owner, np.arange(b - a))
                number = np.bincount(owner, minlength=b - a)
                ids, sizes_out, kinds, opens, hashes, places, lengths, values, held, named = [], [], [], [], [], [], [], [], [], []
                for size in sizes:
                    wanted = None if patterns is None else patterns.get(size, np.zeros(0, np.int64))
                    for exact, opened, starts, total, slots in readings(canon, own, owner, opener, size, wanted):
                        usable = np.ones(len(starts), bool)
                        if whole_items:
                            n_words = number[owner[starts]]
                            usable &= (n_words >= WINDOW) if size == WINDOW else (n_words == size)
                        if chosen is not None:
                            key = (total >> np.uint64(64 - FILTER_BITS)).astype(np.int64)
                            usable &= chosen[key >> 3] >> (key & 7).astype(np.uint8) & 1 == 1
                        used = np.nonzero(usable)[0]
                        at_word = starts[used]
                        of = owner[at_word]
                        ids.append(of)
                        sizes_out.append(np.full(len(of), size, np.int32))
                        kinds.append(np.full(len(of), exact))
                        opens.append(np.full(len(of), opened))
                        hashes.append(total[used].view(np.int64))
                        places.append(at_word - first[of])
                        lengths.append(number[of])
                        marks = slots(used)
                        values += [own[w : w + size][m].view(np.int64) for w, m in zip(at_word.tolist(), marks)]
                        if whole_items:
                            # slots that are names by their capital alone, or openers read as names
                            is_name = marks & ~np.isin(canon[at_word[:, None] + np.arange(size)], SLOTS[SLOTS != NAME])
                            named.append((is_name << np.arange(size)).sum(axis=1))
                            held += [own[w : w + size][m | slot[w : w + size]].view(np.int64) for w, m in zip(at_word.tolist(), marks)]
                of = np.concatenate([np.zeros(0, np.int64), *ids])
                joined = lambda parts, kind: pa.array(np.concatenate([np.zeros(0, kind), *parts]).astype(kind))
                yield pa.RecordBatch.from_arrays(
                    [names.slice(a, b - a).take(pa.array(of)), joined(sizes_out, np.int32), joined(kinds, bool), joined(opens, bool),
                     joined(hashes, np.int64), joined(places, np.int64), joined(lengths, np.int64), _lists(values), _lists(held or [[]] * len(of)),
                     joined(named or [np.zeros(len(of))], np.int64)],
                    ["id", "size", "exact", "opened", "hash", "place", "n_words", "slots", "held", "names"])
    return fn


_WINDOW = "id long, size int, exact boolean, opened boolean, hash long, place long, n_words long, slots array<long>, held array<long>, names long"


def _filter(items: DataFrame) -> np.ndarray:
    """Bits of the leading hash bits that occur among the items' windows; 2**24 bits at most."""
    bucket = F.shiftrightunsigned("hash", 64 - FILTER_BITS)
    parts = items.select(bucket.alias("b")).groupBy(F.expr("b div 32768").alias("page")).agg(
        F.expr("bitmap_construct_agg(b % 32768)").alias("bits")).collect()
    chosen = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
    for page, bits in parts:
        chosen[page * 4096 : (page + 1) * 4096] = np.frombuffer(bits, np.uint8)
    return chosen


def _patterns(items: DataFrame) -> dict[int, np.ndarray]:
    """Where the items' template windows have names, as bit patterns per window size; 2**8 of a size at most."""
    rows = items.where("not exact and names > 0").select("size", "names").distinct().collect()
    return {size: np.array(sorted(r["names"] for r in rows if r["size"] == size)) for size in {r["size"] for r in rows}}


def contamination(docs: DataFrame, benchmark: DataFrame, least_share: float = 0.0) -> DataFrame:
    """(doc_id, item_id, n_windows, share, doc_word, item_word) of every document that holds part of an item.

    One row per pair, for its best alignment: the number of matching windows,
    their share of the item's windows, and where the first of them starts in
    words. An item of 5 to 7 words is one window; one of 4 words
    matches word for word, a shorter one nothing. Null texts and ids match nothing; repeated rows of either table
    count once. Only doc_id, item_id and text are read. Windows of which more
    than half are placeholders match by their own words only.
    """
    texts = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("id"), "text")
    items = in_arrow(texts, _emit([WINDOW, *range(SHORTEST, WINDOW)], None, True), _WINDOW).distinct()
    items = materialise(items, "template-items")
    sizes = sorted((r["size"] for r in items.select("size").distinct().collect()), reverse=True) or [WINDOW]
    rows = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("id"), "text")
    found = in_arrow(rows, _emit(sizes, _filter(items), False, _patterns(items)), _WINDOW).drop("held", "names")
    right = items.select(
        "size", "exact", "hash", F.col("id").alias("item_id"), F.col("opened").alias("item_opened"), F.col("place").alias("item_word"), F.col("slots").alias("item_slots"), F.col("held").alias("item_held"),
        (F.col("n_words") - F.col("size") + 1).alias("of"))
    same = found.withColumnRenamed("id", "doc_id").join(right, ["size", "exact", "hash"]).where("size(slots) = size(item_slots)")
    same = materialise(same.select(
        "doc_id", "item_id", (F.col("place") - F.col("item_word")).alias("shift"), "place", "item_word", "of", "exact",
        F.expr("opened or item_opened").alias("opened"), F.col("slots").alias("mine"), F.col("item_slots").alias("theirs"), "item_held"), "template-pairs")
    line = ["doc_id", "item_id", "shift"]
    pairs = same.where("not exact").select(*line, "opened", F.inline(F.arrays_zip("mine", "theirs")))
    pairs = pairs.groupBy(*line, "theirs", "mine").agg(F.bool_and("opened").alias("opened"))
    torn = pairs.groupBy(*line, "theirs").agg(F.count("*").alias("n"), F.count_if(~F.col("opened")).alias("inner")).where("n > 1")
    # what only the openers of sentences tear counts against windows that read an opener as a name
    torn = torn.groupBy(*line).agg(F.collect_set("theirs").alias("any_torn"), F.collect_set(F.expr("if(inner > 1, theirs, null)")).alias("torn"))
    held = F.coalesce(F.arrays_overlap("item_held", F.when(F.col("opened"), F.col("any_torn")).otherwise(F.col("torn"))), F.lit(False))
    # one row per place: a window is sound by its own words or when it holds no torn slot
    places = same.join(torn, line, "left").groupBy(*line, "place").agg(
        F.bool_or("exact").alias("exact"), F.bool_or(~held).alias("clear"), F.min("item_word").alias("item_word"), F.max("of").alias("of"),
        F.bool_or(F.expr("coalesce(size(torn), 0) > 0")).alias("torn"))
    runs = places.where("exact or clear").groupBy(*line).agg(
        F.count("*").alias("n_windows"), F.min("place").alias("doc_word"), F.min("item_word").alias("item_word"), F.max("of").alias("of"),
        F.bool_or(F.expr("exact and clear")).alias("firm"), F.count_if("exact").alias("n_exact"), F.count_if(~F.col("exact")).alias("n_clear"),
        F.bool_or("torn").alias("torn")).where("not torn or firm or n_exact > 1 or n_clear > 1")
    best = Window.partitionBy("doc_id", "item_id").orderBy(F.desc("n_windows"), "doc_word", "shift")
    return (
        runs.withColumn("share", F.col("n_windows") / F.col("of")).where(F.col("share") >= least_share)
        .withColumn("rank", F.row_number().over(best)).where("rank = 1")
        .select("doc_id", "item_id", "n_windows", "share", "doc_word", "item_word")
    )


def without_benchmark(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no part of a benchmark item; a null doc_id stays."""
    return without(docs, contamination(docs, benchmark), "template-gone")
