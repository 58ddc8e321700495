"""Periodic runs of words, found online with catchers over completed dyadic blocks.

Words are appended one by one. A block of 2, 4, 8, ... words that starts at a
multiple of its length gets a catcher when it is complete. Every appended word
advances the suffix comparison level by level: the last ``m`` words carry the
name of a caught block only if both their halves do, so a new suffix costs one
look-up. A suffix that equals a caught block ``q`` words back, with ``q`` in the
catcher's reach, is the middle of a possible square of period ``q``: it is
extended to the left at once, and to the right with the words that follow. The
squares of one period that meet are one run.
"""

from __future__ import annotations

from itertools import count

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelworks.llm.common import blocks, in_arrow, packed

LEAST = 12  # words of the shortest run
SMALLEST = 2  # words of the smallest block: a run of 12 words repeats 6 of them at least, so it holds a whole one


class Catchers:
    """Online detection: ``append`` words, then ``close``; ``runs`` holds (start, length, period).

    A run is a stretch of ``least`` words at least, and of two periods at least,
    that no neighbouring word extends; its period is the smallest one.
    ``squares`` counts the first squares reported for each run.
    """

    def __init__(self, least: int = LEAST):
        if least < LEAST:
            raise ValueError(f"runs of fewer than {LEAST} words can hold no whole block twice")
        self.least, self.runs, self.squares = least, [], 0
        self._words: list[int] = []
        self._live: dict[int, int] = {}  # period -> start of the stretch that has it up to the last word
        # for blocks of 2, 4, ... words: names of pairs of halves, names of the complete blocks, name of the suffix at a place
        self._levels: list[tuple[dict, list, dict]] = [({}, [], {})]
        self._names = count(1)

    def append(self, word: int) -> None:
        self.extend((word,))

    def extend(self, new) -> None:
        """Append whole numbers below 2**32, one after the other."""
        words, live, levels, names = self._words, self._live, self._levels, self._names
        first_pairs, first_blocks, first_ends = levels[0]
        for at, word in enumerate(new, len(words)):
            words.append(word)
            if live:
                for period in [q for q in live if words[at - q] != word]:
                    self._finish(period, live.pop(period), at)
            if not at:
                continue
            # level 0: the last two words; pairs of names are kept as one number
            key = words[at - 1] << 32 | word
            name = first_pairs.get(key)
            known = name is not None
            if at & 1:  # a block is complete: from now on it is watched for
                if not known:
                    first_pairs[key] = name = next(names)
                first_blocks.append(name)
            elif not known:
                continue
            first_ends[at] = name
            if known:
                self._catch(first_blocks, 2, at, name)
            size, level, left = 4, 1, first_ends.get(at - 2)
            while left is not None:
                if level == len(levels):
                    levels.append(({}, [], {}))
                pairs, caught, ends = levels[level]
                key = left << 32 | name
                name = pairs.get(key)
                known = name is not None
                if not (at + 1) % size:
                    if not known:
                        pairs[key] = name = next(names)
                    caught.append(name)
                elif not known:
                    break
                ends[at] = name
                if known:
                    self._catch(caught, size, at, name)
                left, size, level = ends.get(at - size), 2 * size, level + 1

    def close(self) -> list[tuple[int, int, int]]:
        """Ends the runs that go up to the last word; all runs by start, then period."""
        for period, start in self._live.items():
            self._finish(period, start, len(self._words))
        self._live.clear()
        return sorted(self.runs, key=lambda run: (run[0], run[2]))

    def _catch(self, row: list, size: int, at: int, name: int) -> None:
        """Periods whose square may hold the suffix and an equal block within the catchers' reach."""
        words, live = self._words, self._live
        begin = at - size + 1
        # the reaches of the levels meet: 1 to 7 words for the smallest blocks, two to four times the size for others
        nearest, furthest = (1, 4 * size) if size == SMALLEST else (2 * size, 4 * size)
        for k in range(max(0, -(-(begin - furthest + 1) // size)), (begin - nearest) // size + 1):
            if row[k] != name:
                continue
            block = k * size
            period = begin - block
            # words around the block with a smaller period that divides this one are a run of the smaller one
            if period in live or any(period % q == 0 and start <= block for q, start in live.items()):
                continue
            start = block
            while start and words[start - 1] == words[start - 1 + period]:
                start -= 1
            live[period] = start

    def _finish(self, period: int, start: int, stop: int) -> None:
        if stop - start >= max(self.least, 2 * period):
            self.squares += 1
            self.runs.append((start, stop - start, period))


def runs_of(words, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of a sequence of words."""
    numbers = {word: k for k, word in enumerate(dict.fromkeys(words))}
    catchers = Catchers(least)
    catchers.extend(map(numbers.__getitem__, words))
    return catchers.close()


def collapsed(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words that no run holds after its first period."""
    out, done = [], 0
    # runs come by start, but what a run drops starts a period later
    for low, high in sorted((start + period, start + length) for start, length, period in runs):
        if high > done:
            out += words[done : max(low, done)]
            done = high
    return out + words[done:]


_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def _search(least: int):
    def fn(batches):
        for batch in batches:
            raw, at = packed(batch.column("text"))
            ids = batch.column("doc_id")
            for a, b in blocks(at):
                whole = raw[at[a] : at[b]].tobytes()
                found, kept = [], []
                for i in range(a, b):
                    words = whole[at[i] - at[a] : at[i + 1] - at[a]].split()
                    runs = runs_of(words, least)
                    found.append([{"start": s, "length": n, "period": q} for s, n, q in runs])
                    kept.append(b" ".join(collapsed(words, runs)))
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(a, b - a), pa.array(found, _RUNS), pa.array(kept, pa.binary()).cast(pa.string())],
                    ["doc_id", "runs", "collapsed"])
    return fn


def periodic_runs(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id, runs (start, length, period; by start, then period) and the collapsed text of every row.

    Words are what white space (space, tab to carriage return) separates. A null
    text, an empty one and one without words have no run and an empty collapsed
    text. Rows are judged one by one, so repeated rows and a null doc_id give
    their own result; an empty table gives an empty one. Only doc_id and text
    are read. Work is n log n for a text of n words, and more only where long
    stretches of one period come again with other words between them.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text"))
    return in_arrow(rows, _search(least), "doc_id long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def looped(docs: DataFrame) -> DataFrame:
    """doc_id and text, where the text of one row in ten repeats itself from some word on.

    With h the crc32 of the decimal doc_id and g = h div 10, a text of n > 0 words with
    h mod 10 = 0 goes on from word a = g mod n by repeating the
    1 + (n - a) div (3 + g mod 8) words there. A null doc_id changes nothing.
    """
    words = F.filter(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text"), F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")).alias("h"))
    chosen = F.coalesce((F.col("h") % 10 == 0) & F.col("text").isNotNull(), F.lit(False))
    some = rows.where(chosen).select("doc_id", words.alias("w"), F.expr("h div 10").alias("g")).withColumn("n", F.size("w").cast("long"))
    some = some.withColumn("a", F.expr("if(n > 0, g % n, 0)")).withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    grown = F.expr("transform(sequence(0L, n - 1), i -> w[cast(if(i < a, i, a + (i - a) % p) as int)])")
    some = some.select("doc_id", F.when(F.col("n") > 0, F.array_join(grown, " ")).otherwise("").alias("text"))
    return rows.where(~chosen).select("doc_id", "text").unionByName(some)


def digests(found: DataFrame) -> DataFrame:
    """Run count, the longest run (ties: smallest start, then period) and digests of runs and collapsed text."""
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    top = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("n"), r["start"].alias("start"), r["period"].alias("period"))))
    return found.withColumn("top", top).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("top.start").alias("start"), (-F.col("top.n")).alias("length"),
        F.col("top.period").alias("period"), F.expr("1000 * -top.n div top.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
