"""Periodic runs against brute force, and the query's digests against plain Python."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import pytest
from cases import documents, rows
from pyspark.testing import assertDataFrameEqual

from panelworks.llm import runs
from panelworks.llm.queries import QUERIES


def smallest_period(words: list) -> int:
    return next(p for p in range(1, len(words) + 1) if words[p:] == words[: len(words) - p])


def plain_runs(words: list, least: int = 12) -> list[tuple[int, int, int]]:
    out, n = [], len(words)
    for q in range(1, n // 2 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least, 2 * q) and smallest_period(words[i : j + q]) == q:
                out.append((i, j + q - i, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def sequences(seed: int, n: int):
    rng = random.Random(seed)
    for k in range(n):
        few, size = rng.randint(1, 4), rng.randint(0, 140)
        if k % 3 == 0:
            yield [rng.randint(0, few) for _ in range(size)]
        elif k % 3 == 1:  # powers of short words, one after the other
            out = []
            while len(out) < size:
                out += [rng.randint(0, few) for _ in range(rng.randint(1, 20))] * rng.randint(1, 7)
            yield out
        else:  # a stretch of one period that comes again after other words
            one, two = ([rng.randint(0, few) for _ in range(rng.randint(1, 5))] for _ in range(2))
            yield (one * rng.randint(1, 9) + two) * rng.randint(1, 4) + one * 2 + two[:1]


@pytest.mark.parametrize("seed", range(4))
def test_runs_equal_brute_force(seed):
    for words in sequences(seed, 400):
        assert runs.runs_of(words) == plain_runs(words), words


def test_fibonacci_words_have_all_their_runs():
    one, two = [0], [0, 1]
    while len(two) < 400:
        one, two = two, two + one
    assert runs.runs_of(two) == plain_runs(two)


def test_appending_word_by_word_reports_a_run_when_it_ends():
    catchers = runs.Catchers()
    for word in [1, 2, 3] * 5 + [4]:
        catchers.append(word)
    assert catchers.runs == [(0, 15, 3)]
    assert catchers.close() == [(0, 15, 3)] and runs.runs_of([1] * 11) == []
    with pytest.raises(ValueError):
        runs.Catchers(4)


def test_long_runs():
    assert runs.runs_of(["a"] * 20_000) == [(0, 20_000, 1)]
    assert runs.runs_of([i % 37 for i in range(30_000)]) == [(0, 30_000, 37)]


def plain_row(doc_id, text) -> tuple:
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if doc_id is not None and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = plain_runs(words) if n < 3000 else runs.runs_of(words)  # brute force is quadratic
    kept = [w for i, w in enumerate(words) if not any(s + q <= i < s + m for s, m, q in found)]
    top = min(((-m, s, q) for s, m, q in found), default=None)
    lines = "".join(f"{s},{m},{q}\n" for s, m, q in found)
    return (doc_id, len(found), *((top[1], -top[0], top[2], 1000 * -top[0] // top[2]) if top else (None,) * 4),
            hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(" ".join(kept).encode()).hexdigest())


def looping_ids(n: int) -> list[int]:
    return [i for i in range(1000, 9000) if zlib.crc32(str(i).encode()) % 10 == 0][:n]


def test_query_rows_equal_plain_python(spark):
    given = rows()
    texts = [r[1] for r in rows(False)]
    given += [(i, texts[k % len(texts)], "aa") for k, i in enumerate(looping_ids(60))]
    given += [(-5, "a  b\x0bc\x0c" * 30, None), (7, "é É é É " * 9, None)]
    found = runs.digests(runs.periodic_runs(runs.looped(documents(spark, given))))
    expected = spark.createDataFrame([plain_row(d, t) for d, t, _ in given], found.schema)
    assertDataFrameEqual(found, expected)


def test_query_on_the_small_tables(spark, folder):
    found = QUERIES["op13_periodic_runs"][0](spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    expected = spark.createDataFrame([plain_row(d, t) for d, t in docs], found.schema)
    assertDataFrameEqual(found, expected)


def test_empty_table(spark):
    assert runs.digests(runs.periodic_runs(runs.looped(documents(spark, [])))).count() == 0
