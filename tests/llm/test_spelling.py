"""Spelling variants against a plain restatement that compares every pair of words."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pytest
from cases import documents, rows

from panelworks.llm import spelling


def plain_counts(given: list[tuple]) -> Counter:
    counts: Counter = Counter()
    for doc_id, text, *_ in given:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{doc_id}:{run}".encode())
            if doc_id is not None and h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 5:
                counts[run] += 1
    return Counter({w: n for w, n in counts.items() if n >= 3})


def one_edit(a: str, b: str) -> bool:
    if len(a) < len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def plain_variants(counts: dict) -> list[tuple]:
    form, out = {}, []
    for w, n in counts.items():
        near = [v for v in counts if one_edit(w, v)]
        best = min(near, key=lambda v: (-counts[v], v), default=None)
        if best is not None and counts[best] < 2 * n:
            best = None
        form[w] = best
        out.append((w, best, n, len(near), best and counts[best]))
    result = []
    for w, best, n, near, m in out:
        root = w
        while form[root] is not None:
            root = form[root]
        result.append((w, best, root, n, near, m))
    return sorted(result, key=repr)


def rows_of(df) -> list[tuple]:
    assert df.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    return sorted((tuple(r) for r in df.collect()), key=repr)


def edge_documents() -> list[tuple]:
    rng = random.Random(4)
    stems = ["".join(rng.choice("abcé") for _ in range(rng.randint(4, 9))) for _ in range(60)]
    words = stems + [s[:i] + rng.choice("abcÉ÷×ß") + s[i + rng.randint(0, 1) :] for s in stems for i in (0, 1, len(s) // 2, len(s) - 1)]
    weights = [40 if k < 20 else 1 << k % 5 for k in range(len(words))]
    out = [(i, " ".join(rng.choices(words, weights, k=80)), None) for i in range(40)]
    chain = {"stretch": 90, "stretchx": 40, "stretchxy": 18, "stretchxyz": 8, "trechxyz": 4, "tretchxyz": 3}
    out += [(60 + i, " ".join(w for w, n in chain.items() for _ in range(n)), None) for i in range(2)]
    out += [(None, "Colour colour COLOUR color color colorz " * 2, None), (1, "x" * 300 + " " + "x" * 299 + " " + "x" * 300 + "y", None)] * 3
    out += [(50, "naïve-naïve_naïve1naive ÀÉÎÕÜ ÀÉÎÕÜ ÀÉÎÕÜĀ àéîõü àéîõüß àéîõüß àéîõüß", None)] * 2
    return rows() + out


def test_edge_documents_equal_a_plain_restatement(spark):
    given = edge_documents()
    want = plain_variants(plain_counts(given))
    assert sum(w[1] is not None for w in want) > 20 and any(w[2] not in (w[0], w[1]) for w in want)
    assert rows_of(spelling.spelling_variants(documents(spark, given))) == want


@pytest.mark.parametrize("tile", [2, 3, 1000])
def test_hot_halves_in_many_tiles(spark, tile):
    """One half holds nearly all words; every pair of tiles is compared, and no pair twice."""
    rng = random.Random(tile)
    counts = {"aaaaa" + "".join(rng.choice("abc") for _ in range(rng.randint(3, 5))): rng.randint(3, 99) for _ in range(150)}
    vocab = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = {r["word"]: (r["n_near"], r["best"], r["best_n"]) for r in spelling.near_words(vocab, tile).collect()}
    want = {}
    for w in counts:
        near = [v for v in counts if one_edit(w, v)]
        if near:
            best = min(near, key=lambda v: (-counts[v], v))
            want[w] = (len(near), best, counts[best])
    assert got == want


def test_long_chains_of_forms(spark):
    words = ["abcdefghijkl"[:k] for k in range(1, 13)]
    vocab = spark.createDataFrame([(w, 3 << k) for k, w in enumerate(words)], "word string, n long")
    assert {r["root"] for r in spelling.variants(vocab).collect()} == {words[-1]}


def test_nothing_to_compare(spark):
    assert rows_of(spelling.spelling_variants(documents(spark, []))) == []
    assert rows_of(spelling.spelling_variants(documents(spark, [(1, None, None), (2, "", None), (3, "abcd abcd abcd", None)]))) == []
    got = rows_of(spelling.spelling_variants(documents(spark, [(None, "lonely " * 3, None)])))
    assert got == [("lonely", None, "lonely", 3, 0, None)]


def test_query_on_the_small_tables(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    given = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert rows_of(spelling.spelling_variants(docs)) == plain_variants(plain_counts(given))
