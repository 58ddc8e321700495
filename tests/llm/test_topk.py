"""Exact top-k search against every pair."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from cases import EXTRA

from panelworks.llm import topk


def frame(spark, given: list[tuple], kind: str = "double"):
    names = ", ".join(f"{c} string" for c in (*EXTRA, "pivot", "distance", "shelf", "ask", "hits", "rank", "score"))
    n = len(EXTRA) + 7
    return spark.createDataFrame([(*r, *["clash"] * n) for r in given], f"vec_id long, embedding array<{kind}>, {names}")


def brute(given: list[tuple], k: int = 10, every: int = 100) -> list[tuple]:
    usable = [(i, [math.floor(1024 * x) for x in v]) for i, v in given
              if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (i, v) in enumerate(usable):
        if i % every == 0:
            scores = sorted((-sum(x * y for x, y in zip(v, w)), j) for b, (j, w) in enumerate(usable) if b != a and len(w) == len(v))
            out += [(i, r, j, -s) for r, (s, j) in enumerate(scores[:k], 1)]
    return sorted(out)


def rows_of(df) -> list[tuple]:
    assert df.columns == ["query_id", "rank", "vec_id", "score"]
    return sorted(tuple(r) for r in df.collect())


def vectors(seed: int, n: int, dim: int) -> list[tuple]:
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((6, dim))
    rows = centres[rng.integers(0, 6, n)] + 0.3 * rng.standard_normal((n, dim)) * rng.integers(0, 2, (n, 1))
    return [(i, rows[i].tolist()) for i in range(n)]


def edge_vectors() -> list[tuple]:
    out = vectors(1, 700, 5)
    same = out[3][1]
    out += [(10_000 + i, same) for i in range(900)]  # copies: ties at every rank
    out += [(400, same), (400, same), (400, out[8][1])]  # one id on several rows
    out += [(-300, [0.0] * 5), (1100, [0.0] * 5), (1200, None), (1300, []), (1400, []), (1500, [1.0, None, 0.0, 0.0, 0.0])]
    out += [(1600, [float("nan")] * 5), (1700, [float("inf"), 0.0, 0.0, 0.0, 0.0]), (None, same), (1800, [1.0, 2.0]), (1801, [-3.0, 0.5])]
    out += [(1900, [1e6, -1e6, 3.0, 0.1, 0.0]), (2000, [1e-9] * 5)]
    random.Random(2).shuffle(out)
    return out


def test_edge_vectors_equal_brute_force(spark):
    given = edge_vectors()
    assert rows_of(topk.nearest(frame(spark, given))) == brute(given)


@pytest.mark.parametrize(("k", "every", "pivots"), [(1, 7, 3), (25, 50, 200), (10, 1, 1)])
def test_other_sizes_equal_brute_force(spark, k, every, pivots):
    given = vectors(k, 300, 8)
    assert rows_of(topk.nearest(frame(spark, given), k, every, pivots)) == brute(given, k, every)


def test_fewer_rows_than_k_and_empty(spark):
    given = vectors(5, 4, 3) + [(100, [1.0, 2.0, 3.0])]
    assert rows_of(topk.nearest(frame(spark, given))) == brute(given)
    assert rows_of(topk.nearest(frame(spark, []))) == []
    assert rows_of(topk.nearest(frame(spark, [(0, [1.0])]))) == []


def test_large_products_are_exact_and_too_large_ones_raise():
    q, v = np.array([[2**30, 1]]), np.array([[2**30, 1], [2**30, 0]])
    assert topk.products(q, v).tolist() == [[2**60 + 1, 2**60]]
    with pytest.raises(OverflowError):
        topk.products(q * 2**20, v)


def test_annuli_are_skipped_by_the_bound():
    """Far clusters are never multiplied, and the result stays exact."""
    rng = np.random.default_rng(3)
    rows = np.concatenate([rng.integers(-50, 50, (3000, 4)) + 5000 * c for c in range(5)])
    centres = topk.choose_pivots(rows, 16)
    away = topk.distances(rows.astype(float), centres)
    shelf = topk.Shelf(np.arange(len(rows)), rows, away.argmin(axis=1), away.min(axis=1), centres)
    asked = []
    plain = topk.products
    topk.products = lambda q, v: asked.append(len(v)) or plain(q, v)
    try:
        names, best, real = shelf.search(rows[-20:], 10, np.full(20, topk.NONE))
    finally:
        topk.products = plain
    want = np.sort(rows[-20:] @ rows.T, axis=1)[:, ::-1][:, :10]
    assert real.all() and (best == want).all()
    assert sum(asked) < len(rows) / 2


def test_query_on_the_small_tables(spark, folder):
    table = spark.read.parquet(f"{folder}/embeddings.parquet")
    given = [tuple(r) for r in table.select("vec_id", "embedding").collect()]
    assert rows_of(topk.nearest(table)) == brute(given)
