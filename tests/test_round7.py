"""Bootstrap arrays that travel as few bytes: digests at once, steps of draws, narrow numbers, folded scores."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from panelworks.functions import digests as DI
from panelworks.operators import resample as RS


def test_digests_at_once_are_md5(monkeypatch):
    monkeypatch.setattr(DI, "AT_ONCE", 96)
    heads = [f"{seed}|{b}|".encode() for seed in (7, -42) for b in range(12)]
    numbers = np.array([12_345, 9, 10, 0, 99, 100, 10**9, 10**9 - 1, 2**40, 10**18, 3, *range(950, 1150)])
    got = DI.digest_words(heads, numbers)
    want = [[hashlib.md5(h + b"%d" % n).digest() for h in heads] for n in numbers.tolist()]
    assert (got == np.frombuffer(b"".join(map(b"".join, want)), ">u4").reshape(len(numbers), -1)).all()
    with pytest.raises(ValueError):
        DI.digest_words([b"x" * 60], numbers)  # two blocks each


@pytest.mark.parametrize("size", [700, 3_000_000])
def test_draws_of_many_positions_are_those_of_few(size, monkeypatch):
    positions = np.arange(90, 190)
    with monkeypatch.context() as m:
        m.setattr(RS.hashlib, "md5", None)  # none of them is made alone
        many = RS.draws(positions, np.full(100, size), 300, 7)
    few = np.concatenate([RS.draws(positions[k : k + 1], np.full(1, size), 300, 7) for k in range(100)])
    assert (many == few).all() and (RS.draws(positions, np.full(100, size), 300, 7, np.uint32) == few).all()


@pytest.mark.parametrize(("size", "bytes_each"), [(9000, 2.0), (60_000_000, 12.0)])
def test_draws_travel_as_steps(size, bytes_each):
    """Two bytes a draw where draws are dense; sparse ones take more and lose nothing."""
    n, replicates = 2000, 10
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(n)), pa.array(np.full(n, size))], ["place", "size"])
    plain = list(RS._packed_draws([], replicates, 7)([batch]))
    sent = list(RS._sent_draws([], replicates, 7)([batch]))
    for p, q in zip(plain, sent, strict=True):
        assert p.column("cell") == q.column("cell")
        data, at = RS._bytes(q.column("codes"))
        assert len(data) <= bytes_each * n * replicates
        assert (RS._codes(q.column("codes")) == p.column("codes").values.to_numpy()).all()
        tail = q.column("codes").slice(1)
        assert (RS._codes(tail) == p.column("codes").slice(1).flatten().to_numpy()).all()


def test_weights_take_a_byte(spark):
    places = spark.range(300).select(F.col("id").alias("place"), F.lit(300).cast("long").alias("size"))
    wide = {r["place"]: np.frombuffer(r["weights"], "<i4").tolist() for r in RS.weight_arrays(places, 40).collect()}
    rows = RS.weight_arrays(places, 40, kind=None).collect()
    assert {r["place"]: list(r["weights"]) for r in rows} == wide


def test_numbers_of_any_width_and_none():
    rows = [np.array([1, 2, 3]), np.array([0, 70_000, 1]), np.array([300, 0, 0]), np.array([0, 0, 2**40]), np.array([-1, 5, 0])]
    packed = [RS._arrays(r[None, :])[0].as_py() for r in rows]
    assert [len(p) // 3 for p in packed] == [1, 4, 2, 8, 8]
    column = pa.array([None, *packed, None, packed[0]], pa.binary())
    want = [[0, 0, 0], *map(list, rows), [0, 0, 0], [1, 2, 3]]
    assert RS._numbers(column, 3).tolist() == want and RS._numbers(column.slice(2), 3).tolist() == want[2:]
    assert RS._numbers(pa.array([packed[0]] * 2, pa.binary()), 3).tolist() == [[1, 2, 3]] * 2


def test_equal_scores_of_all_batches_are_one_row(monkeypatch):
    monkeypatch.setattr(RS, "LONG", 4)
    monkeypatch.setattr(RS, "SLAB", 5)
    rng, replicates, n = np.random.default_rng(3), 6, 400
    group = [None if k % 11 == 0 else "ab"[k % 2] for k in range(n)]
    score = [None if k % 13 == 0 else float(x) for k, x in enumerate(rng.integers(0, 9, n) / 8)]
    pos, neg, weights = rng.integers(0, 3, n), rng.integers(0, 2, n), rng.integers(0, 5, (n, replicates))
    whole = pa.RecordBatch.from_arrays(
        [pa.array(group), pa.array(score, pa.float64()), pa.array(pos), pa.array(neg), RS._arrays(weights)], ["g", "s", "_pos", "_neg", "weights"])
    out = list(RS._score_sums(["g"], ["s"], replicates)(whole.slice(a, 50) for a in range(0, n, 50)))
    got = {}
    for batch in out:
        sums = [RS._numbers(batch.column(c), replicates).tolist() for c in ("pos", "neg")]
        for g, name, s, p, q in zip(*(batch.column(c).to_pylist() for c in ("g", "score", "_s")), *sums):
            assert name == "s" and (g, s) not in got
            got[g, s] = p, q
    want = {}
    for k in range(n):
        if score[k] is not None:
            both = want.setdefault((group[k], score[k]), np.zeros((2, replicates), int))
            both += np.outer([pos[k], neg[k]], weights[k])
    assert got == {key: tuple(x.tolist()) for key, x in want.items()}
