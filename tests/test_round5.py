"""Bootstrap draws of several groups over one stream of digests."""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa

from panelworks.operators import resample as RS


def test_groups_share_the_digests_of_a_position(monkeypatch):
    made, real = [], hashlib.md5
    monkeypatch.setattr(RS.hashlib, "md5", lambda text: made.append(text) or real(text))
    sizes, replicates, n = {"a": 9000, "b": 5000, None: 700}, 10, 600
    rows = [(g, p, size) for p in range(n) for g, size in sizes.items()]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["g", "place", "size"])
    out = list(RS._packed_draws(["g"], replicates, 7)([batch]))
    assert len(made) == n * 3  # one digest for four replicates, whatever the groups
    got = Counter(
        (g, cell * RS.CELL + code // replicates, code % replicates)
        for b in out for g, cell, codes in zip(*map(pa.Array.to_pylist, b.columns)) for code in codes)
    want = Counter(
        (g, int(place), at[1]) for g, size in sizes.items()
        for at, place in np.ndenumerate(RS.draws(np.arange(n), np.full(n, size), replicates, 7)))
    assert got == want
    word = int.from_bytes(real(b"7|2|599").digest()[4:8], "big")  # replicate 9 is the second word of block 2
    assert want["b", word % 5000, 9] >= 1
