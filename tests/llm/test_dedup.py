"""Near-duplicate and repeated-string operators next to brute force."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from cases import documents, rows

from panelworks.llm import common, embeddings, simhash, suffixes
from panelworks.llm.common import table


class Groups:
    def __init__(self):
        self.up = {}

    def find(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, x, y):
        x, y = self.find(x), self.find(y)
        self.up[max(x, y)] = min(x, y)


def plain_print(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall("[^\x20\x09-\x0d]+", text)
    if not words:
        return 0
    grams = [" ".join(words)] if len(words) < 3 else [" ".join(words[i : i + 3]) for i in range(len(words) - 2)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_edge_rows(spark):
    given = rows()
    got = simhash.simhash_groups(documents(spark)).collect()
    prints = [(i, plain_print(t)) for i, t, _ in given]
    groups = Groups()
    named = [(i, p) for i, p in prints if i is not None]
    for i, p in named:
        for j, q in named:
            if bin(p ^ q).count("1") <= 2:
                groups.join(i, j)
    want = sorted(((i, f"{p:016x}", None if i is None else groups.find(i)) for i, p in prints), key=repr)
    assert sorted((tuple(r) for r in got), key=repr) == want
    kept = simhash.keep_first(documents(spark))
    assert kept.columns == documents(spark).columns
    heads = {c for i, _, c in want if i is not None}
    assert sorted(r["doc_id"] for r in kept.where("doc_id is not null").select("doc_id").collect()) == sorted(
        i for i, _, _ in given if i in heads)


@pytest.mark.parametrize("bits", [24, 7])
def test_without_ids_is_the_exact_anti_join(spark, bits, monkeypatch):
    """Null and repeated ids, columns named like the helper's own, and a filter too small to tell rows apart."""
    monkeypatch.setattr(common, "FILTER_BITS", bits)
    docs = spark.range(3000).selectExpr(
        "cast(if(id % 50 = 0, null, id % 2000) as int) AS doc_id", "id AS word", "cast(id AS string) AS bits", "id AS row", "1 AS id")
    gone = spark.range(0, 3000, 7).selectExpr("if(id % 3 = 0, null, id) AS doc_id", "id AS row")
    got = common.without(docs, gone, "test-gone")
    assert got.schema == docs.schema
    want = {i for i in range(0, 3000, 7) if i % 3}
    ids = [(r["doc_id"], r["word"]) for r in got.select("doc_id", "word").collect()]
    assert sorted(ids, key=repr) == sorted(
        ((None if i % 50 == 0 else i % 2000, i) for i in range(3000) if i % 50 == 0 or i % 2000 not in want), key=repr)
    assert common.without(docs, gone.limit(0), "test-gone").count() == 3000
    assert common.without(docs.limit(0), gone, "test-gone").count() == 0


@pytest.mark.parametrize("radius", [0, 1, 2, 3])
def test_near_links_connect_all(spark, radius):
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 2**64, 40, dtype=np.uint64)
    prints = [int(b) for b in base]
    for b in base:
        for _ in range(6):
            bits = rng.choice(64, rng.integers(0, 5), replace=False)
            prints.append(int(b) ^ sum(1 << int(x) for x in bits))
    prints = sorted({*prints, 0, 2**64 - 1, 1, 3})
    groups = Groups()
    for i, p in enumerate(prints):
        for j in range(i):
            if bin(p ^ prints[j]).count("1") <= radius:
                groups.join(i, j)
    df = spark.createDataFrame([(i, p - 2**64 if p >= 2**63 else p) for i, p in enumerate(prints)], "rep long, fp long")
    found = common.components(simhash.near_links(df, radius, tile=8), "test").collect()
    want = {i: groups.find(i) for i in range(len(prints))}
    linked = {i for i in want if want[i] != i} | set(c for i, c in want.items() if c != i)
    assert {r["node"]: r["component"] for r in found} == {i: want[i] for i in linked}


def test_a_tile_meets_itself_in_any_order():
    """The two copies of one tile need not come in the same order."""
    prints, ids = [5, 1 << 40, 7, 1 << 60], [10, 11, 12, 13]  # the first and third, second and fourth are near
    kinds = [pa.list_(pa.int64())] * 4
    data = [[prints], [ids], [prints[::-1]], [ids[::-1]]]
    batch = pa.RecordBatch.from_arrays([*map(pa.array, data, kinds), pa.array([True])], ["fps", "ids", "other_fps", "other_ids", "same"])
    links = [(r["a"], r["b"]) for out in simhash._near(2)([batch]) for r in out.to_pylist()]
    assert sorted(links) == [(12, 10), (13, 11)]


def test_components_of_a_long_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(0, 300)]
    random.Random(1).shuffle(path)
    star = [(1000, k) for k in range(1001, 1400)]
    df = spark.createDataFrame(path + star + [(5, 5)], "a long, b long")
    got = {r["node"]: r["component"] for r in common.components(df, "test").collect()}
    assert got == {**{i: 0 for i in range(301)}, **{k: 1000 for k in range(1000, 1400)}}


def plain_cut(given):
    """Rows in reading order -> the contract's columns, by comparing every 100-byte string."""
    seen, out = set(), {}
    for i, text in given:
        data = (text or "").encode()
        gone = np.zeros(len(data), bool)
        for p in range(len(data) - 99):
            if (w := data[p : p + 100]) in seen:
                gone[p : p + 100] = True
            else:
                seen.add(w)
        kept = bytes(np.frombuffer(data, np.uint8)[~gone])
        spans = int((gone & ~np.insert(gone[:-1], 0, False)[: len(gone)]).sum()) if len(gone) else 0
        out[i, text] = (i, len(data), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    return out


def cut(df):
    return df.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()


def test_suffix_edge_rows(spark):
    given = [(i, t) for i, t, _ in rows()]
    distinct = sorted(set(given), key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
    want = plain_cut(distinct)
    got = sorted((tuple(r) for r in cut(suffixes.without_repeats(documents(spark)))), key=repr)
    assert got == sorted((want[r] for r in given), key=repr)


@pytest.mark.parametrize("seed", range(3))
def test_suffix_random(spark, seed, monkeypatch):
    rng = random.Random(seed)
    pool = ["".join(rng.choice("ab c") for _ in range(rng.choice([60, 130, 300]))) for _ in range(12)]
    given = []
    for i in range(60):
        text = "".join(rng.choice(pool)[rng.randint(0, 40) :] for _ in range(rng.randint(0, 5)))
        if seed == 2:
            text = ("ab" if i % 2 else "aab") * rng.randint(0, 300) + text
        given.append((i, text))
    monkeypatch.setattr(suffixes, "CHUNK", 150)
    want = plain_cut(given)
    got = cut(suffixes.without_repeats(documents(spark, [(i, t, "aa") for i, t in given])))
    assert sorted(tuple(r) for r in got) == sorted(want.values())


def test_suffix_hot_copies_and_hot_passage(spark):
    rng = random.Random(9)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(230))
    own = lambda: "".join(rng.choice("ijklmnop ") for _ in range(150))
    copy = own()
    given = [(i, copy if i % 3 == 0 else own() + passage + own()) for i in range(300)]
    want = plain_cut(given)
    got = cut(suffixes.without_repeats(documents(spark, [(i, t, None) for i, t in given])))
    assert sorted(tuple(r) for r in got) == sorted(want.values())


def test_multikey_order():
    rng = np.random.default_rng(0)
    rows_ = rng.integers(0, 3, (500, 30)).astype(np.uint8)
    rows_[100:200] = rows_[0]
    order = suffixes.multikey_order(rows_)
    assert [bytes(r) for r in rows_[order]] == sorted(bytes(r) for r in rows_)
    lcp = suffixes.common_prefixes(rows_, order)
    for k in range(1, 500):
        a, b = rows_[order[k - 1]], rows_[order[k]]
        assert lcp[k] == (30 if (a == b).all() else int((a != b).argmax()))


def plain_vectors(given):
    fine = {}
    for k, (i, v, label) in enumerate(given):
        if i is None or v is None or label is None or not len(v) or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            continue
        x = np.array(v, float) / np.abs(v).max()
        fine[k] = (i, x / np.sqrt((x * x).sum()), label)
    groups, links = Groups(), {k: 0 for k in range(len(given))}
    for k, (i, x, a) in fine.items():
        for m, (j, y, b) in fine.items():
            if m < k and a == b and len(x) == len(y) and (tuple(given[k][1]) == tuple(given[m][1]) or float(x @ y) >= 0.93):
                links[k] += 1
                links[m] += 1
                groups.join(i, j)
    return sorted(((i, links[k], i if k not in fine else groups.find(i), True if i is None else (i if k not in fine else groups.find(i)) == i)
                   for k, (i, _, _) in enumerate(given)), key=repr)


def test_embedding_groups(spark):
    rng = np.random.default_rng(4)
    given = []
    for c in range(25):
        centre = rng.standard_normal(32)
        for _ in range(6):
            v = centre + rng.choice([0, 0.1, 0.2, 0.3]) * rng.standard_normal(32)
            given.append((len(given), [float(np.float32(x)) for x in v], int(c % 3) if c else None))
    inf, nan = float("inf"), float("nan")
    for v in (None, [], [0.0] * 32, [None] + [1.0] * 31, [inf] + [1.0] * 31, [nan] + [1.0] * 31, [1e-30] * 32, [1e30] * 32, [1.0] * 32, [-0.0] + [1.0] * 31,
              [0.0] + [1.0] * 31, [1.0] * 8, [1.0] * 8):
        given.append((len(given), v, 1))
    given += [(None, [1.0] * 32, 1), given[30], given[30], (777, given[30][1], given[30][2])]
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in given], "vec_id long, embedding array<float>, label int, rep string, cls string, n string")
    got = embeddings.embedding_groups(df, tile=16).select("vec_id", "n_links", "component_id", "kept").collect()
    assert sorted((tuple(r) for r in got), key=repr) == plain_vectors(given)


def test_estimates_hold_their_bounds():
    rng = np.random.default_rng(1)
    units = embeddings.unit(rng.standard_normal((300, 64)))
    codes, factors = embeddings.encode(units)
    guess, width = embeddings.estimate(codes, factors, units)
    error = guess - units @ units.T
    np.fill_diagonal(error, 0)
    assert (np.abs(error) <= width[:, None]).all()
    assert abs(error.mean()) < 2e-3  # unbiased


def test_empty_tables(spark):
    none = documents(spark, [])
    assert simhash.simhash_groups(none).count() == 0
    assert suffixes.without_repeats(none).count() == 0
    assert suffixes.without_repeats(documents(spark, [(1, None, None), (2, "", "aa")])).count() == 2
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert embeddings.embedding_groups(empty).count() == 0


def test_vectors_of_the_table(spark, folder):
    df = table(spark, folder, "embeddings")
    given = [(r["vec_id"], r["embedding"], r["label"]) for r in df.collect()]
    got = embeddings.embedding_groups(df).select("vec_id", "n_links", "component_id", "kept").collect()
    assert sorted((tuple(r) for r in got), key=repr) == plain_vectors(given)
