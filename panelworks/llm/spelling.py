"""Spelling variants: words one edit apart, found by dense comparison of tiles.

Two words are one edit apart when their common prefix and their common suffix
together reach the length of the longer one minus one. Then one of the two is at
least half as long as the longer word, so words meet in tiles that share this
half's hash: once by their first and once by their last half. A tile holds its
words as matrices of code points, padded to one length from the left and from the
right; a pair of tiles is compared column by column, all words with all words.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelworks.llm.common import blocks, in_arrow, packed
from panelworks.session import materialise

SHORTEST = 5  # code points
LEAST = 3  # occurrences
THIN = 97  # a word of a document loses a code point when this divides its hash
BUCKET = 256  # words that a bucket of halves holds on average
TILE = 1024  # words of a tile at most
TILE_BYTES = 1 << 20
FLUSH = 1 << 18  # distinct words a task holds before it hands them on


def thinned(doc_id: int | None, run: str) -> str:
    """``run`` without the code point that its document takes from it, if any."""
    h = zlib.crc32(f"{doc_id}:{run}".encode())
    if doc_id is None or h % THIN:
        return run
    k = h % len(run)
    return run[:k] + run[k + 1 :]


def _count(shortest: int):
    letters = re.compile("[a-zÀ-ÿ]{%d,}" % shortest)

    def rows(found: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["word", "n"])

    def fn(batches):
        held: Counter = Counter()
        for batch in batches:
            raw, at = packed(batch.column("text"))
            ids = batch.column("doc_id").to_pylist()
            for a, b in blocks(at):
                whole = raw[at[a] : at[b]].tobytes().lower()  # bytes: A to Z only
                for i in range(a, b):
                    runs = Counter(letters.findall(whole[at[i] - at[a] : at[i + 1] - at[a]].decode()))
                    if ids[i] is not None:
                        start = zlib.crc32(b"%d:" % ids[i])
                        for run in [r for r in runs if not zlib.crc32(r.encode(), start) % THIN]:
                            n, word = runs.pop(run), thinned(ids[i], run)
                            if len(word) >= shortest:
                                held[word] += n
                    held.update(runs)
                if len(held) > FLUSH:
                    yield rows(held)
                    held = Counter()
        yield rows(held)
    return fn


def vocabulary(docs: DataFrame, least: int = LEAST, shortest: int = SHORTEST) -> DataFrame:
    """(word, n) of the words of ``shortest`` code points that occur ``least`` times over all documents."""
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    counts = in_arrow(rows, _count(shortest), "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def matrices(words: list[bytes], width: int, pad: int) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the words, column by column, counted from the left and from the right."""
    left = np.full((len(words), width), pad, np.uint8)
    right = left.copy()
    for i, word in enumerate(words):
        codes = np.frombuffer(word, np.uint8)
        left[i, : len(codes)] = codes
        right[i, : len(codes)] = codes[::-1]
    return np.ascontiguousarray(left.T), np.ascontiguousarray(right.T)


def common(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Length of the common prefix of every word of one matrix with every word of the other."""
    alive = np.ones((one.shape[1], two.shape[1]), bool)
    total = np.zeros(alive.shape, np.uint8 if len(one) < 256 else np.int32)
    for a, b in zip(one, two):
        alive &= a[:, None] == b[None, :]
        if not alive.any():
            break
        total += alive
    return total


def near_pairs(long: list[bytes], other: list[bytes], width: int, by_suffix: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs one edit apart that share the first half (or the last, but not the first, half) of ``width``.

    Words of ``long`` have ``width`` code points, those of ``other`` as many or one fewer.
    """
    # unlike pads never match, so a common stretch ends where the shorter word ends
    (a_left, a_right), (b_left, b_right) = matrices(long, width, 0), matrices(other, width, 1)
    before, after = common(a_left, b_left), common(a_right, b_right)
    near = before.astype(np.int32) + after >= width - 1
    near &= (before < width // 2) if by_suffix else (before >= width // 2)
    return np.nonzero(near)


def _compare(batches):
    """For every word of two tiles the number of near words and the best one, the one of largest n."""
    for batch in batches:
        out: list[tuple[list, np.ndarray, np.ndarray, np.ndarray, list]] = []
        names, counts, numbers, best_n, best = [], [], [], [], []
        columns = [batch.column(c) for c in ("m", "side", "words", "ns", "words2", "ns2")]
        for m, side, words, ns, words2, ns2 in zip(*(c.to_pylist() for c in columns)):
            every, n = [w.encode("latin-1") for w in words], list(ns)
            tiles = [range(len(words))]
            if words2 is not None:
                every += [w.encode("latin-1") for w in words2]
                n += ns2
                tiles.append(range(len(words), len(every)))
            longs, shorts = ([[i for i in t if len(every[i]) == x] for t in tiles] for x in (m, m - 1))
            works = [(longs[0], longs[-1]), (longs[0], shorts[-1])]
            if len(tiles) > 1:
                works.append((longs[1], shorts[0]))
            left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for one, two in works:
                if not one or not two:
                    continue
                i, j = near_pairs([every[k] for k in one], [every[k] for k in two], m, bool(side))
                i, j = np.array(one)[i], np.array(two)[j]
                if one is two:
                    i, j = i[i < j], j[i < j]
                left.append(i)
                right.append(j)
            i, j = np.concatenate(left), np.concatenate(right)
            if not len(i):
                continue
            # both directions; the best near word has the largest n and then comes first in code-point order
            of, near = np.concatenate([i, j]), np.concatenate([j, i])
            rank = np.empty(len(every), np.int64)
            rank[sorted(range(len(every)), key=lambda k: (-n[k], every[k]))] = np.arange(len(every))
            order = np.lexsort((rank[near], of))
            of, near = of[order], near[order]
            first = np.nonzero(np.append(True, of[1:] != of[:-1]))[0]
            size = np.diff(np.append(first, len(of)))
            for k, b, c in zip(of[first].tolist(), near[first].tolist(), size.tolist()):
                names.append(every[k].decode("latin-1"))
                counts.append(c)
                best_n.append(n[b])
                best.append(every[b].decode("latin-1"))
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), pa.array(counts, pa.int64()), pa.array(best_n, pa.int64()), pa.array(best, pa.string())],
            ["word", "n_near", "best_n", "best"])


def near_words(vocab: DataFrame, tile: int = TILE) -> DataFrame:
    """(word, n_near, best_n, best) of every word of ``vocab`` (word, n) with a word one edit apart."""
    size = F.length("word")

    def halves(m):
        k = F.floor(m / 2).cast("int")
        return [F.struct(m.alias("m"), F.lit(0).alias("side"), F.left("word", k).alias("half")),
                F.struct(m.alias("m"), F.lit(1).alias("side"), F.right("word", k).alias("half"))]

    # a word is the longer or an equal one at its own length, the shorter one at the next
    keyed = vocab.select("word", "n", F.inline(F.array(*halves(size), *halves(size + 1))))
    buckets = keyed.groupBy("m").agg(F.greatest(F.floor(F.count("*") / (2 * BUCKET)), F.lit(1)).alias("buckets"))
    placed = keyed.join(buckets, "m").select("word", "n", "m", "side", F.pmod(F.xxhash64("half"), "buckets").alias("bucket"))
    key = ["m", "side", "bucket"]
    rows = F.count("*")
    sizes = placed.groupBy(*key).agg(
        F.greatest(F.ceil(rows / tile), F.ceil(rows * F.col("m") / TILE_BYTES)).alias("parts"), rows.alias("rows"),
        F.count_if(F.length("word") == F.col("m")).alias("longs")).where("rows > 1 and longs > 0").drop("rows", "longs")
    dealt = placed.join(sizes, key).withColumn("part", F.pmod(F.xxhash64("word", F.lit(1)), "parts"))
    tiles = dealt.groupBy(*key, "parts", "part").agg(F.array_sort(F.collect_list(F.struct("word", "n"))).alias("rows")).select(
        *key, "parts", "part", F.col("rows.word").alias("words"), F.col("rows.n").alias("ns"))
    tiles = materialise(tiles, "spelling-tiles")
    alone = tiles.select("m", "side", "words", "ns", F.lit(None).cast("array<string>").alias("words2"), F.lit(None).cast("array<long>").alias("ns2"))
    # a hot half has several tiles: every pair of them is a piece of work with a key of its own
    several = tiles.where("parts > 1")
    left = several.where("part < parts - 1").withColumn("low", F.col("part")).withColumn("high", F.explode(F.sequence(F.col("part") + 1, F.col("parts") - 1)))
    right = several.where("part > 0").withColumn("high", F.col("part")).withColumn("low", F.explode(F.sequence(F.lit(0).cast("long"), F.col("part") - 1)))
    both = left.join(right.select(*key, "low", "high", F.col("words").alias("words2"), F.col("ns").alias("ns2")), [*key, "low", "high"])
    pairs = alone.unionByName(both.select("m", "side", "words", "ns", "words2", "ns2"))
    found = in_arrow(pairs, _compare, "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("n"), "best"))  # Spark orders texts as code points
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select(
        "word", "n_near", (-F.col("b.n")).alias("best_n"), F.col("b.best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): the last word when (word, up) is followed from word to word; ``up`` is the word itself at the end.

    Every round doubles the number of steps taken. A word's number of near words is
    bounded by its length and the alphabet, so no key of the joins is hot.
    """
    now = materialise(forms.select("word", "up"), "spelling-forms")
    while True:
        step = now.select(F.col("word").alias("up"), F.col("up").alias("next"))
        now = materialise(now.join(step, "up").select("word", F.col("next").alias("up"), (F.col("next") != F.col("up")).alias("moved")), "spelling-forms")
        if not now.where("moved").limit(1).count():
            return now.select("word", F.col("up").alias("root"))


def variants(vocab: DataFrame) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word of ``vocab`` (word, n).

    A word's form is its near word of largest n (ties: smallest in code-point
    order), if that n is at least twice its own; its root is the end of the chain
    of forms. Forms at least double n, so a chain is short and has no circle.
    """
    vocab = materialise(vocab, "spelling-vocabulary")
    joined = vocab.join(near_words(vocab), "word", "left")
    has = F.col("best_n") >= 2 * F.col("n")
    known = materialise(joined.select(
        "word", F.when(has, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(has, F.col("best_n")).alias("form_n")), "spelling-near")
    ends = roots(known.select("word", F.coalesce("form", "word").alias("up")))
    return known.join(ends, "word").select("word", "form", "root", "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, least: int = LEAST, shortest: int = SHORTEST) -> DataFrame:
    """Variants among the words of ``docs``.

    Words are maximal runs of A-Z, a-z and U+00C0 to U+00FF, with A-Z lower-cased;
    one run in 97 of a document, chosen by the crc32 of doc_id and run, loses a code
    point. Null texts and those without such runs give nothing, repeated rows count
    again, and a row without doc_id gives its runs as they are. An empty table gives
    an empty result. Only doc_id and text are read.
    """
    return variants(vocabulary(docs, least, shortest))


#: the same in DuckDB SQL; crc32 byte by byte over the table of its 256 remainders
ORACLE = """
WITH RECURSIVE crc AS (
  SELECT i, 0 AS k, i::BIGINT AS c FROM range(256) t(i)
  UNION ALL SELECT i, k + 1, CASE WHEN (c & 1) = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM crc WHERE k < 8),
tab AS (SELECT list(c ORDER BY i) AS tab FROM crc WHERE k = 8),
runs AS (
  SELECT doc_id, run, count(*) AS n FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[a-z\\x{00C0}-\\x{00FF}]+')) AS run FROM documents)
  WHERE length(run) >= 5 GROUP BY ALL),
coded AS (
  SELECT doc_id, run, n, hex(encode(concat(doc_id, ':', run))) AS x FROM runs),
hashed AS (
  SELECT doc_id, run, n, CASE WHEN doc_id IS NULL THEN 1 ELSE xor(list_reduce(
    [('0x' || x[i * 2 - 1 : i * 2])::BIGINT for i in range(1, len(x) // 2 + 1)],
    lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1]), 4294967295::BIGINT), 4294967295) END AS h FROM coded, tab),
words AS (
  SELECT CASE WHEN h % 97 = 0 THEN run[1 : h % length(run)] || run[h % length(run) + 2 :] ELSE run END AS word, n FROM hashed),
v AS (SELECT word, sum(n)::BIGINT AS n FROM words WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
cut AS (
  SELECT word, n, k, CASE WHEN k = 0 THEN word ELSE word[1 : k - 1] || word[k + 1 :] END AS part
  FROM (SELECT word, n, unnest(range(0, length(word) + 1)) AS k FROM v) z),
near AS (
  SELECT DISTINCT a.word, a.n, b.word AS other, b.n AS m FROM cut a JOIN cut b ON a.part = b.part AND a.word <> b.word
  WHERE (a.k = b.k AND a.k > 0) OR (a.k = 0 AND b.k > 0) OR (a.k > 0 AND b.k = 0)),
best AS (
  SELECT word, count(*) AS n_near, first(other ORDER BY m DESC, encode(other)) AS other, max(m) AS m FROM near GROUP BY word),
known AS (
  SELECT v.word, CASE WHEN m >= 2 * n THEN other END AS form, n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 2 * n THEN m END AS form_n
  FROM v LEFT JOIN best USING (word)),
chain AS (
  SELECT word, word AS here, form AS up FROM known
  UNION ALL SELECT c.word, c.up, k.form FROM chain c JOIN known k ON k.word = c.up)
SELECT known.word, form, here AS root, n, n_near, form_n FROM known JOIN chain ON known.word = chain.word AND chain.up IS NULL
"""
