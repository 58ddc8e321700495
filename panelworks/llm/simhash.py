"""SimHash near-duplicates by tiled exact comparison of 64-bit fingerprints.

Fingerprints are collapsed to distinct values and put into tiles that share the
population counts of their four 16-bit quarters. Two fingerprints within the
radius differ by at most the radius in those counts, so a tile meets only tiles
whose counts are that close; all other tile pairs are skipped. A tile pair is
compared with exclusive-or and bit counts in numpy.
"""

from __future__ import annotations

from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelworks.llm.common import components, in_arrow, local_labels, packed, without
from panelworks.session import materialise

SEED = 42
TILE = 1024


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """Unsigned 64-bit fingerprint of a text in UTF-8; zero without words."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(g, SEED) for g in grams), np.uint64, max(1, len(words) - shingle + 1))
    ones = np.zeros(64, np.int64)
    for start in range(0, len(hashes), 8192):
        part = hashes[start : start + 8192].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprints(batches):
    for batch in batches:
        raw, at = packed(batch.column("text"))
        whole = raw.tobytes()
        prints = np.array([fingerprint(whole[a:b]) for a, b in zip(at[:-1], at[1:])], np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(prints.view(np.int64))], ["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) of every row; fp is the fingerprint as a signed long."""
    return in_arrow(docs.select(F.col("doc_id").cast("long"), "text"), _fingerprints, "doc_id long, fp long")


def _near(radius: int):
    def links(batches):
        for batch in batches:
            out_a, out_b = [], []
            cols = [batch.column(c) for c in ("fps", "ids", "other_fps", "other_ids", "same")]
            for fps, ids, other_fps, other_ids, same in zip(*cols):
                if same.as_py():  # one tile with itself: its other copy may come in another order
                    other_fps, other_ids = fps, ids
                x, y = fps.values.to_numpy().view(np.uint64), other_fps.values.to_numpy().view(np.uint64)
                i, j = np.nonzero(np.bitwise_count(x[:, None] ^ y[None, :]) <= radius)
                if same.as_py():
                    i, j = i[i < j], j[i < j]
                if len(i):
                    # links that span the pair's groups: as connected as all of them, never more than its rows
                    names = np.concatenate([ids.values.to_numpy(), other_ids.values.to_numpy()])
                    label = local_labels(len(names), i, j if same.as_py() else j + len(x))
                    moved = np.nonzero(label != np.arange(len(names)))[0]
                    out_a.append(names[moved])
                    out_b.append(names[label[moved]])
            none = np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([none, *x])) for x in (out_a, out_b)], ["a", "b"])
    return links


def near_links(prints: DataFrame, radius: int = 2, tile: int = TILE) -> DataFrame:
    """Links (a, b) that connect all ids whose fingerprints differ in at most ``radius`` bits.

    ``prints`` holds one (rep, fp) per distinct fingerprint.
    """
    quarters = [F.bit_count(F.shiftrightunsigned("fp", 16 * q).bitwiseAND(F.lit(0xFFFF))) + 4 for q in range(4)]
    code = sum((q.cast("long") * 32**i for i, q in enumerate(quarters)), F.lit(0).cast("long"))
    marked = prints.withColumn("sig", code)
    sizes = marked.groupBy("sig").agg(F.ceil(F.count("*") / tile).alias("parts"))
    tiles = (
        marked.join(sizes, "sig").withColumn("part", F.pmod(F.xxhash64("fp"), "parts"))
        .groupBy("sig", "part").agg(F.array_sort(F.collect_list(F.struct("fp", "rep"))).alias("rows"))
        .select("sig", "part", F.col("rows.fp").alias("fps"), F.col("rows.rep").alias("ids"))
    )
    steps = [d for d in product(range(-radius, radius + 1), repeat=4) if sum(map(abs, d)) <= radius]
    ahead = [s for s in (sum(x * 32**i for i, x in enumerate(d)) for d in steps) if s >= 0]
    left = tiles.select("part", "fps", "ids", "sig", F.explode(F.array(*map(F.lit, sorted(ahead)))).alias("step"))
    left = left.withColumn("target", F.col("sig") + F.col("step"))
    right = tiles.select(F.col("sig").alias("target"), F.col("part").alias("other"),
                         F.col("fps").alias("other_fps"), F.col("ids").alias("other_ids"))
    pairs = left.join(right, "target").where("step > 0 or part <= other").select(
        "fps", "ids", "other_fps", "other_ids", (F.expr("step = 0 and part = other")).alias("same"))
    return in_arrow(pairs, _near(radius), "a long, b long")


def simhash_groups(docs: DataFrame, radius: int = 2) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row of ``docs``.

    A null or empty text, and one without words, has fingerprint zero and is
    linked like any other; repeated rows are repeated in the result. A row whose
    doc_id is null gets its fingerprint but takes no part in the links
    (component_id null). An empty table gives an empty result. Only doc_id and
    text are read, so further columns of any name do no harm.
    """
    marked = materialise(fingerprints(docs), "simhash-prints")
    reps = materialise(marked.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep")), "simhash-reps")
    found = components(near_links(reps, radius), "simhash-links")
    named = reps.join(found, F.col("rep") == F.col("node"), "left").select(
        "fp", F.coalesce("component", "rep").alias("component_id"))
    return marked.join(named, "fp", "left").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def keep_first(docs: DataFrame, radius: int = 2) -> DataFrame:
    """The rows of ``docs`` that are the smallest doc_id of their group; null ids stay."""
    groups = simhash_groups(docs, radius)
    return without(docs, groups.where("component_id <> doc_id"), "simhash-gone")
