"""Helpers shared by the text operators: packed bytes, shared tables, connected components."""

from __future__ import annotations

import os
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelworks.session import materialise

ROOT = str(Path(__file__).resolve().parents[2])
FILTER_BITS = 24


def importable(spark: SparkSession) -> None:
    """Let the Python workers find this package where it is installed by path only."""
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, paths)])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def in_arrow(df: DataFrame, fn, schema) -> DataFrame:
    importable(df.sparkSession)
    return df.mapInArrow(fn, schema)


def packed(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All UTF-8 bytes of a string array and its n+1 offsets; a null is empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    n = len(texts)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, places, data = texts.buffers()
    offsets = np.frombuffer(places, kind)[texts.offset : texts.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(offsets: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Runs of whole documents of about ``most`` bytes; a longer document is a run of its own."""
    start, n = 0, len(offsets) - 1
    while start < n:
        stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + most, "right")) - 1)
        yield start, stop
        start = stop


def without(docs: DataFrame, ids: DataFrame, name: str) -> DataFrame:
    """The rows of ``docs`` whose doc_id is not among ``ids``; a null doc_id stays.

    A filter of fixed size, at most ``2**FILTER_BITS / 64`` rows of 64 bits
    whatever the tables hold, is broadcast and lets the rows pass that surely
    stay. Only the others are shuffled with their texts, to an exact anti-join.
    """
    gone = materialise(ids.select(F.col("doc_id").cast("long").alias("id")).where("id is not null").distinct(), name)
    place = F.pmod(F.xxhash64("id"), F.lit(1 << FILTER_BITS))
    spots = {"word": F.shiftright(place, 6), "bit": (place % 64).cast("int")}
    words = gone.withColumns(spots).groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"))
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id")).withColumns(spots)
    marked = rows.join(F.broadcast(words), "word", "left")
    seen = F.coalesce(F.getbit("bits", "bit") == 1, F.lit(False))
    checked = marked.where(seen).select("row", "id").join(gone, "id", "left_anti")
    return marked.where(~seen).select("row").unionByName(checked.select("row")).select("row.*")


def local_labels(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Smallest node reachable from each of ``n`` nodes over the given links."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, left, low)
        np.minimum.at(new, right, low)
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def components(edges: DataFrame, name: str, most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node with a link; component is its smallest node.

    Alternates the large-star and small-star steps on a stored table of links;
    every round halves the distance to the smallest node, so rounds grow with
    the logarithm of the largest component. Nothing is collected but one
    checksum a round. The joins are plain equi-joins, so a node with very many
    links is split at run time.
    """
    def folded(df: DataFrame) -> DataFrame:
        return df.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.expr("sum(cast(xxhash64(u, v) as decimal(38,0)))")).first())

    links = materialise(folded(edges.select("a", "b")), name)
    before = mark(links)
    for _ in range(most_rounds):
        if not before[0]:
            break
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lows = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(lows, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        large = folded(large)
        lows = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lows, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        links = materialise(folded(small.unionByName(lows.select(F.col("u").alias("a"), F.col("m").alias("b")))), name)
        now = mark(links)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components of {name} did not settle in {most_rounds} rounds")
    stars = links.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())
