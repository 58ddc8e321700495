"""Embedding near-duplicates by randomly rotated binary codes with exact recomputation.

A unit vector is rotated by a fixed random rotation and kept as the signs of its
components, with one correction factor: the product of the vector and its code.
The product of a code with another rotated vector, divided by that factor, is an
unbiased estimate of the two vectors' cosine, and its error has a known bound.
Only pairs whose upper bound reaches the threshold are computed exactly, in
double precision.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelworks.llm.common import components, in_arrow, local_labels
from panelworks.session import materialise

TILE = 1024
CONFIDENCE = 5.0  # half width of a bound in standard errors
SEED = 20


@lru_cache(maxsize=8)
def rotation(dim: int, seed: int = SEED) -> np.ndarray:
    """A random rotation of ``dim`` dimensions, the same on every worker."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one in double precision, safe from over- and underflow."""
    large = np.abs(vectors).max(axis=1, keepdims=True)
    scaled = vectors / large
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def encode(units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed sign bits and correction factors of unit vectors."""
    turned = units @ rotation(units.shape[1]).T
    factor = np.abs(turned).sum(axis=1) / np.sqrt(units.shape[1])
    return np.packbits(turned >= 0, axis=1), factor


def estimate(codes: np.ndarray, factors: np.ndarray, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimated cosines (codes x others) and the half width of their bound per code."""
    dim = others.shape[1]
    signs = np.unpackbits(codes, axis=1, count=dim).astype(np.float32) * 2 - 1
    turned = (others @ rotation(dim).T).astype(np.float32)
    product = signs @ turned.T / np.float32(np.sqrt(dim)) / factors[:, None].astype(np.float32)
    width = CONFIDENCE * np.sqrt(np.maximum(1 - factors**2, 0)) / factors / np.sqrt(max(1, dim - 1))
    return product, width + 1e-5


def _encode(batches):
    for batch in batches:
        column = batch.column("vector")
        lengths = np.diff(column.offsets.to_numpy())
        flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        at = np.concatenate([[0], np.cumsum(lengths)])
        packs: list = [None] * len(lengths)
        rows: list = [None] * len(lengths)
        factors = np.zeros(len(lengths))
        for dim in np.unique(lengths):
            which = np.nonzero(lengths == dim)[0]
            units = unit(flat[at[which][:, None] + np.arange(dim)])
            codes, factor = encode(units)
            factors[which] = factor
            for k, code, row in zip(which, codes, units):
                packs[k], rows[k] = code.tobytes(), row.tobytes()
        yield pa.RecordBatch.from_arrays(
            [batch.column("label"), batch.column("dim"), batch.column("rep"), batch.column("n"), batch.column("cls"),
             pa.array(packs, pa.binary()), pa.array(factors), pa.array(rows, pa.binary())],
            ["label", "dim", "rep", "n", "cls", "code", "factor", "unit"])


def _compare(least: float):
    def side(batch: pa.RecordBatch, k: int, tail: str):
        def get(name):
            return batch.column(f"{name}{tail}")[k].values

        dim = batch.column("dim")[k].as_py()
        reps, n, classes, factor = (get(x).to_numpy(zero_copy_only=False) for x in ("rep", "n", "cls", "factor"))
        codes = np.frombuffer(b"".join(get("code").to_pylist()), np.uint8).reshape(len(reps), -1)
        units = np.frombuffer(b"".join(get("unit").to_pylist()), np.float64).reshape(len(reps), dim)
        return reps, n, factor, codes, units, classes

    def fn(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                one = reps, n, factor, codes, units, classes = side(batch, k, "s")
                same = batch.column("same")[k].as_py()
                other = one if same else side(batch, k, "s2")
                guess, width = estimate(codes, factor, other[4])
                i, j = np.nonzero(guess >= (least - width)[:, None])
                if same:
                    i, j = i[i < j], j[i < j]
                good = np.zeros(len(i), bool)
                for a in range(0, len(i), 1 << 15):
                    part = slice(a, a + (1 << 15))
                    good[part] = (units[i[part]] * other[4][j[part]]).sum(axis=1) >= least
                i, j = i[good], j[good]
                if not len(i):
                    continue
                links = np.bincount(i, weights=other[1][j], minlength=len(reps))
                names = np.concatenate([reps, other[0]])
                back = np.bincount(j, weights=n[i], minlength=len(other[0]))
                # links that span the pair's groups, never more than its rows, and the number of links of each row
                label = local_labels(len(names), i, j if same else j + len(reps))
                moved = np.nonzero(label != np.arange(len(names)))[0]
                some = np.nonzero(np.concatenate([links, back]))[0]
                total = np.concatenate([links, back])[some].astype(np.int64)
                empty, marks = pa.nulls(len(some), pa.int64()), np.concatenate([classes, other[5]])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([names[some], names[moved]])),
                     pa.concat_arrays([empty, pa.array(names[label[moved]])]),
                     pa.array(np.concatenate([marks[some], np.zeros(len(moved), np.int64)])),
                     pa.array(np.concatenate([total, np.zeros(len(moved), np.int64)]))], ["a", "b", "cls", "links"])
    return fn


def embedding_groups(vectors: DataFrame, least: float = 0.93, tile: int = TILE) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of ``vectors``.

    Vectors are compared when their labels are equal and not null and they have
    the same length. One that is null, empty, zero or holds a null or non-finite
    component links with nothing. Equal vectors of a label are compared once and
    count as links of each other; so a repeated row has links too. A null vec_id
    keeps its row with no links and no component. Within a label vectors lie in
    tiles of about ``tile``; each pair of tiles is one piece of work with a key of
    its own, so a label with most rows is spread over as many tasks as it has
    pairs. Only vec_id, embedding and label are read.
    """
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("label"), F.col("embedding").cast("array<double>").alias("vector"))
    fine = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0)
    # adding zero makes a negative zero a plain one, so equal vectors are equal keys
    rows = rows.withColumn("usable", F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & fine, F.lit(False)))
    rows = rows.withColumn("vector", F.transform("vector", lambda x: x + F.lit(0.0)))
    # a class is told by its smallest id and a hash: an id can come with two different vectors
    usable = rows.where("usable").withColumns({"dim": F.size("vector"), "cls": F.xxhash64("label", "vector")})
    classes = usable.groupBy("label", "dim", "vector").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.first("cls").alias("cls"))
    kind = vectors.schema["label"].dataType.simpleString()
    coded = materialise(in_arrow(
        classes, _encode, f"label {kind}, dim int, rep long, n long, cls long, code binary, factor double, unit binary"), "vector-codes")
    sizes = coded.groupBy("label", "dim").agg(F.ceil(F.count("*") / tile).cast("int").alias("parts"))
    placed = coded.join(sizes, ["label", "dim"]).withColumn("part", F.pmod(F.xxhash64("cls"), "parts").cast("int"))
    fields = ("rep", "n", "cls", "factor", "code", "unit")
    grouped = placed.groupBy("label", "dim", "parts", "part").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("rows"))
    tiles = grouped.select("label", "dim", "parts", "part", *[F.col(f"rows.{f}").alias(f"{f}s") for f in fields])
    key = ["label", "dim", "low", "high"]
    left = tiles.withColumn("low", F.col("part")).withColumn("high", F.explode(F.sequence("part", F.col("parts") - 1)))
    right = tiles.withColumn("high", F.col("part")).withColumn("low", F.explode(F.sequence(F.lit(0), F.col("part"))))
    right = right.select(*key, *[F.when(F.col("low") < F.col("high"), F.col(f"{f}s")).alias(f"{f}s2") for f in fields])
    pairs = left.join(right, key).select("dim", *[f"{f}s" for f in fields], *[f"{f}s2" for f in fields], F.expr("low = high").alias("same"))
    found = materialise(in_arrow(pairs, _compare(least), "a long, b long, cls long, links long"), "vector-links")
    groups = components(found.where("b is not null").select("a", "b"), "vector-stars")
    links = found.where("b is null").groupBy(F.col("a").alias("rep"), "cls").agg(F.sum("links").alias("links"))
    named = (
        coded.select("rep", "cls", "n").join(links, ["rep", "cls"], "left").join(groups, F.col("rep") == F.col("node"), "left")
        .select("rep", "cls", F.coalesce("component", "rep").alias("component_id"),
                (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    )
    members = usable.select("vec_id", "label", "cls", "vector").join(
        classes.select("label", "cls", "vector", "rep"), ["label", "cls", "vector"]).select("vec_id", "rep", "cls").join(named, ["rep", "cls"])
    rest = rows.where(~F.col("usable")).select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    every = members.select("vec_id", "n_links", "component_id").unionByName(rest)
    return every.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
