"""Exact inner-product search through a pivot-distance index.

Every vector has a key: its nearest pivot and its distance to it. The rows are
range-partitioned by key into shelves, so a shelf is a sorted run of annuli around
a few pivots. A query meets the annuli in the order of their least possible
distance and stops where the triangle inequality leaves no better product:

    product(q, v) = (|q|^2 + |v|^2 - |q - v|^2) / 2
                 <= (|q|^2 + largest |v|^2 of the annulus - gap^2) / 2

with ``gap`` the distance from q's own distance to the pivot to the annulus.
Every query is first answered by its own shelf. Its k-th product there is a bound
that decides which other shelves it is sent to.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelworks.llm.common import in_arrow
from panelworks.session import materialise

PIVOTS = 64
SAMPLE = 4096  # vectors the pivots are chosen from, those of the smallest key hash
SHELF = 32_768  # vectors of a shelf, but at least as many shelves as shuffle partitions
RING = 512  # vectors of an annulus that is looked at as one
BLOCK = 1024  # queries that go through a shelf together
SCALE = 1024
SEED = 21


NONE = np.iinfo(np.int64).min  # in place of a product: there is none


def whole_numbers(column: pa.ListArray, dim: int) -> np.ndarray:
    """Rows of floor(SCALE * x) as long integers; all rows of the column have ``dim`` components."""
    flat = np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * SCALE)
    if np.abs(flat).max(initial=0) >= 2.0**62:
        raise OverflowError("components of these vectors do not fit 64 bits")
    return flat.astype(np.int64).reshape(len(column), dim)


def choose_pivots(sample: np.ndarray, number: int = PIVOTS, rounds: int = 8) -> np.ndarray:
    """Centres of a few Lloyd rounds from evenly spread sample rows; no more than distinct rows."""
    rows = np.unique(sample.astype(np.float64), axis=0)
    centres = rows[np.linspace(0, len(rows) - 1, min(number, len(rows))).astype(int)]
    for _ in range(rounds):
        near = distances(rows, centres).argmin(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, rows)
        size = np.bincount(near, minlength=len(centres))
        centres = np.where(size[:, None] > 0, sums / np.maximum(size, 1)[:, None], centres)
    return centres


def distances(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Euclidean distances, rows x centres, taken from the differences and so never off by cancellation."""
    out = np.empty((len(rows), len(centres)))
    for k, centre in enumerate(centres):
        step = rows - centre
        out[:, k] = np.sqrt(np.einsum("ij,ij->i", step, step))
    return out


def products(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers."""
    most = int(np.abs(queries).max(initial=0)) * int(np.abs(rows).max(initial=0)) * max(1, rows.shape[1])
    if most < 1 << 53:  # every partial sum is a whole number that a double holds
        return (queries.astype(np.float64) @ rows.T.astype(np.float64)).astype(np.int64)
    if most < 1 << 63:
        return queries @ rows.T
    raise OverflowError("inner products of these vectors do not fit 64 bits")


class Shelf:
    """Sorted vectors of one shelf with their annuli."""

    def __init__(self, ids, rows, pivot, distance, centres):
        order = np.lexsort((ids, distance, pivot))
        self.ids, self.rows, self.centres = ids[order], rows[order], centres
        pivot, distance = pivot[order], distance[order]
        squares = np.einsum("ij,ij->i", self.rows.astype(np.float64), self.rows.astype(np.float64))
        # an annulus ends where the pivot changes and after RING vectors
        change = np.append(True, pivot[1:] != pivot[:-1])
        since = np.arange(len(pivot)) - np.maximum.accumulate(np.where(change, np.arange(len(pivot)), 0))
        self.start = np.nonzero(since % RING == 0)[0]
        self.stop = np.append(self.start[1:], len(pivot))
        self.pivot = pivot[self.start]
        self.low, self.high = distance[self.start], distance[self.stop - 1]
        self.largest = np.maximum.reduceat(squares, self.start)

    def search(self, queries: np.ndarray, k: int, bound: np.ndarray, own: np.ndarray | None = None) -> tuple:
        """For each query the best ``k`` (id, product) of this shelf that reach its bound.

        ``own`` is the place in key order of a query that is a row of this shelf itself.
        """
        n, real = len(queries), queries.astype(np.float64)
        square = np.einsum("ij,ij->i", real, real)
        away = distances(real, self.centres)[:, self.pivot]
        gap = np.maximum(np.maximum(self.low - away, away - self.high), 0)
        # the slack is far above the rounding of a distance
        reach = square[:, None] + self.largest
        ceiling = (reach - gap * gap) / 2 + 1e-9 * reach + 0.25
        best, names = np.full((n, k), NONE), np.full((n, k), np.iinfo(np.int64).max)
        bound = bound.copy()
        for ring in np.argsort(gap.min(axis=0), kind="stable"):
            ask = np.nonzero(ceiling[:, ring] >= bound)[0]
            if not len(ask):
                if (ceiling < bound[:, None]).all():
                    break
                continue
            ceiling[ask, ring] = -np.inf
            part = slice(self.start[ring], self.stop[ring])
            score = products(queries[ask], self.rows[part])
            if own is not None:
                inside = np.nonzero((own[ask] >= part.start) & (own[ask] < part.stop))[0]
                score[inside, own[ask][inside] - part.start] = NONE
            # what is below the bound or the annulus' own k-th product is out; ties with it stay
            least = np.maximum(bound[ask], NONE + 1)
            if score.shape[1] > k:
                least = np.maximum(least, np.partition(score, score.shape[1] - k, axis=1)[:, -k])
            i, j = np.nonzero(score >= least[:, None])
            of = np.concatenate([np.repeat(np.arange(len(ask)), k), i])
            score = np.concatenate([best[ask].ravel(), score[i, j]])
            name = np.concatenate([names[ask].ravel(), self.ids[part][j]])
            order = np.lexsort((name, ~score, of))  # the complement turns the order round without overflow
            first = np.searchsorted(of[order], np.arange(len(ask)))
            chosen = order[first[:, None] + np.arange(k)]
            best[ask], names[ask] = score[chosen], name[chosen]
            bound[ask] = np.maximum(bound[ask], best[ask, -1])
        return names, best, best > NONE


_FOUND = "array<struct<vec_id: long, score: long>>"
_HITS = pa.list_(pa.struct([("vec_id", pa.int64()), ("score", pa.int64())]))


def _listed(names, best, real) -> pa.Array:
    at = np.append(0, np.cumsum(real.sum(axis=1))).astype(np.int32)
    pairs = pa.StructArray.from_arrays([pa.array(names[real]), pa.array(best[real])], ["vec_id", "score"])
    return pa.ListArray.from_arrays(pa.array(at), pairs).cast(_HITS)


def _keys(centres: dict[int, np.ndarray]):
    """Adds the nearest pivot and the distance to it; vectors of a length outside the sample have the origin."""
    def fn(batches):
        for batch in batches:
            column = batch.column("vector")
            lengths = np.diff(column.offsets.to_numpy())
            pivot, distance, square = np.zeros(len(lengths), np.int32), np.zeros(len(lengths)), np.zeros(len(lengths))
            for dim in np.unique(lengths):
                which = np.nonzero(lengths == dim)[0]
                rows = whole_numbers(column.take(pa.array(which)), dim).astype(np.float64)
                away = distances(rows, centres.get(int(dim), np.zeros((1, dim))))
                pivot[which] = away.argmin(axis=1)
                distance[which] = away.min(axis=1)
                square[which] = np.einsum("ij,ij->i", rows, rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), column, pa.array(lengths.astype(np.int32)), pa.array(pivot), pa.array(distance),
                 pa.array(square)], ["vec_id", "vector", "dim", "pivot", "distance", "square"])
    return fn


def _held(batches: list) -> pa.Table:
    return pa.Table.from_batches(batches).combine_chunks()


def _column(table: pa.Table, name: str) -> pa.Array:
    column = table.column(name)
    return column.chunk(0) if column.num_chunks == 1 else pa.concat_arrays(column.chunks)


def _shelf_of(table: pa.Table, centres: dict[int, np.ndarray]) -> tuple[Shelf, np.ndarray]:
    """The shelf of rows of one length, and the rows' order in it."""
    dim = table.column("dim")[0].as_py()
    ids, pivot, distance = (table.column(c).to_numpy() for c in ("vec_id", "pivot", "distance"))
    rows = whole_numbers(_column(table, "vector"), dim)
    return Shelf(ids, rows, pivot, distance, centres.get(dim, np.zeros((1, dim)))), np.lexsort((ids, distance, pivot))


def _build(centres: dict[int, np.ndarray], k: int, every: int):
    """Rows of a shelf, and for its queries what the shelf itself answers with the k-th product as bound."""
    def fn(batches):
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = _held(held)
        lengths = table.column("dim").to_numpy()
        for dim in np.unique(lengths):
            part = table.filter(pa.array(lengths == dim))
            shelf, order = _shelf_of(part, centres)
            hits: list = [None] * part.num_rows
            bounds = np.full(part.num_rows, NONE)
            asking = np.nonzero(shelf.ids % every == 0)[0]
            for at in range(0, len(asking), BLOCK):
                own = asking[at : at + BLOCK]
                names, best, real = shelf.search(shelf.rows[own], k, bounds[own], own)
                bounds[order[own]] = best[:, -1]
                for place, found in zip(order[own].tolist(), _listed(names, best, real).to_pylist()):
                    hits[place] = found
            part = part.append_column("place", pa.array(np.arange(part.num_rows)))
            yield from part.append_column("hits", pa.array(hits, _HITS)).append_column("bound", pa.array(bounds)).to_batches(8192)
    return fn


def _answer(centres: dict[int, np.ndarray], k: int):
    """Answers of each shelf to the queries sent to it: the rows of a shelf come first, then its queries."""
    def fn(batches):
        held, of, shelf = [], None, None
        for batch in batches:
            keys = list(zip(batch.column("shelf").to_pylist(), batch.column("dim").to_pylist()))
            asks = batch.column("ask").to_pylist()
            edges = [0, *[i for i in range(1, len(keys)) if keys[i] != keys[i - 1] or asks[i] != asks[i - 1]], len(keys)]
            for a, b in zip(edges[:-1], edges[1:]):
                if a == b:
                    continue
                if keys[a] != of:
                    held, of, shelf = [], keys[a], None
                piece = batch.slice(a, b - a)
                if not asks[a]:
                    held.append(piece)
                    continue
                if not held:
                    continue
                shelf = shelf or _shelf_of(_held(held), centres)[0]
                rows = whole_numbers(piece.column("vector"), of[1])
                bound = piece.column("bound").to_numpy()
                for at in range(0, len(rows), BLOCK):
                    part = slice(at, at + BLOCK)
                    names, best, real = shelf.search(rows[part], k, bound[part])
                    some = np.nonzero(real.any(axis=1))[0]
                    yield pa.RecordBatch.from_arrays(
                        [piece.column(c).slice(at, BLOCK).take(pa.array(some)) for c in ("vec_id", "origin", "place")]
                        + [_listed(names[some], best[some], real[some])], ["query_id", "origin", "place", "hits"])
    return fn


def nearest(vectors: DataFrame, k: int = 10, every: int = 100, pivots: int = PIVOTS) -> DataFrame:
    """query_id, rank, vec_id and score: the ``k`` largest inner products of every query with the other rows.

    A component x counts as floor(1024 * x). Queries are the rows whose vec_id is
    divisible by ``every``; ties go to the smaller vec_id. A row takes no part when
    its vec_id or vector is null or a component is null or not finite. Vectors of
    different lengths have no product. Rows with one vec_id are rows of their own,
    so a repeated query is answered as often as it stands there, each time with the
    other copies among its candidates. An empty table gives no rows. Products beyond
    64 bits raise. Only vec_id and embedding are read. The pivots are fitted on
    ``SAMPLE`` rows; every row is indexed, and the answer is exact.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("vector"))
    fine = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & F.coalesce(fine, F.lit(False)))
    drawn = rows.select("vector", F.xxhash64("vec_id", "vector").alias("h")).orderBy("h").limit(SAMPLE).select("vector")
    by_length: dict[int, list] = {}
    for row in drawn.collect():  # SAMPLE rows at most
        by_length.setdefault(len(row[0]), []).append(row[0])
    centres = {dim: choose_pivots(np.floor(np.array(some, np.float64) * SCALE), pivots) for dim, some in by_length.items() if dim}
    kind = rows.schema["vector"].dataType.simpleString()
    fields = f"vec_id long, vector {kind}, dim int, pivot int, distance double, square double"
    keyed = in_arrow(rows, _keys(centres), fields)
    shelves = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // SHELF))
    # equal keys are parted by id and then at random, so copies of a vector or of a row fill several shelves
    placed = keyed.repartitionByRange(shelves, "dim", "pivot", "distance", "vec_id", F.rand(SEED))
    index = materialise(in_arrow(
        placed.withColumn("shelf", F.spark_partition_id()), _build(centres, k, every),
        fields + f", shelf int, place long, hits {_FOUND}, bound long"), "pivot-index")
    asking = index.where("hits is not null")
    rings = index.groupBy("dim", "pivot", F.col("shelf").alias("target")).agg(
        F.min("distance").alias("low"), F.max("distance").alias("high"), F.max("square").alias("largest"))
    # queries of one shelf are close to each other; they are sent on together
    spread = in_arrow(asking.select("shelf", "dim", "vector", "square", "bound"), _reach(centres),
                      "shelf int, dim int, pivot int, near double, far double, room double")
    groups = spread.groupBy("shelf", "dim", "pivot").agg(F.min("near").alias("near"), F.max("far").alias("far"), F.max("room").alias("room"))
    gap = F.greatest(F.col("near") - F.col("high"), F.col("low") - F.col("far"), F.lit(0.0))
    open_to = gap * gap * (1 - 1e-9) <= F.col("room") + F.col("largest") * (1 + 1e-9)
    routes = groups.join(rings, ["dim", "pivot"]).where((F.col("shelf") != F.col("target")) & open_to)
    routes = routes.select("dim", "shelf", "target").distinct()
    sent = asking.join(routes, ["dim", "shelf"]).select(
        F.col("target").alias("shelf"), "dim", F.lit(True).alias("ask"), "vec_id", "vector", "pivot", "distance", "bound",
        F.col("shelf").alias("origin"), "place")
    stored = index.select(
        "shelf", "dim", F.lit(False).alias("ask"), "vec_id", "vector", "pivot", "distance", "bound", F.col("shelf").alias("origin"), "place")
    meeting = stored.unionByName(sent).repartition(shelves, "shelf").sortWithinPartitions("shelf", "dim", "ask")
    others = in_arrow(meeting, _answer(centres, k), f"query_id long, origin int, place long, hits {_FOUND}")
    found = asking.select(F.col("vec_id").alias("query_id"), F.col("shelf").alias("origin"), "place", "hits").unionByName(others)
    order = Window.partitionBy("query_id", "origin", "place").orderBy(F.desc("score"), "vec_id")
    ranked = found.select("query_id", "origin", "place", F.inline("hits")).withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _reach(centres: dict[int, np.ndarray]):
    """For each pivot the least and greatest distance of a batch's queries, and their room below the bound."""
    def fn(batches):
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in ("shelf", "dim")], axis=1)
            square, bound = batch.column("square").to_numpy(), batch.column("bound").to_numpy()
            for shelf, dim in np.unique(keys, axis=0):
                which = np.nonzero((keys == (shelf, dim)).all(axis=1))[0]
                rows = whole_numbers(batch.column("vector").take(pa.array(which)), dim).astype(np.float64)
                away = distances(rows, centres.get(int(dim), np.zeros((1, dim))))
                n = away.shape[1]
                room = float((square[which] * (1 + 1e-9) - 2.0 * bound[which]).max()) + 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, shelf, np.int32)), pa.array(np.full(n, dim, np.int32)), pa.array(np.arange(n, dtype=np.int32)),
                     pa.array(away.min(axis=0)), pa.array(away.max(axis=0)), pa.array(np.full(n, room))],
                    ["shelf", "dim", "pivot", "near", "far", "room"])
    return fn


#: the same search in plain SQL, every query against every row
ORACLE = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, [floor(1024 * x::DOUBLE) for x in embedding] AS iv FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len([x for x in embedding if x IS NULL OR NOT isfinite(x::DOUBLE)]) = 0),
s AS (
  SELECT q.r, q.vec_id AS query_id, c.vec_id, list_sum([z[1] * z[2] for z in list_zip(q.iv, c.iv)])::BIGINT AS score
  FROM v q JOIN v c ON q.r <> c.r AND len(q.iv) = len(c.iv) WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS rank FROM s)
WHERE rank <= 10
"""
