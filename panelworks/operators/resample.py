"""Grouped bootstrap: students are drawn with replacement, their rows come along.

A replicate is a weight per student, never a copy of rows. Draws are a hash of
(seed, replicate, position), so a retried task draws the same students.

All replicates are worked on at once, as vectors. Draws travel as the steps between
sorted numbers, two bytes a draw, one row per slab of positions and cell of students.
A student gets one row with an array of its weights; rows of equal score are added up
element by element; and the running totals that an AUC needs are prefix sums of arrays,
inside a range of scores and then between ranges. So no step has a row per replicate
and student. Arrays travel as bytes, in the narrowest numbers that hold them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelworks import constants as K
from panelworks.functions.arrow import fields, in_batches, reachable
from panelworks.functions.digests import digest_words
from panelworks.functions.numeric import draw_digest, draw_word, ratio
from panelworks.operators.ordered import null_safe_join, running_totals
from panelworks.session import fan_out, materialise

CELL = 4096  # students whose draws meet in one piece of work
SLAB = 4096  # positions drawn for at a time
FEW = 4096  # digests that are not worth the fixed cost of making them at once
FULL = 65_535  # a step of this size has a next part
GATHER = 65_536  # rows whose equal scores are added up together
LONG = 32  # rows of a score that are added side by side with those of other scores


def numbered(df: DataFrame, key: str, by: Sequence[str] = ()) -> DataFrame:
    """Distinct keys of a group numbered 0.. in md5 order, with the number of keys."""
    keys = df.select(*by, key).distinct().select(
        *by, key, F.md5(F.col(key).cast("string")).alias("_h"), F.lit(1).alias("n"))
    bucket = F.conv(F.substring("_h", 1, 4), 16, 10).cast("int")
    placed = running_totals(keys, by, "_h", ["n"], within=[key], bucket=bucket)
    return placed.select(*by, key, F.col("before_n").alias("place"), F.col("all_n").alias("size"))


def _grouped(batch: pa.RecordBatch, by: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Group number of every row and the first row of every group; nulls are equal."""
    if not by:
        return np.zeros(batch.num_rows, np.int64), np.zeros(min(1, batch.num_rows), np.int64)
    numbers = batch.select(by).to_pandas().groupby(by, dropna=False, sort=False).ngroup().to_numpy()
    return numbers, np.unique(numbers, return_index=True)[1]


def draws(positions: np.ndarray, size: np.ndarray, replicates: int, seed: int, kind: type = np.int64) -> np.ndarray:
    """Drawn places, positions x replicates: 32-bit words of the md5 of (seed, block of four replicates, position)."""
    blocks = -(-replicates // 4)
    once, at = np.unique(positions, return_inverse=True)  # groups that have a position share its words
    heads = [f"{seed}|{b}|".encode() for b in range(blocks)]
    if len(once) * blocks < FEW:
        md5 = hashlib.md5
        digests = b"".join(md5(head + tail).digest() for tail in (b"%d" % p for p in once.tolist()) for head in heads)
        words = np.frombuffer(digests, ">u4").reshape(len(once), 4 * blocks)
    else:
        words = digest_words(heads, once)
    drawn = words[at, :replicates].astype(kind)
    drawn %= size.astype(kind)[:, None]
    return drawn


def _packed_draws(by: list[str], replicates: int, seed: int):
    """Draws of a slab of positions, one row per cell of drawn students: place in the cell and replicate in one number."""
    def fn(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, SLAB):
                slab = batch.slice(at, SLAB)
                group, first = _grouped(slab, by)
                place, size = (slab.column(c).to_numpy() for c in ("place", "size"))
                cells = int(size.max()) // CELL + 1
                # half as wide, twice as fast
                kind = np.uint32 if (int(group.max()) + 1) * cells * CELL * replicates < 2**32 else np.int64
                drawn = draws(place, size, replicates, seed, kind)
                drawn += (group * (cells * CELL)).astype(kind)[:, None]
                drawn *= kind(replicates)
                drawn += np.arange(replicates, dtype=kind)
                drawn = drawn.ravel()
                drawn.sort()
                key, code = np.divmod(drawn, CELL * replicates)
                start = np.nonzero(np.append(True, key[1:] != key[:-1]))[0]
                codes = pa.ListArray.from_arrays(pa.array(np.append(start, len(key)).astype(np.int32)), pa.array(code.astype(np.int32)))
                at_group, cell = np.divmod(key[start].astype(np.int64), cells)
                rows = pa.array(first[at_group])
                yield pa.RecordBatch.from_arrays(
                    [slab.column(c).take(rows) for c in by] + [pa.array(cell), codes], [*by, "cell", "codes"])
    return fn


def _steps(codes: pa.ListArray) -> pa.Array:
    """Sorted codes of every row as the bytes of the steps between them, 16 bits each; a larger step takes several."""
    start, code = codes.offsets.to_numpy(), codes.values.to_numpy()
    step = code.copy()
    step[1:] -= code[:-1]
    step[start[:-1]] = code[start[:-1]]
    if step.max(initial=0) >= FULL:
        parts = step // FULL + 1
        ends = np.cumsum(parts)
        units = np.full(ends[-1], FULL, "<u2")
        units[ends - 1] = step % FULL
        start = np.append(0, ends)[start]
    else:
        units = step.astype("<u2")
    return pa.Array.from_buffers(pa.binary(), len(codes), [None, pa.py_buffer((start * 2).astype(np.int32)), pa.py_buffer(units)])


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a binary column, and where each row begins and the last ends."""
    kind = "<i8" if pa.types.is_large_binary(column.type) else "<i4"
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data else np.empty(0, np.uint8), at - at[0]


def _codes(column: pa.Array) -> np.ndarray:
    """The codes of all rows, from their steps."""
    data, at = _bytes(column)
    units, start = data.view("<u2"), at // 2
    code = np.cumsum(units, dtype=np.int64)
    code -= np.repeat(np.append(0, code)[start[:-1]], np.diff(start))
    ends = units != FULL
    return code if ends.all() else code[ends]


def _arrays(rows: np.ndarray, kind: str | None = None) -> pa.Array:
    """Rows of numbers as bytes, ``kind`` or else the narrowest that holds them all."""
    low, top = rows.min(initial=0), rows.max(initial=0)
    kind = kind or next(k for k in ("u1", "<u2", "<u4", "<i8") if np.iinfo(k).min <= low and top <= np.iinfo(k).max)
    data = np.ascontiguousarray(rows.astype(kind, copy=False))
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * np.int32(data.itemsize * rows.shape[1])
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def _numbers(column: pa.Array, replicates: int) -> np.ndarray:
    """Rows of numbers from their bytes, a null as zeros."""
    data, at = _bytes(column)
    width = np.diff(at) // replicates
    kinds = {w: {1: "u1", 2: "<u2", 4: "<u4", 8: "<i8"}[w] for w in np.unique(width[width > 0]).tolist()}
    if len(kinds) == 1 and width.all():
        return data.view(next(iter(kinds.values()))).reshape(-1, replicates)
    out = np.zeros((len(column), replicates), kinds[max(kinds)] if kinds else "u1")
    for w, kind in kinds.items():
        rows = np.nonzero(width == w)[0]
        mine = data if len(kinds) == 1 else data[np.repeat(width == w, np.diff(at))]
        out[rows] = mine.view(kind).reshape(-1, replicates)
    return out


def _cell_weights(by: list[str], replicates: int, kind: str | None):
    """One row per drawn student of a cell with its weights in all replicates."""
    def fn(table: pa.Table) -> pa.Table:
        code = np.concatenate([_codes(chunk) for chunk in table.column("codes").chunks])
        weights = np.bincount(code, minlength=CELL * replicates).reshape(CELL, replicates)
        some = np.nonzero(weights.any(axis=1))[0]
        repeat = pa.array(np.zeros(len(some), np.int64))
        return pa.Table.from_arrays(
            [table.column(c).take(repeat) for c in by]
            + [pa.array(some + table.column("cell")[0].as_py() * CELL), _arrays(weights[some], kind)],
            [*by, "place", "weights"])
    return fn


def _sent_draws(by: list[str], replicates: int, seed: int):
    """``_packed_draws`` with the codes as bytes, which Spark passes on whole."""
    packs = _packed_draws(by, replicates, seed)

    def fn(batches):
        for batch in packs(batches):
            yield batch.set_column(len(by) + 1, "codes", _steps(batch.column("codes")))
    return fn


def weight_arrays(places: DataFrame, replicates: int, seed: int = K.SEED, by: Sequence[str] = (), kind: str | None = "<i4"
                  ) -> DataFrame:
    """(place, weights): how often a numbered key is drawn in each replicate, as packed numbers.

    They have 32 bits, or without a ``kind`` as few as the largest of a cell needs. Keys
    that no replicate draws have no row.
    """
    by = list(by)
    # equal places of all groups lie side by side
    spread = fan_out(places.select(*by, "place", "size"), "place").sortWithinPartitions("place")
    packs = in_batches(spread, _sent_draws(by, replicates, seed), f"{fields(places, by)}cell long, codes binary")
    reachable(places.sparkSession)
    return packs.groupBy(*by, "cell").applyInArrow(
        _cell_weights(by, replicates, kind), f"{fields(places, by)}place long, weights binary")


def draw_weights(df: DataFrame, key: str, replicates: int, seed: int = K.SEED, by: Sequence[str] = ()) -> DataFrame:
    """(replicate, key, weight) in long form: how often each key is drawn in each replicate."""
    by = list(by)
    places = numbered(df, key, by)
    blocks = F.sequence(F.lit(0), F.lit((replicates - 1) // 4))
    spread = fan_out(places.select(*by, "place", "size"), "place")
    digests = spread.select(*by, "size", "place", F.explode(blocks).alias("_block")).select(
        *by, "size", "_block", draw_digest(seed, F.col("_block"), F.col("place")).alias("_d"))
    words = F.array(*[
        F.struct((F.col("_block") * 4 + w).cast("int").alias("replicate"),
                 draw_word(F.col("_d"), w, F.col("size")).alias("place"))
        for w in range(4)
    ])
    drawn = digests.select(*by, F.inline(words)).where(F.col("replicate") < replicates)
    counted = drawn.groupBy(*by, "replicate", "place").agg(F.count(F.lit(1)).alias("weight"))
    joined = null_safe_join(counted, places.select(*by, "place", key), [*by, "place"])
    return joined.select(*by, "replicate", key, "weight")


def _with_weights(rows: DataFrame, weights: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Rows with the weights of their place.

    The planner takes a packed array for a few bytes, so by size it would collect the
    weights of all students at the driver to broadcast them: both sides are shuffled.
    """
    return null_safe_join(rows.hint("merge"), weights.hint("merge"), [*by, "place"])


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of ``GATHER`` rows and more, and a last one."""
    held, rows = [], 0
    for batch in batches:
        held, rows = [*held, batch], rows + batch.num_rows
        if rows >= GATHER:
            yield pa.concat_batches(held)
            held, rows = [], 0
    if rows:
        yield pa.concat_batches(held)


def _run_sums(values: np.ndarray, rows: np.ndarray, times: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Sums of ``times`` x ``values`` of ``rows`` over runs that begin at ``start``.

    The k-th rows of all runs are added at once; what is left of a long run is added by itself.
    """
    length = np.diff(np.append(start, len(rows)))
    top = int(values.max(initial=0)) * int(np.abs(times).max(initial=0)) * int(length.max(initial=0))
    kind = np.int32 if top < 2**31 else np.int64
    once = bool((times == 1).all())

    def part(at: np.ndarray | slice) -> np.ndarray:
        some = values[rows[at]]
        return some if once else some.astype(kind) * times[at, None].astype(kind)

    out = np.zeros((len(start), values.shape[1]), kind)
    for k in range(min(LONG, length.max(initial=0))):
        at = np.nonzero(length > k)[0]
        out[at] += part(start[at] + k)
    for i in np.nonzero(length > LONG)[0]:
        for a in range(start[i] + LONG, start[i] + length[i], SLAB):
            out[i] += part(slice(a, min(a + SLAB, start[i] + length[i]))).sum(axis=0, dtype=kind)
    return out


def _score_sums(by: list[str], scores: list[str], replicates: int):
    """Weighted positives and negatives of every replicate per distinct score of some batches."""
    def sums(batch: pa.RecordBatch, name: str, weights: np.ndarray, group: np.ndarray) -> Iterator[pa.RecordBatch]:
        value = batch.column(name).to_numpy(zero_copy_only=False)
        used = np.nonzero(~np.isnan(value))[0]  # a null score comes as NaN
        if not len(used):
            return
        used = used[np.lexsort((value[used], group[used]))]
        new = np.append(True, (value[used][1:] != value[used][:-1]) | (group[used][1:] != group[used][:-1]))
        start = np.nonzero(new)[0]
        run, found = np.cumsum(new) - 1, {}
        for c in ("_pos", "_neg"):  # a row has one class as a rule
            times = batch.column(c).to_numpy()[used]
            has = np.nonzero(times != 0)[0]
            runs, first = np.unique(run[has], return_index=True)
            found[c] = runs, _run_sums(weights, used[has], times[has], first)
        for a in range(0, len(start), SLAB):
            rows = pa.array(used[start[a : a + SLAB]])
            columns = [batch.column(c).take(rows) for c in by] + [pa.array([name] * len(rows), pa.string()), pa.array(value[used][start[a : a + SLAB]])]
            for runs, total in found.values():
                lo, hi = np.searchsorted(runs, [a, a + len(rows)])
                at = np.full(len(rows), -1)
                at[runs[lo:hi] - a] = np.arange(hi - lo)
                columns.append(_arrays(total[lo:hi]).take(pa.array(at, mask=at < 0)))
            yield pa.RecordBatch.from_arrays(columns, [*by, "score", "_s", "pos", "neg"])

    def fn(batches):
        for batch in _gathered(batches):
            weights, (group, _) = _numbers(batch.column("weights"), replicates), _grouped(batch, by)
            for name in scores:
                yield from sums(batch, name, weights, group)
    return fn


def _range_sums(by: list[str], replicates: int):
    """Prefix sums of arrays over one range of sorted scores: totals and wins per group and replicate.

    A win is a positive above a negative, a tie half a win. The sums of one score
    may come in several rows, also of two batches, so the last score stays open.
    """
    zero = np.zeros(replicates)

    def fn(batches):
        state, key, names = None, None, [*by, "score"]

        def close(done):
            key_row, last, pos, neg, wins, open_pos, open_neg = done
            wins = wins + open_pos * (neg + open_neg / 2)
            return pa.RecordBatch.from_arrays(
                [*key_row, *[pa.array([x.tolist()], pa.list_(pa.float64())) for x in (pos + open_pos, neg + open_neg, wins)]],
                [*names, "pos", "neg", "wins"])

        for batch in batches:
            if not batch.num_rows:
                continue
            group, value = _grouped(batch, names)[0], batch.column("_s").to_numpy()
            pos, neg = (_numbers(batch.column(c), replicates).astype(float) for c in ("pos", "neg"))
            edges = np.append(np.nonzero(np.append(True, group[1:] != group[:-1]))[0], batch.num_rows)
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
                of = tuple(batch.column(c)[a].as_py() for c in names)
                if state is not None and of != key:
                    yield close(state)
                    state = None
                if state is None:
                    key, state = of, ([batch.column(c).slice(a, 1) for c in names], None, zero, zero, zero, zero, zero)
                row, last, all_pos, all_neg, wins, open_pos, open_neg = state
                start = np.nonzero(np.append(True, value[a + 1 : b] != value[a : b - 1]))[0]
                p, n = (np.add.reduceat(x[a:b], start, axis=0) for x in (pos, neg))
                if last is not None and last == value[a]:
                    p[0] += open_pos
                    n[0] += open_neg
                else:
                    wins = wins + open_pos * (all_neg + open_neg / 2)
                    all_pos, all_neg = all_pos + open_pos, all_neg + open_neg
                before = all_neg + np.cumsum(n, axis=0) - n
                wins = wins + (p[:-1] * (before[:-1] + n[:-1] / 2)).sum(axis=0)
                state = (row, value[b - 1], all_pos + p[:-1].sum(axis=0), all_neg + n[:-1].sum(axis=0), wins, p[-1], n[-1])
        if state is not None:
            yield close(state)
    return fn


def bootstrap_auc(scored: DataFrame, replicates: int = K.BOOTSTRAP_REPLICATES, key: str = "id", y: str = "y",
                  scores: Sequence[str] = ("p",), seed: int = K.SEED, by: Sequence[str] = ()) -> DataFrame:
    """AUC per (group, replicate, score name); one-class replicates are left out."""
    by, names = list(by), [f"_s_{k}" for k in range(len(scores))]
    places = numbered(scored, key, by)
    # rows of a student with the same scores count together before they meet the weights
    folded = scored.groupBy(*by, key, *[F.col(c).cast("double").alias(n) for c, n in zip(scores, names)]).agg(
        F.sum(y).cast("long").alias("_pos"), F.sum(1 - F.col(y)).cast("long").alias("_neg"))
    located = null_safe_join(folded, places.select(*by, key, "place"), [*by, key])
    weighted = _with_weights(located.drop(key), weight_arrays(places, replicates, seed, by, kind=None), by)
    group = fields(scored, by)
    sums = materialise(in_batches(weighted.drop("place"), _score_sums(by, names, replicates),
                                  f"{group}score string, _s double, pos binary, neg binary"), "bootstrap-sums")
    order = [*by, "score", "_s"]
    ranges = in_batches(sums.repartitionByRange(*order).sortWithinPartitions(*order), _range_sums(by, replicates),
                        f"{group}score string, pos array<double>, neg array<double>, wins array<double>")
    each = ranges.withColumn("_range", F.spark_partition_id()).select(
        *by, "score", "_range", F.posexplode(F.arrays_zip("pos", "neg", "wins")).alias("replicate", "x")).select(
        *by, "score", "replicate", "_range", "x.*")
    # a row per range, few whatever the group size
    below = Window.partitionBy(*by, "score", "replicate").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    wins = F.col("wins") + F.col("pos") * F.coalesce(F.sum("neg").over(below), F.lit(0.0))
    out = each.select(*by, "score", "replicate", "pos", "neg", wins.alias("wins")).groupBy(*by, "replicate", "score").agg(
        F.sum("wins").alias("w"), F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    named = F.element_at(F.create_map(*[F.lit(x) for n, c in zip(names, scores) for x in (n, c)]), F.col("score"))
    return out.select(*by, "replicate", named.alias("score"), ratio(F.col("w"), F.col("p") * F.col("n")).alias("auc")).where("auc is not null")


def bootstrap_interval(scored: DataFrame, replicates: int = K.BOOTSTRAP_REPLICATES, key: str = "id",
                       y: str = "y", p: str = "p", seed: int = K.SEED, by: Sequence[str] = ()) -> DataFrame:
    """95 % percentile interval of the AUC; one value per replicate is all that is ranked."""
    aucs = bootstrap_auc(scored, replicates, key, y, (p,), seed, by)
    return aucs.groupBy(*by).agg(
        F.percentile("auc", F.lit(0.025)).alias("auc_ci_low"), F.percentile("auc", F.lit(0.975)).alias("auc_ci_high"),
        F.count(F.lit(1)).alias("n_replicates"),
    )


def paired_difference(scored: DataFrame, first: str, second: str, replicates: int = K.PAIRED_REPLICATES,
                      key: str = "id", y: str = "y", seed: int = K.SEED) -> DataFrame:
    """Mean, 95 % interval and share above zero of AUC(first) − AUC(second) on the same draws."""
    aucs = bootstrap_auc(scored, replicates, key, y, (first, second), seed)
    sides = aucs.groupBy("replicate").agg(
        F.max(F.when(F.col("score") == first, F.col("auc"))).alias("_a"),
        F.max(F.when(F.col("score") == second, F.col("auc"))).alias("_b"),
    ).select((F.col("_a") - F.col("_b")).alias("d")).where(F.col("d").isNotNull())
    return sides.agg(
        F.avg("d").alias("delta"), F.percentile("d", F.lit(0.025)).alias("ci_low"),
        F.percentile("d", F.lit(0.975)).alias("ci_high"),
        F.avg((F.col("d") > 0).cast("double")).alias("p_gt_0"), F.count(F.lit(1)).alias("n_replicates"),
    )
