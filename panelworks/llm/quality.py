"""Quality classifier by positive-unlabelled learning.

Trusted positives are documents labelled good; unlabelled web text is drawn from
the whole table. The share of good text in it is estimated from the scores of
plain positive-against-unlabelled fits on the other half of the sample. The final
linear model minimises the non-negative unbiased risk

    prior * E+[loss(f)] + max(0, Eu[loss(-f)] - prior * E+[loss(-f)])

with the logistic loss in numpy, so its sigmoid is a probability of being good.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelworks.llm.common import blocks, in_arrow, packed
from panelworks.llm.langid import held_out
from panelworks.llm.textstats import word_hashes, words

BYTES = 129  # the ASCII bytes one by one, all others together
STATISTICS = 12
FEATURES = BYTES + STATISTICS


@dataclass(frozen=True)
class QualitySpec:
    """``positives`` and ``unlabelled`` bound the samples that are fitted on."""

    positives: int = 4000
    unlabelled: int = 8000
    epochs: int = 60
    rate: float = 0.05
    batch: int = 256
    decay: float = 1e-3
    beta: float = 0.0
    threshold: float = 0.3
    seed: int = 11


@dataclass(frozen=True)
class QualityModel:
    mean: np.ndarray
    spread: np.ndarray
    weight: np.ndarray
    bias: float
    prior: float


def features(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One row of length-free numbers per document: byte shares, word shape and repetition."""
    out = np.zeros((len(at) - 1, FEATURES), np.float32)
    kind = np.minimum(np.arange(256), BYTES - 1)
    for a, b in blocks(at):
        offsets, data = at[a : b + 1] - at[a], raw[at[a] : at[b]]
        n, size = b - a, np.diff(offsets)
        owner = np.repeat(np.arange(n), size)
        counts = np.bincount(owner * BYTES + kind[data], minlength=n * BYTES).reshape(n, BYTES)
        shares = counts / np.maximum(size, 1)[:, None]
        start, end = words(data, offsets)
        of = owner[start] if len(start) else np.zeros(0, int)
        number = np.bincount(of, minlength=n)
        each = np.maximum(number, 1)
        hashes = word_hashes(data, start, end)
        inside = of[1:] == of[:-1] if len(of) else np.zeros(0, bool)

        def per_word(values: np.ndarray, owners: np.ndarray) -> np.ndarray:
            return np.bincount(owners, weights=values, minlength=n)[:n] / each

        def distinct(keys: np.ndarray, owners: np.ndarray) -> np.ndarray:
            mixed = keys ^ (owners.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            once = np.unique(mixed, return_index=True)[1]
            return np.bincount(owners[once], minlength=n)

        same = (hashes[1:] == hashes[:-1]) & inside
        pairs = (hashes[1:] * np.uint64(31) + hashes[:-1])[inside]
        lone = distinct(pairs, of[1:][inside])
        length = end - start
        lead = data[start] if len(start) else data[:0]
        tail = data[end - 1] if len(start) else data[:0]
        upper, lower = counts[:, 65:91].sum(axis=1), counts[:, 97:123].sum(axis=1)
        odd = counts[:, 33:48].sum(axis=1) + counts[:, 58:65].sum(axis=1) + counts[:, 91:97].sum(axis=1) + counts[:, 123:127].sum(axis=1)
        stats = [
            np.log1p(number), per_word(length, of), np.sqrt(np.maximum(per_word(length**2.0, of) - per_word(length, of) ** 2, 0)),
            per_word(same, of[1:]) if len(of) else np.zeros(n), lone / np.maximum(number - 1, 1), distinct(hashes, of) / each,
            upper / np.maximum(upper + lower, 1), odd / each, per_word((lead >= 65) & (lead <= 90), of),
            per_word((length == 1) & (lead < 128), of), per_word((tail >= 33) & (tail <= 64), of), counts[:, 10] / each,
        ]
        out[a:b, :BYTES] = np.sqrt(shares)
        out[a:b, BYTES:] = np.stack(stats, axis=1)
    return out


def _vectors(batches):
    for batch in batches:
        rows = features(*packed(batch.column("text")))
        yield pa.RecordBatch.from_arrays(
            [batch.column("positive"), pa.array([r.tobytes() for r in rows], pa.binary())], ["positive", "vector"])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _minimise(good: np.ndarray, mixed: np.ndarray, prior: float | None, spec: QualitySpec) -> tuple[np.ndarray, float]:
    """Weights and bias by stochastic gradient descent with momentum; a plain fit when ``prior`` is None."""
    rng = np.random.default_rng(spec.seed)
    weight, bias = np.zeros(good.shape[1]), 0.0
    speed, push = np.zeros_like(weight), 0.0
    batches = max(1, len(mixed) // spec.batch)
    for epoch in range(spec.epochs):
        rate = spec.rate * (1 - epoch / spec.epochs)
        parts = zip(np.array_split(rng.permutation(len(good)), batches), np.array_split(rng.permutation(len(mixed)), batches))
        for i, j in parts:
            if not len(i) or not len(j):
                continue
            p, u = good[i], mixed[j]
            at_p, at_u = _sigmoid(p @ weight + bias), _sigmoid(u @ weight + bias)
            # slopes of loss(f) = log(1 + exp(-f)) and loss(-f) by f
            up, down_p, down_u = (at_p - 1) / len(i), at_p / len(i), at_u / len(j)
            if prior is None:
                slope = up @ p + down_u @ u
                tilt = up.sum() + down_u.sum()
            else:
                rest = -np.log1p(-np.minimum(at_u, 1 - 1e-9)).mean() + prior * np.log1p(-np.minimum(at_p, 1 - 1e-9)).mean()
                slope, tilt = down_u @ u - prior * (down_p @ p), down_u.sum() - prior * down_p.sum()
                if rest >= -spec.beta:
                    slope, tilt = slope + prior * (up @ p), tilt + prior * up.sum()
                else:  # the negative part has gone below zero: step back up
                    slope, tilt = -slope, -tilt
            speed = 0.9 * speed - rate * (slope + spec.decay * weight)
            push = 0.9 * push - rate * tilt
            weight, bias = weight + speed, bias + push
    return weight, bias


def class_prior(good: np.ndarray, mixed: np.ndarray) -> float:
    """Share of good rows in ``mixed``, from scores of both (higher: likelier good).

    Among rows above any score, mixed text holds at least prior * share of the
    good ones, so the least ratio of the two shares bounds the prior from above.
    Upper parts with half of the good rows or more are looked at, and the ratio
    is taken at its lower limit, two standard errors down, as a prior that is too
    high leaves the risk nothing to learn the other class from.
    """
    good, mixed = np.sort(good), np.sort(mixed)
    marks = np.quantile(good, np.linspace(0.0, 0.5, 101))
    above_good = 1 - np.searchsorted(good, marks, "left") / len(good)
    above_mixed = 1 - np.searchsorted(mixed, marks, "left") / len(mixed)
    low = above_mixed - 2 * np.sqrt(above_mixed * (1 - above_mixed) / len(mixed))
    high = above_good + 2 * np.sqrt(above_good * (1 - above_good) / len(good))
    return float(np.clip((low / high).min(), 0.05, 0.98))


def _cross_scores(good: np.ndarray, mixed: np.ndarray, spec: QualitySpec) -> tuple[np.ndarray, np.ndarray]:
    """Scores of every row by a plain fit on the half that it is not in."""
    out = np.zeros(len(good)), np.zeros(len(mixed))
    for k in range(2):
        weight, bias = _minimise(good[k::2], mixed[k::2], None, spec)
        for rows, scores in zip((good, mixed), out):
            scores[1 - k :: 2] = rows[1 - k :: 2] @ weight + bias
    return out


def fit(docs: DataFrame, labels: DataFrame, spec: QualitySpec = QualitySpec()) -> QualityModel | None:
    """Fit on rows that are not held out; None without positives or other text.

    A document is a trusted positive when all its labels say 1. Both samples are
    drawn by a hash of the id; only the ids of the positives drawn, at most
    about ``spec.positives``, are broadcast.
    """
    free = ~held_out(5, 0) & F.col("doc_id").isNotNull()
    trusted = (
        labels.where(free & F.col("quality").isNotNull()).groupBy("doc_id")
        .agg(F.min("quality").alias("q")).where("q = 1").select("doc_id")
    )
    draw = F.pmod(F.xxhash64("doc_id", F.lit(spec.seed)), F.lit(1 << 30)) / float(1 << 30)
    other = F.pmod(F.xxhash64("doc_id", F.lit(spec.seed + 1)), F.lit(1 << 30)) / float(1 << 30)
    n_good, n_all = trusted.count(), docs.count()
    if not n_good or not n_all:
        return None
    picked = trusted.where(draw < spec.positives / n_good).withColumn("positive", F.lit(True))
    rows = docs.select("doc_id", "text").where(free).join(F.broadcast(picked), "doc_id", "left")
    rows = rows.where(F.col("positive") | (other < spec.unlabelled / n_all)).select(
        F.coalesce("positive", F.lit(False)).alias("positive"), "text")
    sample = in_arrow(rows, _vectors, "positive boolean, vector binary").toArrow()
    vectors = sample.column("vector").to_pylist()
    if not vectors:
        return None
    flags = sample.column("positive").to_numpy()
    order = sorted(range(len(vectors)), key=lambda i: (flags[i], vectors[i]))
    x = np.stack([np.frombuffer(vectors[i], np.float32) for i in order]).astype(np.float64)
    good = flags[order].astype(bool)
    if good.all() or not good.any():
        return None
    mean, spread = x.mean(axis=0), x.std(axis=0)
    spread = np.where(spread < 1e-4, 1.0, spread)
    x = np.clip((x - mean) / spread, -6, 6)
    # the rows are ordered by their features, so the halves must be drawn
    drawn = np.random.default_rng(spec.seed).permutation(len(x))
    x, good = x[drawn], good[drawn]
    prior = class_prior(*_cross_scores(x[good], x[~good], spec))
    weight, bias = _minimise(x[good], x[~good], prior, spec)
    return QualityModel(mean, spread, weight, bias, prior)


def _score(model: QualityModel):
    def fn(batches):
        for batch in batches:
            x = np.clip((features(*packed(batch.column("text"))) - model.mean) / model.spread, -6, 6)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(_sigmoid(x @ model.weight + model.bias))],
                ["doc_id", "held_out", "score"])
    return fn


def quality_of(docs: DataFrame, labels: DataFrame, spec: QualitySpec = QualitySpec()) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``docs``.

    A null text counts as empty; an empty text gets the score of its (all zero)
    statistics. Without a model (no positives, or no other text) every score is
    0.5. Repeated rows repeat, a null doc_id is kept and counts as not held
    out. Labels enter only the fit; only doc_id and text are read of ``docs``.
    """
    model = fit(docs, labels, spec)
    rows = docs.select("doc_id", "text", held_out(5, 0).alias("held_out"))
    if model is None:
        scored = rows.select("doc_id", "held_out", F.lit(0.5).alias("score"))
    else:
        kind = docs.schema["doc_id"].dataType.simpleString()
        scored = in_arrow(rows, _score(model), f"doc_id {kind}, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= spec.threshold).cast("int"))
