"""Language identification by averaged hashed subword embeddings.

A document is the mean of the embeddings of its byte n-grams, hashed into
``2**bits`` buckets, with a linear softmax on top; both are trained together by
stochastic gradient descent in numpy on a bounded sample of labelled rows. For
prediction the two linear maps are folded into one table of scores per bucket.
The softmax is calibrated by a temperature on rows kept out of the fit, which
also set the confidence below which a document is rejected.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from panelworks.llm.common import blocks, in_arrow, packed
from panelworks.llm.textstats import gram_buckets, sums_by_document

UNKNOWN = "und"


@dataclass(frozen=True)
class LangSpec:
    """``rows_per_language`` bounds the fitted sample, half as many calibrate;
    ``error`` is the share of wrong answers allowed among accepted rows;
    ``even`` the confidence that an accepted row needs in any case."""

    orders: tuple[int, ...] = (2, 3, 4)
    bits: int = 14
    width: int = 16
    rows_per_language: int = 600
    epochs: int = 12
    rate: float = 1.0
    batch: int = 32
    error: float = 0.01
    even: float = 0.5
    seed: int = 7


@dataclass(frozen=True)
class LangModel:
    langs: list[str]
    scores: np.ndarray  # (buckets + 1) x languages
    bias: np.ndarray
    temperature: float
    least: float
    spec: LangSpec


def held_out(modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id as text leaves ``remainder``; false for a null id."""
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    return F.coalesce(crc % modulus == remainder, F.lit(False))


def _has_letter() -> Column:
    return F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))


def _softmax(logits: np.ndarray) -> np.ndarray:
    power = np.exp(logits - logits.max(axis=1, keepdims=True))
    return power / power.sum(axis=1, keepdims=True)


def _mean_grams(spec: LangSpec):
    """Non-empty buckets of each row and the share of its n-grams in them."""
    def fn(batches):
        for batch in batches:
            raw, at = packed(batch.column("text"))
            keys, shares = [], []
            for a, b in zip(at[:-1], at[1:]):
                found = np.concatenate(gram_buckets(raw[a:b], np.array([b - a]), spec.orders, spec.bits))
                count = np.bincount(found, minlength=(1 << spec.bits) + 1)[:-1]
                some = np.nonzero(count)[0]
                keys.append(some.astype(np.int32).tobytes())
                shares.append((count[some] / max(1, count.sum())).astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("lang"), batch.column("part"), pa.array(keys, pa.binary()), pa.array(shares, pa.binary())],
                ["lang", "part", "keys", "shares"])
    return fn


def fit(labelled: DataFrame, spec: LangSpec = LangSpec()) -> LangModel | None:
    """Fit on (doc_id, text, lang) rows with a known language; None without any.

    The sample takes rows by a hash of their id, so it is the same on every run.
    """
    rows = labelled.where("text is not null and lang is not null").select("doc_id", "text", "lang")
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return None
    langs = sorted(counts)
    want = 1.5 * spec.rows_per_language
    share = F.coalesce(*[F.when(F.col("lang") == c, F.lit(want / n)) for c, n in counts.items()])
    draw = F.pmod(F.xxhash64("doc_id", F.lit(spec.seed)), F.lit(1 << 30)) / float(1 << 30)
    drawn = rows.withColumn("draw", draw).where(F.col("draw") < share)
    drawn = drawn.withColumn("part", (F.col("draw") >= share * 2 / 3).cast("int")).select("lang", "part", "text")
    sample = in_arrow(drawn, _mean_grams(spec), "lang string, part int, keys binary, shares binary").toArrow()
    target = np.array([langs.index(x) for x in sample.column("lang").to_pylist()])
    part = sample.column("part").to_numpy()
    keys = [np.frombuffer(x, np.int32) for x in sample.column("keys").to_pylist()]
    shares = [np.frombuffer(x, np.float32) for x in sample.column("shares").to_pylist()]
    # a fixed order, whatever the order in which tasks ended
    order = sorted(range(len(keys)), key=lambda i: (target[i], keys[i].tobytes(), shares[i].tobytes()))
    train = np.array([i for i in order if part[i] == 0 or len(order) < 20], int)
    check = np.array([i for i in order if part[i] == 1 or len(order) < 20], int)

    def dense(index: np.ndarray) -> np.ndarray:
        out = np.zeros((len(index), 1 << spec.bits), np.float32)
        for row, i in enumerate(index):
            out[row, keys[i]] = shares[i]
        return out

    rng = np.random.default_rng(spec.seed)
    scale = 30.0  # a mean of many n-grams is short; a fixed factor keeps the steps of the two maps alike
    embed = (rng.standard_normal((1 << spec.bits, spec.width)) / spec.width).astype(np.float32)
    head = np.zeros((spec.width, len(langs)), np.float32)
    bias = np.zeros(len(langs), np.float32)
    steps, done = spec.epochs * max(1, -(-len(train) // spec.batch)), 0
    for _ in range(spec.epochs):
        shuffled = rng.permutation(train)
        for start in range(0, len(shuffled), spec.batch):
            index = shuffled[start : start + spec.batch]
            rate = spec.rate * (1 - done / steps)
            x = dense(index) * scale
            hidden = x @ embed
            slope = _softmax(hidden @ head + bias)
            slope[np.arange(len(index)), target[index]] -= 1
            slope /= len(index)
            back = slope @ head.T
            head -= rate * (hidden.T @ slope)
            bias -= rate * slope.sum(axis=0)
            embed -= rate * (x.T @ back)
            done += 1
    scores = np.vstack([embed @ head * scale, np.zeros((1, len(langs)), np.float32)]).astype(np.float32)
    logits = np.vstack([dense(check[i : i + 64]) @ scores[:-1] for i in range(0, len(check), 64)] or [np.zeros((0, len(langs)))]) + bias
    temperature, least = _calibrated(logits, target[check], spec)
    return LangModel(langs, scores, bias, temperature, least, spec)


def _calibrated(logits: np.ndarray, target: np.ndarray, spec: LangSpec) -> tuple[float, float]:
    """Temperature of least log loss, and the least confidence that keeps errors in bounds."""
    if not len(target):
        return 1.0, spec.even
    at = np.arange(len(target))
    loss = {t: -np.log(_softmax(logits / t)[at, target] + 1e-12).mean() for t in np.geomspace(0.25, 16, 49)}
    temperature = float(min(loss, key=loss.get))
    chance = _softmax(logits / temperature)
    best = chance.max(axis=1)
    wrong = chance.argmax(axis=1) != target
    order = np.argsort(-best, kind="stable")
    bad = np.cumsum(wrong[order]) / np.arange(1, len(order) + 1)
    ok = np.nonzero(bad <= spec.error)[0]
    least = float(best[order[ok[-1]]]) if len(ok) else 1.0
    if len(ok) == len(order):
        least = 0.0  # nothing to refuse but less than an even chance
    return temperature, max(least, spec.even)


def _judge(model: LangModel, texts: pa.Array, known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Language, confidence and rejection of each text."""
    raw, at = packed(texts)
    total = np.zeros((len(at) - 1, len(model.langs)))
    number = np.zeros(len(at) - 1)
    orders = model.spec.orders
    for a, b in blocks(at):
        offsets, data = at[a : b + 1] - at[a], raw[at[a] : at[b]]
        for n, bucket in zip(sorted(orders), gram_buckets(data, offsets[1:], orders, model.spec.bits)):
            total[a:b] += sums_by_document(model.scores[bucket], offsets)
            number[a:b] += np.maximum(np.diff(offsets) - n + 1, 0)
    chance = _softmax((total / np.maximum(number, 1)[:, None] + model.bias) / model.temperature)
    named = np.where(known, np.array(model.langs, object)[chance.argmax(axis=1)], UNKNOWN)
    score = np.where(known, chance.max(axis=1), 0.0)
    return named, score, ~known | (score < model.least)


def _predict(model: LangModel):
    def fn(batches):
        for batch in batches:
            known = batch.column("known").to_numpy(zero_copy_only=False).astype(bool)
            named, score, rejected = _judge(model, batch.column("text"), known)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(named, pa.string()), pa.array(score),
                 pa.array(rejected)], ["doc_id", "held_out", "lang_pred", "score", "rejected"])
    return fn


def _keep(model: LangModel):
    def fn(batches):
        for batch in batches:
            known = batch.column("known").to_numpy(zero_copy_only=False).astype(bool)
            rejected = _judge(model, batch.column("row").field("text"), known)[2]
            yield pa.RecordBatch.from_arrays([batch.column("row").filter(pa.array(~rejected))], ["row"])
    return fn


def predict(docs: DataFrame, model: LangModel | None, modulus: int = 4, remainder: int = 2) -> DataFrame:
    """doc_id, held_out, lang_pred, score and rejected of every row of ``docs``.

    A null text, an empty one and one without a letter is ``und`` with score 0
    and rejected; without a model every row is. Every other row gets a learned
    language, and is rejected when its calibrated confidence is below the
    model's bound. A text too short for any n-gram is judged by the bias alone.
    Repeated rows repeat; a null doc_id is kept. Only doc_id and text are read.
    """
    rows = docs.select("doc_id", "text", held_out(modulus, remainder).alias("held_out"), _has_letter().alias("known"))
    if model is None:
        return rows.select("doc_id", "held_out", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"),
                           F.lit(True).alias("rejected"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return in_arrow(rows, _predict(model), f"doc_id {kind}, held_out boolean, lang_pred string, score double, rejected boolean")


def language_of(docs: DataFrame, spec: LangSpec = LangSpec(), modulus: int = 4, remainder: int = 2) -> DataFrame:
    """Fit on the rows of ``docs`` that are not held out, predict all of them."""
    return predict(docs, fit(docs.where(~held_out(modulus, remainder)), spec), modulus, remainder)


def known_language(docs: DataFrame, spec: LangSpec = LangSpec()) -> DataFrame:
    """The rows of ``docs`` whose language is not rejected, with all their columns; no shuffle.

    Rows with a null text or without a letter are rejected. Where no row is labelled
    there is nothing to judge by, and all rows stay.
    """
    model = fit(docs.where(~held_out(4, 2)), spec)
    if model is None:
        return docs
    rows = docs.select(F.struct("*").alias("row"), _has_letter().alias("known"))
    schema = StructType([StructField("row", docs.schema)])
    return in_arrow(rows, _keep(model), schema).select("row.*")
