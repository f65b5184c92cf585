"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are presences of words, of word beginnings (4 to 6 bytes, so that inflected forms share a weight),
of adjacent pairs and of pairs with one word between, hashed into ``2 ** bits`` coordinates. A bounded,
hash-chosen sample of the labelled rows is learned by FTRL-proximal, with a rate of its own for every
coordinate; L1 leaves few weights. With several ``shards`` each learns a part, and a grouped sum averages
them; one shard, the default, finds rare words better and is bounded by the sample. What is broadcast has at
most ``2 ** bits`` entries however large the corpus is, and is in practice a few hundred.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from workledger.llm.common import WordHashes, mix64, python_batches, text_bytes


@dataclass(frozen=True)
class ToxicityConfig:
    """``sample_rows`` bounds the labelled rows that are learned from (in expectation, chosen by hash)."""

    bits: int = 20
    sample_rows: int = 20_000
    shards: int = 1
    epochs: int = 3
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 4.0
    l2: float = 0.0
    threshold: float = 0.5


# A-Z to a-z; other ASCII that is no letter becomes a space.
_FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32
    for c in range(256)
)
_WORDS = WordHashes()
_STARTS = [WordHashes() for _ in range(3)]


def features(text: bytes, bits: int) -> np.ndarray:
    """Sorted distinct feature coordinates of a text."""
    words = text.translate(_FOLD).split()
    n = len(words)
    if not n:
        return np.empty(0, np.int64)
    h = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, n)
    parts = [h]
    for k, table in zip((4, 5, 6), _STARTS, strict=True):
        starts = [w[:k] for w in words if len(w) > k]
        parts.append(np.fromiter(map(table.__getitem__, starts), np.uint64, len(starts)) + np.uint64(k))
    for gap in (1, 2):
        if n > gap:
            parts.append(mix64(h[:-gap] * np.uint64(0x9E3779B97F4A7C15) + h[gap:] + np.uint64(100 + gap)))
    return np.unique(mix64(np.concatenate(parts)) >> np.uint64(64 - bits)).astype(np.int64)


def ftrl(rows: list[np.ndarray], labels: np.ndarray, config: ToxicityConfig) -> np.ndarray:
    """Weights after ``epochs`` passes; the last entry is the intercept, which L1 does not touch."""
    size = (1 << config.bits) + 1
    z, n = np.zeros(size), np.zeros(size)
    bias = np.array([size - 1])

    def weights(at: np.ndarray) -> np.ndarray:
        za, l1 = z[at], np.where(at == size - 1, 0.0, config.l1)
        shrunk = np.sign(za) * np.maximum(np.abs(za) - l1, 0.0)
        return -shrunk / ((config.beta + np.sqrt(n[at])) / config.alpha + config.l2)

    for _ in range(config.epochs):
        for row, y in zip(rows, labels, strict=True):
            at = np.concatenate([row, bias])
            w = weights(at)
            g = 1.0 / (1.0 + np.exp(-np.clip(w.sum(), -35, 35))) - y
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / config.alpha
            z[at] += g - sigma * w
            n[at] += g * g
    return weights(np.arange(size))


def held_out(doc_id: str = "doc_id") -> Column:
    """True for rows whose labels are never learned."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0


def _learnable(docs: DataFrame, labels: DataFrame, config: ToxicityConfig) -> DataFrame | None:
    """``doc_id, body, toxic`` of the sample that may be learned from; none without any label."""
    usable = (
        labels.where("doc_id is not null and toxic is not null")
        .where(~held_out())
        .groupBy(F.col("doc_id").alias("label_id"))
        .agg(F.max("toxic").alias("toxic"))
    )
    total = usable.count()
    if not total:
        return None
    share = min(1.0, config.sample_rows / total)
    sample = usable.where(F.pmod(F.xxhash64("label_id", F.lit(7)), F.lit(1 << 30)) < int(share * (1 << 30)))
    rows = docs.select("doc_id", text_bytes().alias("body"))
    return rows.join(F.broadcast(sample), F.col("doc_id") == F.col("label_id")).select("doc_id", "body", "toxic")


def cross_validated(docs: DataFrame, labels: DataFrame, config: ToxicityConfig = ToxicityConfig(), choices: tuple[float, ...] = (1.0, 2.0, 4.0, 8.0), folds: int = 4) -> DataFrame:
    """``l1, rows, log_loss, toxic, found, wrong`` for each L1 of ``choices``, over rows that may be learned from only.

    The sample is dealt into ``folds`` by hash; each is scored by what the others teach. ``found`` and ``wrong`` count
    rows scored at the threshold or above that are labelled toxic, and that are not. No held-out label is looked at.
    """
    chosen = _learnable(docs, labels, config)
    if chosen is None:
        return docs.sparkSession.createDataFrame([], "l1 double, rows long, log_loss double, toxic long, found long, wrong long")

    def fold(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        l1, number = key
        frame = frame.sort_values(["order", "body"])
        rows = [features(body, config.bits) for body in frame["body"]]
        y, test = frame["toxic"].to_numpy(float), frame["fold"].to_numpy() == number
        w = ftrl([r for r, t in zip(rows, test, strict=True) if not t], y[~test], replace(config, l1=l1))
        p = np.array([1 / (1 + np.exp(-np.clip(w[r].sum() + w[-1], -35, 35))) for r, t in zip(rows, test, strict=True) if t])
        y, found = y[test], p >= config.threshold
        loss = -np.log(np.maximum(np.where(y > 0, p, 1 - p), 1e-15)).sum()
        return pd.DataFrame({"l1": [l1], "n": [len(y)], "loss": [loss], "toxic": [int(y.sum())], "found": [int((found & (y > 0)).sum())], "wrong": [int((found & (y == 0)).sum())]})

    dealt = chosen.select("body", "toxic", F.xxhash64("doc_id", F.lit(11)).alias("order"), F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(folds)).alias("fold"))
    tasks = dealt.withColumn("l1", F.explode(F.array(*map(F.lit, choices)))).withColumn("task", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))
    done = tasks.groupBy("l1", "task").applyInPandas(fold, "l1 double, n long, loss double, toxic long, found long, wrong long")
    return done.groupBy("l1").agg(F.sum("n").alias("rows"), (F.sum("loss") / F.sum("n")).alias("log_loss"), *(F.sum(c).alias(c) for c in ("toxic", "found", "wrong")))


def learn(docs: DataFrame, labels: DataFrame, config: ToxicityConfig = ToxicityConfig()) -> dict[int, float]:
    """``(doc_id, text)`` and ``(doc_id, toxic)`` -> non-zero weights by coordinate (``2 ** bits``: intercept).

    Rows without id or label are not learned from; of repeated labels the larger counts. Without any row to
    learn from there are no weights, and every score is 0.5.
    """
    chosen = _learnable(docs, labels, config)
    if chosen is None:
        return {}

    def shard(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["order", "body"])  # rows may share a doc_id, and so their order
        rows = [features(body, config.bits) for body in frame["body"]]
        w = ftrl(rows, frame["toxic"].to_numpy(float), config)
        at = np.flatnonzero(w)
        return pd.DataFrame({"coordinate": at, "weight": w[at]})

    parts = chosen.select(
        "body",
        "toxic",
        F.xxhash64("doc_id", F.lit(11)).alias("order"),
        F.pmod(F.xxhash64("doc_id", F.lit(13)), F.lit(config.shards)).alias("shard"),
    )
    averaged = (
        parts.groupBy("shard")
        .applyInPandas(shard, "coordinate long, weight double")
        .groupBy("coordinate")
        .agg((F.sum("weight") / F.lit(config.shards)).alias("weight"))
    )
    return {r["coordinate"]: r["weight"] for r in averaged.collect()}


def score(docs: DataFrame, weights: dict[int, float], config: ToxicityConfig = ToxicityConfig()) -> DataFrame:
    """``docs`` columns doc_id and text -> ``doc_id, score``: a probability for every row, empty texts too."""
    size = 1 << config.bits
    at = np.fromiter(weights, np.int64, len(weights))
    values = np.fromiter(weights.values(), np.float64, len(weights))
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = np.zeros(size + 1)
        dense[at] = values
        for batch in batches:
            sums = [dense[features(v.as_py(), config.bits)].sum() + dense[size] for v in batch.column(1)]
            p = 1.0 / (1.0 + np.exp(-np.clip(np.asarray(sums, float), -35, 35)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p, pa.float64())], schema=schema)

    python_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), text_bytes().alias("body")).mapInArrow(
        run, "doc_id long, score double"
    )


def toxicity(docs: DataFrame, labels: DataFrame, config: ToxicityConfig = ToxicityConfig()) -> DataFrame:
    """``doc_id, held_out, score, predicted``, one row per input row.

    A null or empty text scores as the intercept alone. Rows without doc_id are scored and count as not held
    out. Repeated rows repeat; no rows give no rows. Only ``text`` is an input of the score.
    """
    scored = score(docs, learn(docs, labels, config), config)
    return scored.select(
        "doc_id",
        F.coalesce(held_out(), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= config.threshold).cast("int").alias("predicted"),
    )
