"""Quality rules: fixed base rules, then an isolation forest on rule statistics calibrated from labels."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from workledger.llm.common import mix64, python_batches, text_bytes, word_hashes, written


@dataclass(frozen=True)
class QualityConfig:
    """``sample_rows`` bounds the labelled rows that trees are drawn from (in expectation, chosen by hash).

    Bad documents resemble one another, so trees are small: a tree of many rows holds a cluster of them, which
    takes as many splits to isolate as good rows do. A rejected good document weighs ``reject_cost`` times a kept bad one when the threshold is set.
    """

    sample_rows: int = 8192
    trees: int = 400
    tree_rows: int = 16
    seed: int = 17
    bins: int = 2000
    reject_cost: float = 3.0


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_marks")
_SYMBOLS = b"#*$%&|<>"
_MARKS = bytes(c for c in range(33, 127) if not chr(c).isalnum())


def statistics(text: bytes) -> tuple[int, ...]:
    """The counts of ``COUNTS`` of one whole text."""
    words = text.split()
    n = len(words)
    if not n:
        return (0,) * len(COUNTS)
    spaces = len(text) - sum(map(len, words))
    points = len(text.decode("utf-8", "replace")) - spaces
    symbols = len(text) - len(text.translate(None, _SYMBOLS))
    marks = len(text) - len(text.translate(None, _MARKS))
    seen: set[bytes] = set()
    lines = repeated = 0
    for line in text.split(b"\n"):
        if line and not line.isspace():
            lines += 1
            repeated += line in seen
            seen.add(line)
    covered = 0
    if n >= 3:
        h = word_hashes(words)
        k = np.uint64(0x9E3779B97F4A7C15)
        grams = mix64(mix64(h[:-2] * k + h[1:-1]) * k + h[2:])
        _, inverse, times = np.unique(grams, return_inverse=True, return_counts=True)
        twice = times[inverse] > 1
        if twice.any():
            mark = np.zeros(n, bool)
            for i in range(3):
                mark[i : n - 2 + i] |= twice
            covered = int(mark.sum())
    return n, points, symbols, repeated, covered, lines, marks


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [statistics(v.as_py()) for v in batch.column(1)]
        columns = list(zip(*rows, strict=True)) or [[] for _ in COUNTS]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array(c, pa.int64()) for c in columns)], names=["doc_id", *COUNTS]
        )


def rule_statistics(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the counts of every whole text, and whether the base rules fail."""
    python_batches(docs.sparkSession)
    counted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("body")).mapInArrow(
        _count, "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS)
    )
    return counted.withColumn("base_failed", F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words"))


#: What the forest sees: shares, so that long and short documents compare.
SHARES = (
    "1.0 * n_symbols / greatest(word_chars, 1)",
    "1.0 * n_marks / greatest(word_chars, 1)",
    "1.0 * n_dup_lines / greatest(n_lines, 1)",
    "1.0 * n_repeat_words / greatest(n_words, 1)",
    "1.0 * word_chars / greatest(n_words, 1)",
)


class IsolationForest:
    """Trees of random axis splits as flat arrays; ``depths`` gives mean path lengths."""

    def __init__(self, rows: np.ndarray, config: QualityConfig):
        draw = np.random.default_rng(config.seed)
        size = min(config.tree_rows, len(rows))
        self.limit = max(1, int(np.ceil(np.log2(max(size, 2)))))
        self.nodes = (1 << (self.limit + 1)) - 1
        shape = (config.trees, self.nodes)
        self.axis = np.full(shape, -1, np.int16)
        self.cut = np.zeros(shape)
        self.extra = np.zeros(shape)
        self.norm = self.usual(size)
        for t in range(config.trees):
            pick = rows[draw.choice(len(rows), size, replace=False)]
            self._grow(t, 0, 0, pick, draw)

    @staticmethod
    def usual(n: int) -> float:
        """Mean path length of an unsuccessful search among n rows."""
        return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n

    def _grow(self, t: int, node: int, depth: int, rows: np.ndarray, draw: np.random.Generator) -> None:
        low, high = (rows.min(0), rows.max(0)) if len(rows) else (np.zeros(1), np.zeros(1))
        axes = np.flatnonzero(high > low)
        if depth == self.limit or len(rows) < 2 or not len(axes):
            self.extra[t, node] = depth + self.usual(len(rows))
            return
        axis = int(draw.choice(axes))
        cut = draw.uniform(low[axis], high[axis])
        left = rows[:, axis] < cut
        self.axis[t, node], self.cut[t, node] = axis, cut
        self._grow(t, 2 * node + 1, depth + 1, rows[left], draw)
        self._grow(t, 2 * node + 2, depth + 1, rows[~left], draw)

    def anomaly(self, rows: np.ndarray) -> np.ndarray:
        """2 ** (-mean path / usual path): near 1 for rows that few splits isolate."""
        total = np.zeros(len(rows))
        every = np.arange(len(rows))
        for t in range(len(self.axis)):
            at = np.zeros(len(rows), np.int64)
            for _ in range(self.limit):
                axis = self.axis[t, at]
                inner = axis >= 0
                right = rows[every, np.maximum(axis, 0)] >= self.cut[t, at]
                at = np.where(inner, 2 * at + 1 + right, at)
            total += self.extra[t, at]
        return 2.0 ** (-total / len(self.axis) / max(self.norm, 1e-9))


def _threshold(histogram: list, config: QualityConfig) -> float:
    """The score above which rejecting costs least on labelled rows; 1 (reject none) without labels."""
    good, bad = np.zeros(config.bins + 1), np.zeros(config.bins + 1)
    for r in histogram:
        (good if r["quality"] else bad)[r["bin"]] += r["n"]
    if not bad.sum() or not good.sum():
        return 1.0
    # rejecting bins >= k
    lost = good[::-1].cumsum()[::-1] * config.reject_cost
    left = bad.cumsum() - bad
    cost = np.append(lost + left, bad.sum())
    best = np.flatnonzero(cost == cost.min())
    middle = (best[0] + best[-1]) / 2
    return float(middle / config.bins)


def quality(docs: DataFrame, labels: DataFrame, config: QualityConfig = QualityConfig()) -> DataFrame:
    """``doc_id``, the counts, ``base_failed, anomaly, kept``, one row per input row.

    A null or empty text has zero counts and fails the base rules. The forest is drawn from labelled rows that
    pass them; equal anomalies get equal verdicts. Labels that are null, or whose document is missing, are not used; without labels of both kinds the
    forest rejects nothing. Repeated rows repeat; no rows give no rows.
    """
    stats = written(rule_statistics(docs), "statistics")
    shares = [F.expr(s).cast("double").alias(f"x{i}") for i, s in enumerate(SHARES)]
    known = (
        labels.where("doc_id is not null and quality is not null")
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"))
    )
    passing = stats.where("not base_failed").join(known.select("doc_id"), "doc_id", "left_semi")
    total = passing.count()
    share = min(1.0, config.sample_rows / max(total, 1))
    sample = passing.where(
        F.pmod(F.xxhash64("doc_id", *COUNTS), F.lit(1 << 30)) < int(share * (1 << 30))
    ).select(*shares)
    rows = np.array([tuple(r) for r in sample.collect()], float).reshape(-1, len(SHARES))
    rows = rows[np.lexsort(rows.T)]
    if len(rows) < 2:
        return stats.select("doc_id", *COUNTS, "base_failed", F.lit(0.0).alias("anomaly"), (~F.col("base_failed")).alias("kept"))
    forest = IsolationForest(rows, config)

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.column_stack([batch.column(f"x{i}").to_numpy(zero_copy_only=False) for i in range(len(SHARES))])
            kept = [batch.column(c) for c in ("doc_id", *COUNTS, "base_failed")]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(forest.anomaly(x), pa.float64())], names=["doc_id", *COUNTS, "base_failed", "anomaly"]
            )

    rated = written(
        stats.select("doc_id", *COUNTS, "base_failed", *shares).mapInArrow(
            rate, "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, anomaly double"
        ),
        "rated",
    )
    histogram = (
        rated.where("not base_failed")
        .join(known, "doc_id")
        .groupBy(F.floor(F.col("anomaly") * config.bins).cast("int").alias("bin"), "quality")
        .agg(F.count("*").alias("n"))
        .collect()
    )
    limit = _threshold(histogram, config)
    return rated.withColumn("kept", ~F.col("base_failed") & (F.col("anomaly") < F.lit(limit)))
