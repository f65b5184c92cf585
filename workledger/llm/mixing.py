"""Temperature mixing of sources: target weights from token shares, realised as block permutations.

Shares p become weights proportional to ``p ** exponent``. The exponent (1: as is, 0: all alike) is found by
bisection: the largest at which the entropy reaches its target, or else the smallest at which no source is
repeated more often than allowed. Only one row a source meets in the driver.

Weights are realised without a global sort of documents. Every source is dealt by hash into blocks of about
``block_tokens`` tokens, so a large source has many blocks; blocks are permuted by hash, whole passes repeat
them, and a last, partial pass takes blocks in permuted order until the budget is met. Only the block in
which the budget ends is cut, document by document, within itself. What lies before a block is a running sum over
range partitions, so no source's blocks meet in one task.

A use's ``place`` is the share of its source's budget that was used before it. Every source is spread over [0, 1) in
proportion to its weight, so the order of places is one mixture: any stretch of it holds about the target shares.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from workledger.llm.common import skew_join, written
from workledger.llm.prefix import products


@dataclass(frozen=True)
class MixConfig:
    """``budget`` tokens in all (null: as many as the input has). ``entropy_share`` is the target entropy as a
    share of that of equal weights; ``max_repeats`` limits how often a source may be passed over. A block has about
    ``block_tokens`` tokens and ``block_rows`` rows at most.
    """

    budget: int | None = None
    entropy_share: float | None = None
    max_repeats: float | None = 2.0
    block_tokens: int = 200_000
    block_rows: int = 20_000
    seed: int = 5
    steps: int = 80


def word_tokens(text: str = "text") -> Column:
    """Words of a text as its token count: spaces outside count for nothing, null has none."""
    trimmed = F.regexp_replace(F.coalesce(F.col(text).cast("string"), F.lit("")), r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")
    return F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, r"[\x20\x09-\x0D]+"))).cast("long")


def weights_at(shares: dict, exponent: float) -> dict:
    powers = {s: p**exponent for s, p in shares.items() if p > 0}
    total = sum(powers.values())
    return {s: v / total for s, v in powers.items()}


def entropy(weights: dict) -> float:
    return -sum(w * math.log(w) for w in weights.values() if w > 0)


def solve_exponent(tokens: dict, config: MixConfig) -> float:
    """The exponent for token totals by source; sources without tokens take no part."""
    have = {s: t for s, t in tokens.items() if t > 0}
    if len(have) < 2:
        return 1.0
    total = sum(have.values())
    shares = {s: t / total for s, t in have.items()}
    budget = config.budget if config.budget is not None else total
    if config.entropy_share is not None:
        target = config.entropy_share * math.log(len(have))
        reached = lambda e: entropy(weights_at(shares, e)) >= target
        if reached(1.0):
            return 1.0
        low, high = 0.0, 1.0  # entropy falls as the exponent rises
        for _ in range(config.steps):
            middle = (low + high) / 2
            low, high = (middle, high) if reached(middle) else (low, middle)
        return low
    if config.max_repeats is None:
        return 0.0
    within = lambda e: all(
        w * budget <= config.max_repeats * have[s] * (1 + 1e-12) for s, w in weights_at(shares, e).items()
    )
    if within(0.0):
        return 0.0
    low, high = 0.0, 1.0
    for _ in range(config.steps):
        middle = (low + high) / 2
        low, high = (low, middle) if within(middle) else (middle, high)
    return high


def source_budgets(tokens: dict, config: MixConfig) -> dict:
    """Whole tokens to take from each source."""
    have = {s: t for s, t in tokens.items() if t > 0}
    budget = config.budget if config.budget is not None else sum(have.values())
    if not have:
        return {}
    total = sum(have.values())
    weights = weights_at({s: t / total for s, t in have.items()}, solve_exponent(tokens, config))
    return {s: int(round(w * budget)) for s, w in weights.items()}


def mix(docs: DataFrame, config: MixConfig = MixConfig(), *carry: str) -> DataFrame:
    """``(doc_id, source, text)`` -> one row per use of a document: ``doc_id, source, n_tokens, pass, block,
    position, place``; in the order of ``place`` (ties by source and doc_id) the uses are the schedule. ``carry``
    names further columns of the rows to be shown with each use.

    A document is used in every whole pass, and in the last pass if it starts before the budget ends, so a
    source gets its budget to within one document. A null source is a source of its own, shown as null.
    Documents without words have no tokens: they are used in whole passes and cost nothing. Repeated rows are
    used as often as they occur. Rows without doc_id take part; they, and rows that share one, are dealt by where they
    lie in the input. No rows give no rows. Names of ``carry`` must differ from the columns made here.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        F.concat(F.when(F.col("source").isNull(), "n").otherwise("s"), F.coalesce("source", F.lit(""))).alias("key"),
        word_tokens().alias("n_tokens"),
        F.monotonically_increasing_id().alias("row"),
        *carry,
    )
    sized = written(rows, "mix-tokens")
    found = {r["key"]: r for r in sized.groupBy("key").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("n")).collect()}
    wanted = source_budgets({k: r["t"] for k, r in found.items()}, config)
    plan = []
    for k, r in found.items():
        t, w = r["t"], wanted.get(k, 0)
        blocks = max(1, -(-t // config.block_tokens), -(-r["n"] // config.block_rows))
        plan.append((k, t, w, blocks, w // t if t else 1, w % t if t else 0))
    if not plan:
        return sized.select(
            "doc_id", "source", "n_tokens", *(F.lit(0).cast("long").alias(c) for c in ("pass", "block", "position")), F.lit(0.0).alias("place"), *carry
        )
    sources = spark.createDataFrame(plan, "key string, total long, wanted long, blocks long, passes long, rest long")
    seed = F.lit(config.seed)
    dealt = skew_join(sized, sources, "key").withColumn("block", F.pmod(F.xxhash64("doc_id", "row", seed), F.col("blocks")))
    blocks = dealt.groupBy("key", "block").agg(F.sum("n_tokens").alias("tokens")).withColumn("drawn", F.xxhash64("block", "key", seed))
    ranked = products(blocks, "mix-blocks", "key", ["drawn", "block"], ["tokens"], [None]).select(
        F.concat_ws(":", "block", "key").alias("kb"), F.col("n").alias("position"), (F.col("sum_tokens") - F.col("tokens")).alias("before"), "tokens"
    )
    # a block is bounded, so its documents may be ordered in one task
    within = Window.partitionBy("kb").orderBy(F.xxhash64("doc_id", "row", F.lit(config.seed + 1)), "row")
    placed = written(
        skew_join(dealt.withColumn("kb", F.concat_ws(":", "block", "key")), ranked, "kb").withColumn(
            "ahead", F.col("before") + F.coalesce(F.sum("n_tokens").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        ),
        "mix-placed",
    )
    whole = placed.where("passes > 0").withColumn("pass", F.explode(F.sequence(F.lit(1).cast("long"), F.col("passes"))))
    last = placed.where("rest > ahead").withColumn("pass", F.col("passes") + 1)
    share = ((F.col("pass") - 1) * F.col("total") + F.col("ahead")) / F.greatest("wanted", F.lit(1))
    # without tokens there is no budget to be a share of
    place = F.when(F.col("total") > 0, share).otherwise(F.pmod(F.xxhash64("row", seed), F.lit(1 << 30)) / F.lit(1 << 30)).cast("double")
    return whole.union(last.select(*whole.columns)).select("doc_id", "source", "n_tokens", "pass", "block", "position", place.alias("place"), *carry)
