"""Activity report and source coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from workledger.operators.accounting import costs_of, select_costs
from workledger.schema import MONEY

TOKENS = ("input_tokens", "output_tokens", "cached_input_tokens", "cache_write_tokens", "reasoning_tokens")


def by_kind(events: DataFrame) -> DataFrame:
    return events.groupBy("kind").agg(F.count("*").alias("n_events"))


def totals(events: DataFrame) -> DataFrame:
    return events.agg(
        F.count("*").alias("n_events"), F.min("occurred_at").alias("first_at"), F.max("occurred_at").alias("last_at")
    )


def by_adapter(events: DataFrame) -> DataFrame:
    """Events and time span of each adapter, with money and tokens of the costs that count."""
    span = events.groupBy("adapter").agg(
        F.count("*").alias("n_events"),
        F.min("occurred_at").alias("first_at"),
        F.max("occurred_at").alias("last_at"),
    )
    sums = (
        select_costs(costs_of(events))
        .groupBy("adapter")
        .agg(F.sum("amount_usd").alias("selected_usd"), *(F.sum(F.coalesce(t, F.lit(0))).alias(t) for t in TOKENS))
    )
    joined = span.join(sums, "adapter", "left")
    return joined.withColumns(
        {"selected_usd": F.coalesce("selected_usd", F.lit(0).cast(MONEY))} | {t: F.coalesce(t, F.lit(0)) for t in TOKENS}
    )


def coverage_gaps(events: DataFrame) -> DataFrame:
    """How often each field of each kind is not recovered, by adapter and status."""
    fields = events.select("adapter", "kind", F.explode("coverage").alias("field", "status"))
    return (
        fields.where("status <> 'recovered'")
        .groupBy("adapter", F.concat_ws(".", "kind", "field").alias("field"), "status")
        .agg(F.count("*").alias("n"))
    )


def latest_runs(runs: DataFrame) -> DataFrame:
    """Each adapter's last run by sequence: its coverage."""
    best = runs.groupBy(F.col("adapter").alias("latest_key")).agg(F.max_by(F.struct("*"), F.struct("sequence")).alias("latest_row"))
    return best.select("latest_row.*")


def freshness(runs: DataFrame) -> DataFrame:
    """``adapter, state``: current when the last run is ok and left nothing out, else unknown."""
    ok = (F.col("status") == "ok") & (F.col("sources_failed") == 0) & (F.col("sources_outside_window") == 0)
    return latest_runs(runs).select("adapter", F.when(ok, "current").otherwise("unknown").alias("state"))
