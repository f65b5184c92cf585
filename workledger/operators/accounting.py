"""Which cost observations count: exact-key de-duplication by declared precedence.

A group's winner is a minimum over a struct of ranks, which combines before the shuffle; a key that a third
of all observations carry costs no more than others. The losers are found by comparing each observation with
its group's winner only where they are asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from workledger.functions.ids import NUL
from workledger.schema import AUTHORITIES, COST_BASIS, COST_KIND, KEY_SCOPE, MONEY, PRECEDENCE

COST_COLUMNS = (
    "event_id", "adapter", "native_id", "occurred_at", "session_id", "parent_event_id", "amount_usd", "basis", "kind",
    "accuracy", "authority", "accounting_key", "accounting_key_scope", "observation_role",
)


def costs_of(events: DataFrame) -> DataFrame:
    """Cost observations of an events table, flat."""
    head = ["event_id", "adapter", "native_id", "occurred_at", "session_id", "parent_event_id"]
    return events.where(F.col("kind") == "cost").select(*head, "cost.*")


def _rank(pairs: tuple, *columns: Column) -> Column:
    out = F.lit(len(pairs))
    for i, value in reversed(list(enumerate(pairs))):
        values = value if isinstance(value, tuple) else (value,)
        match = F.lit(True)
        for c, v in zip(columns, values, strict=True):
            match = match & (c == v)
        out = F.when(match, i).otherwise(out)
    return out


def countable(costs: DataFrame) -> DataFrame:
    """Priced observations that are no rollups, with their group and their rank in it."""
    authority = F.coalesce("authority", "adapter")
    group = (
        F.when((F.col("accounting_key_scope") == "shared") & F.col("accounting_key").isNotNull(), F.concat_ws(NUL, F.lit("shared"), "accounting_key"))
        .when((F.col("accounting_key_scope") == "source") & F.col("accounting_key").isNotNull(), F.concat_ws(NUL, F.lit("source"), "adapter", "accounting_key"))
        .otherwise(F.concat_ws(NUL, F.lit("event"), "event_id"))
    )
    return (
        costs.where("observation_role <> 'rollup' and amount_usd is not null")
        .withColumn("amount_usd", F.col("amount_usd").cast(MONEY))
        .withColumn("group_key", group)
        .withColumn(
            "rank",
            F.struct(
                _rank(PRECEDENCE, F.col("basis"), F.col("accuracy")).alias("provenance"),
                _rank(AUTHORITIES, authority).alias("authority_rank"),
                authority.alias("authority_text"),
                F.col("event_id"),
            ),
        )
    )


def select_costs(costs: DataFrame) -> DataFrame:
    """The observation of each (group, economic kind) that counts, with the size of its group."""
    rows = countable(costs)
    kept = [c for c in rows.columns if c not in ("group_key", "kind", "rank")]
    return (
        rows.groupBy("group_key", "kind")
        .agg(
            F.min_by(F.struct(*kept), "rank").alias("w"),
            F.count("*").alias("observations"),
            F.sum("amount_usd").alias("raw_usd"),
        )
        .select("group_key", "kind", "w.*", "observations", "raw_usd")
    )


def suppressed(costs: DataFrame) -> DataFrame:
    """Observations that lose to another of their group: ``group_key, kind, event_id, winner_id, place``."""
    rows = countable(costs).select("group_key", "kind", "rank")
    best = rows.groupBy("group_key", "kind").agg(F.min("rank").alias("best"), F.count("*").alias("n")).where("n > 1")
    return (
        rows.join(best, ["group_key", "kind"])
        .where(F.col("rank") != F.col("best"))
        .select("group_key", "kind", F.col("rank.event_id").alias("event_id"), F.col("best.event_id").alias("winner_id"))
    )


def decisions(costs: DataFrame) -> DataFrame:
    """One row per group with losers: winner, its provenance, and how much was suppressed."""
    return select_costs(costs).where("observations > 1").select(
        "group_key", "kind", F.col("event_id").alias("winner_id"), "adapter", "basis", "accuracy", "amount_usd",
        (F.col("observations") - 1).alias("n_suppressed"), (F.col("raw_usd") - F.col("amount_usd")).alias("suppressed_usd"),
    )


def _totals(costs: DataFrame, by: str, values: tuple[str, ...]) -> DataFrame:
    raw = countable(costs).groupBy(by).agg(F.sum("amount_usd").alias("raw_usd"), F.count("*").alias("n_priced"))
    chosen = select_costs(costs).groupBy(by).agg(F.sum("amount_usd").alias("selected_usd"), F.count("*").alias("n_selected"))
    every = costs.sparkSession.createDataFrame([(v,) for v in values], f"{by} string")
    zero = F.lit(0).cast(MONEY)
    return (
        F.broadcast(every)
        .join(raw, by, "left")
        .join(chosen, by, "left")
        .select(
            by,
            F.coalesce("raw_usd", zero).alias("raw_usd"),
            F.coalesce("selected_usd", zero).alias("selected_usd"),
            (F.coalesce("raw_usd", zero) - F.coalesce("selected_usd", zero)).alias("suppressed_usd"),
            F.coalesce("n_priced", F.lit(0)).alias("n_priced"),
            F.coalesce("n_selected", F.lit(0)).alias("n_selected"),
        )
    )


def by_kind(costs: DataFrame) -> DataFrame:
    """Raw, selected and suppressed money of every economic kind, also of those without observations."""
    return _totals(costs, "kind", COST_KIND)


def by_basis(costs: DataFrame) -> DataFrame:
    return _totals(costs, "basis", COST_BASIS)


def key_coverage(costs: DataFrame) -> DataFrame:
    """Observations, rollups, priced and keyed ones by scope of the accounting key."""
    every = costs.sparkSession.createDataFrame([(s,) for s in KEY_SCOPE], "accounting_key_scope string")
    counts = costs.groupBy("accounting_key_scope").agg(
        F.count("*").alias("n_observations"),
        F.count_if(F.col("observation_role") == "rollup").alias("n_rollups"),
        F.count("amount_usd").alias("n_priced"),
        F.count("accounting_key").alias("n_keyed"),
    )
    joined = F.broadcast(every).join(counts, "accounting_key_scope", "left")
    return joined.na.fill(0)
