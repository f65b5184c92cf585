"""What receipts of research outcomes show: coverage, raw dimensions, chains, funnel, claimability.

Chains need no walk: valid ones are strictly increasing in time, so their order is the order of time within a
connected component of the predecessor links.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from workledger.functions.coerce import raw_bucket, ratio
from workledger.operators.graph import components
from workledger.schema import MONEY
from workledger.shared import written

GAPS = ("outside_window", "missing_target", "cross_domain", "non_increasing_timestamp", "fork", "cycle")
DIMENSIONS = (
    "workload", "treatment_namespace", "manifest_sha256", "authority_namespace", "domain_namespace",
    "domain_object_type", "outcome_kind", "judgment", "error_kind",
)
REASONS = ("below_join_threshold", "ambiguous_or_invalid_followup", "no_standardized_admissions", "insufficient_later_followup")


def percentage(a, b):
    return F.round(F.try_divide(F.col(a).cast("double") * 100, F.col(b).cast("double")), 6)


def call_coverage(receipts: DataFrame, selected_calls: DataFrame) -> DataFrame:
    """One row: slots, nulls, occurrences, distinct and repeated call ids, and how many have a selected cost.

    ``receipts``: coordinate, call_ids. ``selected_calls``: call_id, coordinate of the outcome its cost was
    attributed to (null if none).
    """
    calls = receipts.select("coordinate", F.explode("call_ids").alias("call_id"))
    slots = calls.agg(F.count("*").alias("total_call_slots"), F.count_if(F.col("call_id").isNull()).alias("null_call_ids"))
    used = calls.where("call_id is not null")
    spread = used.groupBy("call_id").agg(F.countDistinct("coordinate").alias("k"), F.count("*").alias("n"))
    per_call = spread.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("non_null_call_id_occurrences"),
        F.count("*").alias("distinct_call_ids"),
        F.count_if(F.col("k") > 1).alias("duplicate_call_ids_across_receipts"),
        F.coalesce(F.sum(F.when(F.col("k") > 1, F.col("k"))), F.lit(0)).alias("duplicate_call_id_occurrences"),
    )
    held = selected_calls.groupBy("call_id").agg(F.collect_set("coordinate").alias("to"))
    joined = used.join(held, "call_id", "left").agg(
        F.count_if(F.array_contains("to", F.col("coordinate"))).alias("joined_occurrences"),
        F.count_if(F.col("to").isNull()).alias("occurrences_without_cost"),
        F.countDistinct(F.when(F.col("to").isNull(), F.col("call_id"))).alias("distinct_without_cost"),
    )
    one = slots.join(F.broadcast(per_call)).join(F.broadcast(joined))
    return one.withColumn("exact_join_percentage", percentage("joined_occurrences", "non_null_call_id_occurrences"))


def window_allocation(attributed: DataFrame) -> DataFrame:
    """Observations and money by state with their percentages."""
    total = attributed.agg(F.count("*").alias("all_n"), F.sum("amount_usd").alias("all_usd"))
    by = attributed.groupBy("state").agg(F.count("*").alias("n"), F.sum("amount_usd").alias("amount_usd"))
    every = attributed.sparkSession.createDataFrame([("attributed",), ("ambiguous",), ("unallocated",)], "state string")
    joined = F.broadcast(every).join(by, "state", "left").join(F.broadcast(total))
    joined = joined.withColumns({"n": F.coalesce("n", F.lit(0)), "amount_usd": F.coalesce("amount_usd", F.lit(0).cast(MONEY))})
    return joined.select("state", "n", "amount_usd", percentage("n", "all_n").alias("n_percentage"), percentage("amount_usd", "all_usd").alias("amount_percentage"))


def _metrics(receipts: DataFrame, costs: DataFrame, *by: str) -> DataFrame:
    """``costs``: coordinate, n, amount_usd of what was attributed to each receipt.

    Groups are few and large, so call ids are not gathered in them: distinct ones are shuffled and counted.
    """
    rows = receipts.join(costs, "coordinate", "left")
    calls = receipts.select(*by, F.explode("call_ids").alias("__call")).where("__call is not null").distinct()
    counts = calls.groupBy(*(F.col(c).alias(f"__{c}") for c in by)).agg(F.count("*").alias("__calls"))
    metrics = rows.groupBy(*by).agg(
        F.count("*").alias("receipt_outcomes"),
        F.countDistinct("attempt").alias("distinct_attempts"),
        F.sum(F.size("call_ids")).alias("call_slots"),
        F.sum(F.size(F.array_compact("call_ids"))).alias("non_null_call_id_occurrences"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("attributed_observations"),
        F.coalesce(F.sum("amount_usd"), F.lit(0).cast(MONEY)).alias("attributed_cost_usd"),
        F.count_if(F.col("n") > 0).alias("outcomes_with_cost"),
    )
    same = reduce(and_, (F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by))
    return metrics.join(counts, same, "left").select(
        *by, "receipt_outcomes", "distinct_attempts", "call_slots", "non_null_call_id_occurrences",
        F.coalesce("__calls", F.lit(0)).alias("distinct_call_ids"),
        "attributed_observations", "attributed_cost_usd", "outcomes_with_cost",
    )


def raw_dimensions(receipts: DataFrame, costs: DataFrame) -> DataFrame:
    """Metrics and share by the nine raw columns of an outcome."""
    total = receipts.agg(F.count("*").alias("__all"))
    rows = _metrics(receipts, costs, *DIMENSIONS).join(F.broadcast(total))
    return rows.withColumn("raw_yield_percentage", percentage("receipt_outcomes", "__all")).drop("__all")


def grouped_yields(receipts: DataFrame, costs: DataFrame, *by: str) -> DataFrame:
    """Metrics of workload or treatment groups with how many outcomes fell in each bucket."""
    marked = receipts.withColumn("bucket", raw_bucket("outcome_kind", "judgment"))
    buckets = marked.groupBy(*by).pivot("bucket", ["ADMITTED", "REJECTED", "CORROBORATED", "error", "unmapped"]).count().na.fill(0)
    return _metrics(receipts, costs, *by).join(buckets, list(by))


def chain_states(receipts: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """``coordinate, component, gaps`` and ``valid`` of every selected receipt.

    ``receipts``: coordinate, predecessor, occurred_at, domain. ``known``: coordinates outside the window too.
    A component with any invalid member is invalid as a whole.
    """
    known = receipts.select("coordinate") if known is None else known.select("coordinate")
    before = receipts.select(F.col("coordinate").alias("predecessor"), F.col("occurred_at").alias("b_at"), F.col("domain").alias("b_domain"))
    elsewhere = known.select(F.col("coordinate").alias("predecessor"), F.lit(True).alias("known")).distinct()
    links = written(
        receipts.where("predecessor is not null")
        .join(before, "predecessor", "left")
        .join(elsewhere, "predecessor", "left")
        .select("coordinate", "predecessor", "occurred_at", "domain", "b_at", "b_domain", "known"),
        "links",
    )
    inside = links.where("b_at is not null")
    forks = inside.groupBy("predecessor").agg(F.count("*").alias("n")).where("n > 1").select("predecessor")
    gap = lambda cond, name: F.when(cond, F.lit(name))
    flagged = links.join(forks.withColumn("forked", F.lit(True)), "predecessor", "left").withColumn(
        "gaps",
        F.array_compact(
            F.array(
                gap(F.col("b_at").isNull() & F.col("known"), "outside_window"),
                gap(F.col("b_at").isNull() & F.col("known").isNull(), "missing_target"),
                gap(F.col("b_at").isNotNull() & ~F.col("domain").eqNullSafe(F.col("b_domain")), "cross_domain"),
                gap(F.col("b_at") >= F.col("occurred_at"), "non_increasing_timestamp"),
                gap(F.col("forked"), "fork"),
            )
        ),
    )
    parts = components(inside.select(F.col("coordinate").alias("a"), F.col("predecessor").alias("b")))
    rows = (
        receipts.select("coordinate", "occurred_at")
        .join(parts.select(F.col("node").alias("coordinate"), F.col("root").alias("component")), "coordinate", "left")
        .withColumn("component", F.coalesce("component", "coordinate"))
        .join(flagged.select("coordinate", "gaps"), "coordinate", "left")
        .withColumn("gaps", F.coalesce("gaps", F.array().cast("array<string>")))
    )
    bad = rows.groupBy("component").agg(F.bool_or(F.size("gaps") > 0).alias("__bad"))
    return rows.join(bad, "component").withColumn("valid", ~F.col("__bad")).drop("__bad")


def gap_counts(receipts: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """``gap, n``: every gap class with its count; forks count once per predecessor.

    Each receipt has one predecessor, so a component holds at most one cycle, and it does exactly when none
    of its receipts lacks a predecessor inside the window.
    """
    states = written(chain_states(receipts, known), "chains")
    counted = states.select(F.explode("gaps").alias("gap")).where("gap <> 'fork'").groupBy("gap").agg(F.count("*").alias("n"))
    inside = receipts.select("coordinate", "predecessor").join(receipts.select(F.col("coordinate").alias("predecessor")), "predecessor", "left_semi")
    forks = inside.groupBy("predecessor").agg(F.count("*").alias("k")).where("k > 1").agg(F.lit("fork").alias("gap"), F.count("*").alias("n"))
    open_ = states.select("coordinate", "component").join(inside.select("coordinate", F.lit(1).alias("__in")), "coordinate", "left")
    cycles = open_.groupBy("component").agg(F.count_if(F.col("__in").isNull()).alias("starts")).where("starts = 0").agg(F.lit("cycle").alias("gap"), F.count("*").alias("n"))
    every = receipts.sparkSession.createDataFrame([(g,) for g in GAPS], "gap string")
    found = counted.unionByName(forks).unionByName(cycles)
    return F.broadcast(every).join(found, "gap", "left").select("gap", F.coalesce("n", F.lit(0)).alias("n"))


def chains(receipts: DataFrame, costs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """One row per valid chain: members, money, whether it admitted, its last bucket, its treatment if single."""
    states = chain_states(receipts, known).where("valid").select("coordinate", "component")
    rows = receipts.withColumn("bucket", raw_bucket("outcome_kind", "judgment")).join(states, "coordinate").join(costs, "coordinate", "left")
    return rows.groupBy("component").agg(
        F.count("*").alias("members"),
        F.bool_or(F.col("bucket") == "ADMITTED").alias("admitted"),
        F.max_by("bucket", F.struct("occurred_at", "coordinate")).alias("terminal"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("attributed_observations"),
        F.coalesce(F.sum("amount_usd"), F.lit(0).cast(MONEY)).alias("attributed_cost_usd"),
        F.when(F.countDistinct("treatment_namespace", "manifest_sha256") == 1, F.first("treatment_namespace")).alias("treatment_namespace"),
        F.when(F.countDistinct("treatment_namespace", "manifest_sha256") == 1, F.first("manifest_sha256")).alias("manifest_sha256"),
    )


def funnel(chain_rows: DataFrame) -> DataFrame:
    """One row: how many chains admitted, were corroborated later, or ended otherwise, and what that cost."""
    later = F.col("admitted") & (F.col("terminal") == "CORROBORATED")
    money = lambda c: F.coalesce(F.sum(F.when(c, F.col("attributed_cost_usd"))), F.lit(0).cast(MONEY))
    out = chain_rows.agg(
        F.count("*").alias("valid_chains"),
        F.count_if("admitted").alias("admitted_chains"),
        F.count_if(later).alias("later_corroborated_chains"),
        F.count_if(F.col("terminal") == "REJECTED").alias("terminal_rejected_chains"),
        F.count_if(F.col("terminal") == "error").alias("terminal_error_chains"),
        F.count_if(F.col("terminal") == "unmapped").alias("terminal_unmapped_chains"),
        F.count_if((F.col("terminal") == "CORROBORATED") & ~F.col("admitted")).alias("corroborated_without_admission"),
        F.count_if(F.col("admitted") & (F.col("terminal") == "ADMITTED")).alias("admitted_awaiting_followup"),
        money(F.col("admitted")).alias("admitted_cost_usd"),
        money(later).alias("later_corroborated_cost_usd"),
    )
    return out.withColumns(
        {
            "admitted_percentage": percentage("admitted_chains", "valid_chains"),
            "later_corroborated_percentage": percentage("later_corroborated_chains", "admitted_chains"),
            "cost_per_admitted_usd": ratio("admitted_cost_usd", "admitted_chains"),
            "cost_per_later_corroborated_usd": ratio("later_corroborated_cost_usd", "later_corroborated_chains"),
        }
    )


def treatment_funnel(chain_rows: DataFrame) -> DataFrame:
    """The funnel by treatment; chains of several treatments form the mixed bucket."""
    single = F.col("treatment_namespace").isNotNull()
    later = F.col("admitted") & (F.col("terminal") == "CORROBORATED")
    return chain_rows.groupBy(
        F.when(single, "single").otherwise("mixed").alias("bucket"), "treatment_namespace", "manifest_sha256"
    ).agg(
        F.count("*").alias("domain_chains"),
        F.sum("attributed_observations").alias("attributed_observations"),
        F.sum("attributed_cost_usd").alias("attributed_cost_usd"),
        F.count_if("admitted").alias("admitted_chains"),
        F.count_if(later).alias("later_corroborated_chains"),
    )


def claimability(coverage: DataFrame, allocated: DataFrame, gaps: DataFrame, chain_rows: DataFrame, threshold: float) -> DataFrame:
    """One row: eligible, or the reasons against a claim in their fixed order."""
    join = coverage.select(F.col("exact_join_percentage").alias("j"))
    ambiguous = allocated.agg(F.coalesce(F.max(F.when(F.col("state") == "ambiguous", F.col("n"))), F.lit(0)).alias("amb"))
    broken = gaps.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("gap"))
    ends = chain_rows.agg(
        F.count_if(F.col("terminal") == "unmapped").alias("unmapped"),
        F.count_if("admitted").alias("adm"),
        F.count_if(F.col("admitted") & (F.col("terminal") == "ADMITTED")).alias("waiting"),
    )
    one = join.join(F.broadcast(ambiguous)).join(F.broadcast(broken)).join(F.broadcast(ends))
    flags = (
        F.col("j").isNull() | (F.col("j") < threshold * 100),
        (F.col("amb") > 0) | (F.col("gap") > 0) | (F.col("unmapped") > 0),
        F.col("adm") == 0,
        F.col("waiting") > 0,
    )
    reasons = F.array_compact(F.array(*(F.when(f, F.lit(r)) for f, r in zip(flags, REASONS, strict=True))))
    good = F.size(reasons) == 0
    return one.select(
        F.when(good, "eligible").otherwise("not_claimable").alias("status"),
        F.when(good, F.array(F.lit("eligible"))).otherwise(reasons).alias("reasons"),
    )
