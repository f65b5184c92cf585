"""Memory audit: what each inventoried item's use evidence allows to recommend."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from workledger.functions.ids import stable_id
from workledger.schema import MEMORY_STAGES


def stage_statuses(evidence: DataFrame) -> DataFrame:
    """``system, item_id`` and one status per stage, by the evidence of the stage's latest time.

    observed or not_observed if that evidence agrees, conflicted if it does not, unknown without any.
    """
    at = evidence.groupBy("system", "item_id", "stage", "occurred_at").agg(
        F.count_if(F.col("state") == "observed").alias("yes"), F.count_if(F.col("state") == "not_observed").alias("no")
    )
    last = at.groupBy("system", "item_id", "stage").agg(F.max_by(F.struct("yes", "no"), "occurred_at").alias("x"))
    status = F.when((F.col("x.yes") > 0) & (F.col("x.no") > 0), "conflicted").when(F.col("x.yes") > 0, "observed").otherwise("not_observed")
    wide = last.withColumn("status", status).groupBy("system", "item_id").pivot("stage", list(MEMORY_STAGES)).agg(F.first("status"))
    return wide.na.fill("unknown", list(MEMORY_STAGES))


def memory_audit(evidence: DataFrame, cutoff: str, non_use_after_days: int = 30) -> DataFrame:
    """``system, item_id``, stage statuses, ``superseded_by, age_days, disposition, reason, grade, coverage``.

    ``evidence``: event_id, occurred_at, system, item_id, stage, state, superseded_by. Only items with an
    observed inventory count; age is that of the latest inventory.
    """
    rows = evidence.where(F.col("occurred_at") < F.lit(cutoff).cast("timestamp"))
    order = F.struct("occurred_at", "event_id")
    seen = (F.col("stage") == "inventory") & (F.col("state") == "observed")
    items = (
        rows.groupBy("system", "item_id")
        .agg(
            F.max(F.when(seen, F.col("occurred_at"))).alias("inventoried_at"),
            F.max_by("superseded_by", F.when(F.col("superseded_by").isNotNull(), order)).alias("superseded_by"),
        )
        .where("inventoried_at is not null")
    )
    joined = items.join(stage_statuses(rows), ["system", "item_id"])
    age = (F.lit(cutoff).cast("timestamp").cast("double") - F.col("inventoried_at").cast("double")) / 86400
    some = lambda value, stages=MEMORY_STAGES: F.array_contains(F.array(*stages), value)
    unused = F.forall(F.array(*MEMORY_STAGES), lambda s: s == "not_observed")
    reason = (
        F.when(some("conflicted"), "conflicted")
        .when(F.col("applied") == "observed", "applied")
        .when(some("observed", MEMORY_STAGES[:3]), "accessed")
        .when(F.col("age_days") < non_use_after_days, "too-recent")
        .when(unused & F.col("superseded_by").isNotNull(), "superseded-non-use")
        .when(unused, "complete-non-use")
        .otherwise("signals-unknown")
    )
    kept = F.col("reason").isin("applied", "accessed")
    disposition = F.when(kept, "keep").when(F.col("reason") == "superseded-non-use", "retire").when(F.col("reason") == "complete-non-use", "park").otherwise("none")
    known = F.size(F.filter(F.array(*MEMORY_STAGES), lambda s: s != "unknown"))
    return (
        joined.withColumn("age_days", age)
        .withColumn("reason", reason)
        .withColumn("disposition", disposition)
        .withColumn("grade", F.when(F.col("reason") == "accessed", "lead").when(F.col("disposition") != "none", "candidate"))
        .withColumn("coverage", known / F.lit(len(MEMORY_STAGES)))
    )


def memory_coverage(audit: DataFrame) -> DataFrame:
    """Per system: items and how many stages of them are known."""
    unknown = F.exists(F.array(*MEMORY_STAGES), lambda s: s == "unknown")
    return audit.groupBy("system").agg(
        F.count("*").alias("items"),
        *(F.count_if(F.col(s) != "unknown").alias(f"known_{s}") for s in MEMORY_STAGES),
        F.count_if(unknown).alias("items_with_unknown"),
    )


def memory_candidates(audit: DataFrame) -> DataFrame:
    rows = audit.where("disposition <> 'none'").select(
        F.concat_ws(":", "disposition", "system", "item_id").alias("subject"),
        F.lit("memory-hygiene").alias("kind"),
        "grade",
        F.to_json(F.struct("reason", "superseded_by", *MEMORY_STAGES)).alias("details"),
    )
    return rows.withColumn("finding_id", stable_id("fnd", "kind", "subject")).withColumn(
        "content_hash", F.sha2(F.concat_ws("\0", "grade", "details").cast("binary"), 256)
    )
