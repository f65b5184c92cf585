"""Stale-gate detector: condition resolved, re-minted, old and not consulted."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from workledger.functions.ids import stable_id
from workledger.schema import GATE_RESOLVED

RULES = ("condition-resolved", "reminted", "old-unconsulted")
# Kind of finding that a detected rule proposes.
FINDING_KIND = {"condition-resolved": "stale-gate", "reminted": "failure-motif", "old-unconsulted": "memory-hygiene"}


@dataclass(frozen=True)
class GateConfig:
    since: str
    cutoff: str
    fresh: bool = True
    remint_threshold: int = 3
    remint_window_days: int = 7
    old_after_days: int = 7
    expires_after_days: int = 7

    def __post_init__(self) -> None:
        if self.since >= self.cutoff:
            raise ValueError("since must come before the cutoff")
        if self.remint_threshold < 2 or min(self.remint_window_days, self.old_after_days, self.expires_after_days) < 1:
            raise ValueError("thresholds must be positive, and a re-mint needs two mints")


def _window(evidence: DataFrame, config: GateConfig) -> DataFrame:
    low, high = (F.lit(x).cast("timestamp") for x in (config.since, config.cutoff))
    return evidence.where((F.col("occurred_at") >= low) & (F.col("occurred_at") < high))


def canonical(evidence: DataFrame) -> DataFrame:
    """Evidence with the coordinate of the mint it targets, where it names one."""
    mints = evidence.where("evidence_kind = 'mint' and mint_id is not null and coordinate is not null")
    by_id = mints.groupBy("mint_id").agg(F.max_by("coordinate", F.struct("occurred_at", "event_id")).alias("__of_mint"))
    targeted = (F.col("evidence_kind") != "mint") & F.col("coordinate").startswith("target=")
    named = evidence.withColumn("__target", F.when(targeted, F.substring("coordinate", 8, 1 << 30)))
    return (
        named.join(by_id.withColumnRenamed("mint_id", "__target"), "__target", "left")
        .withColumn("coordinate", F.coalesce("__of_mint", "coordinate"))
        .drop("__target", "__of_mint")
    )


def densest_windows(mints: DataFrame, days: int) -> DataFrame:
    """``coordinate, size, ends_at`` of the densest window of mints; the earliest of equal ones."""
    order = F.col("occurred_at").cast("double")
    back = Window.partitionBy("coordinate").orderBy(order).rangeBetween(-days * 86400, 0)
    counted = mints.withColumn("__n", F.count("*").over(back))
    return counted.groupBy("coordinate").agg(F.max("__n").alias("size"), F.min_by("occurred_at", F.struct(-F.col("__n"), F.col("occurred_at"))).alias("ends_at"))


def gate_assessments(evidence: DataFrame, config: GateConfig) -> DataFrame:
    """``coordinate, rule, state, reason, mint_count, supporting_count, age_days``, three rows a coordinate and
    three a mint without one.

    ``evidence``: event_id, occurred_at, evidence_kind, coordinate, mint_id, status, consultation, ambiguous.
    """
    rows = canonical(_window(evidence, config))
    lost = rows.where("evidence_kind = 'mint' and coordinate is null").select(
        F.lit(None).cast("string").alias("coordinate"),
        F.explode(F.array(*(F.lit(r) for r in RULES))).alias("rule"),
        F.lit("abstain").alias("state"),
        F.when(F.col("ambiguous"), "coordinate-ambiguous").otherwise("coordinate-unavailable").alias("reason"),
        F.lit(1).cast("long").alias("mint_count"),
        F.lit(0).cast("long").alias("supporting_count"),
        F.lit(None).cast("double").alias("age_days"),
    )
    mint = F.col("evidence_kind") == "mint"
    consult = F.col("evidence_kind") == "consult"
    solved = F.col("evidence_kind").isin("decision", "disposition") & F.col("status").isin(*GATE_RESOLVED)
    facts = (
        rows.where("coordinate is not null")
        .groupBy("coordinate")
        .agg(
            F.count_if(mint).alias("mints"),
            F.count_if(solved).alias("solved"),
            F.count_if(consult).alias("consults"),
            F.count_if(consult & (F.col("consultation") == "consulted")).alias("consulted"),
            F.count_if(consult & (F.col("consultation") == "not_consulted")).alias("unconsulted"),
            F.min(F.when(mint, F.col("occurred_at"))).alias("first_mint"),
        )
        .where("mints > 0")
    )
    keyed = rows.where("evidence_kind = 'mint' and coordinate is not null")
    facts = facts.join(densest_windows(keyed, config.remint_window_days).select("coordinate", "size"), "coordinate")
    cutoff = F.lit(config.cutoff).cast("timestamp")
    age = (cutoff.cast("double") - F.col("first_mint").cast("double")) / 86400
    if not config.fresh:
        judged = F.array(*(
            F.struct(F.lit(r).alias("rule"), F.lit("abstain").alias("state"), F.lit("stale-source").alias("reason"), F.col("mints").alias("mint_count"), F.lit(0).cast("long").alias("supporting_count"), F.lit(None).cast("double").alias("age_days"))
            for r in RULES
        ))
    else:
        done = F.col("solved") > 0
        many = F.col("size") >= config.remint_threshold
        old = (
            F.when(done, "already-resolved")
            .when(age < config.old_after_days, "too-young")
            .when(F.col("consulted") > 0, "consulted")
            .when(F.col("unconsulted") > 0, "explicit-not-consulted")
            .otherwise("consultation-unknown")
        )
        found = lambda c: F.when(c, "detected").otherwise("not-detected")
        nothing = F.lit(None).cast("double")
        judged = F.array(
            F.struct(F.lit(RULES[0]).alias("rule"), found(done).alias("state"), F.when(done, "resolution-receipt").otherwise("no-resolution").alias("reason"), F.col("mints").alias("mint_count"), F.col("solved").alias("supporting_count"), nothing.alias("age_days")),
            F.struct(F.lit(RULES[1]).alias("rule"), found(many).alias("state"), F.when(many, "remint-threshold").otherwise("below-threshold").alias("reason"), F.col("size").alias("mint_count"), F.lit(0).cast("long").alias("supporting_count"), nothing.alias("age_days")),
            F.struct(
                F.lit(RULES[2]).alias("rule"),
                F.when(old == "explicit-not-consulted", "detected").when(old == "consultation-unknown", "abstain").otherwise("not-detected").alias("state"),
                old.alias("reason"), F.col("mints").alias("mint_count"), F.col("consults").alias("supporting_count"), F.round(age, 6).alias("age_days"),
            ),
        )
    return facts.select("coordinate", F.explode(judged).alias("j")).select("coordinate", "j.*").unionByName(lost)


def mint_coverage(evidence: DataFrame, config: GateConfig) -> DataFrame:
    """Share of mints that have a coordinate."""
    mints = _window(evidence, config).where("evidence_kind = 'mint'")
    return mints.agg(F.count("*").alias("mints"), F.count("coordinate").alias("keyed")).withColumn(
        "coverage", F.col("keyed") / F.greatest("mints", F.lit(1))
    )


def gate_candidates(assessments: DataFrame) -> DataFrame:
    """Findings that detected rules propose, all of grade lead."""
    kinds = F.create_map(*(F.lit(v) for pair in FINDING_KIND.items() for v in pair))
    rows = assessments.where("state = 'detected'").select(
        F.concat_ws(":", "rule", "coordinate").alias("subject"),
        F.element_at(kinds, F.col("rule")).alias("kind"),
        F.lit("lead").alias("grade"),
        F.to_json(F.struct("coordinate", "mint_count", "reason", "rule", "supporting_count")).alias("details"),
    )
    return rows.withColumn("finding_id", stable_id("fnd", "kind", "subject")).withColumn(
        "content_hash", F.sha2(F.concat_ws("\0", "grade", "details").cast("binary"), 256)
    )
