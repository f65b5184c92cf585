"""Failure facets of sessions and the assessment of proposed motifs against them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from workledger.functions.coerce import error_category, failed_action
from workledger.functions.ids import ref, stable_id
from workledger.operators import graph
from workledger.operators.activity import family_events, reference_events

TERMINAL = ("failed", "reverted", "abandoned")


@dataclass(frozen=True)
class MotifConfig:
    since: str
    cutoff: str
    recurrence_floor: int = 3
    receipt_floor: int = 1
    aggregation_floor: int = 2

    def __post_init__(self) -> None:
        if self.since >= self.cutoff or min(self.recurrence_floor, self.receipt_floor, self.aggregation_floor) < 1:
            raise ValueError("the window must not be empty and floors must be positive")


def in_window(df: DataFrame, since: str, cutoff: str) -> DataFrame:
    low, high = (F.lit(x).cast("timestamp") for x in (since, cutoff))
    return df.where((F.col("occurred_at") >= low) & (F.col("occurred_at") < high))


def _mode(df: DataFrame, value: str, name: str) -> DataFrame:
    """The most frequent value of each session that occurs at least twice; the smaller of equal ones."""
    counts = df.where(F.col(value).isNotNull()).groupBy("session_id", value).agg(F.count("*").alias("n")).where("n >= 2")
    order = Window.partitionBy("session_id").orderBy(F.desc("n"), value)
    return counts.withColumn("r", F.row_number().over(order)).where("r = 1").select("session_id", F.col(value).alias(name))


def failure_facets(sessions: DataFrame, tools: DataFrame, outcomes: DataFrame, extras: DataFrame | None = None) -> DataFrame:
    """One row per session that has tools or outcomes.

    ``sessions``: session_id, adapter, native_id. ``tools``: event_id, session_id, tool_name, status, error,
    input_sha. ``outcomes``: event_id, session_id, status. ``extras``: session_id, scope_changes. All are
    already windowed; sessions outside have no facet.
    """
    failed = tools.where("status = 'failed'").withColumn("action", failed_action("tool_name", "input_sha"))
    attempts = tools.groupBy("session_id").agg(
        F.count("*").alias("tool_attempts"),
        F.count_if(F.col("status") == "failed").alias("failed_tool_attempts"),
        F.array_sort(F.collect_set(error_category("error"))).alias("error_categories"),
    )
    results = outcomes.groupBy("session_id").agg(F.array_sort(F.collect_set("status")).alias("outcome_statuses"))
    changes = None if extras is None else extras.groupBy("session_id").agg(F.sum("scope_changes").alias("scope_changes"))
    none = F.array().cast("array<string>")
    joined = sessions.join(attempts, "session_id", "left").join(results, "session_id", "left")
    joined = joined.where("tool_attempts is not null or outcome_statuses is not null")
    for frame, value, name in (
        (tools, "tool_name", "repeated_tool"),
        (failed, "tool_name", "repeated_failed_tool"),
        (failed, "action", "repeated_failure_fingerprint"),
    ):
        joined = joined.join(_mode(frame, value, name), "session_id", "left")
    joined = joined.join(changes, "session_id", "left") if changes is not None else joined.withColumn("scope_changes", F.lit(0))
    return joined.withColumns(
        {c: F.coalesce(c, F.lit(0)).cast("long") for c in ("tool_attempts", "failed_tool_attempts", "scope_changes")}
        | {c: F.coalesce(c, none) for c in ("error_categories", "outcome_statuses")}
    )


#: Adapters whose sessions other sources may refer to, and by which namespace.
SESSION_NAMESPACES = {
    "claude-code": "claude-code.session", "codex": "codex.session", "fab": "fab.job", "hermes": "hermes.session", "opencode": "opencode.session",
}


def corroborating_receipts(facets: DataFrame, own: DataFrame, events: DataFrame, crosswalks: DataFrame, relations: DataFrame, cutoff: str, max_depth: int = 4) -> DataFrame:
    """``session_id, event_id`` of outcomes that vouch for sessions without a receipt of their own.

    ``facets``: session_id, adapter, native_id. ``own``: session_id, event_id. From a session's reference current links
    and relations are walked; every stored event that a reached reference names brings its family, and the family's
    outcomes before the cutoff count. Adapters whose sessions nothing refers to have none.
    """
    known = F.create_map(*(F.lit(v) for pair in SESSION_NAMESPACES.items() for v in pair))
    asked = facets.join(own.select("session_id"), "session_id", "left_anti").select("session_id", ref(F.try_element_at(known, "adapter"), "native_id").alias("node"))
    roots = asked.where("node is not null").select(F.col("session_id").alias("root"), "node")
    edges = graph.crosswalk_edges(crosswalks).unionByName(graph.relation_edges(relations))
    seeds = reference_events(graph.reachable(roots, edges, max_depth), events).select("root", F.col("event_id").alias("node"))
    family = family_events(seeds, events)
    vouching = family.where("kind = 'outcome'").where(F.col("occurred_at") < F.lit(cutoff).cast("timestamp"))
    return vouching.select(F.col("asked").alias("session_id"), "event_id").distinct()


def session_receipts(facets: DataFrame, own: DataFrame, corroborating: DataFrame) -> DataFrame:
    """``session_id, event_id``: the union of each known session's own and corroborating receipts, a row each."""
    both = own.select("session_id", "event_id").unionByName(corroborating.select("session_id", "event_id")).distinct()
    return both.join(facets.select("session_id").distinct(), "session_id", "left_semi")


def facet_snapshot(facets: DataFrame, config: MotifConfig) -> str:
    """An id of a window's facets as a set: the same for the same rows in any order, without gathering them."""
    one = F.xxhash64(*sorted(facets.columns))
    bounds = (config.since, config.cutoff, config.recurrence_floor, config.receipt_floor, config.aggregation_floor)
    whole = facets.agg(F.count("*").alias("n"), F.sum(one.cast("decimal(38,0)")).alias("s"), F.bit_xor(one).alias("x"))
    return whole.select(stable_id("mfs", *(F.lit(str(b)) for b in bounds), "n", "s", "x").alias("id")).head()["id"]


def check_synthesis(snapshot: str, synthesis: dict, evaluation: dict | None, config: MotifConfig) -> None:
    """Refuse proposals that were not made of this snapshot, or that the evaluation at hand says nothing about.

    ``synthesis``: source_snapshot, model, harness, parameters_digest. ``evaluation``: generator, model, harness,
    parameters_digest, recurrence_floor, aggregation_floor. A scan may tighten the floors that were measured, not weaken them.
    """
    if synthesis["source_snapshot"] != snapshot:
        raise ValueError("the proposals were made of another snapshot")
    if evaluation is None:
        return
    if evaluation["generator"] != "failure-motif":
        raise ValueError("the evaluation is of another generator")
    if any(evaluation[k] != synthesis[k] for k in ("model", "harness", "parameters_digest")):
        raise ValueError("the evaluation is of another model, harness or set of parameters")
    if config.recurrence_floor < evaluation["recurrence_floor"] or config.aggregation_floor < evaluation["aggregation_floor"]:
        raise ValueError("the floors are below those that were measured")


def supports(motif: Column) -> Column:
    """Whether a facet row supports a motif."""
    drift = (F.col("scope_changes") > 0) & F.arrays_overlap("outcome_statuses", F.array(*(F.lit(t) for t in TERMINAL)))
    loop = F.col("repeated_failed_tool").isNotNull() & F.array_contains("error_categories", "permission")
    return (
        F.when(motif == "retry-storm", F.col("repeated_failure_fingerprint").isNotNull())
        .when(motif == "permission-loop", loop)
        .when(motif == "context-drift", drift)
        .otherwise(False)
    )


def assess_proposals(proposals: DataFrame, facets: DataFrame, receipts: DataFrame, decision: str, config: MotifConfig) -> DataFrame:
    """``motif_id, state, reason, sessions, supported, with_receipt, grade`` for each proposal.

    ``proposals``: motif_id, session_ids. ``receipts``: session_id of sessions with at least one receipt, as
    ``session_receipts`` finds them.
    ``decision``: what the evaluation allows (surface, narrow or offline).
    """
    rows = proposals.select("motif_id", F.explode(F.array_distinct("session_ids")).alias("session_id"))
    known = facets.withColumn("__known", F.lit(True))
    held = receipts.select("session_id").distinct().withColumn("__receipt", F.lit(True))
    joined = rows.join(known, "session_id", "left").join(held, "session_id", "left")
    ok = F.coalesce(supports(F.col("motif_id")), F.lit(False))
    facts = joined.groupBy("motif_id").agg(
        F.count("*").alias("sessions"),
        F.count_if(F.col("__known").isNull()).alias("unknown"),
        F.count_if(ok).alias("supported"),
        F.count_if(F.col("__receipt").isNotNull()).alias("with_receipt"),
        F.countDistinct("adapter").alias("aggregation"),
    )
    reason = (
        F.when(F.col("unknown") > 0, "unknown-session")
        .when(F.col("supported") < F.col("sessions"), "unsupported-facet")
        .when(F.col("sessions") < config.recurrence_floor, "below-recurrence-floor")
        .when(F.col("with_receipt") < config.receipt_floor, "below-receipt-floor")
        .when(F.col("sessions") < config.aggregation_floor, "below-aggregation-floor")
        .when(F.lit(decision) == "offline", "evaluation-offline")
        .otherwise("eligible")
    )
    good = F.col("reason") == "eligible"
    return (
        facts.withColumn("reason", reason)
        .withColumn("state", F.when(good, "eligible").otherwise("rejected"))
        .withColumn("grade", F.when(good & (F.lit(decision) == "surface"), "candidate").when(good, "lead"))
        .drop("unknown", "aggregation")
    )


def motif_candidates(assessments: DataFrame) -> DataFrame:
    rows = assessments.where("state = 'eligible'").select(
        F.col("motif_id").alias("subject"), F.lit("failure-motif").alias("kind"), "grade", F.to_json(F.struct("sessions", "with_receipt")).alias("details"),
    )
    return rows.withColumn("finding_id", stable_id("fnd", "kind", "subject")).withColumn(
        "content_hash", F.sha2(F.concat_ws("\0", "grade", "details").cast("binary"), 256)
    )
