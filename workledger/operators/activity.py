"""What belongs to one identity, evidence per outcome tuple, and calibration of promoted procedures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from workledger.functions.coerce import procedure_class
from workledger.functions.ids import SEP, event_id, ref, ref_namespace, ref_value
from workledger.operators import graph
from workledger.schema import MONEY, REFERENCES


def reference_events(refs: DataFrame, events: DataFrame) -> DataFrame:
    """``root, node`` -> ``root, node, event_id`` of the stored event that each reference names."""
    table = refs.sparkSession.createDataFrame(list(REFERENCES), "ns string, r_adapter string, r_kind string")
    named = refs.withColumn("ns", ref_namespace("node")).withColumn("val", F.regexp_replace("node", f"^[^{SEP}]*{SEP}", "")).join(F.broadcast(table), "ns")
    ids = named.withColumn("event_id", event_id("r_adapter", "r_kind", "val"))
    return ids.join(events.select("event_id"), "event_id", "left_semi").select("root", "node", "event_id")


def activity(roots: DataFrame, events: DataFrame, crosswalks: DataFrame, relations: DataFrame, max_depth: int = 4) -> tuple[DataFrame, DataFrame]:
    """For each root reference: the references connected to it, and the events of the families they name.

    Session and job references that name no stored event still stand for the event id they would have.
    """
    edges = graph.crosswalk_edges(crosswalks).unionByName(graph.relation_edges(relations))
    refs = graph.reachable(roots.select(F.col("node").alias("root"), "node"), edges, max_depth)
    return refs, family_events(named_events(refs), events)


def named_events(refs: DataFrame) -> DataFrame:
    """``root, node`` references -> ``root, node`` of the event ids that they name, stored or not."""
    table = refs.sparkSession.createDataFrame(list(REFERENCES), "ns string, r_adapter string, r_kind string")
    parts = refs.withColumn("ns", ref_namespace("node")).withColumn("val", F.regexp_replace("node", f"^[^{SEP}]*{SEP}", "")).join(F.broadcast(table), "ns")
    return parts.select("root", event_id("r_adapter", "r_kind", "val").alias("node")).distinct()


def family_events(seeds: DataFrame, events: DataFrame) -> DataFrame:
    """``asked`` and the events of the families that each root's seeds belong to."""
    found = graph.family_closure(seeds, events.select("event_id", "session_id", "parent_event_id"))
    return found.select(F.col("root").alias("asked"), F.col("node").alias("event_id")).join(events, "event_id").select("asked", *events.columns)


def outcome_counts(events: DataFrame) -> DataFrame:
    """Outcomes by root, type and status; ``events`` has asked and the outcome struct."""
    rows = events.where("kind = 'outcome'")
    return rows.groupBy("asked", F.col("outcome.outcome_type").alias("outcome_type"), F.col("outcome.status").alias("status")).agg(F.count("*").alias("n"))


def _text(column: str | F.Column) -> F.Column:
    """A text, null where it is blank."""
    c = F.col(column) if isinstance(column, str) else column
    return F.when(F.trim(c) != "", c)


def harnesses(candidates: DataFrame, placed: DataFrame, attempts: DataFrame) -> DataFrame:
    """``event_id, backend`` of the first runner attempt with a backend on any of a cost's paths.

    ``candidates``: event_id, node, rank, won, path; ``attempts``: node, backend. A cost's winning path comes first, then
    its other candidates by rank and reference; on a path, attempts in walking order.
    """
    passed = candidates.select("path").distinct().where(F.size("path") > 1).select("path", F.posexplode(F.slice("path", F.lit(2), F.size("path") - 1)).alias("at", "edge"))
    ends = placed.select("edge", F.posexplode(F.array("source", "target")).alias("side", "node")).where(ref_namespace("node") == "fab.attempt")
    named = passed.join(ends.join(attempts, "node"), "edge")
    first = named.groupBy("path").agg(F.min_by("backend", F.struct("at", "side")).alias("backend"))
    every = candidates.join(first, "path").groupBy("event_id")
    return every.agg(F.min_by("backend", F.struct((~F.col("won")).alias("lost"), "rank", "node")).alias("backend"))


def tuple_observations(judged: DataFrame, candidates: DataFrame, placed: DataFrame, events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Attributed costs as observations of outcome tuples, from events; and how many costs lack a part of theirs.

    ``judged, candidates, placed``: what ``attribution.judge`` gives for commits. ``events``: rows of the event table.
    A cost's call is its stored parent; profile, served model and harness are the nearest that the call, its cost, an
    attempt on any of its paths or its session states. One row per cost and commit that it may have led to.
    """
    calls = events.where("kind = 'model-call'").select(
        F.col("event_id").alias("parent_event_id"), F.col("session_id").alias("call_session"), F.col("adapter").alias("call_adapter"), "model_call.model",
        *(_text(F.get_json_object("attributes", f"$.{c}")).alias(c) for c in ("workload_id", "prompt_id", "origin")),
    )
    sessions = events.where("kind = 'session'").select(F.col("event_id").alias("call_session"), F.col("session.harness").alias("session_harness"), F.lit(True).alias("has_session"))
    models = events.where("kind = 'cost'").select("event_id", F.col("cost.model").alias("cost_model"))
    attempts = events.where("kind = 'outcome' and adapter = 'fab'").select(ref("fab.attempt", "native_id").alias("node"), _text(F.get_json_object("attributes", "$.backend")).alias("backend")).where("backend is not null")
    won = judged.where("state = 'attributed'").select("event_id", F.col("outcome_node").alias("node"), F.lit(True).alias("won"))
    options = candidates.join(won, ["event_id", "node"], "left").withColumn("won", F.coalesce("won", F.lit(False)))
    options = graph.written(options, "tuple-options")
    wide = (
        judged.select("event_id", "parent_event_id", "state", "outcome_type", "outcome_node", "outcome_status", "amount_usd", F.col("kind").alias("economic_kind"))
        .join(calls, "parent_event_id", "left").join(sessions, "call_session", "left").join(models, "event_id", "left")
        .join(harnesses(options, placed, attempts), "event_id", "left")
    )
    native = F.when((F.col("call_adapter") == "somm") & (F.col("origin") == "native"), "somm")
    harness = F.coalesce("backend", F.when(F.col("has_session"), F.col("session_harness")).otherwise(native))
    commits = options.where("outcome_type = 'git.commit'").where(ref_namespace("node") == "git.commit").select("event_id", ref_value("node").alias("implementation")).distinct()
    # a served model is asked of a stored call only
    served = F.when(F.col("call_adapter").isNotNull(), F.coalesce(_text("cost_model"), _text("model")))
    told = wide.withColumns({"profile": F.coalesce("workload_id", "prompt_id"), "served_model": served, "harness": _text(harness)})
    rows = told.join(commits, "event_id", "left")
    missing = F.lit(False)
    for c in ("profile", "served_model", "harness", "implementation"):
        missing = missing | F.col(c).isNull()
    outcome = F.when((F.col("outcome_type") == "git.commit") & F.col("outcome_node").isNotNull(), F.regexp_replace("outcome_node", f"^[^{SEP}]*{SEP}", ""))
    shown = ["event_id", "profile", "served_model", "harness", "implementation", "state", "amount_usd", "economic_kind", "outcome_status"]
    whole = rows.where(~missing).withColumn("outcome_implementation", outcome).select(*shown, "outcome_implementation")
    return whole, rows.where(missing).select("event_id").distinct()


def tuple_parts(observations: DataFrame) -> DataFrame:
    """Money by economic kind and observations by the status of their outcome, of each tuple: ``part, name, n, amount_usd``."""
    key = ["profile", "served_model", "harness", "implementation"]
    money = observations.groupBy(*key, F.lit("kind").alias("part"), F.col("economic_kind").alias("name")).agg(F.count("*").alias("n"), F.sum("amount_usd").alias("amount_usd"))
    mine = observations.where("outcome_implementation = implementation and outcome_status is not null")
    statuses = mine.groupBy(*key, F.lit("status").alias("part"), F.col("outcome_status").alias("name")).agg(F.count("*").alias("n"), F.sum("amount_usd").alias("amount_usd"))
    return money.unionByName(statuses)


def tuple_evidence(observations: DataFrame, source_errors: bool = False, minimum: int = 5) -> DataFrame:
    """State of the evidence for each (profile, served_model, harness, implementation).

    ``observations``: the tuple, state, outcome_implementation, amount_usd. Any ambiguous or unallocated
    observation confounds a tuple; fewer attributed ones than ``minimum`` leave it sparse.
    """
    key = ["profile", "served_model", "harness", "implementation"]
    whole = observations.where(" and ".join(f"coalesce({k}, '') <> ''" for k in key))
    mine = (F.col("state") == "attributed") & (F.col("outcome_implementation") == F.col("implementation"))
    facts = whole.groupBy(*key).agg(
        F.count("*").alias("observations"),
        F.count_if(mine).alias("attributed"),
        F.count_if(F.col("state") == "ambiguous").alias("ambiguous"),
        F.count_if(F.col("state") == "unallocated").alias("unallocated"),
        F.coalesce(F.sum("amount_usd"), F.lit(0).cast(MONEY)).alias("amount_usd"),
    )
    confounded = (F.col("ambiguous") > 0) | (F.col("unallocated") > 0)
    state = F.when(F.lit(source_errors), "unavailable").when(confounded, "confounded").when(F.col("attributed") < minimum, "sparse").otherwise("ready")
    return facts.withColumn("state", state)


def procedure_calibration(promotions: DataFrame, relations: DataFrame, runner: DataFrame, gateway: DataFrame) -> DataFrame:
    """One row per promotion: its classification, or why it has none.

    All of ``promotions``, ``runner`` and ``gateway`` carry promotion_id, revision_id, evaluation_tuple and
    baseline_tuple (structs that must all be there); runner rows also status and semantic, gateway rows
    direction, baseline_score and post_score. Exactly one match of each is needed; of the runner's, rows
    marked semantic come first.
    """
    key = ["promotion_id", "revision_id", "evaluation_tuple", "baseline_tuple"]
    best = runner.groupBy(*key).agg(F.max("semantic").alias("semantic"))
    jobs = runner.join(best, [*key, "semantic"]).groupBy(*key).agg(F.count("*").alias("n_runner"), F.first("status").alias("runner_status"))
    scores = gateway.groupBy(*key).agg(F.count("*").alias("n_gateway"), *(F.first(c).alias(c) for c in ("direction", "baseline_score", "post_score")))
    promoted = relations.where("predicate = 'promotes' and subject_ns = 'workledger.finding-revision' and object_ns = 'spindle.promotion-receipt'")
    stated = promoted.select(F.col("subject_val").alias("revision_id"), F.col("object_val").alias("promotion_id"), F.lit(True).alias("__stated")).distinct()
    rows = promotions.join(stated, ["promotion_id", "revision_id"], "left").join(jobs, key, "left").join(scores, key, "left")
    reasons = F.array_compact(
        F.array(
            F.when(F.col("__stated").isNull(), "missing-finding-promotion-relation"),
            F.when(F.coalesce("n_runner", F.lit(0)) != 1, "missing-exact-fab-outcome"),
            F.when((F.col("n_runner") == 1) & (F.col("runner_status") != "succeeded"), "fab-outcome-not-successful"),
            F.when(F.coalesce("n_gateway", F.lit(0)) != 1, "missing-exact-somm-outcome"),
        )
    )
    classed = F.when(F.size(reasons) == 0, procedure_class("direction", "baseline_score", "post_score")).otherwise("inconclusive")
    return rows.select(*key, reasons.alias("reasons"), classed.alias("classification"), (F.col("post_score") - F.col("baseline_score")).alias("delta"))
