"""Conservative attribution of selected costs to outcomes: each amount is attributed, ambiguous or unallocated.

One search runs per distinct set of roots, not per cost. States and money depend only on what is reachable;
the path that is reported is the first of a breadth-first search in sorted order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from workledger.functions.ids import ref
from workledger.operators import graph
from workledger.schema import MONEY, OUTCOME_TYPES, RECEIPT_OUTCOME

REASON_STATE = {
    "exact-directed-path": "attributed",
    "competing-outcomes": "ambiguous",
    "association-only": "unallocated",
    "no-root-reference": "unallocated",
    "no-outcome-path": "unallocated",
}


def event_reference() -> Column:
    """Reference that an event (kind, adapter, native_id) stands for in the graph; null for most."""
    sessions = {a: f"{a}.session" for a in ("claude-code", "codex", "hermes", "opencode", "somm")} | {"fab": "fab.job"}
    names = F.create_map(*(F.lit(v) for pair in sessions.items() for v in pair))
    return F.when(F.col("kind") == "session", ref(F.element_at(names, F.col("adapter")), "native_id")).when(
        (F.col("kind") == "model-call") & (F.col("adapter") == "somm"), ref("somm.call", "native_id")
    )


def outcome_candidates(outcomes: DataFrame, types: tuple[str, ...] = OUTCOME_TYPES) -> DataFrame:
    """Latest outcome of each (type, reference): ``outcome_type, node, event_id, status, occurred_at, rank``.

    ``outcomes`` has event_id, adapter, native_id, occurred_at, outcome_type, status, reference.
    """
    has = F.col("reference").isNotNull() & (F.col("reference") != "")
    kind = F.col("outcome_type")
    resolved = (
        F.when((kind == "git.commit") & has, F.struct(F.lit("git.commit").alias("t"), ref("git.commit", "reference").alias("r")))
        .when((F.col("adapter") == "george") & kind.isNotNull(), F.struct(F.lit("george.entry").alias("t"), ref("george.entry", "native_id").alias("r")))
        .when((kind == "fab.job") & has, F.struct(F.lit("fab.job").alias("t"), ref("fab.job", "reference").alias("r")))
        .when(kind == "fab.attempt", F.struct(F.lit("fab.attempt").alias("t"), ref("fab.attempt", "native_id").alias("r")))
        .when((F.col("adapter") == "barnowl-research-outcome") & (kind == RECEIPT_OUTCOME) & has, F.struct(F.lit(RECEIPT_OUTCOME).alias("t"), ref(RECEIPT_OUTCOME, "reference").alias("r")))
    )
    rows = outcomes.withColumn("__c", resolved).where(F.col("__c").isNotNull() & F.col("__c.t").isin(*types))
    best = F.max(F.struct("occurred_at", "event_id", "status"))
    rank = F.array_position(F.array(*(F.lit(t) for t in OUTCOME_TYPES)), F.col("outcome_type"))
    return (
        rows.groupBy(F.col("__c.t").alias("outcome_type"), F.col("__c.r").alias("node"))
        .agg(best.alias("b"))
        .select("outcome_type", "node", "b.event_id", "b.status", "b.occurred_at", rank.alias("rank"))
    )


def cost_roots(costs: DataFrame, events: DataFrame) -> DataFrame:
    """``event_id, roots``: sorted references among the stored ancestors of each cost that has any."""
    named = events.withColumn("node", event_reference()).where("node is not null").select("event_id", "node")
    return (
        graph.lineage(costs, events)
        .join(named, "event_id")
        .groupBy("cost_id")
        .agg(F.array_sort(F.collect_set("node")).alias("roots"))
        .withColumnRenamed("cost_id", "event_id")
    )


def receipt_links(costs: DataFrame, events: DataFrame, relations: DataFrame, candidates: DataFrame) -> DataFrame:
    """Costs whose immediate metered call an outcome's own receipt names: ``event_id, node``."""
    calls = events.where("kind = 'model-call' and adapter = 'somm'").select(
        F.col("event_id").alias("parent_event_id"), ref("somm.call", "native_id").alias("call")
    )
    direct = costs.where("adapter = 'somm'").select("event_id", "parent_event_id").join(calls, "parent_event_id")
    edges = relations.where(
        f"predicate = 'produced' and method = 'source_receipt' and subject_ns = 'somm.call' and object_ns = '{RECEIPT_OUTCOME}'"
    ).select(
        ref(F.col("subject_ns"), "subject_val").alias("call"), ref(F.col("object_ns"), "object_val").alias("node"), "evidence_event_ids"
    )
    named = candidates.where(F.col("outcome_type") == RECEIPT_OUTCOME).select("node", F.col("event_id").alias("outcome_id"))
    return (
        direct.join(edges, "call")
        .join(named, "node")
        .where(F.array_contains("evidence_event_ids", F.col("outcome_id")))
        .select("event_id", "node")
        .distinct()
    )


def attribute(
    costs: DataFrame,
    events: DataFrame,
    outcomes: DataFrame,
    crosswalks: DataFrame,
    relations: DataFrame,
    types: tuple[str, ...] = OUTCOME_TYPES,
    max_depth: int = 8,
) -> DataFrame:
    """Selected costs with ``state, reason, outcome_type, outcome_node, outcome_status, outcome_event_id, steps,
    n_candidates``; where steps are not asked for, ``states`` moves far less.

    ``costs`` are selected observations; crosswalks and relations are current states. Of the eligible outcomes
    those of the strongest type compete: one wins, several are ambiguous.
    """
    judged, _, edges = judge(costs, events, outcomes, crosswalks, relations, types, max_depth)
    shown = graph.steps_of(judged.where("path is not null"), edges)  # only of what won
    return judged.join(shown, "path", "left").drop("path")


def judge(
    costs: DataFrame,
    events: DataFrame,
    outcomes: DataFrame,
    crosswalks: DataFrame,
    relations: DataFrame,
    types: tuple[str, ...] = OUTCOME_TYPES,
    max_depth: int = 8,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """As ``attribute``, with the winner's ``path`` for its steps; the candidates of every cost (``event_id, node,
    outcome_type, rank, eligible, path``); and the placed edges that paths are numbers of.
    """
    costs = graph.written(costs, "costs")  # both are read several times below
    candidates = graph.written(outcome_candidates(outcomes, types), "candidates")
    edges = graph.placed_edges(graph.attribution_graph(crosswalks, relations, outcomes))
    judged, every = _judge(costs, events, relations, candidates, lambda starts: graph.walks(starts, edges, max_depth))
    out = graph.written(judged, "attributed")
    graph.freed(costs, candidates)
    return out, every, edges


def states(
    costs: DataFrame,
    events: DataFrame,
    outcomes: DataFrame,
    crosswalks: DataFrame,
    relations: DataFrame,
    types: tuple[str, ...] = OUTCOME_TYPES,
    max_depth: int = 8,
) -> DataFrame:
    """As ``attribute``, without ``steps``: these alone need numbered edges and the walks' paths."""
    costs = graph.written(costs, "costs")
    candidates = graph.written(outcome_candidates(outcomes, types), "candidates")
    edges = graph.attribution_graph(crosswalks, relations, outcomes)
    return _judge(costs, events, relations, candidates, lambda starts: graph.arrivals(starts, edges, max_depth))[0].drop("path")


def start_key(roots: str = "roots") -> Column:
    """A text for a sorted set of roots: they themselves where they are short, else their digest."""
    text = F.array_join(roots, "\0")
    return F.when(F.length(text) < 64, text).otherwise(F.sha2(text.cast("binary"), 256))


def _judge(costs: DataFrame, events: DataFrame, relations: DataFrame, candidates: DataFrame, search: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Verdict and candidates of every cost, from the walks that ``search`` makes of (start, node)."""
    rooted = graph.written(cost_roots(costs, events).withColumn("start", start_key()), "roots")
    starts = rooted.select("start", "roots").dropDuplicates(["start"]).select("start", F.explode("roots").alias("node"))
    walked = search(starts)
    found = walked.join(candidates.select("node", "outcome_type", "rank"), "node")
    receipt = F.col("outcome_type") == RECEIPT_OUTCOME
    # a walk that used a relation makes an outcome eligible, except that receipts have their own rule
    options = (
        found.groupBy("start", "node", "outcome_type", "rank")
        .agg(
            F.max("used").alias("by_relation"),
            F.min_by("path", F.when(F.col("used"), 0).otherwise(1)).alias("path"),
        )
        .withColumn("eligible", F.col("by_relation") & ~receipt)
    )
    per_cost = rooted.select("event_id", "start").join(options, "start").select("event_id", "node", "outcome_type", "rank", "path", "eligible")
    direct = receipt_links(costs, events, relations, candidates)
    rank = OUTCOME_TYPES.index(RECEIPT_OUTCOME) + 1
    direct = direct.select(
        "event_id", "node", F.lit(RECEIPT_OUTCOME).alias("outcome_type"), F.lit(rank).cast("long").alias("rank"),
        F.lit(None).cast("array<long>").alias("path"), F.lit(True).alias("eligible"),
    )
    every = graph.written(
        per_cost.unionByName(direct)
        .groupBy("event_id", "node", "outcome_type", "rank")
        .agg(F.max("eligible").alias("eligible"), F.first("path", ignorenulls=True).alias("path")),
        "options",
    )
    graph.freed(*walked.levels)
    verdict = every.groupBy("event_id").agg(
        F.count("*").alias("n_candidates"),
        F.min(F.when(F.col("eligible"), F.col("rank"))).alias("best"),
        F.min(F.when(F.col("eligible"), F.struct("rank", "node", "outcome_type"))).alias("winner"),
    )
    at_best = (
        every.where("eligible")
        .join(verdict.select("event_id", "best"), "event_id")
        .where("rank = best")
        .groupBy("event_id")
        .agg(F.count("*").alias("n_best"), F.first("path", ignorenulls=True).alias("path"))
    )
    reason = (
        F.when(F.col("start").isNull(), "no-root-reference")
        .when(F.col("n_candidates").isNull(), "no-outcome-path")
        .when(F.col("best").isNull(), "association-only")
        .when(F.col("n_best") > 1, "competing-outcomes")
        .otherwise("exact-directed-path")
    )
    states = F.create_map(*(F.lit(v) for pair in REASON_STATE.items() for v in pair))
    won = F.col("reason") == "exact-directed-path"
    named = candidates.select(F.col("node").alias("outcome_node"), F.col("outcome_type").alias("outcome_type"), F.col("status").alias("outcome_status"), F.col("event_id").alias("outcome_event_id"))
    judged = (
        costs.join(rooted.select("event_id", "start"), "event_id", "left")
        .join(verdict, "event_id", "left")
        .join(at_best, "event_id", "left")
        .withColumn("reason", reason)
        .withColumn("state", F.element_at(states, F.col("reason")))
        .withColumn("outcome_node", F.when(won, F.col("winner.node")))
        .withColumn("outcome_type", F.when(won, F.col("winner.outcome_type")))
        .withColumn("path", F.when(won, F.col("path")))
        .join(named, ["outcome_node", "outcome_type"], "left")
        .drop("start", "best", "winner", "n_best")
    )
    return judged, every


def path_evidence(attributed: DataFrame) -> DataFrame:
    """Events, links and relations on each reported path, sorted and distinct."""
    sorted_ = lambda x: F.array_sort(F.array_distinct(x))
    of = lambda kind, field: F.transform(F.filter("steps", lambda s: s["kind"] == kind), lambda s: s[field])
    return attributed.where("steps is not null").select(
        "event_id",
        sorted_(F.concat(F.array("event_id", "outcome_event_id"), F.flatten(F.transform("steps", lambda s: s["evidence_event_ids"])))).alias("event_ids"),
        sorted_(of("crosswalk", "edge_id")).alias("link_ids"),
        sorted_(F.array_compact(of("crosswalk", "revision_id"))).alias("link_record_ids"),
        sorted_(of("relation", "edge_id")).alias("relation_ids"),
        sorted_(F.array_compact(of("relation", "revision_id"))).alias("relation_record_ids"),
    )


def allocation(attributed: DataFrame) -> DataFrame:
    """Observations and money by state and reason; the states' money adds up to what was selected."""
    return attributed.groupBy("state", "reason").agg(F.count("*").alias("n"), F.sum("amount_usd").alias("amount_usd"))


def conserved(attributed: DataFrame, costs: DataFrame) -> bool:
    """Whether every selected amount is in exactly one state."""
    a = attributed.agg(F.sum("amount_usd"), F.count("*"), F.count("state")).head()
    b = costs.agg(F.sum("amount_usd"), F.count("*")).head()
    return a[0] == b[0] and a[1] == b[1] == a[2]


def rollup(attributed: DataFrame) -> DataFrame:
    """Attributed money by outcome type, reference, status and economic kind."""
    return (
        attributed.where("state = 'attributed'")
        .groupBy("outcome_type", F.col("outcome_node"), "outcome_status", "kind")
        .agg(F.sum("amount_usd").alias("amount_usd"), F.count("*").alias("n"))
    )


def cost_per_outcome(attributed: DataFrame, types: tuple[str, ...] = OUTCOME_TYPES) -> DataFrame:
    """Distinct outcomes, money and money per outcome for every type, also those without any."""
    every = attributed.sparkSession.createDataFrame([(t,) for t in types], "outcome_type string")
    sums = (
        attributed.where("state = 'attributed'")
        .groupBy("outcome_type")
        .agg(F.countDistinct("outcome_node").alias("n_outcomes"), F.sum("amount_usd").alias("amount_usd"))
    )
    joined = F.broadcast(every).join(sums, "outcome_type", "left")
    return joined.select(
        "outcome_type",
        F.coalesce("n_outcomes", F.lit(0)).alias("n_outcomes"),
        F.coalesce("amount_usd", F.lit(0).cast(MONEY)).alias("amount_usd"),
        F.round(F.try_divide(F.col("amount_usd").cast("double"), F.col("n_outcomes")), 6).alias("usd_per_outcome"),
    )
