"""Registered queries over the test tables. Sums of money are DECIMAL(38,6) and counts BIGINT at this edge."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from workledger.functions.coerce import procedure_class
from workledger.functions.text import sha256_text
from workledger.operators import accounting, attribution, effectiveness, evaluation, findings, gates, graph, memory, motifs, revisions
from workledger.plans import workbench as wb
from workledger.plans.edge import edge

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


@query
def accounting_by_kind(spark, sf):
    return edge(accounting.by_kind(wb.costs(spark, sf)))


@query
def accounting_by_basis(spark, sf):
    return edge(accounting.by_basis(wb.costs(spark, sf)))


@query
def accounting_decisions(spark, sf):
    rows = accounting.decisions(wb.costs(spark, sf))
    return edge(rows, "kind", "winner_id", "adapter", "basis", "accuracy", "amount_usd", "n_suppressed", "suppressed_usd")


@query
def accounting_suppressed(spark, sf):
    return accounting.suppressed(wb.costs(spark, sf)).select("kind", "event_id", "winner_id")


@query
def key_coverage(spark, sf):
    return edge(accounting.key_coverage(wb.costs(spark, sf)))


@query
def report_by_adapter(spark, sf):
    b = wb.base(spark, sf)
    span = b.groupBy("adapter").agg(F.count("*").alias("n_events"), F.min("ts").alias("first_at"), F.max("ts").alias("last_at"))
    sums = accounting.select_costs(wb.costs(spark, sf)).groupBy("adapter").agg(
        F.sum("amount_usd").alias("selected_usd"), F.sum("input_tokens").alias("input_tokens")
    )
    return edge(span.join(sums, "adapter", "left"))


@query
def report_by_kind(spark, sf):
    names = {"purchase": "cost", "click": "tool-call", "error": "tool-call", "signup": "gate-evidence", "view": "gate-evidence"}
    kinds = F.create_map(*(F.lit(v) for pair in names.items() for v in pair))
    return edge(wb.base(spark, sf).groupBy(F.element_at(kinds, F.col("event_type")).alias("kind")).agg(F.count("*").alias("n_events")))


@query
def coverage_gaps(spark, sf):
    c = wb.costs(spark, sf)
    fields = ("amount_usd", "authority", "accounting_key", "input_tokens")
    status = F.create_map(*(x for f in fields for x in (F.lit(f), F.when(F.col(f).isNull(), "unavailable").otherwise("recovered"))))
    rows = c.select("adapter", F.explode(status).alias("field", "status")).where("status <> 'recovered'")
    return edge(rows.groupBy("adapter", "field", "status").agg(F.count("*").alias("n")))


@query
def current_relations(spark, sf):
    now = wb.current_relations(spark, sf)
    return edge(now.groupBy("object_ns").agg(F.count("*").alias("n"), F.countDistinct("subject_val").alias("n_subjects")))


@query
def as_of_relations(spark, sf):
    rows = wb.relation_revisions(spark, sf).where("object_ns = 'git.commit'")
    now = revisions.as_of(rows, "relation_id", F.lit("1996-01-01").cast("timestamp"))
    return now.select("subject_val", "object_val")


@query
def latest_outcomes(spark, sf):
    c = attribution.outcome_candidates(wb.outcomes(spark, sf))
    return edge(c.groupBy("outcome_type", "status").agg(F.count("*").alias("n"), F.max("occurred_at").alias("last_at")))


def _attributed(spark, sf):
    """States of all costs; no query over them shows the steps that led to an outcome."""
    costs = accounting.select_costs(wb.order_costs(spark, sf))
    return attribution.states(costs, wb.calls(spark, sf), wb.outcomes(spark, sf), wb.crosswalks(spark, sf), wb.current_relations(spark, sf))


@query
def attribution_states(spark, sf):
    return edge(attribution.allocation(_attributed(spark, sf)))


@query
def cost_per_outcome(spark, sf):
    return edge(attribution.cost_per_outcome(_attributed(spark, sf)))


@query
def outcome_rollup(spark, sf):
    rows = attribution.rollup(_attributed(spark, sf))
    return edge(rows.groupBy("outcome_type", "outcome_status", "kind").agg(F.count("*").alias("n_outcomes"), F.sum("amount_usd").alias("amount_usd")))


@query
def window_allocation(spark, sf):
    return edge(effectiveness.window_allocation(_attributed(spark, sf)))


@query
def connected_refs_depth4(spark, sf):
    """How many references each call reaches within four steps."""
    now = wb.current_relations(spark, sf)
    edges = graph.crosswalk_edges(wb.crosswalks(spark, sf)).unionByName(graph.relation_edges(now))
    o = wb.table(spark, sf, "orders")
    root = F.concat(F.lit("somm.call\x01"), F.col("o_orderkey").cast("string"))
    reached = graph.reachable(o.select(root.alias("root"), root.alias("node")), edges, 4)
    sizes = reached.groupBy("root").agg(F.count("*").alias("size"))
    return edge(sizes.groupBy("size").agg(F.count("*").alias("n")))


@query
def event_family_size(spark, sf):
    """Sizes of the families that events form with their sessions."""
    b = wb.base(spark, sf)
    rows = b.select(F.concat(F.lit("e"), F.col("raw_id")).alias("event_id"), F.col("session_native").alias("session_id"), F.lit(None).cast("string").alias("parent_event_id"))
    sizes = graph.event_families(rows).groupBy("root").agg(F.count("*").alias("size"))
    return edge(sizes.groupBy("size").agg(F.count("*").alias("n")))


GATE = gates.GateConfig(wb.SINCE, wb.CUTOFF, remint_threshold=6)


def _gate(spark, sf, rule):
    rows = gates.gate_assessments(wb.gates(spark, sf), GATE).where(F.col("rule") == rule)
    return edge(rows.groupBy("state", "reason").agg(F.count("*").alias("n"), F.sum("mint_count").alias("mints"), F.sum("supporting_count").alias("supporting")))


@query
def gate_condition_resolved(spark, sf):
    return _gate(spark, sf, "condition-resolved")


@query
def gate_reminted(spark, sf):
    return _gate(spark, sf, "reminted")


@query
def gate_old_unconsulted(spark, sf):
    return _gate(spark, sf, "old-unconsulted")


def _facets(spark, sf):
    b = wb.base(spark, sf).where("event_type = 'purchase' and value > 450")
    ends = b.select(F.lit(None).cast("string").alias("event_id"), "session_id", F.when(F.col("k") % 4 == 0, "failed").otherwise("succeeded").alias("status"))
    return motifs.failure_facets(wb.sessions(spark, sf), wb.tools(spark, sf), ends)


@query
def failure_facets(spark, sf):
    f = _facets(spark, sf)
    return edge(
        f.select("session_id", "tool_attempts", "failed_tool_attempts", "repeated_tool", "repeated_failed_tool", "repeated_failure_fingerprint",
                 F.array_join("error_categories", ",").alias("errors"), F.array_join("outcome_statuses", ",").alias("outcomes"))
    )


@query
def retry_storm_sessions(spark, sf):
    return edge(_facets(spark, sf).where(motifs.supports(F.lit("retry-storm"))).groupBy("adapter").agg(F.count("*").alias("n")))


@query
def permission_loop_sessions(spark, sf):
    return edge(_facets(spark, sf).where(motifs.supports(F.lit("permission-loop"))).groupBy("adapter").agg(F.count("*").alias("n")))


@query
def memory_dispositions(spark, sf):
    rows = memory.memory_audit(wb.memory(spark, sf), wb.MEMORY_CUTOFF)
    return edge(rows.select("system", "item_id", "loaded", "retrieved", "referenced", "applied", "superseded_by", "disposition", "reason"))


@query
def memory_coverage(spark, sf):
    return edge(memory.memory_coverage(memory.memory_audit(wb.memory(spark, sf), wb.MEMORY_CUTOFF)))


def _cases(spark, sf):
    i = F.col("doc_id")
    return wb.table(spark, sf, "labels").select(
        i.alias("case_id"), wb.pick(("tuning", "held-out", "calibration"), i % 3).alias("partition"), (F.col("quality") == 1).alias("expected"),
        F.when(i % 7 != 0, F.col("toxic") == 0).alias("predicted"), F.array((i % 100).cast("string")).alias("coordinates"),
    )


@query
def evaluation_metrics(spark, sf):
    rows = evaluation.decide(evaluation.metrics(_cases(spark, sf), "partition"))
    return edge(rows)


@query
def evaluation_leakage(spark, sf):
    return edge(evaluation.leakage(_cases(spark, sf), "coordinates"))


def _receipt_costs(r):
    """One cost for every receipt whose turn is even, by its length of coordinate."""
    even = F.element_at(F.split("coordinate", "/"), 2).cast("int") % 2 == 0
    return r.where(even).select("coordinate", F.lit(1).cast("long").alias("n"), F.char_length("coordinate").cast("decimal(38,18)").alias("amount_usd"))


@query
def receipt_coverage(spark, sf):
    r = wb.receipts(spark, sf)
    held = r.select("coordinate", F.explode("call_ids").alias("call_id")).where("call_id like '%-0' or call_id like '%-2'")
    return edge(effectiveness.call_coverage(r, held.groupBy("call_id").agg(F.min("coordinate").alias("coordinate"))))


@query
def raw_outcome_dimensions(spark, sf):
    r = wb.receipts(spark, sf)
    return edge(effectiveness.raw_dimensions(r, _receipt_costs(r)))


@query
def chain_gaps(spark, sf):
    return edge(effectiveness.gap_counts(wb.receipts(spark, sf)))


@query
def semantic_funnel(spark, sf):
    r = wb.receipts(spark, sf)
    return edge(effectiveness.funnel(effectiveness.chains(r, _receipt_costs(r))))


def _pairs(spark, sf):
    c = wb.table(spark, sf, "conversations")
    return c.select("conv_id", "turn", "role", F.ceil(F.col("turn") / 2).cast("long").alias("call"))


@query
def tool_pairing(spark, sf):
    """User turns as tool uses paired with the assistant turns of the same call."""
    p = _pairs(spark, sf)
    use = p.where("role = 'user'").groupBy("conv_id", "call").agg(F.min("turn").alias("used_at"))
    result = p.where("role = 'assistant'").groupBy("conv_id", "call").agg(F.min("turn").alias("answered_at"))
    return edge(use.join(result, ["conv_id", "call"]).where("answered_at > used_at"))


@query
def orphan_results(spark, sf):
    p = _pairs(spark, sf)
    use, result = (p.where(F.col("role") == r).select("conv_id", "call").distinct() for r in ("user", "assistant"))
    orphans = result.join(use, ["conv_id", "call"], "left_anti").withColumn("problem", F.lit("orphan"))
    return edge(orphans.unionByName(use.join(result, ["conv_id", "call"], "left_anti").withColumn("problem", F.lit("deferred"))))


@query
def turn_protection(spark, sf):
    c = wb.table(spark, sf, "conversations")
    return edge(c.select("conv_id", "turn", "role", sha256_text("text").alias("content_sha256"), F.char_length("text").alias("content_chars")))


@query
def append_replay_conflict(spark, sf):
    """Half of the documents are stored; the whole comes in with some lengths changed."""
    d = wb.table(spark, sf, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    top = d.agg(F.max("doc_id").alias("top"))
    stored = d.join(F.broadcast(top)).where("doc_id <= top / 2").drop("top")
    batch = d.withColumn("n_chars", F.when(F.col("doc_id") % 50 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars")))
    out = revisions.classify_append(stored, batch, "doc_id")
    return edge(out.groupBy("verdict").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id")))


def _finding_tables(spark, sf):
    """Parts as findings; suppliers' line items as action receipts."""
    p = wb.table(spark, sf, "part")
    f = p.select(
        F.col("p_partkey").cast("string").alias("finding_id"), F.concat(F.lit("r"), F.col("p_partkey")).alias("revision_id"),
        F.lit("stale-gate").alias("kind"), F.lit("lead").alias("grade"), F.lit(1).cast("long").alias("sequence"),
    )
    li = wb.table(spark, sf, "lineitem")
    predicate = F.when(F.col("l_returnflag") == "A", "refutes").when(F.col("l_returnflag") == "R", "acts_on").otherwise("evaluates")
    acts = li.groupBy("l_partkey", predicate.alias("predicate"), (F.col("l_suppkey") % 10).alias("m")).agg(F.max("l_linestatus").alias("s"))
    relations = acts.select(
        F.concat_ws("/", "l_partkey", "predicate", "m").alias("relation_id"), F.lit(findings.REVISION_NS).alias("subject_ns"),
        F.concat(F.lit("r"), F.col("l_partkey")).alias("subject_val"), "predicate", F.lit("git.commit-instance").alias("object_ns"),
        F.col("m").cast("string").alias("object_val"), F.when(F.col("s") == "O", "asserted").otherwise("refuted").alias("state"),
        F.lit(1).cast("long").alias("sequence"),
    )
    known = spark.range(10).where("id % 3 <> 0").select(
        F.concat(F.lit("e"), F.col("id")).alias("event_id"), F.lit("git.commit-instance").alias("ns"), F.col("id").cast("string").alias("val"), F.lit("git").alias("adapter")
    )
    fresh = spark.createDataFrame([("git", "git.commit-instance", "current")], "adapter string, ns string, state string")
    return f, findings.action_receipts(f, relations, known, fresh)


@query
def finding_disposition(spark, sf):
    f, receipts = _finding_tables(spark, sf)
    a = findings.finding_activity(f, receipts)
    return edge(a.groupBy("disposition", "freshness", "ever_acted_on").agg(F.count("*").alias("n"), F.sum("n_receipts").alias("n_receipts")))


@query
def procedure_outcomes(spark, sf):
    """Change of a customer's balance against the segment's mean as a score."""
    c = wb.table(spark, sf, "customer").select("c_custkey", "c_mktsegment", F.col("c_acctbal").cast("decimal(18,2)").alias("post"))
    base = c.groupBy("c_mktsegment").agg(F.max("post").alias("top"), F.min("post").alias("bottom"))
    rows = c.join(F.broadcast(base), "c_mktsegment")
    lower = F.col("c_custkey") % 2 == 0
    direction = F.when(F.col("c_custkey") % 5 == 0, None).when(lower, "lower").otherwise("higher")
    rows = rows.withColumn("direction", direction).withColumn("baseline", F.when(lower, F.col("bottom")).otherwise(F.col("top")))
    return edge(rows.groupBy("c_mktsegment", procedure_class("direction", "baseline", "post").alias("classification")).agg(F.count("*").alias("n")))


@query
def method_scores(spark, sf):
    """Quality labels as expected motifs, two seeded assignments a method."""
    l = wb.table(spark, sf, "labels").groupBy("doc_id").agg(F.min("quality").alias("q"))  # noqa: E741
    motif = F.concat(F.lit("m"), F.col("q"))
    expected = l.select(F.col("doc_id").alias("case_id"), motif.alias("motif"))
    every = l.crossJoin(F.broadcast(spark.createDataFrame([("direct", 17), ("direct", 23), ("facets", 17), ("facets", 23)], "method string, seed int")))
    wrong = (F.col("method") == "facets") & ((F.col("doc_id") + F.col("seed")) % 4 == 0)
    assigned = every.select("method", "seed", F.col("doc_id").alias("case_id"), F.when(wrong, "m9").otherwise(motif).alias("motif"))
    return evaluation.method_scores(assigned, expected)
