"""Queries that gather evidence across sources: receipts of failing sessions, activity of identities, outcome tuples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from workledger.functions.ids import event_id, ref, relation_id, stable_id
from workledger.operators import accounting, activity, attribution, evaluation, motifs, research, surfacing
from workledger.plans import oracles
from workledger.plans import workbench as wb
from workledger.plans.edge import edge
from workledger.plans.queries import _receipt_costs
from workledger.plans.scans import N, lines_file
from workledger.schema import RECEIPT_OUTCOME

QUERIES, ORACLES = {}, {}
CUTOFF = "1997-01-01"


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


def _id(adapter: str, kind: str, value) -> F.Column:
    return event_id(F.lit(adapter), F.lit(kind), value)


def job_events(spark, sf) -> DataFrame:
    """``orders`` as a runner's jobs: a session each, its outcome, and for every third one a check of that outcome later."""
    o = wb.table(spark, sf, "orders")
    job, at, none = F.col("o_orderkey"), F.col("o_orderdate").cast("timestamp"), F.lit(None).cast("string")
    session, outcome = _id("fab", "session", job), _id("fab", "outcome", job)
    rows = [
        o.select(session.alias("event_id"), F.lit("session").alias("kind"), at.alias("occurred_at"), none.alias("session_id"), none.alias("parent_event_id")),
        o.select(outcome.alias("event_id"), F.lit("outcome").alias("kind"), at.alias("occurred_at"), session.alias("session_id"), none.alias("parent_event_id")),
        # the check hangs on a run that no source has stored
        o.where("o_orderkey % 3 = 0").select(_id("fab", "outcome", F.concat(F.lit("v"), job)).alias("event_id"), F.lit("outcome").alias("kind"), (at + F.expr("interval 1 day")).alias("occurred_at"), none.alias("session_id"), F.concat(F.lit("run-"), job).alias("parent_event_id")),
        o.where("o_orderkey % 3 = 0").select(_id("fab", "turn", job).alias("event_id"), F.lit("turn").alias("kind"), at.alias("occurred_at"), session.alias("session_id"), F.concat(F.lit("run-"), job).alias("parent_event_id")),
    ]
    out = rows[0]
    for part in rows[1:]:
        out = out.unionByName(part)
    return out.withColumn("outcome", F.when(F.col("kind") == "outcome", F.struct(F.lit("fab.job").alias("outcome_type"), F.lit("succeeded").alias("status"))))


def _links(rows: DataFrame, left: str, x, right: str, y) -> DataFrame:
    none = F.array().cast("array<string>")
    return rows.select(
        F.lit(left).alias("left_ns"), x.cast("string").alias("left_val"), F.lit(right).alias("right_ns"), y.cast("string").alias("right_val"),
        stable_id("xwl", F.lit(left), x, F.lit(right), y).alias("link_id"), stable_id("xwr", F.lit(left), x, F.lit(right), y).alias("record_id"), none.alias("evidence_event_ids"),
    )


def order_links(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Customers' sessions joined to their orders' jobs: by a link, through a correlation, or by a relation."""
    o = wb.table(spark, sf, "orders")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    links = _links(o.where("o_orderkey % 4 = 0"), "codex.session", c, "fab.job", k)
    links = links.unionByName(_links(o.where("o_orderkey % 4 = 1"), "codex.session", c, "correlation", k)).unionByName(_links(o.where("o_orderkey % 4 = 1"), "correlation", k, "fab.job", k))
    r = o.where("o_orderkey % 4 = 2").select(
        F.lit("codex.session").alias("subject_ns"), c.cast("string").alias("subject_val"), F.lit("dispatched").alias("predicate"), F.lit("fab.job").alias("object_ns"), k.cast("string").alias("object_val"), F.array().cast("array<string>").alias("evidence_event_ids"),
    )
    r = r.withColumn("relation_id", relation_id("subject_ns", "subject_val", "predicate", "object_ns", "object_val"))
    return links, r.withColumns({"record_id": F.concat(F.lit("r"), "relation_id"), "method": F.lit("exact")})


RECEIPTS = f"""
q AS (SELECT o_custkey AS c, o_orderkey AS k, o_orderdate AS made FROM orders WHERE o_orderkey % 4 <> 3 AND o_custkey % 3 <> 0 AND o_custkey % 5 <> 0),
v AS (
    SELECT c, k, 'o' AS what FROM q WHERE made < TIMESTAMP '{CUTOFF}'
    UNION ALL SELECT c, k, 'v' FROM q WHERE k % 3 = 0 AND made + INTERVAL 1 DAY < TIMESTAMP '{CUTOFF}')
"""


def _facets(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Customers as failing sessions, of two adapters, and the receipts that every fifth one has itself."""
    c = wb.table(spark, sf, "customer").select(F.col("c_custkey").alias("c"))
    adapter = F.when(F.col("c") % 3 == 0, "unknown").otherwise("codex")
    facets = c.select(_id("codex", "session", F.col("c")).alias("session_id"), adapter.alias("adapter"), F.col("c").cast("string").alias("native_id"), "c")
    return facets, facets.where("c % 5 = 0").select("session_id", F.concat(F.lit("own-"), "native_id").alias("event_id"))


@query(f"WITH {RECEIPTS} SELECT CAST(c AS VARCHAR) AS session, {N('count(*)')} AS receipts, {N('count(DISTINCT k)')} AS jobs FROM (SELECT DISTINCT * FROM v) GROUP BY 1")
def corroborated_sessions(spark, sf):
    """Outcomes before a cutoff that links, correlations and relations lead sessions to, with their families."""
    facets, own = _facets(spark, sf)
    links, relations = order_links(spark, sf)
    events = job_events(spark, sf)
    found = motifs.corroborating_receipts(facets, own, events, links, relations, CUTOFF)
    named = found.join(facets, "session_id").join(job_events(spark, sf).select("event_id", "occurred_at", "parent_event_id"), "event_id")
    checks = F.count_if(F.col("parent_event_id").isNotNull())
    per = named.groupBy(F.col("native_id").alias("session")).agg(F.count("*").alias("receipts"), (F.count("*") - checks).alias("jobs"))
    return edge(per)


GROUPS = {"retry-storm": "c % 50 = 1", "permission-loop": "c % 30 = 3", "context-drift": "c % 30 = 0"}


@query(f"""WITH {RECEIPTS}, s AS (
        SELECT c_custkey AS c, c_custkey % 5 = 0 OR c_custkey IN (SELECT c FROM v) AS has FROM customer),
    p AS ({" UNION ALL ".join(f"SELECT '{m}' AS motif, c, has FROM s WHERE {w}" for m, w in GROUPS.items())}),
    g AS (SELECT motif, count(*) AS n, count_if(has) AS held FROM p GROUP BY 1)
    SELECT motif AS motif_id, {N("n")} AS sessions, {N("held")} AS with_receipt,
        CASE WHEN n < 3 THEN 'below-recurrence-floor' WHEN held < 2 THEN 'below-receipt-floor' WHEN n < 40 THEN 'below-aggregation-floor' ELSE 'eligible' END AS reason FROM g""")
def receipted_motifs(spark, sf):
    """Proposals over sessions, judged by the receipts that these have or that others vouch for."""
    facets, own = _facets(spark, sf)
    links, relations = order_links(spark, sf)
    found = motifs.corroborating_receipts(facets, own, job_events(spark, sf), links, relations, CUTOFF)
    receipts = motifs.session_receipts(facets, own, found)
    facets = facets.withColumns({
        "repeated_failure_fingerprint": F.lit("f"), "repeated_failed_tool": F.lit("t"), "scope_changes": F.lit(1),
        "error_categories": F.array(F.lit("permission")), "outcome_statuses": F.array(F.lit("failed")),
    })
    proposals = None
    for motif, which in GROUPS.items():
        part = facets.where(which).agg(F.lit(motif).alias("motif_id"), F.collect_list("session_id").alias("session_ids"))
        proposals = part if proposals is None else proposals.unionByName(part)
    judged = motifs.assess_proposals(proposals, facets, receipts, "surface", motifs.MotifConfig(wb.SINCE, wb.CUTOFF, receipt_floor=2, aggregation_floor=40))
    return edge(judged.select("motif_id", "sessions", "with_receipt", "reason"))


@query(f"""WITH q AS (
        SELECT concat('codex.session:', o_custkey) AS asked, o_orderkey AS k FROM orders WHERE o_orderkey % 4 <> 3 AND o_custkey IN (1, 2, 4, 5)
        UNION ALL SELECT concat('fab.job:', o_orderkey), o_orderkey FROM orders WHERE o_orderkey % 4 = 3 AND o_orderkey < 1000)
    SELECT asked, {N("sum(CASE WHEN k % 3 = 0 THEN 4 ELSE 2 END)")} AS events, {N("sum(CASE WHEN k % 3 = 0 THEN 2 ELSE 1 END)")} AS outcomes FROM q GROUP BY 1""")
def identity_activity(spark, sf):
    """What belongs to a few sessions and jobs, found from these identities alone."""
    links, relations = order_links(spark, sf)
    o = wb.table(spark, sf, "orders")
    sep = "\x01"
    sessions = o.where("o_custkey in (1, 2, 4, 5)").select(F.concat(F.lit(f"codex.session{sep}"), F.col("o_custkey").cast("string")).alias("node"))
    jobs = o.where("o_orderkey % 4 = 3 and o_orderkey < 1000").select(F.concat(F.lit(f"fab.job{sep}"), F.col("o_orderkey").cast("string")).alias("node"))
    _, events = activity.activity(sessions.union(jobs).distinct(), job_events(spark, sf), links, relations)
    counts = events.groupBy("asked").agg(F.count("*").alias("events"), F.count_if(F.col("kind") == "outcome").alias("outcomes"))
    return edge(counts.select(F.regexp_replace("asked", sep, ":").alias("asked"), "events", "outcomes"))


def _relation(rows: DataFrame, subject: str, s, predicate: str, object_: str, o) -> DataFrame:
    out = rows.select(F.lit(subject).alias("subject_ns"), s.cast("string").alias("subject_val"), F.lit(predicate).alias("predicate"), F.lit(object_).alias("object_ns"), o.cast("string").alias("object_val"))
    out = out.withColumn("relation_id", relation_id("subject_ns", "subject_val", "predicate", "object_ns", "object_val")).distinct()
    return out.withColumns({"record_id": F.concat(F.lit("r"), "relation_id"), "method": F.lit("exact"), "evidence_event_ids": F.array().cast("array<string>")})


def tuple_sources(spark, sf) -> dict[str, DataFrame]:
    """``orders`` as calls, some native, some of a session, some of neither; their jobs made commits, partly through attempts."""
    o = wb.table(spark, sf, "orders").withColumn("k", F.col("o_orderkey"))
    k, none = F.col("k"), F.lit(None).cast("string")
    session = F.when(k % 8 == 0, _id("claude-code", "session", k))
    attributes = F.to_json(F.struct(F.when(k % 9 != 0, F.concat(F.lit("w"), k % 2)).alias("workload_id"), F.when(k % 9 == 0, "p").alias("prompt_id"), F.when(k % 4 != 0, "native").alias("origin")))
    backend = F.to_json(F.struct(F.when(k % 12 != 0, "codex").alias("backend")))
    call, cost = F.struct(F.lit("m").alias("model")), F.struct(F.when(k % 11 == 0, "m2").alias("model"))
    blank = {"model_call": call, "cost": cost, "session": F.struct(F.lit("claude").alias("harness"))}

    def event(rows, adapter, kind, native, session_id=none, parent=none, attributes=F.lit("{}"), payload=None):
        ids = _id(adapter, kind, native)
        return rows.select(
            ids.alias("event_id"), F.lit(kind).alias("kind"), F.lit(adapter).alias("adapter"), native.cast("string").alias("native_id"), session_id.alias("session_id"), parent.alias("parent_event_id"), attributes.alias("attributes"),
            *((c if n == payload else F.when(F.lit(False), c)).alias(n) for n, c in blank.items()),
        )

    tried, own = o.where("k % 6 = 0"), F.concat(F.lit("a"), k)
    commit, second = F.concat(F.lit("g"), F.floor(k / 16).cast("string")), F.concat(F.lit("x"), k)
    events = event(o, "somm", "model-call", k, session_id=session, attributes=attributes, payload="model_call").unionByName(event(o, "somm", "cost", k, parent=_id("somm", "model-call", k), payload="cost"))
    events = events.unionByName(event(o.where("k % 8 = 0"), "claude-code", "session", k, payload="session")).unionByName(event(tried, "fab", "outcome", own, attributes=backend))
    straight, twice = o.where("k % 6 <> 0 and k % 5 <> 0"), o.where("k % 7 = 0")
    relations = _relation(o, "fab.job", k, "produced", "somm.call", k).unionByName(_relation(straight, "fab.job", k, "produced", "git.commit", commit))
    relations = relations.unionByName(_relation(twice, "fab.job", k, "produced", "git.commit", second)).unionByName(_relation(tried, "fab.attempt", own, "produced", "git.commit", commit))

    def outcome(rows, adapter, kind, value, reference):
        at = F.lit("2024-01-01").cast("timestamp").alias("occurred_at")
        return rows.select(_id(adapter, "outcome", value).alias("event_id"), F.lit(adapter).alias("adapter"), value.cast("string").alias("native_id"), at, F.lit(kind).alias("outcome_type"), F.lit("succeeded").alias("status"), reference.cast("string").alias("reference")).distinct()

    outcomes = outcome(o, "git", "git.commit", commit, commit).unionByName(outcome(twice, "git", "git.commit", second, second)).unionByName(outcome(tried, "fab", "fab.attempt", own, k))
    costs = wb.order_costs(spark, sf).withColumn("parent_event_id", _id("somm", "model-call", F.col("native_id")))
    return {"events": events, "relations": relations, "outcomes": outcomes, "costs": costs}


TUPLES = """
t AS (
    SELECT o_orderkey AS k, k // 16 AS g, o_totalprice AS usd, CASE WHEN k % 9 = 0 THEN 'p' ELSE 'w' || k % 2 END AS profile, CASE WHEN k % 11 = 0 THEN 'm2' ELSE 'm' END AS model,
        CASE WHEN k % 6 = 0 AND k % 12 <> 0 THEN 'codex' WHEN k % 8 = 0 THEN 'claude' WHEN k % 4 <> 0 THEN 'somm' END AS harness,
        k % 6 = 0 OR k % 5 <> 0 AS one, k % 6 <> 0 AND k % 5 <> 0 AND k % 7 = 0 AS leads, k % 7 = 0 AS two FROM orders),
-- a commit leads back to the other jobs that made it, and so to what else these made
i AS (
    SELECT *, count(*) OVER (PARTITION BY k) > 1 AS several FROM (
        SELECT t.*, 'g' || g AS implementation FROM t WHERE one UNION SELECT t.*, 'x' || k FROM t WHERE two
        UNION SELECT t.*, 'x' || o.k FROM t JOIN t o ON o.g = t.g AND o.leads WHERE t.one)),
f AS (
    SELECT profile, model, harness, implementation, count(*) AS n, count_if(NOT several) AS a, count_if(several) AS am, sum(CAST(usd AS DECIMAL(18,2))) AS usd
    FROM i WHERE harness IS NOT NULL GROUP BY ALL)
"""


def _observed(spark, sf):
    s = tuple_sources(spark, sf)
    links = _links(wb.table(spark, sf, "orders").where("false"), "correlation", F.lit("x"), "fab.job", F.lit("y"))
    judged, candidates, placed = attribution.judge(accounting.select_costs(s["costs"]), s["events"], s["outcomes"], links, s["relations"], ("git.commit",))
    return activity.tuple_observations(judged, candidates, placed, s["events"])


@query(f"""WITH {TUPLES}
    SELECT profile, model AS served_model, harness, implementation, {N("n")} AS observations, {N("a")} AS attributed, {N("am")} AS ambiguous, CAST(usd AS DECIMAL(38,6)) AS amount_usd,
        CASE WHEN am > 0 THEN 'confounded' WHEN a < 2 THEN 'sparse' ELSE 'ready' END AS state FROM f""")
def tuple_from_events(spark, sf):
    """Outcome tuples made from events: profile, model, harness by nearest statement, commits by attribution."""
    observed, _ = _observed(spark, sf)
    out = activity.tuple_evidence(observed, minimum=2)
    return edge(out, "profile", "served_model", "harness", "implementation", "observations", "attributed", "ambiguous", "amount_usd", "state")


@query(f"""WITH {TUPLES}
    SELECT 'kind marginal' AS part, {N("count(*)")} AS n, CAST(sum(CAST(usd AS DECIMAL(18,2))) AS DECIMAL(38,6)) AS amount_usd FROM i WHERE harness IS NOT NULL
    UNION ALL SELECT 'status succeeded', count(*), sum(CAST(usd AS DECIMAL(18,2))) FROM i WHERE harness IS NOT NULL AND NOT several
    UNION ALL SELECT 'missing', count(*), NULL FROM t WHERE harness IS NULL OR NOT (one OR two)""")
def tuple_breakdown(spark, sf):
    """Money by kind and outcomes by status over all tuples, and costs that lack a part of theirs."""
    observed, missing = _observed(spark, sf)
    parts = activity.tuple_parts(observed).groupBy(F.concat_ws(" ", "part", "name").alias("part")).agg(F.sum("n").alias("n"), F.sum("amount_usd").alias("amount_usd"))
    rest = missing.agg(F.count("*").alias("n")).select(F.lit("missing").alias("part"), "n", F.lit(None).cast("decimal(38,18)").alias("amount_usd"))
    return edge(parts.unionByName(rest))


@query(f"""WITH c AS (
        SELECT p_partkey AS i, 'r' || i % 3 AS rule, i % 2 = 0 AS good,
            CASE WHEN i % 2 = 0 THEN i % 11 <> 0 WHEN i % 3 = 1 THEN i % 5 = 1 WHEN i % 3 = 2 THEN i % 5 < 3 ELSE false END AS hit FROM part),
    m AS (SELECT rule, round(count_if(good AND hit) / count_if(hit), 6) AS precision FROM c WHERE i % 4 <> 0 GROUP BY 1)
    SELECT rule, precision, CASE WHEN precision >= 0.9 THEN 'surface' WHEN precision >= 0.7 THEN 'narrow' ELSE 'offline' END AS decision,
        {N("CASE WHEN precision >= 0.9 THEN (SELECT count_if(hit) FROM c WHERE c.rule = m.rule) ELSE 0 END")} AS shown FROM m""")
def cases_to_candidates(spark, sf):
    """A corpus read strictly, rules measured on its held-out part, and the candidates of those that may surface."""
    i = F.col("p_partkey")
    p = wb.table(spark, sf, "part").select(i, F.concat(F.lit("r"), i % 3).alias("rule"))
    label, name = F.when(i % 2 == 0, "supported").otherwise("unsupported"), lambda c: F.concat(F.lit(c), i)
    corpus = p.select(name("c").alias("case_id"), F.when(i % 4 == 0, "tuning").otherwise("held-out").alias("partition"), "rule", label.alias("label"), F.array(name("t")).alias("coordinates"), F.array(name("e")).alias("evidence"))
    cases = surfacing.read_cases(spark, lines_file(corpus, "cases"))
    hit = F.when(i % 2 == 0, i % 11 != 0).when(i % 3 == 1, i % 5 == 1).when(i % 3 == 2, i % 5 < 3).otherwise(False)
    assessed = p.select(name("c").alias("case_id"), "rule", F.when(hit, "detected").otherwise("not-detected").alias("state"))
    decided = evaluation.evaluate_gate_cases(cases, assessed, evaluation.Floors(narrow=0.7))
    shown = surfacing.to_append(assessed.where("state = 'detected'"), decided)
    counts = surfacing.state_counts(shown, "rule").select("rule", "n")
    return edge(decided.join(counts, "rule", "left").select("rule", "precision", "decision", F.coalesce("n", F.lit(0)).alias("shown")))


@query(f"""WITH c AS (
        SELECT c_custkey AS i, lpad(CAST(i AS VARCHAR), 9, '0') AS id, i % 3 = 0 AS again, i % 2 = 0 AS failed FROM customer),
    p AS (SELECT * FROM c WHERE again ORDER BY id LIMIT 40), a AS (SELECT * FROM p WHERE i % 4 <> 0 UNION ALL (SELECT * FROM c WHERE failed AND NOT again ORDER BY id LIMIT 2)),
    f AS (SELECT (SELECT count(*) FROM a) AS assigned, (SELECT count(*) FROM a WHERE again) AS correct, (SELECT count(*) FROM p WHERE i % 4 = 0) AS missed)
    SELECT {N("assigned")} AS assigned, {N("correct")} AS correct, {N("missed")} AS missed, round(correct / assigned, 6) AS precision, round(correct / (correct + missed), 6) AS recall,
        correct / assigned >= 0.9 AND abs(round(correct / (correct + missed), 6) - 0.85) <= 0.15 AS within_tolerance FROM f""")
def live_motif_check(spark, sf):
    """The first sessions with and without repeated failures, and how well assignments meet them."""
    i = F.col("c_custkey")
    id_ = F.lpad(i.cast("string"), 9, "0")
    facets = wb.table(spark, sf, "customer").select(i, id_.alias("session_id"), F.when(i % 3 == 0, "f").alias("repeated_failure_fingerprint"), F.when(i % 2 == 0, 1).otherwise(0).alias("failed_tool_attempts"))
    sample = surfacing.live_sample(facets, 40, 2)
    assigned = sample.where(~F.col("positive") | (F.col("session_id").cast("long") % 4 != 0))
    return edge(surfacing.live_metrics(sample, assigned, 0.85))


def research_events(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Conversations' receipts as stored events, some with attributes of a wrong type, and the costs attributed to them."""
    r = wb.receipts(spark, sf)
    text = lambda **fields: F.struct(*(F.col(v).alias(k) for k, v in fields.items()))
    parts = {
        "attempt": F.struct(F.lit("a").alias("namespace"), F.col("attempt").alias("attempt_id")), "authority": text(namespace="authority_namespace"),
        "domain_object": text(namespace="domain_namespace", object_type="domain_object_type", object_id="domain"), "treatment_manifest": text(namespace="treatment_namespace", manifest_sha256="manifest_sha256"),
        "outcome": text(kind="outcome_kind", judgment="judgment", error_kind="error_kind"), "supersedes_event_id": F.col("predecessor"),
    }

    def event(rows, native, workload, calls):
        attributes = F.to_json(F.struct(*(c.alias(k) for k, c in parts.items()), workload.alias("workload"), calls.alias("somm_calls")), {"ignoreNullFields": "false"})
        outcome = F.struct(F.lit(RECEIPT_OUTCOME).alias("outcome_type"), F.lit("succeeded").alias("status"), native.alias("reference"))
        return rows.select(_id("barnowl-research-outcome", "outcome", native).alias("event_id"), F.lit("outcome").alias("kind"), "occurred_at", attributes.alias("attributes"), outcome.alias("outcome"))

    calls = F.transform("call_ids", lambda c: F.struct(c.alias("call_id")))
    good = event(r, F.col("coordinate"), F.col("workload"), calls)
    first = r.where("predecessor is null")
    number = event(first, F.concat(F.lit("number-"), "coordinate"), F.lit(7), calls)
    blank = event(first.where("workload = 'w0'"), F.concat(F.lit("blank-"), "coordinate"), F.lit(None).cast("string"), calls)
    named = event(first.where("workload = 'w1'"), F.concat(F.lit("calls-"), "coordinate"), F.col("workload"), F.transform("call_ids", lambda c: F.struct(F.lit(1).alias("call_id"))))
    plain = event(first.where("workload = 'w2'"), F.concat(F.lit("plain-"), "coordinate"), F.col("workload"), F.col("workload"))
    events = good.unionByName(number).unionByName(blank).unionByName(named).unionByName(plain)
    costs = _receipt_costs(r).select(F.lit("attributed").alias("state"), F.lit(RECEIPT_OUTCOME).alias("outcome_type"), ref(RECEIPT_OUTCOME, "coordinate").alias("outcome_node"), "amount_usd")
    return events, costs


@query(oracles.ORACLES["semantic_funnel"])
def research_funnel(spark, sf):
    """The funnel of the whole report, from events and attributed costs."""
    events, costs = research_events(spark, sf)
    calls = spark.createDataFrame([], "call_id string, coordinate string")
    return edge(research.report(events, costs, calls, wb.SINCE, "2025-01-01")["funnel"])


@query(f"""WITH f AS (SELECT conv_id % 4 AS w FROM conversations WHERE turn = 0)
    SELECT 'workload' AS reason, {N("count(*) + count_if(w = 0)")} AS n FROM f UNION ALL SELECT 'somm_calls', count_if(w IN (1, 2)) FROM f""")
def research_failing(spark, sf):
    """Receipts that do not parse, by the first thing that is wrong with them."""
    events, _ = research_events(spark, sf)
    return edge(research.receipts_of(events)[1].groupBy("reason").agg(F.count("*").alias("n")))
