"""Queries from end to end: test tables written in a source's own shape, read by that source, then projected."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from workledger.functions.ids import iso_text
from workledger.operators import accounting, gates, report, revisions, views
from workledger.plans import workbench as wb
from workledger.plans.edge import edge
from workledger.shared import remove, shared_path, shuffles_end
from workledger.sources import base, registries, tables

QUERIES = {}
PART_FILES = "part-*"


def query(f):
    QUERIES[f.__name__] = f
    return f


def lines_file(rows: DataFrame, name: str) -> str:
    """Rows as files of JSON lines, nulls left out."""
    path = shared_path(rows.sparkSession, name)
    rows.select(F.to_json(F.struct("*")).alias("value")).write.text(path)
    return path


def inbox_file(spark: SparkSession, sf: str) -> str:
    """``events`` as registry entries: mints, consultations and decisions about a user's target."""
    b = wb.base(spark, sf)
    kind = F.col("event_type")
    mint, consult, decision = kind == "signup", (kind == "view") & (F.col("k") % 3 != 2), (kind == "purchase") & (F.col("value") > 200)
    user = F.col("user_id").cast("string")
    context = F.struct(
        F.when(consult, F.struct((F.col("k") % 3 == 0).alias("consulted"))).alias("gate_consultation"),
        F.when(decision, "resolved").alias("gate_decision"),
        F.when(mint & (F.col("user_id") % 20 == 1), F.concat(F.lit(" on "), user, F.lit(" "))).alias("triage_coordinate"),
    )
    rows = b.where(mint | consult | decision).select(
        F.col("raw_id").cast("string").alias("id"), F.when(decision, "decision").when(mint, "blocker").otherwise("note").alias("kind"),
        iso_text("ts").alias("ts"), F.lit("text").alias("content"), F.when(mint, F.array(F.lit("needs:human"))).alias("tags"),
        F.when(F.col("user_id") % 20 != 0, F.array(user)).otherwise(F.array(user, F.lit("other"))).alias("refs"), context.alias("context"),
    )
    return lines_file(rows, "inbox")


def hermes_tables(spark: SparkSession, sf: str) -> str:
    """``conversations`` as a session database: users speak, assistants call tools, tools answer."""
    path = shared_path(spark, "hermes")
    c = wb.table(spark, sf, "conversations").withColumn("at", (F.lit(1_700_000_000) + F.col("conv_id") * 1000 + F.col("turn")).cast("double"))
    call = F.concat_ws("-", "conv_id", F.ceil(F.col("turn") / 2).cast("long"))
    size = F.sum(F.char_length("text"))
    c.groupBy(F.col("conv_id").cast("string").alias("id")).agg(
        F.min("at").alias("started_at"), F.lit("done").alias("end_reason"), F.lit("t").alias("title"), F.lit("m1").alias("model"),
        F.when(F.min("conv_id") % 3 == 0, (size / 1000).cast("decimal(18,3)")).cast("string").alias("actual_cost_usd"),
        (size / 2000).cast("decimal(18,3)").cast("string").alias("estimated_cost_usd"), F.count("*").alias("input_tokens"), F.max("turn").alias("output_tokens"),
        F.lit(None).cast("long").alias("cache_read_tokens"), F.lit(2).cast("long").alias("cache_write_tokens"), F.lit(None).cast("long").alias("reasoning_tokens"),
        F.lit("p").alias("billing_provider"), F.when(F.min("conv_id") % 2 == 0, "payg").otherwise("subscription").alias("billing_mode"),
        F.lit(None).cast("string").alias("pricing_version"), F.lit("list").alias("cost_source"),
    ).write.parquet(f"{path}/sessions.parquet")
    assistant, other = F.col("role") == "assistant", ~F.col("role").isin("user", "assistant")
    asks = F.array(F.struct(call.alias("id"), F.struct(F.concat(F.lit("tool"), F.col("turn") % 3).alias("name"), F.lit("{}").alias("arguments")).alias("function")))
    c.select(
        F.col("turn").alias("id"), F.col("conv_id").cast("string").alias("session_id"), F.when(other, "tool").otherwise(F.col("role")).alias("role"), F.col("text").alias("content"),
        F.when(assistant, F.to_json(asks)).alias("tool_calls"), F.when(other | (F.col("role") == "user"), call).alias("tool_call_id"), F.col("at").alias("timestamp"), F.lit("stop").alias("finish_reason"),
    ).write.parquet(f"{path}/messages.parquet")
    return path


def commit_log(spark: SparkSession, sf: str) -> str:
    """``lineitem`` as an exported log: one commit an order and supplier; some records lack a field."""
    path = shared_path(spark, "log")
    made = wb.table(spark, sf, "lineitem").groupBy("l_orderkey", "l_suppkey").agg(F.min("l_shipdate").alias("at"), F.count("*").alias("n"))
    sha = F.concat_ws("-", "l_orderkey", "l_suppkey")
    fields = [sha, iso_text("at"), F.lit(""), F.lit("N"), F.lit("e"), F.lit(""), F.concat(F.lit("ships "), F.col("n").cast("string"))]
    whole = F.concat_ws("\0", *fields, F.lit("body"))
    record = F.when(F.col("l_suppkey") % 17 == 0, F.concat_ws("\0", *fields)).otherwise(whole)
    with shuffles_end(spark):
        made.select(record.alias("value")).write.option("lineSep", "\x1e").text(path)
    return path


def runner_file(spark: SparkSession, sf: str) -> str:
    """``orders`` as a runner's ledger: submissions and terminal states."""
    o = wb.table(spark, sf, "orders")
    job = F.col("o_orderkey").cast("string")
    tags = F.struct(
        F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("c"), F.col("o_custkey"))).alias("correlation_id"), F.when(F.col("o_orderkey") % 5 == 0, F.concat(F.lit("s"), job)).alias("session_id"),
        F.when(F.col("o_orderkey") % 4 == 0, (F.col("o_orderkey") - F.col("o_orderkey") % 8).cast("string")).alias("repair_of"),
    )
    sent = o.select(F.lit("submitted").alias("event"), job.alias("job_id"), iso_text("o_orderdate").alias("ts"), F.lit("codex").alias("backend"), F.lit("/w/r").alias("cwd"), tags.alias("tags"), F.lit(None).cast("string").alias("to"))
    end = F.when(F.col("o_orderstatus") == "F", "succeeded").when(F.col("o_orderstatus") == "P", "failed").otherwise("cancelled")
    ended = o.select(F.lit("status_changed").alias("event"), job.alias("job_id"), iso_text("o_orderdate").alias("ts"), F.lit("codex").alias("backend"), F.lit("/w/r").alias("cwd"), F.lit(None).cast(sent.schema["tags"].dataType).alias("tags"), end.alias("to"))
    return lines_file(sent.unionByName(ended), "ledger")


@query
def scan_gates(spark, sf):
    """Registry entries to gate evidence to assessments."""
    found = registries.inbox(spark, inbox_file(spark, sf), glob=PART_FILES)
    rows = gates.gate_assessments(views.gates_of(found.events), gates.GateConfig(wb.SINCE, wb.CUTOFF, remint_threshold=6))
    return edge(rows.groupBy("rule", "state", "reason").agg(F.count("*").alias("n"), F.sum("supporting_count").alias("supporting")))


@query
def scan_gate_links(spark, sf):
    """What the registry links and relates its gate entries to."""
    found = registries.inbox(spark, inbox_file(spark, sf), glob=PART_FILES)
    links = found.crosswalks.select(F.concat_ws(" ", "left_ns", F.lit("="), "right_ns").alias("link"), "method", F.col("left_val").alias("x"), F.col("right_val").alias("y"))
    relations = found.relations.select(F.concat_ws(" ", "subject_ns", "predicate", "object_ns").alias("link"), "method", F.col("subject_val").alias("x"), F.col("object_val").alias("y"))
    return edge(links.unionByName(relations).groupBy("link", "method").agg(F.count("*").alias("n"), F.countDistinct("x").alias("n_left"), F.countDistinct("y").alias("n_right")))


@query
def scan_gate_coordinates(spark, sf):
    found = registries.inbox(spark, inbox_file(spark, sf), glob=PART_FILES).events.where("kind = 'gate-evidence'")
    rows = found.select("event_id", "parent_event_id", "gate.coordinate", F.get_json_object("attributes", "$.coordinate_method").alias("method"))
    return rows


@query
def scan_sessions(spark, sf):
    """Report by adapter over a session database: events, time span, money and all five token columns."""
    events = tables.hermes(spark, hermes_tables(spark, sf)).events
    return edge(report.by_adapter(events))


@query
def scan_session_events(spark, sf):
    return edge(report.by_kind(tables.hermes(spark, hermes_tables(spark, sf)).events))


@query
def scan_coverage_gaps(spark, sf):
    return edge(report.coverage_gaps(tables.hermes(spark, hermes_tables(spark, sf)).events))


@query
def scan_session_costs(spark, sf):
    """Costs of sessions: basis, accuracy and kind by what the database knows of billing."""
    costs = accounting.costs_of(tables.hermes(spark, hermes_tables(spark, sf)).events)
    return edge(costs.groupBy("basis", "accuracy", "kind", "accounting_key_scope").agg(F.count("*").alias("n"), F.sum("amount_usd").alias("amount_usd")))


@query
def scan_tool_calls(spark, sf):
    """Tool uses paired with later answers, and what is left over."""
    found = tables.hermes(spark, hermes_tables(spark, sf))
    calls = views.tools_of(found.events).groupBy("tool_name", "status").agg(F.count("*").alias("n"))
    left = found.diagnostics.groupBy(F.col("code").alias("tool_name"), F.col("level").alias("status")).agg(F.count("*").alias("n"))
    return edge(calls.unionByName(left))


@query
def scan_commits(spark, sf):
    """An exported log: commits by year, their identity links, and records with too few fields."""
    found = registries.commits(spark, commit_log(spark, sf), repository="r")
    events = found.events.groupBy(F.date_format("occurred_at", "yyyy").alias("what")).agg(F.count("*").alias("n"), F.sum(F.get_json_object("attributes", "$.message_chars").cast("long")).alias("chars"))
    links = found.crosswalks.groupBy(F.concat_ws(" ", "left_ns", "right_ns").alias("what")).agg(F.count("*").alias("n"), F.sum(F.char_length("left_val")).alias("chars"))
    bad = found.diagnostics.groupBy(F.col("code").alias("what")).agg(F.count("*").alias("n"), F.lit(0).cast("long").alias("chars"))
    return edge(events.unionByName(links).unionByName(bad))


@query
def scan_runner_links(spark, sf):
    """A runner's ledger: the identities it links its jobs to."""
    links = registries.runner(spark, runner_file(spark, sf), glob=PART_FILES).crosswalks
    return links.select("left_ns", "left_val", "right_ns", "right_val", "method")


@query
def scan_runner_outcomes(spark, sf):
    events = registries.runner(spark, runner_file(spark, sf), glob=PART_FILES).events
    rows = views.outcomes_of(events).join(views.sessions_of(events).select("session_id", "project", "harness"), "session_id")
    return edge(rows.groupBy("outcome_type", "status", "project", "harness").agg(F.count("*").alias("n"), F.max("occurred_at").alias("last_at")))


def _calls(spark, sf):
    """``orders`` as the gateway's call ledger."""
    o = wb.table(spark, sf, "orders")
    key = F.col("o_orderkey")
    return o.select(
        key.cast("string").alias("id"), iso_text("o_orderdate").alias("ts"), F.lit("p").alias("provider"), F.concat(F.lit("m"), key % 3).alias("model"),
        F.when(F.col("o_orderstatus") == "F", "ok").otherwise("timeout").alias("outcome"), F.col("o_totalprice").cast("decimal(18,2)").cast("string").alias("cost_usd"),
        F.when(key % 4 != 0, F.col("o_custkey").cast("string")).alias("session_id"), F.when(key % 3 == 0, F.concat(F.lit("k"), key)).alias("correlation_id"),
        F.when(key % 2 == 0, F.concat(F.lit("req"), key)).alias("provider_request_id"), F.lit(None).cast("string").alias("cost_basis"),
    )


@query
def scan_gateway(spark, sf):
    """The gateway's calls: sessions by first sighting, model calls by status, costs by scope."""
    events = tables.gateway_calls(spark, _calls(spark, sf)).events
    what = F.coalesce("model_call.status", F.concat_ws(" ", "cost.basis", "cost.kind", "cost.accounting_key_scope"))
    return edge(events.groupBy("kind", F.nullif(what, F.lit("")).alias("what")).agg(F.count("*").alias("n"), F.sum("cost.amount_usd").alias("amount_usd"), F.min("occurred_at").alias("first_at")))


@query
def scan_report(spark, sf):
    """Three sources and one that is not there, in a window: how each run went, and what is fresh."""
    roots = {"git": commit_log(spark, sf), "hermes": hermes_tables(spark, sf), "codex": shared_path(spark, "nothing"), "opencode": shared_path(spark, "nothing")}
    found, runs = base.ingest_all(spark, {k: v for k, v in roots.items() if k != "codex"}, since="1996-01-01T00:00:00Z")
    fresh = report.freshness(runs)
    stored = found.events.groupBy("adapter").agg(F.count("*").alias("stored"))
    shown = runs.join(fresh, "adapter").join(stored, "adapter", "left")
    return edge(shown.select("adapter", "status", "state", "sources_failed", "sources_outside_window", "n_events", "n_crosswalks", F.coalesce("stored", F.lit(0)).alias("stored")))


@query
def scan_numbered_links(spark, sf):
    """Link revisions from a log get distinct, dense numbers in time order; each link's last one is current."""
    log = commit_log(spark, sf)
    found, _ = base.ingest_all(spark, {"git": log})
    remove(spark, log)  # what was read of it is stored
    links = found.crosswalks.select("link_id", "record_id", "sequence", "state")
    now = revisions.current(links, "link_id")
    order = links.agg(F.count("*").alias("n"), F.countDistinct("sequence").alias("n_numbers"), F.min("sequence").alias("least"), F.max("sequence").alias("most"))
    return edge(order.join(F.broadcast(now.agg(F.count("*").alias("n_current")))))


BASE = """
b AS (
    SELECT event_id AS id, ts, user_id, event_type, value, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events),
g AS (
    SELECT *, CASE WHEN event_type = 'signup' THEN 'mint' WHEN event_type = 'view' AND k % 3 <> 2 THEN 'consult'
        WHEN event_type = 'purchase' AND value > 200 THEN 'decision' END AS evidence,
        CASE WHEN event_type = 'signup' AND user_id % 20 = 1 THEN concat('context=on ', user_id) WHEN user_id % 20 <> 0 THEN concat('target=', user_id) END AS coordinate,
        CASE WHEN event_type = 'signup' AND user_id % 20 = 1 THEN 'explicit-context' WHEN user_id % 20 <> 0 THEN 'exact-target' ELSE 'ambiguous-target' END AS method
    FROM b WHERE event_type = 'signup' OR event_type = 'view' AND k % 3 <> 2 OR event_type = 'purchase' AND value > 200)
"""
EVT = "concat('evt_', left(sha256(concat_ws(chr(0), 'george', '{}', CAST(id AS VARCHAR))), 24))"
C = """
c AS (
    SELECT *, CASE WHEN role IN ('user', 'assistant') THEN role ELSE 'tool' END AS said, CAST(ceil(turn / 2.0) AS BIGINT) AS call FROM conversations),
s AS (
    SELECT conv_id, count(*) AS n, max(turn) AS top, min(turn) AS low, sum(length(text)) AS size FROM conversations GROUP BY 1),
usd AS (
    SELECT *, CASE WHEN conv_id % 3 = 0 THEN round(size / 1000.0, 3) ELSE round(size / 2000.0, 3) END AS usd FROM s),
use AS (SELECT conv_id, call, min(turn) AS at, arg_min(concat('tool', turn % 3), turn) AS tool FROM c WHERE said = 'assistant' GROUP BY ALL),
ans AS (SELECT conv_id, call, min(turn) AS at FROM c WHERE said = 'tool' GROUP BY ALL),
met AS (SELECT use.* FROM use JOIN ans USING (conv_id, call) WHERE ans.at > use.at)
"""
LOG = """
m AS (
    SELECT l_orderkey, l_suppkey, min(l_shipdate) AS made, count(*) AS n, concat(l_orderkey, '-', l_suppkey) AS sha FROM lineitem GROUP BY 1, 2)
"""
N = "CAST({} AS BIGINT)".format
D = "CAST({} AS DECIMAL(38,6))".format

ORACLES = {
    "scan_gates": f"""WITH {BASE},
        i AS (SELECT * FROM g WHERE ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-01-31'),
        w AS (SELECT i.* REPLACE (coalesce(t.coordinate, i.coordinate) AS coordinate) FROM i
            LEFT JOIN i t ON i.evidence <> 'mint' AND t.evidence = 'mint' AND t.coordinate IS NOT NULL AND i.coordinate = concat('target=', t.id)),
        d AS (SELECT coordinate, max(n) AS size FROM (SELECT coordinate, count(*) OVER (PARTITION BY coordinate ORDER BY ts RANGE BETWEEN INTERVAL 7 DAY PRECEDING AND CURRENT ROW) AS n
            FROM w WHERE evidence = 'mint' AND coordinate IS NOT NULL) GROUP BY 1),
        f AS (SELECT coordinate, count_if(evidence = 'mint') AS mints, count_if(evidence = 'decision') AS solved, count_if(evidence = 'consult') AS consults,
            count_if(evidence = 'consult' AND k % 3 = 0) AS yes, count_if(evidence = 'consult' AND k % 3 = 1) AS no, min(CASE WHEN evidence = 'mint' THEN ts END) AS first
            FROM w WHERE coordinate IS NOT NULL GROUP BY 1 HAVING count_if(evidence = 'mint') > 0),
        j AS (SELECT f.*, size, epoch(TIMESTAMP '2024-01-31' - first) / 86400 AS age FROM f JOIN d USING (coordinate)),
        r AS (
            SELECT 'condition-resolved' AS rule, CASE WHEN solved > 0 THEN 'detected' ELSE 'not-detected' END AS state,
                CASE WHEN solved > 0 THEN 'resolution-receipt' ELSE 'no-resolution' END AS reason, solved AS supporting FROM j
            UNION ALL SELECT 'reminted', CASE WHEN size >= 6 THEN 'detected' ELSE 'not-detected' END, CASE WHEN size >= 6 THEN 'remint-threshold' ELSE 'below-threshold' END, 0 FROM j
            UNION ALL SELECT 'old-unconsulted', CASE WHEN solved > 0 OR age < @OLD OR yes > 0 THEN 'not-detected' WHEN no > 0 THEN 'detected' ELSE 'abstain' END,
                CASE WHEN solved > 0 THEN 'already-resolved' WHEN age < @OLD THEN 'too-young' WHEN yes > 0 THEN 'consulted' WHEN no > 0 THEN 'explicit-not-consulted' ELSE 'consultation-unknown' END, consults FROM j
            UNION ALL SELECT unnest(['condition-resolved', 'reminted', 'old-unconsulted']), 'abstain', 'coordinate-ambiguous', 0 FROM w WHERE evidence = 'mint' AND coordinate IS NULL)
        SELECT rule, state, reason, {N("count(*)")} AS n, {N("sum(supporting)")} AS supporting FROM r GROUP BY ALL""",
    "scan_gate_links": f"""WITH {BASE}, v AS (SELECT *, CASE WHEN evidence = 'mint' THEN 'george.gate-mint' ELSE 'george.gate-event' END AS view FROM g),
        l AS (
            SELECT concat('george.entry = ', view) AS link, 'explicit' AS method, id AS x, CAST(id AS VARCHAR) AS y FROM v
            UNION ALL SELECT concat(view, CASE WHEN evidence = 'mint' THEN ' part_of' ELSE ' evaluates' END, ' george.gate'), 'source_receipt', id, coordinate FROM v WHERE coordinate IS NOT NULL)
        SELECT link, method, {N("count(*)")} AS n, {N("count(DISTINCT x)")} AS n_left, {N("count(DISTINCT y)")} AS n_right FROM l GROUP BY ALL""",
    "scan_gate_coordinates": f"""WITH {BASE} SELECT {EVT.format("gate-evidence")} AS event_id, {EVT.format("outcome")} AS parent_event_id, coordinate, method FROM g""",
    "scan_sessions": f"""WITH {C}, n AS (SELECT count(*) + (SELECT 2 * count(*) FROM s) + (SELECT count(*) FROM met) + count_if(said = 'assistant') AS n,
            min(conv_id * 1000 + turn) AS lo, max(conv_id * 1000 + turn) AS hi FROM c WHERE said <> 'tool' AND text <> '')
        SELECT 'hermes' AS adapter, {N("any_value(n.n)")} AS n_events, to_timestamp(1700000000 + min(conv_id * 1000 + low)) AS first_at,
            to_timestamp(1700000000 + any_value(hi)) AS last_at, {D("sum(usd)")} AS selected_usd, {N("sum(usd.n)")} AS input_tokens, {N("sum(top)")} AS output_tokens,
            {N("0")} AS cached_input_tokens, {N("2 * count(*)")} AS cache_write_tokens, {N("0")} AS reasoning_tokens FROM usd, n""",
    "scan_session_events": f"""WITH {C} SELECT 'session' AS kind, {N("count(*)")} AS n_events FROM s UNION ALL SELECT 'cost', count(*) FROM s
        UNION ALL SELECT 'turn', count(*) FROM c WHERE said <> 'tool' AND text <> '' UNION ALL SELECT 'model-call', count(*) FROM c WHERE said = 'assistant' UNION ALL SELECT 'tool-call', count(*) FROM met HAVING count(*) > 0""",
    "scan_coverage_gaps": f"""WITH {C}, k AS (
            SELECT unnest(['session.project', 'session.working_directory', 'cost.cached_input_tokens', 'cost.reasoning_tokens']) AS field, 'unavailable' AS status, (SELECT count(*) FROM s) AS n
            UNION ALL SELECT 'turn.content', 'redacted', count(*) FROM c WHERE said <> 'tool' AND text <> ''
            UNION ALL SELECT 'model-call.provider', 'unavailable', count(*) FROM c WHERE said = 'assistant'
            UNION ALL SELECT unnest(['tool-call.input', 'tool-call.output']), 'redacted', (SELECT count(*) FROM met)
            UNION ALL SELECT 'tool-call.error', 'unavailable', (SELECT count(*) FROM met))
        SELECT 'hermes' AS adapter, field, status, {N("n")} AS n FROM k WHERE n > 0""",
    "scan_session_costs": f"""WITH {C} SELECT CASE WHEN conv_id % 3 = 0 THEN 'reported' ELSE 'computed' END AS basis, CASE WHEN conv_id % 3 = 0 THEN 'actual' ELSE 'estimated' END AS accuracy,
            CASE WHEN conv_id % 2 = 0 THEN 'marginal' ELSE 'notional' END AS kind, 'source' AS accounting_key_scope, {N("count(*)")} AS n, {D("sum(usd)")} AS amount_usd FROM usd GROUP BY ALL""",
    "scan_tool_calls": f"""WITH {C} SELECT tool AS tool_name, 'succeeded' AS status, {N("count(*)")} AS n FROM met GROUP BY ALL
        UNION ALL SELECT 'orphan-tool-result', 'info', count(*) FROM ans ANTI JOIN met USING (conv_id, call) HAVING count(*) > 0
        UNION ALL SELECT 'open-tool-call', 'info', count(*) FROM use ANTI JOIN met USING (conv_id, call) HAVING count(*) > 0""",
    "scan_commits": f"""WITH {LOG}, ok AS (SELECT * FROM m WHERE l_suppkey % 17 <> 0)
        SELECT strftime(made, '%Y') AS what, {N("count(*)")} AS n, {N("sum(length(concat('ships ', n)) + 6)")} AS chars FROM ok GROUP BY 1
        UNION ALL SELECT 'git.commit git.commit-instance', count(*), sum(length(sha)) FROM ok
        UNION ALL SELECT 'bad-commit', count(*), 0 FROM m WHERE l_suppkey % 17 = 0 HAVING count(*) > 0""",
    "scan_runner_links": """WITH x AS (
            SELECT o_orderkey AS k, 'correlation' AS ns, CAST(o_orderkey AS VARCHAR) AS v FROM orders
            UNION SELECT o_orderkey, 'correlation', concat('c', o_custkey) FROM orders WHERE o_orderkey % 3 = 0
            UNION SELECT o_orderkey, 'correlation', concat('s', o_orderkey) FROM orders WHERE o_orderkey % 5 = 0)
        SELECT ns AS left_ns, v AS left_val, 'fab.job' AS right_ns, CAST(k AS VARCHAR) AS right_val, 'explicit' AS method FROM x
        UNION ALL SELECT 'fab.job', least(a, b), 'fab.job', greatest(a, b), 'explicit' FROM (
            SELECT CAST(o_orderkey AS VARCHAR) AS a, CAST(o_orderkey - o_orderkey % 8 AS VARCHAR) AS b FROM orders WHERE o_orderkey % 8 = 4)""",
    "scan_runner_outcomes": f"""SELECT 'fab.job' AS outcome_type, CASE o_orderstatus WHEN 'F' THEN 'succeeded' WHEN 'P' THEN 'failed' ELSE 'abandoned' END AS status, 'r' AS project, 'codex' AS harness,
            {N("count(*)")} AS n, CAST(max(o_orderdate) AS TIMESTAMPTZ) AS last_at FROM orders GROUP BY ALL""",
    "scan_gateway": f"""SELECT 'session' AS kind, NULL AS what, {N("count(DISTINCT o_custkey)")} AS n, {D("NULL")} AS amount_usd, CAST(min(o_orderdate) AS TIMESTAMPTZ) AS first_at FROM orders WHERE o_orderkey % 4 <> 0
        UNION ALL SELECT 'model-call', CASE WHEN o_orderstatus = 'F' THEN 'succeeded' ELSE 'failed' END, count(*), NULL, min(o_orderdate) FROM orders GROUP BY ALL
        UNION ALL SELECT 'cost', concat('computed unknown ', CASE WHEN o_orderkey % 2 = 0 THEN 'shared' ELSE 'source' END), count(*), {D("sum(CAST(o_totalprice AS DECIMAL(18,2)))")}, min(o_orderdate) FROM orders GROUP BY ALL""",
    "scan_report": f"""WITH {LOG}, {C}, ok AS (SELECT * FROM m WHERE l_suppkey % 17 <> 0),
        h AS (SELECT count(*) + (SELECT 2 * count(*) FROM s) + (SELECT count(*) FROM met) + count_if(said = 'assistant') AS n FROM c WHERE said <> 'tool' AND text <> '')
        SELECT 'git' AS adapter, 'ok' AS status, CASE WHEN count_if(made < TIMESTAMP '1996-01-01') = 0 THEN 'current' ELSE 'unknown' END AS state, {N("0")} AS sources_failed,
            {N("2 * count_if(made < TIMESTAMP '1996-01-01')")} AS sources_outside_window, {N("count_if(made >= TIMESTAMP '1996-01-01')")} AS n_events, {N("count_if(made >= TIMESTAMP '1996-01-01')")} AS n_crosswalks,
            {N("count_if(made >= TIMESTAMP '1996-01-01')")} AS stored FROM ok
        UNION ALL SELECT 'hermes', 'ok', 'current', 0, 0, n, 0, n FROM h
        UNION ALL SELECT 'opencode', 'error', 'unknown', 1, 0, 0, 0, 0""",
    "scan_numbered_links": f"""WITH {LOG} SELECT {N("count(*)")} AS n, {N("count(*)")} AS n_numbers, {N("0")} AS least, {N("count(*) - 1")} AS most, {N("count(*)")} AS n_current FROM m WHERE l_suppkey % 17 <> 0""",
}
ORACLES["scan_gates"] = ORACLES["scan_gates"].replace("@OLD", str(gates.GateConfig(wb.SINCE, wb.CUTOFF).old_after_days))
