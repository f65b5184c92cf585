"""Queries that apply single operators to the test tables, each with its SQL beside it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from workledger.functions import coerce
from workledger.functions.ids import epoch_millis, epoch_seconds, event_id, iso_text, link_id, parse_time, ref, ref_namespace, ref_value
from workledger.functions.text import canonical_json, json_keys, text_blocks
from workledger.operators import activity, effectiveness, evaluation, findings, gates, graph, memory, motifs, quality, report, revisions
from workledger.plans import oracles as o
from workledger.plans import workbench as wb
from workledger.plans.edge import edge
from workledger.shared import written

QUERIES, ORACLES = {}, {}
N, D = o.B, o.D


def query(sql: str):
    """Registers a query and its SQL."""

    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


def text(x: str) -> Column:
    return F.col(x).cast("string")


# ---- functions -------------------------------------------------------------------------------------------------------


@query(
    f"""WITH e AS (SELECT event_id AS i, event_type, value, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)
    SELECT i AS id, CASE WHEN k % 10 <> 0 THEN CAST(k AS BIGINT) END AS whole, CASE WHEN i % 7 <> 0 THEN {D("value")} END AS money,
        CASE WHEN i % 2 = 0 THEN {D("value")} END AS not_negative, CASE WHEN i % 5 = 0 THEN k % 2 = 0 ELSE FALSE END AS flag,
        CASE k % 4 WHEN 0 THEN 'computed' WHEN 1 THEN 'reported' WHEN 2 THEN 'computed' ELSE 'unknown' END AS basis,
        CASE k % 4 WHEN 0 THEN 'estimated' WHEN 1 THEN 'actual' ELSE 'unknown' END AS accuracy, CASE k % 4 WHEN 1 THEN 'marginal' ELSE 'unknown' END AS kind,
        CASE k % 4 WHEN 0 THEN 'production' WHEN 1 THEN 'rollup' ELSE 'unknown' END AS role,
        ['included', 'notional', 'notional', 'marginal', 'unknown'][k % 5 + 1] AS billing, concat('r', k) AS project, (k % 3 = 0) AS is_attempt,
        CASE WHEN k % 3 = 0 THEN CAST(k AS VARCHAR) WHEN k % 3 = 1 THEN event_type END AS first_of,
        CASE WHEN k % 2 = 0 THEN concat('provider.request=p:q', k) ELSE concat('somm.call=', i) END AS akey, CASE WHEN k % 2 = 0 THEN 'shared' ELSE 'source' END AS ascope,
        CASE WHEN k % 4 = 0 THEN concat('act_', left(sha256(concat(CASE WHEN k % 8 = 0 THEN 'unknown' ELSE event_type END, chr(0), k)), 24)) END AS action,
        CASE WHEN k <> 0 THEN round(i * 1.0 / k, 6) END AS share, CASE WHEN k % 100 = 0 THEN CAST(k // 100 AS VARCHAR) WHEN k % 10 = 0 THEN concat(k // 100, '.', (k % 100) // 10)
            ELSE concat(k // 100, '.', lpad(CAST(k % 100 AS VARCHAR), 2, '0')) END AS plain FROM e"""
)
def coerced_values(spark, sf):
    """Every coercion of a source value, on words made from ``events``."""
    i, k = F.col("raw_id"), F.col("k")
    pick = lambda n, *words: F.element_at(F.array(*(F.lit(w) for w in words)), (k % n + 1).cast("int"))
    key, scope = coerce.accounting_key(F.lit("p"), F.when(k % 2 == 0, F.concat(F.lit("q"), k)), text("raw_id"))
    amount = F.col("value").cast("decimal(18,6)").cast("string")
    return edge(
        wb.base(spark, sf).select(
            i.alias("id"), coerce.number(F.when(k % 10 != 0, k.cast("string")).otherwise("none")).alias("whole"), coerce.money(F.when(i % 7 != 0, amount).otherwise("free")).alias("money"),
            coerce.money_or_none(F.when(i % 2 == 0, amount).otherwise(F.concat(F.lit("-1"), amount))).alias("not_negative"),
            coerce.boolean(F.when(i % 5 == 0, F.when(k % 2 == 0, " Yes ").otherwise("no"))).alias("flag"),
            coerce.cost_basis(pick(4, None, "reported", "computed", "guessed")).alias("basis"), coerce.cost_accuracy(pick(4, None, "actual", "unknown", "guessed")).alias("accuracy"),
            coerce.cost_kind(pick(4, None, "marginal", "unknown", "guessed")).alias("kind"), coerce.observation_role(pick(4, None, "rollup", "other", "guessed")).alias("role"),
            coerce.billing_kind(pick(5, "Plan-Included", "Subscription", "metered", "PAYG", "else")).alias("billing"), coerce.project_from_cwd(F.concat(F.lit("/w/r"), k, F.lit("//"))).alias("project"),
            coerce.attempt_shape(F.concat(text("raw_id"), F.when(k % 3 == 0, ":attempt:0").otherwise(":attempt"))).alias("is_attempt"),
            coerce.first_text(F.when(k % 3 == 0, k.cast("string")).otherwise(""), F.when(k % 3 == 1, F.col("event_type"))).alias("first_of"), key.alias("akey"), scope.alias("ascope"),
            coerce.failed_action(F.when(k % 8 != 0, F.col("event_type")).otherwise(""), F.when(k % 4 == 0, k.cast("string")).otherwise("")).alias("action"), coerce.ratio("raw_id", "k").alias("share"),
            coerce.plain_decimal(k / 100).alias("plain"),
        )
    )


@query(
    f"""SELECT event_id AS id, concat('evt_', left(sha256(concat('a', chr(0), 'k', chr(0), event_id)), 24)) AS eid, CAST(ts AS TIMESTAMPTZ) AS parsed, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS whole,
        CAST(date_trunc('second', ts) AS TIMESTAMPTZ) AS seconds, CAST(date_trunc('millisecond', ts) AS TIMESTAMPTZ) AS millis, 'user' AS ns, CAST(user_id AS VARCHAR) AS val,
        concat('xwl_', left(sha256(concat_ws(chr(0), 'a', CAST(user_id AS VARCHAR), 'b', CAST(event_id AS VARCHAR))), 24)) AS link FROM events"""
)
def ids_and_times(spark, sf):
    """Ids, references and the forms of time."""
    b = wb.base(spark, sf).withColumn("r", ref("user", "user_id"))
    at = iso_text("ts")
    return b.select(
        F.col("raw_id").alias("id"), event_id(F.lit("a"), F.lit("k"), "raw_id").alias("eid"), parse_time(at).alias("parsed"), F.substring(at, 1, 19).alias("whole"),
        epoch_seconds(F.floor(F.col("ts").cast("double"))).alias("seconds"), epoch_millis(F.unix_millis("ts")).alias("millis"), ref_namespace("r").alias("ns"), ref_value("r").alias("val"),
        link_id(ref("b", "raw_id"), ref("a", "user_id")).alias("link"),
    )


@query(
    f"""WITH e AS (SELECT event_id AS id, props, event_type, user_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)
    SELECT id, CASE WHEN id % 9 <> 0 THEN concat('{{"a":', k, ',"b":"', event_type, '"}}') END AS canonical, concat(event_type, '|', user_id) AS blocks, 'b,ab' AS keys,
        [ 'permission', 'rate-limit', 'timeout', 'tool-failed'][k % 4 + 1] AS category FROM e"""
)
def protected_texts(spark, sf):
    """Canonical JSON, joined text blocks, normalised keys and error categories."""
    k = F.col("k").cast("string")
    loose = F.when(F.col("raw_id") % 9 != 0, F.concat(F.lit('{ "b" : "'), F.col("event_type"), F.lit('", "a": '), k, F.lit(" }"))).otherwise("{bad")
    block = lambda kind, x: F.struct(F.lit(kind).alias("type"), x.cast("string").alias("text"))
    error = F.element_at(F.array(*(F.lit(x) for x in ("Access DENIED", "Rate is over the limit", "it timed out", "broke"))), (F.col("k") % 4 + 1).cast("int"))
    return wb.base(spark, sf).select(
        F.col("raw_id").alias("id"), canonical_json(loose).alias("canonical"),
        text_blocks(F.array(block("text", F.col("event_type")), block("image", F.lit("x")), block("text", F.col("user_id"))), "|").alias("blocks"),
        F.array_join(json_keys(F.lit('{"B": {"a_b": 1}}')), ",").alias("keys"), coerce.error_category(error).alias("category"),
    )


# ---- reports and runs ------------------------------------------------------------------------------------------------


@query(f"SELECT {N('count(*)')} AS n_events, CAST(min(ts) AS TIMESTAMPTZ) AS first_at, CAST(max(ts) AS TIMESTAMPTZ) AS last_at FROM events")
def report_totals(spark, sf):
    return edge(report.totals(wb.base(spark, sf).withColumn("occurred_at", F.col("ts"))))


@query(
    """SELECT concat('a', user_id) AS adapter, CASE WHEN arg_max(event_type, event_id) <> 'error' AND arg_max(event_id % 2, event_id) = 0 THEN 'current' ELSE 'unknown' END AS state
    FROM events GROUP BY 1"""
)
def run_freshness(spark, sf):
    """Events as runs of their user's source: only the last one tells."""
    b = wb.base(spark, sf)
    failed = F.when(F.col("event_type") == "error", "error").otherwise("ok")
    runs = b.select(F.concat(F.lit("a"), "user_id").alias("adapter"), F.col("raw_id").alias("sequence"), failed.alias("status"), (F.col("raw_id") % 2).alias("sources_failed"), F.lit(0).alias("sources_outside_window"))
    return report.freshness(runs)


# ---- graphs ----------------------------------------------------------------------------------------------------------


@query(
    f"""WITH RECURSIVE e AS (SELECT event_id AS i FROM events),
    up AS (SELECT i, i - 7 AS a, 1 AS d FROM e WHERE i % 238 >= 7 UNION ALL SELECT i, a - 7, d + 1 FROM up WHERE a % 238 >= 7),
    t AS (SELECT i, max(d) AS depth, count(*) AS n FROM up JOIN e USING (i) GROUP BY 1)
    SELECT {N("n")} AS n_ancestors, {N("count(*)")} AS n FROM t GROUP BY 1"""
)
def deep_lineage(spark, sf):
    """Events under parents seven ids before, in chains of up to 34: how many ancestors each has."""
    i = F.col("raw_id")
    events = wb.base(spark, sf).select(i.cast("string").alias("event_id"), F.when(i % 238 >= 7, i - 7).cast("string").alias("parent_event_id"), F.lit(None).cast("string").alias("session_id"))
    sizes = graph.lineage(events, events).groupBy("cost_id").agg(F.count("*").alias("n_ancestors"))
    return edge(sizes.groupBy("n_ancestors").agg(F.count("*").alias("n")))


@query(
    f"""WITH li AS (SELECT l_orderkey, l_suppkey, arg_max(l_returnflag, (l_shipdate, l_linenumber, l_partkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus)) AS flag FROM lineitem GROUP BY 1, 2),
    r AS (SELECT * FROM li WHERE flag <> 'A'), c AS (SELECT o_orderkey FROM orders WHERE o_orderkey % 10 <> 9)
    SELECT 'incoming' AS way, {N("1")} AS depth, {N("count(*)")} AS n FROM r
    UNION ALL SELECT 'outgoing', 1, (SELECT count(*) FROM r) + (SELECT count(*) FROM c)"""
)
def traversals(spark, sf):
    """From every commit inwards to its job, and from every job outwards."""
    ends = ["subject_ns", "subject_val", "predicate", "object_ns", "object_val"]
    now = written(wb.current_relations(spark, sf).select(*ends), "relations")  # a walk needs no ids
    now = now.withColumns({"relation_id": F.lit(None).cast("string"), "record_id": F.lit(None).cast("string"), "evidence_event_ids": F.array().cast("array<string>")})
    commit, job = ref(F.col("object_ns"), "object_val"), ref(F.col("subject_ns"), "subject_val")
    rows = now.where("object_ns = 'git.commit'").select(commit.alias("root"), commit.alias("node"))
    inwards = graph.traverse(rows, now, "incoming", 1, ["produced"]).where("depth > 0").select(F.lit("incoming").alias("way"), "depth")
    rows = now.select(job.alias("root"), job.alias("node"))
    outwards = graph.traverse(rows, now, "outgoing", 3).where("depth > 0").select(F.lit("outgoing").alias("way"), "depth")
    return edge(inwards.unionByName(outwards).groupBy("way", "depth").agg(F.count("*").alias("n")))


# ---- evaluation ------------------------------------------------------------------------------------------------------

CASES = "l AS (SELECT doc_id AS i, quality, toxic, concat('rule', doc_id % 3) AS rule, ['supported', 'ambiguous', 'unsupported', 'supported'][CAST(doc_id % 4 + 1 AS INT)] AS label FROM labels)"


def _gate_cases(spark, sf):
    i = F.col("doc_id")
    cases = wb.table(spark, sf, "labels").select(
        i.alias("case_id"), wb.pick(("tuning", "held-out", "calibration"), i % 3 % 2 + F.when(i % 5 == 0, 1).otherwise(0)).alias("partition"),
        F.concat(F.lit("rule"), i % 3).alias("rule"), wb.pick(("supported", "ambiguous", "unsupported", "supported"), i % 4).alias("label"),
    )
    state = F.when(F.col("quality") == 1, "detected").when(F.col("toxic") == 1, "abstain").otherwise("not-detected")
    once = wb.table(spark, sf, "labels").select(i.alias("case_id"), F.concat(F.lit("rule"), i % 3).alias("rule"), state.alias("state"))
    return cases, once.where("case_id % 11 <> 0").unionByName(once.where("case_id % 13 = 0"))


@query(
    f"""WITH {CASES}, h AS (
        SELECT *, CASE WHEN (i % 11 <> 0)::INT + (i % 13 = 0)::INT = 1 THEN CASE WHEN quality = 1 THEN 1 WHEN toxic = 1 THEN NULL ELSE 0 END END AS p,
            CASE label WHEN 'supported' THEN 1 WHEN 'ambiguous' THEN NULL ELSE 0 END AS x FROM l WHERE i % 3 % 2 + (i % 5 = 0)::INT = 1),
    m AS (SELECT rule, count(*) AS n, count_if(p = 1 AND x = 1) AS tp, count_if(p = 1 AND coalesce(x, 0) = 0) AS fp, count_if(p IS NULL) AS ab, count_if(p IS NOT DISTINCT FROM x) AS ex FROM h GROUP BY 1)
    SELECT rule, {N("n")} AS n_cases, {N("tp")} AS true_positive, {N("fp")} AS false_positive, {N("ab")} AS abstained, {N("ex")} AS exact, round(tp * 1.0 / nullif(tp + fp, 0), 6) AS precision,
        CASE WHEN tp = 0 THEN 'offline' WHEN round(tp * 1.0 / (tp + fp), 6) >= 0.9 THEN 'surface' WHEN round(tp * 1.0 / (tp + fp), 6) >= 0.8 THEN 'narrow' ELSE 'offline' END AS decision FROM m"""
)
def gate_case_metrics(spark, sf):
    """Held-out gate cases against assessments, of which some are missing or double."""
    rows = evaluation.evaluate_gate_cases(*_gate_cases(spark, sf))
    return edge(rows, "rule", "n_cases", "true_positive", "false_positive", "abstained", "exact", "precision", "decision")


@query(
    f"""WITH l AS (SELECT doc_id AS i FROM labels) SELECT 'prediction' AS missing, {N("count(*)")} AS n FROM l WHERE i % 3 % 2 + (i % 5 = 0)::INT > 0 AND i % 11 = 0 AND i % 13 <> 0
    UNION ALL SELECT 'case', sum((i % 11 <> 0)::INT + (i % 13 = 0)::INT) FROM l WHERE i % 3 % 2 + (i % 5 = 0)::INT = 0"""
)
def uncovered_cases(spark, sf):
    cases, given = _gate_cases(spark, sf)
    return edge(evaluation.uncovered(cases, given).groupBy("missing").agg(F.count("*").alias("n")))


@query("SELECT CAST(c_nationkey AS BIGINT) AS case_id, count(*) AS n FROM customer GROUP BY 1 HAVING count(*) > 1")
def repeated_case_ids(spark, sf):
    return edge(evaluation.repeated_cases(wb.table(spark, sf, "customer").select(F.col("c_nationkey").alias("case_id"))))


@query("SELECT p_brand, p_partkey FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) <= 3")
def first_of_each_class(spark, sf):
    return edge(evaluation.first_per_class(wb.table(spark, sf, "part").select("p_brand", "p_partkey"), "p_brand", "p_partkey", 3))


@query(
    """WITH a AS (SELECT p_type AS operation, p_partkey % 2 AS arm, round(avg(CAST(p_size AS DOUBLE)), 6) AS score, count_if(p_partkey % 7 = 0) AS errors FROM part GROUP BY 1, 2)
    SELECT b.operation, b.score AS baseline_score, b.errors AS baseline_errors, v.score AS variant_score, v.errors AS variant_errors, round(v.score - b.score, 6) AS delta
    FROM a b JOIN a v ON v.operation = b.operation AND b.arm = 0 AND v.arm = 1"""
)
def arm_comparison(spark, sf):
    p = F.col("p_partkey")
    calls = wb.table(spark, sf, "part").select(
        F.col("p_type").alias("operation"), F.when(p % 2 == 0, "baseline").otherwise("variant").alias("arm"), F.col("p_size").cast("double").alias("score"), F.when(p % 7 == 0, "bad").alias("error"),
    )
    return edge(evaluation.arm_summary(calls))


@query(
    f"""SELECT round((p_partkey % 2 = 0)::INT * 0.6 + ((p_partkey % 3 = 0)::INT + (p_partkey % 5 = 0)::INT + (p_partkey % 7 = 0)::INT) * 0.1, 6)::DOUBLE AS score, {N("count(*)")} AS n FROM part GROUP BY 1"""
)
def rubric_scores(spark, sf):
    p = F.col("p_partkey")
    rows = wb.table(spark, sf, "part").select((p % 2 == 0).alias("a"), *((p % k == 0).alias(f"c{k}") for k in (3, 5, 7)), F.lit(None).cast("boolean").alias("c0"))
    return edge(rows.groupBy(evaluation.rubric_score("a", ["c3", "c5", "c7", "c0"]).alias("score")).agg(F.count("*").alias("n")))


@query(
    f"""SELECT concat('cal:', doc_id) AS case_id, 'calibration' AS partition, concat('rule', doc_id % 3) AS rule, CASE WHEN quality = 1 THEN 'supported' ELSE 'unsupported' END AS label FROM labels"""
)
def later_cases(spark, sf):
    i = F.col("doc_id")
    rows = wb.table(spark, sf, "labels").select(
        text("doc_id").alias("label_id"), F.concat(F.lit("rule"), i % 3).alias("rule"), F.when(F.col("quality") == 1, "supported").otherwise("unsupported").alias("label"), F.lit("e").alias("evidence")
    )
    return evaluation.as_later_case(rows).drop("evidence")


@query(
    f"""SELECT arg_max(method, (operator_value, recall, precision, method)) AS method FROM ({o.ORACLES["method_scores"]}) WHERE precision >= 0.9 AND stability >= 0.8"""
)
def chosen_method(spark, sf):
    """Of the two methods that ``method_scores`` measures, the one above the floors."""
    from workledger.plans.queries import QUERIES as core

    return evaluation.choose_method(core["method_scores"](spark, sf))


# ---- findings --------------------------------------------------------------------------------------------------------


def _findings(spark, sf):
    """Parts as findings, some revised and some refuted later."""
    p = F.col("p_partkey")
    at = lambda day: F.lit(f"2024-01-0{day}").cast("timestamp")
    first = wb.table(spark, sf, "part").select(
        F.col("p_partkey"), F.concat(F.lit("part:"), p).alias("subject"), F.lit("stale-gate").alias("kind"), F.lit("lead").alias("grade"), F.col("p_name").alias("summary"),
        F.to_json(F.struct(F.when(p % 2 == 0, F.concat(F.lit("target="), p)).alias("coordinate"))).alias("details"),
        F.array(F.struct(F.concat(F.lit("e"), p).alias("event_id"), F.lit("x").alias("note"))).alias("evidence"), at(1).alias("recorded_at"),
    )
    rows = findings.create_revisions(first).withColumn("sequence", F.lit(1).cast("long"))
    change = rows.where(p % 3 == 0).select("finding_id", at(2).alias("recorded_at"), F.lit("candidate").alias("grade"), F.when(p % 2 == 0, "changed").alias("summary"))
    rows = rows.unionByName(findings.revise(rows, change).withColumn("sequence", F.lit(2).cast("long")))
    gone = rows.where((p % 5 == 0) & (F.col("sequence") == 1)).select("finding_id", at(3).alias("recorded_at"))
    return rows.unionByName(findings.refute(rows, gone).withColumn("sequence", F.lit(3).cast("long")))


@query(
    f"""SELECT CASE WHEN p_partkey % 5 = 0 THEN 'refuted' WHEN p_partkey % 3 = 0 THEN 'candidate' ELSE 'lead' END AS grade, CASE WHEN p_partkey % 5 = 0 THEN 3 WHEN p_partkey % 3 = 0 THEN 2 ELSE 1 END::BIGINT AS sequence,
        (p_partkey % 3 = 0 AND p_partkey % 2 = 0) AS changed, {N("count(*)")} AS n FROM part GROUP BY ALL"""
)
def finding_revisions(spark, sf):
    """Findings created, revised and refuted: the last revision of each."""
    now = revisions.latest(_findings(spark, sf), "finding_id")
    return edge(now.groupBy("grade", "sequence", (F.col("summary") == "changed").alias("changed")).agg(F.count("*").alias("n")))


@query(f"SELECT 'ok' AS error, {N('count(*) + count_if(p_partkey % 3 = 0) + count_if(p_partkey % 5 = 0)')} AS n FROM part")
def finding_chains(spark, sf):
    """Every revision against the rules of its chain."""
    bad = revisions.check_finding_chain(_findings(spark, sf))
    return edge(bad.groupBy(F.coalesce("error", F.lit("ok")).alias("error")).agg(F.count("*").alias("n")))


DOCS = "p AS (SELECT *, p_partkey % 5 = 0 AS refuted, CASE WHEN p_partkey % 3 = 0 AND p_partkey % 2 = 0 THEN 'changed' ELSE p_name END AS summary FROM part)"


@query(f"WITH {DOCS} SELECT summary, CASE WHEN p_partkey % 2 = 0 THEN concat('target=', p_partkey) ELSE 'own' END AS coordinate, {N('count(*)')} AS n FROM p GROUP BY ALL")
def candidate_exports(spark, sf):
    d = findings.candidate_documents(_findings(spark, sf))
    given = F.get_json_object("document", "$.coordinate")
    own = given == F.concat(F.lit("workledger.finding="), "finding_id")
    return edge(d.groupBy(F.get_json_object("document", "$.summary").alias("summary"), F.when(own, "own").otherwise(given).alias("coordinate")).agg(F.count("*").alias("n")))


@query(f"WITH {DOCS} SELECT concat('[\"e', p_partkey, '\"]') AS refs, summary FROM p WHERE NOT refuted")
def procedure_exports(spark, sf):
    d = findings.procedure_documents(_findings(spark, sf))
    return d.select(F.get_json_object("document", "$.occurrence_refs").alias("refs"), F.get_json_object("document", "$.summary").alias("summary"))


_ID = "concat('{}_', left(sha256(concat_ws(chr(0), {})), 24))".format
_FOUND = _ID("fnd", "'stale-gate', concat('part:', p_partkey)")


@query(f"WITH {DOCS} SELECT 'custody' AS what, {N('sum(1 + (p_partkey % 3 = 0)::INT + (p_partkey % 5 = 0)::INT)')} AS revisions, {N('sum((p_partkey % 4 = 0)::INT)')} AS receipts, {N('count(*)')} AS n, {N('count(*)')} AS n_ids, {N('0')} AS n_blank FROM p "
       f"UNION ALL SELECT 'candidate', NULL, NULL, count(*), count(*), 0 FROM p UNION ALL SELECT 'procedure', NULL, NULL, count(*), count(*), 0 FROM p WHERE NOT refuted")
def export_ids(spark, sf):
    """Exported documents carry their layout and an id that is their own; receipts stand in the custody of their finding."""
    rows = _findings(spark, sf)
    acted = rows.where("sequence = 1 and p_partkey % 4 = 0").select("finding_id", F.concat(F.lit("r"), "p_partkey").alias("relation_id"), F.lit("acts_on").alias("predicate"), F.lit(True).alias("active"), F.lit("valid").alias("validity"))
    documents = {"custody": findings.custody_documents(rows, acted), "candidate": findings.candidate_documents(rows), "procedure": findings.procedure_documents(rows)}
    out = None
    for what, d in documents.items():
        size = lambda name: F.sum(F.json_array_length(F.get_json_object("document", f"$.{name}"))).cast("long")
        own = F.get_json_object("document", "$.export_id") == F.col("export_id")
        named = F.get_json_object("document", "$.schema").endswith("/v1")
        part = d.agg(F.lit(what).alias("what"), size("history").alias("revisions"), size("receipts").alias("receipts"), F.count("*").alias("n"), F.countDistinct("export_id").alias("n_ids"), F.count_if(~(own & named)).alias("n_blank"))
        out = part if out is None else out.unionByName(part)
    return edge(out)


@query(f"WITH {DOCS}, e AS (SELECT *, CASE WHEN p_partkey % 2 = 0 THEN concat('target=', p_partkey) END AS given, {_FOUND} AS id FROM p) SELECT id AS finding_id, coalesce(given, concat('workledger.finding=', id)) AS coordinate, 'review-stale-gate' AS suggestion FROM e")
def candidate_suggestions(spark, sf):
    d = findings.candidate_documents(_findings(spark, sf))
    at = lambda path: F.get_json_object("document", path)
    return d.select("finding_id", at("$.target.coordinate").alias("coordinate"), at("$.suggestion.kind").alias("suggestion"))


@query(f"SELECT 1 + (p_partkey % 3 = 0)::INT + (p_partkey % 5 = 0)::INT AS n_revisions, {N('count(*)')} AS n FROM part GROUP BY 1")
def custody_exports(spark, sf):
    rows = _findings(spark, sf)
    none = spark.createDataFrame([], "finding_id string, relation_id string, predicate string, active boolean, validity string")
    d = findings.custody_documents(rows, none)
    size = F.json_array_length(F.get_json_object("document", "$.history"))
    return edge(d.groupBy(size.alias("n_revisions")).agg(F.count("*").alias("n"))).withColumn("n_revisions", F.col("n_revisions").cast("int"))


@query(
    f"""SELECT CASE WHEN p_partkey % 2 = 1 THEN 'insert' WHEN p_partkey % 10 = 0 THEN 'revise' ELSE 'replay' END AS verdict, {N("count(*)")} AS n FROM part GROUP BY 1"""
)
def emitted_candidates(spark, sf):
    p = F.col("p_partkey")
    rows = wb.table(spark, sf, "part").select(p, text("p_partkey").alias("finding_id"), F.col("p_name").alias("content_hash"))
    held = rows.where(p % 2 == 0).select("finding_id", F.when(p % 10 == 0, "old").otherwise(F.col("content_hash")).alias("content_hash"), F.lit("r").alias("revision_id"))
    return edge(revisions.emit_candidates(held, rows).groupBy("verdict").agg(F.count("*").alias("n")))


@query(
    f"""WITH l AS (SELECT l_partkey, count(*) AS k FROM lineitem GROUP BY 1)
    SELECT CASE WHEN k > 30 THEN 'refuted' ELSE 'asserted' END AS state, {N("count(*)")} AS n FROM l JOIN part ON p_partkey = l_partkey WHERE p_partkey % 4 <> 0 GROUP BY 1
    UNION ALL SELECT 'no receipt', count(*) FROM l JOIN part ON p_partkey = l_partkey WHERE p_partkey % 4 = 0"""
)
def related_findings(spark, sf):
    """Findings related to receipts, of which some are missing; relations of busy parts are refuted again."""
    rows = _findings(spark, sf)
    used = wb.table(spark, sf, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("k"))
    asked = rows.where("sequence = 1").join(used, F.col("p_partkey") == F.col("l_partkey")).select(
        "finding_id", F.lit("acts_on").alias("predicate"), F.lit("git.commit-instance").alias("object_ns"), text("p_partkey").alias("object_val"), F.concat(F.lit("e"), "p_partkey").alias("event_id"),
        F.lit("2024-02-01").cast("timestamp").alias("recorded_at"), "k",
    )
    events = wb.table(spark, sf, "part").where("p_partkey % 4 <> 0").select(F.concat(F.lit("e"), "p_partkey").alias("event_id"))
    made, lost = findings.relate(rows, asked, events)
    made = made.withColumns({"record_id": F.concat(F.lit("a"), "relation_id"), "sequence": F.lit(1).cast("long"), "confidence": F.lit(1.0), "note": F.lit(None).cast("string"), "supersedes": F.lit(None).cast("string")})
    busy = made.join(asked.where("k > 30"), made["object_val"] == asked["object_val"]).select("relation_id", F.lit("busy").alias("note"), F.lit("2024-03-01").cast("timestamp").alias("recorded_at"))
    undone = findings.unrelate(made, busy).withColumns({"record_id": F.concat(F.lit("b"), "relation_id"), "sequence": F.lit(2).cast("long")})
    last = revisions.latest(made.unionByName(undone), "relation_id").groupBy("state").agg(F.count("*").alias("n"))
    return edge(last.unionByName(lost.agg(F.lit("no receipt").alias("state"), F.count("*").alias("n"))))


# ---- candidates of detectors -----------------------------------------------------------------------------------------


def _detected(name: str) -> str:
    return f"SELECT n FROM ({o.ORACLES[name]}) WHERE state = 'detected'"


@query(
    f"""SELECT 'stale-gate' AS kind, 'lead' AS grade, {N("sum(n)")} AS n FROM ({_detected("gate_condition_resolved")}) HAVING count(*) > 0
    UNION ALL SELECT 'failure-motif', 'lead', sum(n) FROM ({_detected("gate_reminted")}) HAVING count(*) > 0
    UNION ALL SELECT 'memory-hygiene', 'lead', sum(n) FROM ({_detected("gate_old_unconsulted")}) HAVING count(*) > 0"""
)
def gate_findings(spark, sf):
    from workledger.plans.queries import GATE

    rows = gates.gate_candidates(gates.gate_assessments(wb.gates(spark, sf), GATE))
    return edge(rows.groupBy("kind", "grade").agg(F.count_distinct("finding_id").alias("n")))


@query(
    f"""SELECT {N("count(*)")} AS mints, {N("count_if(user_id % 20 <> 0)")} AS keyed, count_if(user_id % 20 <> 0) * 1.0 / count(*) AS coverage FROM events
    WHERE event_type = 'signup' AND ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-01-31'"""
)
def gate_mint_coverage(spark, sf):
    from workledger.plans.queries import GATE

    return edge(gates.mint_coverage(wb.gates(spark, sf), GATE))


@query(f"SELECT CASE reason WHEN 'accessed' THEN 'lead' ELSE 'candidate' END AS grade, {N('count(*)')} AS n FROM ({o.ORACLES['memory_dispositions']}) WHERE disposition <> 'none' GROUP BY 1")
def memory_findings(spark, sf):
    rows = memory.memory_candidates(memory.memory_audit(wb.memory(spark, sf), wb.MEMORY_CUTOFF))
    return edge(rows.groupBy("grade").agg(F.count_distinct("finding_id").alias("n")))


# ---- research outcomes -----------------------------------------------------------------------------------------------


@query(
    f"""WITH {o.RECEIPTS}, x AS (SELECT *, concat('w', conv_id % 4) AS workload FROM rc)
    SELECT workload, {N("count(*)")} AS receipt_outcomes, {N("count(DISTINCT coordinate)")} AS distinct_attempts, {N("count(DISTINCT call_id)")} AS distinct_call_ids, {N("coalesce(sum(n), 0)")} AS attributed_observations,
        {D("coalesce(sum(usd), 0)")} AS attributed_cost_usd, {N("count_if(judgment = 'ADMITTED')")} AS "ADMITTED", {N("count_if(judgment = 'REJECTED')")} AS "REJECTED",
        {N("count_if(judgment = 'CORROBORATED')")} AS "CORROBORATED", {N("0")} AS error, {N("0")} AS unmapped FROM x GROUP BY 1"""
)
def workload_yields(spark, sf):
    from workledger.plans.queries import _receipt_costs

    r = wb.receipts(spark, sf)
    rows = effectiveness.grouped_yields(r, _receipt_costs(r), "workload")
    return edge(rows, "workload", "receipt_outcomes", "distinct_attempts", "distinct_call_ids", "attributed_observations", "attributed_cost_usd", "ADMITTED", "REJECTED", "CORROBORATED", "error", "unmapped")


@query(
    f"""{o.CHAINS}, y AS (SELECT *, CAST(split_part(top, '/', 1) AS BIGINT) AS c FROM ch)
    SELECT 'single' AS bucket, concat('t', c % 3) AS treatment_namespace, concat('m', c % 2) AS manifest_sha256, {N("count(*)")} AS domain_chains, {D("sum(usd)")} AS attributed_cost_usd,
        {N("count_if(admitted)")} AS admitted_chains, {N("count_if(admitted AND terminal = 'CORROBORATED')")} AS later_corroborated_chains FROM y GROUP BY ALL"""
)
def treatment_funnels(spark, sf):
    from workledger.plans.queries import _receipt_costs

    r = wb.receipts(spark, sf)
    rows = effectiveness.treatment_funnel(effectiveness.chains(r, _receipt_costs(r)))
    return edge(rows, "bucket", "treatment_namespace", "manifest_sha256", "domain_chains", "attributed_cost_usd", "admitted_chains", "later_corroborated_chains")


@query(
    f"""WITH c AS (SELECT exact_join_percentage AS j FROM ({o.ORACLES["receipt_coverage"]})), g AS (SELECT sum(n) AS gaps FROM ({o.ORACLES["chain_gaps"]})), f AS (SELECT * FROM ({o.ORACLES["semantic_funnel"]})),
    r AS (SELECT list_filter([CASE WHEN j IS NULL OR j < 50 THEN 'below_join_threshold' END, CASE WHEN gaps > 0 OR terminal_unmapped_chains > 0 THEN 'ambiguous_or_invalid_followup' END,
        CASE WHEN admitted_chains = 0 THEN 'no_standardized_admissions' END, CASE WHEN admitted_awaiting_followup > 0 THEN 'insufficient_later_followup' END], lambda x: x IS NOT NULL) AS why FROM c, g, f)
    SELECT CASE WHEN len(why) = 0 THEN 'eligible' ELSE 'not_claimable' END AS status, CASE WHEN len(why) = 0 THEN 'eligible' ELSE array_to_string(why, ',') END AS reasons FROM r"""
)
def claimable(spark, sf):
    from workledger.plans.queries import _receipt_costs

    r = wb.receipts(spark, sf)
    costs = _receipt_costs(r)
    held = r.select("coordinate", F.explode("call_ids").alias("call_id")).where("call_id like '%-0' or call_id like '%-2'")
    coverage = effectiveness.call_coverage(r, held.groupBy("call_id").agg(F.min("coordinate").alias("coordinate")))
    states = r.select(F.lit("attributed").alias("state"), F.lit(1).alias("n"))
    one = effectiveness.claimability(coverage, states, effectiveness.gap_counts(r), effectiveness.chains(r, costs), 0.5)
    return one.select("status", F.array_join("reasons", ",").alias("reasons"))


# ---- tuples and procedures -------------------------------------------------------------------------------------------


@query(
    f"""WITH t AS (SELECT l_returnflag AS profile, l_linestatus AS served_model, concat('h', l_suppkey % 40) AS harness, concat('i', l_suppkey % 40 % 3) AS implementation, l_linenumber AS n, l_orderkey AS k, l_extendedprice AS usd FROM lineitem),
    f AS (SELECT profile, served_model, harness, implementation, count(*) AS c, count_if(n < 6 AND k % 2 = 0) AS a, count_if(n = 6 AND harness < 'h2') AS am, count_if(n > 6 AND harness < 'h2') AS un, sum(CAST(usd AS DECIMAL(18,2))) AS usd FROM t GROUP BY ALL)
    SELECT profile, served_model, harness, implementation, {N("c")} AS observations, {N("a")} AS attributed, {D("usd")} AS amount_usd,
        CASE WHEN am > 0 OR un > 0 THEN 'confounded' WHEN a < 100 THEN 'sparse' ELSE 'ready' END AS state FROM f"""
)
def tuple_states(spark, sf):
    """Evidence for each tuple of profile, model, harness and implementation."""
    h, n = F.col("l_suppkey") % 40, F.col("l_linenumber")
    implementation = F.concat(F.lit("i"), h % 3)
    harness = F.concat(F.lit("h"), h)
    loose = harness < "h2"
    state = F.when((n == 6) & loose, "ambiguous").when((n > 6) & loose, "unallocated").otherwise("attributed")
    rows = wb.table(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("profile"), F.col("l_linestatus").alias("served_model"), harness.alias("harness"), implementation.alias("implementation"), state.alias("state"),
        F.when((n < 6) & (F.col("l_orderkey") % 2 == 0), implementation).alias("outcome_implementation"), F.col("l_extendedprice").cast("decimal(18,2)").alias("amount_usd"),
    )
    out = activity.tuple_evidence(rows, minimum=100)
    return edge(out, "profile", "served_model", "harness", "implementation", "observations", "attributed", "amount_usd", "state")


@query(
    f"""WITH p AS (SELECT p_partkey AS i, p_size AS s FROM part),
    c AS (SELECT *, concat_ws(',', CASE WHEN i % 3 = 0 THEN 'missing-finding-promotion-relation' END, CASE WHEN i % 5 = 0 THEN 'missing-exact-fab-outcome' END,
        CASE WHEN i % 5 <> 0 AND i % 7 = 0 THEN 'fab-outcome-not-successful' END, CASE WHEN i % 11 = 0 THEN 'missing-exact-somm-outcome' END) AS reasons FROM p)
    SELECT reasons, CASE WHEN reasons <> '' OR s = 20 THEN 'inconclusive' WHEN (s > 20) = (i % 2 = 0) THEN 'improvement' ELSE 'regression' END AS classification, {N("count(*)")} AS n FROM c GROUP BY ALL"""
)
def calibrated_procedures(spark, sf):
    """Parts as promotions; runner and gateway outcomes are missing, failed or double for some."""
    i = F.col("i")
    p = wb.table(spark, sf, "part").select(F.col("p_partkey").alias("i"), F.col("p_size").alias("size"))
    key = [text("i").alias("promotion_id"), F.concat(F.lit("r"), i).alias("revision_id"), F.struct(i.alias("t")).alias("evaluation_tuple"), F.struct(i.alias("t")).alias("baseline_tuple")]
    relations = p.where("i % 3 <> 0").select(F.lit("promotes").alias("predicate"), F.lit("workledger.finding-revision").alias("subject_ns"), F.concat(F.lit("r"), i).alias("subject_val"), F.lit("spindle.promotion-receipt").alias("object_ns"), text("i").alias("object_val"))
    runner = p.where("i % 5 <> 0").select(*key, F.when(i % 7 == 0, "failed").otherwise("succeeded").alias("status"), F.lit(True).alias("semantic"))
    rough = p.where("i % 4 = 0 and i % 5 <> 0").select(*key, F.lit("failed").alias("status"), F.lit(False).alias("semantic"))
    gateway = p.select(i, *key, F.when(i % 2 == 0, "higher").otherwise("lower").alias("direction"), F.lit(20).alias("baseline_score"), F.col("size").alias("post_score"))
    gateway = gateway.unionByName(gateway.where("i % 11 = 0")).drop("i")
    rows = activity.procedure_calibration(p.select(*key), relations, runner.unionByName(rough), gateway)
    return edge(rows.groupBy(F.array_join("reasons", ",").alias("reasons"), "classification").agg(F.count("*").alias("n")))


# ---- checks and appends ----------------------------------------------------------------------------------------------


def _errors(checked: DataFrame, name: str) -> DataFrame:
    return checked.select(F.lit(name).alias("check"), F.explode("errors").alias("code")).groupBy("check", "code").agg(F.count("*").alias("n"))


@query(
    f"""WITH p AS (SELECT p_partkey AS i FROM part), x AS (
        SELECT 'costs' AS "check", 'negative-amount' AS code, count_if(i % 5 = 0) AS n FROM p UNION ALL SELECT 'costs', 'negative-input_tokens', count_if(i % 7 = 0) FROM p
        UNION ALL SELECT 'costs', 'blank', count_if(i % 11 = 0) FROM p UNION ALL SELECT 'costs', 'scope-without-key', count_if(i % 3 = 0) FROM p
        UNION ALL SELECT 'gates', 'coordinate', count_if(i % 4 = 0) FROM p UNION ALL SELECT 'gates', 'mint_id', count_if(i % 6 = 0) FROM p
        UNION ALL SELECT 'memory', 'item', count_if(i % 3 = 0) FROM p UNION ALL SELECT 'memory', 'stage', count_if(i % 5 = 0) FROM p UNION ALL SELECT 'memory', 'superseded', count_if(i % 7 = 0) FROM p
        UNION ALL SELECT 'crosswalks', 'self-link', count_if(i % 2 = 0) FROM p UNION ALL SELECT 'crosswalks', 'confidence', count_if(i % 3 = 0) FROM p UNION ALL SELECT 'crosswalks', 'refutation', count_if(i % 5 = 0) FROM p
        UNION ALL SELECT 'findings', 'grade', count_if(i % 3 = 0) FROM p UNION ALL SELECT 'findings', 'subject', count_if(i % 5 = 0) FROM p UNION ALL SELECT 'findings', 'evidence', count_if(i % 7 = 0) FROM p
        UNION ALL SELECT 'relations', 'self-relation', count_if(i % 2 = 0) FROM p UNION ALL SELECT 'relations', 'evidence', count_if(i % 3 = 0) FROM p
        UNION ALL SELECT 'relations', 'refutation', count_if(i % 5 = 0) FROM p UNION ALL SELECT 'relations', 'relation-id', count_if(i % 7 = 0) FROM p)
    SELECT "check", code, {N("n")} AS n FROM x WHERE n > 0"""
)
def row_checks(spark, sf):
    """Parts made into rows of every table, with planted faults."""
    p = wb.table(spark, sf, "part").select(F.col("p_partkey").alias("i"))
    i = F.col("i")
    bad = lambda k, x, y: F.when(i % k == 0, F.lit(x)).otherwise(F.lit(y))
    costs = p.select(bad(5, -1, 1).alias("amount_usd"), bad(7, -1, 1).alias("input_tokens"), bad(11, " x", "x").alias("authority"), F.when(i % 3 != 0, "k").alias("accounting_key"), F.lit("source").alias("accounting_key_scope"))
    gate = p.select(bad(4, "", "c").alias("coordinate"), bad(6, "m ", "m").alias("mint_id"))
    mem = p.select(F.lit("s").alias("system"), F.when(i % 3 != 0, "x").alias("item_id"), bad(5, "seen", "loaded").alias("stage"), bad(7, " ", "y").alias("superseded_by"))
    links = p.select(
        F.lit("a").alias("left_ns"), F.lit("1").alias("left_val"), F.lit("a").alias("right_ns"), bad(2, "1", "2").alias("right_val"), bad(3, 2.0, 1.0).alias("confidence"), bad(5, "refuted", "asserted").alias("state"), F.lit(None).cast("string").alias("supersedes"),
    )
    notes = p.select(bad(3, "guess", "lead").alias("grade"), bad(5, " ", "s").alias("subject"), F.lit("x").alias("summary"), F.when(i % 7 != 0, F.array(F.lit("e"))).otherwise(F.array()).alias("evidence"))
    from workledger.functions.ids import relation_id

    rel = p.select(
        i, F.lit("a").alias("subject_ns"), F.lit("1").alias("subject_val"), F.lit("produced").alias("predicate"), F.lit("a").alias("object_ns"), bad(2, "1", "2").alias("object_val"), bad(5, "refuted", "asserted").alias("state"),
        F.when(i % 5 == 0, 0.0).otherwise(1.0).alias("confidence"), F.when(i % 5 == 0, "r").alias("supersedes"), bad(5, " ", "n").alias("note"), F.when(i % 3 == 0, F.array(F.lit("b"), F.lit("a"))).otherwise(F.array(F.lit("a"))).alias("evidence_event_ids"),
    )
    rel = rel.withColumn("relation_id", F.when(i % 7 != 0, relation_id("subject_ns", "subject_val", "predicate", "object_ns", "object_val")).otherwise("x"))
    out = None
    for name, checked in (
        ("costs", quality.check_costs(costs)), ("gates", quality.check_gates(gate)), ("memory", quality.check_memory(mem)), ("crosswalks", quality.check_crosswalks(links)),
        ("findings", quality.check_findings(notes)), ("relations", quality.check_relations(rel)),
    ):
        out = _errors(checked, name) if out is None else out.unionByName(_errors(checked, name))
    return edge(out)


@query(f"SELECT {N('count_if(p_partkey % 3 = 0)')} AS n, {N('min(p_partkey) FILTER (p_partkey % 3 = 0)')} AS first_id FROM part")
def native_id_conflicts(spark, sf):
    p = F.col("p_partkey")
    rows = wb.table(spark, sf, "part").select(F.lit("a").alias("adapter"), F.lit("k").alias("kind"), text("p_partkey").alias("native_id"), F.concat(F.lit("e"), p).alias("event_id"), p)
    batch = rows.withColumn("event_id", F.when(p % 3 == 0, F.concat("event_id", F.lit("x"))).otherwise(F.col("event_id")))
    found = revisions.native_conflicts(rows, batch)
    return edge(found.agg(F.count("*").alias("n"), F.min("p_partkey").alias("first_id")))


@query(
    f"""WITH t AS (SELECT l_orderkey, l_linenumber AS n, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS r FROM lineitem)
    SELECT CASE WHEN r = 1 AND l_orderkey % 10 = 0 THEN 'first revision supersedes' WHEN r > 1 AND l_orderkey % 7 = 0 THEN 'does not supersede the current record' ELSE 'ok' END AS error, {N("count(*)")} AS n FROM t GROUP BY 1"""
)
def link_chains(spark, sf):
    """Line items as revisions of their order's link, some out of their chain."""
    from pyspark.sql import Window

    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    k = F.col("l_orderkey")
    li = wb.table(spark, sf, "lineitem").withColumn("r", F.row_number().over(order))
    before = F.concat_ws(":", "l_orderkey", (F.col("r") - 1).cast("string"))
    rows = li.select(
        text("l_orderkey").alias("link_id"), F.col("r").cast("long").alias("sequence"), F.concat_ws(":", "l_orderkey", "r").alias("record_id"),
        F.when((F.col("r") == 1) & (k % 10 == 0), "none").when(F.col("r") == 1, None).when(k % 7 == 0, "other").otherwise(before).alias("supersedes"),
    )
    return edge(revisions.check_crosswalk_chain(rows).groupBy(F.coalesce("error", F.lit("ok")).alias("error")).agg(F.count("*").alias("n")))


@query(
    """SELECT event_type AS adapter, CAST(user_id AS VARCHAR) AS source, CAST(max(ts) AS TIMESTAMPTZ) AS recorded_at FROM events GROUP BY 1, 2"""
)
def source_manifest(spark, sf):
    """The newest row of each source, from a stored manifest and a batch."""
    rows = wb.base(spark, sf).select(F.col("event_type").alias("adapter"), text("user_id").alias("source"), F.col("ts").alias("recorded_at"), text("raw_id").alias("fingerprint"), F.col("raw_id"))
    held = rows.where("raw_id % 2 = 0").drop("raw_id")
    return revisions.upsert_sources(held, rows.where("raw_id % 2 = 1").drop("raw_id")).select("adapter", "source", "recorded_at")


@query(
    f"""WITH s AS (SELECT * FROM ({o.ORACLES["failure_facets"]})), r AS (
        SELECT 'retry-storm' AS motif_id, count(*) AS sessions, count(*) AS supported, count(*) AS with_receipt FROM s WHERE repeated_failure_fingerprint IS NOT NULL
        UNION ALL SELECT 'permission-loop', count(*), count_if(repeated_failed_tool IS NOT NULL AND list_contains(string_split(errors, ','), 'permission')), count(*) FROM s)
    SELECT motif_id, CASE WHEN supported < sessions THEN 'unsupported-facet' WHEN sessions < 3 THEN 'below-recurrence-floor' ELSE 'eligible' END AS reason, {N("sessions")} AS sessions, {N("supported")} AS supported,
        CASE WHEN supported = sessions AND sessions >= 3 THEN 'candidate' END AS grade FROM r WHERE sessions > 0"""
)
def assessed_motifs(spark, sf):
    """Two proposed motifs: the sessions that bear one out, and all sessions for another."""
    from workledger.plans.queries import _facets

    f = _facets(spark, sf)
    rows = f.where(motifs.supports(F.lit("retry-storm"))).select(F.lit("retry-storm").alias("motif_id"), F.array("session_id").alias("session_ids"))
    rows = rows.unionByName(f.select(F.lit("permission-loop").alias("motif_id"), F.array("session_id").alias("session_ids")))
    out = motifs.assess_proposals(rows, f, f.select("session_id"), "surface", motifs.MotifConfig(wb.SINCE, wb.CUTOFF))
    return edge(out, "motif_id", "reason", "sessions", "supported", "grade")
