"""The registered queries in SQL over the same Parquet tables."""

from __future__ import annotations

BASE = """
b AS (
    SELECT event_id AS raw_id, ts, user_id, event_type, value, CAST(json_extract_string(props, '$.k') AS INT) AS k,
        event_id % 3 AS e1, (event_id // 3) % 3 AS e2, (event_id // 9) % 3 AS e3, (event_id // 27) % 4 AS e4,
        ['claude-code', 'codex', 'hermes', 'opencode', 'somm'][CAST(user_id % 5 + 1 AS INT)] AS adapter,
        concat(user_id, '-', strftime(date_trunc('week', ts), '%Y-%m-%d')) AS session_native
    FROM events)
"""


def evt(*parts: str) -> str:
    return f"concat('evt_', left(sha256(concat_ws(chr(0), {', '.join(f'CAST({p} AS VARCHAR)' for p in parts)})), 24))"


COSTS = f"""
c AS (
    SELECT {evt("adapter", "'cost'", "raw_id")} AS event_id, adapter,
        CASE WHEN k % 10 <> 0 THEN CAST(value AS DECIMAL(18,6)) END AS amount_usd,
        ['reported', 'computed', 'unknown'][CAST(e2 + 1 AS INT)] AS basis,
        ['marginal', 'notional', 'included', 'unknown'][CAST(e4 + 1 AS INT)] AS kind,
        ['actual', 'estimated', 'unknown'][CAST(e3 + 1 AS INT)] AS accuracy,
        ['shared', 'source', 'unknown'][CAST(e1 + 1 AS INT)] AS scope,
        CASE WHEN e1 < 2 THEN concat('req=', k) END AS accounting_key,
        CASE WHEN k % 10 = 1 THEN 'rollup' ELSE 'production' END AS role, k
    FROM b WHERE event_type = 'purchase')
"""
RANKED = """
r AS (
    SELECT *, CASE scope WHEN 'shared' THEN concat('shared ', accounting_key)
            WHEN 'source' THEN concat('source ', adapter, ' ', accounting_key) ELSE concat('event ', event_id) END AS group_key
    FROM c WHERE role <> 'rollup' AND amount_usd IS NOT NULL),
w AS (
    SELECT *, row_number() OVER g AS place, count(*) OVER (PARTITION BY group_key, kind) AS n,
        sum(amount_usd) OVER (PARTITION BY group_key, kind) AS raw_usd, first_value(event_id) OVER g AS winner_id
    FROM r WINDOW g AS (PARTITION BY group_key, kind ORDER BY
        list_position(['actual', 'estimated', 'unknown'], accuracy), list_position(['reported', 'computed', 'unknown'], basis),
        coalesce(list_position(['provider', 'somm', 'hermes', 'opencode', 'claude-code', 'codex'], adapter), 7), adapter, event_id))
"""
WITH_COSTS = f"WITH {BASE}, {COSTS}, {RANKED}"


def _totals(by: str, values: str) -> str:
    return f"""{WITH_COSTS}
        SELECT v.x AS {by}, CAST(coalesce(raw, 0) AS DECIMAL(38,6)) AS raw_usd, CAST(coalesce(sel, 0) AS DECIMAL(38,6)) AS selected_usd,
            CAST(coalesce(raw, 0) - coalesce(sel, 0) AS DECIMAL(38,6)) AS suppressed_usd,
            CAST(coalesce(np, 0) AS BIGINT) AS n_priced, CAST(coalesce(ns, 0) AS BIGINT) AS n_selected
        FROM (SELECT unnest({values}) AS x) v
        LEFT JOIN (SELECT {by}, sum(amount_usd) AS raw, count(*) AS np,
            sum(CASE WHEN place = 1 THEN amount_usd END) AS sel, count_if(place = 1) AS ns FROM w GROUP BY 1) t ON t.{by} = v.x"""


RELATIONS = """
li AS (
    SELECT concat('job', l_orderkey) AS subject, concat('commit', l_orderkey, '-', l_suppkey) AS object, l_orderkey, l_suppkey, l_returnflag, l_shipdate,
        row_number() OVER (PARTITION BY l_orderkey, l_suppkey ORDER BY l_shipdate DESC, l_linenumber DESC, l_partkey DESC, l_quantity DESC,
            l_extendedprice DESC, l_discount DESC, l_tax DESC, l_returnflag DESC, l_linestatus DESC) AS n
    FROM lineitem {where}),
rel AS (SELECT * FROM li WHERE n = 1 AND l_returnflag <> 'A')
"""
ATTRIBUTED = f"""WITH {RELATIONS.format(where="")},
n AS (SELECT l_orderkey, count(*) AS n, min(l_suppkey) AS supp FROM rel GROUP BY 1),
a AS (
    SELECT o.*, CAST(o_totalprice AS DECIMAL(18,2)) AS amount, coalesce(n.n, 0) AS n, supp,
        CASE WHEN o_orderkey % 50 = 0 THEN 'no-root-reference' WHEN o_orderkey % 20 = 19 THEN 'no-outcome-path'
            WHEN coalesce(n.n, 0) >= 2 THEN 'competing-outcomes' WHEN n.n = 1 THEN 'exact-directed-path'
            WHEN o_orderkey % 10 = 9 THEN 'association-only' ELSE 'exact-directed-path' END AS reason
    FROM orders o LEFT JOIN n ON n.l_orderkey = o.o_orderkey),
s AS (
    SELECT *, CASE reason WHEN 'exact-directed-path' THEN 'attributed' WHEN 'competing-outcomes' THEN 'ambiguous' ELSE 'unallocated' END AS state,
        CASE WHEN reason = 'exact-directed-path' THEN CASE WHEN n = 1 THEN 'git.commit' ELSE 'fab.job' END END AS outcome_type,
        CASE WHEN n = 1 THEN 'succeeded' WHEN o_orderstatus = 'F' THEN 'succeeded' WHEN o_orderstatus = 'P' THEN 'failed' ELSE 'unknown' END AS outcome_status
    FROM a)
"""
GATES = f"""WITH {BASE},
g AS (
    SELECT *, CASE event_type WHEN 'signup' THEN 'mint' WHEN 'view' THEN 'consult' ELSE 'decision' END AS evidence_kind,
        CASE WHEN user_id % 20 <> 0 THEN user_id END AS coordinate
    FROM b WHERE event_type IN ('signup', 'view') OR event_type = 'purchase' AND value > 200),
gg AS (SELECT * FROM g WHERE ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-01-31'),
dense AS (
    SELECT coordinate, max(n) AS size FROM (
        SELECT coordinate, count(*) OVER (PARTITION BY coordinate ORDER BY ts RANGE BETWEEN INTERVAL 7 DAYS PRECEDING AND CURRENT ROW) AS n
        FROM gg WHERE evidence_kind = 'mint' AND coordinate IS NOT NULL) GROUP BY 1),
f AS (
    SELECT gg.coordinate, count_if(evidence_kind = 'mint') AS mints, count_if(evidence_kind = 'decision') AS solved,
        count_if(evidence_kind = 'consult') AS consults, count_if(evidence_kind = 'consult' AND k % 3 = 0) AS consulted,
        count_if(evidence_kind = 'consult' AND k % 3 = 1) AS unconsulted,
        min(CASE WHEN evidence_kind = 'mint' THEN ts END) AS first_mint, any_value(size) AS size
    FROM gg JOIN dense ON dense.coordinate = gg.coordinate GROUP BY 1 HAVING count_if(evidence_kind = 'mint') > 0),
lost AS (SELECT 'abstain' AS state, 'coordinate-unavailable' AS reason, 1 AS m, 0 AS s FROM gg WHERE evidence_kind = 'mint' AND coordinate IS NULL)
"""


def _gate(state: str, reason: str, mints: str, supporting: str) -> str:
    return f"""{GATES}, j AS (SELECT {reason} AS reason, {mints} AS m, {supporting} AS s FROM f),
        k AS (SELECT {state} AS state, reason, m, s FROM j UNION ALL SELECT * FROM lost)
        SELECT state, reason, CAST(count(*) AS BIGINT) AS n, CAST(sum(m) AS BIGINT) AS mints, CAST(sum(s) AS BIGINT) AS supporting FROM k GROUP BY 1, 2"""


def _mode(where: str, value: str, name: str) -> str:
    return f"""{name} AS (
        SELECT session_id, v AS {name} FROM (
            SELECT session_id, {value} AS v, count(*) AS n, row_number() OVER (PARTITION BY session_id ORDER BY count(*) DESC, {value}) AS p
            FROM t WHERE {where} GROUP BY 1, 2 HAVING count(*) >= 2) WHERE p = 1)"""


FACETS = f"""WITH {BASE},
s AS (SELECT *, {evt("adapter", "'session'", "session_native")} AS session_id FROM b),
t AS (
    SELECT session_id, concat('tool_', k % 7) AS tool, event_type = 'error' AS failed,
        CASE WHEN event_type = 'error' THEN ['permission', 'rate-limit', 'timeout'][CAST(k % 3 + 1 AS INT)] END AS category,
        concat('act_', left(sha256(concat_ws(chr(0), concat('tool_', k % 7), sha256(CAST(k % 5 AS VARCHAR)))), 24)) AS action
    FROM s WHERE event_type IN ('click', 'error')),
a AS (SELECT session_id, count(*) AS n, count_if(failed) AS nf, string_agg(DISTINCT category, ',' ORDER BY category) AS errors FROM t GROUP BY 1),
o AS (
    SELECT session_id, string_agg(DISTINCT CASE WHEN k % 4 = 0 THEN 'failed' ELSE 'succeeded' END, ',' ORDER BY CASE WHEN k % 4 = 0 THEN 'failed' ELSE 'succeeded' END) AS outcomes
    FROM s WHERE event_type = 'purchase' AND value > 450 GROUP BY 1),
{_mode("true", "tool", "repeated_tool")},
{_mode("failed", "tool", "repeated_failed_tool")},
{_mode("failed", "action", "repeated_failure_fingerprint")},
x AS (
    SELECT q.session_id, adapter, CAST(coalesce(n, 0) AS BIGINT) AS tool_attempts, CAST(coalesce(nf, 0) AS BIGINT) AS failed_tool_attempts,
        repeated_tool, repeated_failed_tool, repeated_failure_fingerprint, coalesce(errors, '') AS errors, coalesce(outcomes, '') AS outcomes
    FROM (SELECT DISTINCT session_id, adapter FROM s) q LEFT JOIN a USING (session_id) LEFT JOIN o USING (session_id)
        LEFT JOIN repeated_tool USING (session_id) LEFT JOIN repeated_failed_tool USING (session_id) LEFT JOIN repeated_failure_fingerprint USING (session_id)
    WHERE n IS NOT NULL OR outcomes IS NOT NULL)
"""
MEMORY = f"""WITH {BASE},
m AS (
    SELECT raw_id, {evt("'memory'", "'memory-evidence'", "raw_id")} AS event_id, ts, CAST(user_id % 2 AS VARCHAR) AS system, CAST(user_id AS VARCHAR) AS item_id,
        CASE event_type WHEN 'signup' THEN 'inventory' WHEN 'view' THEN 'loaded' WHEN 'click' THEN 'retrieved' WHEN 'purchase' THEN 'referenced' ELSE 'applied' END AS stage,
        event_type = 'signup' OR k % 2 = 0 AS seen, CASE WHEN k % 25 = 0 THEN concat('item-', k) END AS superseded_by
    FROM b),
st AS (
    SELECT system, item_id, stage, CASE WHEN bool_and(seen) THEN 'observed' WHEN bool_or(seen) THEN 'conflicted' ELSE 'not_observed' END AS status
    FROM (SELECT *, max(ts) OVER (PARTITION BY system, item_id, stage) AS last FROM m) WHERE ts = last GROUP BY 1, 2, 3),
i AS (
    SELECT system, item_id, max(CASE WHEN stage = 'inventory' THEN ts END) AS inventoried_at,
        arg_max(superseded_by, (ts, event_id)) FILTER (superseded_by IS NOT NULL) AS superseded_by
    FROM m GROUP BY 1, 2 HAVING count_if(stage = 'inventory') > 0),
p AS (
    SELECT i.*, coalesce(max(CASE WHEN stage = 'loaded' THEN status END), 'unknown') AS loaded, coalesce(max(CASE WHEN stage = 'retrieved' THEN status END), 'unknown') AS retrieved,
        coalesce(max(CASE WHEN stage = 'referenced' THEN status END), 'unknown') AS referenced, coalesce(max(CASE WHEN stage = 'applied' THEN status END), 'unknown') AS applied,
        date_diff('second', inventoried_at, TIMESTAMP '2024-03-01') / 86400.0 AS age
    FROM i JOIN st ON st.system = i.system AND st.item_id = i.item_id GROUP BY ALL),
d AS (
    SELECT *, CASE WHEN list_contains([loaded, retrieved, referenced, applied], 'conflicted') THEN 'conflicted' WHEN applied = 'observed' THEN 'applied'
        WHEN list_contains([loaded, retrieved, referenced], 'observed') THEN 'accessed' WHEN age < 30 THEN 'too-recent'
        WHEN loaded = 'not_observed' AND retrieved = loaded AND referenced = loaded AND applied = loaded
            THEN CASE WHEN superseded_by IS NULL THEN 'complete-non-use' ELSE 'superseded-non-use' END ELSE 'signals-unknown' END AS reason
    FROM p)
"""
RECEIPTS = """
rc AS (
    SELECT concat(conv_id, '/', turn) AS coordinate, CASE WHEN turn > 0 THEN concat(conv_id, '/', turn - 1) END AS predecessor, conv_id, turn,
        CASE WHEN turn = 5 THEN concat(conv_id, '-other') ELSE CAST(conv_id AS VARCHAR) END AS domain,
        CASE role WHEN 'user' THEN 'ADMITTED' WHEN 'assistant' THEN 'CORROBORATED' ELSE 'REJECTED' END AS judgment,
        CASE WHEN turn % 3 <> 0 THEN concat('c', conv_id, '-', turn // 2) END AS call_id,
        CASE WHEN turn % 2 = 0 THEN 1 END AS n, CASE WHEN turn % 2 = 0 THEN length(concat(conv_id, '/', turn)) END AS usd
    FROM conversations)
"""
CHAINS = f"""WITH RECURSIVE {RECEIPTS},
lk AS (
    SELECT s.coordinate, s.predecessor, p.coordinate IS NULL AS missing, p.domain <> s.domain AS crossed, p.turn >= s.turn AS late,
        count(*) OVER (PARTITION BY s.predecessor, p.coordinate IS NULL) > 1 AND p.coordinate IS NOT NULL AS forked
    FROM rc s LEFT JOIN rc p ON p.coordinate = s.predecessor WHERE s.predecessor IS NOT NULL),
walk AS (
    SELECT coordinate, coordinate AS top FROM rc WHERE predecessor IS NULL OR predecessor NOT IN (SELECT coordinate FROM rc)
    UNION SELECT rc.coordinate, walk.top FROM walk JOIN rc ON rc.predecessor = walk.coordinate),
bad AS (SELECT DISTINCT top FROM walk JOIN lk USING (coordinate) WHERE missing OR crossed OR late OR forked),
ch AS (
    SELECT top, bool_or(judgment = 'ADMITTED') AS admitted, arg_max(judgment, turn) AS terminal, coalesce(sum(usd), 0) AS usd
    FROM walk JOIN rc USING (coordinate) WHERE top NOT IN (SELECT top FROM bad) GROUP BY 1)
"""
CASES = """
cs AS (
    SELECT doc_id, ['tuning', 'held-out', 'calibration'][CAST(doc_id % 3 + 1 AS INT)] AS partition, quality = 1 AS expected,
        CASE WHEN doc_id % 7 <> 0 THEN toxic = 0 END AS predicted FROM labels)
"""
PAIRS = "p AS (SELECT conv_id, turn, role, CAST(ceil(turn / 2.0) AS BIGINT) AS call FROM conversations)"
B = "CAST({} AS BIGINT)".format
D = "CAST({} AS DECIMAL(38,6))".format

ORACLES = {
    "accounting_by_kind": _totals("kind", "['marginal', 'notional', 'included', 'unknown']"),
    "accounting_by_basis": _totals("basis", "['reported', 'computed', 'unknown']"),
    "accounting_decisions": f"""{WITH_COSTS} SELECT kind, event_id AS winner_id, adapter, basis, accuracy, {D("amount_usd")} AS amount_usd,
        {B("n - 1")} AS n_suppressed, {D("raw_usd - amount_usd")} AS suppressed_usd FROM w WHERE place = 1 AND n > 1""",
    "accounting_suppressed": f"{WITH_COSTS} SELECT kind, event_id, winner_id FROM w WHERE place > 1",
    "key_coverage": f"""WITH {BASE}, {COSTS} SELECT v.x AS accounting_key_scope, {B("count(c.event_id)")} AS n_observations,
        {B("count_if(role = 'rollup')")} AS n_rollups, {B("count(amount_usd)")} AS n_priced, {B("count(accounting_key)")} AS n_keyed
        FROM (SELECT unnest(['shared', 'source', 'unknown']) AS x) v LEFT JOIN c ON c.scope = v.x GROUP BY 1""",
    "report_by_adapter": f"""{WITH_COSTS}, t AS (SELECT adapter, sum(amount_usd) AS usd, sum(k) AS k FROM w WHERE place = 1 GROUP BY 1)
        SELECT b.adapter, {B("count(*)")} AS n_events, CAST(min(ts) AS TIMESTAMPTZ) AS first_at, CAST(max(ts) AS TIMESTAMPTZ) AS last_at,
            {D("any_value(usd)")} AS selected_usd, {B("any_value(t.k)")} AS input_tokens FROM b LEFT JOIN t ON t.adapter = b.adapter GROUP BY 1""",
    "report_by_kind": f"""WITH {BASE} SELECT CASE WHEN event_type = 'purchase' THEN 'cost' WHEN event_type IN ('click', 'error') THEN 'tool-call'
        ELSE 'gate-evidence' END AS kind, {B("count(*)")} AS n_events FROM b GROUP BY 1""",
    "coverage_gaps": f"""WITH {BASE}, {COSTS} SELECT adapter, field, 'unavailable' AS status, {B("count(*)")} AS n FROM (
        SELECT adapter, 'amount_usd' AS field FROM c WHERE amount_usd IS NULL UNION ALL SELECT adapter, 'authority' FROM c
        UNION ALL SELECT adapter, 'accounting_key' FROM c WHERE accounting_key IS NULL) GROUP BY 1, 2""",
    "current_relations": f"""WITH {RELATIONS.format(where="")} SELECT 'git.commit' AS object_ns, {B("count(*)")} AS n, {B("count(DISTINCT subject)")} AS n_subjects FROM rel
        UNION ALL SELECT 'somm.call', {B("count(*)")}, {B("count(DISTINCT o_orderkey)")} FROM orders WHERE o_orderkey % 10 <> 9""",
    "as_of_relations": f"""WITH {RELATIONS.format(where="WHERE l_shipdate < DATE '1996-01-01'")}
        SELECT CAST(l_orderkey AS VARCHAR) AS subject_val, concat(l_orderkey, '-', l_suppkey) AS object_val FROM rel""",
    "latest_outcomes": f"""SELECT 'git.commit' AS outcome_type, 'succeeded' AS status, {B("count(*)")} AS n, CAST(max(d) AS TIMESTAMPTZ) AS last_at
            FROM (SELECT l_orderkey, l_suppkey, CAST(min(l_shipdate) AS TIMESTAMP) AS d FROM lineitem GROUP BY 1, 2)
        UNION ALL SELECT 'fab.job', CASE o_orderstatus WHEN 'F' THEN 'succeeded' WHEN 'P' THEN 'failed' ELSE 'unknown' END, {B("count(*)")},
            CAST(max(CAST(o_orderdate AS TIMESTAMP)) AS TIMESTAMPTZ) FROM orders GROUP BY 2""",
    "attribution_states": f"{ATTRIBUTED} SELECT state, reason, {B('count(*)')} AS n, {D('sum(amount)')} AS amount_usd FROM s GROUP BY 1, 2",
    "cost_per_outcome": f"""{ATTRIBUTED} SELECT v.x AS outcome_type, {B("count(DISTINCT o_orderkey)")} AS n_outcomes, {D("coalesce(sum(amount), 0)")} AS amount_usd,
        round(CAST(sum(amount) AS DOUBLE) / nullif(count(DISTINCT o_orderkey), 0), 6) AS usd_per_outcome
        FROM (SELECT unnest(['git.commit', 'george.entry', 'fab.job', 'fab.attempt', 'barnowl.research-outcome']) AS x) v
        LEFT JOIN s ON s.outcome_type = v.x GROUP BY 1""",
    "outcome_rollup": f"""{ATTRIBUTED} SELECT outcome_type, outcome_status, 'marginal' AS kind, {B("count(*)")} AS n_outcomes, {D("sum(amount)")} AS amount_usd
        FROM s WHERE state = 'attributed' GROUP BY 1, 2""",
    "window_allocation": f"""{ATTRIBUTED}, t AS (SELECT count(*) AS n, sum(amount) AS usd FROM s)
        SELECT v.x AS state, {B("count(s.o_orderkey)")} AS n, {D("coalesce(sum(amount), 0)")} AS amount_usd,
            round(count(s.o_orderkey) * 100.0::DOUBLE / any_value(t.n), 6) AS n_percentage,
            round(CAST(coalesce(sum(amount), 0) AS DOUBLE) * 100 / CAST(any_value(t.usd) AS DOUBLE), 6) AS amount_percentage
        FROM (SELECT unnest(['attributed', 'ambiguous', 'unallocated']) AS x) v LEFT JOIN s ON s.state = v.x, t GROUP BY 1""",
    "connected_refs_depth4": f"""WITH {RELATIONS.format(where="")}, n AS (SELECT l_orderkey, count(*) AS n FROM rel GROUP BY 1),
        z AS (SELECT CASE WHEN o_orderkey % 20 = 19 THEN 1 WHEN o_orderkey % 10 <> 9 THEN 2 + coalesce(n, 0) ELSE 3 + coalesce(n, 0) END AS size
            FROM orders LEFT JOIN n ON l_orderkey = o_orderkey)
        SELECT {B("size")} AS size, {B("count(*)")} AS n FROM z GROUP BY 1""",
    "event_family_size": f"""WITH {BASE}, z AS (SELECT count(*) + 1 AS size FROM b GROUP BY session_native)
        SELECT {B("size")} AS size, {B("count(*)")} AS n FROM z GROUP BY 1""",
    "gate_condition_resolved": _gate(
        "CASE reason WHEN 'resolution-receipt' THEN 'detected' ELSE 'not-detected' END",
        "CASE WHEN solved > 0 THEN 'resolution-receipt' ELSE 'no-resolution' END", "mints", "solved",
    ),
    "gate_reminted": _gate(
        "CASE reason WHEN 'remint-threshold' THEN 'detected' ELSE 'not-detected' END",
        "CASE WHEN size >= 6 THEN 'remint-threshold' ELSE 'below-threshold' END", "size", "0",
    ),
    "gate_old_unconsulted": _gate(
        "CASE reason WHEN 'explicit-not-consulted' THEN 'detected' WHEN 'consultation-unknown' THEN 'abstain' ELSE 'not-detected' END",
        """CASE WHEN solved > 0 THEN 'already-resolved' WHEN date_diff('microsecond', first_mint, TIMESTAMP '2024-01-31') < 7 * 86400000000 THEN 'too-young'
            WHEN consulted > 0 THEN 'consulted' WHEN unconsulted > 0 THEN 'explicit-not-consulted' ELSE 'consultation-unknown' END""", "mints", "consults",
    ),
    "failure_facets": f"{FACETS} SELECT * EXCLUDE (adapter) FROM x",
    "retry_storm_sessions": f"{FACETS} SELECT adapter, {B('count(*)')} AS n FROM x WHERE repeated_failure_fingerprint IS NOT NULL GROUP BY 1",
    "permission_loop_sessions": f"{FACETS} SELECT adapter, {B('count(*)')} AS n FROM x WHERE repeated_failed_tool IS NOT NULL AND contains(errors, 'permission') GROUP BY 1",
    "memory_dispositions": f"""{MEMORY} SELECT system, item_id, loaded, retrieved, referenced, applied, superseded_by, reason,
        CASE WHEN reason IN ('applied', 'accessed') THEN 'keep' WHEN reason = 'superseded-non-use' THEN 'retire' WHEN reason = 'complete-non-use' THEN 'park' ELSE 'none' END AS disposition FROM d""",
    "memory_coverage": f"""{MEMORY} SELECT system, {B("count(*)")} AS items, {", ".join(f"{B(f'''count_if({s} <> 'unknown')''')} AS known_{s}" for s in ("loaded", "retrieved", "referenced", "applied"))},
        {B("count_if(list_contains([loaded, retrieved, referenced, applied], 'unknown'))")} AS items_with_unknown FROM d GROUP BY 1""",
    "evaluation_metrics": f"""WITH {CASES}, t AS (SELECT partition, count(*) AS n, count_if(predicted AND expected) AS tp, count_if(predicted AND NOT expected) AS fp,
            count_if(NOT predicted AND NOT expected) AS tn, count_if(NOT predicted AND expected) AS fn, count_if(predicted IS NULL) AS ab,
            count_if(predicted IS NOT DISTINCT FROM expected) AS ex FROM cs GROUP BY 1)
        SELECT partition, {B("n")} AS n_cases, {B("tp")} AS true_positive, {B("fp")} AS false_positive, {B("tn")} AS true_negative, {B("fn")} AS false_negative,
            {B("ab")} AS abstained, {B("ex")} AS exact, {B("0")} AS recurrence_violations, {B("0")} AS aggregation_violations,
            round(CAST(tp AS DOUBLE) / nullif(tp + fp, 0), 6) AS precision, round(CAST(n - ab AS DOUBLE) / n, 6) AS coverage,
            CASE WHEN tp > 0 AND round(CAST(tp AS DOUBLE) / (tp + fp), 6) >= 0.9 THEN 'surface' WHEN tp > 0 AND round(CAST(tp AS DOUBLE) / (tp + fp), 6) >= 0.8 THEN 'narrow' ELSE 'offline' END AS decision FROM t""",
    "evaluation_leakage": f"""WITH {CASES} SELECT CAST(doc_id % 100 AS VARCHAR) AS value, {B("count(DISTINCT partition)")} AS partitions, {B("count(*)")} AS uses
        FROM cs GROUP BY 1 HAVING count(DISTINCT partition) > 1""",
    "receipt_coverage": f"""WITH {RECEIPTS}, u AS (SELECT coordinate, call_id FROM rc WHERE call_id IS NOT NULL),
        h AS (SELECT call_id, min(coordinate) AS held FROM u WHERE call_id LIKE '%-0' OR call_id LIKE '%-2' GROUP BY 1),
        k AS (SELECT call_id, count(DISTINCT coordinate) AS k FROM u GROUP BY 1),
        j AS (SELECT count_if(held = coordinate) AS joined, count_if(held IS NULL) AS without, count(DISTINCT CASE WHEN held IS NULL THEN call_id END) AS dw, count(*) AS n FROM u LEFT JOIN h USING (call_id))
        SELECT {B("(SELECT count(*) FROM rc)")} AS total_call_slots, {B("(SELECT count(*) FROM rc WHERE call_id IS NULL)")} AS null_call_ids,
            {B("n")} AS non_null_call_id_occurrences, {B("(SELECT count(*) FROM k)")} AS distinct_call_ids, {B("(SELECT count(*) FROM k WHERE k > 1)")} AS duplicate_call_ids_across_receipts,
            {B("(SELECT coalesce(sum(k), 0) FROM k WHERE k > 1)")} AS duplicate_call_id_occurrences, {B("joined")} AS joined_occurrences,
            {B("without")} AS occurrences_without_cost, {B("dw")} AS distinct_without_cost, round(joined * 100.0::DOUBLE / n, 6) AS exact_join_percentage FROM j""",
    "raw_outcome_dimensions": f"""WITH {RECEIPTS} SELECT concat('w', conv_id % 4) AS workload, concat('t', conv_id % 3) AS treatment_namespace, concat('m', conv_id % 2) AS manifest_sha256,
            'review' AS authority_namespace, 'conversation' AS domain_namespace, 'thread' AS domain_object_type, 'judged' AS outcome_kind, judgment, CAST(NULL AS VARCHAR) AS error_kind,
            {B("count(*)")} AS receipt_outcomes, {B("count(DISTINCT coordinate)")} AS distinct_attempts, {B("count(*)")} AS call_slots,
            {B("count(call_id)")} AS non_null_call_id_occurrences, {B("count(DISTINCT call_id)")} AS distinct_call_ids, {B("coalesce(sum(n), 0)")} AS attributed_observations,
            {D("coalesce(sum(usd), 0)")} AS attributed_cost_usd, {B("coalesce(count_if(n > 0), 0)")} AS outcomes_with_cost,
            round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM rc), 6) AS raw_yield_percentage
        FROM rc GROUP BY 1, 2, 3, judgment""",
    "chain_gaps": f"""{CHAINS}, x AS (
            SELECT 'missing_target' AS gap, count_if(missing) AS n FROM lk UNION ALL SELECT 'cross_domain', count_if(crossed) FROM lk
            UNION ALL SELECT 'non_increasing_timestamp', count_if(late) FROM lk UNION ALL SELECT 'fork', count(DISTINCT CASE WHEN forked THEN predecessor END) FROM lk
            UNION ALL SELECT 'outside_window', 0 UNION ALL SELECT 'cycle', 0) SELECT gap, {B("n")} AS n FROM x""",
    "semantic_funnel": f"""{CHAINS}, t AS (SELECT count(*) AS v, count_if(admitted) AS a, count_if(admitted AND terminal = 'CORROBORATED') AS l,
            count_if(terminal = 'REJECTED') AS r, count_if(terminal = 'CORROBORATED' AND NOT admitted) AS cw, count_if(admitted AND terminal = 'ADMITTED') AS aw,
            coalesce(sum(CASE WHEN admitted THEN usd END), 0) AS ua, coalesce(sum(CASE WHEN admitted AND terminal = 'CORROBORATED' THEN usd END), 0) AS ul FROM ch)
        SELECT {B("v")} AS valid_chains, {B("a")} AS admitted_chains, {B("l")} AS later_corroborated_chains, {B("r")} AS terminal_rejected_chains,
            {B("0")} AS terminal_error_chains, {B("0")} AS terminal_unmapped_chains, {B("cw")} AS corroborated_without_admission, {B("aw")} AS admitted_awaiting_followup,
            {D("ua")} AS admitted_cost_usd, {D("ul")} AS later_corroborated_cost_usd, round(a * 100.0::DOUBLE / nullif(v, 0), 6) AS admitted_percentage,
            round(l * 100.0::DOUBLE / nullif(a, 0), 6) AS later_corroborated_percentage, round(CAST(ua AS DOUBLE) / nullif(a, 0), 6) AS cost_per_admitted_usd,
            round(CAST(ul AS DOUBLE) / nullif(l, 0), 6) AS cost_per_later_corroborated_usd FROM t""",
    "tool_pairing": f"""WITH {PAIRS}, u AS (SELECT conv_id, call, min(turn) AS used_at FROM p WHERE role = 'user' GROUP BY 1, 2),
        a AS (SELECT conv_id, call, min(turn) AS answered_at FROM p WHERE role = 'assistant' GROUP BY 1, 2)
        SELECT conv_id, call, used_at, answered_at FROM u JOIN a USING (conv_id, call) WHERE answered_at > used_at""",
    "orphan_results": f"""WITH {PAIRS}, g AS (SELECT conv_id, call, bool_or(role = 'user') AS u, bool_or(role = 'assistant') AS a FROM p GROUP BY 1, 2)
        SELECT conv_id, call, CASE WHEN a THEN 'orphan' ELSE 'deferred' END AS problem FROM g WHERE u <> a""",
    "turn_protection": f"SELECT conv_id, turn, role, sha256(text) AS content_sha256, {B('length(text)')} AS content_chars FROM conversations",
    "append_replay_conflict": f"""SELECT CASE WHEN doc_id > t / 2 THEN 'insert' WHEN doc_id % 50 = 0 THEN 'conflict' ELSE 'replay' END AS verdict,
        {B("count(*)")} AS n, min(doc_id) AS first_id, max(doc_id) AS last_id FROM documents, (SELECT max(doc_id) AS t FROM documents) GROUP BY 1""",
    "finding_disposition": f"""WITH acts AS (SELECT l_partkey, CASE l_returnflag WHEN 'A' THEN 'refutes' WHEN 'R' THEN 'acts_on' ELSE 'evaluates' END AS p, l_suppkey % 10 AS m,
            max(l_linestatus) = 'O' AS active FROM lineitem GROUP BY 1, 2, 3),
        f AS (SELECT p_partkey, coalesce(bool_or(active AND m % 3 <> 0 AND p = 'acts_on'), false) AS act, coalesce(bool_or(active AND m % 3 <> 0 AND p = 'refutes'), false) AS ref,
            coalesce(bool_or(active AND m % 3 <> 0 AND p = 'evaluates'), false) AS ev, count_if(active) AS shown, count_if(active AND m % 3 = 0) AS bad, count(m) AS n
            FROM part LEFT JOIN acts ON l_partkey = p_partkey GROUP BY 1)
        SELECT CASE WHEN act AND ref THEN 'conflicted' WHEN act THEN 'acted_on' WHEN ref THEN 'refuted' WHEN ev THEN 'evaluated' ELSE 'none' END AS disposition,
            CASE WHEN shown = 0 THEN 'not_applicable' WHEN bad > 0 THEN 'invalid' ELSE 'current' END AS freshness, act AS ever_acted_on,
            {B("count(*)")} AS n, {B("sum(n)")} AS n_receipts FROM f GROUP BY 1, 2, 3""",
    "procedure_outcomes": f"""WITH c AS (SELECT c_custkey, c_mktsegment, CAST(c_acctbal AS DECIMAL(18,2)) AS post FROM customer),
        r AS (SELECT *, max(post) OVER (PARTITION BY c_mktsegment) AS top, min(post) OVER (PARTITION BY c_mktsegment) AS bottom FROM c)
        SELECT c_mktsegment, CASE WHEN c_custkey % 5 = 0 THEN 'inconclusive' WHEN c_custkey % 2 = 0 THEN CASE WHEN post < bottom THEN 'improvement' WHEN post > bottom THEN 'regression' ELSE 'inconclusive' END
            WHEN post > top THEN 'improvement' WHEN post < top THEN 'regression' ELSE 'inconclusive' END AS classification, {B("count(*)")} AS n FROM r GROUP BY 1, 2""",
    "method_scores": """WITH l AS (SELECT doc_id, concat('m', min(quality)) AS m FROM labels GROUP BY 1),
        x AS (SELECT method, seed, doc_id, m, CASE WHEN method = 'facets' AND (doc_id + seed) % 4 = 0 THEN 'm9' ELSE m END AS g
            FROM l, (VALUES ('direct', 17), ('direct', 23), ('facets', 17), ('facets', 23)) v(method, seed)),
        s AS (SELECT method, seed, count(*) AS given, count_if(g = m) AS good FROM x GROUP BY 1, 2),
        val AS (SELECT method, seed, avg(CASE WHEN n >= 3 THEN 1.0 ELSE 0.0 END) AS value FROM (SELECT method, seed, g, count(*) AS n FROM x GROUP BY 1, 2, 3) GROUP BY 1, 2),
        st AS (SELECT method, avg(CASE WHEN k = 2 THEN 1.0 ELSE 0.0 END) AS stability FROM (SELECT method, doc_id, g, count(DISTINCT seed) AS k FROM x GROUP BY 1, 2, 3) GROUP BY 1)
        SELECT s.method, round(avg(good / given), 6) AS precision, round(avg(good / (SELECT count(*) FROM l)), 6) AS recall,
            round(avg(value), 6) AS operator_value, round(any_value(stability), 6) AS stability
        FROM s JOIN val ON val.method = s.method AND val.seed = s.seed JOIN st ON st.method = s.method GROUP BY 1""",
}
