"""Projections on hand-made rows."""

from __future__ import annotations

import hashlib
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from workledger.functions import coerce, ids, text
from workledger.operators import accounting, activity, attribution, effectiveness, evaluation, findings, gates, graph, memory, motifs, quality, revisions

SEP = "\x01"
COST = "event_id string, adapter string, occurred_at timestamp, amount_usd decimal(38,18), basis string, kind string, accuracy string, authority string, accounting_key string, accounting_key_scope string, observation_role string, session_id string, parent_event_id string"


def cost(spark, *rows):
    base = dict(adapter="somm", occurred_at=None, amount_usd=Decimal(1), basis="reported", kind="marginal", accuracy="actual", authority=None, accounting_key=None, accounting_key_scope="unknown", observation_role="production", session_id=None, parent_event_id=None)
    names = [c.split()[0] for c in COST.split(", ")]
    return spark.createDataFrame([tuple((base | r)[n] for n in names) for r in rows], COST)


def test_stable_id_matches_python(spark):
    want = "evt_" + hashlib.sha256("codex\0cost\0é".encode()).hexdigest()[:24]
    assert spark.range(1).select(ids.event_id(F.lit("codex"), F.lit("cost"), F.lit("é"))).head()[0] == want


def test_iso_text_drops_a_zero_fraction(spark):
    rows = spark.sql("select timestamp'2026-07-17 10:00:00' a, timestamp'2026-07-17 10:00:00.120000' b")
    assert tuple(rows.select(ids.iso_text("a"), ids.iso_text("b")).head()) == ("2026-07-17T10:00:00Z", "2026-07-17T10:00:00.120000Z")


def test_canonical_json(spark):
    rows = spark.createDataFrame([('{"b": 1, "a": "é"}',), ('{"a": NaN}',), (None,)], "j string")
    assert [r[0] for r in rows.select(text.canonical_json("j")).collect()] == ['{"a":"\\u00e9","b":1}', None, None]


def test_stronger_observation_wins_and_kinds_stay_apart(spark):
    rows = cost(
        spark,
        dict(event_id="a", accounting_key="k", accounting_key_scope="shared", accuracy="estimated"),
        dict(event_id="b", accounting_key="k", accounting_key_scope="shared", basis="computed", adapter="codex", amount_usd=Decimal(2)),
        dict(event_id="c", accounting_key="k", accounting_key_scope="shared", kind="notional"),
        dict(event_id="d", accounting_key="k", accounting_key_scope="source", adapter="codex"),
        dict(event_id="e", observation_role="rollup"),
        dict(event_id="f", amount_usd=None),
    )
    assert {r.event_id for r in accounting.select_costs(rows).collect()} == {"b", "c", "d"}
    assert [(r.event_id, r.winner_id) for r in accounting.suppressed(rows).collect()] == [("a", "b")]
    marginal = {r.kind: r for r in accounting.by_kind(rows).collect()}
    assert marginal["marginal"].suppressed_usd == 1 and marginal["included"].raw_usd == 0


def relations(spark, rows):
    df = spark.createDataFrame(rows, "subject_ns string, subject_val string, predicate string, object_ns string, object_val string")
    return df.withColumns({"relation_id": F.concat_ws("|", *df.columns), "record_id": F.concat_ws("|", *df.columns), "method": F.lit("exact"), "evidence_event_ids": F.array().cast("array<string>")})


def test_attribution_states_and_conservation(spark):
    calls = spark.createDataFrame([(f"m{i}", "model-call", "somm", f"c{i}", None, None) for i in range(5)], "event_id string, kind string, adapter string, native_id string, session_id string, parent_event_id string")
    costs = accounting.select_costs(cost(spark, *(dict(event_id=f"x{i}", parent_event_id=f"m{i}" if i < 5 else None) for i in range(6))))
    rel = relations(spark, [("fab.job", "j0", "produced", "somm.call", "c0"), ("fab.job", "j0", "produced", "git.commit", "g0"), ("fab.job", "j1", "produced", "somm.call", "c1"), ("fab.job", "j1", "produced", "git.commit", "g1"), ("fab.job", "j1", "produced", "git.commit", "g2"), ("fab.job", "j2", "produced", "somm.call", "c2")])
    links = spark.createDataFrame([("fab.job", "j3", "somm.call", "c3", "l", "r")], "left_ns string, left_val string, right_ns string, right_val string, link_id string, record_id string").withColumn("evidence_event_ids", F.array().cast("array<string>"))
    out = [("fab.job", f"j{i}", "fab") for i in range(4)] + [("git.commit", f"g{i}", "git") for i in range(3)]
    outcomes = spark.createDataFrame([(f"o{v}", a, v, None, t, "succeeded", v) for t, v, a in out], "event_id string, adapter string, native_id string, occurred_at timestamp, outcome_type string, status string, reference string")
    got = attribution.attribute(costs, calls, outcomes, links, rel).persist()
    assert {r.event_id: r.reason for r in got.collect()} == {"x0": "exact-directed-path", "x1": "competing-outcomes", "x2": "exact-directed-path", "x3": "association-only", "x4": "no-outcome-path", "x5": "no-root-reference"}
    assert attribution.conserved(got, costs)
    won = {r.event_id: (r.outcome_node, len(r.steps)) for r in got.where("state = 'attributed'").collect()}
    assert won == {"x0": (f"git.commit{SEP}g0", 2), "x2": (f"fab.job{SEP}j2", 1)}
    assert attribution.path_evidence(got).count() == 2
    steps = {r.event_id: [(s.source, s.target) for s in r.steps] for r in got.where("state = 'attributed'").collect()}
    assert steps["x0"] == [(f"somm.call{SEP}c0", f"fab.job{SEP}j0"), (f"fab.job{SEP}j0", f"git.commit{SEP}g0")]


def test_proposals_of_another_snapshot_model_or_floor_are_refused(spark):
    config = motifs.MotifConfig("2024-01-01", "2024-02-01")
    rows = [("s1", "codex", 1), ("s2", "codex", 2), ("s2", "codex", 2)]
    facets = lambda r: spark.createDataFrame(r, "session_id string, adapter string, n int")
    snapshot = motifs.facet_snapshot(facets(rows), config)
    assert snapshot == motifs.facet_snapshot(facets(rows[::-1]).repartition(3), config)
    assert snapshot != motifs.facet_snapshot(facets(rows[1:]), config)
    assert snapshot != motifs.facet_snapshot(facets(rows), motifs.MotifConfig("2024-01-01", "2024-02-02"))
    said = {"source_snapshot": snapshot, "model": "m", "harness": "h", "parameters_digest": "p"}
    known = {"generator": "failure-motif", "model": "m", "harness": "h", "parameters_digest": "p", "recurrence_floor": 3, "aggregation_floor": 2}
    motifs.check_synthesis(snapshot, said, None, config)
    motifs.check_synthesis(snapshot, said, known, config)
    for change, reason in (({"generator": "gates"}, "generator"), ({"model": "n"}, "model"), ({"recurrence_floor": 4}, "floors"), ({"aggregation_floor": 3}, "floors")):
        with pytest.raises(ValueError, match=reason):
            motifs.check_synthesis(snapshot, said, known | change, config)
    with pytest.raises(ValueError, match="snapshot"):
        motifs.check_synthesis("other", said, None, config)


def test_families_are_found_from_their_seeds(spark):
    """Through parents that are not stored, up and down, in a cycle, and nothing that no root asks for."""
    rows = [("a", None, "s"), ("b", "lost", None), ("c", "lost", "s"), ("d", "b", None), ("x", "y", None), ("y", "x", None), ("z", None, None), ("self", "self", None)]
    events = spark.createDataFrame(rows, "event_id string, parent_event_id string, session_id string")
    seeds = spark.createDataFrame([("r1", "a"), ("r2", "x"), ("r3", "z"), ("r4", "nowhere"), ("r4", "self"), ("r5", "d")], "root string, node string")
    got = {}
    for r in graph.family_closure(seeds, events).collect():
        got.setdefault(r.root, set()).add(r.node)
    whole = {"a", "s", "c", "lost", "b", "d"}
    assert got == {"r1": whole, "r2": {"x", "y"}, "r3": {"z"}, "r4": {"nowhere", "self"}, "r5": whole}


def test_components_and_depth(spark):
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("d", "e"), ("e", "d"), ("f", "f")], "a string, b string")
    assert {(r.node, r.root) for r in graph.components(links).collect()} == {("b", "a"), ("c", "a"), ("e", "d")} or {
        (r.node, r.root) for r in graph.components(links).collect()
    } >= {("b", "a"), ("c", "a"), ("e", "d")}
    edges = spark.createDataFrame([("1", "2"), ("2", "3"), ("3", "1"), ("3", "4")], "source string, target string")
    got = graph.reachable(spark.createDataFrame([("1", "1")], "root string, node string"), edges, 2)
    assert {(r.node, r.depth) for r in got.collect()} == {("1", 0), ("2", 1), ("3", 2)}


def test_current_state_takes_the_last_revision_first(spark):
    rows = spark.createDataFrame([("a", 1, "asserted"), ("a", 2, "refuted"), ("b", 1, "asserted")], "id string, sequence int, state string")
    assert [r.id for r in revisions.current(rows, "id").collect()] == ["b"]


def test_append_is_idempotent(spark):
    stored = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    batch = spark.createDataFrame([(1, "a"), (2, "x"), (3, "c"), (3, "c"), (4, "d"), (4, "e")], "k int, v string")
    got = sorted((r.k, r.verdict) for r in revisions.classify_append(stored, batch, "k").collect())
    assert [v for k, v in got if k == 1] == ["replay"] and [v for k, v in got if k == 2] == ["conflict"]
    assert sorted(v for k, v in got if k == 3) == ["insert", "replay"] and sorted(v for k, v in got if k == 4) == ["conflict", "insert"]


def test_relation_chain_rules(spark):
    t = [f"2026-01-0{i} 00:00:00" for i in range(1, 7)]
    rows = [
        ("r", 1, "a", "asserted", None, t[0], ["e1"]),
        ("r", 2, "b", "asserted", None, t[1], ["e1"]),
        ("r", 3, "c", "asserted", None, t[2], ["e2"]),
        ("r", 4, "d", "refuted", "a", t[3], []),
        ("r", 5, "e", "refuted", "c", t[3], []),
        ("r", 6, "f", "asserted", None, t[5], ["e9"]),
    ]
    df = spark.createDataFrame(rows, "relation_id string, sequence int, record_id string, state string, supersedes string, at string, evidence_event_ids array<string>").withColumn("recorded_at", F.to_timestamp("at"))
    got = {r.sequence: r.error for r in revisions.check_relation_chain(df).collect()}
    assert got == {1: None, 2: "no new evidence", 3: None, 4: "does not supersede the current record", 5: None, 6: "history is closed"}


def test_finding_ladder(spark):
    rows = [("f", i, f"r{i}", "stale-gate", g, s, f"2026-01-0{i} 00:00:00") for i, (g, s) in enumerate([("lead", None), ("candidate", "r1"), ("lead", "r2"), ("refuted", "r2"), ("lead", "r4")], 1)]
    df = spark.createDataFrame(rows, "finding_id string, sequence int, revision_id string, kind string, grade string, supersedes string, at string").withColumn("recorded_at", F.to_timestamp("at"))
    assert {r.sequence: r.error for r in revisions.check_finding_chain(df).collect()} == {1: None, 2: None, 3: "grade moved back", 4: None, 5: "refuted finding revived"}


def gate(spark, rows):
    return spark.createDataFrame(rows, "event_id string, at string, evidence_kind string, coordinate string, mint_id string, status string, consultation string, ambiguous boolean").withColumn("occurred_at", F.to_timestamp("at"))


def test_gate_rules(spark):
    e = gate(spark, [
        ("1", "2026-01-01 00:00:00", "mint", "a", "m1", "open", None, False), ("2", "2026-01-02 00:00:00", "mint", "a", "m2", "open", None, False), ("3", "2026-01-08 00:00:00", "mint", "a", "m3", "open", None, False),
        ("4", "2026-01-05 00:00:00", "consult", "a", None, None, "not_consulted", False), ("5", "2026-01-02 00:00:00", "mint", "b", "m5", "open", None, False), ("6", "2026-01-03 00:00:00", "decision", "target=m5", None, "resolved", None, False),
        ("7", "2026-01-02 00:00:00", "mint", None, "m7", "open", None, True),
    ])
    got = {(r.coordinate, r.rule): (r.state, r.reason) for r in gates.gate_assessments(e, gates.GateConfig("2026-01-01", "2026-02-01")).collect()}
    assert got[("a", "condition-resolved")] == ("not-detected", "no-resolution") and got[("a", "reminted")] == ("detected", "remint-threshold")
    assert got[("a", "old-unconsulted")] == ("detected", "explicit-not-consulted") and got[("b", "condition-resolved")] == ("detected", "resolution-receipt")
    assert got[("b", "old-unconsulted")] == ("not-detected", "already-resolved") and got[(None, "reminted")] == ("abstain", "coordinate-ambiguous")
    stale = gates.gate_assessments(e, gates.GateConfig("2026-01-01", "2026-02-01", fresh=False))
    assert {r.reason for r in stale.where("coordinate is not null").collect()} == {"stale-source"}
    with pytest.raises(ValueError):
        gates.GateConfig("2026-02-01", "2026-01-01")


def test_memory_ladder(spark):
    stages = ("loaded", "retrieved", "referenced", "applied")
    rows = [("i", "1", x, "inventory", "observed", None) for x in "abcde"]
    rows += [(f"b{s}", "2", "b", s, "not_observed", None) for s in stages] + [(f"c{s}", "2", "c", s, "not_observed", "new") for s in stages]
    rows += [("d1", "2", "d", "applied", "observed", None), ("e1", "2", "e", "loaded", "observed", None), ("e2", "2", "e", "loaded", "not_observed", None)]
    df = spark.createDataFrame(rows, "event_id string, day string, item_id string, stage string, state string, superseded_by string").withColumn("occurred_at", F.to_timestamp(F.concat(F.lit("2026-01-0"), F.when(F.col("day") == "i", "1").otherwise(F.col("day"))))).withColumn("system", F.lit("s"))
    got = {r.item_id: (r.disposition, r.reason) for r in memory.memory_audit(df, "2026-06-01").collect()}
    assert got == {"a": ("none", "signals-unknown"), "b": ("park", "complete-non-use"), "c": ("retire", "superseded-non-use"), "d": ("keep", "applied"), "e": ("none", "conflicted")}


def test_facets_and_motifs(spark):
    sessions = spark.createDataFrame([("s1", "codex", "n1"), ("s2", "codex", "n2")], "session_id string, adapter string, native_id string")
    tools = spark.createDataFrame([("1", "s1", "bash", "failed", "Permission denied", "x"), ("2", "s1", "bash", "failed", "timed out", "x"), ("3", "s1", "ls", "succeeded", None, "y")], "event_id string, session_id string, tool_name string, status string, error string, input_sha string")
    none = spark.createDataFrame([], "event_id string, session_id string, status string")
    facets = motifs.failure_facets(sessions, tools, none).persist()
    (row,) = facets.collect()
    assert row.repeated_failed_tool == "bash" and row.error_categories == ["permission", "timeout"] and row.repeated_failure_fingerprint
    proposals = spark.createDataFrame([("permission-loop", ["s1"]), ("retry-storm", ["s1", "s9"])], "motif_id string, session_ids array<string>")
    got = {r.motif_id: r.reason for r in motifs.assess_proposals(proposals, facets, sessions, "surface", motifs.MotifConfig("a", "b", recurrence_floor=1, aggregation_floor=1)).collect()}
    assert got == {"permission-loop": "eligible", "retry-storm": "unknown-session"}


def test_evaluation_counts_ambiguous_cases_as_false_positives(spark):
    rows = spark.createDataFrame([(True, True), (None, True), (True, False), (False, False), (True, None)], "expected boolean, predicted boolean")
    m = evaluation.decide(evaluation.metrics(rows)).head()
    assert (m.true_positive, m.false_positive, m.false_negative, m.true_negative, m.abstained, m.precision, m.decision) == (1, 1, 1, 1, 1, 0.5, "offline")


def test_chains_and_gaps(spark):
    rows = [("a", None, 1, "d"), ("b", "a", 2, "d"), ("c", "x", 3, "d"), ("e", None, 1, "d"), ("f", "e", 2, "z"), ("g", "h", 1, "d"), ("h", "g", 2, "d")]
    df = spark.createDataFrame(rows, "coordinate string, predecessor string, t int, domain string").withColumn("occurred_at", F.timestamp_seconds("t"))
    gaps = {r.gap: r.n for r in effectiveness.gap_counts(df).collect()}
    assert gaps == {"outside_window": 0, "missing_target": 1, "cross_domain": 1, "non_increasing_timestamp": 1, "fork": 0, "cycle": 1}
    assert {r.coordinate for r in effectiveness.chain_states(df).where("valid").collect()} == {"a", "b"}


def test_finding_dispositions(spark):
    f = spark.createDataFrame([("f1", "r1", "k", "lead", 1), ("f2", "r2", "k", "lead", 1)], "finding_id string, revision_id string, kind string, grade string, sequence int")
    rel = spark.createDataFrame([("x", findings.REVISION_NS, "r1", "acts_on", "n", "1", "asserted", 1), ("y", findings.REVISION_NS, "r1", "refutes", "n", "1", "asserted", 1), ("z", findings.REVISION_NS, "r2", "evaluates", "n", "9", "asserted", 1)], "relation_id string, subject_ns string, subject_val string, predicate string, object_ns string, object_val string, state string, sequence int")
    known = spark.createDataFrame([("e1", "n", "1", "a")], "event_id string, ns string, val string, adapter string")
    fresh = spark.createDataFrame([("a", "n", "unknown")], "adapter string, ns string, state string")
    got = {r.finding_id: (r.disposition, r.freshness) for r in findings.finding_activity(f, findings.action_receipts(f, rel, known, fresh)).collect()}
    assert got == {"f1": ("conflicted", "unknown"), "f2": ("none", "unknown")}


def test_quality_and_tuples(spark):
    bad = quality.check_costs(cost(spark, dict(event_id="a", amount_usd=Decimal(-1)), dict(event_id="b", accounting_key_scope="shared"), dict(event_id="c")))
    assert {r.event_id: r.errors for r in bad.collect()} == {"a": ["negative-amount"], "b": ["scope-without-key"], "c": []}
    obs = spark.createDataFrame([("p", "m", "h", "i", "attributed", "i", 1.0)] * 5 + [("p", "m", "h", "j", "ambiguous", None, 1.0)], "profile string, served_model string, harness string, implementation string, state string, outcome_implementation string, amount_usd double")
    assert {r.implementation: r.state for r in activity.tuple_evidence(obs).collect()} == {"i": "ready", "j": "confounded"}


def test_coercions(spark):
    row = spark.range(1).select(
        coerce.status(F.lit("OK"), "gateway"), coerce.status(F.lit("parked"), "receipt"), coerce.billing_kind(F.lit("Metered")), coerce.project_from_cwd(F.lit("/a/b/")), coerce.cost_basis(F.lit(None).cast("string")),
        coerce.error_category(F.lit("Rate LIMIT hit")), coerce.plain_decimal(F.lit("6.600")), coerce.attempt_shape(F.lit("j:attempt:0")), coerce.procedure_class(F.lit("lower"), F.lit(2), F.lit(1)),
    ).head()
    assert tuple(row) == ("succeeded", "abandoned", "notional", "b", "computed", "rate-limit", "6.6", True, "improvement")


def test_distinct_calls_are_counted_without_gathering_them(spark):
    from workledger.operators.effectiveness import DIMENSIONS, raw_dimensions

    schema = "coordinate string, attempt string, call_ids array<string>, " + ", ".join(f"{c} string" for c in DIMENSIONS)
    group = lambda w: [w, None, *"mandojx"[:7]]
    rows = [("a", "1", ["x", "y", None], *group("w")), ("b", "1", ["y", "z"], *group("w")), ("c", "2", ["y", "y"], *group(None)), ("d", "3", [None], *group("v")), ("e", "4", [], *group("v")), ("f", "5", None, *group("u"))]
    costs = spark.createDataFrame([("a", 2, 1)], "coordinate string, n long, usd int").selectExpr("coordinate", "n", "cast(usd as decimal(38,18)) as amount_usd")
    out = raw_dimensions(spark.createDataFrame(rows, schema), costs)
    assert "collect_set" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = {r.workload: (r.receipt_outcomes, r.distinct_attempts, r.distinct_call_ids, r.attributed_observations) for r in out.collect()}
    assert got == {"w": (2, 1, 3, 2), None: (1, 1, 1, 0), "v": (2, 2, 0, 0), "u": (1, 1, 0, 0)}
