"""Table schemas, closed vocabularies and rank tables."""

from __future__ import annotations

from pyspark.sql import types as T

MONEY = T.DecimalType(38, 18)


def _struct(**fields: T.DataType | str) -> T.StructType:
    kinds = {"s": T.StringType(), "i": T.LongType(), "d": T.DoubleType(), "t": T.TimestampType(), "m": MONEY}
    return T.StructType([T.StructField(k, kinds[v] if isinstance(v, str) else v) for k, v in fields.items()])


# Payload fields by event kind, in order.
PAYLOADS = {
    "session": _struct(project="s", working_directory="s", status="s", harness="s"),
    "turn": _struct(role="s", content="s", content_sha256="s", content_chars="i"),
    "tool_call": _struct(tool_name="s", status="s", input="s", output="s", error="s"),
    "model_call": _struct(provider="s", model="s", status="s", finish_reason="s"),
    "cost": _struct(
        amount_usd="m", input_tokens="i", output_tokens="i", cached_input_tokens="i", cache_write_tokens="i",
        reasoning_tokens="i", provider="s", model="s", basis="s", kind="s", accuracy="s", authority="s",
        pricing_version="s", accounting_key="s", accounting_key_scope="s", observation_role="s",
    ),
    "outcome": _struct(outcome_type="s", status="s", reference="s"),
    "gate": _struct(evidence_kind="s", coordinate="s", mint_id="s", status="s", consultation="s", disposition="s"),
    "memory": _struct(
        system="s", item_id="s", item_kind="s", stage="s", state="s", evidence_reference="s", superseded_by="s"
    ),
}

EVENTS = T.StructType(
    [
        T.StructField("event_id", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("adapter", T.StringType()),
        T.StructField("native_id", T.StringType()),
        T.StructField("location", T.StringType()),
        T.StructField("occurred_at", T.TimestampType()),
        T.StructField("recorded_at", T.TimestampType()),
        T.StructField("session_id", T.StringType()),
        T.StructField("parent_event_id", T.StringType()),
        T.StructField("attributes", T.StringType()),
        T.StructField("coverage", T.MapType(T.StringType(), T.StringType())),
        *(T.StructField(name, kind) for name, kind in PAYLOADS.items()),
    ]
)

CROSSWALKS = T.StructType(
    [
        *_struct(record_id="s", link_id="s", left_ns="s", left_val="s", right_ns="s", right_val="s", state="s", confidence="d", method="s", recorded_at="t", supersedes="s", note="s").fields,
        T.StructField("evidence_event_ids", T.ArrayType(T.StringType())),
        T.StructField("sequence", T.LongType()),
    ]
)
RELATIONS = T.StructType(
    [
        *_struct(record_id="s", relation_id="s", subject_ns="s", subject_val="s", predicate="s", object_ns="s", object_val="s", state="s", confidence="d", method="s", recorded_at="t", supersedes="s", note="s").fields,
        T.StructField("evidence_event_ids", T.ArrayType(T.StringType())),
        T.StructField("sequence", T.LongType()),
    ]
)
FINDINGS = T.StructType(
    [
        *_struct(finding_id="s", revision_id="s", subject="s", kind="s", grade="s", summary="s", details="s", content_hash="s", recorded_at="t", supersedes="s").fields,
        T.StructField("evidence", T.ArrayType(_struct(event_id="s", role="s"))),
        T.StructField("sequence", T.LongType()),
    ]
)
# judgements of findings and of promoted procedures: rows that are added and never revised
LABELS = _struct(label_id="s", finding_id="s", revision_id="s", label="s", labelled_by="s", note="s", recorded_at="t")
CALIBRATIONS = _struct(result_id="s", promotion_id="s", revision_id="s", classification="s", delta="d", recorded_at="t")
DIAGNOSTICS = _struct(level="s", code="s", message="s", source="s", line="i")

# Closed vocabularies of the data model.
KINDS = ("session", "turn", "tool-call", "model-call", "cost", "outcome", "gate-evidence", "memory-evidence")
COVERAGE = ("recovered", "inferred", "unavailable", "redacted")
CALL_STATUS = ("started", "succeeded", "failed", "cancelled", "unknown")
OUTCOME_STATUS = ("succeeded", "failed", "reverted", "abandoned", "unknown")
COST_BASIS = ("reported", "computed", "unknown")
COST_KIND = ("marginal", "notional", "included", "unknown")
COST_ACCURACY = ("actual", "estimated", "unknown")
KEY_SCOPE = ("shared", "source", "unknown")
ROLES = ("production", "rollup", "unknown")
GATE_KINDS = ("mint", "consult", "decision", "disposition")
GATE_RESOLVED = ("resolved", "retired", "refuted", "acted")
MEMORY_STAGES = ("loaded", "retrieved", "referenced", "applied")
GRADES = ("lead", "candidate", "corroborated", "refuted")

# Accounting precedence, strongest first.
PRECEDENCE = (
    ("reported", "actual"),
    ("computed", "actual"),
    ("unknown", "actual"),
    ("reported", "estimated"),
    ("computed", "estimated"),
    ("unknown", "estimated"),
    ("reported", "unknown"),
    ("computed", "unknown"),
    ("unknown", "unknown"),
)
AUTHORITIES = ("provider", "somm", "hermes", "opencode", "claude-code", "codex")
# Outcome types, strongest first.
OUTCOME_TYPES = ("git.commit", "george.entry", "fab.job", "fab.attempt", "barnowl.research-outcome")
RECEIPT_OUTCOME = "barnowl.research-outcome"

# Fixed values: (predicate, subject namespace, object namespace) that may carry attribution.
SUPPORTING = (
    ("produced", "fab.job", "somm.call"),
    ("produced", "fab.job", "git.commit"),
    ("produced", "fab.job", "codex.session"),
    ("produced", "fab.job", "claude-code.session"),
    ("produced", "fab.job", "opencode.session"),
    ("produced", "fab.attempt", "somm.call"),
    ("produced", "fab.attempt", "git.commit"),
    ("produced", "fab.attempt", "codex.session"),
    ("produced", "fab.attempt", "claude-code.session"),
    ("produced", "fab.attempt", "opencode.session"),
    ("verifies", "george.entry", "fab.job"),
    ("verifies", "george.entry", "git.commit"),
    ("attempt_of", "fab.attempt", "fab.job"),
    ("part_of", "somm.call", "fab.attempt"),
    ("part_of", "fab.attempt", "fab.job"),
    ("evaluates", "somm.call", "git.commit"),
)
# The event that a reference namespace names, as (namespace, adapter, kind).
REFERENCES = (
    ("claude-code.session", "claude-code", "session"),
    ("codex.session", "codex", "session"),
    ("chip.candidate-receipt", "chip", "outcome"),
    ("fab.job", "fab", "session"),
    ("fab.attempt", "fab", "outcome"),
    ("fab.verifier", "fab", "outcome"),
    ("george.entry", "george", "outcome"),
    ("george.disposition", "george", "outcome"),
    ("george.gate-event", "george", "gate-evidence"),
    ("george.gate-mint", "george", "gate-evidence"),
    ("git.commit-instance", "git", "outcome"),
    ("hermes.session", "hermes", "session"),
    ("opencode.session", "opencode", "session"),
    ("somm.call", "somm", "model-call"),
    ("somm.call-update", "somm", "outcome"),
    ("somm.campaign", "somm", "outcome"),
    ("somm.campaign-event", "somm", "outcome"),
    ("somm.decision", "somm", "outcome"),
    ("somm.eval-receipt", "somm", "outcome"),
    ("somm.eval-result", "somm", "outcome"),
    ("spindle.evaluation-receipt", "spindle", "outcome"),
    ("spindle.promotion-receipt", "spindle", "outcome"),
    ("somm.recommendation", "somm", "outcome"),
    ("somm.session", "somm", "session"),
)
