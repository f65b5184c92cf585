"""Findings: revisions, activity from action receipts, disposition, exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from workledger.functions.ids import iso_text, stable_id
from workledger.operators.revisions import latest

ACTIONS = ("acts_on", "promotes", "refutes", "evaluates")
#: Namespace of a finding's revision as the subject of a relation.
REVISION_NS = "workledger.finding-revision"


def create_revisions(rows: DataFrame) -> DataFrame:
    """First revisions: ``subject, kind, grade, summary, details, evidence, recorded_at`` get their ids."""
    ids = rows.withColumn("finding_id", stable_id("fnd", "kind", "subject"))
    ids = ids.withColumn("revision_id", stable_id("fnr", "finding_id", iso_text("recorded_at")))
    return ids.withColumn("supersedes", F.lit(None).cast("string"))


def revise(findings: DataFrame, changes: DataFrame) -> DataFrame:
    """Next revisions: what a change leaves null is carried over. ``changes``: finding_id, recorded_at and any
    of grade, summary, details, evidence."""
    now = latest(findings, "finding_id")
    fields = ("grade", "summary", "details", "evidence")
    named = changes.select("finding_id", F.col("recorded_at").alias("__at"), *(F.col(c).alias(f"__{c}") for c in fields if c in changes.columns))
    joined = now.join(named, "finding_id").withColumn("supersedes", F.col("revision_id")).withColumn("recorded_at", F.col("__at"))
    for c in fields:
        if c in changes.columns:
            joined = joined.withColumn(c, F.coalesce(f"__{c}", c))
    return joined.withColumn("revision_id", stable_id("fnr", "finding_id", iso_text("recorded_at"))).drop("__at", *(f"__{c}" for c in fields))


def refute(findings: DataFrame, changes: DataFrame) -> DataFrame:
    """Revisions that refute; ``changes``: finding_id, recorded_at and optionally summary."""
    return revise(findings, changes.withColumn("grade", F.lit("refuted")))


def relate(findings: DataFrame, changes: DataFrame, events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Action relations of current revisions to stored receipts, and the changes whose receipt is missing.

    ``changes``: finding_id, predicate, object_ns, object_val, event_id, recorded_at.
    """
    now = latest(findings, "finding_id").select("finding_id", "revision_id")
    rows = changes.join(now, "finding_id", "left").join(events.select("event_id", F.lit(True).alias("__ok")), "event_id", "left")
    good = F.col("__ok").isNotNull() & F.col("revision_id").isNotNull()
    accepted = rows.where(good).select(
        stable_id("rel", F.lit(REVISION_NS), "revision_id", "predicate", "object_ns", "object_val").alias("relation_id"),
        F.lit(REVISION_NS).alias("subject_ns"), F.col("revision_id").alias("subject_val"), "predicate", "object_ns",
        "object_val", F.lit("asserted").alias("state"), F.array("event_id").alias("evidence_event_ids"), "recorded_at",
    )
    return accepted, rows.where(~good).drop("__ok", "revision_id")


def unrelate(relations: DataFrame, changes: DataFrame) -> DataFrame:
    """Refutations of current relations; ``changes``: relation_id, note, recorded_at."""
    now = latest(relations, "relation_id").where("state = 'asserted'")
    named = changes.select("relation_id", F.col("note").alias("__note"), F.col("recorded_at").alias("__at"))
    return (
        now.join(named, "relation_id")
        .withColumns({"supersedes": F.col("record_id"), "state": F.lit("refuted"), "confidence": F.lit(0.0), "note": F.col("__note"), "recorded_at": F.col("__at")})
        .drop("__note", "__at", "record_id", "sequence")
    )


def action_receipts(findings: DataFrame, relations: DataFrame, events: DataFrame, freshness: DataFrame) -> DataFrame:
    """One row per action relation of any revision: ``finding_id, relation_id, predicate, active, on_current,
    validity, freshness, receipt_event_id``.

    ``events``: event_id, ns, val, adapter of receipts by reference. ``freshness``: adapter, ns, state.
    """
    now = latest(findings, "finding_id").select("finding_id", F.col("revision_id").alias("current_revision"))
    revisions = findings.select("finding_id", F.col("revision_id").alias("subject_val"))
    acts = latest(relations.where((F.col("subject_ns") == REVISION_NS) & F.col("predicate").isin(*ACTIONS)), "relation_id")
    rows = acts.join(revisions, "subject_val").join(now, "finding_id")
    refuters = (
        latest(relations.where(F.col("predicate") == "refutes"), "relation_id")
        .where((F.col("state") == "asserted") & (F.col("subject_ns") != REVISION_NS))
        .groupBy("object_ns", "object_val")
        .agg(F.array_sort(F.collect_set("relation_id")).alias("invalidated_by"))
    )
    known = events.select(F.col("ns").alias("object_ns"), F.col("val").alias("object_val"), F.col("event_id").alias("receipt_event_id"))
    fresh = freshness.select(F.col("ns").alias("object_ns"), F.col("state").alias("adapter_state"))
    joined = (
        rows.join(refuters, ["object_ns", "object_val"], "left")
        .join(known, ["object_ns", "object_val"], "left")
        .join(F.broadcast(fresh), "object_ns", "left")
    )
    there, current = F.col("receipt_event_id").isNotNull(), F.coalesce(F.col("adapter_state"), F.lit("unknown")) == "current"
    validity = (
        F.when(F.col("invalidated_by").isNotNull(), "invalid").when(there, "valid").when(current, "invalid").otherwise("unknown")
    )
    return joined.select(
        "finding_id",
        "relation_id",
        "predicate",
        (F.col("state") == "asserted").alias("active"),
        (F.col("subject_val") == F.col("current_revision")).alias("on_current"),
        validity.alias("validity"),
        F.when(validity == "invalid", "invalid").when(there & current, "current").otherwise("unknown").alias("freshness"),
        "receipt_event_id",
    )


def finding_activity(findings: DataFrame, receipts: DataFrame) -> DataFrame:
    """``finding_id, kind, grade, disposition, ever_acted_on, freshness, n_receipts`` of every finding.

    Only active, valid receipts on the current revision make the disposition; ``ever_acted_on`` looks at all.
    """
    good = F.col("active") & (F.col("validity") == "valid")
    here = good & F.col("on_current")
    has = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    shown = F.col("active") & F.col("on_current")
    facts = receipts.groupBy("finding_id").agg(
        has(here & (F.col("predicate") == "promotes")).alias("promoted"),
        has(here & F.col("predicate").isin("acts_on", "promotes")).alias("acted_on"),
        has(here & (F.col("predicate") == "refutes")).alias("refuted"),
        has(here & (F.col("predicate") == "evaluates")).alias("evaluated"),
        has(good & F.col("predicate").isin("acts_on", "promotes")).alias("ever_acted_on"),
        F.count_if(shown).alias("shown"),
        has(shown & (F.col("freshness") == "invalid")).alias("some_invalid"),
        has(shown & (F.col("freshness") == "unknown")).alias("some_unknown"),
        F.count("*").alias("n_receipts"),
    )
    joined = latest(findings, "finding_id").select("finding_id", "kind", "grade").join(facts, "finding_id", "left").na.fill(False).na.fill(0)
    disposition = (
        F.when(F.col("refuted") & F.col("acted_on"), "conflicted")
        .when(F.col("promoted"), "promoted")
        .when(F.col("acted_on"), "acted_on")
        .when(F.col("refuted"), "refuted")
        .when(F.col("evaluated"), "evaluated")
        .otherwise("none")
    )
    fresh = F.when(F.col("shown") == 0, "not_applicable").when(F.col("some_invalid"), "invalid").when(F.col("some_unknown"), "unknown").otherwise("current")
    return joined.select("finding_id", "kind", "grade", disposition.alias("disposition"), "ever_acted_on", fresh.alias("freshness"), "n_receipts")


def list_findings(activity: DataFrame, kind: str | None = None, grade: str | None = None, acted_on: bool | None = None, disposition: str | None = None) -> DataFrame:
    out = activity
    for column, value in (("kind", kind), ("grade", grade), ("ever_acted_on", acted_on), ("disposition", disposition)):
        out = out if value is None else out.where(F.col(column) == value)
    return out


#: Names of the exported documents' layouts; a reader that does not know one must not guess.
CANDIDATE_LAYOUT, PROCEDURE_LAYOUT, CUSTODY_LAYOUT = (f"workledger.{x}/v1" for x in ("finding-candidate", "procedure-candidate", "finding-custody"))
_TAINT = {"classification": "derived-untrusted-data", "instruction_authority": "none", "content_policy": "structured-metadata"}


def _words(fields: dict[str, str]) -> Column:
    return F.struct(*(F.lit(v).alias(k) for k, v in fields.items()))


def _detail(name: str) -> Column:
    """A text of a finding's details, null where it is blank."""
    value = F.get_json_object("details", f"$.{name}")
    return F.when(F.trim(value) != "", value)


def candidate_documents(findings: DataFrame, project: str = "registry") -> DataFrame:
    """Export of current findings as advisory documents: ``finding_id, export_id, document``.

    The coordinate is that of the scope, else of the details, else the finding's own. The export's id follows from the
    revision, the project, the coordinate and what is suggested, so that the same finding exported again is the same document.
    """
    scope = F.get_json_object("details", "$.scope.coordinate")
    coordinate = F.coalesce(F.when(F.trim(scope) != "", scope), _detail("coordinate"), F.concat(F.lit("workledger.finding="), "finding_id"))
    rule = _detail("rule")
    stale = (F.col("kind") == "stale-gate") | F.coalesce(rule == "condition-resolved", F.lit(False))
    suggestion = F.when(stale, "review-stale-gate").when(rule == "re-minted", "review-re-mint").otherwise("review-finding")
    now = latest(findings, "finding_id").withColumns({"coordinate": coordinate, "suggestion": suggestion})
    now = now.withColumn("export_id", stable_id("fcx", F.lit(CANDIDATE_LAYOUT), "finding_id", "revision_id", F.lit(project), "coordinate", "suggestion"))
    document = F.struct(
        F.lit(CANDIDATE_LAYOUT).alias("schema"), "export_id", F.concat(F.lit("workledger.finding-export="), "export_id").alias("export_coordinate"),
        "coordinate", "evidence", "finding_id", "grade", "kind", "revision_id", "subject", "summary",
        F.struct(F.lit(project).alias("project"), "coordinate").alias("target"),
        F.struct(F.col("suggestion").alias("kind"), F.lit(True).alias("advisory_only")).alias("suggestion"), _words(_TAINT).alias("taint"),
    )
    return now.select("finding_id", "export_id", F.to_json(document).alias("document"))


def procedure_documents(findings: DataFrame) -> DataFrame:
    """Export for procedure authors: ``finding_id, export_id, document`` of findings that are not refuted, with references.

    Occurrences fall back to the evidence; blank references count for nothing. The candidate's id follows from the
    finding and stays as it is revised, the export's id from the revision.
    """
    now = latest(findings, "finding_id").where("grade <> 'refuted'")
    shown = lambda refs: F.array_sort(F.array_distinct(F.filter(refs, lambda r: F.trim(r) != "")))
    given = lambda name: F.coalesce(F.from_json(F.get_json_object("details", f"$.{name}"), "array<string>"), F.array().cast("array<string>"))
    stated = shown(given("occurrences"))
    refs = F.when(F.size(stated) > 0, stated).otherwise(shown(F.transform("evidence", lambda e: e["event_id"])))
    now = now.withColumn("candidate_id", stable_id("pcd", F.lit(PROCEDURE_LAYOUT), "finding_id"))
    now = now.withColumn("export_id", stable_id("pcx", F.lit(PROCEDURE_LAYOUT), "revision_id", "candidate_id")).withColumn("occurrence_refs", refs)
    document = F.struct(
        F.lit(PROCEDURE_LAYOUT).alias("schema"), "export_id", "candidate_id", "finding_id", "kind", "occurrence_refs", F.size("occurrence_refs").alias("count"),
        shown(F.concat(given("counterexample_refs"), given("negative_fixture_refs"))).alias("counterexample_refs"),
        shown(F.concat(given("fixture_refs"), given("exception_fixture_refs"))).alias("fixture_refs"), "revision_id", "summary", _words(_TAINT).alias("taint"),
    )
    return now.select("finding_id", "export_id", F.to_json(document).alias("document"))


def custody_documents(findings: DataFrame, receipts: DataFrame) -> DataFrame:
    """Whole history of each finding with its receipts, in order: ``finding_id, export_id, document``.

    The id follows from the revisions and the receipts' relations, in their order. A document is one finding's history, and
    as large as that is.
    """
    history = findings.groupBy("finding_id").agg(
        F.array_sort(F.collect_list(F.struct("sequence", "revision_id", "grade", "summary", "recorded_at"))).alias("history")
    )
    acts = receipts.groupBy("finding_id").agg(F.array_sort(F.collect_list(F.struct("relation_id", "predicate", "active", "validity"))).alias("receipts"))
    ids = F.concat(F.transform("history", lambda r: r["revision_id"]), F.coalesce(F.transform("receipts", lambda r: r["relation_id"]), F.array().cast("array<string>")))
    rows = history.join(acts, "finding_id", "left").withColumn("export_id", stable_id("fcu", F.lit(CUSTODY_LAYOUT), F.array_join(ids, "\0")))
    document = F.struct(F.lit(CUSTODY_LAYOUT).alias("schema"), "export_id", "finding_id", "history", "receipts")
    return rows.select("finding_id", "export_id", F.to_json(document).alias("document"))
