"""Strict receipt sources: candidates, evaluations, research outcomes; and memory inventories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from workledger.functions.ids import event_id, parse_time
from workledger.functions.text import json_keys
from workledger.sources.base import Ingested, json_lines, make_crosswalks, make_events, make_relations, source

SHA = r"^[0-9a-f]{64}$"
UUID = r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
RESEARCH = (
    "schema_version string, event_id string, occurred_at string, workload string, attempt struct<namespace:string,value:string>, correlation struct<namespace:string,value:string>, "
    "somm_calls array<struct<vote_index:bigint,call_id:string,served_provider:string,served_model:string>>, treatment_manifest struct<namespace:string,sha256:string>, "
    "prompt_coordinate struct<namespace:string,value:string>, domain_object struct<namespace:string,object_type:string,value:string>, "
    "outcome struct<kind:string,judgment:string,error_kind:string>, authority struct<namespace:string,value:string>, supersedes_event_id string"
)
# Keys that a research outcome may not hold at any depth, normalised, and parts of such keys.
FORBIDDEN = (
    "body completion completionbody completiontext content evidence evidencebody evidencetext prompt promptbody prompttext questiontext "
    "response responsebody responsetext rostertext snippet snippettext systemprompt systempromptbody text"
).split()
FORBIDDEN_PARTS = "token|latency|cost"


def first_reason(*checks: tuple[str, Column]) -> Column:
    """The code of the first check that fails; null if all hold. A null check fails."""
    out = F.lit(None).cast("string")
    for code, ok in reversed(checks):
        out = F.when(~F.coalesce(ok, F.lit(False)), code).otherwise(out)
    return out


def _split(rows: DataFrame, reason: Column, code: str) -> tuple[DataFrame, DataFrame]:
    judged = rows.withColumn("reason", reason)
    bad = judged.where("reason is not null").select(
        F.lit("error").alias("level"), F.lit(code).alias("code"), F.col("reason").alias("message"), F.col("file").alias("source"), F.col("line").cast("long").alias("line")
    )
    return judged.where("reason is null").drop("reason"), bad


def text_ok(c: str) -> Column:
    return (F.col(c) == F.trim(c)) & (F.col(c) != "")


def calls_ok() -> Column:
    """Votes positive and unique, call ids unique, every call with some coordinate."""
    calls = F.col("somm_calls")
    votes = F.transform(calls, lambda c: c["vote_index"])
    ids = F.array_compact(F.transform(calls, lambda c: c["call_id"]))
    named = F.forall(calls, lambda c: c["call_id"].isNotNull() | c["served_provider"].isNotNull() | c["served_model"].isNotNull())
    positive = F.forall(votes, lambda v: v.isNotNull() & (v > 0))
    return calls.isNotNull() & positive & (F.size(F.array_distinct(votes)) == F.size(votes)) & (F.size(F.array_distinct(ids)) == F.size(ids)) & named


def no_forbidden_keys(text: str = "text") -> Column:
    return ~F.exists(json_keys(text), lambda k: k.isin(*FORBIDDEN) | k.rlike(FORBIDDEN_PARTS))


@source("barnowl-research-outcome")
def research(spark: SparkSession, path: str) -> Ingested:
    """Research outcomes that pass every check; each other line gives one diagnostic with its reason."""
    rows, bad = json_lines(spark, path, RESEARCH)
    rows = rows.withColumn("at", parse_time("occurred_at"))
    o = F.col("outcome")
    reason = first_reason(
        ("event-id", F.col("event_id").rlike(UUID)), ("time", F.col("at").isNotNull() & F.col("occurred_at").endswith("Z")), ("workload", text_ok("workload")),
        ("attempt", text_ok("attempt.namespace") & text_ok("attempt.value")), ("calls", calls_ok()), ("treatment", text_ok("treatment_manifest.namespace") & F.col("treatment_manifest.sha256").rlike(SHA)),
        ("domain", text_ok("domain_object.namespace") & text_ok("domain_object.value")), ("authority", text_ok("authority.namespace")), ("forbidden-key", no_forbidden_keys()),
        ("outcome", F.when(o["kind"] == "judged", o["judgment"].isNotNull() & o["error_kind"].isNull()).when(o["kind"] == "error", o["error_kind"].isNotNull() & o["judgment"].isNull())),
        ("supersedes", F.col("supersedes_event_id").isNull() | (F.col("supersedes_event_id").rlike(UUID) & (F.col("supersedes_event_id") != F.col("event_id")))),
    )
    good, broken = _split(rows, reason, "invalid-research-outcome")
    key, kind = F.col("event_id"), "barnowl.research-outcome"
    state = F.when(o["kind"] == "error", "failed").when(o["judgment"].isin("ADMITTED", "CORROBORATED"), "succeeded").otherwise("unknown")
    attributes = {c: F.col(c) for c in ("attempt", "authority", "domain_object", "outcome", "somm_calls", "supersedes_event_id", "treatment_manifest", "workload")}
    events = make_events(good, "outcome", "barnowl-research-outcome", key, F.col("at"), {"outcome_type": F.lit(kind), "status": state, "reference": key}, attributes=attributes)
    proof = event_id(F.lit("barnowl-research-outcome"), F.lit("outcome"), key)
    calls = good.select("event_id", "at", F.explode("somm_calls").alias("c"))
    relations = make_relations(calls, "somm.call", F.col("c.call_id"), "produced", kind, key, F.col("at"), proof)
    relations = relations.unionByName(make_relations(good, kind, key, "part_of", F.col("attempt.namespace"), F.col("attempt.value"), F.col("at"), proof))
    relations = relations.unionByName(make_relations(good, kind, key, "evaluates", F.col("domain_object.namespace"), F.col("domain_object.value"), F.col("at"), proof))
    links = make_crosswalks(good, kind, key, F.col("correlation.namespace"), F.col("correlation.value"), F.col("at"), proof)
    return Ingested(spark, events, links, relations, bad.unionByName(broken))


CANDIDATE = "schema string, receipt_id string, occurred_at string, candidate_id string, status string, finding_revision_ids array<string>, evidence_event_ids array<string>, digest string"


@source("chip")
def candidates(spark: SparkSession, path: str) -> Ingested:
    """Candidate receipts; their lists must be sorted and distinct."""
    rows, bad = json_lines(spark, path, CANDIDATE)
    rows = rows.withColumn("at", parse_time("occurred_at"))
    tidy = lambda c: F.col(c) == F.array_sort(F.array_distinct(c))
    reason = first_reason(("receipt", text_ok("receipt_id")), ("candidate", text_ok("candidate_id")), ("time", F.col("at").isNotNull()), ("digest", F.col("digest").rlike(SHA)), ("findings", tidy("finding_revision_ids")), ("evidence", tidy("evidence_event_ids")))
    good, broken = _split(rows, reason, "invalid-candidate-receipt")
    key = F.col("receipt_id")
    events = make_events(good, "outcome", "chip", key, F.col("at"), {"outcome_type": F.lit("chip.candidate"), "status": F.when(F.col("status") == "accepted", "succeeded").otherwise("unknown"), "reference": F.col("candidate_id")})
    of = good.select("receipt_id", "at", F.explode("finding_revision_ids").alias("f"))
    relations = make_relations(of, "workledger.finding-revision", F.col("f"), "acts_on", "chip.candidate-receipt", key, F.col("at"), event_id(F.lit("chip"), F.lit("outcome"), key))
    return Ingested(spark, events, relations=relations, diagnostics=bad.unionByName(broken))


EVALUATION = "schema string, receipt_id string, occurred_at string, kind string, candidate_receipt_id string, evaluation_receipt_id string, finding_revision_id string, decision string"


@source("spindle")
def evaluations(spark: SparkSession, path: str) -> Ingested:
    """Evaluation and promotion receipts with two or three relations each."""
    rows, bad = json_lines(spark, path, EVALUATION, glob="*.json*")
    rows = rows.withColumn("at", parse_time("occurred_at"))
    promoted = F.col("kind") == "promotion"
    reason = first_reason(("receipt", text_ok("receipt_id")), ("kind", F.col("kind").isin("evaluation", "promotion")), ("time", F.col("at").isNotNull()), ("candidate", text_ok("candidate_receipt_id")), ("evaluation", ~promoted | text_ok("evaluation_receipt_id")))
    good, broken = _split(rows, reason, "invalid-evaluation-receipt")
    key = F.col("receipt_id")
    ns = F.concat(F.lit("spindle."), F.col("kind"), F.lit("-receipt"))
    state = F.when(F.col("decision").isin("accept", "promote", "passed"), "succeeded").when(F.col("decision").isin("reject", "failed"), "failed").otherwise("unknown")
    events = make_events(good, "outcome", "spindle", key, F.col("at"), {"outcome_type": F.concat(F.lit("spindle."), F.col("kind")), "status": state, "reference": key})
    proof = event_id(F.lit("spindle"), F.lit("outcome"), key)
    acts = F.when(promoted, "promotes").otherwise("evaluates")
    relations = make_relations(good, ns, key, "evaluates", "chip.candidate-receipt", F.col("candidate_receipt_id"), F.col("at"), proof)
    relations = relations.unionByName(make_relations(good, "workledger.finding-revision", F.col("finding_revision_id"), acts, ns, key, F.col("at"), proof))
    relations = relations.unionByName(make_relations(good.where(promoted), ns, key, "part_of", "spindle.evaluation-receipt", F.col("evaluation_receipt_id"), F.col("at"), proof))
    return Ingested(spark, events, relations=relations, diagnostics=bad.unionByName(broken))


IGNORED = r"/(\.git|node_modules|__pycache__|\.venv|dist|build)/"
ACCESS = "schema string, item string, stage string, state string, evidence_reference string, superseded_by string, occurred_at string"


def inventory(spark: SparkSession, path: str, decisions: bool = False) -> DataFrame:
    """``file, locator, item_kind, at, digest`` of memory files; decisions: only notes under a decisions folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    rows = files.where(~F.col("path").rlike(IGNORED)).select(
        F.col("path").alias("file"), F.col("modificationTime").alias("at"), F.sha2("content", 256).alias("digest"), F.col("length").alias("bytes")
    )
    base = F.element_at(F.split("file", "/"), -1)
    if decisions:
        rows = rows.where(F.col("file").rlike(r"/decisions/[^/]+\.md$") & (base != "README.md")).withColumn("item_kind", F.lit("decision"))
    else:
        rule = F.lower("file").rlike(r"\.(md|txt)$") & F.col("file").contains("/rules/")
        kind = F.when(base == "SKILL.md", "skill").when(rule, "rule").when(base.isin("AGENTS.md", "CLAUDE.md", "MEMORY.md", "memory_summary.md"), "file")
        rows = rows.withColumn("item_kind", kind).where("item_kind is not null")
    root = path.rstrip("/").replace("file://", "")
    return rows.withColumn("locator", F.regexp_replace("file", f"^(file:)?/*{root.lstrip('/')}/", ""))


@source("memory")
def memory(spark: SparkSession, path: str, system: str = "native", decisions: bool = False, log: str | None = None) -> Ingested:
    """Inventory events of memory items and the stages that an access log states; log rows without an item are
    diagnosed."""
    items = inventory(spark, path, decisions)
    name = F.lit(system)
    seen = make_events(
        items, "memory", "memory", F.concat_ws(":", name, "locator", F.lit("inventory"), "digest"), F.col("at"),
        {"system": name, "item_id": F.col("locator"), "item_kind": F.col("item_kind"), "stage": F.lit("inventory"), "state": F.lit("observed"), "evidence_reference": F.col("locator")}, attributes={"bytes": F.col("bytes"), "sha256": F.col("digest")},
    )
    if log is None:
        return Ingested(spark, seen)
    rows, bad = json_lines(spark, log, ACCESS)
    rows = rows.withColumn("at", parse_time("occurred_at")).where("at is not null")
    known = items.select(F.col("locator").alias("item"), "item_kind")
    used = make_events(
        rows.join(known, "item"), "memory", "memory", F.concat_ws(":", name, "item", "stage", "occurred_at", "line"), F.col("at"),
        {"system": name, "item_id": F.col("item"), "item_kind": F.col("item_kind"), **{c: F.col(c) for c in ("stage", "state", "evidence_reference", "superseded_by")}},
    )
    lost = rows.join(known, "item", "left_anti").select(
        F.lit("warning").alias("level"), F.lit("unknown-memory-item").alias("code"), F.col("item").alias("message"), F.col("file").alias("source"), F.col("line").cast("long").alias("line")
    )
    return Ingested(spark, seen.unionByName(used), diagnostics=bad.unionByName(lost))
