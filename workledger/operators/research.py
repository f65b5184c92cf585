"""Research receipts out of the event table: a strict typed parse, costs folded onto receipts, and one report of both."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from workledger.functions.ids import ref_value
from workledger.operators import effectiveness
from workledger.schema import RECEIPT_OUTCOME
from workledger.shared import written
from workledger.sources.receipts import first_reason

#: Fields that must be texts, by the name they get, and where they lie; of two places the first that is there counts.
TEXTS = {
    "workload": ("$.workload",), "attempt_namespace": ("$.attempt.namespace",), "attempt_id": ("$.attempt.attempt_id", "$.attempt.value"),
    "treatment_namespace": ("$.treatment_manifest.namespace",), "manifest_sha256": ("$.treatment_manifest.manifest_sha256", "$.treatment_manifest.sha256"),
    "authority_namespace": ("$.authority.namespace",), "domain_namespace": ("$.domain_object.namespace",),
    "domain_object_id": ("$.domain_object.object_id", "$.domain_object.value"), "outcome_kind": ("$.outcome.kind",),
}
#: Fields that are texts or absent.
OPTIONAL = {"domain_object_type": "$.domain_object.object_type", "judgment": "$.outcome.judgment", "error_kind": "$.outcome.error_kind", "predecessor": "$.supersedes_event_id"}


def _at(path: str) -> Column:
    return F.try_variant_get("v", path, "variant")


def _kind(value: Column) -> Column:
    """The type of a JSON value as it stands, null where there is none."""
    kind = F.schema_of_variant(value)
    return F.when(value.isNotNull() & (kind != "VOID"), kind)


def _text(*paths: str) -> Column:
    """A value that is a text and nothing else: numbers are not read as texts."""
    return F.coalesce(*(F.when(_kind(_at(p)) == "STRING", F.try_variant_get("v", p, "string")) for p in paths))


def receipts_of(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Outcome events of research -> receipts with typed columns; and ``event_id, reason`` of those that do not parse.

    ``events``: rows of the event table. A receipt needs its reference, each of ``TEXTS``, and a list of calls, each an object
    whose call_id is a text or null; the others may be absent but not of another type. The first thing that is wrong is named.
    """
    rows = events.where("kind = 'outcome'").where(F.col("outcome.outcome_type") == RECEIPT_OUTCOME)
    rows = rows.select("event_id", F.col("outcome.reference").alias("coordinate"), "occurred_at", F.expr("try_parse_json(attributes)").alias("v"))
    calls = F.expr("transform(try_variant_get(v, '$.somm_calls', 'array<variant>'), c -> try_variant_get(c, '$.call_id', 'variant'))")
    named = rows.withColumns({k: _text(*p) for k, p in TEXTS.items()} | {k: _text(p) for k, p in OPTIONAL.items()} | {"calls": F.when(F.schema_of_variant(_at("$.somm_calls")).startswith("ARRAY"), calls)})
    kinds = F.transform("calls", lambda c: F.when(c.isNotNull(), F.schema_of_variant(c)))
    sound = F.col("calls").isNotNull() & F.forall(kinds, lambda k: k.isNull() | k.isin("STRING", "VOID"))
    objects = F.expr("forall(try_variant_get(v, '$.somm_calls', 'array<variant>'), c -> startswith(schema_of_variant(c), 'OBJECT'))")
    checks = [("attributes", F.col("v").isNotNull()), ("reference", F.col("coordinate").isNotNull())]
    checks += [(k, F.col(k).isNotNull()) for k in TEXTS]
    checks += [(k, _kind(_at(p)).isNull() | F.col(k).isNotNull()) for k, p in OPTIONAL.items()]
    judged = named.withColumn("reason", first_reason(*checks, ("somm_calls", sound & objects)))
    judged = judged.withColumn("call_ids", F.transform("calls", lambda c: F.when(F.schema_of_variant(c) == "STRING", F.try_variant_get(c, "$", "string"))))
    judged = written(judged.drop("v", "calls"), "receipts")
    good = judged.where("reason is null").select(
        "event_id", "coordinate", "predecessor", "occurred_at", F.concat_ws("\0", "domain_namespace", "domain_object_type", "domain_object_id").alias("domain"),
        "workload", "treatment_namespace", "manifest_sha256", "authority_namespace", "domain_namespace", "domain_object_type", "outcome_kind", "judgment", "error_kind",
        F.concat_ws("\0", "attempt_namespace", "attempt_id").alias("attempt"), "call_ids",
    )
    return good, judged.where("reason is not null").select("event_id", "reason")


def costs_by_receipt(attributed: DataFrame) -> DataFrame:
    """``coordinate, n, amount_usd`` of the costs that were attributed to each receipt; ``attributed``: what ``attribute`` gives."""
    won = attributed.where("state = 'attributed'").where(F.col("outcome_type") == RECEIPT_OUTCOME)
    return won.groupBy(ref_value("outcome_node").alias("coordinate")).agg(F.count("*").alias("n"), F.sum("amount_usd").alias("amount_usd"))


def report(events: DataFrame, attributed: DataFrame, selected_calls: DataFrame, since: str, until: str, threshold: float = 0.9) -> dict[str, DataFrame]:
    """Every section of the report on receipts in [since, until), from events and attributed costs.

    Receipts outside the window still count as known predecessors. ``selected_calls``: call_id and the coordinate that its cost
    was attributed to. Receipts that do not parse are a section of their own.
    """
    if not (0 <= threshold <= 1 and since < until):
        raise ValueError("the window must not be empty, and the threshold lies within 0 and 1")
    every, failing = receipts_of(events)
    inside = (F.col("occurred_at") >= F.lit(since).cast("timestamp")) & (F.col("occurred_at") < F.lit(until).cast("timestamp"))
    receipts = written(every.where(inside), "receipts-window")
    costs = written(costs_by_receipt(attributed), "receipts-costs")
    coverage = effectiveness.call_coverage(receipts, selected_calls)
    allocated = effectiveness.window_allocation(attributed)
    gaps = written(effectiveness.gap_counts(receipts, every), "receipts-gaps")
    rows = written(effectiveness.chains(receipts, costs, every), "receipts-chains")
    return {
        "receipts": receipts, "failing": failing, "coverage": coverage, "allocation": allocated,
        "raw": effectiveness.raw_dimensions(receipts, costs), "workloads": effectiveness.grouped_yields(receipts, costs, "workload"),
        "treatments": effectiveness.grouped_yields(receipts, costs, "treatment_namespace", "manifest_sha256"), "gaps": gaps, "chains": rows,
        "funnel": effectiveness.funnel(rows), "treatment_funnel": effectiveness.treatment_funnel(rows),
        "claimability": effectiveness.claimability(coverage, allocated, gaps, rows, threshold),
    }
