"""Row quality: each check adds a code to an ``errors`` array; rows with errors go to quarantine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from workledger.functions.ids import relation_id
from workledger.schema import COVERAGE, GRADES, KINDS, MEMORY_STAGES, PAYLOADS

KIND_FIELD = {"tool-call": "tool_call", "model-call": "model_call", "gate-evidence": "gate", "memory-evidence": "memory"}


def check(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """``df`` with ``errors``: codes of the checks that do not hold. A null result counts as a failure."""
    codes = [F.when(~F.coalesce(ok, F.lit(False)), F.lit(code)) for code, ok in checks.items()]
    return df.withColumn("errors", F.array_compact(F.array(*codes)))


def split(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good rows without the errors column, and the rows to quarantine."""
    return df.where(F.size("errors") == 0).drop("errors"), df.where(F.size("errors") > 0)


def trimmed(c: str) -> Column:
    """Null, or not blank and without outer spaces."""
    return F.col(c).isNull() | ((F.trim(c) == F.col(c)) & (F.col(c) != ""))


def check_events(events: DataFrame) -> DataFrame:
    """Kinds, one payload of the right kind, and a coverage map that fits it."""
    checks = {
        "kind": F.col("kind").isin(*KINDS),
        "source": (F.trim("adapter") != "") & (F.trim("native_id") != ""),
        "time": F.col("occurred_at").isNotNull(),
        "payloads": sum((F.col(p).isNotNull().cast("int") for p in PAYLOADS), F.lit(0)) == 1,
        "coverage-status": F.forall(F.map_values("coverage"), lambda s: s.isin(*COVERAGE)),
    }
    for payload, schema in PAYLOADS.items():
        here = F.col(payload).isNotNull()
        names = F.array(*(F.lit(n) for n in sorted(schema.names)))
        fits = F.array_sort(F.map_keys("coverage")) == names
        for n in schema.names:
            absent = F.element_at("coverage", n).isin("unavailable", "redacted")
            fits = fits & (F.col(f"{payload}.{n}").isNull() == absent)
        checks[f"coverage-{payload}"] = ~here | fits
    return check(events, checks)


def check_costs(costs: DataFrame) -> DataFrame:
    tokens = ("input_tokens", "output_tokens", "cached_input_tokens", "cache_write_tokens", "reasoning_tokens")
    not_negative = lambda c: F.col(c).isNull() | (F.col(c) >= 0)
    return check(
        costs,
        {
            "negative-amount": not_negative("amount_usd"),
            **{f"negative-{t}": not_negative(t) for t in tokens if t in costs.columns},
            "blank": trimmed("authority") & trimmed("accounting_key"),
            "scope-without-key": (F.col("accounting_key_scope") == "unknown") | F.col("accounting_key").isNotNull(),
        },
    )


def check_gates(rows: DataFrame) -> DataFrame:
    return check(rows, {c: trimmed(c) for c in ("coordinate", "mint_id", "disposition") if c in rows.columns})


def check_memory(rows: DataFrame) -> DataFrame:
    return check(
        rows,
        {
            "system": trimmed("system") & F.col("system").isNotNull(),
            "item": trimmed("item_id") & F.col("item_id").isNotNull(),
            "stage": F.col("stage").isin("inventory", *MEMORY_STAGES),
            "superseded": trimmed("superseded_by"),
        },
    )


def check_crosswalks(rows: DataFrame) -> DataFrame:
    return check(
        rows,
        {
            "self-link": (F.col("left_ns") != F.col("right_ns")) | (F.col("left_val") != F.col("right_val")),
            "confidence": F.col("confidence").between(0, 1),
            "refutation": (F.col("state") != "refuted") | F.col("supersedes").isNotNull(),
        },
    )


def check_relations(rows: DataFrame) -> DataFrame:
    refuted = F.col("state") == "refuted"
    evidence = F.coalesce("evidence_event_ids", F.array().cast("array<string>"))
    same_id = F.col("relation_id") == relation_id("subject_ns", "subject_val", "predicate", "object_ns", "object_val")
    return check(
        rows,
        {
            "self-relation": (F.col("subject_ns") != F.col("object_ns")) | (F.col("subject_val") != F.col("object_val")),
            "confidence": F.col("confidence").between(0, 1),
            "evidence": (evidence == F.array_sort(F.array_distinct(evidence))) & F.forall(evidence, lambda e: F.trim(e) != ""),
            "assertion": refuted | F.col("supersedes").isNull(),
            "refutation": ~refuted | (F.col("supersedes").isNotNull() & (F.col("confidence") == 0) & (F.trim("note") != "")),
            "relation-id": same_id,
        },
    )


def check_findings(rows: DataFrame) -> DataFrame:
    return check(
        rows,
        {"grade": F.col("grade").isin(*GRADES), "subject": (F.trim("subject") != ""), "summary": (F.trim("summary") != ""), "evidence": F.size("evidence") > 0},
    )
