"""The event table as the flat rows that projections read: one view per payload."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from workledger.functions.text import sha256_text


def sessions_of(events: DataFrame) -> DataFrame:
    """``session_id, adapter, native_id, occurred_at`` and the payload of every session."""
    return events.where("kind = 'session'").select(F.col("event_id").alias("session_id"), "adapter", "native_id", "occurred_at", "session.*")


def tools_of(events: DataFrame) -> DataFrame:
    """Tool calls with ``input_sha``: of the stored input, or else the digest that its metadata keeps."""
    kept = F.get_json_object("attributes", "$.input_metadata.sha256")
    rows = events.where("kind = 'tool-call'")
    return rows.select(
        "event_id", "session_id", "adapter", "occurred_at", "tool_call.tool_name", "tool_call.status", "tool_call.error",
        F.coalesce(sha256_text("tool_call.input"), kept).alias("input_sha"),
    )


def outcomes_of(events: DataFrame) -> DataFrame:
    return events.where("kind = 'outcome'").select("event_id", "adapter", "native_id", "occurred_at", "session_id", "outcome.*")


def gates_of(events: DataFrame) -> DataFrame:
    """Gate evidence; ``ambiguous`` as the source found its coordinate."""
    ambiguous = F.coalesce(F.get_json_object("attributes", "$.coordinate_ambiguous").cast("boolean"), F.lit(False))
    return events.where("kind = 'gate-evidence'").select("event_id", "adapter", "native_id", "occurred_at", "gate.*", ambiguous.alias("ambiguous"))


def memory_of(events: DataFrame) -> DataFrame:
    return events.where("kind = 'memory-evidence'").select("event_id", "adapter", "occurred_at", "memory.*")
