"""Deterministic ids and the time text they are made of."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUL = "\0"
#: Joins a namespace and a value into one reference; sorts below every printable character.
SEP = "\x01"


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def stable_id(prefix: str, *parts: Column | str) -> Column:
    """``prefix_`` and 24 hex digits of SHA-256 over the parts; strings name columns, null counts as empty."""
    texts = [F.coalesce(col(p).cast("string"), F.lit("")) for p in parts]
    return F.concat(F.lit(prefix + "_"), F.left(F.sha2(F.concat_ws(NUL, *texts).cast("binary"), 256), F.lit(24)))


def event_id(adapter: Column | str, kind: Column | str, native_id: Column | str) -> Column:
    return stable_id("evt", adapter, kind, native_id)


def iso_text(ts: Column | str) -> Column:
    """UTC time with ``Z``; six digits of fraction, or none if they are zero. Needs a UTC session zone."""
    ts = col(ts)
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format(ts, "SSSSSS")
    return F.concat(whole, F.when(micros == "000000", "").otherwise(F.concat(F.lit("."), micros)), F.lit("Z"))


def parse_time(text: Column | str) -> Column:
    """Text with a zone -> timestamp; naive or malformed text -> null."""
    text = col(text)
    zoned = text.rlike(r"(Z|[+-]\d{2}:?\d{2})$")
    return F.when(zoned, F.try_to_timestamp(text))


def naive_utc(text: Column | str) -> Column:
    """Text whose missing zone means UTC."""
    return F.try_to_timestamp(col(text))


def epoch_seconds(x: Column | str) -> Column:
    return F.timestamp_micros(F.round(col(x).cast("double") * 1_000_000).cast("long"))


def epoch_millis(x: Column | str) -> Column:
    return F.timestamp_millis(col(x).cast("long"))


def ref(namespace: Column | str, value: Column | str) -> Column:
    """One string for a typed reference; null if the value is."""
    return F.concat(F.lit(namespace) if isinstance(namespace, str) else namespace, F.lit(SEP), col(value).cast("string"))


def ref_namespace(x: Column | str) -> Column:
    return F.substring_index(col(x), SEP, 1)


def ref_value(x: Column | str) -> Column:
    return F.expr(f"substring(`{x}`, length(substring_index(`{x}`, '\\u0001', 1)) + 2)") if isinstance(x, str) else F.regexp_replace(x, f"^[^{SEP}]*{SEP}", "")


def link_id(left: Column | str, right: Column | str) -> Column:
    """Id of an undirected link between two references."""
    low, high = F.least(col(left), col(right)), F.greatest(col(left), col(right))
    parts = [f(x) for x in (low, high) for f in (ref_namespace, lambda c: F.regexp_replace(c, f"^[^{SEP}]*{SEP}", ""))]
    return stable_id("xwl", *parts)


def relation_id(s_ns: Column | str, s_val: Column | str, predicate: Column | str, o_ns: Column | str, o_val: Column | str) -> Column:
    return stable_id("rel", s_ns, s_val, predicate, o_ns, o_val)


def float_text(x: Column | str) -> Column:
    """A confidence as text with a decimal point."""
    text = col(x).cast("double").cast("string")
    return F.when(text.contains("."), text).otherwise(F.concat(text, F.lit(".0")))


def relation_record_id(evidence: Column | str = "evidence_event_ids") -> Column:
    parts = [
        F.col("relation_id"), F.col("state"), float_text("confidence"), F.col("method"), iso_text("recorded_at"),
        F.coalesce("supersedes", F.lit("")), F.coalesce("note", F.lit("")),
    ]
    tail = F.transform(F.coalesce(col(evidence), F.array().cast("array<string>")), lambda e: F.concat(F.lit(NUL), e))
    whole = F.concat(F.concat_ws(NUL, *parts), F.array_join(tail, ""))
    return F.concat(F.lit("rrv_"), F.left(F.sha2(whole.cast("binary"), 256), F.lit(24)))
