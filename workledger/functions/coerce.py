"""Coercions of source values, status tables and small classifications."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from workledger.functions.ids import col, stable_id
from workledger.schema import COST_ACCURACY, COST_BASIS, COST_KIND, ROLES


def string_or_none(x: Column | str) -> Column:
    return F.nullif(col(x).cast("string"), F.lit(""))


def first_text(*xs: Column | str) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*(string_or_none(x) for x in xs))


def number(x: Column | str) -> Column:
    return col(x).cast("string").try_cast("long")


def money(x: Column | str) -> Column:
    """Exact decimal from text; never through a double."""
    return col(x).cast("string").try_cast("decimal(38,18)")


def money_or_none(x: Column | str) -> Column:
    """As ``money``; negative amounts are null."""
    m = money(x)
    return F.when(m >= 0, m)


def boolean(x: Column | str, default: bool = False) -> Column:
    text = F.lower(F.trim(col(x).cast("string")))
    return F.when(text.isNull(), F.lit(default)).otherwise(text.isin("1", "true", "yes", "on"))


def one_of(x: Column | str, allowed: tuple[str, ...], missing: str, bad: str = "unknown") -> Column:
    x = col(x)
    return F.when(x.isNull(), missing).when(x.isin(*allowed), x).otherwise(bad)


def cost_basis(x: Column | str) -> Column:
    return one_of(x, COST_BASIS, "computed")


def cost_accuracy(x: Column | str) -> Column:
    return one_of(x, COST_ACCURACY, "estimated")


def cost_kind(x: Column | str) -> Column:
    return one_of(x, COST_KIND, "unknown")


def observation_role(x: Column | str) -> Column:
    return one_of(x, ROLES, "production")


def billing_kind(mode: Column | str) -> Column:
    """Economic kind that a billing mode names."""
    text = F.lower(F.coalesce(col(mode).cast("string"), F.lit("")))
    return (
        F.when(text.contains("included"), "included")
        .when(text.rlike("subscription|metered|notional"), "notional")
        .when(text.isin("payg", "actual"), "marginal")
        .otherwise("unknown")
    )


# Each source's words for a result, by the status they mean. The empty key is the rest.
STATUS_WORDS = {
    "gateway": {
        "succeeded": "ok success succeeded completed passed acted",
        "failed": "error failed bad_json empty off_task timeout rate_limit upstream_error exhausted",
        "reverted": "reverted revert refuted",
        "abandoned": "abandoned dismissed stopped plateau budget_exhausted",
        "": "unknown",
    },
    "campaign-action": {"succeeded": "keep", "reverted": "revert", "abandoned": "stop", "": "unknown"},
    "attempt": {"succeeded": "succeeded", "failed": "errored stuck out_of_turns agent_blocked", "": "unknown"},
    "job": {"succeeded": "succeeded", "abandoned": "cancelled", "": "failed"},
    "receipt": {
        "succeeded": "done ok pass passed succeeded success",
        "abandoned": "cancelled parked",
        "failed": "errored escalated fail failed needs_review uncertain",
        "": "unknown",
    },
    "inbox": {"succeeded": "done", "failed": "blocker", "reverted": "obviated", "": "unknown"},
    "tool": {"succeeded": "completed", "failed": "error", "started": "running pending", "": "unknown"},
    "call": {"succeeded": "ok success succeeded", "": "failed"},
    "recommendation": {"succeeded": "applied", "abandoned": "dismissed", "": "unknown"},
}


def status(x: Column | str, source: str) -> Column:
    """Status by the words of a source."""
    words = STATUS_WORDS[source]
    text = F.lower(F.trim(F.coalesce(col(x).cast("string"), F.lit(""))))
    out = F.lit(words[""])
    for meant, some in words.items():
        if meant:
            out = F.when(text.isin(*some.split()), meant).otherwise(out)
    return out


def attempt_shape(x: Column | str) -> Column:
    """Whether a correlation names one attempt of a job."""
    return col(x).rlike(r"^.+:attempt:[0-9]+$")


def project_from_cwd(x: Column | str) -> Column:
    path = F.regexp_replace(col(x), "/+$", "")
    return string_or_none(F.element_at(F.split(path, "/"), -1))


def error_category(x: Column | str) -> Column:
    """Bounded category of an error text; null stays null."""
    text = F.lower(col(x))
    has = lambda *words: text.rlike("|".join(words))
    return (
        F.when(text.isNull(), F.lit(None).cast("string"))
        .when(has("permission", "denied", "read_only", "read-only"), "permission")
        .when(text.contains("rate") & text.contains("limit"), "rate-limit")
        .when(has("timeout", "timed out"), "timeout")
        .otherwise("tool-failed")
    )


def failed_action(tool: Column | str, input_sha: Column | str) -> Column:
    """Fingerprint of a failed action; null without an input digest."""
    return F.when(string_or_none(input_sha).isNotNull(), stable_id("act", F.coalesce(string_or_none(tool), F.lit("unknown")), input_sha))


def accounting_key(provider: Column | str, request_id: Column | str, call_id: Column | str) -> tuple[Column, Column]:
    """Key and scope of a metered call: the provider's request, else the source's own call, else none."""
    request, call = string_or_none(request_id), string_or_none(call_id)
    key = F.when(
        request.isNotNull(),
        F.concat(F.lit("provider.request="), F.coalesce(col(provider), F.lit("unknown")), F.lit(":"), request),
    ).when(call.isNotNull(), F.concat(F.lit("somm.call="), call))
    scope = F.when(request.isNotNull(), "shared").when(call.isNotNull(), "source").otherwise("unknown")
    return key, scope


def procedure_class(direction: Column | str, baseline: Column | str, post: Column | str) -> Column:
    """improvement, regression or inconclusive, by the direction in which a score is better."""
    d, b, p = col(direction), col(baseline), col(post)
    better = F.when(d == "higher", p > b).when(d == "lower", p < b)
    worse = F.when(d == "higher", p < b).when(d == "lower", p > b)
    return F.when(better, "improvement").when(worse, "regression").otherwise("inconclusive")


def ratio(a: Column | str, b: Column | str, digits: int = 6) -> Column:
    """Quotient as a double, rounded; null for a zero or missing denominator."""
    return F.round(F.try_divide(col(a).cast("double"), col(b).cast("double")), digits)


def plain_decimal(x: Column | str) -> Column:
    """Decimal text without trailing zeros or exponent."""
    text = col(x).cast("decimal(38,18)").cast("string")
    return F.regexp_replace(F.regexp_replace(text, r"(\.\d*?)0+$", "$1"), r"\.$", "")


def raw_bucket(outcome_kind: Column | str, judgment: Column | str) -> Column:
    """Bucket of a research outcome: error, one of three exact judgments, or unmapped."""
    j = col(judgment)
    return F.when(col(outcome_kind) == "error", "error").when(j.isin("ADMITTED", "REJECTED", "CORROBORATED"), j).otherwise("unmapped")
