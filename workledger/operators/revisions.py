"""Append-only tables: idempotent appends, revision chains, current states.

Nothing is ever updated. An append splits a batch into rows to insert, replays of stored rows, and conflicts
that go to quarantine; chains are checked by ordered folds over one id's short history.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from workledger.schema import GRADES


def document_hash(columns: list[str]) -> Column:
    """Digest of a row's content."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}).cast("binary"), 256)


def classify_append(stored: DataFrame, batch: DataFrame, key: str, columns: list[str] | None = None) -> DataFrame:
    """``batch`` with ``verdict``: insert, replay or conflict.

    A key that the batch holds with different contents conflicts with itself in all but its smallest content;
    equal repeats are replays of their first row.
    """
    columns = columns or [c for c in batch.columns if c != key]
    digest = document_hash(columns)
    order = Window.partitionBy(key).orderBy("__doc")
    held = stored.select(key, digest.alias("__held")).dropDuplicates([key])
    rows = (
        batch.withColumn("__doc", digest)
        .withColumn("__first", F.first("__doc").over(order))
        .withColumn("__n", F.row_number().over(order))
        .join(held, key, "left")
    )
    verdict = (
        F.when(F.col("__held").isNotNull(), F.when(F.col("__held") == F.col("__doc"), "replay").otherwise("conflict"))
        .when(F.col("__doc") != F.col("__first"), "conflict")
        .when(F.col("__n") > 1, "replay")
        .otherwise("insert")
    )
    return rows.withColumn("verdict", verdict).drop("__doc", "__first", "__n", "__held")


def native_conflicts(stored: DataFrame, batch: DataFrame) -> DataFrame:
    """Events of the batch whose (adapter, kind, native_id) is stored under another id."""
    held = stored.select("adapter", "kind", "native_id", F.col("event_id").alias("__id"))
    return batch.join(held, ["adapter", "kind", "native_id"]).where("event_id <> __id").drop("__id")


def latest(records: DataFrame, key: str | list[str], order: str = "sequence") -> DataFrame:
    """The last revision of each id; of equal numbers, the one with the larger record_id where there is one.

    The winner combines before the shuffle, so an id with a long history is no large group. What moves is one struct a
    row that starts with what ranks it, so each column is carried once; columns that maps keep from being compared
    follow a copy of the ranking ones. A caller that needs few columns selects them first.
    """
    keys = [key] if isinstance(key, str) else key
    ties = [c for c in ("record_id", "revision_id") if c in records.columns and c not in (order, *keys)]
    rest = [c for c in records.columns if c not in (order, *ties, *keys)]
    if any("map<" in records.schema[c].dataType.simpleString() for c in rest):
        best = F.max_by(F.struct(order, *ties, *rest), F.struct(order, *ties))
    else:
        best = F.max(F.struct(order, *ties, *rest))
    return records.groupBy(*keys).agg(best.alias("latest_row")).select(*(c if c in keys else F.col(f"latest_row.{c}").alias(c) for c in records.columns))


def current(records: DataFrame, key: str | list[str], order: str = "sequence") -> DataFrame:
    """Ids whose last revision asserts; a refuted id has no current state."""
    return latest(records, key, order).where("state = 'asserted'")


def as_of(records: DataFrame, key: str, cutoff: Column, order: str = "sequence") -> DataFrame:
    """Current state when only revisions recorded before the cutoff count."""
    return current(records.where(F.col("recorded_at") < cutoff), key, order)


def check_crosswalk_chain(records: DataFrame) -> DataFrame:
    """``records`` with ``error``: a link's revisions must each supersede the one before."""
    order = Window.partitionBy("link_id").orderBy("sequence")
    before = F.lag("record_id").over(order)
    error = F.when(before.isNull() & F.col("supersedes").isNotNull(), "first revision supersedes").when(
        before.isNotNull() & ~F.col("supersedes").eqNullSafe(before), "does not supersede the current record"
    )
    return records.withColumn("error", error)


def _fold(records: DataFrame, key: str, fields: list[str], state: str, step: str, zero: str) -> DataFrame:
    """Ordered fold over one id's revisions; ``step`` gives the accumulator with an ``errors`` array."""
    rows = F.array_sort(F.collect_list(F.struct("sequence", *fields)))
    return (
        records.groupBy(key)
        .agg(rows.alias("rows"))
        .withColumn("out", F.expr(f"aggregate(rows, {zero}, (s, r) -> {step})"))
        .select(key, F.explode(F.arrays_zip(F.col("rows.sequence").alias("sequence"), F.col("out.errors").alias("error"))).alias("z"))
        .select(key, "z.sequence", "z.error")
    )


def check_relation_chain(records: DataFrame) -> DataFrame:
    """``relation_id, sequence, error`` of every revision; a rejected revision leaves the state as it was.

    The first revision must assert; another assertion needs evidence that none before had; a refutation must
    supersede the current record and be later than every assertion; a refuted relation is closed.
    """
    zero = (
        "named_struct('head', cast(null as string), 'state', cast(null as string), 'seen', array_repeat(cast(null as string), 0), "
        "'at', cast(null as timestamp), 'errors', array_repeat(cast(null as string), 0))"
    )
    error = (
        "case when s.head is null then case when r.state <> 'asserted' or r.supersedes is not null "
        "then 'first revision must assert' end "
        "when s.state = 'refuted' then 'history is closed' "
        "when r.state = 'asserted' then case when size(array_except(coalesce(r.evidence_event_ids, array()), s.seen)) = 0 "
        "then 'no new evidence' end "
        "when not (r.supersedes <=> s.head) then 'does not supersede the current record' "
        "when r.recorded_at <= s.at then 'not forward in time' end"
    )
    step = (
        f"named_struct('head', if(({error}) is null, r.record_id, s.head), "
        f"'state', if(({error}) is null, r.state, s.state), "
        f"'seen', if(({error}) is null, array_union(s.seen, coalesce(r.evidence_event_ids, array())), s.seen), "
        f"'at', if(({error}) is null and r.state = 'asserted', greatest(s.at, r.recorded_at), s.at), "
        f"'errors', array_append(s.errors, {error}))"
    )
    fields = ["record_id", "state", "supersedes", "recorded_at", "evidence_event_ids"]
    return _fold(records, "relation_id", fields, "state", step, zero)


def check_finding_chain(records: DataFrame) -> DataFrame:
    """``finding_id, sequence, error`` of every revision of findings.

    The first revision supersedes nothing; each next one keeps the kind, supersedes the current revision,
    is later, and never goes back on the grading ladder; a refuted finding stays refuted.
    """
    ladder = ", ".join(f"'{g}', {i}" for i, g in enumerate(GRADES[:3]))
    zero = (
        "named_struct('head', cast(null as string), 'kind', cast(null as string), 'grade', cast(null as string), "
        "'at', cast(null as timestamp), 'errors', array_repeat(cast(null as string), 0))"
    )
    error = (
        "case when s.head is null then case when r.supersedes is not null then 'first revision supersedes' end "
        "when r.kind <> s.kind then 'kind changed' "
        "when not (r.supersedes <=> s.head) then 'does not supersede the current revision' "
        "when r.recorded_at <= s.at then 'not forward in time' "
        "when s.grade = 'refuted' and r.grade <> 'refuted' then 'refuted finding revived' "
        f"when r.grade <> 'refuted' and map({ladder})[r.grade] < map({ladder})[s.grade] then 'grade moved back' end"
    )
    step = (
        f"named_struct('head', if(({error}) is null, r.revision_id, s.head), "
        f"'kind', if(({error}) is null, r.kind, s.kind), 'grade', if(({error}) is null, r.grade, s.grade), "
        f"'at', if(({error}) is null, r.recorded_at, s.at), 'errors', array_append(s.errors, {error}))"
    )
    return _fold(records, "finding_id", ["revision_id", "kind", "grade", "supersedes", "recorded_at"], "grade", step, zero)


def emit_candidates(current_findings: DataFrame, candidates: DataFrame) -> DataFrame:
    """``candidates`` with ``verdict``: insert (new), replay (same content) or revise (changed)."""
    held = current_findings.select("finding_id", F.col("content_hash").alias("__held"), F.col("revision_id").alias("supersedes"))
    joined = candidates.drop("supersedes").join(held, "finding_id", "left")
    verdict = F.when(F.col("__held").isNull(), "insert").when(F.col("__held") == F.col("content_hash"), "replay").otherwise("revise")
    return joined.withColumn("verdict", verdict).drop("__held")


def upsert_sources(manifest: DataFrame, seen: DataFrame) -> DataFrame:
    """Source manifest with the newest row of each (adapter, source)."""
    order = Window.partitionBy("adapter", "source").orderBy(F.desc("recorded_at"), F.desc("fingerprint"))
    both = manifest.unionByName(seen)
    return both.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")
