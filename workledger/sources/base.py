"""Building events, links, relations and diagnostics from source rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from workledger.functions.ids import col, event_id, iso_text, relation_id, stable_id
from workledger.functions.text import coverage_of
from workledger.schema import CROSSWALKS, DIAGNOSTICS, EVENTS, PAYLOADS, RELATIONS

KIND_OF = {"tool_call": "tool-call", "model_call": "model-call", "gate": "gate-evidence", "memory": "memory-evidence"}


@dataclass
class Ingested:
    """What one source gave; empty frames where it gives none of a kind."""

    spark: SparkSession
    events: DataFrame | None = None
    crosswalks: DataFrame | None = None
    relations: DataFrame | None = None
    diagnostics: DataFrame | None = None
    extra: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        for name, schema in (("events", EVENTS), ("crosswalks", CROSSWALKS), ("relations", RELATIONS), ("diagnostics", DIAGNOSTICS)):
            if getattr(self, name) is None:
                setattr(self, name, self.spark.createDataFrame([], schema))

    def __add__(self, other: Ingested) -> Ingested:
        return Ingested(
            self.spark,
            *(getattr(self, n).unionByName(getattr(other, n)) for n in ("events", "crosswalks", "relations", "diagnostics")),
        )

    def window(self, since: str | None, until: str | None) -> tuple[Ingested, DataFrame]:
        """Records in [since, until), and how many of each kind lie outside."""
        outside = []

        def cut(df: DataFrame, at: str, name: str) -> DataFrame:
            inside = F.lit(True) if since is None and until is None else F.col(at).isNotNull()
            if since is not None:
                inside = inside & (F.col(at) >= F.lit(since).cast("timestamp"))
            if until is not None:
                inside = inside & (F.col(at) < F.lit(until).cast("timestamp"))
            outside.append(df.where(~inside).agg(F.lit(name).alias("record"), F.count("*").alias("outside_window")))
            return df.where(inside)

        kept = Ingested(
            self.spark, cut(self.events, "occurred_at", "events"), cut(self.crosswalks, "recorded_at", "crosswalks"),
            cut(self.relations, "recorded_at", "relations"), self.diagnostics,
        )
        return kept, outside[0].union(outside[1]).union(outside[2])


def json_object(fields: dict[str, Column]) -> Column:
    """Canonical JSON of named columns, nulls kept, keys sorted."""
    return F.to_json(F.struct(*(fields[k].alias(k) for k in sorted(fields))), {"ignoreNullFields": "false"}) if fields else F.lit("{}")


def make_events(
    rows: DataFrame,
    payload: str,
    adapter: str,
    native_id: Column,
    occurred_at: Column,
    values: dict[str, Column],
    session_native: Column | None = None,
    session_id: Column | None = None,
    parent_event_id: Column | None = None,
    attributes: dict[str, Column] | None = None,
    coverage: dict[str, str] | None = None,
    location: Column | None = None,
) -> DataFrame:
    """One event per row. Unnamed payload fields are null; ids follow from adapter, kind and native id."""
    kind = KIND_OF.get(payload, payload)
    text = F.lit(None).cast("string")
    structs = []
    for name, schema in PAYLOADS.items():
        if name != payload:
            structs.append(F.lit(None).cast(schema).alias(name))
            continue
        fields = [values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in schema]
        structs.append(F.struct(*fields).alias(name))
    if session_id is None and session_native is not None:
        session_id = event_id(F.lit(adapter), F.lit("session"), session_native)
    out = rows.select(
        event_id(F.lit(adapter), F.lit(kind), native_id).alias("event_id"), F.lit(kind).alias("kind"),
        F.lit(adapter).alias("adapter"), native_id.cast("string").alias("native_id"), (text if location is None else location).alias("location"),
        occurred_at.alias("occurred_at"), occurred_at.alias("recorded_at"), (text if session_id is None else session_id).alias("session_id"),
        (text if parent_event_id is None else parent_event_id).alias("parent_event_id"), json_object(attributes or {}).alias("attributes"), *structs,
    )
    return out.withColumn("coverage", coverage_of(payload, coverage)).select(*EVENTS.names)


def make_crosswalks(rows: DataFrame, left_ns: str | Column, left: Column, right_ns: str | Column, right: Column, at: Column, evidence: Column | list[Column], method: str = "exact") -> DataFrame:
    """Asserted identity links; rows with an empty end, or that link a thing to itself, give none."""
    ns = lambda x: F.lit(x) if isinstance(x, str) else x
    ends = rows.select(
        F.struct(ns(left_ns).alias("ns"), left.cast("string").alias("val")).alias("x"),
        F.struct(ns(right_ns).alias("ns"), right.cast("string").alias("val")).alias("y"),
        at.alias("recorded_at"), F.array_sort(F.array(*evidence if isinstance(evidence, list) else [evidence])).alias("evidence_event_ids"),
    ).where("x.val <> '' and y.val <> '' and x <> y")
    low, high = F.least("x", "y"), F.greatest("x", "y")
    rows = ends.select(
        low["ns"].alias("left_ns"), low["val"].alias("left_val"), high["ns"].alias("right_ns"), high["val"].alias("right_val"),
        F.lit("asserted").alias("state"), F.lit(1.0).alias("confidence"), F.lit(method).alias("method"), "recorded_at",
        F.lit(None).cast("string").alias("supersedes"), F.lit(None).cast("string").alias("note"), "evidence_event_ids",
        F.lit(0).cast("long").alias("sequence"),
    )
    rows = rows.withColumn("link_id", stable_id("xwl", "left_ns", "left_val", "right_ns", "right_val"))
    return rows.withColumn("record_id", stable_id("xwr", "link_id", "state", iso_text("recorded_at"))).select(*CROSSWALKS.names)


def make_relations(rows: DataFrame, s_ns: str | Column, s: Column, predicate: str | Column, o_ns: str | Column, o: Column, at: Column, evidence: Column, method: str = "source_receipt") -> DataFrame:
    """Asserted relations; rows with an empty end or equal ends give none."""
    from workledger.functions.ids import relation_record_id

    ns = lambda x: F.lit(x) if isinstance(x, str) else x
    out = rows.select(
        ns(s_ns).alias("subject_ns"), s.cast("string").alias("subject_val"), ns(predicate).alias("predicate"), ns(o_ns).alias("object_ns"),
        o.cast("string").alias("object_val"), F.lit("asserted").alias("state"), F.lit(1.0).alias("confidence"), F.lit(method).alias("method"),
        at.alias("recorded_at"), F.lit(None).cast("string").alias("supersedes"), F.lit(None).cast("string").alias("note"),
        F.array(evidence).alias("evidence_event_ids"), F.lit(0).cast("long").alias("sequence"),
    ).where("subject_val <> '' and object_val <> '' and (subject_ns <> object_ns or subject_val <> object_val)")
    out = out.withColumn("relation_id", relation_id("subject_ns", "subject_val", "predicate", "object_ns", "object_val"))
    return out.withColumn("record_id", relation_record_id()).select(*RELATIONS.names)


def json_lines(spark: SparkSession, path: str, schema: str, modified_after: str | None = None, glob: str = "*.jsonl", skip: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Lines of JSON files with ``file`` and ``line`` (from 1), and a diagnostic for each bad one.

    Large files are read in parts. Rows are numbered where they are read; the number of the first row of a part
    and the sizes of the parts before it, a row a part, give the line. Bad lines never stop their neighbours.
    """
    reader = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob)
    if modified_after:
        reader = reader.option("modifiedAfter", modified_after)
    rows = reader.format("text").load(path).select(
        F.col("value").alias("text"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("part"),
        F.monotonically_increasing_id().alias("row"),
    )
    parts = rows.groupBy("file", "part").agg(F.min("row").alias("first"), F.count("*").alias("n"))
    ahead = F.sum("n").over(Window.partitionBy("file").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.withColumn("at", F.coalesce(ahead, F.lit(0)) - F.col("first") + 1).drop("n", "first")
    lines = rows.join(parts, ["file", "part"]).where("trim(text) <> ''")
    if skip:
        lines = lines.where(~F.element_at(F.split("file", "/"), -1).rlike(skip))
    parsed = lines.select("file", (F.col("row") + F.col("at")).cast("int").alias("line"), "text", F.from_json("text", schema, {"mode": "PERMISSIVE"}).alias("r"), F.expr("try_parse_json(text)").isNotNull().alias("ok"))
    object_ = F.col("ok") & F.ltrim("text").startswith("{")
    bad = parsed.where(~object_).select(
        F.lit("warning").alias("level"), F.lit("bad-json").alias("code"), F.lit("line is not a JSON object").alias("message"),
        F.col("file").alias("source"), F.col("line").cast("long").alias("line"),
    )
    return parsed.where(object_).select("file", "line", "text", "r.*"), bad


def require_columns(df: DataFrame, source: str, required: tuple[str, ...], optional: tuple[str, ...] = ()) -> tuple[DataFrame | None, DataFrame | None]:
    """The table with missing optional columns as nulls; or no table and a diagnostic."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        row = [("error", "missing-columns", ", ".join(missing), source, None)]
        return None, df.sparkSession.createDataFrame(row, DIAGNOSTICS)
    return df.select(*(F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in required + optional)), None


def pair_tools(uses: DataFrame, results: DataFrame, *keys: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Uses joined to the first later result of their call, results without a use, uses without a result.

    Both carry ``keys`` and ``line``; of repeated call ids the first line counts.
    """
    first_use = uses.groupBy(*keys).agg(F.min_by(F.struct(*[c for c in uses.columns if c not in keys]), "line").alias("use"))
    first_result = results.groupBy(*keys).agg(F.min_by(F.struct(*[c for c in results.columns if c not in keys]), "line").alias("result"))
    both = first_use.join(first_result, list(keys)).where("result.line > use.line")
    done = both.select(*keys)
    return both, first_result.join(done, list(keys), "left_anti"), first_use.join(done, list(keys), "left_anti")


#: User-written sources by name: ``f(spark, path, **options) -> Ingested``.
REGISTRY: dict[str, Callable[..., Ingested]] = {}


def source(name: str):
    def add(f):
        REGISTRY[name] = f
        return f

    return add


RUNS = (
    "adapter string, source string, sequence long, status string, message string, sources_failed long, "
    "sources_outside_window long, n_events long, n_crosswalks long, n_relations long, n_diagnostics long"
)


def numbered(records: DataFrame, start: int = 0) -> DataFrame:
    """``records`` with a ``sequence`` by (recorded_at, record_id), from ``start``: a total order of revisions."""
    from workledger.shared import written

    ordered = written(records.drop("sequence").repartitionByRange("recorded_at", "record_id").sortWithinPartitions("recorded_at", "record_id").withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()), "numbered")
    sizes = ordered.groupBy("part").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    sizes = sizes.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    placed = ordered.join(F.broadcast(sizes.select("part", "first", "before")), "part")
    return placed.withColumn("sequence", (F.lit(start) + F.col("before") + F.col("at") - F.col("first")).cast("long")).select(*records.columns)


def ingest_all(spark: SparkSession, roots: dict[str, str], since: str | None = None, until: str | None = None, first_sequence: int = 0, first_revision: int = 0, **options) -> tuple[Ingested, DataFrame]:
    """Run the named sources over their roots, and say in ``RUNS`` how each one went.

    A source's rows are written before the next one starts, so one that fails, while it is planned or while
    it runs, gives a failed run and no rows and stops no other. Links and relations are numbered over all, from
    ``first_revision``; a ``store`` numbers them on by itself.
    """
    from workledger.shared import freed, written
    from workledger.sources.scan import own_failure

    total, runs, unnumbered = Ingested(spark), [], []
    for n, (name, path) in enumerate(roots.items(), first_sequence):
        try:
            kept, outside = REGISTRY[name](spark, path, **options).window(since, until)
            parts = {k: written(getattr(kept, k), f"ingest-{k}") for k in ("events", "crosswalks", "relations", "diagnostics")}
            left = sum(r["outside_window"] for r in outside.collect())
            runs.append((name, path, n, "ok", None, 0, left, *(df.count() for df in parts.values())))
            total = total + Ingested(spark, **parts)
            unnumbered += [parts["crosswalks"], parts["relations"]]
        except Exception as broken:  # a source's own failure is a result here; a full disk or a lost folder is not
            if not own_failure(broken):
                raise
            runs.append((name, path, n, "error", str(broken)[:500], 1, 0, 0, 0, 0, 0))
    total.crosswalks, total.relations = numbered(total.crosswalks, first_revision), numbered(total.relations, first_revision)
    freed(*unnumbered)
    return total, spark.createDataFrame(runs, RUNS)
