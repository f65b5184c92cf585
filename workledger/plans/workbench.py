"""The test tables seen as the engine's tables, by arithmetic that Spark and SQL share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from workledger.functions.ids import event_id, relation_id, stable_id
from workledger.operators import revisions
from workledger.schema import MONEY

ADAPTERS = ("claude-code", "codex", "hermes", "opencode", "somm")
SINCE, CUTOFF, MEMORY_CUTOFF = "2024-01-01", "2024-01-31", "2024-03-01"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(values: tuple, n) -> F.Column:
    return F.element_at(F.array(*(F.lit(v) for v in values)), (n + 1).cast("int"))


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` with its helper columns."""
    e = table(spark, sf_dir, "events")
    i = F.col("event_id")
    return e.select(
        F.col("event_id").alias("raw_id"), F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value",
        F.get_json_object("props", "$.k").cast("int").alias("k"),
        (i % 3).alias("e1"), (F.floor(i / 3) % 3).alias("e2"), (F.floor(i / 9) % 3).alias("e3"), (F.floor(i / 27) % 4).alias("e4"),
        F.date_trunc("week", "ts").alias("wk"),
        pick(ADAPTERS, F.col("user_id") % 5).alias("adapter"),
    ).withColumn("session_native", F.concat_ws("-", "user_id", F.date_format("wk", "yyyy-MM-dd"))).withColumn(
        "session_id", event_id("adapter", F.lit("session"), "session_native")
    )


def costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = base(spark, sf_dir).where("event_type = 'purchase'")
    scope = pick(("shared", "source", "unknown"), F.col("e1"))
    return b.select(
        event_id("adapter", F.lit("cost"), F.col("raw_id")).alias("event_id"), "adapter",
        F.col("raw_id").cast("string").alias("native_id"), F.col("ts").alias("occurred_at"), "session_id",
        F.lit(None).cast("string").alias("parent_event_id"),
        F.when(F.col("k") % 10 != 0, F.col("value").cast("decimal(18,6)")).cast(MONEY).alias("amount_usd"),
        pick(("reported", "computed", "unknown"), F.col("e2")).alias("basis"),
        pick(("marginal", "notional", "included", "unknown"), F.col("e4")).alias("kind"),
        pick(("actual", "estimated", "unknown"), F.col("e3")).alias("accuracy"),
        F.lit(None).cast("string").alias("authority"),
        F.when(scope != "unknown", F.concat(F.lit("req="), F.col("k"))).alias("accounting_key"),
        scope.alias("accounting_key_scope"),
        F.when(F.col("k") % 10 == 1, "rollup").otherwise("production").alias("observation_role"),
        F.col("k").cast("long").alias("input_tokens"),
    )


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base(spark, sf_dir).select("session_id", "adapter", F.col("session_native").alias("native_id")).distinct()


def tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = base(spark, sf_dir).where("event_type in ('click', 'error')")
    failed = F.col("event_type") == "error"
    return b.select(
        event_id("adapter", F.lit("tool-call"), F.col("raw_id")).alias("event_id"), "session_id", "ts",
        F.concat(F.lit("tool_"), F.col("k") % 7).alias("tool_name"),
        F.when(failed, "failed").otherwise("succeeded").alias("status"),
        F.when(failed, pick(("permission denied", "rate limit", "timed out"), F.col("k") % 3)).alias("error"),
        F.sha2((F.col("k") % 5).cast("string").cast("binary"), 256).alias("input_sha"),
    )


def gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = base(spark, sf_dir)
    kind = F.col("event_type")
    evidence = F.when(kind == "signup", "mint").when(kind == "view", "consult").when((kind == "purchase") & (F.col("value") > 200), "decision")
    return (
        b.withColumn("evidence_kind", evidence)
        .where("evidence_kind is not null")
        .select(
            event_id(F.lit("george"), F.lit("gate-evidence"), F.col("raw_id")).alias("event_id"), F.col("ts").alias("occurred_at"), "evidence_kind",
            F.when(F.col("user_id") % 20 != 0, F.concat(F.lit("target="), F.col("user_id"))).alias("coordinate"),
            F.when(F.col("evidence_kind") == "mint", F.concat(F.lit("mint-"), F.col("raw_id"))).alias("mint_id"),
            F.when(F.col("evidence_kind") == "decision", "resolved").otherwise("open").alias("status"),
            F.when(F.col("evidence_kind") == "consult", F.when(F.col("k") % 3 == 0, "consulted").when(F.col("k") % 3 == 1, "not_consulted")).alias("consultation"),
            F.lit(False).alias("ambiguous"),
        )
    )


def memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    stages = {"signup": "inventory", "view": "loaded", "click": "retrieved", "purchase": "referenced", "error": "applied"}
    names = F.create_map(*(F.lit(v) for pair in stages.items() for v in pair))
    b = base(spark, sf_dir)
    observed = (F.col("event_type") == "signup") | (F.col("k") % 2 == 0)
    return b.select(
        event_id(F.lit("memory"), F.lit("memory-evidence"), F.col("raw_id")).alias("event_id"), F.col("ts").alias("occurred_at"),
        (F.col("user_id") % 2).cast("string").alias("system"), F.col("user_id").cast("string").alias("item_id"),
        F.element_at(names, F.col("event_type")).alias("stage"),
        F.when(observed, "observed").otherwise("not_observed").alias("state"),
        F.when(F.col("k") % 25 == 0, F.concat(F.lit("item-"), F.col("k"))).alias("superseded_by"),
    )


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as the metered calls that their costs hang on."""
    o = table(spark, sf_dir, "orders")
    return o.select(
        event_id(F.lit("somm"), F.lit("model-call"), F.col("o_orderkey")).alias("event_id"), F.lit("model-call").alias("kind"),
        F.lit("somm").alias("adapter"), F.col("o_orderkey").cast("string").alias("native_id"),
        F.lit(None).cast("string").alias("session_id"), F.lit(None).cast("string").alias("parent_event_id"),
    )


def order_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    none = F.lit(None).cast("string")
    return o.select(
        event_id(F.lit("somm"), F.lit("cost"), F.col("o_orderkey")).alias("event_id"), F.lit("somm").alias("adapter"),
        F.col("o_orderkey").cast("string").alias("native_id"), F.col("o_orderdate").cast("timestamp").alias("occurred_at"),
        none.alias("session_id"),
        F.when(F.col("o_orderkey") % 50 != 0, event_id(F.lit("somm"), F.lit("model-call"), F.col("o_orderkey"))).alias("parent_event_id"),
        F.col("o_totalprice").cast("decimal(18,2)").cast(MONEY).alias("amount_usd"), F.lit("reported").alias("basis"),
        F.lit("marginal").alias("kind"), F.lit("actual").alias("accuracy"), none.alias("authority"), none.alias("accounting_key"),
        F.lit("unknown").alias("accounting_key_scope"), F.lit("production").alias("observation_role"),
    )


#: What tells relations of ``relation_rows`` apart, as their subjects and predicates are of one kind.
RELATION_KEY = ["subject_val", "object_ns", "object_val"]


def relation_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Job-to-commit revisions from lineitem, in shipping order, and job-to-call relations from orders, without ids."""
    li = table(spark, sf_dir, "lineitem")
    order = ["l_shipdate", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]
    commit = F.concat_ws("-", "l_orderkey", "l_suppkey")
    made = li.select(
        F.col("l_orderkey").cast("string").alias("subject_val"), F.lit("git.commit").alias("object_ns"), commit.alias("object_val"),
        F.when(F.col("l_returnflag") == "A", "refuted").otherwise("asserted").alias("state"),
        F.col("l_shipdate").cast("timestamp").alias("recorded_at"), F.struct(*order).alias("sequence"),
    )
    blank = F.struct(*(F.lit(None).cast(li.schema[c].dataType).alias(c) for c in order))
    o = table(spark, sf_dir, "orders").where("o_orderkey % 10 <> 9")
    linked = o.select(
        F.col("o_orderkey").cast("string").alias("subject_val"), F.lit("somm.call").alias("object_ns"),
        F.col("o_orderkey").cast("string").alias("object_val"), F.lit("asserted").alias("state"),
        F.col("o_orderdate").cast("timestamp").alias("recorded_at"), blank.alias("sequence"),
    )
    return made.unionByName(linked)


def relation_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``relation_rows`` with their ids."""
    return _identified(relation_rows(spark, sf_dir))


def current_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations whose last revision asserts; ids are made of what is left, so they are not moved."""
    return _identified(revisions.current(relation_rows(spark, sf_dir).drop("recorded_at"), RELATION_KEY))


def _identified(rows: DataFrame) -> DataFrame:
    both = rows.withColumn("subject_ns", F.lit("fab.job")).withColumn("predicate", F.lit("produced"))
    ids = both.withColumn("relation_id", relation_id("subject_ns", "subject_val", "predicate", "object_ns", "object_val"))
    return ids.withColumns(
        {
            "record_id": stable_id("rrv", "relation_id", F.to_json("sequence")),
            "method": F.lit("exact"),
            "evidence_event_ids": F.array().cast("array<string>"),
        }
    )


def crosswalks(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").where("o_orderkey % 20 = 9").select(F.col("o_orderkey").cast("string").alias("v"))
    out = None
    for left, right in (("correlation", "somm.call"), ("correlation", "fab.job")):
        part = o.select(
            F.lit(left).alias("left_ns"), F.col("v").alias("left_val"), F.lit(right).alias("right_ns"), F.col("v").alias("right_val"),
            stable_id("xwl", F.lit(left), "v", F.lit(right), "v").alias("link_id"),
            stable_id("xwr", F.lit(left), "v", F.lit(right), "v").alias("record_id"),
            F.array().cast("array<string>").alias("evidence_event_ids"),
        )
        out = part if out is None else out.unionByName(part)
    return out


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs from orders and commits from lineitem."""
    o = table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "succeeded").when(F.col("o_orderstatus") == "P", "failed").otherwise("unknown")
    jobs = o.select(
        event_id(F.lit("fab"), F.lit("outcome"), F.col("o_orderkey")).alias("event_id"), F.lit("fab").alias("adapter"),
        F.col("o_orderkey").cast("string").alias("native_id"), F.col("o_orderdate").cast("timestamp").alias("occurred_at"),
        F.lit("fab.job").alias("outcome_type"), status.alias("status"), F.col("o_orderkey").cast("string").alias("reference"),
    )
    commit = F.concat_ws("-", "l_orderkey", "l_suppkey")
    commits = table(spark, sf_dir, "lineitem").groupBy(commit.alias("reference")).agg(F.min("l_shipdate").cast("timestamp").alias("occurred_at"))
    commits = commits.select(
        event_id(F.lit("git"), F.lit("outcome"), "reference").alias("event_id"), F.lit("git").alias("adapter"),
        F.col("reference").alias("native_id"), "occurred_at", F.lit("git.commit").alias("outcome_type"),
        F.lit("succeeded").alias("status"), "reference",
    )
    return jobs.unionByName(commits)


def receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as research receipts chained by turn, some with broken links."""
    c = table(spark, sf_dir, "conversations")
    conv, turn = F.col("conv_id").cast("string"), F.col("turn")
    judgment = F.when(F.col("role") == "user", "ADMITTED").when(F.col("role") == "assistant", "CORROBORATED").otherwise("REJECTED")
    return c.select(
        F.concat_ws("/", conv, turn).alias("coordinate"),
        F.when(turn > F.lit(0), F.concat_ws("/", conv, turn - 1)).alias("predecessor"),
        (F.lit(SINCE).cast("timestamp").cast("long") + turn * 60).cast("timestamp").alias("occurred_at"),
        F.when(turn == 5, F.concat(conv, F.lit("-other"))).otherwise(conv).alias("domain"),
        F.concat(F.lit("w"), F.col("conv_id") % 4).alias("workload"),
        F.concat(F.lit("t"), F.col("conv_id") % 3).alias("treatment_namespace"),
        F.concat(F.lit("m"), F.col("conv_id") % 2).alias("manifest_sha256"),
        F.lit("review").alias("authority_namespace"), F.lit("conversation").alias("domain_namespace"), F.lit("thread").alias("domain_object_type"),
        F.lit("judged").alias("outcome_kind"), judgment.alias("judgment"), F.lit(None).cast("string").alias("error_kind"),
        F.concat_ws("/", conv, turn).alias("attempt"),
        F.array(F.when(turn % 3 != 0, F.concat(F.lit("c"), F.col("conv_id"), F.lit("-"), F.floor(turn / 2)))).alias("call_ids"),
    )
