"""What queries leave on disk and how many rounds they take, beside their results."""

from __future__ import annotations

import os
from collections import defaultdict

from pyspark.sql import functions as F

from workledger import shared
from workledger.operators import attribution, graph, revisions

SEP = "\x01"


def folders(spark, name):
    root = shared.shared_root(spark).removeprefix("file://")
    return {x for x in os.listdir(root) if x.rsplit("-", 1)[0] == name} if os.path.isdir(root) else set()


def relations(spark, rows):
    df = spark.createDataFrame(rows, "subject_ns string, subject_val string, predicate string, object_ns string, object_val string")
    return df.withColumns({"relation_id": F.concat_ws("|", *df.columns), "record_id": F.concat_ws("|", *df.columns), "method": F.lit("exact"), "evidence_event_ids": F.array().cast("array<string>")})


def small_graph(spark):
    made = [("fab.job", f"j{i}", "produced", "somm.call", f"c{i}") for i in range(4)] + [("fab.job", f"j{i}", "produced", "git.commit", f"g{i // 2}") for i in range(3)] + [("fab.job", "j0", "mentions", "git.commit", "g9")]
    links = spark.createDataFrame([("l", "r", "somm.call", "c3", "fab.job", "j2")], "link_id string, record_id string, left_ns string, left_val string, right_ns string, right_val string")
    return relations(spark, made), links.withColumn("evidence_event_ids", F.array().cast("array<string>"))


def test_arrivals_are_those_of_walks(spark):
    rel, links = small_graph(spark)
    edges = graph.relation_edges(rel).unionByName(graph.crosswalk_edges(links))
    starts = spark.createDataFrame([(f"s{i}", f"somm.call{SEP}c{i}") for i in range(4)] + [("s0", f"somm.call{SEP}c3")], "start string, node string")
    key = ["start", "node", "used", "depth"]
    walked, arrived = graph.walks(starts, graph.placed_edges(edges)), graph.arrivals(starts, edges)
    assert sorted(map(tuple, arrived.select(*key).collect())) == sorted(map(tuple, walked.select(*key).collect()))


def test_states_are_those_of_attribute_and_leave_no_walks(spark):
    rel, links = small_graph(spark)
    cost = "event_id string, adapter string, parent_event_id string, session_id string, amount_usd decimal(38,18), kind string"
    costs = spark.createDataFrame([(f"cost{i}", "somm", f"e{i}", None, None, "marginal") for i in range(5)], cost).withColumn("amount_usd", F.lit(1).cast("decimal(38,18)"))
    events = spark.createDataFrame([(f"e{i}", "model-call", "somm", f"c{i}", None, None) for i in range(4)], "event_id string, kind string, adapter string, native_id string, session_id string, parent_event_id string")
    out = [(f"o{g}", "git", f"g{g}", "git.commit", "succeeded", f"g{g}") for g in (0, 1, 9)]
    outcomes = spark.createDataFrame(out, "event_id string, adapter string, native_id string, outcome_type string, status string, reference string").withColumn("occurred_at", F.lit("2024-01-01").cast("timestamp"))
    shown = ["event_id", "state", "reason", "outcome_node", "outcome_status", "n_candidates"]
    want = attribution.attribute(costs, events, outcomes, links, rel).select(*shown).collect()
    before = {n: folders(spark, n) for n in ("walks", "steps", "placed-edges", "edges")}
    got = attribution.states(costs, events, outcomes, links, rel).select(*shown).collect()
    assert sorted(map(str, got)) == sorted(map(str, want)) and {r.state for r in got} >= {"attributed", "unallocated"}
    assert {n: folders(spark, n) for n in before} == before


def closure(up):
    out = defaultdict(set)
    for a in up:
        todo = list(up[a])
        while todo:
            if (b := todo.pop()) in up and b not in out[a]:
                out[a].add(b)
                todo += up[b]
    return {(a, b) for a in out for b in out[a] if a != b}


def test_lineage_of_long_chains_diamonds_and_cycles_takes_few_rounds(spark):
    up = {f"e{i:03}": ([f"e{i - 1:03}"] if i else []) + ([f"e{i - 7:03}"] if i > 90 else []) for i in range(100)}
    up |= {"x": ["y"], "y": ["z", "gone"], "z": ["x", "e003"]}
    rows = spark.createDataFrame([(a, *(b + [None, None])[:2]) for a, b in up.items()], "event_id string, parent_event_id string, session_id string")
    before = folders(spark, "lineage")
    got = graph.lineage(rows, rows)
    assert sorted(map(tuple, got.select("cost_id", "event_id").collect())) == sorted(closure(up))
    assert len(folders(spark, "lineage") - before) <= 9  # 99 levels; a round each before


def test_latest_takes_the_last_of_equal_numbers_by_record(spark):
    rows = spark.createDataFrame([("a", 1, "r1", {"k": "v"}, "x"), ("a", 2, "r2", None, "y"), ("a", 2, "r3", {"k": "w"}, "z"), ("b", None, "r4", None, None)], "id string, sequence int, record_id string, m map<string,string>, v string")
    for columns in (rows.columns, ["id", "sequence", "record_id", "v"]):
        got = revisions.latest(rows.select(*columns), "id")
        assert got.columns == columns and sorted((r.id, r.record_id, r.v) for r in got.collect()) == [("a", "r3", "z"), ("b", "r4", None)]
    assert sorted(r.v for r in revisions.latest(rows.drop("m"), ["id", "v"]).where("v is not null").collect()) == ["x", "y", "z"]


def test_written_ends_shuffles_and_freed_deletes(spark):
    before = spark.conf.get(shared.SHUFFLES_END, None)
    df = shared.written(spark.range(100).groupBy((F.col("id") % 10).alias("k")).count(), "sizes")
    assert df.count() == 10 and len(folders(spark, "sizes")) == 1 and spark.conf.get(shared.SHUFFLES_END, None) == before
    shared.freed(df)
    assert not folders(spark, "sizes")


def link_rows(spark, rows):
    from workledger.plans.stored import _shaped

    df = spark.createDataFrame(rows, "link_id string, record_id string, supersedes string, recorded_at string")
    return _shaped(df.withColumn("recorded_at", F.col("recorded_at").cast("timestamp")).withColumn("state", F.lit("asserted")), "crosswalks")


def test_an_append_leaves_the_store_alone(spark):
    from workledger.operators.store import Store

    names = ("batch-crosswalks", "touched-crosswalks", "verdicts-crosswalks", "judged-crosswalks", "numbered-crosswalks", "chain")
    before = {n: folders(spark, n) for n in names}
    store = Store(spark, shared.shared_path(spark, "store"))
    chain = [("l", f"r{i}", f"r{i - 1}" if i else None, f"2024-01-0{i + 1}") for i in range(5)] + [("m", "s0", "none", "2024-01-01")]
    store.append({"crosswalks": link_rows(spark, chain[:2])})
    store.append({"crosswalks": link_rows(spark, chain)})
    assert sorted((r.record_id, r.sequence) for r in store.read("crosswalks").collect()) == [(f"r{i}", i) for i in range(5)]
    assert {n: folders(spark, n) for n in names} == before


def test_numbered_links_leave_no_unnumbered_ones(spark, tmp_path):
    from workledger.sources import base

    (tmp_path / "log").write_text("".join("\0".join([f"sha{i}", f"2024-01-0{i + 1}T00:00:00Z", "", "N", "e", "", "s", "b"]) + "\x1e" for i in range(3)))
    before = folders(spark, "ingest-crosswalks")
    found, _ = base.ingest_all(spark, {"git": f"file://{tmp_path}/log"})
    assert sorted(r.sequence for r in found.crosswalks.collect()) == [0, 1, 2]
    assert folders(spark, "ingest-crosswalks") == before


def test_a_scan_keeps_only_what_it_stored(spark, tmp_path):
    from workledger.operators.store import Store
    from workledger.sources.scan import scan

    (tmp_path / "log").write_text("\0".join(["sha", "2024-01-01T00:00:00Z", "", "N", "e", "", "s", "b"]) + "\x1e")
    names = ("scan-events", "scan-crosswalks", "scan-relations", "scan-diagnostics", "fingerprints", "judged-events", "batch-events")
    before = {n: folders(spark, n) for n in names}
    store = Store(spark, shared.shared_path(spark, "store"))
    assert [r.status for r in scan(store, {"git": f"file://{tmp_path}"}, options={"git": {"repository": "r"}}).collect()] == ["ok"]
    assert store.read("events").count() == 1 and {n: folders(spark, n) for n in names} == before


def test_many_small_files_take_few_tasks(spark, tmp_path):
    from workledger.sources import attempts

    for i in range(200):
        (tmp_path / f"part-{i}").write_text(f"{i}\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1m")
    try:
        lines = attempts._named(spark, f"file://{tmp_path}", "part-*", "text")
        assert lines.count() == 200 and lines.rdd.getNumPartitions() <= 3 * spark.sparkContext.defaultParallelism
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
