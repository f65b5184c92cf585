"""The store: appends against a sequential reference, commits, and scans that read only what changed."""

from __future__ import annotations

import json
import os
import random
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from workledger.operators import surfacing
from workledger.operators.store import TABLES, Store
from workledger.schema import GRADES
from workledger.sources.base import REGISTRY
from workledger.sources.scan import own_failure, scan
from workledger.streaming.incremental import held_calls, stream_into

START = datetime(2024, 1, 1)
LADDER = {g: i for i, g in enumerate(GRADES[:3])}


def row(name, **values):
    return tuple(values.get(f.name) for f in TABLES[name][0])


def revision(name, key, record, at, supersedes, **values):
    _, record_name, key_name = TABLES[name]
    return row(name, **{key_name: key, record_name: record, "recorded_at": START + timedelta(minutes=at), "supersedes": supersedes}, **values)


class Sequential:
    """What one append after the other would keep."""

    def __init__(self):
        self.kept = {name: [] for name in ("crosswalks", "relations", "findings")}

    def head(self, name, key):
        mine = [r for r in self.kept[name] if r[TABLES[name][2]] == key]
        return mine[-1] if mine else None

    def append(self, name, batch):
        schema, record, key = TABLES[name]
        rows = [dict(zip(schema.names, r, strict=True)) for r in batch]
        for r in sorted(rows, key=lambda r: (r["recorded_at"], r[record])):
            if all(x[record] != r[record] for x in self.kept[name]) and self.follows(name, r, self.head(name, r[key])):
                self.kept[name].append(r)

    def follows(self, name, r, head):
        if name == "crosswalks":
            return r["supersedes"] == (head and head["record_id"])
        if name == "findings":
            if head is None:
                return r["supersedes"] is None
            forward = r["grade"] == "refuted" or (head["grade"] != "refuted" and LADDER[r["grade"]] >= LADDER[head["grade"]])
            return r["supersedes"] == head["revision_id"] and r["kind"] == head["kind"] and r["recorded_at"] > head["recorded_at"] and forward
        if head is None:
            return r["state"] == "asserted" and r["supersedes"] is None
        asserted = [x for x in self.kept[name] if x["relation_id"] == r["relation_id"] and x["state"] == "asserted"]
        if head["state"] == "refuted":
            return False
        if r["state"] == "asserted":
            return bool(set(r["evidence_event_ids"]) - {e for x in asserted for e in x["evidence_event_ids"]})
        return r["supersedes"] == head["record_id"] and r["recorded_at"] > max(x["recorded_at"] for x in asserted)


def drawn_batch(draw, part, reference, n=50):
    """Revisions that now follow their history, now another record, now none."""
    out = {"crosswalks": [], "relations": [], "findings": []}
    for i in range(n):
        for name, rows in out.items():
            key, record = f"{name}{draw.randrange(5)}", f"{part}-{i}"
            head = reference.head(name, key)
            near = [f"{part}-{j}" for j in range(max(0, i - 4), i)]
            supersedes = draw.choice([None, *near, *([head[TABLES[name][1]]] * 4 if head else [])])
            extra = {"state": draw.choice(["asserted"] * 4 + ["refuted"]), "kind": draw.choice("kkkj"), "grade": draw.choice(GRADES), "evidence_event_ids": draw.sample("abcdefgh", draw.randrange(3))}
            rows.append(revision(name, key, record, part * 40 + draw.randrange(60), supersedes, **extra))
    return out


def test_batches_onto_stored_heads(spark, tmp_path):
    draw, reference, store = random.Random(5), Sequential(), Store(spark, f"file://{tmp_path}/store", buckets=3)
    for part in range(2):
        batch = drawn_batch(draw, part, reference)
        store.append({name: spark.createDataFrame(rows, TABLES[name][0]) for name, rows in batch.items()})
        for name, rows in batch.items():
            reference.append(name, rows)
            found = store.read(name).orderBy("sequence").collect()
            assert [r[TABLES[name][1]] for r in found] == [r[TABLES[name][1]] for r in reference.kept[name]]
            assert [r["sequence"] for r in found] == list(range(len(found))) and found
    again = {name: spark.createDataFrame(rows, TABLES[name][0]) for name, rows in batch.items()}
    before = {r["table"]: r["n"] for r in store.commits().where("number = 2").select("table", F.col("inserted").alias("n")).collect()}
    store.append(again)
    third = {r["table"]: r for r in store.commits().where("number = 3").collect()}
    assert all(third[name]["inserted"] == 0 and third[name]["replayed"] == before[name] for name in batch)


def test_events_that_conflict_go_to_quarantine(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    event = lambda id_, native, location="x": row("events", event_id=id_, kind="turn", adapter="a", native_id=native, location=location, recorded_at=START)
    events = lambda *rows: {"events": spark.createDataFrame(list(rows), TABLES["events"][0])}
    store.append(events(event("e1", "1"), event("e1", "1"), event("e2", "2"), event("e2", "2", "y")))
    assert sorted(r.event_id for r in store.read("events").collect()) == ["e1", "e2"]
    store.append(events(event("e1", "1"), event("e1", "1", "z"), event("e3", "1"), event("e4", "4"), event(None, "5")))
    assert sorted(r.event_id for r in store.read("events").where("event_id is not null").collect()) == ["e1", "e2", "e4"]
    refused = sorted((r.id, r.verdict) for r in store.read("quarantine").collect())
    assert refused == [("e1", "conflict"), ("e2", "conflict"), ("e3", "conflict")]


def test_a_batch_without_its_commit_is_not_seen(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    link = spark.createDataFrame([revision("crosswalks", "k", "r1", 0, None)], TABLES["crosswalks"][0])
    assert store.read("crosswalks").count() == 0 and store.manifest().count() == 0
    store.append({"crosswalks": link})
    link.withColumn("bucket", F.lit(0)).write.partitionBy("bucket").parquet(f"{store.path}/crosswalks/batch=died")
    assert [r.record_id for r in store.read("crosswalks").collect()] == ["r1"]
    store.append({"crosswalks": spark.createDataFrame([], TABLES["crosswalks"][0])})
    assert [r.sequence for r in store.read("crosswalks").collect()] == [0]


ENTRY = {"kind": "blocker", "ts": "2024-01-02T00:00:00Z", "content": "c", "tags": ["needs:human"], "refs": ["u"]}


def put(folder, name, *ids):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("".join(json.dumps(ENTRY | {"id": i}) + "\n" for i in ids))


def runs_of(found):
    (run,) = found.collect()
    return {c: run[c] for c in ("status", "sources_discovered", "sources_read", "sources_unchanged", "sources_outside_window", "sources_failed")} | {"message": run["message"]}


def test_scans_read_what_changed(spark, tmp_path):
    inbox, store = tmp_path / "inbox", Store(spark, f"file://{tmp_path}/store")
    roots = {"george": f"file://{inbox}"}
    inbox.mkdir()
    assert runs_of(scan(store, roots))["status"] == "empty"
    put(inbox, "a.jsonl", "1", "2")
    put(inbox, "b.jsonl", "3")
    first = runs_of(scan(store, roots))
    assert (first["sources_discovered"], first["sources_read"], first["sources_unchanged"]) == (2, 2, 0)
    stored = store.read("events").count()
    second = runs_of(scan(store, roots))
    assert (second["sources_read"], second["sources_unchanged"]) == (0, 2) and store.read("events").count() == stored
    put(inbox, "b.jsonl", "3", "4")  # a grown file is read again, its old records are replays
    third = runs_of(scan(store, roots))
    assert (third["sources_read"], third["sources_unchanged"]) == (1, 1)
    assert store.read("events").count() > stored
    last = {r["table"]: r for r in store.commits().where("number = 4").collect()}
    assert last["events"]["replayed"] == last["events"]["inserted"] > 0
    numbers = sorted(r.sequence for r in store.read("crosswalks").collect())
    assert numbers == list(range(len(numbers))) and numbers
    # another window or policy is another question
    assert runs_of(scan(store, roots, until="2024-01-01T00:00:00Z"))["sources_read"] == 2
    assert runs_of(scan(store, roots, policy="full"))["sources_read"] == 2
    assert runs_of(scan(store, roots, policy="full"))["sources_read"] == 0
    assert runs_of(scan(store, roots, policy="full", force=True))["sources_read"] == 2
    old = time.time() - 10_000_000
    os.utime(inbox / "a.jsonl", (old, old))
    since = datetime.fromtimestamp(old + 1000).isoformat()
    assert runs_of(scan(store, roots, since=since))["sources_outside_window"] == 1


def test_a_failing_source_is_read_again_and_stops_no_other(spark, tmp_path, monkeypatch):
    store, inbox = Store(spark, f"file://{tmp_path}/store"), tmp_path / "inbox"
    put(inbox, "a.jsonl", "1")
    (tmp_path / "other").mkdir()
    (tmp_path / "other" / "x").write_text("x")

    def broken(spark, path, **options):
        raise ValueError("no such layout")

    monkeypatch.setitem(REGISTRY, "broken", broken)
    for _ in range(2):
        runs = {r.adapter: r for r in scan(store, {"broken": f"file://{tmp_path}/other", "george": f"file://{inbox}"}).collect()}
        assert runs["broken"]["status"] == "error" and "no such layout" in runs["broken"]["message"] and runs["broken"]["sources_failed"] == 1
    assert runs["george"]["status"] == "ok" and runs["george"]["sources_unchanged"] == 1

    def lost(spark, path, **options):
        raise OSError("disk full")

    monkeypatch.setitem(REGISTRY, "broken", lost)
    with pytest.raises(OSError, match="disk full"):
        scan(store, {"broken": f"file://{tmp_path}/other"})
    assert not own_failure(OSError("x")) and own_failure(KeyError("x"))


def test_a_stream_into_the_store_adds_each_event_once(spark, tmp_path):
    store, schema = Store(spark, f"file://{tmp_path}/store"), TABLES["events"][0]
    source = f"file://{tmp_path}/in"
    event = lambda i, location="x": row("events", event_id=f"e{i}", kind="turn", adapter="a", native_id=str(i), location=location, recorded_at=START)
    spark.createDataFrame([event(1), event(2)], schema).write.mode("append").parquet(source)
    stream_into(spark.readStream.schema(schema).parquet(source), store, f"file://{tmp_path}/c")
    spark.createDataFrame([event(2), event(3), event(1, "y")], schema).write.mode("append").parquet(source)
    stream_into(spark.readStream.schema(schema).parquet(source), store, f"file://{tmp_path}/c")
    assert sorted(r.event_id for r in store.read("events").collect()) == ["e1", "e2", "e3"]
    assert [(r.id, r.verdict) for r in store.read("quarantine").collect()] == [("e1", "conflict")]
    # a checkpoint that was lost reads everything again and adds nothing
    stream_into(spark.readStream.schema(schema).parquet(source), store, f"file://{tmp_path}/other")
    assert store.read("events").count() == 3


def test_open_calls_are_held_over_a_restart(spark, tmp_path):
    use, result = "session string, call_id string, at timestamp, name string", "session string, call_id string, at timestamp, content string"
    at = lambda minutes: START + timedelta(minutes=minutes)

    def put(name, kind, *rows):
        spark.createDataFrame(list(rows), kind).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/{name}")

    def run():
        stream = lambda name, kind: spark.readStream.schema(kind).parquet(f"file://{tmp_path}/{name}")
        rows = held_calls(stream("uses", use), stream("results", result), "1 hour")
        query = rows.writeStream.format("parquet").option("path", f"file://{tmp_path}/out").option("checkpointLocation", f"file://{tmp_path}/c").trigger(availableNow=True).start()
        query.awaitTermination()
        return sorted((r.call_id, r.status, r.name, r.content) for r in spark.read.parquet(f"file://{tmp_path}/out").collect())

    put("uses", use, ("s", "c1", at(0), "t1"), ("s", "c2", at(1), "t2"), ("s", "c2", at(2), "again"))
    put("results", result, ("s", "c3", at(3), "early"))
    assert run() == []
    put("results", result, ("s", "c1", at(20), "r1"))
    put("uses", use, ("s", "c3", at(2), "t3"))
    first = [("c1", "paired", "t1", "r1"), ("c3", "paired", "t3", "early")]
    assert run() == first
    put("uses", use, ("s", "far", at(600), "t"))  # time goes on
    run()
    put("uses", use, ("s", "farther", at(1200), "t"))
    assert run()[:3] == [*first[:1], ("c2", "open", "t2", None), first[1]]


def test_reads_of_the_store(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store", buckets=2)
    event = lambda i, adapter, session: row("events", event_id=f"e{i}", kind="turn", adapter=adapter, native_id=str(i), session_id=session, occurred_at=START + timedelta(hours=i), recorded_at=START)
    links = [revision("crosswalks", "k", "r1", 0, None, state="asserted"), revision("crosswalks", "k", "r2", 1, "r1", state="refuted"), revision("crosswalks", "m", "r3", 1, None, state="asserted")]
    store.append({"events": spark.createDataFrame([event(i, "ab"[i % 2], f"s{i // 3}") for i in range(6)], TABLES["events"][0]), "crosswalks": spark.createDataFrame(links, TABLES["crosswalks"][0])})
    ids = lambda df: sorted(r.event_id for r in df.collect())
    assert ids(store.events()) == [f"e{i}" for i in range(6)] and ids(store.events(adapter="a", session_id="s0")) == ["e0", "e2"]
    assert ids(store.events(since="2024-01-01T02:00:00", until="2024-01-01T04:00:00")) == ["e2", "e3"]
    assert ids(store.events_of(spark.createDataFrame([("e1",), ("gone",), ("e1",)], "event_id string"))) == ["e1"]
    assert ids(store.events_of(spark.createDataFrame([("a", "turn", "4"), ("b", "turn", "4")], "adapter string, kind string, native_id string"))) == ["e4"]
    assert sorted(r.record_id for r in store.history("crosswalks", spark.createDataFrame([("k",)], "link_id string")).collect()) == ["r1", "r2"]
    assert [r.record_id for r in store.current("crosswalks").collect()] == ["r3"]


def test_attempts_without_a_receipt_name_their_session(spark, tmp_path):
    def attempt(job, n, *lines, backend="codex", receipt=False, spec=True):
        at = tmp_path / "jobs" / job / "attempts" / str(n)
        at.mkdir(parents=True)
        (at / "stdout").write_text("\n".join(line if isinstance(line, str) else json.dumps(line) for line in lines))
        if spec:
            (tmp_path / "jobs" / job / "spec.json").write_text(json.dumps({"id": f"id-{job}", "backend": backend, "created_at": "2024-01-01T00:00:00Z"}))
        if receipt:
            (tmp_path / "jobs" / job / "receipts").mkdir(exist_ok=True)
            (tmp_path / "jobs" / job / "receipts" / f"attempt-{n}-finished.json").write_text("{}")

    started = lambda i: {"type": "thread.started", "thread_id": i}
    attempt("a", 0, "no json", {"type": "x", "thread_id": "not"}, started("t1"), started("t2"), "late")
    attempt("a", 1, started("t3"), receipt=True)
    attempt("b", 0, {"session_id": ""}, {"conversation_id": "c1"}, backend="claude-cli")
    attempt("c", 0, {"part": {"sessionID": "o1"}}, backend="opencode")
    attempt("d", 0, started("t4"), backend="other")
    attempt("e", 0, started("t5"), spec=False)
    attempt("f", "retry", "", {"type": "y"})
    found = REGISTRY["fab-attempts"](spark, f"file://{tmp_path}/jobs")
    assert sorted((r.left_ns, r.left_val, r.right_ns, r.right_val) for r in found.crosswalks.collect()) == [
        ("claude-code.session", "c1", "fab.job", "id-b"), ("codex.session", "t1", "fab.job", "id-a"), ("fab.job", "id-c", "opencode.session", "o1"),
    ]
    assert sorted((r.code, r.source.split("/")[-4]) for r in found.diagnostics.collect()) == [("malformed-receipt-record", "a"), ("session-id-unavailable", "f")]


CASE = {"case_id": "c1", "partition": "tuning", "rule": "r", "label": "supported", "coordinates": ["x"], "evidence": ["e"]}


@pytest.mark.parametrize(
    ("change", "reason"),
    [({"case_id": "c1", "evidence": []}, "twice"), ({"partition": "held-out"}, "coordinates"), ({"partition": "held-out", "coordinates": []}, "evidence"), ({"case_id": None}, "lack")],
)
def test_corpora_are_read_whole_or_not_at_all(spark, tmp_path, change, reason):
    path = tmp_path / "cases.jsonl"
    path.write_text(json.dumps(CASE) + "\n" + json.dumps(CASE | {"case_id": "c2"} | change) + "\n")
    with pytest.raises(ValueError, match=reason):
        surfacing.read_cases(spark, f"file://{path}")


def test_nothing_is_appended_without_an_approved_rule(spark, tmp_path):
    path = tmp_path / "cases.jsonl"
    path.write_text(json.dumps(CASE) + "\n")
    assert surfacing.read_cases(spark, f"file://{path}").count() == 1
    path.write_text("")
    with pytest.raises(ValueError, match="empty"):
        surfacing.read_cases(spark, f"file://{path}")
    candidates = spark.createDataFrame([("r", 1), ("s", 2), (None, 3)], "rule string, n int")
    decided = spark.createDataFrame([("r", "surface"), ("s", "narrow")], "rule string, decision string")
    assert [r.n for r in surfacing.to_append(candidates, decided).collect()] == [1]
    for bad in (None, decided.where("rule = 's'")):
        with pytest.raises(ValueError):
            surfacing.to_append(candidates, bad)
