"""Every source on rows of its shape; streaming appends."""

from __future__ import annotations

import json


from workledger.operators.accounting import costs_of, select_costs
from workledger.operators.report import freshness  # noqa: E402
from workledger.operators.quality import check_events
from workledger.operators.report import by_adapter, coverage_gaps
from workledger.sources import base, receipts, registries, tables, transcripts
from workledger.streaming import incremental


def lines(path, *rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows) + "\n")
    return f"file://{path.parent}"


def kinds(got):
    rows = got.events.groupBy("kind").count().collect()
    assert check_events(got.events).where("size(errors) > 0").select("kind", "native_id", "errors").collect() == []
    return {r["kind"]: r["count"] for r in rows}


def test_claude_transcript(spark, tmp_path):
    said = lambda n, role, content, **k: {"type": role, "uuid": f"u{n}", "sessionId": "s", "timestamp": f"2026-07-17T10:00:0{n}Z", "cwd": "/w/repo", "message": {"role": role, "content": content, **k}}
    use = [{"type": "text", "text": "hello"}, {"type": "tool_use", "id": "t1", "name": "Bash", "input": {"c": 1}}, {"type": "tool_use", "id": "t2", "name": "Bash", "input": {}}]
    path = lines(
        tmp_path / "a" / "session.jsonl",
        said(1, "user", "hi"), "not json", said(2, "assistant", use, id="m1", model="x", usage={"input_tokens": 5, "output_tokens": 2}) | {"requestId": "r1"},
        said(3, "assistant", "again", id="m1", model="x", usage={"input_tokens": 5}), said(4, "user", [{"type": "tool_result", "tool_use_id": "t1", "content": "Permission denied", "is_error": True}, {"type": "tool_result", "tool_use_id": "t9", "content": "x"}]),
        said(5, "user", "stray") | {"sessionId": "other"},
    )
    got = transcripts.claude_code(spark, path)
    assert kinds(got) == {"session": 1, "turn": 3, "model-call": 1, "cost": 1, "tool-call": 1}
    tool = got.events.where("kind = 'tool-call'").head()
    assert tool.tool_call.status == "failed" and tool.tool_call.input is None and tool.coverage["input"] == "redacted"
    assert json.loads(tool.attributes)["input_metadata"]["sha256"]
    assert sorted(r.code for r in got.diagnostics.collect()) == ["bad-json", "mixed-session", "open-tool-call", "orphan-tool-result"]
    cost = got.events.where("kind = 'cost'").head()
    assert cost.cost.accounting_key == "anthropic.request=r1" and cost.cost.input_tokens == 5
    assert got.events.where("kind = 'session'").head().session.project == "repo"
    full = transcripts.claude_code(spark, path, full=True)
    assert full.events.where("kind = 'tool-call'").head().tool_call.input == '{"c":1}'


def test_codex_rollout_and_fork(spark, tmp_path):
    t = lambda n: f"2026-07-17T10:00:0{n}Z"
    meta = lambda n, i, **k: {"timestamp": t(n), "type": "session_meta", "payload": {"id": i, "cwd": "/w/r", **k}}
    task = lambda n, turn: {"timestamp": t(n), "type": "event_msg", "payload": {"type": "task_started", "turn_id": turn}}
    message = lambda n, text: {"timestamp": t(n), "type": "response_item", "payload": {"type": "message", "role": "assistant", "content": [{"type": "output_text", "text": text}]}}
    lines(tmp_path / "a" / "p.jsonl", meta(0, "parent"), task(1, "t1"), message(2, "first"))
    path = lines(
        tmp_path / "a" / "c.jsonl", meta(3, "child", forked_from_id="parent"), task(3, "t1"), message(3, "first"), {"timestamp": t(4), "type": "turn_context", "payload": {"model": "gpt"}}, task(4, "t2"),
        {"timestamp": t(5), "type": "turn_context", "payload": {"model": "gpt"}}, message(5, "second"), {"timestamp": t(6), "type": "event_msg", "payload": {"type": "token_count", "info": {"last_token_usage": {"input_tokens": 7}}}},
        {"timestamp": t(6), "type": "response_item", "payload": {"type": "function_call", "call_id": "c", "name": "ls", "arguments": "{}"}}, {"timestamp": t(7), "type": "response_item", "payload": {"type": "function_call_output", "call_id": "c", "output": "ok"}},
        {"timestamp": t(8), "type": "event_msg", "payload": {"type": "task_complete", "turn_id": "t2"}},
    )
    got = transcripts.codex(spark, path)
    assert kinds(got) == {"session": 2, "turn": 2, "model-call": 2, "cost": 1, "tool-call": 1, "outcome": 1}
    assert got.events.where("kind = 'cost'").head().cost.model == "gpt"


def test_runner_ledger_under_receipts(spark, tmp_path):
    ledger = lines(
        tmp_path / "l" / "ledger.jsonl", {"event": "submitted", "job_id": "j1", "ts": "2026-07-17T10:00:00Z", "backend": "codex", "cwd": "/w/r", "tags": {"correlation_id": "k", "session_id": "s", "repair_of": "j0"}},
        {"event": "attempt_finished", "job_id": "j1", "attempt_idx": 0, "ts": "2026-07-17T10:01:00Z", "outcome": "errored"}, {"event": "attempt_finished", "job_id": "j1", "attempt_idx": 1, "ts": "2026-07-17T10:02:00Z", "outcome": "succeeded"},
        {"event": "status_changed", "job_id": "j1", "to": "succeeded", "ts": "2026-07-17T10:03:00Z"},
    )
    plain = registries.runner(spark, ledger)
    assert kinds(plain) == {"session": 1, "outcome": 3}
    links = {(r.left_ns, r.left_val, r.right_ns, r.right_val, r.method) for r in plain.crosswalks.collect()}
    assert links == {("correlation", v, "fab.job", "j1", "explicit") for v in ("j1", "k", "s")} | {("fab.job", "j0", "fab.job", "j1", "explicit")}
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "x.json").write_text(json.dumps({
        "receipt_id": "x", "kind": "attempt_finished", "job_id": "j1", "attempt_id": "j1:attempt:0", "attempt_idx": 0, "occurred_at": "2026-07-17T10:01:00Z", "correlation_id": "k", "outcome": {"status": "failed"},
        "accounting": {"amount_usd": "0.25", "observation_role": "rollup"}, "relations": [{"subject": {"namespace": "fab.attempt", "value": "a"}, "predicate": "produced", "object": {"namespace": "git.commit", "value": "g"}}, {"subject": {"namespace": "fab.attempt", "value": "a"}, "predicate": "attempt_of", "object": {"namespace": "fab.job", "value": "j1"}}],
    }))
    got = registries.runner(spark, ledger, receipts=f"file://{tmp_path}/r")
    assert kinds(got) == {"session": 1, "outcome": 3, "cost": 1}
    assert {(r.left_ns, r.right_ns) for r in got.crosswalks.collect()} == {("correlation", "fab.job"), ("fab.job", "fab.job")}
    assert [r.predicate for r in got.relations.collect()] == ["produced"]
    assert select_costs(costs_of(got.events)).count() == 0


def test_inbox_entries_and_gates(spark, tmp_path):
    path = lines(
        tmp_path / "i" / "inbox.jsonl", {"id": "e1", "kind": "blocker", "ts": "2026-07-17T10:00:00Z", "content": "c", "tags": ["needs:human"], "edges": [{"type": "x", "target": "A"}], "refs": ["A"]},
        {"id": "e2", "kind": "done", "ts": "2026-07-17T11:00:00Z", "refs": ["e1"], "context": {"fab_job_id": "j", "git_sha": "g", "gate_disposition": "resolved"}}, {"id": "e3", "kind": "note", "ts": "2026-07-17T11:00:00", "content": "naive"},
        {"id": "e4", "kind": "note", "ts": "2026-07-17T12:00:00Z", "context": {"gate_consultation": {"consulted": False, "mint_id": "e1"}, "finding_disposition": {"receipt_id": "e4", "finding_id": "f", "revision_id": "r", "disposition": "refuted"}}},
    )
    got = registries.inbox(spark, path)
    assert kinds(got) == {"outcome": 3, "gate-evidence": 3}
    gates = {r.gate.evidence_kind: r.gate for r in got.events.where("kind = 'gate-evidence'").collect()}
    assert gates["mint"].coordinate == "target=A" and gates["mint"].mint_id == "e1" and gates["consult"].consultation == "not_consulted" and gates["disposition"].status == "resolved"
    assert {(r.subject_ns, r.predicate, r.object_ns) for r in got.relations.collect()} == {("george.entry", "verifies", "fab.job"), ("george.entry", "verifies", "git.commit"), ("fab.job", "produced", "git.commit"), ("workledger.finding-revision", "refutes", "george.entry"), ("george.gate-mint", "part_of", "george.gate"), ("george.gate-event", "acts_on", "george.gate")}
    assert {r.native_id for r in got.events.where("kind = 'gate-evidence' and parent_event_id is not null").collect()} == {"e1", "e2", "e4"}
    views = {(r.right_ns, r.right_val, len(r.evidence_event_ids)) for r in got.crosswalks.where("right_ns like 'george.gate-%'").collect()}
    assert views == {("george.gate-mint", "e1", 2), ("george.gate-event", "e2", 2), ("george.gate-event", "e4", 2)}


def test_gate_coordinates(spark, tmp_path):
    base_ = {"kind": "blocker", "ts": "2026-07-17T10:00:00Z", "tags": ["needs:human"]}
    place = {"repo": "https://github.com/Own/Name.git", "branch": "main", "rule": "Two_Eyes  rule", "target": "T1"}
    path = lines(
        tmp_path / "c" / "inbox.jsonl", base_ | {"id": "1", "context": {"triage_coordinate": " a b "}}, base_ | {"id": "2", "context": {"work_coordinate": place}},
        base_ | {"id": "3", "context": {"triage_coordinate": place | {"target": ""}, "decision": {"coordinate": "d"}}}, base_ | {"id": "4", "edges": [{"type": "blocks", "target": "x"}, {"type": "other", "target": "y"}]},
        base_ | {"id": "5", "refs": ["x", "y"]}, base_ | {"id": "6"},
    )
    got = {r.native_id: (r.gate.coordinate, json.loads(r.attributes)["coordinate_method"]) for r in registries.inbox(spark, path).events.where("kind = 'gate-evidence'").collect()}
    assert got == {
        "1": ("context=a b", "explicit-context"), "2": ("repository=own/name|ref=main|policy=two-eyes-rule|target=t1", "explicit-structured"), "3": ("context=d", "decision-context"),
        "4": ("target=x", "exact-target"), "5": (None, "ambiguous-target"), "6": (None, "unavailable"),
    }


def test_commit_log(spark, tmp_path):
    record = "\0".join(["abc", "2026-07-17T10:00:00+02:00", "p1 p2", "N", "e", "", "subject", "body"])
    (tmp_path / "log").write_text(f"{record}\x1e\n" + "only\0three\0fields\x1e")
    got = registries.commits(spark, f"file://{tmp_path}/log", repository="r")
    assert kinds(got) == {"outcome": 1} and got.diagnostics.count() == 1 and got.crosswalks.count() == 1
    assert got.events.head().occurred_at.hour == 8


def test_session_databases(spark, tmp_path):
    def save(folder, name, rows, schema):
        spark.createDataFrame(rows, schema).write.parquet(f"file://{tmp_path}/{folder}/{name}.parquet")

    save("h", "sessions", [("s", "cli", "m", None, 1.5, None, "done", 1, 2, 3, 4, 5, "p", "metered", "0.20", None, "v", "t"), ("old", "cli", "m", None, 0.5, None, None, 0, 0, 0, 0, 0, "p", "payg", None, "0.1", "v", "t")],
         "id string, source string, model string, parent_session_id string, started_at double, ended_at double, end_reason string, input_tokens int, output_tokens int, cache_read_tokens int, cache_write_tokens int, reasoning_tokens int, billing_provider string, billing_mode string, estimated_cost_usd string, actual_cost_usd string, pricing_version string, title string")
    df = spark.read.parquet(f"file://{tmp_path}/h/sessions.parquet").selectExpr("*", "cast(null as string) as cost_source")
    df.write.parquet(f"file://{tmp_path}/g/sessions.parquet")
    save("g", "messages", [(1, "s", "user", "hi", None, None, 2.0, None), (2, "s", "assistant", "yo", None, json.dumps([{"id": "c", "function": {"name": "ls", "arguments": "{}"}}]), 3.0, "stop"), (3, "s", "tool", "out", "c", None, 4.0, None)],
         "id int, session_id string, role string, content string, tool_call_id string, tool_calls string, timestamp double, finish_reason string")
    got = tables.hermes(spark, f"file://{tmp_path}/g", since="1970-01-01 00:00:01")
    assert kinds(got) == {"session": 1, "cost": 1, "turn": 2, "model-call": 1, "tool-call": 1}
    cost = got.events.where("kind = 'cost'").head().cost
    assert (str(cost.amount_usd)[:4], cost.kind, cost.accuracy) == ("0.20", "notional", "estimated")

    save("o", "project", [("p", "proj", "/w/t")], "id string, name string, worktree string")
    save("o", "session", [("s", "p", None, "/w/t", 1000)], "id string, project_id string, parent_id string, directory string, time_created long")
    save("o", "message", [("m", "s", 2000, json.dumps({"role": "assistant", "modelID": "x", "cost": 0.5, "tokens": {"input": 3, "cache": {"read": 1}}}))], "id string, session_id string, time_created long, data string")
    save("o", "part", [("a", "m", json.dumps({"type": "text", "text": "t"})), ("b", "m", json.dumps({"type": "tool", "tool": "ls", "state": {"status": "error", "error": "no", "input": {"a": 1}}}))], "id string, message_id string, data string")
    got = tables.opencode(spark, f"file://{tmp_path}/o")
    assert kinds(got) == {"session": 1, "model-call": 1, "cost": 1, "turn": 1, "tool-call": 1}


def test_gateway_tables(spark):
    calls = spark.createDataFrame([("c1", "2026-07-17 10:00:00", "p", "m", "ok", "0.10", "s", "j:attempt:0", "q1"), ("c2", "2026-07-17 10:01:00", "p", "m", "timeout", "0.20", "s", None, None)], "id string, ts string, provider string, model string, outcome string, cost_usd string, session_id string, correlation_id string, provider_request_id string")
    results = spark.createDataFrame([("r1", "c1", "2026-07-17 10:02:00", 0.5)], "id string, call_id string, ts string, judge_score double")
    campaigns = spark.createDataFrame([("k", "completed", "2026-07-17 10:02:00", "1.5")], "id string, status string, completed_at string, spent_usd string")
    bad = spark.createDataFrame([("d",)], "id string")
    got = tables.gateway(spark, "x", {"calls": calls, "eval_results": results, "campaigns": campaigns, "decisions": bad})
    assert kinds(got) == {"session": 1, "model-call": 2, "cost": 3, "outcome": 2}
    assert {r.code for r in got.diagnostics.collect()} == {"missing-table", "missing-columns"}
    assert {(r.predicate, r.object_ns) for r in got.relations.collect()} == {("part_of", "fab.attempt"), ("evaluates", "somm.call")}
    chosen = {r.native_id: r for r in select_costs(costs_of(got.events)).collect()}
    assert set(chosen) == {"c1", "c2"} and chosen["c1"].accounting_key == "provider.request=p:q1" and chosen["c2"].accounting_key_scope == "source"
    assert {r.adapter for r in by_adapter(got.events).collect()} == {"somm"} and coverage_gaps(got.events).count() > 0


def research(**k):
    u = lambda n: f"00000000-0000-0000-0000-00000000000{n}"
    return {
        "schema_version": "1", "event_id": u(1), "occurred_at": "2026-07-17T10:00:00Z", "workload": "w", "attempt": {"namespace": "a", "value": "1"}, "correlation": {"namespace": "c", "value": "1"},
        "somm_calls": [{"vote_index": 1, "call_id": "c1"}], "treatment_manifest": {"namespace": "t", "sha256": "0" * 64}, "domain_object": {"namespace": "d", "object_type": "o", "value": "v"},
        "outcome": {"kind": "judged", "judgment": "ADMITTED"}, "authority": {"namespace": "x", "value": "y"},
    } | k


def test_strict_receipts(spark, tmp_path):
    path = lines(
        tmp_path / "b" / "r.jsonl", research(), research(prompt_text="p"), research(outcome={"kind": "error", "judgment": "ADMITTED"}), research(somm_calls=[{"vote_index": 1, "call_id": "c"}, {"vote_index": 1, "call_id": "d"}]),
        '{"a": 1, "a": 2}', research(latencyMs=3),
    )
    got = receipts.research(spark, path)
    assert kinds(got) == {"outcome": 1} and got.relations.count() == 3 and got.crosswalks.count() == 1
    assert sorted(r.message for r in got.diagnostics.collect()) == ["calls", "forbidden-key", "forbidden-key", "line is not a JSON object", "outcome"]
    path = lines(tmp_path / "c" / "c.jsonl", {"receipt_id": "r", "candidate_id": "k", "occurred_at": "2026-07-17T10:00:00Z", "status": "accepted", "digest": "0" * 64, "finding_revision_ids": ["a", "b"], "evidence_event_ids": []}, {"receipt_id": "r2", "candidate_id": "k", "occurred_at": "2026-07-17T10:00:00Z", "digest": "0" * 64, "finding_revision_ids": ["b", "a"], "evidence_event_ids": []})
    got = receipts.candidates(spark, path)
    assert kinds(got) == {"outcome": 1} and got.relations.count() == 2 and got.diagnostics.count() == 1
    path = lines(tmp_path / "s" / "s.jsonl", {"receipt_id": "p", "kind": "promotion", "occurred_at": "2026-07-17T10:00:00Z", "candidate_receipt_id": "r", "evaluation_receipt_id": "e", "finding_revision_id": "f", "decision": "promote"})
    assert {r.predicate for r in receipts.evaluations(spark, path).relations.collect()} == {"evaluates", "promotes", "part_of"}


def test_memory_files(spark, tmp_path):
    for name in ("CLAUDE.md", "skills/x/SKILL.md", "rules/a.md", "node_modules/rules/b.md", "readme.txt"):
        (tmp_path / "m" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "m" / name).write_text(name)
    row = {"item": "CLAUDE.md", "stage": "loaded", "state": "observed", "occurred_at": "2026-07-17T10:00:00Z"}
    log = lines(tmp_path / "log" / "access.jsonl", row, row | {"item": "gone.md"})
    got = receipts.memory(spark, f"file://{tmp_path}/m", log=log)
    assert kinds(got) == {"memory-evidence": 4} and [r.code for r in got.diagnostics.collect()] == ["unknown-memory-item"]


def test_failing_source_stops_no_other(spark, tmp_path):
    (tmp_path / "log").write_text("\0".join(["abc", "2026-07-17T10:00:00Z", "", "N", "e", "", "s", "b"]) + "\x1e")
    got, runs = base.ingest_all(spark, {"git": f"file://{tmp_path}/log", "hermes": f"file://{tmp_path}/none"}, since="2026-01-01")
    assert {r.adapter: r.status for r in runs.collect()} == {"git": "ok", "hermes": "error"} and got.events.count() == 1
    assert {r.adapter: r.state for r in freshness(runs).collect()} == {"git": "current", "hermes": "unknown"}
    # a source that plans well and fails as it runs
    spark.createDataFrame([("s", "not a time")], "id string, started_at string").write.parquet(f"{tmp_path}/h/sessions.parquet")
    got, runs = base.ingest_all(spark, {"hermes": f"file://{tmp_path}/h", "git": f"file://{tmp_path}/log"})
    assert {r.adapter: (r.status, r.n_events) for r in runs.collect()} == {"git": ("ok", 1), "hermes": ("error", 0)} and got.events.count() == 1
    assert [r.sequence for r in got.crosswalks.collect()] == [0]


def test_stream_appends_once(spark, tmp_path):
    git = tmp_path / "log"
    git.write_text("\0".join(["abc", "2026-07-17T10:00:00Z", "", "N", "e", "", "s", "b"]) + "\x1e")
    events = registries.commits(spark, f"file://{git}").events
    folder, table, bad, mark = (f"file://{tmp_path}/{n}" for n in ("in", "table", "bad", "mark"))
    for _ in range(2):
        events.write.mode("append").parquet(folder)
        incremental.append_stream(spark.readStream.schema(events.schema).parquet(folder), table, bad, mark)
    assert spark.read.parquet(table).count() == 1 and spark.read.parquet(bad).count() == 0
    manifest = spark.createDataFrame([], "adapter string, source string, fingerprint string, status string")
    seen = incremental.changed_sources(spark, f"file://{git}", manifest, "git")
    assert seen.count() == 1
    (row,) = seen.collect()
    manifest = spark.createDataFrame([("git", row.source, row.fingerprint, "ok")], manifest.schema)
    assert incremental.changed_sources(spark, f"file://{git}", manifest, "git").count() == 0
    with git.open("a") as f:
        f.write("more")
    assert incremental.changed_sources(spark, f"file://{git}", manifest, "git").count() == 1
