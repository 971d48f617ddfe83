"""Parsers on small logs of our own, and the incremental store fed by them."""

import json
import sqlite3

import pytest
import zstandard

import tracelake.sources as sources
from tracelake.operators import merge
from tracelake.sources.base import iso, zstd_frames


def log(*rows):
    return "".join(json.dumps(r) + "\n" for r in rows).encode()


def parsed(name, files):
    out = {}
    for kind, row in sources.REGISTRY[name].parse(files):
        out.setdefault(kind, []).append(row)
    return out


def user(uuid, text, parent=None, at="2024-01-01T00:00:00Z", **more):
    return {"type": "user", "uuid": uuid, "parentUuid": parent, "timestamp": at, "message": {"role": "user", "content": text}, **more}


def test_claude():
    main = log(
        {"type": "ai-title", "aiTitle": "low"}, {"type": "custom-title", "customTitle": "high"}, user("u1", "hi", cwd="/w", gitBranch="b", version="2"),
        {"type": "assistant", "uuid": "u2", "parentUuid": "u1", "timestamp": "2024-01-01T01:00:05+01:00", "message": {"role": "assistant", "model": "m", "usage": {"input_tokens": 1, "cache_read_input_tokens": 2, "output_tokens": 3}, "content": [{"type": "tool_use", "id": "t1", "name": "Read", "input": {"file_path": "/a"}}]}},
        user("u3", [{"type": "tool_result", "tool_use_id": "t1", "content": [{"type": "text", "text": "body"}], "is_error": True}], "u2", "2024-01-01T00:00:09Z"),
        {"type": "system", "subtype": "turn_duration", "parentUuid": "u2", "durationMs": 7}, {"type": "system", "subtype": "away_summary", "uuid": "s1", "content": "sum", "timestamp": "2024-01-01T00:00:10Z"},
        user("u4", "<system-reminder>x"),
    ) + b'{"type": "user", "uuid": "torn'
    sub = log(user("v1", "go", at="2024-01-01T00:00:01Z"), {"type": "assistant", "uuid": "v2", "timestamp": "2024-01-01T00:00:03Z", "message": {"usage": {"input_tokens": 4, "output_tokens": 5}, "content": "ok"}})
    got = parsed("claude", {"/r/projects/-w/S.jsonl": main, "/r/projects/-w/S/subagents/agent-A.jsonl": sub, "/r/projects/-w/S/subagents/agent-A.meta.json": json.dumps({"agentType": "k", "toolUseId": "t1"}).encode()})
    m = {r["uuid"]: r for r in got["messages"]}
    assert set(m) == {"u1", "u2", "u3", "u4", "v1", "v2"}
    assert (m["u2"]["input_tokens"], m["u2"]["output_tokens"], m["u2"]["timestamp"], m["u2"]["content_type"]) == (3, 3, "2024-01-01T00:00:05.000Z", "tool_use")
    assert (m["u4"]["harness_kind"], m["u4"]["is_meta"]) == ("reminder", 1) and m["v1"]["agent_id"] == "A"
    assert got["tool_calls"][0]["file_path"] == "/a" and (got["tool_results"][0]["content"], got["tool_results"][0]["is_error"]) == ("body", 1)
    assert got["turn_duration"] == [{"uuid": "u2", "turn_duration_ms": 7}] and got["summaries"][0]["content"] == "sum"
    assert (got["subagents"][0]["total_tokens"], got["subagents"][0]["duration_ms"]) == (9, 2000)
    s = got["sessions"]
    assert len(s) == 1 and (s[0]["id"], s[0]["title"], s[0]["message_count"], s[0]["git_branch"], s[0]["project"]) == ("S", "high", 4, "b", "-w")


def test_codex_prefers_events_folds_children_and_retracts_guardians():
    at = "2024-01-01T00:00:00Z"
    event = lambda **p: {"timestamp": at, "type": "event_msg", "payload": p}
    item = lambda **p: {"timestamp": at, "type": "response_item", "payload": p}
    rows = [
        {"timestamp": at, "type": "session_meta", "payload": {"id": "T", "cwd": "/w"}}, event(type="user_message", message="q"), item(type="message", role="user", content=[{"type": "input_text", "text": "q"}]),
        item(type="message", role="user", content=[{"type": "input_text", "text": "<environment_context> x"}]), event(type="agent_message", message="a"), item(type="message", role="assistant", content=[{"type": "output_text", "text": "a"}]),
        event(type="token_count", info={"last_token_usage": {"input_tokens": 5, "output_tokens": 6}}), item(type="function_call", name="shell", call_id="c", arguments="{}"), item(type="function_call_output", call_id="c", output="done"),
        event(type="task_complete", duration_ms=9), event(type="thread_name_updated", thread_name="name"),
    ]
    got = parsed("codex", {"/x/rollout-1.jsonl.zst": zstandard.compress(log(*rows))})
    shown = [(r["role"], r["text"], r["visibility"]) for r in got["messages"] if r["content_type"] == "text"]
    assert shown == [("user", "q", "visible"), ("user", "<environment_context> x", "hidden"), ("assistant", "a", "visible")]
    assert got["messages"][2]["output_tokens"] == 6 and got["sessions"][0]["title"] == "name" and got["tool_results"][0]["message_uuid"] == got["tool_calls"][0]["message_uuid"]
    child = parsed("codex", {"/x/rollout-2.jsonl": log({"type": "session_meta", "payload": {"id": "C", "parent_thread_id": "T"}}, event(type="agent_message", message="z"))})
    assert child["messages"][0]["session_id"] == "T" and child["subagents"][0]["agent_id"] == "C" and "sessions" not in child
    assert parsed("codex", {"/x/rollout-3.jsonl": log({"type": "session_meta", "payload": {"id": "G", "agent_role": "guardian"}})}) == {"delete": [{"session_id": "G"}]}
    with pytest.raises(ValueError):
        parsed("codex", {"/x/rollout-1.jsonl.zst": zstandard.compress(log(*rows))[:-3]})


def test_pi_tree_activity_and_tool_scope():
    head = {"type": "session", "id": "P", "cwd": "/w"}
    msg = lambda id, parent, role, content, **m: {"type": "message", "id": id, "parentId": parent, "timestamp": "2024-01-01T00:00:00Z", "message": {"role": role, "content": content, **m}}
    got = parsed("pi", {"/x/.pi/s.jsonl": log(
        head, msg("1", None, "user", "root"), msg("2", "1", "assistant", [{"type": "text", "text": "old"}]), msg("3", "1", "assistant", [{"type": "thinking", "thinking": "hm"}, {"type": "toolCall", "id": "k", "name": "bash", "arguments": {}}], usage={"input": 1, "cacheRead": 2, "output": 3}),
        msg("4", "3", "toolResult", [{"type": "text", "text": "out"}], toolCallId="k"), msg("5", "2", "toolResult", [{"type": "text", "text": "stray"}], toolCallId="k"), {"type": "leaf", "targetId": "4"},
    )})
    seen = {r["uuid"]: r for r in got["messages"]}
    assert [seen[f"pi:P:{i}"]["visibility"] for i in ("1", "2", "3", "4", "5")] == ["visible", "inactive", "visible", "visible", "inactive"]
    assert [r["content"] for r in got["tool_results"]] == ["out"] and seen["pi:P:3:1"]["input_tokens"] == 3 and got["sessions"][0]["title"] == "root"


def test_kimi_undo_stops_at_the_floor():
    add = lambda role, text, **m: {"type": "context.append_message", "message": {"role": role, "content": text, **m}}
    got = parsed("kimi", {"/k/S/state.json": b'{"id": "S", "agents": {"main": {}}}', "/k/S/agents/main/wire.jsonl": log(
        add("user", "a"), add("assistant", "b"), {"type": "context.apply_compaction", "summary": "sum"}, add("user", "c"), add("assistant", "d"), {"type": "context.undo", "count": 5}, add("user", "e"),
    )})
    assert [r["text"] for r in got["messages"]] == ["a", "b", "e"] and got["summaries"][0]["content"] == "sum"


def test_deepseek_highest_generation_and_seed():
    old, new = log({"type": "session", "id": "D"}), log({"type": "session", "id": "D", "cwd": "/w", "isSeeded": True}, {"type": "user/message", "seq": 1, "time": 0, "data": {"content": "inherited"}}, {"type": "session/end-seed", "seq": 1}, {"type": "assistant/message", "seq": 2, "time": 1704067200000, "data": {"content": "own", "usage": {"inputTokens": 3}}})
    got = parsed("deepseek", {"/d/session.jsonl": old, "/d/session.v4.jsonl.zstd": zstandard.compress(new)})
    assert [(r["text"], r["input_tokens"]) for r in got["messages"]] == [("own", 3)]


def store(tmp_path, script):
    path = tmp_path / "x.db"
    con = sqlite3.connect(path)
    con.executescript(script)
    con.commit()
    con.close()
    return path.read_bytes()


def test_devin_chains(tmp_path):
    data = store(tmp_path, """create table sessions(id, working_directory, model, created_at, last_activity_at, title, main_chain_id, hidden);
        create table message_nodes(row_id, session_id, node_id, parent_node_id, chat_message, created_at, metadata); create table subagent_heads(session_id, agent_id, chain_node_id, updated_at);
        insert into sessions values ('s', '/w', 'm', 1704067200, 1704067300, 't', 2, 0);
        insert into message_nodes values (1, 's', 1, null, '{"role": "user", "content": "q"}', 1704067200, null), (2, 's', 2, 1, '{"role": "assistant", "content": "a"}', 1704067201, null), (3, 's', 3, 1, '{"role": "assistant", "content": "lost"}', 1704067202, null);""")  # fmt: skip
    got = parsed("devin", {"/devin/x.db": data})
    assert [(r["text"], r["visibility"]) for r in got["messages"]] == [("q", "visible"), ("a", "visible"), ("lost", "inactive")]


def test_opencode_v1_revert_and_usage(tmp_path):
    data = store(tmp_path, """create table session(id, parent_id, directory, title, version, revert, time_created, time_updated); create table message(id, session_id, time_created, time_updated, data); create table part(id, message_id, session_id, time_created, time_updated, data);
        insert into session values ('s', null, '/w', 't', '1', '{"messageID": "m2"}', 1704067200000, 1704067200000);
        insert into message values ('m1', 's', 1704067200000, 0, '{"role": "assistant", "modelID": "x", "tokens": {"input": 1, "output": 2, "reasoning": 3, "cache": {"read": 4}}}'), ('m2', 's', 1704067201000, 0, '{"role": "user"}');
        insert into part values ('p1', 'm1', 's', 0, 0, '{"type": "tool", "tool": "bash", "callID": "c", "state": {"status": "error", "error": "bad", "input": {}}}'), ('p2', 'm2', 's', 0, 0, '{"type": "text", "text": "later"}');""")  # fmt: skip
    got = parsed("opencode", {"/opencode/x.db": data})
    a, b = got["messages"]
    assert (a["input_tokens"], a["output_tokens"], b["visibility"], got["tool_results"][0]["is_error"]) == (5, 5, "inactive", 1)


@pytest.mark.parametrize("name", ["hermes", "zcode", "copilot-chronicle", "kiro-store", "devin", "opencode"])
def test_foreign_stores_are_left_alone(tmp_path, name):
    assert parsed(name, {"/x.db": store(tmp_path, "create table other(a);"), "/y.db": b"no database"}) == {}


def test_times_and_frames():
    assert iso("2024-01-01T02:00:00+02:00") == "2024-01-01T00:00:00.000Z" and iso("2024-01-01T02:00") == "2024-01-01T02:00" and iso("") is None and iso(1704067200) == iso(1704067200000) == "2024-01-01T00:00:00.000Z"
    two = zstandard.compress(b"a\n") + zstandard.compress(b"b\n")
    assert zstd_frames(two) == b"a\nb\n" and zstd_frames(two[:-2], torn=True).startswith(b"a\n")


def test_incremental_merge_equals_a_rebuild(spark, tmp_path):
    from tracelake.streaming import ingest

    root = tmp_path / "logs"
    first = root / "projects" / "-w"
    first.mkdir(parents=True)
    (first / "A.jsonl").write_bytes(log(user("a1", "one"), user("a2", "two", "a1", "2024-01-01T00:01:00Z")))
    one, two = merge.Store(spark, str(tmp_path / "one")), merge.Store(spark, str(tmp_path / "two"))
    q = ingest.ingest(spark, str(root), one, str(tmp_path / "state"), {"availableNow": True})
    q.awaitTermination()
    assert one.tables()["messages"].count() == 2
    (first / "B.jsonl").write_bytes(log(user("b1", "three")))
    ingest.ingest(spark, str(root), one, str(tmp_path / "state"), {"availableNow": True}).awaitTermination()
    (first / "A.jsonl").write_bytes(log(user("a1", "one, edited"), user("a2", "two", "a1", "2024-01-01T00:01:00Z"), user("a3", "four", "a2", "2024-01-01T00:02:00Z")))
    ingest.reconcile(spark, str(root), one, "again")
    version = one.version()
    assert ingest.reconcile(spark, str(root), one, "nothing new") == version[0]
    ingest.reconcile(spark, str(root), two, "all at once")
    for name, key in (("messages", "uuid"), ("sessions", "id"), ("index_state", "jsonl_path")):
        a, b = ({r[key]: {k: v for k, v in r.asDict().items() if k not in ("ingest_seq",)} for r in s.tables()[name].collect()} for s in (one, two))
        assert a == b and a, name
