"""Sources that keep sessions in SQLite stores: devin, hermes, opencode (V1 and V2), zcode, copilot chronicles, kiro."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

from tracelake.sources.base import FILE, Record, Source, Span, SqliteFile, digest, iso, message, register, text_of, tool_call, tool_result, total


def _json(value):
    if not isinstance(value, str | bytes):
        return value if isinstance(value, dict | list) else {}
    try:
        return json.loads(value)
    except ValueError:
        return {}


def _each(parse):
    def run(files: dict[str, bytes]) -> Iterator[Record]:
        for path, data in files.items():
            if data.startswith(b"SQLite format 3\0"):
                with SqliteFile(data) as db:
                    yield from parse(path, db)

    return run


# ---- devin: a forest of nodes per session; live chains run from the heads ----


def _devin(path: str, db: SqliteFile) -> Iterator[Record]:
    if not db.has(sessions=["id"], message_nodes=["session_id", "node_id", "parent_node_id", "chat_message"]):
        return
    heads = db.rows("select * from subagent_heads") if db.columns("subagent_heads") else []
    for s in db.rows("select * from sessions"):
        sid, span = f"devin:{s['id']}", Span()
        nodes = {r["node_id"]: r for r in db.rows("select * from message_nodes where session_id = ? order by row_id", s["id"])}
        owner: dict = {}
        for agent, head in [(None, s.get("main_chain_id")), *((h["agent_id"], h["chain_node_id"]) for h in heads if h["session_id"] == s["id"])]:
            seen = set()
            while head in nodes and head not in seen:
                seen.add(head)
                owner.setdefault(head, agent)
                head = nodes[head]["parent_node_id"]
        claimed: set = set()
        for node, r in sorted(nodes.items(), key=lambda x: (x[0] not in owner, x[1].get("row_id") or 0)):
            m = _json(r["chat_message"])
            id = m.get("id") or m.get("message_id") or node
            if id in claimed:
                continue  # a message counts once, for the chain that claims it first
            claimed.add(id)
            role, at, uuid = m.get("role"), iso(r.get("created_at")), f"devin:{s['id']}:{node}"
            visible = "visible" if node in owner else "inactive"
            if role == "system" or (role == "user" and m.get("is_user_input") is False):
                visible = "hidden"
            parent = f"devin:{s['id']}:{r['parent_node_id']}" if r["parent_node_id"] in nodes else None
            u = _json(r.get("metadata")).get("usage") or m.get("usage") or {}
            if m.get("thinking"):
                span.see(at, visible == "visible")
                yield message(f"{uuid}:thinking", sid, "devin", "assistant", text_of(m["thinking"]), parent_uuid=parent, timestamp=at, content_type="thinking", visibility=visible, agent_id=owner.get(node))
            if role == "tool":
                yield tool_result(m.get("tool_call_id"), uuid, sid, text_of(m.get("content")), m.get("is_error"))
            span.see(at, visible == "visible")
            yield message(
                uuid, sid, "devin", "user" if role == "tool" else role, text_of(m.get("content")), parent_uuid=parent, timestamp=at, visibility=visible, agent_id=owner.get(node), model=s.get("model") if role == "assistant" else None,
                content_type="tool_result" if role == "tool" else "text", harness_kind="other" if role == "system" else None, input_tokens=total(u.get("input_tokens"), u.get("cache_creation_input_tokens"), u.get("cache_read_input_tokens")), output_tokens=u.get("output_tokens"),
            )
            for c in m.get("tool_calls") or []:
                f = c.get("function") or c
                yield tool_call(c.get("id"), uuid, sid, f.get("name"), f.get("arguments") or f.get("input"))
        for h in heads:
            if h["session_id"] == s["id"]:
                yield "subagents", {"agent_id": h["agent_id"], "session_id": sid}
        span.see(iso(s.get("created_at")), False)
        span.see(iso(s.get("last_activity_at")), False)
        yield span.session(sid, "devin", title=s.get("title"), project_path=s.get("working_directory"), jsonl_path=path)


register(Source("devin", r"/devin/.*\.(db|sqlite)$", (FILE,), _each(_devin)))


# ---- hermes: state.db per profile ----


def _hermes(path: str, db: SqliteFile) -> Iterator[Record]:
    if not db.has(sessions=["id", "source"], messages=["id", "session_id", "role", "content"]):
        return
    every = db.rows("select * from sessions")
    known = {s["id"] for s in every}
    for s in every:
        parent = s.get("parent_session_id") if s.get("parent_session_id") in known else None
        child = bool(parent) and "agent" in (s.get("source") or "")
        home = f"hermes:{parent if child else s['id']}"
        agent = f"hermes:{s['id']}" if child else None
        span, last = Span(), None
        for m in db.rows("select * from messages where session_id = ? order by id", s["id"]):
            at, uuid, role = iso(m.get("timestamp")), f"hermes:{s['id']}:{m['id']}", m["role"]
            visible = "hidden" if m.get("display_kind") == "hidden" else "inactive" if m.get("active") == 0 else "visible"
            if m.get("_compressed_summary") or (m.get("compacted") and role == "assistant" and not m.get("tool_calls")):
                yield "summaries", {"id": uuid, "session_id": home, "timestamp": at, "source": "compaction", "content": m["content"], "visibility": visible}
                continue
            thought = m.get("reasoning_content") or m.get("reasoning")
            if thought:
                span.see(at)
                yield message(f"{uuid}:thinking", home, "hermes", "assistant", thought, parent_uuid=last, timestamp=at, content_type="thinking", visibility=visible, agent_id=agent)
            if role == "tool":
                yield tool_result(m.get("tool_call_id"), uuid, home, m["content"], False)
            span.see(at)
            yield message(uuid, home, "hermes", "user" if role == "tool" else role, m["content"], parent_uuid=last, timestamp=at, visibility=visible, agent_id=agent, content_type="tool_result" if role == "tool" else "text", model=s.get("model") if role == "assistant" else None, harness_kind="other" if role == "system" else None)
            calls = _json(m.get("tool_calls")) or []
            for c in calls if isinstance(calls, list) else []:
                f = c.get("function") or c
                yield tool_call(c.get("id"), uuid, home, f.get("name"), f.get("arguments"))
            last = uuid
        if child:
            yield "subagents", {"agent_id": agent, "session_id": home, "description": s.get("title"), "agent_type": s.get("source")}
        span.see(iso(s.get("started_at")), False)
        span.see(iso(s.get("ended_at")), False)
        yield span.session(f"hermes:{s['id']}", "hermes", title=s.get("title"), project_path=s.get("cwd"), git_branch=s.get("git_branch"), jsonl_path=path, started_by="agent" if child else None)


register(Source("hermes", r"/hermes/.*state\.db$", (FILE,), _each(_hermes)))


# ---- opencode: V1 session/message/part, V2 session_v2/session_message ----


def _opencode_usage(t: dict) -> dict:
    cache = t.get("cache") or {}
    return {"input_tokens": total(t.get("input"), cache.get("read"), cache.get("write")), "output_tokens": total(t.get("output"), t.get("reasoning"))}


def _opencode_part(base: str, sid: str, role: str, p: dict, at, parent, visible, agent) -> list[Record]:
    kind = p.get("type")
    more = {"parent_uuid": parent, "timestamp": at, "visibility": visible, "agent_id": agent}
    if kind in ("text", "reasoning"):
        return [message(base, sid, "opencode", role, p.get("text"), content_type="thinking" if kind == "reasoning" else "text", harness_kind="other" if p.get("synthetic") else None, **more)]
    if kind == "tool":
        state = p.get("state") or {}
        call = p.get("callID") or p.get("id") or f"{base}:tool"
        out = [message(base, sid, "opencode", role, None, content_type="tool_use", **more), tool_call(call, base, sid, p.get("tool") or p.get("name"), state.get("input"))]
        if state.get("status") in ("completed", "error"):
            out.append(tool_result(call, base, sid, text_of(state.get("output") if state["status"] == "completed" else state.get("error")), state["status"] == "error"))
        return out
    return []


def _opencode(path: str, db: SqliteFile) -> Iterator[Record]:
    if db.has(session=["id"], message=["id", "session_id", "data"], part=["id", "message_id", "data"]):
        yield from _opencode_v1(path, db)
    if db.has(session_v2=["id"], session_message=["id", "session_id", "type", "data"]):
        yield from _opencode_v2(path, db)


def _opencode_session(path: str, s: dict, span: Span, known: set) -> Iterator[Record]:
    parent = s.get("parent_id") if s.get("parent_id") in known else None
    if parent:
        yield "subagents", {"agent_id": f"opencode:{s['id']}", "session_id": f"opencode:{parent}", "description": s.get("title")}
    span.see(iso(s.get("time_created")), False)
    span.see(iso(s.get("time_updated")), False)
    yield span.session(f"opencode:{s['id']}", "opencode", title=s.get("title"), project_path=s.get("directory"), version=s.get("version"), jsonl_path=path, started_by="agent" if parent else None)


def _opencode_v1(path: str, db: SqliteFile) -> Iterator[Record]:
    every = db.rows("select * from session")
    for s in every:
        sid, span, last = f"opencode:{s['id']}", Span(), None
        revert = _json(s.get("revert"))
        cut = False
        for m in db.rows("select * from message where session_id = ? order by time_created, id", s["id"]):
            d, at = _json(m["data"]), iso(m.get("time_created"))
            role = d.get("role") or "assistant"
            whole = revert.get("messageID") == m["id"] and not revert.get("partID")
            cut = cut or whole
            rows: list[Record] = []
            for p in db.rows("select * from part where message_id = ? order by id", m["id"]):
                if revert.get("partID") == p["id"]:
                    cut = True
                part = _json(p["data"])
                if part.get("type") == "step-finish" and any(k == "messages" for k, _ in rows):
                    next(r for k, r in reversed(rows) if k == "messages").update(_opencode_usage(part.get("tokens") or {}))
                if part.get("type") == "compaction":
                    rows.append(("summaries", {"id": f"{sid}:{p['id']}", "session_id": sid, "timestamp": at, "source": "compaction", "content": part.get("text"), "visibility": "inactive" if cut else "visible"}))
                rows += _opencode_part(f"{sid}:{p['id']}", sid, role, part, at, last, "inactive" if cut else "visible", None)
            told = [r for k, r in rows if k == "messages"]
            if not told:
                rows.append(message(f"{sid}:{m['id']}", sid, "opencode", role, None, parent_uuid=last, timestamp=at, visibility="inactive" if cut else "visible"))
                told = [rows[-1][1]]
            for r in told:
                r["model"] = d.get("modelID") if role == "assistant" else None
                span.see(at)
            if d.get("tokens") and told[-1].get("input_tokens") is None:
                told[-1].update(_opencode_usage(d["tokens"]))
            last = told[-1]["uuid"]
            yield from rows
        yield from _opencode_session(path, s, span, {x["id"] for x in every})


def _opencode_v2(path: str, db: SqliteFile) -> Iterator[Record]:
    every = db.rows("select * from session_v2")
    for s in every:
        sid, span, last = f"opencode:{s['id']}", Span(), None
        revert = _json(s.get("revert")).get("messageID")
        rows = db.rows("select * from session_message where session_id = ? order by seq, id", s["id"])
        cut_at = next((i for i, m in enumerate(rows) if m["id"] == revert), len(rows))
        for i, m in enumerate(rows):
            d, at, kind, visible = _json(m["data"]), iso(m.get("time_created")), m["type"], "visible" if i < cut_at else "inactive"
            base, found = f"{sid}:{m['id']}", []
            if kind == "user":
                found = [message(base, sid, "opencode", "user", text_of(d.get("text") or d.get("content")), parent_uuid=last, timestamp=at, visibility=visible)]
            elif kind == "assistant":
                for j, p in enumerate(d.get("content") or []):
                    found += _opencode_part(base if j == 0 else f"{base}:{j}", sid, "assistant", p, at, last, visible, None)
                told = [r for k, r in found if k == "messages"]
                if told:
                    told[-1].update(_opencode_usage(d.get("tokens") or {}))
            elif kind == "compaction":
                found = [("summaries", {"id": base, "session_id": sid, "timestamp": at, "source": "compaction", "content": d.get("summary") or d.get("text"), "visibility": visible})]
            else:
                found = [message(base, sid, "opencode", "user", text_of(d.get("text")) or kind, parent_uuid=last, timestamp=at, visibility=visible, harness_kind="other")]
            for k, r in found:
                if k == "messages":
                    span.see(at)
                    last = r["uuid"]
            yield from found
        yield from _opencode_session(path, s, span, {x["id"] for x in every})


register(Source("opencode", r"/opencode/.*\.(db|sqlite)$", (FILE,), _each(_opencode)))


# ---- zcode ----


def _zcode(path: str, db: SqliteFile) -> Iterator[Record]:
    if not db.has(session=["id", "task_type"], message=["id", "session_id", "data"], part=["id", "message_id", "data"]):
        return
    every = db.rows("select * from session")
    order = "order by sequence is null, sequence, time_created, id"
    for s in every:
        sid, span, last = f"zcode:{digest(path, s['id'])}", Span(), None
        ms = db.rows(f"select * from message where session_id = ? {order}", s["id"])
        revert = _json(s.get("revert")).get("messageID")
        stop = next((i for i, m in enumerate(ms) if m["id"] == revert), len(ms))
        compacted = max((i for i, m in enumerate(ms[:stop]) if _json(m["data"]).get("type") == "compact_summary"), default=-1)
        for i, m in enumerate(ms):
            d, at = _json(m["data"]), iso(m.get("time_created"))
            visible = {"hidden": "hidden", "inactive": "inactive"}.get(d.get("visibility"), "visible")
            if visible == "visible" and not compacted <= i < stop:
                visible = "inactive"
            role, base, rows = d.get("role") or "assistant", f"{sid}:{m['id']}", []
            parts = [_json(p["data"]) for p in db.rows(f"select * from part where message_id = ? {order}", m["id"])]
            if d.get("type") == "compact_summary":
                yield "summaries", {"id": base, "session_id": sid, "timestamp": at, "source": "compact_summary", "content": "\n".join(p.get("text") or "" for p in parts), "visibility": "visible" if i < stop else "inactive"}
                continue
            text = "\n".join(p.get("text") or "" for p in parts if p.get("type") == "text")
            usage = {"input_tokens": (d.get("tokens") or {}).get("input"), "output_tokens": (d.get("tokens") or {}).get("output")} if role == "assistant" else {}
            rows.append(message(base, sid, "zcode", role, text or None, parent_uuid=last, timestamp=at, visibility=visible, model=d.get("modelID"), content_type="text" if text else "tool_use", **usage))
            for n, p in enumerate(x for x in parts if x.get("type") == "reasoning"):
                rows.append(message(f"{base}:think{n:06d}", sid, "zcode", role, p.get("text"), parent_uuid=base, timestamp=at, visibility=visible, content_type="thinking"))
            for p in parts:
                if p.get("type") == "tool":
                    state = p.get("state") or {}
                    rows.append(tool_call(p.get("callID"), base, sid, p.get("tool"), state.get("input")))
                    if state.get("status") in ("completed", "error"):
                        rows.append(tool_result(p.get("callID"), base, sid, text_of(state.get("output") or state.get("error")), state["status"] == "error"))
            span.see(at)
            last = base
            yield from rows
        parent = s.get("parent_id") if s.get("parent_id") in {x["id"] for x in every} else None
        child = s.get("task_type") == "subagent_child"
        if parent:
            yield "subagents", {"agent_id": sid, "session_id": f"zcode:{digest(path, parent)}", "description": s.get("title")}
        yield span.session(sid, "zcode", title=s.get("title"), project_path=s.get("directory"), version=s.get("version"), jsonl_path=path, started_by="agent" if child else None)


register(Source("zcode", r"/zcode/.*\.(db|sqlite)$", (FILE,), _each(_zcode)))


# ---- copilot chronicles: a row per turn ----


def _chronicle(path: str, db: SqliteFile) -> Iterator[Record]:
    if not db.has(sessions=["id", "cwd"], turns=["session_id", "turn_index", "user_message", "assistant_response"]):
        return
    for s in db.rows("select * from sessions"):
        sid, span, last = s["id"], Span(), None
        for t in db.rows("select * from turns where session_id = ? order by turn_index", s["id"]):
            at = iso(t.get("timestamp"))
            for role, text in (("user", t["user_message"]), ("assistant", t["assistant_response"])):
                if text:
                    span.see(at)
                    uuid = f"copilot:{sid}:{t['turn_index']:06d}:{role}"
                    yield message(uuid, sid, "copilot", role, text, parent_uuid=last, timestamp=at)
                    last = uuid
        span.see(iso(s.get("created_at")), False)
        span.see(iso(s.get("updated_at")), False)
        yield span.session(sid, "copilot", title=s.get("summary"), project_path=s.get("cwd"), git_branch=s.get("branch"), jsonl_path=path)


register(Source("copilot-chronicle", r"/copilot/.*\.(db|sqlite)$", (FILE,), _each(_chronicle)))


def _kiro_store(path: str, db: SqliteFile) -> Iterator[Record]:
    if not db.has(conversations_v2=["key", "conversation_id", "value"]):
        return
    for c in db.rows("select * from conversations_v2 order by key, conversation_id"):
        v = _json(c["value"])
        sid, span, last, n, calls = f"kiro:{c['conversation_id']}", Span(), None, 0, {}
        turns = [*(v.get("history") or []), *([{"user": v["next_message"]}] if v.get("next_message") else [])]
        for turn in turns:
            rows: list[Record] = []
            for side, role in (("user", "user"), ("assistant", "assistant")):
                m = turn.get(side) or {}
                body = m.get("content") or m
                at = iso(m.get("timestamp"))
                text = next((x.get("prompt") or x.get("content") for x in body.values() if isinstance(x, dict) and (x.get("prompt") or x.get("content"))), None) if isinstance(body, dict) else body
                uses = next((x.get("tool_uses") for x in body.values() if isinstance(x, dict) and x.get("tool_uses")), []) if isinstance(body, dict) else []
                if text is None and not uses:
                    continue
                uuid = f"{sid}:message:{n:06d}"
                n += 1
                span.see(at)
                rows.append(message(uuid, sid, "kiro", role, text_of(text), parent_uuid=last, timestamp=at))
                last = uuid
                for u in uses:
                    calls[u.get("id")] = f"{uuid}:tool"
                    rows.append(tool_call(f"{uuid}:tool", uuid, sid, u.get("name"), u.get("args") or u.get("input")))
            meta = turn.get("request_metadata") or {}
            if rows and meta:
                final = next(r for k, r in reversed(rows) if k == "messages")
                final["input_tokens"], final["output_tokens"] = meta.get("input_tokens"), meta.get("output_tokens")
            yield from rows
        span.see(iso(c.get("created_at")), False)
        span.see(iso(c.get("updated_at")), False)
        yield span.session(sid, "kiro", project_path=c["key"] if re.match("/", c["key"]) else None, jsonl_path=path)


register(Source("kiro-store", r"/\.?kiro/.*\.(db|sqlite3?)$", (FILE,), _each(_kiro_store)))
