"""Nested outputs of a session: its detail, timeline items, and the universal session format (USF).

A session's rows are brought together as JSON by session id and assembled in one task per
session: runs of thinking and of tool calls are merged in order, which no window expresses.
The output is JSON, since runs nest without a bound.
"""

from __future__ import annotations

import json
from collections.abc import Iterable

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("sessions", "messages", "tool_calls", "tool_results", "subagents", "workflows", "summaries")
MOST_PROBLEMS = 50


def bundled(t, columns: dict[str, tuple] | None = None) -> DataFrame:
    """(session_id, kind, seq, body): every row of a session as JSON, of all kinds or those columns of those kinds."""
    parts = None
    for kind in columns or KINDS:
        df = getattr(t, kind)
        key = "id" if kind == "sessions" else "session_id"
        body = F.to_json(F.struct(*(columns[kind] if columns else df.columns)))
        one = df.select(F.col(key).alias("session_id"), F.lit(kind).alias("kind"), F.col("ingest_seq").alias("seq"), body.alias("body"))
        parts = one if parts is None else parts.unionByName(one)
    return parts.where("session_id is not null")


def _per_session(parts: DataFrame, function, column: str) -> DataFrame:
    def run(group: pa.Table) -> pa.Table:
        rows: dict[str, list[dict]] = {}
        for kind in KINDS:
            own = group.filter(pc.equal(group["kind"], kind))
            # sort_indices is stable; the bodies become one list, read in one go
            body = own["body"].cast(pa.large_string()).take(pc.sort_indices(own["seq"])).combine_chunks()
            joined = pc.binary_join(pa.LargeListArray.from_arrays([0, len(body)], body), pa.scalar(",", pa.large_string()))
            rows[kind] = json.loads(f"[{joined[0].as_py()}]")
        return pa.table({"session_id": [group["session_id"][0].as_py()], column: [json.dumps(function(rows), ensure_ascii=False)]})

    return parts.groupBy("session_id").applyInArrow(run, f"session_id string, {column} string")


def _visible(m: dict) -> bool:
    return m.get("visibility") in (None, "visible")


def _calls(rows: dict) -> dict[str, list[dict]]:
    """Tool calls by message, each with its result, subagent and workflow; the last result of a call counts."""
    results = {r["tool_use_id"]: r for r in rows["tool_results"]}
    agents = {a["parent_tool_use_id"]: a for a in rows["subagents"] if a.get("parent_tool_use_id")}
    flows = {w["parent_tool_use_id"]: w for w in rows["workflows"] if w.get("parent_tool_use_id")}
    out: dict[str, list[dict]] = {}
    for c in rows["tool_calls"]:
        call = dict(c)
        for name, found in (("result", results), ("subagent", agents), ("workflow", flows)):
            if c["id"] in found:
                call[name] = found[c["id"]]
        out.setdefault(c.get("message_uuid"), []).append(call)
    return out


def detail(rows: dict) -> dict:
    """{session, messages, workflows, summaries} of a session's main timeline, visible rows only."""
    session = rows["sessions"][-1] if rows["sessions"] else None
    shown = [m for m in rows["messages"] if _visible(m) and m.get("agent_id") in (None, m["session_id"])]
    shown.sort(key=lambda m: (m.get("timestamp") or "", m["uuid"]))
    own = {m["uuid"] for m in shown}
    calls = _calls(rows)
    asked = {c["id"] for u in own for c in calls.get(u, [])}
    attached = {r["message_uuid"] for r in rows["tool_results"] if r["tool_use_id"] in asked}
    thoughts: dict[str, list[str]] = {}
    for m in shown:
        parent = m.get("parent_uuid")
        if m.get("content_type") == "thinking" and parent in own and m["uuid"].startswith(f"{parent}:think"):
            thoughts.setdefault(parent, []).append(m.get("text") or "")
    out: list[dict] = []
    # of the last entry: how many of its calls are skills, and the texts of a run of thinking
    skills, parts = 0, []
    for m in shown:
        kind, parent = m.get("content_type"), m.get("parent_uuid")
        if kind == "thinking" and parent in thoughts and m["uuid"].startswith(f"{parent}:think"):
            continue
        if kind == "tool_result" and (m["uuid"] in attached or not m.get("text")):
            continue
        row = {**m, "tool_calls": list(calls.get(m["uuid"], []))}
        own_skills = sum(c.get("presentation") == "skill" for c in row["tool_calls"])
        if m["uuid"] in thoughts:
            row["_thinking"] = "\n\n".join(thoughts[m["uuid"]])
        last = out[-1] if out else None
        if kind == "skill_instructions" and skills:
            last["_skillMd"] = m.get("text")
        elif kind == "thinking" and last and last.get("content_type") == "thinking" and last.get("role") == m.get("role"):
            parts.append(m.get("text"))
        elif kind == "tool_use" and not _only(own_skills, row) and last and last.get("role") == "assistant" and last.get("content_type") in ("text", "tool_use") and not _only(skills, last):
            # a run of calls is one entry, and an assistant's text takes in the calls that follow it
            last["tool_calls"] += row["tool_calls"]
            skills += own_skills
        else:
            _join(last, parts)
            out.append(row)
            skills, parts = own_skills, [m.get("text")]
    _join(out[-1] if out else None, parts)
    return {"session": session, "messages": out, "workflows": rows["workflows"], "summaries": [s for s in rows["summaries"] if _visible(s)]}


def _join(entry: dict | None, parts: list) -> None:
    if len(parts) > 1:
        entry["text"] = "\n\n".join(x for x in parts if x)


def _only(skills: int, row: dict) -> bool:
    return 0 < skills == len(row["tool_calls"])


def _skill_only(row: dict) -> bool:
    return bool(row["tool_calls"]) and all(c.get("presentation") == "skill" for c in row["tool_calls"])


def items(found: dict) -> list[dict]:
    """Timeline items of a detail: meta, workflow, workflow-tools, skill, thinking, message."""
    out = []
    for m in found["messages"]:
        flows = [c for c in m["tool_calls"] if c.get("workflow")]
        if m.get("is_meta"):
            out.append({"kind": "meta", "uuid": m["uuid"]})
        elif flows:
            out += [{"kind": "workflow", "uuid": m["uuid"], "run_id": c["workflow"]["run_id"]} for c in flows]
            if len(flows) < len(m["tool_calls"]):
                out.append({"kind": "workflow-tools", "uuid": m["uuid"]})
        elif _skill_only(m):
            out.append({"kind": "skill", "uuid": m["uuid"]})
        else:
            out.append({"kind": "thinking" if m.get("content_type") == "thinking" else "message", "uuid": m["uuid"]})
    return out


def details(t) -> DataFrame:
    """(session_id, detail) of all sessions, as JSON."""
    return _per_session(bundled(t), detail, "detail")


def item_rows(t) -> DataFrame:
    """What timeline items are made of, for every row: of a message's text, whether there is one."""
    return bundled(
        t,
        {
            "messages": ("uuid", "session_id", "parent_uuid", "timestamp", "role", "content_type", "is_meta", "visibility", "agent_id", F.when(F.col("text") != "", F.lit("-")).alias("text")),
            "tool_calls": ("id", "message_uuid", "presentation"),
            "tool_results": ("tool_use_id", "message_uuid"),
            "workflows": ("run_id", "parent_tool_use_id"),
        },
    )


def timeline(t) -> DataFrame:
    """(session_id, k, kind, uuid) of all sessions' timeline items."""
    found = _per_session(item_rows(t), lambda rows: items(detail(rows)), "items")
    kind = "array<struct<kind:string,uuid:string>>"
    return found.select("session_id", F.posexplode(F.from_json("items", kind)).alias("k", "i")).select("session_id", "k", "i.kind", "i.uuid")


# ---- universal session format ----


def _step(m: dict, calls: dict) -> dict:
    kind = "human" if m.get("role") == "user" and not m.get("is_meta") and m.get("content_type") not in ("tool_result",) else "meta" if m.get("is_meta") else m.get("content_type") or "text"
    step = {"id": m["uuid"], "kind": kind, "role": m.get("role"), "at": m.get("timestamp"), "text": m.get("text")}
    if m.get("visibility") not in (None, "visible"):
        step["state"] = m["visibility"]
    if m.get("model"):
        step["model"] = m["model"]
    if m.get("input_tokens") is not None or m.get("output_tokens") is not None:
        step["usage"] = {"input": m.get("input_tokens"), "output": m.get("output_tokens")}
    found = calls.get(m["uuid"])
    if found:
        step["tools"] = [{"id": c["id"], "name": c.get("name"), "input": c.get("input_json"), **({"output": c["result"].get("content"), "error": bool(c["result"].get("is_error"))} if c.get("result") else {})} for c in found]
    return step


def usf(rows: dict) -> dict:
    """The session as turns of steps; a subagent's run stands in the tool step that began it, else by its time."""
    session = rows["sessions"][-1] if rows["sessions"] else {"id": rows["messages"][0]["session_id"] if rows["messages"] else None}
    calls, homes, seen, twice = _calls(rows), {}, set(), 0
    for m in sorted(rows["messages"], key=lambda m: (m.get("timestamp") or "", m["uuid"])):
        if m["uuid"] in seen:
            twice += 1
            continue
        seen.add(m["uuid"])
        if m.get("content_type") == "tool_result" and not m.get("text"):
            continue
        agent = m.get("agent_id")
        homes.setdefault(None if agent in (None, m["session_id"]) else agent, []).append(m)
    main = _merged([_step(m, calls) for m in homes.pop(None, [])], {m["uuid"]: m for m in rows["messages"]})
    runs = {}
    for a in rows["subagents"]:
        own = [_step(m, calls) for m in homes.pop(a["agent_id"], [])]
        runs[a["agent_id"]] = ({"agent": a["agent_id"], "kind": a.get("agent_type"), "about": a.get("description"), "steps": own}, a.get("parent_tool_use_id"))
    for agent, ms in homes.items():
        runs[agent] = ({"agent": agent, "kind": None, "about": None, "steps": [_step(m, calls) for m in ms]}, None)
    places = {}
    for step in [*main, *(s for r, _ in runs.values() for s in r["steps"])]:
        for tool in step.get("tools", ()):
            places[tool["id"]] = step
    detached = []
    for agent, (run, call) in sorted(runs.items()):
        step = places.get(call)
        if step is not None and not any(s is step for s in run["steps"]):
            step.setdefault("runs", []).append(run)
        elif run["steps"]:
            at = run["steps"][0]["at"] or ""
            before = [s for s in main if (s["at"] or "") <= at]
            (before[-1] if before else main[0]).setdefault("runs", []).append(run) if main else detached.append(run)
    turns: list[dict] = []
    for step in main:
        if not turns or (step["kind"] == "human" and "state" not in step and any(s["kind"] == "human" for s in turns[-1]["steps"])):
            turns.append({"steps": []})
        turns[-1]["steps"].append(step)
    out = {"usf": 1, "harness": session.get("source") or "claude", "id": session["id"], "title": session.get("title"), "git_branch": session.get("git_branch"), "turns": turns}
    if session.get("started_by"):
        out["started_by"] = session["started_by"]
    if detached:
        out["detached"] = detached
    if twice:
        out["stats"] = {"duplicate_messages": twice}
    return out


def _merged(steps: list[dict], by_id: dict[str, dict]) -> list[dict]:
    """Parts of one submission (same time, each the child of the one before, same state) as one human step."""
    out: list[dict] = []
    for s in steps:
        last = out[-1] if out else None
        if last and s["kind"] == last["kind"] == "human" and s["at"] == last["at"] and s["at"] and s.get("state") == last.get("state") and by_id[s["id"]].get("parent_uuid") == last.get("_tip", last["id"]):
            last["text"] = "\n".join(x for x in (last["text"], s["text"]) if x)
            last["_tip"] = s["id"]
        else:
            out.append(s)
    for s in out:
        s.pop("_tip", None)
    return out


def published(found: dict) -> dict:
    """A USF session without stated (inactive, hidden) steps, at any depth, and without empty turns."""

    def keep(steps: Iterable[dict]) -> list[dict]:
        out = []
        for s in steps:
            if "state" in s:
                continue
            s = dict(s)
            if "runs" in s:
                s["runs"] = [{**r, "steps": keep(r["steps"])} for r in s["runs"]]
            out.append(s)
        return out

    turns = [{**t, "steps": keep(t["steps"])} for t in found["turns"]]
    return {**found, "turns": [t for t in turns if t["steps"]]}


def problems(found) -> list[str]:
    """What is wrong with a USF session, 50 findings at most."""
    out: list[str] = []

    def say(ok: bool, where: str, text: str) -> None:
        if not ok and len(out) < MOST_PROBLEMS:
            out.append(f"{where}: {text}")

    def steps(value, where: str) -> None:
        say(isinstance(value, list), where, "steps must be a list")
        for i, s in enumerate(value if isinstance(value, list) else []):
            at = f"{where}[{i}]"
            say(isinstance(s, dict), at, "a step must be an object")
            if not isinstance(s, dict):
                continue
            say(isinstance(s.get("id"), str) and bool(s["id"]), at, "id is missing")
            say(isinstance(s.get("kind"), str), at, "kind is missing")
            say(s.get("at") is None or isinstance(s["at"], str), at, "at must be a text")
            say(s.get("state", "inactive") in ("inactive", "hidden", "other"), at, "state is unknown")
            for j, tool in enumerate(s.get("tools", ())):
                say(isinstance(tool.get("id"), str), f"{at}.tools[{j}]", "id is missing")
            for j, run in enumerate(s.get("runs", ())):
                steps(run.get("steps"), f"{at}.runs[{j}].steps")

    if not isinstance(found, dict):
        return ["session: must be an object"]
    say(found.get("usf") == 1, "usf", "version must be 1")
    say(isinstance(found.get("id"), str) and bool(found["id"]), "id", "is missing")
    say(isinstance(found.get("harness"), str), "harness", "is missing")
    say(isinstance(found.get("turns"), list), "turns", "must be a list")
    for i, turn in enumerate(found.get("turns") or []):
        steps(turn.get("steps") if isinstance(turn, dict) else None, f"turns[{i}].steps")
    return out


def sessions_usf(t, public: bool = False) -> DataFrame:
    """(session_id, usf) of all sessions, as JSON."""
    return _per_session(bundled(t), (lambda rows: published(usf(rows))) if public else usf, "usf")
