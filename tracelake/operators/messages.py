"""Message windows, pages, threads, and parent chains."""

from __future__ import annotations

import functools

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.functions import predicates as p
from tracelake.functions.storage import written

MOST = 500
DEEPEST = 10_000
_OPTIONS = {"uuid", "around", "session_id", "relation", "before_count", "after_count", "after", "before", "limit", "cursor", "agent_id", "content_types", "include_meta", "include_inactive", "include_session"}


def qualifies(include_meta: bool = False, include_inactive: bool = False, content_types: Iterable[str] | None = None) -> Column:
    out = p.is_visible(include_inactive=include_inactive)
    if not include_meta:
        out = out & p.not_meta()
    if content_types is not None:
        out = out & F.col("content_type").isin(list(content_types))
    return out


def place(timestamp="timestamp", uuid="uuid") -> Column:
    """The order of a session's messages: time as text, a missing one first, then uuid."""
    return F.struct(F.coalesce(p.as_column(timestamp), F.lit("")).alias("t"), p.as_column(uuid).alias("u"))


def windows(messages: DataFrame, anchors: DataFrame, before: int = 3, after: int = 3, **filters) -> DataFrame:
    """(anchor, side, k, message columns): the neighbours of each anchor row in its session and agent.

    k counts away from the anchor; one neighbour more than asked for is kept with
    over = true, for has_more. All anchors are served by one join and one ranking.
    """
    a = anchors.select(F.col("uuid").alias("anchor"), F.col("session_id").alias("s"), F.col("agent_id").alias("a"), place().alias("at"))
    rows = messages.where(qualifies(**filters)).join(a, (F.col("session_id") == F.col("s")) & F.col("agent_id").eqNullSafe(F.col("a"))).where(place() != F.col("at"))
    rows = rows.withColumn("side", F.when(place() < F.col("at"), "before").otherwise("after"))
    near = F.when(F.col("side") == "before", F.row_number().over(Window.partitionBy("anchor", "side").orderBy(F.desc(place())))).otherwise(F.row_number().over(Window.partitionBy("anchor", "side").orderBy(F.asc(place()))))
    most = F.when(F.col("side") == "before", before).otherwise(after)
    rows = rows.withColumn("k", near).where(F.col("k") <= most + 1).where(most > 0).withColumn("over", F.col("k") > most)
    return rows.select("anchor", "side", "k", "over", *messages.columns)


def page(messages: DataFrame, session_id: str, limit: int = 20, cursor: tuple[str | None, str] | None = None, after: str | None = None, before: str | None = None, agent_id="any", **filters) -> DataFrame:
    """A session's messages after the cursor (timestamp, uuid), one more than `limit` for has_more."""
    rows = messages.where((F.col("session_id") == session_id) & qualifies(**filters))
    if agent_id != "any":
        rows = rows.where(F.col("agent_id").eqNullSafe(F.lit(agent_id)))
    if after is not None:
        rows = rows.where(F.col("timestamp") > after)
    if before is not None:
        rows = rows.where(F.col("timestamp") < before)
    if cursor is not None:
        rows = rows.where(place() > F.struct(F.lit(cursor[0] or "").alias("t"), F.lit(cursor[1]).alias("u")))
    return rows.orderBy(F.coalesce("timestamp", F.lit("")), "uuid").limit(limit + 1)


def thread(messages: DataFrame, session_id: str, include_meta: bool = False, include_inactive: bool = False) -> DataFrame:
    return messages.where((F.col("session_id") == session_id) & qualifies(include_meta, include_inactive)).orderBy(F.asc_nulls_first("timestamp"), "uuid")


def related(messages: DataFrame, anchors: DataFrame) -> DataFrame:
    """(uuid, parent_uuid) of the anchors' sessions, and of all sessions that parents lead to from there: no chain leaves them.

    Parents mostly stay in their session, so this is two rounds of joins against a narrow
    scan, after which only these sessions' rows are written and shuffled.
    """
    links = messages.select("uuid", "parent_uuid", "session_id")
    fresh = written(links.join(anchors.select("uuid").distinct(), "uuid", "left_semi").select("session_id").distinct())
    parts: list[DataFrame] = []
    while not fresh.isEmpty():
        own = links.join(fresh.select(F.col("session_id").alias("__s")), F.col("session_id").eqNullSafe(F.col("__s")), "left_semi")
        parts.append(written(own))
        held = functools.reduce(DataFrame.unionByName, parts)
        beyond = parts[-1].where("parent_uuid is not null").select(F.col("parent_uuid").alias("uuid")).distinct().join(held.select("uuid"), "uuid", "left_anti")
        met = links.join(written(beyond), "uuid", "left_semi").select("session_id").distinct()
        known = held.select(F.col("session_id").alias("__s")).distinct()
        fresh = written(met.join(known, F.col("session_id").eqNullSafe(F.col("__s")), "left_anti"))
    return functools.reduce(DataFrame.unionByName, parts).select("uuid", "parent_uuid") if parts else links.where("false").select("uuid", "parent_uuid")


def ancestors(messages: DataFrame, anchors: DataFrame) -> DataFrame:
    """(anchor, uuid, depth): each anchor's distinct ancestors (depth 0 is the anchor itself).

    Pointer doubling over the sessions that the anchors' chains run through: after k rounds a
    chain reaches 2^k up, so a chain of 10,000 costs 14 joins of narrow columns. A cycle adds
    no new uuid and ends the search; a missing parent ends its chain.
    """
    known = related(messages, anchors)
    jump = known.join(known.select(F.col("uuid").alias("parent_uuid")), "parent_uuid").select("uuid", F.col("parent_uuid").alias("up"))
    jump = written(jump)
    chain = written(anchors.select(F.col("uuid").alias("anchor"), "uuid", F.lit(0).cast("long").alias("depth")))
    size, step = chain.count(), 1
    while True:
        further = chain.join(jump, "uuid").select("anchor", F.col("up").alias("uuid"), (F.col("depth") + step).alias("depth"))
        chain = written(chain.union(further).groupBy("anchor", "uuid").agg(F.min("depth").alias("depth")))
        grown = chain.count()
        if grown == size:
            return chain
        size, step = grown, 2 * step
        jump = written(jump.select("uuid", F.col("up").alias("middle")).join(jump.select(F.col("uuid").alias("middle"), "up"), "middle").select("uuid", "up"))


def parent_chains(messages: DataFrame, anchors: DataFrame, include_start: bool = False, include_inactive: bool = False) -> DataFrame:
    """(anchor, depth, message columns) of the visible ancestors; hidden ones are passed through. Cycles and gaps end a chain."""
    found = ancestors(messages, anchors)
    if not include_start:
        found = found.where("depth > 0")
    return found.join(messages.where(p.is_visible(include_inactive=include_inactive)), "uuid").select("anchor", "depth", *messages.columns)


def cyclic(messages: DataFrame, chains: DataFrame) -> DataFrame:
    """The anchors whose chain runs into itself: the last ancestor's parent is in the chain."""
    last = chains.groupBy("anchor").agg(F.max_by("uuid", "depth").alias("uuid"))
    ends = last.join(messages.select("uuid", "parent_uuid"), "uuid").select("anchor", F.col("parent_uuid").alias("uuid"))
    return ends.join(chains, ["anchor", "uuid"], "left_semi").select("anchor")


def parents(messages: DataFrame, anchors: DataFrame, count: int, **filters) -> DataFrame:
    """(anchor, k, over, message columns): the nearest `count` qualifying ancestors and one more; others are passed through."""
    found = ancestors(messages, anchors).where("depth > 0").join(messages.where(qualifies(**filters)), "uuid")
    k = F.row_number().over(Window.partitionBy("anchor").orderBy("depth"))
    return found.withColumn("k", k).where(F.col("k") <= count + 1).select("anchor", "k", (F.col("k") > count).alias("over"), "depth", *messages.columns)


def _require(ok: bool, error: type[Exception], text: str) -> None:
    if not ok:
        raise error(f"messages() {text}")


def _count(value, default: int, name: str) -> int:
    value = default if value is None else value
    _require(isinstance(value, int) and not isinstance(value, bool) and 0 <= value <= MOST, ValueError, f"{name} must be an integer from 0 to {MOST}")
    return value


def checked(options: dict) -> dict:
    """The validated options of `query`, with defaults; TypeError and ValueError say what is wrong."""
    for key in options:
        _require(key in _OPTIONS, TypeError, f"does not support option {key}")
    modes = [k for k in ("uuid", "around", "session_id") if k in options]
    _require(len(modes) == 1, TypeError, "requires exactly one of uuid, around, or session_id")
    mode = modes[0]
    locator = options[mode]
    _require(isinstance(locator, str) and bool(locator.strip()), TypeError, f"{mode} must be a non-empty string")
    out = {"mode": mode, "locator": locator}
    for key in ("include_meta", "include_inactive", "include_session"):
        _require(options.get(key) is None or isinstance(options[key], bool), TypeError, f"{key} must be boolean")
        out[key] = options.get(key) is True
    unfit = [] if mode == "session_id" else ["after", "before", "limit", "cursor", "agent_id"]
    unfit += [] if mode == "around" else ["relation", "before_count", "after_count"]
    for key in unfit:
        _require(key not in options, TypeError, f"{key} is not supported with {mode}")
    relation = options.get("relation") or "timeline"
    _require(relation in ("timeline", "parents"), TypeError, "relation must be timeline or parents")
    around = mode == "around"
    out["relation"] = relation
    out["before_count"] = _count(options.get("before_count"), 3, "before_count") if around else 0
    out["after_count"] = _count(options.get("after_count"), 0 if relation == "parents" else 3, "after_count") if around else 0
    _require(relation != "parents" or out["after_count"] == 0, ValueError, "parents relation requires after_count: 0")
    _require(out["before_count"] + out["after_count"] + 1 <= MOST, ValueError, f"window must contain at most {MOST} messages including the anchor")
    out["limit"] = _count(options.get("limit"), 20, "limit") if mode == "session_id" else 0
    kinds = options.get("content_types")
    _require(kinds is None or (isinstance(kinds, list | tuple) and len(kinds) > 0 and all(isinstance(x, str) and x.strip() for x in kinds)), TypeError, "content_types must be a non-empty list of strings")
    out["content_types"] = kinds
    for key in ("after", "before"):
        _require(options.get(key) is None or (isinstance(options[key], str) and bool(options[key].strip())), TypeError, f"{key} must be a non-empty timestamp string")
        out[key] = options.get(key)
    out["agent_id"] = options.get("agent_id", "any")
    _require(out["agent_id"] is None or isinstance(out["agent_id"], str), TypeError, "agent_id must be a string or None")
    cursor = options.get("cursor")
    if cursor is not None:
        _require(isinstance(cursor, dict) and isinstance(cursor.get("uuid"), str) and bool(cursor["uuid"].strip()) and (cursor.get("timestamp") is None or isinstance(cursor["timestamp"], str)), TypeError, "cursor requires timestamp (string or None) and uuid")
    out["cursor"] = cursor
    return out


def query(messages: DataFrame, sessions: DataFrame, **options) -> dict | None:
    """The envelope {anchor, messages, session, has_more, next_cursor} of one uuid, window, chain or page."""
    o = checked(options)
    filters = {k: o[k] for k in ("include_meta", "include_inactive", "content_types")}

    def shown(rows):
        return [{k: v for k, v in (r.asDict().items()) if k not in ("anchor", "side", "k", "over", "depth")} | {"visibility": r["visibility"] or "visible"} for r in rows]

    def session_of(session_id):
        rows = sessions.where(F.col("id") == session_id).take(1) if o["include_session"] else []
        return rows[0].asDict() if rows else None

    if o["mode"] == "session_id":
        cursor = (o["cursor"]["timestamp"], o["cursor"]["uuid"]) if o["cursor"] else None
        rows = page(messages, o["locator"], o["limit"], cursor, o["after"], o["before"], o["agent_id"], **filters).collect()
        chosen = shown(rows[: o["limit"]])
        more = len(rows) > o["limit"]
        return {"anchor": None, "messages": chosen, "session": session_of(o["locator"]), "has_more": more, "next_cursor": {k: chosen[-1][k] for k in ("timestamp", "uuid")} if more and chosen else None}
    anchors = messages.where((F.col("uuid") == o["locator"]) & p.is_visible(include_inactive=o["include_inactive"]))
    found = anchors.take(1)
    if not found:
        return None
    before, after, more = [], [], False
    if o["mode"] == "around" and o["relation"] == "parents" and o["before_count"]:
        chains = ancestors(messages, anchors)
        rows = chains.where("depth > 0").join(messages.where(qualifies(**filters)), "uuid").orderBy("depth").limit(o["before_count"] + 1).collect()
        deepest = chains.agg(F.max("depth")).first()[0]
        if len(rows) <= o["before_count"]:
            if not cyclic(messages, chains).isEmpty():
                raise ValueError("messages() found a cyclic parent path")
            if deepest > DEEPEST:
                raise ValueError(f"messages() parent traversal exceeded {DEEPEST} records")
        more = len(rows) > o["before_count"]
        before = shown(rows[: o["before_count"]][::-1])
    elif o["mode"] == "around" and o["relation"] == "timeline":
        rows = windows(messages, anchors, o["before_count"], o["after_count"], **filters).orderBy("k").collect()
        more = any(r["over"] for r in rows)
        before = shown([r for r in rows if r["side"] == "before" and not r["over"]][::-1])
        after = shown([r for r in rows if r["side"] == "after" and not r["over"]])
    anchor = shown(found)[0]
    return {"anchor": anchor, "messages": [*before, anchor, *after], "session": session_of(found[0]["session_id"]), "has_more": more, "next_cursor": None}


def contexts(t, anchors: DataFrame) -> DataFrame:
    """(uuid, session columns, subagent and workflow ids) of anchor messages: what surrounds each."""
    from tracelake.operators import agents

    derived = agents.with_derived(t.subagents, t.messages).select("agent_id", F.col("total_tokens").alias("agent_tokens"), "agent_type")
    flows = t.workflow_agents.select("agent_id", "run_id").join(t.workflows.select("run_id", "workflow_name"), "run_id")
    own = anchors.select("uuid", "session_id", "agent_id")
    titled = t.sessions.select(F.col("id").alias("session_id"), "title", "project")
    return own.join(titled, "session_id", "left").join(derived, "agent_id", "left").join(flows, "agent_id", "left").select("uuid", "session_id", "title", "project", "agent_id", "agent_type", "agent_tokens", "run_id", "workflow_name")
