"""Registered queries: session details, timelines, USF, and ingest of rendered transcripts by every JSON-lines source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.operators import assemble
from tracelake.plans.registry import query
from tracelake.sources import base, raw


_SHOWN = """shown AS (SELECT *, row_number() OVER w AS r, coalesce(content_type = 'thinking' AND lag(content_type) OVER w = 'thinking' AND lag(role) OVER w IS NOT DISTINCT FROM role, false) AS more
      FROM messages WHERE coalesce(visibility, 'visible') = 'visible' AND (agent_id IS NULL OR agent_id = session_id) WINDOW w AS (PARTITION BY session_id ORDER BY coalesce(timestamp, ''), uuid)),
    parts AS (SELECT *, (count(*) FILTER (NOT more) OVER (PARTITION BY session_id ORDER BY r ROWS UNBOUNDED PRECEDING) - 1)::INTEGER AS k FROM shown),
    entries AS (SELECT session_id, k, any_value(uuid) FILTER (NOT more) AS uuid, any_value(content_type) AS content_type, any_value(is_meta) FILTER (NOT more) AS is_meta,
      CASE WHEN count(*) = 1 THEN any_value(text) ELSE coalesce(string_agg(nullif(text, ''), chr(10) || chr(10) ORDER BY r), '') END AS text FROM parts GROUP BY session_id, k)"""
_CALLS = """calls AS (SELECT c.session_id, c.message_uuid, string_agg(c.id, ',' ORDER BY c.ingest_seq) AS calls, string_agg(coalesce(r.content, '-'), ',' ORDER BY c.ingest_seq) AS results, bool_and(c.presentation = 'skill') AS skill
      FROM tool_calls c LEFT JOIN tool_results r ON r.tool_use_id = c.id AND r.session_id = c.session_id GROUP BY 1, 2)"""
_EVERY = """every AS (SELECT id AS session_id FROM sessions UNION SELECT session_id FROM messages UNION SELECT session_id FROM tool_calls UNION SELECT session_id FROM tool_results
      UNION SELECT session_id FROM subagents UNION SELECT session_id FROM workflows UNION SELECT session_id FROM summaries)"""
_TABLES = ("sessions", "messages", "tool_calls", "tool_results", "subagents", "workflows", "summaries")
_DETAIL = "session struct<title:string>, messages array<struct<uuid:string,text:string,tool_calls:array<struct<id:string,result:struct<content:string>>>>>, workflows array<struct<run_id:string>>, summaries array<struct<id:string>>"


@query("N1_session_details", f""", {_SHOWN}, {_CALLS}, {_EVERY},
    flows AS (SELECT session_id, string_agg(run_id, ',' ORDER BY ingest_seq) AS workflows FROM workflows GROUP BY 1),
    told AS (SELECT session_id, string_agg(id, ',' ORDER BY ingest_seq) AS summaries FROM summaries WHERE coalesce(visibility, 'visible') = 'visible' GROUP BY 1)
    SELECT v.session_id, s.title, coalesce(f.workflows, '') AS workflows, coalesce(t.summaries, '') AS summaries, e.k, e.uuid, e.text, CASE WHEN e.uuid IS NOT NULL THEN coalesce(c.calls, '') END AS calls,
      CASE WHEN e.uuid IS NOT NULL THEN coalesce(c.results, '') END AS results
    FROM every v LEFT JOIN sessions s ON s.id = v.session_id LEFT JOIN flows f ON f.session_id = v.session_id LEFT JOIN told t ON t.session_id = v.session_id LEFT JOIN entries e ON e.session_id = v.session_id
      LEFT JOIN calls c ON c.session_id = e.session_id AND c.message_uuid = e.uuid""", _TABLES)
def n1(t):
    """Each session's detail, its JSON as rows of messages."""
    d = assemble.details(t).select("session_id", F.from_json("detail", _DETAIL).alias("d"))
    rows = d.select("session_id", F.col("d.session.title").alias("title"), F.array_join("d.workflows.run_id", ",").alias("workflows"), F.array_join("d.summaries.id", ",").alias("summaries"), F.posexplode_outer("d.messages").alias("k", "m"))
    results = F.array_join(F.transform("m.tool_calls", lambda c: F.coalesce(c["result"]["content"], F.lit("-"))), ",")
    return rows.select("session_id", "title", "workflows", "summaries", "k", "m.uuid", "m.text", F.array_join("m.tool_calls.id", ",").alias("calls"), results.alias("results"))


@query("N6_N10_timeline_items", f""", {_SHOWN}, {_CALLS}
    SELECT e.session_id, e.k, CASE WHEN e.is_meta = 1 THEN 'meta' WHEN c.skill THEN 'skill' WHEN e.content_type = 'thinking' THEN 'thinking' ELSE 'message' END AS kind, e.uuid
    FROM entries e LEFT JOIN calls c ON c.session_id = e.session_id AND c.message_uuid = e.uuid""", ("messages", "tool_calls", "tool_results"))
def n10(t):
    return assemble.timeline(t)


_USF = "harness string, title string, turns array<struct<steps:array<struct<id:string,kind:string,state:string,text:string,tools:array<struct<id:string>>,runs:array<struct<agent:string,steps:array<struct<id:string>>>>>>>>"


def _usf_sql(public: bool) -> str:
    """A turn begins with each visible human step that another human step precedes; an agent's run stands at the last main step that isn't later than it."""
    shown = "NOT stated" if public else "true"
    return f""", {_CALLS}, {_EVERY},
    flagged AS (SELECT *, coalesce(timestamp, '') AS moment, coalesce(visibility, 'visible') <> 'visible' AS stated, role = 'user' AND coalesce(is_meta, 0) = 0 AND content_type <> 'tool_result' AS human, agent_id IS NULL OR agent_id = session_id AS own FROM messages),
    main AS (SELECT *, row_number() OVER w AS r, human AND NOT stated AND coalesce(count(*) FILTER (human) OVER (PARTITION BY session_id ORDER BY moment, uuid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) > 0 AS breaks FROM flagged WHERE own WINDOW w AS (PARTITION BY session_id ORDER BY moment, uuid)),
    turned AS (SELECT *, count(*) FILTER (breaks) OVER (PARTITION BY session_id ORDER BY r ROWS UNBOUNDED PRECEDING) AS raw_turn FROM main),
    runs AS (SELECT session_id, agent_id, min(moment) AS moment, concat(agent_id, ':', coalesce(string_agg(uuid, ' ' ORDER BY moment, uuid) FILTER ({shown}), '')) AS run FROM flagged WHERE NOT own GROUP BY 1, 2),
    placed AS (SELECT u.session_id, greatest(1, count(m.uuid)) AS r, any_value(u.run) AS run FROM runs u LEFT JOIN main m ON m.session_id = u.session_id AND m.moment <= u.moment GROUP BY u.session_id, u.agent_id),
    homes AS (SELECT session_id, r, string_agg(run, ',' ORDER BY run) AS runs FROM placed GROUP BY 1, 2),
    steps AS (SELECT *, (dense_rank() OVER (PARTITION BY session_id ORDER BY raw_turn) - 1)::INTEGER AS turn, (row_number() OVER (PARTITION BY session_id, raw_turn ORDER BY r) - 1)::INTEGER AS step FROM turned WHERE {shown})
    SELECT v.session_id, coalesce(s.source, 'claude') AS harness, s.title, t.turn, t.step, t.uuid AS id, CASE WHEN t.human THEN 'human' WHEN t.is_meta = 1 THEN 'meta' WHEN t.uuid IS NOT NULL THEN coalesce(t.content_type, 'text') END AS kind,
      CASE WHEN t.stated THEN t.visibility END AS state, t.text, coalesce(c.calls, '') AS tools, coalesce(h.runs, '') AS runs
    FROM every v LEFT JOIN sessions s ON s.id = v.session_id LEFT JOIN steps t ON t.session_id = v.session_id LEFT JOIN calls c ON c.session_id = t.session_id AND c.message_uuid = t.uuid LEFT JOIN homes h ON h.session_id = t.session_id AND h.r = t.r"""


def _steps(found: DataFrame) -> DataFrame:
    """A row for each step of the main line, with the ids of its tools and of the runs that it began."""
    u = found.select("session_id", F.from_json("usf", _USF).alias("u"))
    turns = u.select("session_id", "u.harness", "u.title", F.posexplode_outer("u.turns").alias("turn", "t"))
    steps = turns.select("session_id", "harness", "title", "turn", F.posexplode_outer("t.steps").alias("step", "s"))
    tools = F.coalesce(F.array_join("s.tools.id", ","), F.lit(""))
    runs = F.coalesce(F.array_join(F.transform("s.runs", lambda r: F.concat(r["agent"], F.lit(":"), F.array_join(r["steps"]["id"], " "))), ","), F.lit(""))
    return steps.select("session_id", "harness", "title", "turn", "step", "s.id", "s.kind", "s.state", "s.text", tools.alias("tools"), runs.alias("runs"))


@query("N7_K5_usf_sessions", _usf_sql(False), _TABLES)
def n7(t):
    return _steps(assemble.sessions_usf(t))


@query("N8_usf_published", _usf_sql(True), _TABLES)
def n8(t):
    return _steps(assemble.sessions_usf(t, public=True))


def _files(t, path: Column, line: Column, head: Column | None = None, end: str = "\n") -> DataFrame:
    """(path, content): one transcript per conversation, a line per turn."""
    rows = t.raw("conversations").select(path.alias("path"), (head if head is not None else F.lit(None).cast("string")).alias("head"), F.struct("turn", line.alias("line")).alias("l"))
    whole = rows.groupBy("path").agg(F.first("head").alias("head"), F.array_sort(F.collect_list("l")).alias("ls"))
    text = F.concat(F.coalesce(F.concat("head", F.lit(end)), F.lit("")), F.array_join("ls.line", end), F.lit(end))
    return whole.select("path", text.cast("binary").alias("content"))


def _told(files: DataFrame, source: str) -> DataFrame:
    found = base.tables_of(base.records(files, base.REGISTRY[source]))
    return found["messages"].select("session_id", "uuid", "parent_uuid", "role", "text", "timestamp")



def _at() -> Column:
    return F.concat(F.lit("2024-01-01T00:00:"), F.lpad(F.col("turn").cast("string"), 2, "0"), F.lit("+00:00"))


def _id() -> Column:
    return F.col("conv_id").cast("string")


_SQL_AT = "concat('2024-01-01T00:00:', lpad(cast(turn AS VARCHAR), 2, '0'), '.000Z')"



@query("S1_claude", f"SELECT concat('c', conv_id) AS session_id, concat(conv_id, '-', turn) AS uuid, CASE WHEN turn > 0 THEN concat(conv_id, '-', turn - 1) END AS parent_uuid, role, text, {_SQL_AT} AS timestamp FROM conversations WHERE role IN ('user', 'assistant')")
def s1(t):
    line = F.to_json(F.struct(F.col("role").alias("type"), F.concat_ws("-", _id(), "turn").alias("uuid"), F.when(F.col("turn") > 0, F.concat_ws("-", _id(), (F.col("turn") - 1).cast("string"))).alias("parentUuid"), _at().alias("timestamp"), F.struct("role", F.array(F.struct(F.lit("text").alias("type"), "text")).alias("content")).alias("message")))
    return _told(_files(t, F.concat(F.lit("/logs/projects/-w/c"), _id(), F.lit(".jsonl")), line), "claude")


@query("T8_unreadable_lines", """SELECT concat('/logs/', conv_id, '.jsonl') AS path, number, line FROM (SELECT *, count(*) OVER (PARTITION BY conv_id) AS n FROM (SELECT conv_id, turn,
      row_number() OVER (PARTITION BY conv_id ORDER BY turn)::INTEGER AS number, CASE turn % 4 WHEN 0 THEN concat('{"turn":', turn, '}') WHEN 1 THEN concat('{"turn":', turn) WHEN 2 THEN concat('[', turn, ']') ELSE '' END AS line FROM conversations)) WHERE turn % 4 IN (1, 2)""")
def t8(t):
    """Lines that a reader of JSON lines passes over: cut off, or no object."""
    turn = F.col("turn").cast("string")
    line = F.when(F.col("turn") % 4 == 0, F.concat(F.lit('{"turn":'), turn, F.lit("}"))).when(F.col("turn") % 4 == 1, F.concat(F.lit('{"turn":'), turn)).when(F.col("turn") % 4 == 2, F.concat(F.lit("["), turn, F.lit("]"))).otherwise("")
    return raw.unreadable(raw.raw_lines(_files(t, F.concat(F.lit("/logs/"), _id(), F.lit(".jsonl")), line)))


@query("S2_codex", f"""SELECT cast(conv_id AS VARCHAR) AS session_id, concat('codex:', conv_id, ':', lpad(cast(turn + 2 AS VARCHAR), 6, '0')) AS uuid, CASE WHEN turn > lo THEN concat('codex:', conv_id, ':', lpad(cast(prev + 2 AS VARCHAR), 6, '0')) END AS parent_uuid, role, text, {_SQL_AT} AS timestamp
    FROM (SELECT *, min(turn) OVER (PARTITION BY conv_id) AS lo, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM conversations WHERE role IN ('user', 'assistant'))""")
def s2(t):
    kind = F.when(F.col("role") == "user", "user_message").when(F.col("role") == "assistant", "agent_message").otherwise("ignored")
    line = F.to_json(F.struct(_at().alias("timestamp"), F.lit("event_msg").alias("type"), F.struct(kind.alias("type"), F.col("text").alias("message")).alias("payload")))
    head = F.to_json(F.struct(F.lit("session_meta").alias("type"), F.struct(_id().alias("id"), F.lit("/w").alias("cwd")).alias("payload")))
    return _told(_files(t, F.concat(F.lit("/logs/rollout-"), _id(), F.lit(".jsonl")), line, head), "codex")


@query("S4_copilot", f"""SELECT cast(conv_id AS VARCHAR) AS session_id, concat('copilot:', conv_id, ':', turn) AS uuid, CASE WHEN prev IS NOT NULL THEN concat('copilot:', conv_id, ':', prev) END AS parent_uuid, role, text, {_SQL_AT} AS timestamp
    FROM (SELECT *, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM conversations WHERE role IN ('user', 'assistant'))""")
def s4(t):
    line = F.to_json(F.struct(F.concat("role", F.lit(".message")).alias("type"), F.col("turn").alias("id"), _at().alias("timestamp"), F.struct(F.col("text").alias("content")).alias("data")))
    return _told(_files(t, F.concat(F.lit("/copilot/"), _id(), F.lit(".jsonl")), line), "copilot")


@query("S12_pi", f"""SELECT concat('pi:', conv_id) AS session_id, concat('pi:', conv_id, ':', turn) AS uuid, CASE WHEN prev IS NOT NULL THEN concat('pi:', conv_id, ':', prev) END AS parent_uuid, role, text, {_SQL_AT} AS timestamp
    FROM (SELECT *, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM conversations WHERE role IN ('user', 'assistant')) WHERE prev = turn - 1 OR prev IS NULL""")
def s12(t):
    line = F.to_json(F.struct(F.lit("message").alias("type"), F.col("turn").cast("string").alias("id"), F.when(F.col("turn") > 0, (F.col("turn") - 1).cast("string")).alias("parentId"), _at().alias("timestamp"), F.struct("role", F.array(F.struct(F.lit("text").alias("type"), "text")).alias("content")).alias("message")))
    head = F.to_json(F.struct(F.lit("session").alias("type"), _id().alias("id"), F.lit("/w").alias("cwd")))
    found = _told(_files(t, F.concat(F.lit("/.pi/sessions/"), _id(), F.lit(".jsonl")), line, head), "pi")
    first = F.min("timestamp").over(Window.partitionBy("session_id"))
    return found.withColumn("f", first).where((F.col("parent_uuid").isNotNull()) | (F.col("timestamp") == F.col("f"))).drop("f")


@query("S8_kimi", f"SELECT concat('kimi:', conv_id) AS session_id, concat('m', turn) AS uuid, cast(NULL AS VARCHAR) AS parent_uuid, role, text, {_SQL_AT} AS timestamp FROM conversations")
def s8(t):
    line = F.to_json(F.struct(F.lit("context.append_message").alias("type"), _at().alias("time"), _at().alias("timestamp"), F.struct(F.concat(F.lit("m"), "turn").alias("id"), "role", F.col("text").alias("content")).alias("message")))
    return _told(_files(t, F.concat(F.lit("/kimi/"), _id(), F.lit("/agents/main/wire.jsonl")), line), "kimi")


@query("S5_deepseek", f"SELECT role, text, {_SQL_AT} AS timestamp FROM conversations WHERE role IN ('user', 'assistant') AND text <> ''")
def s5(t):
    line = F.to_json(F.struct(F.concat("role", F.lit("/message")).alias("type"), (F.col("turn") + 1).alias("seq"), _at().alias("time"), F.struct(F.col("text").alias("content")).alias("data")))
    head = F.to_json(F.struct(F.lit("session").alias("type"), _id().alias("id"), F.lit("/w").alias("cwd")))
    return _told(_files(t, F.concat(F.lit("/deepseek/"), _id(), F.lit("/session.v4.jsonl")), line, head), "deepseek").select("role", "text", "timestamp")


@query("S9_kiro", f"SELECT concat('kiro:', conv_id) AS session_id, role, text, {_SQL_AT} AS timestamp FROM conversations WHERE role IN ('user', 'assistant')")
def s9(t):
    kind = F.when(F.col("role") == "assistant", "AssistantMessage").when(F.col("role") == "user", "Prompt").otherwise("Other")
    content = F.when(F.col("role").isin("user", "assistant"), F.array(F.struct(F.lit("text").alias("kind"), F.col("text").alias("data"))))
    line = F.to_json(F.struct(F.lit("v1").alias("version"), kind.alias("kind"), F.struct(F.col("turn").cast("string").alias("message_id"), content.alias("content"), F.struct(_at().alias("timestamp")).alias("meta")).alias("data")))
    return _told(_files(t, F.concat(F.lit("/kiro/"), _id(), F.lit(".jsonl")), line), "kiro").select("session_id", "role", "text", "timestamp")
