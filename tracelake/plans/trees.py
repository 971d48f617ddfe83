"""Registered queries: windows around a message, pages, parent chains, joins of tool rows, agents, overview."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracelake.operators import agents, messages, overview, tools
from tracelake.plans.registry import query

_OK = "coalesce(visibility, 'visible') = 'visible' AND coalesce(is_meta, 0) = 0"


def _middles(t):
    """One anchor per session: the message with the smallest uuid that stands third or later."""
    return t.messages.where("substring(uuid, -6) = '000002'")


@query("W1_timeline_windows", f""", n AS (SELECT a.uuid AS anchor, m.uuid, CASE WHEN (coalesce(m.timestamp, ''), m.uuid) < (coalesce(a.timestamp, ''), a.uuid) THEN 'before' ELSE 'after' END AS side, coalesce(m.timestamp, '') AS ts
      FROM (SELECT * FROM messages WHERE uuid LIKE '%000002') a JOIN (SELECT * FROM messages WHERE {_OK}) m ON m.session_id = a.session_id AND m.agent_id IS NOT DISTINCT FROM a.agent_id AND m.uuid <> a.uuid),
    r AS (SELECT *, CASE side WHEN 'before' THEN row_number() OVER (PARTITION BY anchor, side ORDER BY ts DESC, uuid DESC) ELSE row_number() OVER (PARTITION BY anchor, side ORDER BY ts, uuid) END AS k FROM n)
    SELECT anchor, side, k::INTEGER AS k, k > 2 AS over, uuid FROM r WHERE k <= 3""", ("messages",))
def w1(t):
    return messages.windows(t.messages, _middles(t), 2, 2).select("anchor", "side", "k", "over", "uuid")


@query("O5_keyset_page", f"SELECT uuid, timestamp FROM messages WHERE session_id = 'conv:1' AND {_OK} AND (coalesce(timestamp, ''), uuid) > ('2024-01-01T01:00:00.000Z', 'conv:1:000000') ORDER BY coalesce(timestamp, ''), uuid LIMIT 4", ("messages",))
def o5(t):
    return messages.page(t.messages, "conv:1", 3, ("2024-01-01T01:00:00.000Z", "conv:1:000000")).select("uuid", "timestamp")


_WALK = "chain AS (SELECT a.uuid AS anchor, a.uuid, a.parent_uuid, 0 AS depth FROM messages a WHERE a.uuid IN (SELECT max(uuid) FROM messages GROUP BY session_id) UNION ALL SELECT c.anchor, m.uuid, m.parent_uuid, c.depth + 1 FROM chain c JOIN messages m ON m.uuid = c.parent_uuid)"


def _lasts(t):
    last = t.messages.groupBy("session_id").agg(F.max("uuid").alias("uuid"))
    return t.messages.join(last.select("uuid"), "uuid", "left_semi")


@query("N12_J14_parent_chains", f", {_WALK} SELECT c.anchor, c.depth::BIGINT AS depth, m.uuid FROM chain c JOIN messages m USING (uuid) WHERE c.depth > 0 AND coalesce(m.visibility, 'visible') = 'visible'", ("messages",))
def n12(t):
    return messages.parent_chains(t.messages, _lasts(t)).select("anchor", "depth", "uuid")


@query("N13_qualifying_parents", f", {_WALK}, r AS (SELECT c.anchor, m.uuid, row_number() OVER (PARTITION BY c.anchor ORDER BY c.depth) AS k FROM chain c JOIN messages m USING (uuid) WHERE c.depth > 0 AND {_OK}) SELECT anchor, uuid, k::INTEGER AS k, k > 2 AS over FROM r WHERE k <= 3", ("messages",))
def n13(t):
    return messages.parents(t.messages, _lasts(t), 2).select("anchor", "uuid", "k", "over")


@query("J15_message_context", """SELECT m.uuid, m.session_id, s.title, s.project, m.agent_id, a.agent_type,
      coalesce(a.total_tokens, (SELECT sum(coalesce(x.input_tokens, 0) + coalesce(x.output_tokens, 0)) FROM messages x WHERE x.agent_id = m.agent_id AND (x.input_tokens IS NOT NULL OR x.output_tokens IS NOT NULL) AND a.agent_id IS NOT NULL))::BIGINT AS agent_tokens, w.run_id, f.workflow_name
    FROM messages m LEFT JOIN sessions s ON s.id = m.session_id LEFT JOIN subagents a ON a.agent_id = m.agent_id LEFT JOIN workflow_agents w ON w.agent_id = m.agent_id LEFT JOIN workflows f ON f.run_id = w.run_id""", ("messages", "sessions", "subagents", "workflow_agents", "workflows"))
def j15(t):
    return messages.contexts(t, t.messages)


_FAILED = """failed AS (SELECT r.tool_use_id, r.session_id, r.message_uuid, r.content, r.is_error, c.name AS call_name, rm.timestamp AS result_at,
      CASE WHEN coalesce(rm.visibility, 'visible') = 'inactive' OR coalesce(cm.visibility, 'visible') = 'inactive' THEN 'inactive' ELSE 'visible' END AS visibility
    FROM tool_results r LEFT JOIN messages rm ON rm.uuid = r.message_uuid LEFT JOIN tool_calls c ON c.id = r.tool_use_id LEFT JOIN messages cm ON cm.uuid = c.message_uuid
    WHERE (coalesce(r.is_error = 1, false) OR r.content ILIKE 'Exit code %') AND coalesce(rm.visibility, 'visible') IN ('visible', 'inactive') AND coalesce(cm.visibility, 'visible') IN ('visible', 'inactive')
    ORDER BY rm.timestamp DESC NULLS LAST, r.tool_use_id LIMIT 50)"""
_F3 = ("tool_results", "tool_calls", "messages")


@query("J2_P13_failures", f", {_FAILED} SELECT * FROM failed", _F3)
def j2(t):
    return tools.failures(t.tool_results, t.tool_calls, t.messages, t.sessions, include_inactive=True)


@query("J13_next_after_failure", f", {_FAILED}, n AS (SELECT f.tool_use_id, m.uuid, row_number() OVER (PARTITION BY f.tool_use_id ORDER BY m.timestamp, m.uuid) AS k FROM failed f JOIN messages m ON m.session_id = f.session_id AND m.timestamp > f.result_at AND coalesce(m.visibility, 'visible') = 'visible') SELECT tool_use_id, k::INTEGER AS k, uuid FROM n WHERE k <= 3", _F3)
def j13(t):
    return tools.next_messages(tools.failures(t.tool_results, t.tool_calls, t.messages, t.sessions, include_inactive=True), t.messages)


@query("J3_file_history", "SELECT c.id, c.message_uuid, c.name, c.input_json, c.session_id, s.title, s.project, m.timestamp, 'visible' AS visibility FROM tool_calls c LEFT JOIN sessions s ON s.id = c.session_id LEFT JOIN messages m ON m.uuid = c.message_uuid WHERE c.file_path = '/work/p1/f3.py' AND coalesce(m.visibility, 'visible') = 'visible' ORDER BY m.timestamp NULLS FIRST, c.message_uuid, c.ingest_seq LIMIT 200", ("tool_calls", "sessions", "messages"))
def j3(t):
    return tools.file_history(t.tool_calls, t.messages, t.sessions, "/work/p1/f3.py")


@query("J5_summaries", "SELECT m.id, m.session_id, m.timestamp, s.title AS session_title, s.project FROM summaries m LEFT JOIN sessions s ON s.id = m.session_id WHERE coalesce(m.visibility, 'visible') = 'visible' AND s.project ILIKE 'proj-3' ORDER BY m.timestamp DESC NULLS LAST, m.id LIMIT 100", ("summaries", "sessions"))
def j5(t):
    from tracelake.plans.engine import Engine

    return Engine(t).summaries(project="proj-3").select("id", "session_id", "timestamp", "session_title", "project")


@query("A9_A10_subagents", """, a AS (SELECT agent_id, count(*) AS c, sum(CASE WHEN input_tokens IS NOT NULL OR output_tokens IS NOT NULL THEN coalesce(input_tokens, 0) + coalesce(output_tokens, 0) END) AS d, min(timestamp) AS lo, max(timestamp) AS hi FROM messages WHERE agent_id IS NOT NULL GROUP BY 1)
    SELECT s.agent_id, s.session_id, coalesce(s.total_tokens, d)::BIGINT AS total_tokens, coalesce(c, 0)::BIGINT AS message_count FROM subagents s LEFT JOIN a USING (agent_id) WHERE hi > '2024-01-01T05:00:00.000Z' AND lo < '2024-01-20' ORDER BY s.agent_id LIMIT 100""", ("subagents", "messages"))
def a9(t):
    return agents.subagents(t.subagents, t.messages, t.sessions, after="2024-01-01T05:00:00.000Z", before="2024-01-20").select("agent_id", "session_id", "total_tokens", "message_count")


@query("O2_workflows", "SELECT w.run_id, w.timestamp FROM workflows w LEFT JOIN sessions s ON s.id = w.session_id WHERE s.git_branch = 'b1' ORDER BY w.timestamp DESC NULLS LAST, w.run_id LIMIT 100", ("workflows", "sessions"))
def o2(t):
    return agents.workflows(t.workflows, t.sessions, branch="b1").select("run_id", "timestamp")


@query("N11_J16_workflow_tree", "SELECT w.run_id, w.result_json AS result, a.agent_id, a.tokens, (SELECT count(*) FROM messages m WHERE m.agent_id = a.agent_id)::BIGINT AS message_count FROM workflows w JOIN workflow_agents a USING (run_id)", ("workflows", "workflow_agents", "messages"))
def n11(t):
    tree = agents.workflow_tree(t.workflows, t.workflow_agents, t.messages)
    return tree.select("run_id", F.to_json("result").alias("result"), F.explode("agents").alias("a")).select("run_id", "result", "a.agent_id", "a.tokens", "a.message_count")


@query("A6_J7_W9_overview_projects", """, s AS (SELECT project, count(*) AS n, max(coalesce(ended_at, started_at)) AS seen, arg_max(project_path, (coalesce(ended_at, started_at), id)) AS path FROM sessions WHERE project IS NOT NULL GROUP BY 1),
    m AS (SELECT project, count(*) AS n, max(created_at) AS seen FROM memories WHERE project IS NOT NULL AND deleted_at IS NULL GROUP BY 1),
    b AS (SELECT project, string_agg(git_branch, ',' ORDER BY seen DESC, git_branch) AS branches FROM (SELECT *, row_number() OVER (PARTITION BY project ORDER BY seen DESC, git_branch) AS k FROM (SELECT project, git_branch, max(coalesce(ended_at, started_at)) AS seen FROM sessions WHERE git_branch <> '' GROUP BY 1, 2)) WHERE k <= 5 GROUP BY 1)
    SELECT project, s.path AS project_path, coalesce(s.n, 0)::BIGINT AS session_count, coalesce(m.n, 0)::BIGINT AS memory_count, s.seen AS last_session_at, m.seen AS last_memory_at, coalesce(branches, '') AS branches FROM s FULL JOIN m USING (project) LEFT JOIN b USING (project)
    ORDER BY coalesce(s.seen, m.seen) DESC NULLS LAST, project LIMIT 20""", ("sessions", "memories"))
def a6(t):
    found = overview.projects(t.sessions, t.memories)
    return found.withColumn("branches", F.array_join("recent_branches", ",")).drop("recent_branches")


@query("A7_overview_totals", "SELECT (SELECT count(*) FROM (SELECT project FROM sessions WHERE project IS NOT NULL UNION SELECT project FROM memories WHERE project IS NOT NULL AND deleted_at IS NULL))::BIGINT AS projects, (SELECT count(*) FROM sessions)::BIGINT AS sessions, (SELECT count(*) FROM memories WHERE deleted_at IS NULL)::BIGINT AS memories", ("sessions", "memories"))
def a7(t):
    return overview.totals(t.sessions, t.memories)


@query("A7_overview_sources", "SELECT coalesce(source, 'claude') AS source, count(*)::BIGINT AS session_count, max(coalesce(ended_at, started_at)) AS last_session_at FROM sessions GROUP BY 1", ("sessions",))
def a7s(t):
    return overview.sources(t.sessions)


@query("A8_current_project", "SELECT project, project_path, 'cwd_project_path' AS origin, 'exact' AS confidence FROM (SELECT project, project_path, max(coalesce(ended_at, started_at)) AS seen FROM sessions WHERE project IS NOT NULL AND project_path <> '' AND ('/work/p3/sub' = project_path OR starts_with('/work/p3/sub', project_path || '/')) GROUP BY 1, 2) ORDER BY length(project_path) DESC, seen DESC, project LIMIT 1", ("sessions",))
def a8(t):
    found = overview.current_project(t.sessions, t.memories, t.messages, cwd="/work/p3/sub")
    return t.spark.createDataFrame([(found["project"], found["project_path"], found["from"], found["confidence"])], "project string, project_path string, origin string, confidence string")


@query("A19_file_synthesis", """, r AS (SELECT c.*, m.timestamp, row_number() OVER (PARTITION BY c.session_id ORDER BY m.timestamp DESC NULLS LAST, c.id) AS k FROM tool_calls c LEFT JOIN messages m ON m.uuid = c.message_uuid WHERE c.file_path = '/work/p2/f4.py')
    SELECT session_id, 0::BIGINT AS writes, count(*)::BIGINT AS reads, min(timestamp) AS first_at, max(timestamp) AS last_at, string_agg(id, ',' ORDER BY k) FILTER (k <= 2) AS evidence FROM r GROUP BY 1""", ("tool_calls", "messages"))
def a19(t):
    found = tools.file_synthesis(t.tool_calls, t.messages, "/work/p2/f4.py")
    return found.withColumn("evidence", F.array_join("evidence", ","))


@query("J11_workflow_heal", """, c AS (SELECT w.run_id, arg_min(r.tool_use_id, r.ingest_seq) AS healed FROM workflows w JOIN tool_results r ON r.session_id = w.session_id JOIN tool_calls k ON k.id = r.tool_use_id AND k.name = 'view' WHERE contains(r.content, substr(w.run_id, 4)) GROUP BY 1)
    SELECT run_id, healed AS parent_tool_use_id FROM workflows LEFT JOIN c USING (run_id)""", ("workflows", "tool_results", "tool_calls"))
def j11(t):
    short = t.workflows.withColumn("run_id", F.substring("run_id", 4, 100))
    healed = tools.heal_workflow_parents(short, t.tool_results, t.tool_calls, "view")
    return healed.select(F.concat(F.lit("wf:"), "run_id").alias("run_id"), "parent_tool_use_id")
