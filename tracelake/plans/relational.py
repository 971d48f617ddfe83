"""Registered queries: predicates, session lists, aggregates, usage series, set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracelake.functions import predicates as p
from tracelake.operators import sessions as s
from tracelake.operators import usage as u
from tracelake.plans.registry import query

_M = "coalesce(visibility, 'visible') = 'visible'"
_LABEL = "coalesce(nullif(list_filter(string_split(project_path, '/'), lambda x: x <> '')[-1], NULL), regexp_replace(project, '^-', ''))"
_DAY = "strftime(cast(timestamp AS TIMESTAMP), '%Y-%m-%d')"
_USAGE = """usage AS (SELECT timestamp, coalesce(input_tokens, 0) + coalesce(output_tokens, 0) AS tokens FROM
 (SELECT timestamp, input_tokens, output_tokens FROM messages UNION ALL SELECT timestamp, input_tokens, output_tokens FROM summaries)
 WHERE input_tokens IS NOT NULL OR output_tokens IS NOT NULL),
days AS (SELECT strftime(cast(timestamp AS TIMESTAMP), '%Y-%m-%d') AS day, sum(tokens)::BIGINT AS tokens FROM usage WHERE timestamp IS NOT NULL GROUP BY 1)"""
_U = ("messages", "summaries")


def _days(t):
    return u.daily(u.usage_rows(t.messages, t.summaries))


@query("A1_usage_daily", f", {_USAGE} SELECT day, tokens FROM days", _U)
def a1(t):
    """Tokens per UTC day of messages and summaries."""
    return _days(t)


@query("A2_usage_totals", f", {_USAGE} SELECT (SELECT sum(tokens)::BIGINT FROM usage) AS total_tokens, day AS peak_day, tokens AS peak_tokens FROM days ORDER BY tokens DESC, day LIMIT 1", _U)
def a2(t):
    return u.totals(u.usage_rows(t.messages, t.summaries))


@query("A3_longest_turn", "SELECT uuid, session_id, turn_duration_ms FROM messages WHERE turn_duration_ms IS NOT NULL ORDER BY turn_duration_ms DESC, uuid LIMIT 1", ("messages",))
def a3(t):
    return u.longest_turn(t.messages)


@query("A21_usage_weekly", f", {_USAGE} SELECT strftime(date_trunc('week', cast(day AS DATE)), '%Y-%m-%d') AS week, sum(tokens)::BIGINT AS tokens FROM days GROUP BY 1", _U)
def a21(t):
    return u.weekly(_days(t))


@query("W4_usage_cumulative", f", {_USAGE} SELECT day, tokens, (sum(tokens) OVER (ORDER BY day ROWS UNBOUNDED PRECEDING))::BIGINT AS running FROM days", _U)
def w4(t):
    return u.cumulative(_days(t))


_ISLANDS = """runs AS (SELECT min(d) AS first, max(d) AS last, count(*) AS length FROM
 (SELECT cast(day AS DATE) AS d, cast(day AS DATE) - cast(row_number() OVER (ORDER BY day) AS INTEGER) AS g FROM days WHERE tokens > 0) GROUP BY g)"""


@query(
    "W5_W6_streaks",
    f", {_USAGE}, {_ISLANDS} SELECT (SELECT max(length) FROM runs)::BIGINT AS longest, (SELECT (last - greatest(first, DATE '2024-01-20' - 365) + 1)::BIGINT FROM "
    "(SELECT min(d) AS first, max(d) AS last FROM (SELECT cast(day AS DATE) AS d, cast(day AS DATE) - cast(row_number() OVER (ORDER BY day) AS INTEGER) AS g FROM days WHERE tokens > 0 AND day <= '2024-01-20') GROUP BY g) ORDER BY last DESC LIMIT 1) AS current",
    _U,
)
def w5(t):
    return u.streaks(_days(t), "2024-01-20")


@query(
    "W7_heatmap",
    f", {_USAGE} SELECT strftime(g.d, '%Y-%m-%d') AS day, coalesce(tokens, 0)::BIGINT AS tokens, "
    "(CASE WHEN coalesce(tokens, 0) > 0 THEN least(4, ceil(tokens / max(tokens) OVER () * 4)) ELSE 0 END)::BIGINT AS level "
    "FROM (SELECT unnest(generate_series(DATE '2024-02-03' - 370, DATE '2024-02-03', INTERVAL 1 DAY)) AS d) g LEFT JOIN days ON cast(day AS DATE) = cast(g.d AS DATE)",
    _U,
)
def w7(t):
    return u.heatmap(_days(t), "2024-01-30")


@query("P1_O1_sessions_scoped", "SELECT id, title, project, ended_at FROM sessions WHERE project ILIKE 'PROJ-%' AND ended_at > '2024-01-01T05:00:00.000Z' AND ended_at < '2024-01-04T00:00:00.000Z' AND coalesce(source, 'claude') = 'claude' ORDER BY ended_at DESC NULLS LAST, id LIMIT 50", ("sessions",))
def o1(t):
    return s.sessions(t.sessions, project="PROJ-%", after="2024-01-01T05:00:00.000Z", before="2024-01-04T00:00:00.000Z", source="claude").select("id", "title", "project", "ended_at")


@query(
    "P2_session_fragments",
    """, refs AS (SELECT * FROM (VALUES ('conv:1'), ('nv:3'), ('conv:99999'), ('onv:2')) r(ref)),
    exact AS (SELECT id, ref FROM sessions JOIN refs ON id = ref),
    held AS (SELECT id, row_number() OVER (PARTITION BY ref ORDER BY ended_at DESC NULLS LAST, id) AS k FROM sessions JOIN refs ON contains(id, ref)
             WHERE ref NOT IN (SELECT ref FROM exact) AND project ILIKE 'proj-%')
    SELECT id, ended_at FROM sessions WHERE id IN (SELECT id FROM exact UNION SELECT id FROM held WHERE k <= 10) ORDER BY ended_at DESC NULLS LAST, id LIMIT 15""",
    ("sessions",),
)
def p2(t):
    return s.sessions(t.sessions, ["conv:1", "nv:3", "", "conv:99999", "onv:2"], limit=15, project="proj-%").select("id", "ended_at")


@query("P3_P4_catalogue_search", "SELECT id, title FROM sessions WHERE title <> '' AND (coalesce(contains(lower(title), 'session 1'), false) OR coalesce(contains(lower(project), 'session 1'), false))", ("sessions",))
def p3(t):
    return t.sessions.where(p.is_titled() & p.catalogue_contains("SESSION 1", "title", "project")).select("id", "title")


@query("P5_interval_overlap", "SELECT id FROM sessions WHERE started_at < '2024-01-02' AND coalesce(ended_at, started_at) >= '2024-01-01T10'", ("sessions",))
def p5(t):
    return t.sessions.where(p.overlaps("started_at", "ended_at", "2024-01-01T10", "2024-01-02")).select("id")


@query("P6_main_timeline", f"SELECT uuid, timestamp FROM messages WHERE (agent_id IS NULL OR agent_id = session_id) AND {_M}", ("messages",))
def p6(t):
    return t.messages.where(p.on_main_timeline() & p.is_visible()).select("uuid", "timestamp")


@query("P7_failure_rows", "SELECT tool_use_id, content FROM tool_results WHERE coalesce(is_error = 1, false) OR content ILIKE 'Exit code %'", ("tool_results",))
def p7(t):
    return t.tool_results.where(p.is_failure()).select("tool_use_id", "content")


@query("P8_canonical_timestamps", "SELECT coalesce(regexp_matches(timestamp, '^\\d{4}-\\d{2}-\\d{2}T\\d{2}:\\d{2}:\\d{2}\\.\\d{3}Z$'), false) AS canonical, count(*)::BIGINT AS n FROM messages GROUP BY 1", ("messages",))
def p8(t):
    return t.messages.groupBy(p.is_canonical().alias("canonical")).agg(F.count("*").alias("n"))


@query("P9_literal_match", "SELECT id FROM tool_calls WHERE contains(lower(input_json), '{\"k\": 1') OR contains(lower(input_json), '{\\\"k\\\": 1')", ("tool_calls",))
def p9(t):
    return t.tool_calls.where(p.literal_in("input_json", '{"K": 1')).select("id")


@query("P10_metadata", f"SELECT {', '.join(s.METADATA)} FROM sessions", ("sessions",))
def p10(t):
    return t.sessions.select(*s.METADATA)


@query("P11_cwd_roots", "SELECT session_id, cwd AS root FROM messages WHERE cwd IS NOT NULL AND cwd <> '' UNION SELECT id, project_path FROM sessions WHERE project_path IS NOT NULL AND project_path <> ''", ("messages", "sessions"))
def p11(t):
    return s.cwd_roots(t.messages, t.sessions)


@query("P12_content_types", f"SELECT uuid FROM messages WHERE content_type IN ('thinking', 'tool_use') AND {_M} AND coalesce(is_meta, 0) = 0", ("messages",))
def p12(t):
    return t.messages.where(F.col("content_type").isin("thinking", "tool_use") & p.is_visible() & p.not_meta()).select("uuid")


@query("P15_noise_sessions", f"SELECT id, (title IS NULL OR title = '' OR coalesce(regexp_matches({_LABEL}, '(?i)^(od-conn-test|[0-9a-f]{{6,}})'), false)) AS noise FROM sessions", ("sessions",))
def p15(t):
    return t.sessions.select("id", p.is_noise().alias("noise"))


@query("F15_visibility", "SELECT coalesce(CASE WHEN visibility IS NULL THEN 'visible' WHEN visibility IN ('visible', 'inactive', 'hidden') THEN visibility ELSE 'hidden' END) AS shown, count(*)::BIGINT AS n FROM messages GROUP BY 1", ("messages",))
def f15(t):
    return t.messages.groupBy(p.shown_visibility().alias("shown")).agg(F.count("*").alias("n"))


_META = ", ".join(s.METADATA)


@query("O3_catalogue_page", f"SELECT {_META} FROM sessions WHERE coalesce(source, 'claude') = 'claude' AND title <> '' ORDER BY coalesce(ended_at, started_at) DESC NULLS LAST, id DESC LIMIT 10 OFFSET 3", ("sessions",))
def o3(t):
    return s.catalogue(t.sessions, titled=True, limit=10, offset=3)[0]


@query("O3_catalogue_total", "SELECT count(*)::BIGINT AS total FROM sessions WHERE coalesce(source, 'claude') = 'claude' AND title <> ''", ("sessions",))
def o3t(t):
    return s.catalogue(t.sessions, titled=True, limit=10, offset=3)[1]


_ACTIVE = "FROM (SELECT *, EXISTS (SELECT 1 FROM sessions e WHERE e.project = o.project AND e.started_at < o.started_at) AS has_earlier FROM sessions o) WHERE started_at < '2024-01-04' AND coalesce(ended_at, started_at) >= '2024-01-01T04:00:00.000Z'"


@query("O4_J10_W8_activity_page", f"SELECT {_META}, has_earlier, CASE WHEN started_at >= '2024-01-01T04:00:00.000Z' THEN CASE WHEN has_earlier THEN 'new-session' ELSE 'new-workspace' END ELSE 'continued' END AS kind {_ACTIVE} ORDER BY started_at DESC, id LIMIT 200", ("sessions",))
def o4(t):
    return s.activity(t.sessions, "2024-01-01T04:00:00.000Z", "2024-01-04", source="all")[0]


@query("O6_O7_thread", f"SELECT uuid, timestamp, role FROM messages WHERE session_id = 'conv:3' AND {_M} AND coalesce(is_meta, 0) = 0 ORDER BY timestamp NULLS FIRST, uuid", ("messages",))
def o6(t):
    from tracelake.operators import messages as m

    return m.thread(t.messages, "conv:3").select("uuid", "timestamp", "role")


@query("O9_recent_sessions", f"SELECT {_META} FROM sessions WHERE coalesce(source, 'claude') = 'claude' ORDER BY coalesce(ended_at, started_at) DESC NULLS LAST, id LIMIT 200", ("sessions",))
def o9(t):
    return t.sessions.where(p.app_source_is(None)).select(*s.METADATA).orderBy(F.desc_nulls_last(F.coalesce("ended_at", "started_at")), "id").limit(200)


@query("O11_memory_list", "SELECT id, created_at FROM memories WHERE project = 'proj-2' AND deleted_at IS NULL AND contains(lower(concat(path, ' ', summary)), 'the') ORDER BY created_at DESC", ("memories",))
def o11(t):
    from tracelake.operators import memories as m

    return m.listed(t.memories, project="proj-2", text="The").select("id", "created_at")


@query("A4_projects", "SELECT project, count(*)::BIGINT AS session_count, max(coalesce(ended_at, started_at)) AS last_active, arg_max(project_path, concat(coalesce(ended_at, started_at), id)) AS project_path FROM sessions WHERE coalesce(source, 'claude') = 'claude' AND project IS NOT NULL GROUP BY project", ("sessions",))
def a4(t):
    return s.project_rollup(t.sessions)


@query("A5_stats", "SELECT (SELECT count(*) FROM sessions WHERE coalesce(source, 'claude') = 'claude')::BIGINT AS sessions, count(*) FILTER (deleted_at IS NULL)::BIGINT AS memories, count(*) FILTER (deleted_at IS NOT NULL)::BIGINT AS archived FROM memories", ("sessions", "memories"))
def a5(t):
    return s.stats(t.sessions, t.memories)


@query("A11_failures_by_tool", "SELECT c.name AS name, count(*)::BIGINT AS failures, max(m.timestamp) AS last_at FROM tool_results r LEFT JOIN tool_calls c ON c.id = r.tool_use_id LEFT JOIN messages m ON m.uuid = r.message_uuid WHERE coalesce(r.is_error = 1, false) OR r.content ILIKE 'Exit code %' GROUP BY 1", ("tool_results", "tool_calls", "messages"))
def a11(t):
    from tracelake.operators import tools

    return tools.failure_counts(t.tool_results, t.tool_calls, t.messages, by="name")


@query("A14_project_path", """, c AS (SELECT session_id, cwd, count(*) AS n, min(timestamp) AS seen, min(ingest_seq) AS seq FROM messages WHERE starts_with(cwd, '/') GROUP BY 1, 2)
    SELECT session_id, cwd AS project_path FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY n DESC, seen NULLS LAST, seq) AS k FROM c) WHERE k = 1""", ("messages",))
def a14(t):
    from tracelake.operators import finalize

    return finalize.observed_paths(t.messages)


@query("A20_event_summary", "SELECT user_id, count(*)::BIGINT AS steps, count(*) FILTER (event_type = 'view')::BIGINT AS requests, (count(props) - count(DISTINCT props))::BIGINT AS repeated, round(sum(value), 4) AS total FROM events GROUP BY user_id")
def a20(t):
    from tracelake.operators import tools

    return tools.event_summary(t.raw("events"))


@query("A22_workflow_phases", "SELECT run_id, CASE WHEN phase IS NULL OR phase = '' THEN 'Other' ELSE phase END AS phase, count(*)::BIGINT AS agents, string_agg(agent_id, ',' ORDER BY ingest_seq) AS agent_ids FROM workflow_agents GROUP BY 1, 2", ("workflow_agents",))
def a22(t):
    from tracelake.operators import agents

    return agents.by_phase(t.workflow_agents)


@query("A23_sidebar", """, m AS (SELECT project, count(*) FILTER (deleted_at IS NULL) AS a, count(*) FILTER (deleted_at IS NOT NULL) AS d FROM memories GROUP BY 1), s AS (SELECT project, count(*) AS n FROM sessions GROUP BY 1)
    SELECT project, coalesce(n, 0)::BIGINT AS sessions, coalesce(a, 0)::BIGINT AS active, coalesce(d, 0)::BIGINT AS archived FROM (SELECT project FROM m UNION SELECT project FROM s) LEFT JOIN s USING (project) LEFT JOIN m USING (project) WHERE project IS NOT NULL""", ("memories", "sessions"))
def a23(t):
    return s.sidebar(t.sessions.select("project").distinct(), t.memories, t.sessions)


@query("A24_mixed_sources", "SELECT count(DISTINCT coalesce(source, 'claude'))::BIGINT AS sources, count(DISTINCT coalesce(source, 'claude')) > 1 AS mixed FROM sessions", ("sessions",))
def a24(t):
    return s.mixed_sources(t.sessions)


@query("U1_projects_union", "SELECT project FROM sessions WHERE project IS NOT NULL UNION SELECT project FROM memories WHERE deleted_at IS NULL AND project IS NOT NULL", ("sessions", "memories"))
def u1(t):
    return t.sessions.select("project").union(t.memories.where("deleted_at is null").select("project")).where("project is not null").distinct()


@query("U2_usage_union", f", {_USAGE} SELECT timestamp, tokens FROM usage", _U)
def u2(t):
    return u.usage_rows(t.messages, t.summaries)


@query("S19_table_scans", "SELECT 'messages' AS name, count(*)::BIGINT AS n FROM messages UNION ALL SELECT 'sessions', count(*) FROM sessions UNION ALL SELECT 'tool_calls', count(*) FROM tool_calls UNION ALL SELECT 'tool_results', count(*) FROM tool_results UNION ALL SELECT 'memories', count(*) FROM memories UNION ALL SELECT 'summaries', count(*) FROM summaries UNION ALL SELECT 'workflows', count(*) FROM workflows UNION ALL SELECT 'workflow_agents', count(*) FROM workflow_agents UNION ALL SELECT 'subagents', count(*) FROM subagents",
       ("messages", "sessions", "tool_calls", "tool_results", "memories", "summaries", "workflows", "workflow_agents", "subagents"))
def s19(t):
    out = None
    for name in ("messages", "sessions", "tool_calls", "tool_results", "memories", "summaries", "workflows", "workflow_agents", "subagents"):
        one = getattr(t, name).agg(F.lit(name).alias("name"), F.count("*").alias("n"))
        out = one if out is None else out.unionByName(one)
    return out
