"""Registered queries: merges, retractions, diffs, finalize passes, scalar functions, SQL guard."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracelake.functions import scalars
from tracelake.operators import finalize, guard, memories, merge
from tracelake.plans.registry import query

_NEW = "CASE WHEN length(text) % 2 = 0 THEN text ELSE concat('edited ', text) END"


def _edited(t):
    """Every message again, about half of them with another text, as a stream."""
    text = F.when(F.length("text") % 2 == 0, F.col("text")).otherwise(F.concat(F.lit("edited "), "text"))
    return t.messages.withColumn("text", text).withColumn("turn_duration_ms", F.lit(None).cast("long")).withColumn("seq", F.col("ingest_seq")).drop("ingest_seq")


@query("M1_upsert_messages", f"SELECT uuid, {_NEW} AS text, turn_duration_ms, ingest_seq FROM messages", ("messages",))
def m1(t):
    return merge.upsert(t.messages, _edited(t), "messages", 1 << 40).select("uuid", "text", "turn_duration_ms", "ingest_seq")


@query("M2_replay_filter", "SELECT uuid FROM messages WHERE length(text) % 2 = 1", ("messages",))
def m2(t):
    return merge.changed(t.messages, _edited(t), "messages").select("uuid")


@query("M3_replace_summaries", "SELECT id, concat('new ', content) AS content, ingest_seq + 1000000 AS ingest_seq FROM summaries", ("summaries",))
def m3(t):
    new = t.summaries.withColumn("content", F.concat(F.lit("new "), "content")).withColumn("seq", F.col("ingest_seq")).drop("ingest_seq")
    return merge.replace(t.summaries, new, "summaries", 1_000_000).select("id", "content", "ingest_seq")


@query("M4_fill_subagents", "SELECT agent_id, 'conv:new' AS session_id, coalesce(CASE WHEN duration_ms % 3000 = 0 THEN 7 END, duration_ms)::BIGINT AS duration_ms, description, total_tokens FROM subagents", ("subagents",))
def m4(t):
    new = t.subagents.select("agent_id", F.lit("conv:new").alias("session_id"), F.when(F.col("duration_ms") % 3000 == 0, F.lit(7)).cast("long").alias("duration_ms"), F.lit(None).cast("string").alias("description"), F.col("ingest_seq").alias("seq"))
    return merge.fill(t.subagents, new, "subagents").select("agent_id", "session_id", "duration_ms", "description", "total_tokens")


@query("M5_A12_A13_session_merge", """SELECT id, coalesce(CASE WHEN message_count % 2 = 0 THEN concat('new ', id) END, title) AS title, project_path, least(started_at, '2024-01-02T00:00:00.000Z') AS started_at, greatest(ended_at, '2024-01-02T00:00:00.000Z') AS ended_at,
    (CASE WHEN message_count % 3 = 0 THEN 5 + 2 ELSE message_count + 2 + 1 END)::BIGINT AS message_count, 'codex' AS source FROM sessions""", ("sessions",))
def m5(t):
    title = F.when(F.col("message_count") % 2 == 0, F.concat(F.lit("new "), "id"))
    common = t.sessions.select("id", title.alias("title"), F.lit(None).cast("string").alias("project"), F.lit("/elsewhere").alias("project_path"), F.lit("2024-01-02T00:00:00.000Z").alias("started_at"), F.lit("2024-01-02T00:00:00.000Z").alias("ended_at"), F.lit(None).cast("string").alias("git_branch"), F.lit(None).cast("string").alias("version"), F.lit("/x").alias("jsonl_path"), F.lit("codex").alias("source"), F.lit(None).cast("string").alias("started_by"), (F.col("message_count") % 3 == 0).alias("total"))
    first = common.withColumn("message_count", F.when(F.col("total"), 5).otherwise(2).cast("long")).withColumn("count_mode", F.when(F.col("total"), "total").otherwise("delta")).withColumn("seq", F.lit(1).cast("long"))
    second = common.withColumn("message_count", F.when(F.col("total"), 2).otherwise(1).cast("long")).withColumn("count_mode", F.lit("delta")).withColumn("seq", F.lit(2).cast("long"))
    found = merge.merge_sessions(t.sessions, first.unionByName(second).drop("total"))
    return found.select("id", "title", "project_path", "started_at", "ended_at", "message_count", "source")


@query("M6_turn_durations", "SELECT uuid, CASE WHEN length(text) % 2 = 0 THEN 42 ELSE turn_duration_ms END::BIGINT AS turn_duration_ms FROM messages", ("messages",))
def m6(t):
    updates = t.messages.where(F.length("text") % 2 == 0).select("uuid", F.lit(42).cast("long").alias("turn_duration_ms"), F.lit(2).cast("long").alias("seq"))
    stray = updates.limit(1).withColumn("uuid", F.lit("nowhere"))
    return merge.set_turn_durations(t.messages, updates.unionByName(updates.withColumn("turn_duration_ms", F.lit(1).cast("long")).withColumn("seq", F.lit(1).cast("long"))).unionByName(stray)).select("uuid", "turn_duration_ms")


_GONE = "(SELECT id FROM sessions WHERE project = 'proj-2')"


@query("M7_J8_J9_delete_cascade", f"""SELECT 'messages' AS name, count(*)::BIGINT AS n FROM messages WHERE session_id NOT IN {_GONE} AND coalesce(agent_id, '') NOT IN {_GONE}
    UNION ALL SELECT 'tool_calls', count(*) FROM tool_calls WHERE session_id NOT IN {_GONE} AND coalesce(message_uuid, '') NOT IN (SELECT uuid FROM messages WHERE session_id IN {_GONE} OR agent_id IN {_GONE})
    UNION ALL SELECT 'summaries', count(*) FROM summaries WHERE session_id NOT IN {_GONE} UNION ALL SELECT 'sessions', count(*) FROM sessions WHERE id NOT IN {_GONE}""", ("messages", "sessions", "tool_calls", "summaries"))
def m7(t):
    names = ("messages", "tool_calls", "tool_results", "subagents", "workflow_agents", "workflows", "summaries", "sessions")
    deletes = t.sessions.where("project = 'proj-2'").select(F.col("id").alias("session_id"), F.lit(1).cast("long").alias("seq"))
    found = merge.delete_sessions({n: getattr(t, n) for n in names}, deletes)
    return merge.union_all(found[n].agg(F.lit(n).alias("name"), F.count("*").alias("n")) for n in ("messages", "tool_calls", "summaries", "sessions"))


@query("M8_barriers", "SELECT uuid FROM messages WHERE NOT (session_id IN (SELECT id FROM sessions WHERE project = 'proj-1') AND ingest_seq % 1000 <= 1)", ("messages", "sessions"))
def m8(t):
    deletes = t.sessions.where("project = 'proj-1'").select(F.col("id").alias("session_id"), (F.col("ingest_seq") * 1000 + 1).alias("seq"))
    return merge.after_barriers(t.messages.withColumn("seq", F.col("ingest_seq")), deletes).select("uuid")


def _versions(t):
    old = t.messages.where("ingest_seq % 1000 <> 1").select("uuid", "text", F.col("ingest_seq").alias("position"))
    new = t.messages.where("ingest_seq % 1000 <> 0").select("uuid", F.when(F.col("ingest_seq") % 1000 == 2, F.concat(F.lit("new "), "text")).otherwise(F.col("text")).alias("text"), F.col("ingest_seq").alias("position"))
    return old, new


_OLD = "old AS (SELECT uuid, text, ingest_seq AS position FROM messages WHERE ingest_seq % 1000 <> 1), new AS (SELECT uuid, CASE WHEN ingest_seq % 1000 = 2 THEN concat('new ', text) ELSE text END AS text, ingest_seq AS position FROM messages WHERE ingest_seq % 1000 <> 0)"


@query("M21_F23_snapshot_diff", f", {_OLD} SELECT coalesce(o.uuid, n.uuid) AS uuid, CASE WHEN o.uuid IS NULL THEN 'added' WHEN n.uuid IS NULL THEN 'removed' ELSE 'changed' END AS change, n.position FROM old o FULL JOIN new n ON o.uuid = n.uuid WHERE o.text IS DISTINCT FROM n.text OR o.uuid IS NULL OR n.uuid IS NULL", ("messages",))
def m21(t):
    return merge.diff(*_versions(t), "uuid").select("uuid", "change", "position")


@query("M22_patch_apply", f", {_OLD} SELECT * FROM new", ("messages",))
def m22(t):
    old, new = _versions(t)
    return merge.patched(old, merge.diff(old, new, "uuid"), "uuid")


@query("M15_W3_F11_titles", """, o AS (SELECT session_id, text, agent_id, row_number() OVER (PARTITION BY session_id ORDER BY timestamp NULLS LAST, uuid) AS a, row_number() OVER (PARTITION BY session_id, agent_id IS NULL ORDER BY timestamp NULLS LAST, uuid) AS m
      FROM messages WHERE role = 'user' AND coalesce(visibility, 'visible') = 'visible' AND coalesce(is_meta, 0) = 0 AND trim(text) <> ''),
    l AS (SELECT session_id, CASE WHEN agent_id IS NULL AND m <= 5 THEN m WHEN a <= 5 THEN 5 + a END AS k,
      list_filter(list_transform(regexp_split_to_array(text, '\\r?\\n'), lambda x: trim(x)), lambda x: length(x) >= 3 AND regexp_matches(x, '[\\p{L}\\p{N}]') AND NOT starts_with(x, '<') AND NOT regexp_matches(x, '(?i)^warm ?up$'))[1] AS line FROM o)
    SELECT session_id, CASE WHEN length(t) > 80 THEN rtrim(t[1:79]) || '…' ELSE t END AS title FROM (SELECT session_id, arg_min(line, k) AS t FROM l WHERE line IS NOT NULL AND k IS NOT NULL GROUP BY 1)""", ("messages",))
def m15(t):
    return finalize.opening_titles(t.messages)


@query("M14_project_paths", """, c AS (SELECT session_id, cwd, count(*) AS n, min(timestamp) AS seen, min(ingest_seq) AS seq FROM messages WHERE starts_with(cwd, '/') GROUP BY 1, 2), b AS (SELECT session_id, cwd FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY n DESC, seen NULLS LAST, seq) AS k FROM c) WHERE k = 1)
    SELECT id, coalesce(cwd, project_path) AS project_path FROM sessions LEFT JOIN b ON session_id = id""", ("sessions", "messages"))
def m14(t):
    return finalize.refreshed_paths(t.sessions, t.messages).select("id", "project_path")


@query("A15_M16_orphan_repair", """, l AS (SELECT session_id, count(*) AS n, max(timestamp) AS hi FROM messages GROUP BY 1)
    SELECT id, CASE WHEN coalesce(source, 'claude') = 'claude' THEN coalesce(n, 0) ELSE message_count END::BIGINT AS message_count, CASE WHEN coalesce(source, 'claude') = 'claude' AND ended_at IS NULL THEN hi ELSE ended_at END AS ended_at FROM sessions LEFT JOIN l ON session_id = id""", ("sessions", "messages"))
def a15(t):
    return finalize.repaired_orphans(t.sessions, t.messages, t.sessions.select("id")).select("id", "message_count", "ended_at")


@query("M19_forget", "SELECT id, deleted_reason FROM memories", ("memories",))
def m19(t):
    table, found = memories.forget(t.memories, "mem:3", "again")
    assert found["already_deleted"]
    return table.select("id", "deleted_reason")


@query("F1_truncate", "SELECT doc_id, text[1:100] AS body FROM documents")
def f1(t):
    return t.raw("documents").select("doc_id", scalars.truncated("text", 100).alias("body"))


@query("F7_timestamps", "SELECT event_id, strftime(ts - INTERVAL 2 HOUR, '%Y-%m-%dT%H:%M:%S.%gZ') AS zoned, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS bare, strftime(ts, '%Y-%m-%dT%H:%M:%Sz') AS small, strftime(ts, '%Y-%m-%d %H:%M:%SZ') AS apart, strftime(ts, '%Y-%m-%dT%H:%M:00.500Z') AS brief, NULL::VARCHAR AS empty FROM events")
def f7(t):
    bare = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    return t.raw("events").select("event_id", scalars.canonical_timestamp(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+02:00'")).alias("zoned"), scalars.canonical_timestamp(bare).alias("bare"), scalars.canonical_timestamp(F.concat(bare, F.lit("z"))).alias("small"),
                                   scalars.canonical_timestamp(F.date_format("ts", "yyyy-MM-dd HH:mm:ss'Z'")).alias("apart"), scalars.canonical_timestamp(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:00.5'+0000'")).alias("brief"), scalars.canonical_timestamp(F.lit("")).alias("empty"))


@query("F16_token_folding", "SELECT uuid, CASE WHEN input_tokens IS NOT NULL OR output_tokens IS NOT NULL THEN coalesce(input_tokens, 0) + coalesce(output_tokens, 0) END AS tokens FROM messages", ("messages",))
def f16(t):
    return t.messages.select("uuid", scalars.folded_tokens("input_tokens", "output_tokens").alias("tokens"))


@query("F17_identities", "SELECT conv_id, turn, concat('codex:', conv_id, ':', lpad(cast(turn AS VARCHAR), 6, '0')) AS id FROM conversations")
def f17(t):
    return t.raw("conversations").select("conv_id", "turn", scalars.line_id("codex", F.col("conv_id").cast("string"), "turn").alias("id"))


@query("F20_highlight", "SELECT doc_id, regexp_replace(text[1:200], '(?i)(the)', '<mark>\\1</mark>', 'g') AS shown FROM documents")
def f20(t):
    return t.raw("documents").select("doc_id", scalars.highlighted(F.substring("text", 1, 200), "the").alias("shown"))


@query("F20_highlight_whole", "SELECT doc_id, regexp_replace(text, '(?i)(the)', '<mark>\\1</mark>', 'g') AS shown FROM documents")
def f20_whole(t):
    """Whole texts; F20_highlight has to match SQL over their first 200 characters."""
    return t.raw("documents").select("doc_id", scalars.highlighted("text", "the").alias("shown"))


@query("F22_project_labels", "SELECT id, list_filter(string_split(project_path, '/'), lambda x: x <> '')[-1] AS label FROM sessions", ("sessions",))
def f22(t):
    from tracelake.functions import predicates as p

    return t.sessions.select("id", p.project_label().alias("label"))


@query("A16_F26_store_watermarks", "SELECT session_id, count(*)::BIGINT AS n, max(ingest_seq) AS last, sum(length(text))::BIGINT AS size FROM messages GROUP BY 1", ("messages",))
def a16(t):
    return t.messages.groupBy("session_id").agg(F.count("*").alias("n"), F.max("ingest_seq").alias("last"), F.sum(F.length("text")).alias("size"))


@query("P16_P17_sql_guard", "SELECT project, count(*)::BIGINT AS n FROM sessions WHERE message_count > 2 GROUP BY project", ("sessions",))
def p16(t):
    return guard.read_only(t, "SELECT project, count(*) AS n FROM sessions WHERE message_count > ? GROUP BY project", [2])


@query("U6_sql_set_operations", "SELECT project FROM memories WHERE deleted_at IS NULL EXCEPT SELECT project FROM sessions", ("sessions", "memories"))
def u6(t):
    return guard.read_only(t, "SELECT project FROM memories WHERE deleted_at IS NULL EXCEPT SELECT project FROM sessions")


@query("SQL_grouping_sets", "SELECT project, git_branch, count(*)::BIGINT AS n FROM sessions GROUP BY GROUPING SETS ((project, git_branch), (project), ())", ("sessions",))
def grouping(t):
    return guard.read_only(t, "SELECT project, git_branch, count(*) AS n FROM sessions GROUP BY GROUPING SETS ((project, git_branch), (project), ())")
