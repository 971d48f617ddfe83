"""Registered queries: smaller operators that the other modules leave."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tracelake.functions import predicates as p
from tracelake.functions import scalars
from tracelake.operators import finalize, memories, merge
from tracelake.plans import schema
from tracelake.plans.registry import query
from tracelake.sources import raw


@query("S14_S18_raw_lines", "SELECT concat('c', conv_id) AS session_id, concat(conv_id, '-', turn) AS uuid, (row_number() OVER (PARTITION BY conv_id ORDER BY turn))::INTEGER AS number FROM conversations")
def s18(t):
    """Every message's raw line, found again by its uuid."""
    line = F.to_json(F.struct(F.concat_ws("-", F.col("conv_id").cast("string"), "turn").alias("uuid"), "text"))
    rows = t.raw("conversations").select(F.concat(F.lit("c"), "conv_id").alias("path"), F.struct("turn", line.alias("line")).alias("l"))
    files = rows.groupBy("path").agg(F.array_join(F.array_sort(F.collect_list("l"))["line"], "\n").cast("binary").alias("content"))
    lines = raw.raw_lines(files)
    wanted = t.raw("conversations").select(F.concat_ws("-", F.col("conv_id").cast("string"), "turn").alias("uuid"))
    return raw.raw_windows(lines, wanted).select(F.col("path").alias("session_id"), "uuid", "number")


@query("K3_retained_snapshot", "SELECT uuid, session_id FROM messages WHERE session_id IN (SELECT id FROM sessions WHERE project = 'proj-3') UNION ALL SELECT concat('new:', uuid), session_id FROM messages WHERE session_id IN (SELECT id FROM sessions WHERE project = 'proj-4')", ("messages", "sessions"))
def k3(t):
    fresh = t.messages.join(t.sessions.where("project = 'proj-4'").select(F.col("id").alias("session_id")), "session_id", "left_semi").withColumn("uuid", F.concat(F.lit("new:"), "uuid"))
    return merge.retained(t.messages.drop("skill"), t.sessions.where("project = 'proj-3'").select("id"), fresh, "messages").select("uuid", "session_id")


@query("K4_additive_migration", "SELECT uuid, 0 AS is_meta, 'visible' AS visibility, 'claude' AS source FROM messages", ("messages",))
def k4(t):
    old = t.messages.drop("is_meta", "visibility", "source")
    assert schema.missing(old, "messages") == ["is_meta", "visibility", "source"]
    return schema.migrated(old, "messages").select("uuid", "is_meta", "visibility", "source")


@query("P13_pair_visibility", "SELECT c.id, CASE WHEN coalesce(m.visibility, 'visible') = 'inactive' OR coalesce(r.visibility, 'visible') = 'inactive' THEN 'inactive' ELSE 'visible' END AS shown FROM tool_calls c LEFT JOIN messages m ON m.uuid = c.message_uuid LEFT JOIN tool_results x ON x.tool_use_id = c.id LEFT JOIN messages r ON r.uuid = x.message_uuid", ("tool_calls", "tool_results", "messages"))
def p13(t):
    seen = t.messages.select("uuid", "visibility")
    a, b = (seen.select(F.col("uuid").alias(f"u{s}"), F.col("visibility").alias(f"v{s}")) for s in "ab")
    results = t.tool_results.select(F.col("tool_use_id").alias("id"), F.col("message_uuid").alias("result_uuid"))
    found = t.tool_calls.join(a, F.col("message_uuid") == F.col("ua"), "left").join(results, "id", "left").join(b, F.col("result_uuid") == F.col("ub"), "left")
    return found.select("id", p.either_inactive(F.col("va"), F.col("vb")).alias("shown"))


@query("P14_source_gates", "SELECT coalesce(source, 'claude') AS source, count(*) > 0 AS known, max(coalesce(ended_at, started_at)) > '2024-01-03' AS recent FROM sessions GROUP BY 1", ("sessions",))
def p14(t):
    return t.sessions.groupBy(p.source_of("source").alias("source")).agg((F.count("*") > 0).alias("known"), (F.max(F.coalesce("ended_at", "started_at")) > "2024-01-03").alias("recent"))


@query("J17_call_assembly", "SELECT c.id, r.content, a.agent_id FROM tool_calls c LEFT JOIN (SELECT tool_use_id, arg_max(content, ingest_seq) AS content FROM tool_results GROUP BY 1) r ON r.tool_use_id = c.id LEFT JOIN (SELECT parent_tool_use_id, max(agent_id) AS agent_id FROM subagents WHERE parent_tool_use_id IS NOT NULL GROUP BY 1) a ON a.parent_tool_use_id = c.id", ("tool_calls", "tool_results", "subagents"))
def j17(t):
    results = t.tool_results.groupBy(F.col("tool_use_id").alias("id")).agg(F.max_by("content", "ingest_seq").alias("content"))
    agents = t.subagents.where("parent_tool_use_id is not null").groupBy(F.col("parent_tool_use_id").alias("id")).agg(F.max("agent_id").alias("agent_id"))
    return t.tool_calls.select("id").join(results, "id", "left").join(agents, "id", "left")


@query("J18_json_lateral", "SELECT event_id, 'k' AS key, cast(json_extract(props, '$.k') AS BIGINT) AS value FROM events WHERE json_extract(props, '$.k') IS NOT NULL")
def j18(t):
    """Object entries of a JSON text as rows; texts that aren't objects give none."""
    entries = F.explode(F.map_entries(F.from_json("props", "map<string, bigint>")))
    return t.raw("events").select("event_id", entries.alias("e")).select("event_id", "e.key", "e.value")


@query("A18_recent_invokers", "SELECT DISTINCT c.session_id FROM tool_calls c JOIN messages m ON m.uuid = c.message_uuid WHERE c.name = 'purchase' AND m.timestamp > '2024-01-01T12:00:00.000Z'", ("tool_calls", "messages"))
def a18(t):
    own = t.messages.where("timestamp > '2024-01-01T12:00:00.000Z'").select(F.col("uuid").alias("message_uuid"))
    return t.tool_calls.where("name = 'purchase'").join(own, "message_uuid", "left_semi").select("session_id").distinct()


@query("A25_family_counts", "SELECT session_id, count(DISTINCT uuid)::BIGINT AS n, min(timestamp) AS low, max(timestamp) AS high FROM messages GROUP BY 1", ("messages",))
def a25(t):
    return t.messages.groupBy("session_id").agg(F.countDistinct("uuid").alias("n"), F.min("timestamp").alias("low"), F.max("timestamp").alias("high"))


@query("O8_nulls_last_page", "SELECT uuid, timestamp FROM messages ORDER BY timestamp IS NULL, timestamp, uuid LIMIT 400 OFFSET 30", ("messages",))
def o8(t):
    return t.messages.orderBy(F.asc_nulls_last("timestamp"), "uuid").select("uuid", "timestamp").offset(30).limit(400)


@query("O10_recent_hints", "SELECT jsonl_path, max(coalesce(ended_at, started_at)) AS at_ FROM sessions WHERE jsonl_path NOT LIKE '%marker%' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 64", ("sessions",))
def o10(t):
    found = t.sessions.where(~F.contains("jsonl_path", F.lit("marker"))).groupBy("jsonl_path").agg(F.max(F.coalesce("ended_at", "started_at")).alias("at_"))
    return found.orderBy(F.desc("at_"), "jsonl_path").limit(64)


_EVIDENCE = "e AS (SELECT session_id, uuid AS key, timestamp FROM messages WHERE content_type = 'thinking' UNION ALL SELECT session_id, message_uuid, NULL FROM tool_calls UNION ALL SELECT session_id, uuid, timestamp FROM messages WHERE role = 'assistant')"


@query("O12_U3_U7_evidence_merge", f", {_EVIDENCE}, d AS (SELECT *, row_number() OVER (PARTITION BY session_id, key ORDER BY timestamp DESC NULLS LAST) AS k FROM e), r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY timestamp DESC NULLS LAST, key) AS n FROM d WHERE k = 1) SELECT session_id, key, timestamp FROM r WHERE n <= 16", ("messages", "tool_calls"))
def o12(t):
    """Evidence of several kinds per session: the newest of each key, 16 at most."""
    parts = [t.messages.where("content_type = 'thinking'"), t.messages.where("role = 'assistant'")]
    rows = merge.union_all([*(d.select("session_id", F.col("uuid").alias("key"), "timestamp") for d in parts), t.tool_calls.select("session_id", F.col("message_uuid").alias("key"), F.lit(None).cast("string").alias("timestamp"))])
    newest = rows.groupBy("session_id", "key").agg(F.max("timestamp").alias("timestamp"))
    k = F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc_nulls_last("timestamp"), "key"))
    return newest.withColumn("k", k).where("k <= 16").drop("k")


@query("U5_values_join", "SELECT id, label FROM sessions JOIN (VALUES ('proj-1', 'one'), ('proj-2', 'two')) v(project, label) USING (project)", ("sessions",))
def u5(t):
    refs = t.spark.createDataFrame([("proj-1", "one"), ("proj-2", "two")], "project string, label string")
    return t.sessions.join(refs, "project").select("id", "label")


@query("F3_F4_F5_F6_blocks", """SELECT concat(conv_id, ':', turn) AS id, CASE WHEN text <> '' THEN concat(text, chr(10), 'hm') ELSE 'hm' END AS text, 'unknown' AS kind, CASE WHEN role = 'system' THEN 'other' END AS harness, CASE WHEN turn % 2 = 0 THEN '/f' END AS file FROM conversations""")
def f3(t):
    blocks = F.array(F.struct(F.lit("text").alias("type"), F.col("text"), F.lit(None).cast("string").alias("thinking")), F.struct(F.lit("thinking").alias("type"), F.lit(None).cast("string").alias("text"), F.lit("hm").alias("thinking")))
    rows = t.raw("conversations").withColumn("b", blocks).withColumn("m", (F.col("role") == "system").cast("int"))
    return rows.select(
        F.concat_ws(":", F.col("conv_id").cast("string"), "turn").alias("id"), scalars.text_of_blocks("b").alias("text"), scalars.content_type_of_blocks("b").alias("kind"),
        scalars.harness_kind("text", "m").alias("harness"), scalars.file_path_of(F.when(F.col("turn") % 2 == 0, "Read").otherwise("Bash"), F.lit('{"file_path": "/f"}')).alias("file"),
    )


@query("F8_F9_slugs", "SELECT id, '-' || replace(ltrim(project_path, '/'), '/', '-') AS slug, '/' || replace(project, '-', '/') AS path FROM sessions", ("sessions",))
def f8(t):
    return t.sessions.select("id", scalars.slug_from_path("project_path").alias("slug"), finalize.path_from_slug("project").alias("path"))


@query("F10_normalized_cwd", """SELECT conv_id, turn, CASE turn % 6 WHEN 0 THEN concat('/srv/p', conv_id, '/q/') WHEN 1 THEN '/' WHEN 2 THEN concat('/p', conv_id) WHEN 3 THEN NULL WHEN 4 THEN concat('/a b/', role) END AS path,
    CASE turn % 6 WHEN 0 THEN concat('-srv-p', conv_id, '-q-') WHEN 1 THEN '-' WHEN 2 THEN concat('-p', conv_id) WHEN 3 THEN NULL WHEN 4 THEN concat('-a b-', role) END AS slug FROM conversations""")
def f10(t):
    """Dots, doubled slashes, parents beyond the root, relative and missing paths."""
    n, role, turn = F.col("conv_id").cast("string"), F.col("role"), F.col("turn") % 6
    given = F.when(turn == 0, F.concat(F.lit("/srv//"), role, F.lit("/../p"), n, F.lit("/./q/"))).when(turn == 1, F.concat(F.lit("/"), role, F.lit("/../../"))).when(turn == 2, F.concat(F.lit("//../p"), n)).when(turn == 3, F.concat(F.lit("./p"), n)).when(turn == 4, F.concat(F.lit("/a b/x/.././"), role))
    return t.raw("conversations").select("conv_id", "turn", scalars.normalized_cwd(given).alias("path"), scalars.slug_from_path(given).alias("slug"))


@query("F12_safe_query_tokens", "SELECT doc_id, array_to_string(regexp_extract_all(text, '[\\p{L}\\p{N}]+')[1:12], ' ') AS terms FROM documents")
def f12(t):
    found = F.slice(F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), 1, 12)
    return t.raw("documents").select("doc_id", F.array_join(found, " ").alias("terms"))


_N, _MS = "(event_id * 4001)", "(event_id * 7919)"


@query("F21_display", f"""SELECT event_id, CASE WHEN {_N} >= 1000000 THEN concat(format('{{:.1f}}', floor(({_N} + 50000) / 100000) / 10), 'M') WHEN {_N} >= 1000 THEN concat(format('{{:.1f}}', floor(({_N} + 50) / 100) / 10), 'k') ELSE cast({_N} AS VARCHAR) END AS tokens,
    CASE WHEN {_MS} >= 3600000 THEN format('{{:d}}h {{:d}}m', {_MS} // 3600000, ({_MS} // 60000) % 60) WHEN {_MS} >= 60000 THEN format('{{:d}}m {{:d}}s', {_MS} // 60000, ({_MS} // 1000) % 60) ELSE concat(format('{{:.1f}}', floor(({_MS} + 50) / 100) / 10), 's') END AS took FROM events""")
def f21(t):
    """Every event, its number spread over all branches."""
    return t.raw("events").select("event_id", scalars.shown_tokens(F.col("event_id") * 4001).alias("tokens"), scalars.shown_duration(F.col("event_id") * 7919).alias("took"))


@query("M9_cursor_state", "SELECT jsonl_path, cast(ingest_seq AS DOUBLE) AS mtime, message_count AS lines_processed, 0 AS replay_required, concat(ingest_seq, ':', message_count) AS cursor FROM sessions", ("sessions",))
def m9(t):
    rows = t.sessions.select("jsonl_path", F.col("ingest_seq").cast("double").alias("mtime"), F.col("message_count").alias("lines_processed"), F.lit(0).alias("replay_required"), F.concat_ws(":", "ingest_seq", "message_count").alias("cursor"), F.col("ingest_seq").alias("seq"))
    empty = t.spark.createDataFrame([], schema.struct_of("index_state"))
    stale = rows.withColumn("cursor", F.lit("old")).withColumn("seq", F.col("seq") - 1)
    return merge.upsert(merge.upsert(empty, stale, "index_state"), rows, "index_state").drop("ingest_seq")


@query("M20_archive_restore", "SELECT id, CASE WHEN id = 'mem:3' THEN NULL WHEN id = 'mem:4' THEN 'gone' ELSE deleted_reason END AS deleted_reason, CASE WHEN id = 'mem:3' THEN true WHEN id = 'mem:4' THEN false ELSE deleted_at IS NULL END AS live FROM memories", ("memories",))
def m20(t):
    table = memories.restore(memories.archive(t.memories, "mem:4", "gone"), "mem:3")
    return table.select("id", "deleted_reason", F.col("deleted_at").isNull().alias("live"))
