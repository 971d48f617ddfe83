"""Tool calls and results: failures with what came next, file histories, counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelake.functions import predicates as p


def _message(messages: DataFrame, prefix: str) -> DataFrame:
    return messages.select(F.col("uuid").alias(f"{prefix}_uuid"), F.col("timestamp").alias(f"{prefix}_at"), F.col("visibility").alias(f"{prefix}_visibility"))


def failures(results: DataFrame, calls: DataFrame, messages: DataFrame, sessions: DataFrame, limit: int | None = None, include_inactive: bool = False, **scope) -> DataFrame:
    """Failed results, newest first, with their call and session ids; orphans stay, and count as visible."""
    found = results.where(p.is_failure())
    columns = {"session_id": "session_id", "timestamp": "result_at"}
    if any(scope.get(k) for k in ("project", "branch", "source")):
        found = found.join(sessions.select(F.col("id").alias("session_id"), "project", "git_branch", F.col("source").alias("session_source")), "session_id", "left")
        columns |= {"project": "project", "branch": "git_branch", "source": "session_source"}
    found = found.join(_message(messages, "result"), F.col("message_uuid") == F.col("result_uuid"), "left")
    own = calls.select(F.col("id").alias("tool_use_id"), F.col("name").alias("call_name"), F.col("message_uuid").alias("call_message"))
    found = found.join(own, "tool_use_id", "left").join(_message(messages, "call"), F.col("call_message") == F.col("call_uuid"), "left")
    found = found.where(p.is_visible("result_visibility", include_inactive) & p.is_visible("call_visibility", include_inactive))
    for c in p.scope(columns, **scope):
        found = found.where(c)
    found = found.withColumn("visibility", p.either_inactive(F.col("result_visibility"), F.col("call_visibility")))
    found = found.select("tool_use_id", "session_id", "message_uuid", "content", "is_error", "call_name", "result_at", "visibility")
    return found.orderBy(F.desc_nulls_last("result_at"), "tool_use_id").limit(p.limit_of(limit, 50))


def next_messages(failed: DataFrame, messages: DataFrame, count: int = 3, include_inactive: bool = False) -> DataFrame:
    """(tool_use_id, k, uuid): the first `count` visible messages of the session after each failure's own."""
    later = messages.where(p.is_visible(include_inactive=include_inactive)).select("session_id", "uuid", "timestamp")
    rows = failed.where("result_at is not null").select("tool_use_id", "session_id", "result_at").join(later, "session_id").where("timestamp > result_at")
    k = F.row_number().over(Window.partitionBy("tool_use_id").orderBy("timestamp", "uuid"))
    return rows.withColumn("k", k).where(F.col("k") <= count).select("tool_use_id", "k", "uuid")


def file_history(calls: DataFrame, messages: DataFrame, sessions: DataFrame, path: str, limit: int | None = None, after: str | None = None, before: str | None = None, source: str | None = None, include_inactive: bool = False) -> DataFrame:
    """The calls that touched a file, oldest first."""
    own = messages.select(F.col("uuid").alias("message_uuid"), "timestamp", "visibility")
    titled = sessions.select(F.col("id").alias("session_id"), "title", "project", F.col("source").alias("session_source"))
    found = calls.where(F.col("file_path") == path).join(titled, "session_id", "left").join(own, "message_uuid", "left")
    found = found.where(p.is_visible(include_inactive=include_inactive))
    for c in p.scope({"timestamp": "timestamp", "source": "session_source"}, after=after, before=before, source=source):
        found = found.where(c)
    found = found.orderBy(F.asc_nulls_first("timestamp"), F.asc_nulls_first("message_uuid"), "ingest_seq").limit(p.limit_of(limit, 200))
    return found.select("id", "message_uuid", "name", "input_json", "session_id", "title", "project", "timestamp", p.shown_visibility().alias("visibility"))


def failure_counts(results: DataFrame, calls: DataFrame, messages: DataFrame, by: str = "name") -> DataFrame:
    """(name or session_id, failures, last_at)."""
    found = results.where(p.is_failure()).join(calls.select(F.col("id").alias("tool_use_id"), "name"), "tool_use_id", "left")
    found = found.join(messages.select(F.col("uuid").alias("message_uuid"), "timestamp"), "message_uuid", "left")
    return found.groupBy(by).agg(F.count("*").alias("failures"), F.max("timestamp").alias("last_at"))


def file_synthesis(calls: DataFrame, messages: DataFrame, path: str) -> DataFrame:
    """Per session: reads and writes of a file, first and last time, and at most two calls as evidence."""
    own = messages.select(F.col("uuid").alias("message_uuid"), "timestamp")
    rows = calls.where(F.col("file_path") == path).join(own, "message_uuid", "left")
    k = F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc_nulls_last("timestamp"), "id"))
    writes = F.col("name").isin("Edit", "Write", "NotebookEdit")
    rows = rows.withColumn("k", k)
    evidence = F.array_sort(F.collect_list(F.when(F.col("k") <= 2, F.struct("k", "id"))))
    return rows.groupBy("session_id").agg(F.count_if(writes).alias("writes"), F.count_if(~writes).alias("reads"), F.min("timestamp").alias("first_at"), F.max("timestamp").alias("last_at"), F.transform(evidence, lambda x: x["id"]).alias("evidence"))


def event_summary(events: DataFrame) -> DataFrame:
    """Per user: steps, requests, repeated commands, total value."""
    return events.groupBy("user_id").agg(F.count("*").alias("steps"), F.count_if(F.col("event_type") == "view").alias("requests"), (F.count("props") - F.countDistinct("props")).alias("repeated"), F.round(F.sum("value"), 4).alias("total"))


def neighbours_in_time(hits: DataFrame, messages: DataFrame, count: int = 6, **filters) -> DataFrame:
    """(hit, k, uuid): the messages of the hit's session that are nearest in time; a missing distance is nearest, ties by insertion."""
    from tracelake.operators.messages import qualifies

    h = hits.select(F.col("uuid").alias("hit"), "session_id", F.col("timestamp").alias("hit_at"))
    rows = messages.where(qualifies(**filters)).select("session_id", "uuid", "timestamp", "ingest_seq").join(h, "session_id").where("uuid <> hit")
    apart = F.abs(F.unix_micros(F.try_to_timestamp("timestamp")) - F.unix_micros(F.try_to_timestamp("hit_at")))
    k = F.row_number().over(Window.partitionBy("hit").orderBy(F.asc_nulls_first(apart), "ingest_seq"))
    near = rows.withColumn("near", k).where(F.col("near") <= count)
    # shown in the order of time, missing times first
    shown = F.row_number().over(Window.partitionBy("hit").orderBy(F.asc_nulls_first("timestamp"), "ingest_seq"))
    return near.withColumn("k", shown).select("hit", "k", "uuid", "timestamp")


def heal_workflow_parents(workflows: DataFrame, results: DataFrame, calls: DataFrame, name: str = "Workflow") -> DataFrame:
    """workflows whose missing parent call is the first call of that name in the session whose result tells the run id."""
    own = results.join(calls.where(F.col("name") == name).select(F.col("id").alias("tool_use_id")), "tool_use_id").select("session_id", "tool_use_id", "content", F.col("ingest_seq").alias("seq"))
    open_runs = workflows.where("parent_tool_use_id is null").select("run_id", "session_id")
    found = open_runs.join(own, "session_id").where(F.contains(F.col("content"), F.col("run_id"))).groupBy("run_id").agg(F.min_by("tool_use_id", F.struct("seq", "tool_use_id")).alias("healed"))
    return workflows.join(found, "run_id", "left").withColumn("parent_tool_use_id", F.coalesce("parent_tool_use_id", "healed")).select(*workflows.columns)
