"""Subagents and workflows with what their messages tell."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.functions import predicates as p

_FIRST, _LAST = "first_message_at", "last_message_at"


def activity(messages: DataFrame) -> DataFrame:
    """(agent_id, message_count, derived tokens, first and last time). Tokens are null without usage rows; 0 stays 0."""
    used = F.col("input_tokens").isNotNull() | F.col("output_tokens").isNotNull()
    tokens = F.when(used, F.coalesce("input_tokens", F.lit(0)) + F.coalesce("output_tokens", F.lit(0)))
    return messages.where("agent_id is not null").groupBy("agent_id").agg(F.count("*").alias("message_count"), F.sum(tokens).alias("derived"), F.min("timestamp").alias(_FIRST), F.max("timestamp").alias(_LAST))


def with_derived(subagents: DataFrame, messages: DataFrame) -> DataFrame:
    """subagents with message_count and total_tokens, where a stored total wins."""
    found = subagents.join(activity(messages), "agent_id", "left")
    return found.withColumn("message_count", F.coalesce("message_count", F.lit(0))).withColumn("total_tokens", F.coalesce("total_tokens", "derived")).drop("derived")


def subagents(table: DataFrame, messages: DataFrame, sessions: DataFrame, limit: int | None = None, **scope) -> DataFrame:
    """`after` matches agents whose last message is later, `before` those whose first is earlier."""
    found = with_derived(table, messages)
    columns = {"session_id": "session_id", "after": _LAST, "before": _FIRST}
    if any(scope.get(k) for k in ("project", "branch", "source")):
        found = found.join(sessions.select(F.col("id").alias("session_id"), "project", "git_branch", F.col("source").alias("session_source")), "session_id", "left")
        columns |= {"project": "project", "branch": "git_branch", "source": "session_source"}
    for c in p.scope(columns, **scope):
        found = found.where(c)
    return found.select(*table.columns, "message_count").orderBy("agent_id").limit(p.limit_of(limit, 100))


def workflows(table: DataFrame, sessions: DataFrame, limit: int | None = None, **scope) -> DataFrame:
    columns = {"session_id": "session_id", "timestamp": "timestamp"}
    found = table
    if any(scope.get(k) for k in ("project", "branch", "source")):
        found = found.join(sessions.select(F.col("id").alias("session_id"), "project", "git_branch", F.col("source").alias("session_source")), "session_id", "left")
        columns |= {"project": "project", "branch": "git_branch", "source": "session_source"}
    for c in p.scope(columns, **scope):
        found = found.where(c)
    return found.select(*table.columns).orderBy(F.desc_nulls_last("timestamp"), "run_id").limit(p.limit_of(limit, 100))


def workflow_tree(workflows: DataFrame, agents: DataFrame, messages: DataFrame) -> DataFrame:
    """workflows with their parsed result and their agents, each with its number of messages."""
    counts = messages.where("agent_id is not null").groupBy("agent_id").agg(F.count("*").alias("message_count"))
    rows = agents.join(counts, "agent_id", "left").withColumn("message_count", F.coalesce("message_count", F.lit(0)))
    inner = F.struct("ingest_seq", *(c for c in rows.columns if c not in ("ingest_seq", "run_id")))
    lists = rows.groupBy("run_id").agg(F.array_sort(F.collect_list(inner)).alias("agents"))
    return workflows.join(lists, "run_id", "left").withColumn("result", F.try_parse_json("result_json"))


def by_phase(agents: DataFrame) -> DataFrame:
    """(run_id, phase, agents, agent_ids) with 'Other' for agents without a phase."""
    phase = F.when(F.coalesce("phase", F.lit("")) == "", "Other").otherwise(F.col("phase")).alias("phase")
    ids = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ingest_seq", "agent_id"))), lambda x: x["agent_id"]), ",")
    return agents.groupBy("run_id", phase).agg(F.count("*").alias("agents"), ids.alias("agent_ids"))
