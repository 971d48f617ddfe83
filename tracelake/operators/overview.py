"""The project overview: per-project counts, totals, and the project of a working folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelake.functions import predicates as p


def _active():
    return F.coalesce("ended_at", "started_at")


def projects(sessions: DataFrame, memories: DataFrame, limit: int = 20, branches: int = 5) -> DataFrame:
    """(project, project_path, session_count, memory_count, last_session_at, last_memory_at, recent_branches), latest first."""
    own = sessions.where("project is not null")
    live = memories.where("project is not null and deleted_at is null")
    path = F.max_by("project_path", F.when(F.col("project_path").isNotNull(), F.struct(F.coalesce(_active(), F.lit("")), "id")))
    s = own.groupBy("project").agg(path.alias("project_path"), F.count("*").alias("session_count"), F.max(_active()).alias("last_session_at"))
    m = live.groupBy("project").agg(F.count("*").alias("memory_count"), F.max("created_at").alias("last_memory_at"))
    found = s.join(m, "project", "full")
    last = own.where("git_branch is not null and git_branch <> ''").groupBy("project", "git_branch").agg(F.max(_active()).alias("at"))
    k = F.row_number().over(Window.partitionBy("project").orderBy(F.desc_nulls_last("at"), "git_branch"))
    recent = last.withColumn("k", k).where(F.col("k") <= branches).groupBy("project").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "git_branch"))), lambda x: x["git_branch"]).alias("recent_branches"))
    found = found.join(recent, "project", "left")
    out = found.select("project", "project_path", F.coalesce("session_count", F.lit(0)).alias("session_count"), F.coalesce("memory_count", F.lit(0)).alias("memory_count"), "last_session_at", "last_memory_at", F.coalesce("recent_branches", F.array().cast("array<string>")).alias("recent_branches"))
    return out.orderBy(F.desc_nulls_last(F.coalesce("last_session_at", "last_memory_at")), "project").limit(limit)


def totals(sessions: DataFrame, memories: DataFrame) -> DataFrame:
    """One row: distinct projects, sessions, active memories."""
    live = memories.where("deleted_at is null")
    names = sessions.select("project").union(live.select("project"))
    return names.agg(F.countDistinct("project").alias("projects")).join(sessions.agg(F.count("*").alias("sessions"))).join(live.agg(F.count("*").alias("memories")))


def sources(sessions: DataFrame) -> DataFrame:
    rolled = sessions.groupBy(p.source_of("source").alias("source")).agg(F.count("*").alias("session_count"), F.max(_active()).alias("last_session_at"))
    return rolled.orderBy(F.desc_nulls_last("last_session_at"), "source")


def current_project(sessions: DataFrame, memories: DataFrame, messages: DataFrame, cwd: str | None = None, project: str | None = None) -> dict | None:
    """{project, project_path, from, confidence} of an explicit pattern, else of the folder."""
    if project:
        row = sessions.where(F.col("project").ilike(project)).orderBy(F.desc_nulls_last(_active()), "id").select("project", "project_path").take(1)
        row = row or memories.where(F.col("project").ilike(project)).orderBy(F.desc_nulls_last("created_at"), "id").select("project", F.lit(None).cast("string").alias("project_path")).take(1)
        if row:
            return {**row[0].asDict(), "from": "opts", "confidence": "inferred" if any(c in project for c in "%_") else "exact"}
        return {"project": project, "project_path": None, "from": "opts", "confidence": "unknown"}
    if not cwd:
        return None
    at = F.lit(cwd)
    under = sessions.where("project is not null and project_path <> ''").where((F.col("project_path") == at) | F.startswith(at, F.concat("project_path", F.lit("/"))))
    row = under.groupBy("project", "project_path").agg(F.max(_active()).alias("seen")).orderBy(F.desc(F.length("project_path")), F.desc_nulls_last("seen"), "project").select("project", "project_path").take(1)
    if row:
        return {**row[0].asDict(), "from": "cwd_project_path", "confidence": "exact"}
    seen = messages.where(F.col("cwd") == at).join(sessions.where("project is not null").select(F.col("id").alias("session_id"), "project", "project_path"), "session_id")
    row = seen.groupBy("project", "project_path").agg(F.max("timestamp").alias("seen")).orderBy(F.desc_nulls_last("seen"), "project").select("project", "project_path").take(1)
    return {**row[0].asDict(), "from": "cwd_messages", "confidence": "inferred"} if row else None


def overview(t, cwd: str | None = None, project: str | None = None, limit: int = 8, project_limit: int = 20, memory_limit: int = 100, session_id: str | None = None) -> dict:
    """The whole overview as nested values; every part is one bounded query."""
    current = current_project(t.sessions, t.memories, t.messages, cwd, project)
    detail = None
    if current and current["project"]:
        own = t.sessions.where(F.col("project") == current["project"])
        live = t.memories.where((F.col("project") == current["project"]) & F.col("deleted_at").isNull())
        shown = own.orderBy(F.desc_nulls_last(_active()), "id").limit(limit).withColumn("source", p.source_of("source"))
        kept = live.orderBy(F.desc_nulls_last("created_at"), "id").limit(memory_limit)
        detail = {
            "project": current["project"], "project_path": current["project_path"], "session_total": own.count(), "memory_total": live.count(),
            "sessions": [r.asDict() for r in shown.select("id", "title", "project", "project_path", "started_at", "ended_at", "git_branch", "message_count", "source").collect()],
            "memories": [r.asDict() for r in kept.select("id", "path", "anchors", "summary", "session_id", "project", "created_at").collect()],
        }
    total = totals(t.sessions, t.memories).first().asDict()
    return {
        "current": {"cwd": cwd, "project": current, "session_id": session_id}, "current_project": detail,
        "projects": [r.asDict() for r in projects(t.sessions, t.memories, project_limit).collect()],
        "totals": {**total, "sources": [r.asDict() for r in sources(t.sessions).collect()]},
    }
