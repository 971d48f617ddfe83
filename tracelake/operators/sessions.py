"""Session lists: scopes, fragments, catalogue and activity pages, project rollups."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelake.functions import predicates as p

METADATA = ("id", "title", "project", "project_path", "started_at", "ended_at", "git_branch", "message_count", "jsonl_path", "source", "started_by")
_SCOPE = {"session_id": "id", "project": "project", "timestamp": "ended_at", "branch": "git_branch", "source": "source"}


def ordered(df: DataFrame, *order, limit: int | None) -> DataFrame:
    df = df.orderBy(*order)
    return df if limit is None else df.limit(limit)


def resolved(sessions: DataFrame, refs: Iterable[str], scoped: DataFrame, newest: int = 10) -> DataFrame:
    """Sessions that the references name: an exact id anywhere, else the newest whose id holds the fragment, within the scope."""
    spark = sessions.sparkSession
    refs = spark.createDataFrame([(r,) for r in dict.fromkeys(refs) if r], "ref string")
    exact = sessions.join(F.broadcast(refs), sessions["id"] == refs["ref"]).select(sessions["id"], "ref")
    open_refs = refs.join(exact, "ref", "left_anti")
    held = scoped.select("id", "ended_at").join(F.broadcast(open_refs), F.contains(F.col("id"), F.col("ref")))
    rank = F.row_number().over(Window.partitionBy("ref").orderBy(F.desc_nulls_last("ended_at"), "id"))
    held = held.withColumn("rank", rank).where(F.col("rank") <= newest).select("id")
    ids = exact.select("id").union(held).distinct()
    return sessions.join(ids, "id", "left_semi")


def sessions(table: DataFrame, refs: Iterable[str] = (), limit: int | None = None, **scope) -> DataFrame:
    """Newest sessions first."""
    n = p.limit_of(limit, 50)
    scoped = table.where(F.lit(True))
    for c in p.scope(_SCOPE, **scope):
        scoped = scoped.where(c)
    found = resolved(table, refs, scoped) if list(refs) else scoped
    return ordered(found, F.desc_nulls_last("ended_at"), "id", limit=n)


def catalogue(table: DataFrame, query: str | None = None, titled: bool | None = None, project: str | None = None, source: str | None = None, descending: bool = True, limit: int = 50, offset: int = 0) -> tuple[DataFrame, DataFrame]:
    """(page, total): sessions by end (or start), with the number of all that match."""
    found = table.where(p.app_source_is(source))
    if query:
        found = found.where(p.catalogue_contains(query, "title", "project", "git_branch"))
    if titled is not None:
        found = found.where(p.is_titled() if titled else ~p.is_titled())
    if project is not None:
        found = found.where(F.col("project") == project)
    by = F.coalesce("ended_at", "started_at")
    order = (F.desc_nulls_last(by), F.desc("id")) if descending else (F.asc_nulls_first(by), F.asc("id"))
    page = found.select(*METADATA).orderBy(*order).offset(p.limit_of(offset, 0, "offset")).limit(max(1, min(100, limit)))
    return page, found.agg(F.count("*").alias("total"))


def with_has_earlier(table: DataFrame) -> DataFrame:
    """Whether the project has a session that started before: one window, no self-join."""
    first = F.min("started_at").over(Window.partitionBy("project"))
    return table.withColumn("has_earlier", F.coalesce((first < F.col("started_at")) & F.col("project").isNotNull(), F.lit(False)))


def activity(table: DataFrame, low: str, high: str, source: str | None = None, limit: int = 200, offset: int = 0) -> tuple[DataFrame, DataFrame]:
    """(page, total) of the sessions that overlap [low, high), with has_earlier and their kind."""
    marked = with_has_earlier(table).where(p.app_source_is(source)).where(p.overlaps("started_at", "ended_at", low, high))
    kind = F.when((F.col("started_at") >= low) & (F.col("started_at") < high), F.when(F.col("has_earlier"), "new-session").otherwise("new-workspace")).otherwise("continued")
    marked = marked.withColumn("kind", kind)
    page = marked.orderBy(F.desc_nulls_last("started_at"), "id").offset(p.limit_of(offset, 0, "offset")).limit(min(200, p.limit_of(limit, 200)))
    return page.select(*METADATA, "has_earlier", "kind"), marked.agg(F.count("*").alias("total"))


def project_rollup(table: DataFrame, source: str | None = None) -> DataFrame:
    """(project, session_count, last_active, project_path) with the path of the latest session."""
    active = F.coalesce("ended_at", "started_at")
    found = table.where(p.app_source_is(source)).where("project is not null")
    rolled = found.groupBy("project").agg(F.count("*").alias("session_count"), F.max(active).alias("last_active"), F.max_by("project_path", F.struct(active, "id")).alias("project_path"))
    return rolled.orderBy(F.desc_nulls_last("last_active"), "project")


def stats(table: DataFrame, memories: DataFrame, source: str | None = None) -> DataFrame:
    """One row: sessions, active memories, archived memories."""
    s = table.agg(F.count_if(p.app_source_is(source)).alias("sessions"))
    m = memories.agg(F.count_if(F.col("deleted_at").isNull()).alias("memories"), F.count_if(F.col("deleted_at").isNotNull()).alias("archived"))
    return s.join(m)  # one row each


def cwd_roots(messages: DataFrame, sessions: DataFrame) -> DataFrame:
    """(session_id, root): the distinct working folders of each session, and its project path."""
    own = messages.where("cwd is not null and cwd <> ''").select("session_id", F.col("cwd").alias("root"))
    paths = sessions.where("project_path is not null and project_path <> ''").select(F.col("id").alias("session_id"), F.col("project_path").alias("root"))
    return own.union(paths).distinct()


def sidebar(projects: DataFrame, memories: DataFrame, sessions: DataFrame) -> DataFrame:
    """(project, sessions, active, archived): counts of each project that any table names."""
    m = memories.groupBy("project").agg(F.count_if(F.col("deleted_at").isNull()).alias("active"), F.count_if(F.col("deleted_at").isNotNull()).alias("archived"))
    s = sessions.groupBy("project").agg(F.count("*").alias("sessions"))
    names = projects.select("project").union(m.select("project")).union(s.select("project")).where("project is not null").distinct()
    out = names.join(s, "project", "left").join(m, "project", "left")
    return out.select("project", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("sessions", "active", "archived")))


def mixed_sources(table: DataFrame) -> DataFrame:
    """One row: the number of sources and whether there are several."""
    return table.agg(F.countDistinct(p.source_of("source")).alias("sources")).withColumn("mixed", F.col("sources") > 1)
