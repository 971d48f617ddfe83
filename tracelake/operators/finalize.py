"""Passes after a build: project paths, titles, orphan repair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.functions import predicates as p
from tracelake.functions import scalars

TITLE_CHARS = 80
#: Blocks that a title leaves out.
WRAPPERS = ("system-reminder", "user_info", "command-name", "command-message", "command-args", "local-command-stdout", "local-command-stderr")
#: What may stand before a title, and a line that isn't one.
AGENT_PREFIX = r"^\[[^\]]{1,40}\]\s*"
WARMUP = r"(?i)^warm ?up$"


def observed_paths(messages: DataFrame) -> DataFrame:
    """(session_id, project_path): the most frequent absolute folder; ties go to the one seen first, known times before unknown."""
    seen = messages.withColumn("cwd", scalars.normalized_cwd("cwd")).where("cwd is not null").groupBy("session_id", "cwd").agg(F.count("*").alias("n"), F.min("timestamp").alias("first"), F.min("ingest_seq").alias("seq"))
    k = F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("n"), F.asc_nulls_last("first"), "seq"))
    return seen.withColumn("k", k).where("k = 1").select("session_id", F.col("cwd").alias("project_path"))


def path_from_slug(project) -> Column:
    """-a-b -> /a/b"""
    c = p.as_column(project)
    return F.when(c != "", F.concat(F.lit("/"), F.regexp_replace(F.regexp_replace(c, "^-", ""), "-", "/")))


def refreshed_paths(sessions: DataFrame, messages: DataFrame, only_unresolved: bool = False) -> DataFrame:
    """sessions with their observed path, else the one that the slug tells."""
    found = sessions.join(observed_paths(messages).withColumnRenamed("project_path", "observed"), sessions["id"] == F.col("session_id"), "left").drop("session_id")
    fresh = F.coalesce("observed", "project_path", path_from_slug("project"))
    path = F.when(F.coalesce("project_path", F.lit("")) != "", F.col("project_path")).otherwise(fresh) if only_unresolved else fresh
    return found.withColumn("project_path", path).drop("observed")


def title_of(text) -> Column:
    """The first usable line of a message without its wrappers: three characters, one of them a letter or digit; 80 at most."""
    edge = r"^\s+|\s+$"
    c = F.regexp_replace(F.regexp_replace(p.as_column(text), edge, ""), AGENT_PREFIX, "")
    for tag in WRAPPERS:
        c = F.regexp_replace(c, rf"(?is)<{tag}>.*?</{tag}>", " ")
    lines = F.transform(F.split(c, r"\r?\n"), lambda x: F.regexp_replace(x, edge, ""))
    usable = F.filter(lines, lambda x: (F.char_length(x) >= 3) & x.rlike(r"[\p{L}\p{N}]") & ~F.startswith(x, F.lit("<")) & ~x.rlike(WARMUP))
    line = F.get(usable, F.lit(0))
    return F.when(F.char_length(line) > TITLE_CHARS, F.concat(F.regexp_replace(F.substring(line, 1, TITLE_CHARS - 1), r"\s+$", ""), F.lit("…"))).otherwise(line)


def opening_titles(messages: DataFrame, count: int = 5) -> DataFrame:
    """(session_id, title): the first title that one of a session's first user messages gives.

    The main timeline's messages come first; where they give none, any user message may.
    """
    own = messages.where((F.col("role") == "user") & p.is_visible() & p.not_meta() & (F.length(F.trim("text")) > 0))
    order = (F.asc_nulls_last("timestamp"), "uuid")
    rank_any = F.row_number().over(Window.partitionBy("session_id").orderBy(*order))
    rank_main = F.row_number().over(Window.partitionBy("session_id", F.col("agent_id").isNull()).orderBy(*order))
    k = F.when(F.col("agent_id").isNull() & (F.col("main") <= count), F.col("main")).when(F.col("any") <= count, count + F.col("any"))
    ranked = own.withColumn("any", rank_any).withColumn("main", rank_main).withColumn("k", k).where("k is not null").withColumn("title", title_of("text"))
    return ranked.groupBy("session_id").agg(F.min_by("title", F.when(F.col("title").isNotNull(), F.col("k"))).alias("title")).where("title is not null")


def backfilled_titles(sessions: DataFrame, messages: DataFrame) -> DataFrame:
    found = opening_titles(messages).withColumnRenamed("title", "opening")
    out = sessions.join(found, sessions["id"] == F.col("session_id"), "left").drop("session_id")
    return out.withColumn("title", F.when(p.is_titled(), F.col("title")).otherwise(F.coalesce("opening", "title"))).drop("opening")


def repaired_orphans(sessions: DataFrame, messages: DataFrame, missing_sources: DataFrame, source: str = "claude") -> DataFrame:
    """Sessions whose transcript is proven gone (id): counts and time bounds from the messages that are left."""
    own = missing_sources.select(F.col("id").alias("gone")).distinct()
    left = messages.groupBy(F.col("session_id").alias("gone")).agg(F.count("*").alias("n"), F.min(F.when(p.is_canonical(), F.col("timestamp"))).alias("low"), F.max(F.when(p.is_canonical(), F.col("timestamp"))).alias("high"))
    found = sessions.join(own.join(left, "gone", "left"), sessions["id"] == F.col("gone"), "left")
    touched = F.col("gone").isNotNull() & (p.source_of("source") == source)
    out = found.withColumn("message_count", F.when(touched, F.coalesce("n", F.lit(0))).otherwise(F.col("message_count")))
    for column, bound in (("started_at", "low"), ("ended_at", "high")):
        out = out.withColumn(column, F.when(touched & ~p.is_canonical(column), F.coalesce(F.col(bound), F.col(column))).otherwise(F.col(column)))
    return out.select(*sessions.columns)
