"""The query façade: one object over the canonical tables, a method per helper."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.functions import predicates as p
from tracelake.operators import agents, guard, memories, messages, overview, search, sessions, tools, usage
from tracelake.operators.search_index import Index
from tracelake.plans import schema

#: Key and searched columns of the tables with an index.
INDEXED = {"messages": ("uuid", "text"), "memories": ("id", "path", "summary")}


class ParquetTables:
    """Canonical tables of a folder, one Parquet folder each; absent tables are empty."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name not in schema.TABLES:
            raise AttributeError(name)
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        if at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at):
            return schema.migrated(self.spark.read.parquet(f"{self.path}/{name}"), name)
        return self.spark.createDataFrame([], schema.struct_of(name))


class Engine:
    """Read helpers over tables with the canonical attributes; a string option is a session id, a number a limit."""

    def __init__(self, tables, session_id: str | None = None, indexes: dict | None = None):
        """`indexes`: search_index.Index by table name (messages, memories), used instead of scans."""
        self.t, self.session_id, self.indexes = tables, session_id, indexes or {}

    @classmethod
    def open(cls, spark: SparkSession, path: str, indexes: str | None = None) -> Engine:
        """The tables of a folder; with the folder of their indexes, these are brought up to date and searched."""
        engine = cls(ParquetTables(spark, path))
        if indexes is not None:
            engine.indexes = {n: Index(spark, f"{indexes.rstrip('/')}/{n}", *c) for n, c in INDEXED.items()}
            for name, index in engine.indexes.items():
                index.refresh(getattr(engine.t, name))
        return engine

    @staticmethod
    def _options(arg, options: dict) -> dict:
        if isinstance(arg, bool) or arg is None:
            return options
        if isinstance(arg, str):
            return {"session_id": arg, **options}
        if isinstance(arg, int | float):
            return {"limit": int(arg), **options}
        return {**arg, **options}

    def sql(self, text: str, *params) -> DataFrame:
        return guard.read_only(self.t, text, list(params))

    def search(self, text: str, context_limit: int = 6, **options) -> tuple[DataFrame, DataFrame]:
        """(hits, context rows)."""
        if not 0 <= context_limit <= 6:
            raise ValueError("search() context_limit must be from 0 to 6")
        hits = search.search(self.t.messages, self.t.sessions, text, index=self.indexes.get("messages"), **options)
        return hits, tools.neighbours_in_time(hits, self.t.messages, context_limit)

    def messages(self, arg=None, **options):
        return messages.query(self.t.messages, self.t.sessions, **({"uuid": arg} if isinstance(arg, str) else {}), **options)

    def sessions(self, arg=None, **options) -> DataFrame:
        o = self._options(arg, options)
        refs = o.pop("sessions", ())
        if "session_id" in o:
            refs = [o.pop("session_id"), *refs]
        found = sessions.sessions(self.t.sessions, refs, **o)
        return found.withColumn("is_invoking", F.col("id").eqNullSafe(F.lit(self.session_id)) & F.lit(self.session_id is not None))

    def recent(self, n: int = 10) -> DataFrame:
        return self.sessions(limit=n)

    def summaries(self, arg=None, **options) -> DataFrame:
        o = self._options(arg, options)
        n, inactive = p.limit_of(o.pop("limit", None), 100), o.pop("include_inactive", False)
        s = self.t.sessions.select(F.col("id").alias("session_id"), F.col("title").alias("session_title"), "project", "git_branch", F.col("source").alias("session_source"))
        found = self.t.summaries.join(s, "session_id", "left").where(p.is_visible(include_inactive=inactive))
        for c in p.scope({"session_id": "session_id", "project": "project", "timestamp": "timestamp", "branch": "git_branch", "source": "session_source"}, **o):
            found = found.where(c)
        return found.drop("git_branch", "session_source").orderBy(F.desc_nulls_last("timestamp"), "id").limit(n)

    def memories(self, arg=None, query: str | None = None, **options) -> DataFrame:
        o = self._options(arg, options)
        if query is None:
            return memories.scoped(self.t.memories, self.t.sessions, **o)
        return search.search_memories(self.t.memories, self.t.sessions, query, index=self.indexes.get("memories"), **o)

    def subagents(self, arg=None, **options) -> DataFrame:
        return agents.subagents(self.t.subagents, self.t.messages, self.t.sessions, **self._options(arg, options))

    def workflows(self, arg=None, **options) -> DataFrame:
        return agents.workflows(self.t.workflows, self.t.sessions, **self._options(arg, options))

    def workflow_tree(self, run_id: str) -> DataFrame:
        own = F.col("run_id") == run_id
        return agents.workflow_tree(self.t.workflows.where(own), self.t.workflow_agents.where(own), self.t.messages)

    def file_history(self, path: str, **options) -> DataFrame:
        return tools.file_history(self.t.tool_calls, self.t.messages, self.t.sessions, path, **options)

    def failures(self, arg=None, **options) -> tuple[DataFrame, DataFrame]:
        """(failures, the messages that came next)."""
        o = self._options(arg, options)
        failed = tools.failures(self.t.tool_results, self.t.tool_calls, self.t.messages, self.t.sessions, **o)
        return failed, tools.next_messages(failed, self.t.messages, include_inactive=o.get("include_inactive", False))

    def context(self, uuid: str, include_inactive: bool = False) -> dict | None:
        anchor = self.t.messages.where((F.col("uuid") == uuid) & p.is_visible(include_inactive=include_inactive))
        if anchor.isEmpty():
            return None
        chain = messages.parent_chains(self.t.messages, anchor, include_inactive=include_inactive).orderBy(F.desc("depth"))
        return {"message": anchor.first().asDict(), "parent_chain": [r.asDict() for r in chain.collect()], "context": messages.contexts(self.t, anchor).first().asDict()}

    def trace(self, uuid: str, include_inactive: bool = False) -> DataFrame:
        anchor = self.t.messages.where((F.col("uuid") == uuid) & p.is_visible(include_inactive=include_inactive))
        return messages.parent_chains(self.t.messages, anchor, True, include_inactive).orderBy(F.desc("depth"))

    def thread(self, session_id: str, **options) -> DataFrame:
        return messages.thread(self.t.messages, session_id, **options)

    def overview(self, arg=None, **options) -> dict:
        if isinstance(arg, str):
            options = {"project": arg, **options}
        elif isinstance(arg, int):
            options = {"limit": arg, **options}
        return overview.overview(self.t, session_id=self.session_id, **options)

    def usage(self, source: str | None = None) -> dict:
        rows = usage.usage_rows(self.t.messages, self.t.summaries, source)
        total = usage.totals(rows).first()
        turn = usage.longest_turn(self.t.messages).take(1)
        return {"daily": [r.asDict() for r in usage.daily(rows).collect()], "total_tokens": total.total_tokens, "peak_day": total.peak_day, "longest_turn": turn[0].asDict() if turn else None}


class MemoryAdmin:
    """The mutations, apart from the read helpers. Each returns the record; `table` is the new state, for the caller to publish."""

    def __init__(self, tables):
        self.t, self.table = tables, tables.memories

    def remember(self, **fields) -> dict:
        self.table, record = memories.remember(self.table, self.t.sessions, **fields)
        return record

    def forget(self, id: str, reason: str) -> dict:
        self.table, record = memories.forget(self.table, id, reason)
        return record
