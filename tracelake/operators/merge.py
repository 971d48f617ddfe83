"""Incremental maintenance: a batch of canonical records merged into the canonical tables.

Every operator is a function of DataFrames, (current, incoming) -> next: Parquet has no
row-level updates, so a table is rewritten by joins and published as a new version.
Incoming rows carry `seq`, their order in the stream. An updated row keeps its ingest_seq;
a new one gets base + seq, which needs no global numbering.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.functions import storage
from tracelake.functions.storage import scratch
from tracelake.plans import schema

SEQ = schema.SEQ
#: Columns that an upsert leaves to their own update records.
KEPT = {"messages": ("turn_duration_ms",)}
#: Columns that a session record fills only where it has a value.
_FILLED = ("title", "project", "git_branch", "version")
_TAKEN = ("jsonl_path", "source", "started_by")


def latest(incoming: DataFrame, key: str) -> DataFrame:
    """The last row of each key, with the first seq under which the key came."""
    cols = [c for c in incoming.columns if c not in (key, "seq")]
    rolled = incoming.groupBy(key).agg(F.max_by(F.struct(*cols), "seq").alias("r"), F.min("seq").alias("first_seq"), F.max("seq").alias("seq"))
    return rolled.select(key, *(F.col("r")[c].alias(c) for c in cols), "first_seq", "seq")


def _sides(current: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    a = current.select(F.col(key).alias("k"), F.struct(*current.columns).alias("a"))
    b = incoming.select(F.col(key).alias("k"), F.struct(*incoming.columns).alias("b"))
    return a.join(b, "k", "full")


def upsert(current: DataFrame, incoming: DataFrame, table: str, base: int = 0) -> DataFrame:
    """Incoming rows replace the source's fields of the rows they meet."""
    key, kept = schema.KEYS[table], KEPT.get(table, ())
    joined = _sides(current, latest(incoming, key), key)
    out = []
    for name in schema.names_of(table):
        a, b = F.col("a")[name], F.col("b")[name] if name in incoming.columns else F.lit(None)
        value = F.coalesce(a, b) if name in kept else F.when(F.col("b").isNotNull(), b).otherwise(a)
        out.append(F.col("k").alias(key) if name == key else value.alias(name))
    return joined.select(*out, F.coalesce(F.col("a")[SEQ], F.lit(base) + F.col("b")["first_seq"]).alias(SEQ))


def changed(current: DataFrame, incoming: DataFrame, table: str) -> DataFrame:
    """The incoming rows that would change something: the replay filter."""
    key = schema.KEYS[table]
    names = [c for c in schema.names_of(table) if c in incoming.columns and c not in KEPT.get(table, ())]
    same = current.select(F.struct(*names).alias("now"), F.col(key).alias("k"))
    joined = incoming.join(same, incoming[key] == same["k"], "left")
    return joined.where(~F.struct(*(incoming[c] for c in names)).eqNullSafe(F.col("now"))).select(incoming["*"])


def replace(current: DataFrame, incoming: DataFrame, table: str, base: int = 0) -> DataFrame:
    """The last incoming row of a key stands instead of the current one, insertion order included."""
    key = schema.KEYS[table]
    new = latest(incoming, key).withColumn(SEQ, F.lit(base) + F.col("seq"))
    return current.join(new, key, "left_anti").unionByName(schema.migrated(new, table))


def fill(current: DataFrame, incoming: DataFrame, table: str, base: int = 0) -> DataFrame:
    """Each column takes the last value that isn't null, whatever order units come in; session_id is always the newest."""
    key = schema.KEYS[table]
    names = [c for c in schema.names_of(table) if c != key]
    new = incoming.groupBy(key).agg(*(F.max_by(c, F.when(F.lit(True) if c == "session_id" else F.col(c).isNotNull(), F.col("seq"))).alias(c) for c in names if c in incoming.columns), F.min("seq").alias("first_seq"))
    joined = _sides(current, new, key)
    out = [F.col("k").alias(key)]
    for c in names:
        a, b = F.col("a")[c], F.col("b")[c] if c in new.columns else F.lit(None)
        out.append((F.when(F.col("b").isNotNull(), b).otherwise(a) if c == "session_id" else F.coalesce(b, a)).alias(c))
    return joined.select(*out, F.coalesce(F.col("a")[SEQ], F.lit(base) + F.col("b")["first_seq"]).alias(SEQ))


def merge_sessions(current: DataFrame, incoming: DataFrame, base: int = 0) -> DataFrame:
    """Session records folded in stream order.

    Bounds widen; a total count replaces what came before, delta counts add up; the
    project path is kept once it is known.
    """

    def last(c: str, only_known: bool) -> Column:
        return F.max_by(c, F.when(F.col(c).isNotNull() if only_known else F.lit(True), F.col("seq"))).alias(c)

    total_at = F.max(F.when(F.coalesce("count_mode", F.lit("total")) == "total", F.col("seq")))
    known = incoming.join(incoming.groupBy("id").agg(total_at.alias("total_at")), "id")
    rolled = known.groupBy("id").agg(
        *(last(c, True) for c in _FILLED), *(last(c, False) for c in _TAKEN), F.min_by("project_path", F.when(F.col("project_path").isNotNull(), F.col("seq"))).alias("project_path"),
        F.min("started_at").alias("started_at"), F.max("ended_at").alias("ended_at"), F.max("total_at").alias("total_at"), F.min("seq").alias("first_seq"),
        F.sum(F.when(F.col("total_at").isNull() | (F.col("seq") >= F.col("total_at")), F.coalesce("message_count", F.lit(0)))).alias("message_count"),
    )
    joined = _sides(current, rolled, "id")
    a, b = F.col("a"), F.col("b")
    new = b.isNotNull()
    count = F.when(new & b["total_at"].isNotNull(), b["message_count"]).when(new, F.coalesce(a["message_count"], F.lit(0)) + b["message_count"]).otherwise(a["message_count"])
    values = {c: F.coalesce(b[c], a[c]) for c in _FILLED} | {c: F.when(new, b[c]).otherwise(a[c]) for c in _TAKEN}
    values |= {"id": F.col("k"), "project_path": F.coalesce(a["project_path"], b["project_path"]), "started_at": F.least(a["started_at"], b["started_at"]), "ended_at": F.greatest(a["ended_at"], b["ended_at"]), "message_count": count}
    return joined.select(*(values[c].alias(c) for c in schema.names_of("sessions")), F.coalesce(a[SEQ], F.lit(base) + b["first_seq"]).alias(SEQ))


def set_turn_durations(messages: DataFrame, updates: DataFrame) -> DataFrame:
    """(uuid, turn_duration_ms, seq): the last update of a message that exists; others do nothing."""
    new = updates.groupBy("uuid").agg(F.max_by("turn_duration_ms", "seq").alias("fresh"))
    return messages.join(new, "uuid", "left").withColumn("turn_duration_ms", F.coalesce("fresh", "turn_duration_ms")).select(*messages.columns)


def after_barriers(incoming: DataFrame, deletes: DataFrame, session: str = "session_id") -> DataFrame:
    """Incoming rows that come after the last delete of their session."""
    last = deletes.groupBy(F.col("session_id").alias("gone")).agg(F.max("seq").alias("gone_at"))
    return incoming.join(last, incoming[session] == last["gone"], "left").where("gone_at is null or seq > gone_at").drop("gone", "gone_at")


def delete_sessions(tables: dict[str, DataFrame], deletes: DataFrame) -> dict[str, DataFrame]:
    """The tables without the sessions (session_id): rows go by session or by agent, tool rows by their message too."""
    gone = deletes.select(F.col("session_id").alias("gone")).distinct()
    out = dict(tables)
    own = tables["messages"]
    lost = own.join(gone, (own["session_id"] == gone["gone"]) | (own["agent_id"] == gone["gone"]), "left_semi").select(F.col("uuid").alias("lost"))
    lost_by_session = own.join(gone, own["session_id"] == gone["gone"], "left_anti")
    out["messages"] = lost_by_session.join(gone, lost_by_session["agent_id"] == gone["gone"], "left_anti")
    for name in ("tool_calls", "tool_results"):
        rows = tables[name].join(gone, F.col("session_id") == F.col("gone"), "left_anti")
        out[name] = rows.join(lost, rows["message_uuid"] == lost["lost"], "left_anti")
    for name in ("subagents", "workflow_agents"):
        rows = tables[name].join(gone, F.col("session_id") == F.col("gone"), "left_anti")
        out[name] = rows.join(gone, rows["agent_id"] == gone["gone"], "left_anti")
    for name, column in (("workflows", "session_id"), ("summaries", "session_id"), ("sessions", "id")):
        out[name] = tables[name].join(gone, tables[name][column] == gone["gone"], "left_anti")
    return out


#: Tables whose rows are a session's own, so that a session that is read again tells which of them are left.
OWNED = ("messages", "tool_calls", "tool_results", "summaries", "subagents", "workflows", "workflow_agents", "sessions")


def retracted(tables: dict[str, DataFrame], records: dict[str, DataFrame], again: DataFrame) -> dict[str, DataFrame]:
    """The tables without the rows of the sessions `again` (session_id) that a whole new reading of them doesn't have."""
    gone = again.select(F.col("session_id").alias("__s")).distinct()
    out = dict(tables)
    for name in OWNED:
        key, session = schema.KEYS[name], "id" if name == "sessions" else "session_id"
        # a row that isn't read again goes if its session is
        suspects = tables[name].join(gone, F.col(session) == F.col("__s"), "left_semi").select(F.col(key).alias("__k"))
        if name in records:
            suspects = suspects.join(records[name].select(F.col(key).alias("__n")), F.col("__k") == F.col("__n"), "left_anti")
        out[name] = tables[name].join(suspects, F.col(key) == F.col("__k"), "left_anti")
    return out


def apply(tables: dict[str, DataFrame], records: dict[str, DataFrame], base: int = 0) -> dict[str, DataFrame]:
    """The tables after a stream of records by kind: tables' rows, `deletes` (session_id, seq), `turn_durations`, `cursors`.

    Deletes are barriers: what came before one of its session is gone, what comes after stays.
    `again` (session_id) names sessions of which the records are a whole new reading, `forgotten`
    (jsonl_path) the cursors of files that are gone. `failures` change nothing but their cursors.
    """
    out = dict(tables)
    records = {k: v for k, v in records.items() if k != "failures"}
    again, forgotten = records.pop("again", None), records.pop("forgotten", None)
    if again is not None:
        out = retracted(out, records, again)
    if forgotten is not None:
        out["index_state"] = out["index_state"].join(forgotten.select(F.col("jsonl_path").alias("__p")), F.col("jsonl_path") == F.col("__p"), "left_anti")
    deletes = records.get("deletes")
    rows = {k: v for k, v in records.items() if k != "deletes"}
    if deletes is not None:
        out = delete_sessions(out, deletes)
        rows = {k: after_barriers(v, deletes, "id" if k == "sessions" else "session_id") if ("session_id" in v.columns or k == "sessions") else v for k, v in rows.items()}
    steps = {"messages": upsert, "tool_calls": upsert, "tool_results": upsert, "summaries": replace, "workflows": replace, "subagents": fill, "workflow_agents": fill}
    for name, step in steps.items():
        if name in rows:
            out[name] = step(out[name], rows[name], name, base)
    if "sessions" in rows:
        out["sessions"] = merge_sessions(out["sessions"], rows["sessions"], base)
    if "turn_durations" in rows:
        out["messages"] = set_turn_durations(out["messages"], rows["turn_durations"])
    if "cursors" in rows:
        out["index_state"] = upsert(out["index_state"], rows["cursors"], "index_state", base)
    return out


def diff(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """(key, change, position, row): rows added or changed (or moved), with where they stand, and keys removed.

    `position` is a column of both sides; rows are compared by a hash of all others.
    """
    cols = [c for c in new.columns if c not in (key, "position")]
    a = old.select(F.col(key).alias("k"), F.xxhash64(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"})).alias("ha"), F.col("position").alias("pa"))
    b = new.select(F.col(key).alias("k"), F.xxhash64(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"})).alias("hb"), F.col("position").alias("pb"), F.struct(*new.columns).alias("row"))
    joined = a.join(b, "k", "full")
    change = F.when(F.col("ha").isNull(), "added").when(F.col("hb").isNull(), "removed").when(F.col("ha") != F.col("hb"), "changed").when(F.col("pa") != F.col("pb"), "moved")
    return joined.withColumn("change", change).where("change is not null").select(F.col("k").alias(key), "change", F.col("pb").alias("position"), "row")


def patched(old: DataFrame, patch: DataFrame, key: str) -> DataFrame:
    """old after a diff."""
    kept = old.join(patch.select(key), key, "left_anti")
    return kept.unionByName(patch.where("change <> 'removed'").select("row.*"))


class Conflict(RuntimeError):
    """Another writer has published the version that was to be published."""


class Store:
    """Versions of the canonical tables in a shared folder.

    A version's tables are written in full to a folder of their own, then a file named by
    its number is made, which only one writer can do: publishing is compare-and-set on the
    version that a writer began with, so no writer's batch is lost. A batch id is published
    once. The last `keep` versions stay, and older ones for `grace` seconds, which is how
    long a reader may go on with the version that it opened.
    """

    def __init__(self, spark, path: str, keep: int = 2, grace: float = 3600.0):
        self.spark, self.path, self.keep, self.grace = spark, path.rstrip("/"), keep, grace

    def _numbers(self) -> list[int]:
        return [int(n) for n in storage.names_in(self.spark, f"{self.path}/versions")]

    def _told(self, number: int) -> dict:
        return json.loads(storage.text_at(self.spark, f"{self.path}/versions/{number:012d}"))

    def version(self) -> tuple[int, str] | None:
        """(number, batch id) of the current version."""
        numbers = self._numbers()
        return (numbers[-1], self._told(numbers[-1])["batch"]) if numbers else None

    def tables(self, number: int | None = None) -> dict[str, DataFrame]:
        """The tables of a version, else of the current one."""
        numbers = self._numbers()
        if number is None and not numbers:
            return {n: self.spark.createDataFrame([], schema.struct_of(n)) for n in schema.TABLES}
        folder = self.folder(number)
        return {n: schema.migrated(self.spark.read.parquet(f"{folder}/{n}"), n) for n in schema.TABLES}

    def folder(self, number: int | None = None) -> str:
        """The folder of a version's tables, as Engine.open() takes it; of the current one by default."""
        return f"{self.path}/{self._told(self._numbers()[-1] if number is None else number)['folder']}"

    def published(self, batch: str) -> int | None:
        """The version under which a batch was published, if it was."""
        now = self.version()
        if now is not None and now[1] == batch:
            return now[0]
        name = hashlib.sha256(batch.encode()).hexdigest()
        return int(storage.text_at(self.spark, f"{self.path}/batches/{name}")) if name in storage.names_in(self.spark, f"{self.path}/batches") else None

    def publish(self, tables: dict[str, DataFrame], batch: str, after: int | None = None) -> int:
        """Makes the tables the version that follows `after` (the current one by default); Conflict if that exists already."""
        known = self.published(batch)
        if known is not None:
            return known
        now = self.version()
        if now is not None:  # a writer that stopped after its version was named
            storage.put_once(self.spark, f"{self.path}/batches/{hashlib.sha256(now[1].encode()).hexdigest()}", str(now[0]))
        number = 1 + ((now[0] if now else 0) if after is None else after)
        folder = f"tables/{number:012d}-{uuid.uuid4().hex}"
        for name, df in tables.items():
            df.write.parquet(f"{self.path}/{folder}/{name}")
        if not storage.put_once(self.spark, f"{self.path}/versions/{number:012d}", json.dumps({"batch": batch, "folder": folder})):
            self._delete(folder)
            raise Conflict(f"version {number} is another writer's")
        storage.put_once(self.spark, f"{self.path}/batches/{hashlib.sha256(batch.encode()).hexdigest()}", str(number))
        self._expire(number)
        return number

    def _delete(self, folder: str) -> None:
        at, fs = storage.filesystem(self.spark, self.path)
        fs.delete(at(f"{self.path}/{folder}"), True)

    def _expire(self, number: int) -> None:
        at, fs = storage.filesystem(self.spark, self.path)
        held = {self._told(n)["folder"].split("/")[1] for n in self._numbers() if n > number - self.keep}
        for name in storage.names_in(self.spark, f"{self.path}/tables"):
            # what no version names may be one that is being written: it stays for the grace time too
            if name not in held and int(name.split("-")[0]) <= number - self.keep:
                if time.time() - fs.getFileStatus(at(f"{self.path}/tables/{name}")).getModificationTime() / 1000 > self.grace:
                    self._delete(f"tables/{name}")

    def merge(self, records: dict[str, DataFrame], batch: str, attempts: int = 5) -> int:
        """Publishes the current tables with a batch applied; if another writer was faster, again on top of its version."""
        for attempt in range(attempts):
            known = self.published(batch)
            if known is not None:
                return known
            after = (self.version() or (0, ""))[0]
            try:
                return self.publish(apply(self.tables(after or None), records, (after + 1) << 40), batch, after)
            except Conflict:
                if attempt == attempts - 1:
                    raise
        raise ValueError("attempts must be 1 or more")


def retained(old: DataFrame, ids: DataFrame, fresh: DataFrame, table: str, column: str = "session_id") -> DataFrame:
    """The rows of a previous snapshot whose session is to be kept, and a fresh build's rows."""
    kept = schema.migrated(old, table).join(ids.select(F.col("id").alias("keep_id")).distinct(), F.col(column) == F.col("keep_id"), "left_semi")
    return kept.unionByName(schema.migrated(fresh, table))


def temporary(spark) -> Store:
    return Store(spark, scratch(spark))


def union_all(frames: Iterable[DataFrame]) -> DataFrame:
    frames = list(frames)
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out
