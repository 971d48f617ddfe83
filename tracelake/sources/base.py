"""The frame of all transcript sources: discover files, parse units, fan records out into tables.

A source says which files are its own, which unit a file belongs to, and how a unit's files
become canonical records. Files are read by Spark (so any store will do), grouped by unit,
and each unit is parsed in one task by plain Python: transcripts are ordered logs whose
meaning depends on what came before. Everything after the parse is declarative.
"""

from __future__ import annotations

import hashlib
import io
import json
import os
import re
import sqlite3
import tempfile
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelake.functions import scalars
from tracelake.functions.storage import written
from tracelake.plans import schema

Record = tuple[str, dict]
BODY_CHARS = 10_000
#: Kinds of records that aren't rows of a table.
UPDATES = {"delete": "session_id string", "turn_duration": "uuid string, turn_duration_ms long"}
RECORDS = "source string, unit string, seq long, kind string, session_id string, body string"


@dataclass(frozen=True)
class Source:
    """A transcript source: its file pattern, the unit of a path, and the parser of a unit's files."""

    name: str
    pattern: str
    #: The first of these that finds something in a path names its unit by its group.
    unit: tuple[str, ...]
    parse: Callable[[dict[str, bytes]], Iterator[Record]]

    def unit_of(self, path: str) -> str:
        return next((m[1] for pattern in self.unit if (m := re.search(pattern, path))), path)

    def unit_column(self, path: Column) -> Column:
        found = [F.when(path.rlike(pattern), F.regexp_extract(path, pattern, 1)) for pattern in self.unit]
        return F.coalesce(*found, path)


#: Units: a file's name without its endings, its folder, or the file itself.
STEM = r"([^/]+?)(?:\.jsonl?(?:\.zstd?)?)?$"
FOLDER = r"^(.*)/[^/]*$"
FILE = r"^(.*)$"


REGISTRY: dict[str, Source] = {}


def register(source: Source) -> Source:
    if source.name in REGISTRY:
        raise ValueError(f"source {source.name} is registered twice")
    REGISTRY[source.name] = source
    return source


def files(spark: SparkSession, root: str, *sources: Source) -> DataFrame:
    """(path, modified, size, content) of the sources' files below root."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return found.where(F.col("path").rlike("|".join(f"(?:{s.pattern})" for s in sources))).select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("size"), "content")


def owned(found: DataFrame, sources: Iterable[Source]) -> DataFrame:
    """found with the columns source and unit: a row for each source that a file is of."""
    path = F.col("path")
    each = [F.when(path.rlike(s.pattern), F.struct(F.lit(s.name).alias("source"), s.unit_column(path).alias("unit"))) for s in sources]
    return found.withColumn("__o", F.explode(F.array_compact(F.array(*each)))).select(*found.columns, "__o.source", "__o.unit")


def changed_units(found: DataFrame, state: DataFrame, *sources: Source) -> DataFrame:
    """(source, unit) of which a file is new, or has another time or size than index_state says, or is gone.

    A unit that couldn't be read is tried again when one of its files changes.
    """
    marks = owned(found.select("path", F.concat_ws(":", F.unix_millis("modified"), "size").alias("mark")), sources)
    known = owned(state.select(F.col("jsonl_path").alias("path"), F.substring_index("cursor", " ", 1).alias("cursor")), sources)
    both = marks.join(known, ["path", "source", "unit"], "full")
    return both.where(~F.col("mark").eqNullSafe(F.col("cursor"))).select("source", "unit").distinct()


def changed_files(found: DataFrame, state: DataFrame, *sources: Source) -> DataFrame:
    """All files of the units of which a file has changed: a unit is parsed whole or not at all."""
    sources = sources or tuple(REGISTRY.values())
    return files_of(found, changed_units(found, state, *sources), sources)


def files_of(found: DataFrame, units: DataFrame, sources: Iterable[Source]) -> DataFrame:
    paths = owned(found.select("path"), sources).join(units, ["source", "unit"], "left_semi").select("path").distinct()
    return found.join(paths, "path", "left_semi").select(*found.columns)


def cursors(found: DataFrame, failures: DataFrame | None = None, sources: Iterable[Source] = ()) -> DataFrame:
    """index_state rows of the files as they are now; those of failed units (source, unit, error) are to be replayed, and say why."""
    mark = F.concat_ws(":", F.unix_millis("modified"), "size")
    known = found.select("path", "modified", mark.alias("mark"))
    if failures is None:
        known = known.withColumn("error", F.lit(None).cast("string"))
    else:
        failed = owned(found.select("path"), sources).join(failures, ["source", "unit"]).groupBy("path").agg(F.min("error").alias("error"))
        known = known.join(failed, "path", "left")
    at = F.unix_millis("modified")
    return known.select(F.col("path").alias("jsonl_path"), at.cast("double").alias("mtime"), F.lit(None).cast("long").alias("lines_processed"), F.col("error").isNotNull().cast("int").alias("replay_required"), F.concat_ws(" ", "mark", "error").alias("cursor"), at.alias("seq"))


def records(found: DataFrame, *sources: Source, on_error: str = "stop") -> DataFrame:
    """RECORDS of all units of the files, each unit parsed once, in one task, whatever source it is of.

    With on_error="skip", a unit that its parser can't read yields one record of the kind
    `failure` that says why, and none of its rows.
    """
    if on_error not in ("stop", "skip"):
        raise ValueError("on_error must be stop or skip")
    by_name = {s.name: s for s in sources}

    def run(group: pd.DataFrame) -> pd.DataFrame:
        own = {p: bytes(c) for p, c in sorted(zip(group["path"], group["content"], strict=True))}
        name, key = group["source"].iloc[0], group["unit"].iloc[0]
        try:
            out = [(name, key, i, kind, row.get("session_id") or (row.get("id") if kind == "sessions" else None), json.dumps(row, ensure_ascii=False)) for i, (kind, row) in enumerate(by_name[name].parse(own))]
        except (ImportError, MemoryError):  # the worker's fault, not the unit's
            raise
        except Exception as e:  # noqa: BLE001  a parser of foreign files may raise anything
            if on_error == "stop":
                raise
            out = [(name, key, 0, "failure", None, json.dumps({"error": f"{type(e).__name__}: {e}"[:500]}, ensure_ascii=False))]
        return pd.DataFrame(out, columns=["source", "unit", "seq", "kind", "session_id", "body"])

    # units are dealt out by path and source alone; contents follow once
    return owned(found.select("path", "content"), sources).groupBy("source", "unit").applyInPandas(run, RECORDS)


def numbered(found: DataFrame) -> DataFrame:
    """found with `seq` counted through all records, units in the order of (source, unit); found must be stored.

    Units are sorted by range, numbered inside each range, and ranges are added up: no window
    holds more than a range's units.
    """
    units = found.groupBy("source", "unit").agg((F.max("seq") + 1).alias("n"))
    units = written(units.repartitionByRange("source", "unit").withColumn("p", F.spark_partition_id()))
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    ranges = units.groupBy("p").agg(F.sum("n").alias("n")).select("p", F.coalesce(F.sum("n").over(before.orderBy("p")), F.lit(0)).alias("base"))
    start = F.coalesce(F.sum("n").over(before.partitionBy("p").orderBy("source", "unit")), F.lit(0))
    # as many rows as there are ranges
    starts = units.withColumn("start", start).join(F.broadcast(ranges), "p").select("source", "unit", (F.col("start") + F.col("base")).alias("start"))
    return found.join(starts, ["source", "unit"]).withColumn("seq", F.col("start") + F.col("seq")).drop("start")


def tables_of(found: DataFrame) -> dict[str, DataFrame]:
    """Numbered records as DataFrames by kind."""
    seq = F.col("seq")
    out = {}
    for name in (n for n in schema.TABLES if n not in ("index_state", "memories")):
        fields = [T.StructField(c[0], c[1]) for c in schema.COLUMNS[name]]
        if name == "sessions":
            fields.append(T.StructField("count_mode", T.StringType()))
        rows = found.where(F.col("kind") == name).select(F.from_json("body", T.StructType(fields)).alias("r"), seq)
        out[name] = rows.select("r.*", "seq")
    for name, kind in UPDATES.items():
        rows = found.where(F.col("kind") == name).select(F.from_json("body", kind).alias("r"), seq)
        out[f"{name}s"] = rows.select("r.*", "seq")
    return out


def ingest(spark: SparkSession, root: str, names: Iterable[str] | None = None, state: DataFrame | None = None) -> dict[str, DataFrame]:
    """The records by kind of the given sources below root; with a state, only units whose files changed."""
    import tracelake.sources  # noqa: F401  registers all sources

    sources = [REGISTRY[n] for n in names or sorted(REGISTRY)]
    found = files(spark, root, *sources)
    return parsed(found if state is None else changed_files(found, state, *sources), names)


def parsed(found: DataFrame, names: Iterable[str] | None = None, on_error: str = "stop") -> dict[str, DataFrame]:
    """The records by kind of files (path, modified, size, content). They are parsed once and written; tables read them back.

    `failures` are the (source, unit, error) that on_error="skip" has left out.
    """
    sources = [REGISTRY[n] for n in names or sorted(REGISTRY)]
    told = written(numbered(written(records(found, *sources, on_error=on_error))))
    failures = told.where("kind = 'failure'").select("source", "unit", F.get_json_object("body", "$.error").alias("error"))
    return {**tables_of(told), "failures": failures, "cursors": cursors(found, failures, sources)}


# ---- what parsers share ----


def lines(data: bytes) -> Iterator[tuple[int, dict]]:
    """(line number, object) of the JSON lines; an unterminated tail that can't be read is left for later."""
    for i, line in enumerate(data.decode("utf-8", "replace").split("\n"), 1):
        try:
            value = json.loads(line)
        except ValueError:
            continue
        if isinstance(value, dict):
            yield i, value


def zstd_frames(data: bytes, torn: bool = False) -> bytes:
    """The bytes of concatenated zstd frames; a torn tail is an error unless `torn` allows it."""
    import zstandard

    out, rest = io.BytesIO(), data
    while rest:
        d = zstandard.ZstdDecompressor().decompressobj()
        try:
            out.write(d.decompress(rest))
        except zstandard.ZstdError:
            if torn:
                break
            raise
        if not d.eof:
            if torn:
                break
            raise ValueError("the last zstd frame is not complete")
        rest = d.unused_data
    return out.getvalue()


class SqliteFile:
    """A SQLite file's bytes as a read-only database, in the task's own temporary folder."""

    def __init__(self, data: bytes):
        fd, self.path = tempfile.mkstemp(suffix=".db")
        with os.fdopen(fd, "wb") as f:
            f.write(data)

    def __enter__(self):
        self.con = sqlite3.connect(f"file:{self.path}?mode=ro&immutable=1", uri=True)
        self.con.row_factory = sqlite3.Row
        return self

    def __exit__(self, *_):
        self.con.close()
        os.unlink(self.path)

    def columns(self, table: str) -> set[str]:
        return {r["name"] for r in self.con.execute(f"pragma table_info({table})")}

    def rows(self, sql: str, *args) -> list[dict]:
        return [dict(r) for r in self.con.execute(sql, args)]

    def has(self, **tables: Iterable[str]) -> bool:
        """Whether each table has the columns that the parser needs."""
        return all(set(c) <= self.columns(t) for t, c in tables.items())


def iso(value) -> str | None:
    """A canonical time of an ISO text, or of seconds or milliseconds since 1970; other texts stay as they are."""
    import datetime

    if value is None or value == "" or isinstance(value, bool):
        return None
    if isinstance(value, int | float):
        seconds = value / 1000 if abs(value) > 1e11 else value
        at = datetime.datetime.fromtimestamp(seconds, datetime.UTC)
    else:
        if not isinstance(value, str):
            return None
        if not re.search(r"(Z|[+-]\d{2}:?\d{2})$", value):
            return value
        try:
            at = datetime.datetime.fromisoformat(value.replace("Z", "+00:00")).astimezone(datetime.UTC)
        except ValueError:
            return value
    return f"{at:%Y-%m-%dT%H:%M:%S}.{at.microsecond // 1000:03d}Z"


def cut(text, limit: int = BODY_CHARS) -> str | None:
    return text[:limit] if isinstance(text, str) else None


def compact(value) -> str:
    """JSON of a value, its string leaves cut."""

    def leaf(v):
        if isinstance(v, str):
            return v if len(v) <= BODY_CHARS else v[:BODY_CHARS] + "...[truncated]"
        if isinstance(v, list):
            return [leaf(x) for x in v]
        return {k: leaf(x) for k, x in v.items()} if isinstance(v, dict) else v

    return json.dumps(leaf(value), ensure_ascii=False)


def total(*parts) -> int | None:
    """The sum of token counts; None only if all are missing."""
    known = [int(p) for p in parts if isinstance(p, int | float) and not isinstance(p, bool)]
    return sum(known) if known else None


def file_of(name: str | None, value) -> str | None:
    if name in ("Read", "Edit", "Write", "NotebookEdit") and isinstance(value, dict):
        return value.get("file_path") or None
    return None


def digest(*parts) -> str:
    return hashlib.sha256("\0".join(map(str, parts)).encode()).hexdigest()[:16]


def message(uuid, session_id, source, role, text, **more) -> Record:
    row = {"uuid": uuid, "session_id": session_id, "type": role, "role": role, "text": cut(text), "content_type": "text", "is_meta": 0, "visibility": "visible", "is_sidechain": 0, "source": source}
    row.update(more)
    if row.get("harness_kind"):
        row["is_meta"] = 1
    return "messages", row


def tool_call(id, message_uuid, session_id, name, value) -> Record:
    return "tool_calls", {"id": id, "message_uuid": message_uuid, "session_id": session_id, "name": name, "presentation": "skill" if name == "Skill" else "default", "input_json": value if isinstance(value, str) else compact(value if value is not None else {}), "file_path": file_of(name, value)}


def tool_result(id, message_uuid, session_id, content, error=False, path=None) -> Record:
    return "tool_results", {"tool_use_id": id, "message_uuid": message_uuid, "session_id": session_id, "content": cut(content if isinstance(content, str) or content is None else text_of(content)), "file_path": path, "is_error": int(bool(error))}


def text_of(content) -> str | None:
    """The text of a string, a block, or a list of blocks."""
    if content is None or isinstance(content, str):
        return content
    if isinstance(content, dict):
        return content.get("text") if "text" in content else json.dumps(content, ensure_ascii=False)
    if isinstance(content, list):
        return "\n".join(x for x in map(text_of, content) if x is not None)
    return str(content)


class Span:
    """A session's bounds and message count as they are read."""

    def __init__(self):
        self.low = self.high = None
        self.n = 0

    def see(self, at: str | None, counts: bool = True) -> None:
        self.n += counts
        if at:
            self.low = at if self.low is None or at < self.low else self.low
            self.high = at if self.high is None or at > self.high else self.high

    def session(self, id, source, **more) -> Record:
        row = {"id": id, "started_at": self.low, "ended_at": self.high, "message_count": self.n, "count_mode": "total", "source": source}
        row.update(more)
        if row.get("project_path") and not row.get("project"):
            row["project"] = scalars.slug_of(row["project_path"])
        return "sessions", row


def stem(path: str) -> str:
    return re.sub(r"\.(jsonl|json)(\.zstd?|)$", "", path.rsplit("/", 1)[-1])
