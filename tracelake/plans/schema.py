"""The canonical tables: exact columns, defaults, and additive migration."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_S, _L, _I, _D = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType()

#: Columns of each table in order; a third item is the default of a missing or null column.
COLUMNS = {
    "sessions": [("id", _S), ("title", _S), ("project", _S), ("project_path", _S), ("started_at", _S), ("ended_at", _S), ("git_branch", _S), ("version", _S), ("message_count", _L, 0), ("jsonl_path", _S), ("source", _S, "claude"), ("started_by", _S)],
    "messages": [
        ("uuid", _S), ("session_id", _S), ("type", _S), ("parent_uuid", _S), ("timestamp", _S), ("role", _S), ("text", _S), ("content_type", _S), ("is_meta", _I, 0), ("visibility", _S, "visible"), ("model", _S), ("is_sidechain", _I, 0),
        ("agent_id", _S), ("input_tokens", _L), ("output_tokens", _L), ("cwd", _S), ("skill", _S), ("turn_duration_ms", _L), ("source", _S, "claude"), ("harness_kind", _S),
    ],
    "tool_calls": [("id", _S), ("message_uuid", _S), ("session_id", _S), ("name", _S), ("presentation", _S, "default"), ("input_json", _S), ("file_path", _S)],
    "tool_results": [("tool_use_id", _S), ("message_uuid", _S), ("session_id", _S), ("content", _S), ("file_path", _S), ("is_error", _I, 0)],
    "subagents": [("agent_id", _S), ("session_id", _S), ("parent_tool_use_id", _S), ("agent_type", _S), ("description", _S), ("duration_ms", _L), ("total_tokens", _L)],
    "workflows": [("run_id", _S), ("session_id", _S), ("parent_tool_use_id", _S), ("task_id", _S), ("script", _S), ("result_json", _S), ("timestamp", _S), ("agent_count", _L, 0), ("duration_ms", _L), ("total_tokens", _L), ("status", _S), ("workflow_name", _S)],
    "workflow_agents": [("agent_id", _S), ("run_id", _S), ("session_id", _S), ("agent_type", _S), ("description", _S), ("phase", _S), ("label", _S), ("model", _S), ("state", _S), ("duration_ms", _L), ("tokens", _L), ("tool_calls", _L)],
    "summaries": [("id", _S), ("session_id", _S), ("timestamp", _S), ("source", _S), ("content", _S), ("visibility", _S, "visible"), ("input_tokens", _L), ("output_tokens", _L)],
    "memories": [("id", _S), ("session_id", _S), ("project", _S), ("message_start", _S), ("message_end", _S), ("path", _S), ("anchors", _S), ("summary", _S), ("created_at", _S), ("deleted_at", _S), ("deleted_reason", _S)],
    "index_state": [("jsonl_path", _S), ("mtime", _D), ("lines_processed", _L), ("replay_required", _I, 0), ("cursor", _S)],
}
KEYS = {name: columns[0][0] for name, columns in COLUMNS.items()}
#: Insertion order: the last tiebreak of several operators, kept by updates.
SEQ = "ingest_seq"
TABLES = tuple(COLUMNS)


def struct_of(table: str) -> T.StructType:
    return T.StructType([*(T.StructField(c[0], c[1]) for c in COLUMNS[table]), T.StructField(SEQ, T.LongType())])


def names_of(table: str) -> list[str]:
    return [c[0] for c in COLUMNS[table]]


def migrated(df: DataFrame, table: str) -> DataFrame:
    """df with the table's columns: missing ones come with their default, nothing else is changed."""
    out = []
    for name, kind, *default in COLUMNS[table]:
        out.append(F.col(name).cast(kind).alias(name) if name in df.columns else F.lit(default[0] if default else None).cast(kind).alias(name))
    out.append(F.col(SEQ).cast("long").alias(SEQ) if SEQ in df.columns else F.lit(None).cast("long").alias(SEQ))
    return df.select(*out)


def missing(df: DataFrame, table: str) -> list[str]:
    """Columns that a migration would add."""
    return [c for c in names_of(table) if c not in df.columns]
