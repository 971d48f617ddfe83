"""The memory registry: lists, and the mutations remember, forget, archive and restore."""

from __future__ import annotations

import datetime
import json
import re
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.functions import predicates as p

#: Scripts that a memory's text may not hold: Han, Hiragana, Katakana, Hangul.
_FOREIGN = re.compile("[ᄀ-ᇿ぀-ヿ㄰-㆏ㇰ-ㇿ㐀-䶿一-鿿ꥠ-꥿가-퟿豈-﫿ｦ-ﾟ\U00020000-\U0003ffff]")


def assert_english(text: str, label: str) -> None:
    if _FOREIGN.search(text or ""):
        raise ValueError(f"{label} must be in English")


def listed(table: DataFrame, project: str | None = None, text: str | None = None, descending: bool = True, archived: bool = False) -> DataFrame:
    found = table.where(F.col("deleted_at").isNotNull() if archived else F.col("deleted_at").isNull())
    if project is not None:
        found = found.where(F.col("project") == project)
    if text:
        found = found.where(F.contains(F.lower(F.concat_ws(" ", "path", "summary")), F.lit(text.lower())))
    return found.orderBy(F.desc_nulls_last("created_at") if descending else F.asc_nulls_first("created_at"), "id")


def scoped(table: DataFrame, sessions: DataFrame, limit: int | None = None, **scope) -> DataFrame:
    """Active memories of a scope, newest first."""
    columns = {"session_id": "session_id", "project": "project", "timestamp": "created_at"}
    found = table.where("deleted_at is null")
    if any(scope.get(k) for k in ("branch", "source")):
        found = found.join(sessions.select(F.col("id").alias("session_id"), "git_branch", F.col("source").alias("session_source")), "session_id", "left")
        columns |= {"branch": "git_branch", "source": "session_source"}
    for c in p.scope(columns, **scope):
        found = found.where(c)
    return found.select(*table.columns).orderBy(F.desc_nulls_last("created_at"), "id").limit(p.limit_of(limit, 50))


def _now() -> str:
    return datetime.datetime.now(datetime.UTC).strftime("%Y-%m-%dT%H:%M:%S.%f")[:-3] + "Z"


def anchors_json(anchors) -> str | None:
    """A JSON array of strings, from a list or a JSON text; null stays null."""
    if anchors is None:
        return None
    value = json.loads(anchors) if isinstance(anchors, str) else list(anchors)
    if not isinstance(value, list) or not all(isinstance(x, str) for x in value):
        raise ValueError("anchors must be an array of strings")
    return json.dumps(value, ensure_ascii=False)


def remember(table: DataFrame, sessions: DataFrame, path: str, summary: str, session_id: str | None = None, project: str | None = None, message_start: str | None = None, message_end: str | None = None, anchors=None, new_id=lambda: f"mem-{uuid.uuid4()}") -> tuple[DataFrame, dict]:
    """(table with the new memory, its record). A taken id is drawn again, three times at most."""
    if not path or not summary:
        raise ValueError("remember() requires path and summary")
    assert_english(summary, "remember() summary")
    if project is None and session_id is not None:
        row = sessions.where(F.col("id") == session_id).select("project").take(1)
        project = row[0][0] if row else None
    for _ in range(3):
        memory = new_id()
        if table.where(F.col("id") == memory).isEmpty():
            break
    else:
        raise ValueError("remember() found no free id")
    record = {"id": memory, "session_id": session_id, "project": project, "message_start": message_start, "message_end": message_end, "path": path, "anchors": anchors_json(anchors), "summary": summary, "created_at": _now(), "deleted_at": None, "deleted_reason": None}
    seq = (table.agg(F.max("ingest_seq")).first()[0] or 0) + 1
    row = table.sparkSession.createDataFrame([[record.get(c, seq) for c in table.columns]], table.schema)
    return table.unionByName(row), record


def forget(table: DataFrame, id: str, reason: str) -> tuple[DataFrame, dict]:
    """Soft delete; the first reason stands."""
    reason = (reason or "").strip()
    if not id or not reason:
        raise ValueError("forget() requires id and reason")
    row = table.where(F.col("id") == id).select("deleted_at", "deleted_reason").take(1)
    if not row:
        raise ValueError(f"forget() memory not found: {id}")
    if row[0].deleted_at:
        return table, {"id": id, **row[0].asDict(), "already_deleted": True}
    now = _now()
    return _set(table, id, now, reason), {"id": id, "deleted_at": now, "deleted_reason": reason}


def archive(table: DataFrame, id: str, reason: str = "archived") -> DataFrame:
    return _set(table, id, _now(), reason)


def restore(table: DataFrame, id: str) -> DataFrame:
    return _set(table, id, None, None)


def _set(table: DataFrame, id: str, at: str | None, reason: str | None) -> DataFrame:
    own = F.col("id") == id
    return table.withColumn("deleted_at", F.when(own, F.lit(at)).otherwise(F.col("deleted_at"))).withColumn("deleted_reason", F.when(own, F.lit(reason)).otherwise(F.col("deleted_reason")))


def file_text(spark, path: str) -> str | None:
    """A memory's markdown file; None if it can't be read."""
    from tracelake.functions.storage import text_at

    try:
        return text_at(spark, path)
    except Exception:  # noqa: BLE001  a missing or unreadable file of any store
        return None
