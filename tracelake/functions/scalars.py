"""Scalar functions over transcript fields."""

from __future__ import annotations

import functools
import posixpath
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracelake.functions.predicates import as_column

BODY_CHARS = 10_000
_ZONED = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(:\d{2})?(\.\d+)?(Z|[+-]\d{2}:?\d{2})$"
#: Tools whose input names a file.
FILE_TOOLS = ("Read", "Edit", "Write", "NotebookEdit")


def truncated(text, limit: int | None = BODY_CHARS) -> Column:
    """The first `limit` code points (an astral character counts once); None keeps all."""
    return as_column(text) if limit is None else F.substring(as_column(text), 1, limit)


def canonical_timestamp(text) -> Column:
    """A zoned ISO time as UTC with milliseconds; what has no zone or can't be read stays; '' is null."""
    c = as_column(text)
    read = F.date_format(F.try_to_timestamp(c), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return F.when(c == "", F.lit(None)).when(c.rlike(_ZONED), F.coalesce(read, c)).otherwise(c)


def normalized_cwd(path) -> Column:
    """An absolute path without empty, `.` and `..` parts; an ending slash stays; null for what isn't absolute."""
    c = as_column(path)
    parts = F.filter(F.split(c, "/"), lambda x: ~x.isin("", "."))
    stack = F.aggregate(parts, F.array().cast("array<string>"), lambda a, x: F.when(x == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(x))))
    whole = F.concat(F.lit("/"), F.array_join(stack, "/"))
    return F.when(F.startswith(c, F.lit("/")), F.when(c.rlike("/$") & (whole != "/"), F.concat(whole, F.lit("/"))).otherwise(whole))


def slug_from_path(path) -> Column:
    """/a/b -> -a-b, for absolute paths, normalized"""
    c = normalized_cwd(path)
    return F.concat(F.lit("-"), F.regexp_replace(F.regexp_replace(c, r"^[\\/]+", ""), r"[\\/]+", "-"))


def slug_of(path: str | None) -> str | None:
    """slug_from_path of one path."""
    if not path or not path.startswith("/"):
        return None
    whole = posixpath.normpath("/" + path.lstrip("/")) + ("/" if path.endswith("/") and path.strip("/") else "")
    return "-" + re.sub(r"[\\/]+", "-", re.sub(r"^[\\/]+", "", whole))


def folded_tokens(*parts) -> Column:
    """The sum of token counts; null only if every part is."""
    columns = [as_column(p) for p in parts]
    none = functools.reduce(lambda a, b: a & b, (c.isNull() for c in columns))
    return F.when(~none, functools.reduce(lambda a, b: a + b, (F.coalesce(c, F.lit(0)) for c in columns)))


def text_of_blocks(blocks) -> Column:
    """The text and thinking blocks of array<struct<type, text, thinking>>, one per line; null without any."""
    said = F.transform(as_column(blocks), lambda b: F.when(b["type"] == "text", b["text"]).when(b["type"] == "thinking", b["thinking"]))
    parts = F.filter(said, lambda x: x.isNotNull() & (x != ""))
    return F.when(F.size(parts) > 0, F.array_join(parts, "\n"))


def content_type_of_blocks(blocks) -> Column:
    """The only known block type, else unknown."""
    kinds = F.array_distinct(F.transform(as_column(blocks), lambda b: b["type"]))
    first = F.get(kinds, F.lit(0))
    return F.when((F.size(kinds) == 1) & first.isin("text", "thinking", "tool_use", "tool_result"), first).otherwise("unknown")


def file_path_of(name, input_json) -> Column:
    return F.when(as_column(name).isin(*FILE_TOOLS), F.get_json_object(as_column(input_json), "$.file_path"))


#: How the rows that a harness writes under the user's role begin.
INTERRUPTION = r"^\s*\[Request interrupted by user(?: for tool use)?\]\s*$"
COMMAND = r"^\s*(?:<command-name>[^<]+</command-name>|<local-command(?:\b|-))"
REMINDER = r"^\s*<system-reminder\b"
NOTIFICATION = r"^\s*<task-notification\b"
SKILL = r"^\s*Base directory for this skill(?:\s*:|\s*\r?\n)"


def harness_kind(text, is_meta, compacted: Column | None = None, interrupted: Column | None = None) -> Column:
    """What kind of harness row a message is: by its flags, then by how its text begins; null for ordinary rows."""
    c = as_column(text)
    out = F.when(F.coalesce(compacted, F.lit(False)) if compacted is not None else F.lit(False), "compaction")
    out = out.when((F.coalesce(interrupted, F.lit(False)) if interrupted is not None else F.lit(False)) | c.rlike(INTERRUPTION), "interruption")
    out = out.when(c.rlike(COMMAND), "command").when(c.rlike(REMINDER), "reminder").when(c.rlike(NOTIFICATION), "notification")
    meta = F.coalesce(as_column(is_meta), F.lit(0)) == 1
    return out.when(meta & c.rlike(SKILL), "skill").when(meta, "other")


def scoped_id(prefix: str, *parts) -> Column:
    return F.concat_ws(":", F.lit(prefix), *(as_column(p) for p in parts))


def line_id(prefix: str, thread, line) -> Column:
    """prefix:thread:000012"""
    return F.concat_ws(":", F.lit(prefix), as_column(thread), F.lpad(as_column(line).cast("string"), 6, "0"))


def fingerprint(*columns) -> Column:
    """One SHA-256 of a group's rows, whatever their order."""
    return F.sha2(F.to_json(F.array_sort(F.collect_list(F.struct(*columns)))), 256)


def row_hash(*columns) -> Column:
    return F.xxhash64(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}))


def highlighted(text, needle: str, before: str = "<mark>", after: str = "</mark>") -> Column:
    """Every literal occurrence, case ignored, between the marks."""
    import re

    escaped = re.sub(r"([\\.^$|?*+(){}\[\]])", r"\\\1", needle)
    return F.regexp_replace(as_column(text), f"(?i)({escaped})", f"{before}$1{after}") if needle else as_column(text)


def shown_tokens(n) -> Column:
    """1.2M, 3.4k, 17"""
    c = as_column(n)
    return F.when(c >= 1_000_000, F.concat(F.format_string("%.1f", c / 1e6), F.lit("M"))).when(c >= 1000, F.concat(F.format_string("%.1f", c / 1e3), F.lit("k"))).otherwise(c.cast("string"))


def shown_duration(ms) -> Column:
    """1h 2m, 3m 4s, 5.6s"""
    s = F.floor(as_column(ms) / 1000)
    hours, minutes = F.floor(s / 3600), F.floor(s / 60) % 60
    return F.when(s >= 3600, F.format_string("%dh %dm", hours, minutes)).when(s >= 60, F.format_string("%dm %ds", minutes, s % 60)).otherwise(F.format_string("%.1fs", as_column(ms) / 1000))
