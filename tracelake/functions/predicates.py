"""Rules that every operator shares: visibility, meta rows, sources, scopes, literal matches."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: YYYY-MM-DDTHH:mm:ss.sssZ
CANONICAL_TIMESTAMP = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d{3}Z$"
NOISE_PROJECT = r"(?i)^(od-conn-test|[0-9a-f]{6,})"


def as_column(c) -> Column:
    return c if isinstance(c, Column) else F.col(c)


def is_visible(visibility="visibility", include_inactive: bool = False) -> Column:
    """Null counts as visible; hidden and unknown values never pass."""
    v = F.coalesce(as_column(visibility), F.lit("visible"))
    return v.isin("visible", "inactive") if include_inactive else v == "visible"


def shown_visibility(visibility="visibility") -> Column:
    v = as_column(visibility)
    return F.when(v.isNull(), "visible").when(v.isin("visible", "inactive", "hidden"), v).otherwise("hidden")


def either_inactive(a: Column, b: Column) -> Column:
    """inactive if one of two joined rows is; a missing row counts as visible."""
    return F.when((shown_visibility(a) == "inactive") | (shown_visibility(b) == "inactive"), "inactive").otherwise("visible")


def not_meta(is_meta="is_meta") -> Column:
    return F.coalesce(as_column(is_meta), F.lit(0)) == 0


def source_of(*columns) -> Column:
    return F.coalesce(*map(as_column, columns), F.lit("claude"))


def source_is(source: str | None, *columns) -> Column:
    """Helper rule: no source, or 'all', lets every row pass."""
    return F.lit(True) if source in (None, "all") else source_of(*(columns or ("source",))) == source


def app_source_is(source: str | None, column="source") -> Column:
    """App rule: no source means claude only; 'all' lets every row pass."""
    return source_is(source or "claude", column)


def like_nocase(column, pattern: str) -> Column:
    """LIKE without regard to case."""
    return as_column(column).ilike(pattern)


def literal_in(column, text: str) -> Column:
    """Whether the column holds the text as it is or as JSON spells it, ASCII case folded."""
    import json

    spelled = json.dumps(text, ensure_ascii=False)[1:-1]
    c = F.lower(as_column(column))
    return F.contains(c, F.lit(text.lower())) | F.contains(c, F.lit(spelled.lower()))


def catalogue_contains(query: str, *columns) -> Column:
    """Whether one of the columns holds the text, case folded; nulls hold nothing."""
    needle = F.lower(F.lit(query))
    out = F.lit(False)
    for c in columns:
        out = out | F.coalesce(F.contains(F.lower(as_column(c)), needle), F.lit(False))
    return out


def scope(
    columns: dict[str, str], *, session_id: str | None = None, sessions: Iterable[str] = (), project: str | None = None, after: str | None = None,
    before: str | None = None, branch: str | None = None, source: str | None = None,
) -> list[Column]:
    """Predicates of the scope options over the columns of an alias map.

    Time bounds are exclusive comparisons of text; `after_column` and `before_column` of
    the map serve rows that are intervals. A column that the map lacks has no predicate.
    """
    out = []

    def on(name: str) -> Column | None:
        return F.col(columns[name]) if name in columns else None

    if session_id is not None and on("session_id") is not None:
        out.append(on("session_id") == session_id)
    sessions = list(sessions)
    if sessions and on("session_id") is not None:
        out.append(on("session_id").isin(sessions))
    if project is not None and on("project") is not None:
        out.append(like_nocase(on("project"), project))
    low = on("after") if "after" in columns else on("timestamp")
    high = on("before") if "before" in columns else on("timestamp")
    if after is not None and low is not None:
        out.append(low > after)
    if before is not None and high is not None:
        out.append(high < before)
    if branch is not None and on("branch") is not None:
        out.append(on("branch") == branch)
    if source not in (None, "all") and on("source") is not None:
        out.append(source_of(on("source")) == source)
    return out


def limit_of(value: int | None, default: int, label: str = "limit") -> int:
    n = default if value is None else int(value)
    if n < 0:
        raise ValueError(f"{label} must be non-negative (got {n})")
    return n


def is_failure(is_error="is_error", content="content") -> Column:
    return F.coalesce(as_column(is_error) == 1, F.lit(False)) | F.coalesce(as_column(content).ilike("Exit code %"), F.lit(False))


def is_canonical(timestamp="timestamp") -> Column:
    return F.coalesce(as_column(timestamp).rlike(CANONICAL_TIMESTAMP), F.lit(False))


def overlaps(start, end, low: str, high: str) -> Column:
    """Whether [start, end or start] meets [low, high)."""
    return (as_column(start) < high) & (F.coalesce(as_column(end), as_column(start)) >= low)


def on_main_timeline(agent_id="agent_id", session_id="session_id") -> Column:
    a = as_column(agent_id)
    return a.isNull() | (a == as_column(session_id))


def is_titled(title="title") -> Column:
    return F.coalesce(as_column(title) != "", F.lit(False))


def project_label(path="project_path", project="project") -> Column:
    """The last part of the path, else the project's slug without its first dash."""
    last = F.element_at(F.filter(F.split(as_column(path), "/"), lambda x: x != ""), -1)
    return F.coalesce(F.when(F.size(F.filter(F.split(as_column(path), "/"), lambda x: x != "")) > 0, last), F.regexp_replace(as_column(project), "^-", ""))


def is_noise(title="title", path="project_path", project="project") -> Column:
    return ~is_titled(title) | F.coalesce(project_label(path, project).rlike(NOISE_PROJECT), F.lit(False))
