"""Read-only SQL: one query over the canonical tables, bound parameters, no commands."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame

from tracelake.plans import schema


class ReadOnlyError(ValueError):
    pass


def _plan(spark, text: str):
    return spark._jsparkSession.sessionState().sqlParser().parsePlan(text)


def tail_is_blank(text: str) -> bool:
    """Whether what follows a statement's end is white space and comments only."""
    text = re.sub(r"/\*.*?(\*/|\Z)", " ", text, flags=re.S)
    return all(not line.split("--", 1)[0].strip() for line in text.splitlines())


#: Nodes of a parsed statement that aren't queries.
_COMMANDS = re.compile(r"(Command|Statement|^Create|^Drop|^Insert|^Replace|^Alter|^Set|^Delete|^Update|^Merge|^Truncate|^Show|^Describe|^Add|^Load|^Cache|^Uncache|^Refresh|^Overwrite|^Append|^Use|^Explain|^Analyze|^Call|^Execute|^Declare)")


def check(spark, text: str) -> None:
    """Raises ReadOnlyError unless text is one SELECT or WITH query."""
    if not re.match(r"\s*(--[^\n]*\n\s*|/\*.*?\*/\s*)*\(*\s*(select|with)\b", text, flags=re.I | re.S):
        raise ReadOnlyError("only SELECT or WITH statements are allowed")
    try:
        plan = _plan(spark, text)
    except Exception as e:
        raise ReadOnlyError(f"not a single query: {str(e).splitlines()[0][:200]}") from e
    todo = [plan]
    while todo:
        node = todo.pop()
        if _COMMANDS.search(node.getClass().getSimpleName()):
            raise ReadOnlyError(f"{node.getClass().getSimpleName()} is not allowed")
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]


def read_only(tables, text: str, params: list | None = None) -> DataFrame:
    """The query's rows; canonical tables are visible under their names, `?` are bound in order.

    The tables are registered in a session of their own, so that neither the caller's views
    nor another query's can be seen or changed.
    """
    spark = tables.spark
    check(spark, text)
    own = spark.newSession()
    for name in schema.TABLES:
        if re.search(rf"\b{name}\b", text):
            stored = f"_{name}_{uuid.uuid4().hex}"
            getattr(tables, name).createOrReplaceGlobalTempView(stored)
            own.table(f"global_temp.{stored}").createOrReplaceTempView(name)
    return own.sql(text, args=params or [])
