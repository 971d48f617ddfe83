"""Raw transcript lines, kept apart from the canonical tables: lookup of a record by what it says."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.functions import predicates as p


def raw_lines(files: DataFrame) -> DataFrame:
    """(path, number, terminated, line) of files (path, content); a last line without an end is not terminated."""
    text = files.select("path", F.split(F.decode("content", "utf-8"), "\n").alias("ls"))
    rows = text.select("path", F.size("ls").alias("n"), F.posexplode("ls").alias("at", "line"))
    return rows.where((F.col("at") < F.col("n") - 1) | (F.col("line") != "")).select("path", (F.col("at") + 1).alias("number"), (F.col("at") < F.col("n") - 1).alias("terminated"), "line")


def raw_windows(lines: DataFrame, wanted: DataFrame, offset: int = 0, limit: int | None = None) -> DataFrame:
    """(uuid, path, number, length, text): the window of the first raw line that names each wanted uuid as its own."""
    n = p.limit_of(limit, 10_000)
    start = p.limit_of(offset, 0, "offset")
    named = lines.withColumn("uuid", F.get_json_object("line", "$.uuid")).where("uuid is not null")
    found = named.join(wanted.select("uuid").distinct(), "uuid", "left_semi")
    first = found.groupBy("uuid").agg(F.min_by(F.struct("path", "number", "line"), F.struct("path", "number")).alias("r"))
    return first.select("uuid", "r.path", "r.number", F.char_length("r.line").alias("length"), F.expr(f"substring(r.line, {start + 1}, {n})").alias("text"))


def unreadable(lines: DataFrame) -> DataFrame:
    """(path, number, line) of the ended, non-blank raw lines that aren't JSON objects: what parsers of line sources pass over."""
    kind = F.schema_of_variant(F.try_parse_json("line"))
    return lines.where(F.col("terminated") & (F.trim("line") != "") & ~F.coalesce(F.startswith(kind, F.lit("OBJECT")), F.lit(False))).select("path", "number", "line")
