"""Token usage as a time series: days, weeks, running totals, streaks, a heatmap."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def usage_rows(messages: DataFrame, summaries: DataFrame, source: str | None = None) -> DataFrame:
    """(timestamp, tokens) of every row that has usage, whatever its visibility."""
    from tracelake.functions import predicates as p

    both = messages.where(p.source_is(source)).select("timestamp", "input_tokens", "output_tokens").unionByName(summaries.select("timestamp", "input_tokens", "output_tokens"))
    both = both.where("input_tokens is not null or output_tokens is not null")
    return both.select("timestamp", (F.coalesce("input_tokens", F.lit(0)) + F.coalesce("output_tokens", F.lit(0))).alias("tokens"))


def per_day(rows: DataFrame) -> DataFrame:
    """(day, tokens) with a null day for rows without a readable time; days are UTC days."""
    return rows.groupBy(F.to_date(F.try_to_timestamp("timestamp")).alias("day")).agg(F.sum("tokens").alias("tokens"))


def daily(rows: DataFrame) -> DataFrame:
    return per_day(rows).where("day is not null").select(F.date_format("day", "yyyy-MM-dd").alias("day"), "tokens").orderBy("day")


def totals(rows: DataFrame) -> DataFrame:
    """One row: all tokens (rows without a day too), and the first day with the most."""
    days = per_day(rows)
    best = F.max_by(F.struct(F.date_format("day", "yyyy-MM-dd").alias("day"), "tokens"), F.when(F.col("day").isNotNull() & (F.col("tokens") > 0), F.struct("tokens", (-F.unix_date("day")).alias("early"))))
    return days.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("total_tokens"), best.alias("best")).select("total_tokens", F.col("best.day").alias("peak_day"), F.col("best.tokens").alias("peak_tokens"))


def longest_turn(messages: DataFrame) -> DataFrame:
    return messages.where("turn_duration_ms is not null").orderBy(F.desc("turn_duration_ms"), "uuid").limit(1).select("uuid", "session_id", "turn_duration_ms")


def weekly(days: DataFrame) -> DataFrame:
    """(week, tokens) of weeks that begin on Monday."""
    return days.groupBy(F.date_format(F.date_trunc("week", F.to_date("day")), "yyyy-MM-dd").alias("week")).agg(F.sum("tokens").alias("tokens")).orderBy("week")


def cumulative(days: DataFrame) -> DataFrame:
    """(day, tokens, running). One row per day, so that the global window stays small."""
    return days.withColumn("running", F.sum("tokens").over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)))


def islands(days: DataFrame) -> DataFrame:
    """(first, last, length) of each run of consecutive active days."""
    active = days.where("tokens > 0").select(F.to_date("day").alias("d")).distinct()
    start = F.date_sub("d", F.row_number().over(Window.orderBy("d")))
    return active.withColumn("island", start).groupBy("island").agg(F.min("d").alias("first"), F.max("d").alias("last"), F.count("*").alias("length")).drop("island")


def streaks(days: DataFrame, today: str, window: int = 365) -> DataFrame:
    """One row: the longest run of active days, and the run that ends last, at most `window` days before today.

    Days without tokens between that run and today don't break it.
    """
    end = F.lit(today).cast("date")
    runs = islands(days.where(F.col("day") <= today))
    oldest = F.date_sub(end, window)
    recent = runs.where(F.col("last") >= oldest).agg(F.max_by(F.struct("first", "last"), "last").alias("r"))
    current = recent.select(F.coalesce(F.datediff("r.last", F.greatest(F.col("r.first"), oldest)) + 1, F.lit(0)).cast("long").alias("current"))
    return islands(days).agg(F.coalesce(F.max("length"), F.lit(0)).alias("longest")).join(current)


def heatmap(days: DataFrame, today: str, size: int = 371) -> DataFrame:
    """(day, tokens, level 0..4) of each of the `size` days up to the Saturday of today's week."""
    last = datetime.date.fromisoformat(today)
    last += datetime.timedelta(days=(5 - last.weekday()) % 7)
    first = last - datetime.timedelta(days=size - 1)
    grid = days.sparkSession.sql(f"select explode(sequence(date'{first}', date'{last}')) as d")
    joined = grid.join(days.select(F.to_date("day").alias("d"), "tokens"), "d", "left").withColumn("tokens", F.coalesce("tokens", F.lit(0)))
    most = F.max("tokens").over(Window.partitionBy())
    level = F.when(F.col("tokens") > 0, F.least(F.lit(4), F.ceil(F.col("tokens") / most * 4))).otherwise(0)
    return joined.select(F.date_format("d", "yyyy-MM-dd").alias("day"), "tokens", level.cast("long").alias("level")).orderBy("day")
