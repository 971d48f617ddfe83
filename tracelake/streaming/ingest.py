"""Continuous ingest: new transcript files in micro-batches, merged once each into the versioned store.

The file source finds new files; a batch's units are parsed, its records merged, and the
result is published under the batch's id, so a batch that is run again after a failure
changes nothing. Retractions are records of the batch (deletes as barriers), which an
append-only sink couldn't express. A batch's files bring all files of their units with them,
as a unit is parsed whole. A file that grows is seen by `reconcile`, a bounded re-read of
the units whose time or size has changed since the stored cursor.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

import tracelake.sources  # noqa: F401  registers the sources
from tracelake.functions.storage import written
from tracelake.operators import merge
from tracelake.sources import base

FILE = "path string, modificationTime timestamp, length long, content binary"


def stream_files(spark: SparkSession, root: str, per_batch: int = 1000) -> DataFrame:
    return spark.readStream.format("binaryFile").schema(FILE).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", per_batch).load(root)


def merge_files(store: merge.Store, found: DataFrame, batch: str) -> int:
    """Parses the files of all sources in found (path, modified, size, content) and publishes the merged tables; units that can't be read are left out and told in index_state."""
    return store.merge(base.parsed(found, on_error="skip"), batch)


def ingest(spark: SparkSession, root: str, store: merge.Store, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Starts the query; with trigger={'availableNow': True} it ends after what is there now."""

    def sink(batch: DataFrame, number: int) -> None:
        sources = list(base.REGISTRY.values())
        units = written(base.owned(batch.select("path"), sources).select("source", "unit").distinct())
        merge_files(store, base.files_of(base.files(spark, root, *sources), units, sources), f"stream-{number}")

    return stream_files(spark, root).writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "1 second"})).start()


def reconcile(spark: SparkSession, root: str, store: merge.Store, batch: str, on_error: str = "skip", retry: bool = False) -> int:
    """Merges the units of which a file is new, changed or gone since its cursor; a number of the current version if none is.

    Units are read whole, so what a session had before and the new reading doesn't have goes:
    the messages cut off from a file, and a session whose files are gone. A unit that can't be
    read is skipped: its sessions stay as they were, its files' cursors say why, and it's read
    again when one of its files changes or with `retry`; on_error="stop" raises instead.
    """
    sources = list(base.REGISTRY.values())
    tables = store.tables()
    state = tables["index_state"]
    if retry:
        state = state.withColumn("cursor", F.when(F.coalesce("replay_required", F.lit(0)) == 0, F.col("cursor")))
    found = base.files(spark, root, *sources)
    units = written(base.changed_units(found, state, *sources))
    if units.isEmpty():
        return (store.version() or (0, ""))[0]
    records = base.parsed(base.files_of(found, units, sources), on_error=on_error)
    units = units.join(records["failures"], ["source", "unit"], "left_anti")
    held = base.owned(state.select(F.col("jsonl_path").alias("path")), sources).join(units, ["source", "unit"], "left_semi").select("path").distinct()
    told = tables["sessions"].join(held, F.col("jsonl_path") == F.col("path"), "left_semi").select(F.col("id").alias("session_id"))
    again = records["sessions"].select(F.col("id").alias("session_id")).unionByName(told).unionByName(records["messages"].select("session_id"))
    gone = held.join(found.select("path"), "path", "left_anti").select(F.col("path").alias("jsonl_path"))
    return store.merge({**records, "again": again, "forgotten": gone}, batch)
