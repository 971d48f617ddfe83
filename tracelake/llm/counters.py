"""Additive count vectors over a whole table, summed without ever holding a group in memory."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import bound_batches, partitions

BLOCK = 2048


def summed(rows: DataFrame, count: Callable[[Iterable[pa.RecordBatch], dict[str, np.ndarray]], None], size: int) -> dict[str, np.ndarray]:
    """The sums over all partitions of the int64 vectors of `size` cells that `count` fills, by name.

    Each task sends its vectors in blocks of BLOCK cells; the blocks of a name are read in
    order and added up as a stream. The driver gets one vector per name, however large the
    table is.
    """

    bound_batches(rows.sparkSession)

    def partial(batches):
        totals: dict[str, np.ndarray] = {}
        count(batches, totals)
        for name, vector in totals.items():
            for i in range(0, size, BLOCK):
                block = vector[i : i + BLOCK]
                if block.any():
                    yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([i], pa.int32()), pa.array([block.astype(np.int64).tobytes()], pa.binary())], ["name", "at", "cells"])

    def add(batches):
        key, total = None, None
        for batch in batches:
            for name, at, cells in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if (name, at) != key:
                    if key is not None:
                        yield pa.RecordBatch.from_arrays([pa.array([key[0]]), pa.array([key[1]], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["name", "at", "cells"])
                    key, total = (name, at), np.zeros(len(cells) // 8, np.int64)
                total += np.frombuffer(cells, np.int64)
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key[0]]), pa.array([key[1]], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["name", "at", "cells"])

    schema = "name string, at int, cells binary"
    parts = rows.mapInArrow(partial, schema).repartition(partitions(rows.sparkSession), "name", "at").sortWithinPartitions("name", "at").mapInArrow(add, schema)
    found: dict[str, np.ndarray] = {}
    for r in parts.collect():
        found.setdefault(r["name"], np.zeros(size, np.int64))[r["at"] : r["at"] + len(r["cells"]) // 8] = np.frombuffer(r["cells"], np.int64)
    return found
