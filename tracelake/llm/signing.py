"""Candidate search by signatures: packing, bucketing, and the groups of rows that share one.

A signature travels as 48 bits of hash and 16 bits of row number in its chunk, in rows of
one hash bucket and one chunk each. The lowest bit of a signature is its family, which its
group's gid keeps as its own lowest bit. What a chunk tells of its rows travels beside them, so
that the texts are read once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkernel as tk

_LOW16 = tk.U64(0xFFFF)
#: Rows of a chunk that one set of packed words can number.
ROWS = 1 << 16


def packed_rows(signature: np.ndarray, row: np.ndarray, buckets: int):
    """(bucket, words): signatures by bucket; a word is 48 bits of signature and 16 of row."""
    if not len(signature):
        return
    bucket = (signature >> tk.U64(48)) * tk.U64(buckets) >> tk.U64(16)
    order = np.argsort(bucket.astype(np.uint32), kind="stable")
    words = ((signature << tk.U64(16)) | row.astype(np.uint64))[order]
    bucket = bucket[order]
    start = np.flatnonzero(np.diff(bucket, prepend=bucket[:1] ^ tk.U64(1)))
    for a, b in zip(start, np.append(start[1:], len(words)), strict=True):
        yield int(bucket[a]), words[a:b]


GROUPS = T.StructType([T.StructField("kind", T.IntegerType()), T.StructField("gid", T.LongType()), T.StructField("times", T.IntegerType()), T.StructField("chunk", T.LongType()), T.StructField("row", T.IntegerType())])


def shared_groups(chunk: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(gid, times, chunk, row) of the signatures that two rows or more have; equal groups are told once, with their number."""
    sig = words >> tk.U64(16)
    order = np.argsort(sig, kind="stable")
    sig, chunk, row = sig[order], chunk[order], (words[order] & _LOW16).astype(np.int64)
    start = np.flatnonzero(np.diff(sig, prepend=sig[:1] ^ tk.U64(1))) if len(sig) else np.zeros(0, np.int64)
    size = np.diff(np.append(start, len(sig)))
    many = np.repeat(size > 1, size)
    family = sig[start][size > 1] & tk.U64(1)
    size = size[size > 1]
    chunk, row = chunk[many], row[many]
    member = tk.seeded(chunk.astype(np.uint64) * tk.U64(0x10001) + row.astype(np.uint64), 61)
    gid = tk.mix64(tk.segment_sum(member, tk.starts_of(size)) + size.astype(np.uint64)) & ~tk.U64(1) | family
    _, told, times = np.unique(gid, return_index=True, return_counts=True)
    each = np.zeros(len(gid), np.int32)
    each[told] = times
    each = np.repeat(each, size)
    keep = each > 0
    return np.repeat(gid, size)[keep].view(np.int64), each[keep], chunk[keep], row[keep].astype(np.int32)


def chunk_number(sequence: int) -> int:
    return (TaskContext.get().partitionId() << 32) | sequence


def told_rows(signed: DataFrame, parts: int) -> DataFrame:
    """The rows of members (kind 0) and of groups (kind 1), by one shuffle of what was signed.

    signed has rows (bucket, chunk, words) and one row (chunk, members) per chunk, with
    bucket -1; one bucket's words are in memory at a time.
    """
    fields = signed.schema["members"].dataType.elementType.fields
    schema = T.StructType([*GROUPS.fields, *fields])

    def split(batches):
        held: list[tuple[int, int, bytes]] = []
        kinds = None

        def flush():
            words = [np.frombuffer(w, np.uint64) for _, _, w in held]
            chunk = np.repeat(np.array([c for _, c, _ in held], np.int64), [len(w) for w in words])
            found = shared_groups(chunk, np.concatenate(words))
            held.clear()
            for i in range(0, len(found[0]), 100_000):
                some = [x[i : i + 100_000] for x in found]
                m = len(some[0])
                yield pa.RecordBatch.from_arrays([pa.array(np.ones(m, np.int32)), *map(pa.array, some), *(pa.nulls(m, t) for t in kinds)], schema.names)

        for batch in batches:
            inner = batch.column(3).type.value_type
            kinds = kinds or [inner.field(i).type for i in range(len(fields))]
            buckets = batch.column(0).to_pylist()
            for i, (bucket, chunk, words) in enumerate(zip(buckets, batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                if bucket < 0:
                    rows = batch.column(3).slice(i, 1).flatten()
                    m = len(rows)
                    yield pa.RecordBatch.from_arrays([pa.array(np.zeros(m, np.int32)), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int32()), pa.array(np.full(m, chunk, np.int64)), pa.array(np.arange(m, dtype=np.int32)), *rows.flatten()], schema.names)
                    continue
                if held and held[-1][0] != bucket:
                    yield from flush()
                held.append((bucket, chunk, words))
        if held:
            yield from flush()

    # rows about documents go by their chunk, signatures by their bucket
    key = F.when(F.col("bucket") < 0, F.hash("chunk")).otherwise(F.col("bucket"))
    spread = signed.repartition(parts, key).sortWithinPartitions("bucket")
    return spread.mapInArrow(split, schema)
