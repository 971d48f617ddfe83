"""Line dedup by a segment-partition edit join.

A line of at least MIN_CHARS code points is dropped if it repeats an earlier line of the
corpus with at most EDITS edits (insertions, deletions, substitutions of code points);
earlier means a smaller (doc_id, row, line number). Shorter lines stay, unless exact_short
asks for those that equal an earlier line to be dropped; blank ones always stay.

A line is cut into EDITS + 1 segments of nearly equal length: EDITS edits leave one of them
whole, at nearly its old place. Each line indexes its segments under (its length, the
segment's number, the segment's hash) and probes, for its own and each length up to EDITS
shorter, the substrings that the multi-match-aware windows allow. Lines that meet under one
key are candidates; a candidate is first compared with the earliest line of its group, and
only what this leaves undecided with the group's other earlier lines, block by block. Every
near candidate is verified with a banded bit-parallel edit distance.

Rows with equal doc_id and text are one document and are treated alike; null and empty
texts have no lines; a null doc_id comes first. Extra columns pass through. A text is
rebuilt from the lines that stay; one that loses nothing is returned as it was.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkernel as tk
from .shared import BROADCAST_ROWS, bound_batches, discard, if_small, partitions, stored, unused, written
from .signing import ROWS, chunk_number, packed_rows, told_rows

EDITS = 2
MIN_CHARS = 24
#: Members of a group that are compared as one block.
BLOCK = 2048


def within(a: str, b: str, edits: int) -> bool:
    """Whether the edit distance of a and b is at most `edits`.

    After common ends are cut off, bit j of state e says that the first i - edits + j
    characters of a match the first i of b with e edits; only this band is kept.
    """
    if abs(len(a) - len(b)) > edits:
        return False
    if a == b:
        return True
    low = _common(a, b)
    a, b = a[low:], b[low:]
    high = _common(a[::-1], b[::-1])
    a, b = a[: len(a) - high], b[: len(b) - high]
    if not a or not b or not edits:
        return max(len(a), len(b)) <= edits
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    band = (1 << (2 * edits + 1)) - 1
    states = [((1 << (e + 1)) - 1) << edits for e in range(edits + 1)]
    states = [s & band for s in states]
    for i, c in enumerate(b):
        match = where.get(c, 0)
        match = (match >> (i - edits) if i >= edits else match << (edits - i)) & band
        # the band moves on: position p = i + 1 - edits + j must lie in 0..len(a)
        first = max(0, edits - i - 1)
        inside = (band >> first << first) & ((1 << max(0, len(a) - (i + 1 - edits) + 1)) - 1)
        before, new = 0, 0
        for e in range(edits + 1):
            now = states[e] & match
            if e:
                now |= before | before >> 1 | new << 1
            before, new = states[e], now & inside
            states[e] = new
        if not states[edits]:
            return False
    at = len(a) - len(b) + edits
    return bool(states[edits] >> at & 1)


def _common(a: str, b: str) -> int:
    """The length of the common beginning."""
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while high - low > 1:
        middle = (low + high) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle
    return low


def _segments(length: np.ndarray, edits: int, number: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and size of a line's segment: the last ones are one longer where the length doesn't divide."""
    n = edits + 1
    small, longer = length // n, length % n
    start = number * small + np.maximum(0, number - (n - longer))
    return start, small + (number >= n - longer)


def signatures(hasher: tk.SpanHasher, byte: np.ndarray, start: np.ndarray, length: np.ndarray, edits: int) -> tuple[np.ndarray, np.ndarray]:
    """(signature, line): what each line indexes and probes; byte: where each code point's bytes begin."""
    out, lines = [], []
    line = np.arange(len(start))

    def add(rows, at, size, indexed, number):
        tag = tk.seeded(indexed.astype(np.uint64) * tk.U64(16) + tk.U64(number), 81)
        out.append(tk.mix64(hasher(byte[start[rows] + at], byte[start[rows] + at + size], 82) + tag))
        lines.append(rows)

    for shorter in range(edits + 1):
        indexed = length - shorter
        for number in range(edits + 1):
            at, size = _segments(indexed, edits, number)
            left, right = number, edits - number
            for move in range(max(-left, shorter - right), min(left, shorter + right) + 1):
                fits = (at + move >= 0) & (at + move + size <= length) & (size > 0)
                rows = line[fits]
                # a line's own segments stand among its probes of its own length
                add(rows, (at + move)[fits], size[fits], indexed[fits], number)
    return np.concatenate(out), np.concatenate(lines)


_SPACE = np.array([chr(c).isspace() for c in range(0x3002)])


def _lines(column: pa.Array, least: int, short: bool = False):
    """(code points, start, length, row, number) of the lines that are long enough, numbered from 0 in their row; with short, also of the non-blank shorter ones."""
    cells, offsets = tk.codepoints(column)
    rows = len(offsets) - 1
    breaks = np.flatnonzero(cells == 10)
    start = np.sort(np.concatenate([offsets[:-1], breaks + 1]), kind="stable")
    row = np.searchsorted(offsets[:-1], start, side="right") - 1
    # an empty text shares its offset with the next one: each offset begins its own row's first line
    row = np.sort(np.concatenate([np.arange(rows), np.searchsorted(offsets, breaks, side="right") - 1]), kind="stable")
    count = np.bincount(row, minlength=rows)
    number = np.arange(len(row)) - tk.starts_of(count)[row]
    is_last = number == count[row] - 1
    end = np.where(is_last, offsets[row + 1], np.append(start[1:], len(cells)) - 1)
    length = end - start
    keep = length >= least
    if short:
        solid = np.append(0, np.cumsum(~_SPACE[np.minimum(cells, len(_SPACE) - 1)]))
        keep |= solid[end] > solid[start]
    return cells, start[keep], length[keep], row[keep], number[keep]


def _bytes(column: pa.Array) -> tuple[tk.SpanHasher, np.ndarray]:
    """A hasher of the column's bytes, and where each code point's bytes begin."""
    data, _ = tk.utf8(column)
    return tk.SpanHasher(data), np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))


def _binary(keys: np.ndarray) -> pa.Array:
    """The rows of a table of 16 bytes each as binaries, without a loop."""
    return pa.Array.from_buffers(pa.binary(16), len(keys), [None, pa.py_buffer(keys.tobytes())]).cast(pa.binary())


def _strings(column: pa.Array, start: np.ndarray, length: np.ndarray) -> pa.Array:
    """The lines at these code points as strings, cut from the column's bytes."""
    data, _ = tk.utf8(column)
    byte = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
    cuts = np.stack([byte[start], byte[start + length]], axis=1).ravel().astype(np.int64)
    pieces = pa.Array.from_buffers(pa.large_string(), max(len(cuts) - 1, 0), [None, pa.py_buffer(np.ascontiguousarray(cuts)), pa.py_buffer(np.ascontiguousarray(data))]) if len(cuts) else pa.array([], pa.large_string())
    return pieces.take(pa.array(np.arange(0, len(cuts), 2))).cast(pa.string())


def _signed(docs: DataFrame, edits: int, least: int, buckets: int, exact_short: bool) -> DataFrame:
    member = T.StructType([T.StructField("d", docs.schema["d"].dataType), T.StructField("rk", T.LongType()), T.StructField("no", T.IntegerType()), T.StructField("length", T.IntegerType()), T.StructField("key", T.BinaryType())])
    schema = T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("chunk", T.LongType()), T.StructField("words", T.BinaryType()), T.StructField("members", T.ArrayType(member))])
    names = [f.name for f in member]

    def sign(batches):
        sequence = 0
        for batch in batches:
            for part in tk.chunks(batch, "t", tk.SIGNED_BYTES):
                cells, start, length, row, number = _lines(part.column(2), least, exact_short)
                hasher, byte = _bytes(part.column(2))
                keys = hasher.digests(byte[start], byte[start + length])
                for i in range(0, len(start), ROWS):
                    s = slice(i, i + ROWS)
                    chunk, sequence = chunk_number(sequence), sequence + 1
                    told = pa.StructArray.from_arrays([*(part.column(k).take(pa.array(row[s])) for k in (0, 1)), pa.array(number[s].astype(np.int32)), pa.array(length[s].astype(np.int32)), _binary(keys[s])], names)
                    kind = pa.schema([pa.field("bucket", pa.int32()), pa.field("chunk", pa.int64()), pa.field("words", pa.binary()), pa.field("members", pa.list_(told.type))])
                    yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([chunk], pa.int64()), pa.array([None], pa.binary()), pa.ListArray.from_arrays(pa.array([0, len(told)], pa.int32()), told)], schema=kind)
                    # equal lines of the chunk sign once
                    long = np.flatnonzero(length[s] >= least)
                    _, first = np.unique(keys[s][long].view("V16").ravel(), return_index=True)
                    if not len(first):
                        continue
                    first = long[first]
                    signature, line = signatures(hasher, byte, start[s][first], length[s][first], edits)
                    rows = list(packed_rows(signature, first[line], buckets))
                    n = len(rows)
                    yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in rows], pa.int32()), pa.array([chunk] * n, pa.int64()), tk.binary([w for _, w in rows]), pa.nulls(n, pa.list_(told.type))], schema=kind)

    return docs.mapInArrow(sign, schema)


def _texts(docs: DataFrame, keys: DataFrame, least: int) -> DataFrame:
    """(key, line) of the given keys."""

    def lines(batches):
        for batch in batches:
            for part in tk.chunks(batch, "t"):
                _, start, length, _, _ = _lines(part.column(0), least)
                hasher, byte = _bytes(part.column(0))
                yield pa.RecordBatch.from_arrays([_binary(hasher.digests(byte[start], byte[start + length])), _strings(part.column(0), start, length)], ["key", "line"])

    found = docs.select("t").mapInArrow(lines, "key binary, line string")
    return found.join(if_small(keys), "key", "left_semi").groupBy("key").agg(F.first("line").alias("line"))


def _near(pairs: DataFrame, texts: DataFrame, edits: int) -> DataFrame:
    """The keys b of the pairs (a, b) whose lines are within `edits` edits."""

    def check(batches):
        for batch in batches:
            keep = [within(x, y, edits) for x, y in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0)], ["b"]).filter(pa.array(keep, pa.bool_()))

    x, y = (texts.select(F.col("key").alias(k), F.col("line").alias(f"line_{k}")) for k in "ab")
    return pairs.join(x, "a").join(y, "b").select("b", "line_a", "line_b").mapInArrow(check, "b binary").distinct()


_CELLS = 64


def _histogram(line: str) -> np.ndarray:
    points = np.frombuffer(line.encode("utf-32-le"), np.uint32)
    return np.bincount(points % _CELLS, minlength=_CELLS)


def _near_earlier(open_groups: DataFrame, edits: int, parts: int) -> DataFrame:
    """The keys b of groups (gid, key, first, length, line, late) that have an earlier line within reach; only late rows are asked for.

    A group is cut into blocks of about BLOCK lines, and each pair of blocks is a unit of
    work. Lines whose counts of characters differ too much aren't compared: an edit changes
    two counts by one.
    """
    sizes = open_groups.groupBy("gid").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    rows = open_groups.join(sizes, "gid").withColumn("own", F.pmod(F.xxhash64("key"), "blocks").cast("int"))
    other = F.explode(F.sequence(F.lit(0), (F.col("blocks") - 1).cast("int")))
    rows = rows.withColumn("other", other).select("gid", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "first", "key", "length", "line", "late", "own")

    def check(batches):
        held, unit = [], None

        def flush():
            length = np.array([h[1] for h in held])
            table = np.stack([_histogram(h[2]) for h in held])
            block = np.array([h[4] for h in held])
            found = []
            for k in range(1, len(held)):
                if not held[k][3]:
                    continue
                before = np.flatnonzero((np.abs(length[:k] - length[k]) <= edits) & ((block[:k] != block[k]) | (unit[1] == unit[2])))
                before = before[np.abs(table[before] - table[k]).sum(axis=1) <= 2 * edits]
                if any(within(held[m][2], held[k][2], edits) for m in before.tolist()):
                    found.append(held[k][0])
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(found, pa.binary())], ["b"])

        for batch in batches:
            for gid, i, j, *row in zip(*(batch.column(c).to_pylist() for c in range(8)), strict=True):
                if (gid, i, j) != unit:
                    if held:
                        yield flush()
                    unit = (gid, i, j)
                held.append(row)
        if held:
            yield flush()

    spread = rows.repartition(parts, "gid", "i", "j").sortWithinPartitions("gid", "i", "j", "first")
    return spread.select("gid", "i", "j", "key", "length", "line", "late", "own").mapInArrow(check, "b binary").distinct()


def dropped_lines(docs: DataFrame, edits: int = EDITS, least: int = MIN_CHARS, doc_id: str = "doc_id", text: str = "text", exact_short: bool = False) -> DataFrame:
    """(d, rk, lines): the numbers of the lines to drop, for each document that loses any; rk tells the documents of one doc_id apart."""
    spark = docs.sparkSession
    bound_batches(spark)
    parts = partitions(spark)
    least = max(least, edits + 1)
    own = docs.select(F.col(doc_id).alias("d"), F.xxhash64(doc_id, text).alias("rk"), F.col(text).alias("t"))
    told = stored(told_rows(_signed(own, edits, least, 8 * parts, exact_short), parts))
    lines = told.where("kind = 0").select("chunk", "row", "key", "length", F.struct("d", "rk", "no").alias("pos"))
    groups = told.where("kind = 1").select("gid", "chunk", "row").distinct()
    classes = lines.groupBy("key").agg(F.min("pos").alias("first"), F.count("*").alias("n"), F.first("length").alias("length"))
    met = groups.join(lines.select("chunk", "row", "key"), ["chunk", "row"]).select("gid", "key").distinct()
    several = met.groupBy("gid").agg(F.count("*").alias("m")).where("m > 1").select("gid")
    needed = written()
    met = stored(met.join(several, "gid").join(classes, "key").select("gid", "key", "first", "length"))
    earliest = met.groupBy("gid").agg(F.min(F.struct("first", "key", "length")).alias("e"))
    stars = met.join(earliest, "gid").where(f"key <> e.key and abs(length - e.length) <= {edits}").select(F.col("e.key").alias("a"), F.col("key").alias("b")).distinct()
    texts = stored(_texts(own, met.select("key").distinct(), least))
    near = stored(_near(stars, texts, edits))
    # lines that no group's earliest line explains, against the other earlier lines of their groups
    late = met.join(earliest, "gid").join(near.select(F.col("b").alias("key"), F.lit(True).alias("done")), "key", "left")
    late = late.withColumn("late", F.col("done").isNull() & (F.col("key") != F.col("e.key")))
    asked = late.groupBy("gid").agg(F.max("late").alias("any"), F.count("*").alias("m")).where("any and m > 2").select("gid")
    open_groups = late.join(asked, "gid").join(texts, "key").select("gid", "key", "first", "length", "line", "late")
    near = near.union(_near_earlier(open_groups, edits, parts)).distinct()
    bad = classes.join(near.select(F.col("b").alias("key"), F.lit(True).alias("near")), "key", "left").where("n > 1 or near").select("key", "first", F.coalesce("near", F.lit(False)).alias("near"))
    made = written()
    bad = stored(bad)
    discard(spark, *(made - needed))
    gone = lines.join(if_small(bad), "key").where(F.col("near") | ~F.col("pos").eqNullSafe(F.col("first")))
    return gone.groupBy(F.col("pos.d").alias("d"), F.col("pos.rk").alias("rk")).agg(F.array_sort(F.collect_set("pos.no")).alias("lines"))


def _joined(docs: DataFrame, drops: DataFrame, doc_id: str, text: str) -> DataFrame:
    size = drops.agg(F.count("*"), F.sum(F.size("lines"))).first()
    if size[0] <= BROADCAST_ROWS and (size[1] or 0) <= 4 * BROADCAST_ROWS:
        drops = F.broadcast(drops)
    d, rk, lines = unused(docs, "__d", "__rk", "__lines")
    names = drops.select(F.col("d").alias(d), F.col("rk").alias(rk), F.col("lines").alias(lines))
    return docs.join(names, docs[doc_id].eqNullSafe(F.col(d)) & (F.xxhash64(docs[doc_id], docs[text]) == F.col(rk)), "left").drop(d, rk)


def deduplicated(docs: DataFrame, edits: int = EDITS, least: int = MIN_CHARS, doc_id: str = "doc_id", text: str = "text", exact_short: bool = False) -> DataFrame:
    """docs with the lines that stay, and the columns n_lines, n_dropped and n_left: the non-blank lines that stay in a document that lost any, null in others.

    Columns of docs by these three names are replaced, all others pass through.
    """
    drops = stored(dropped_lines(docs, edits, least, doc_id, text, exact_short))
    joined = _joined(docs, drops, doc_id, text)
    columns = [c for c in docs.columns if c not in ("n_lines", "n_dropped", "n_left")]
    place = columns.index(text)
    schema = T.StructType([*(docs.schema[c] for c in columns), *(T.StructField(c, T.LongType()) for c in ("n_lines", "n_dropped", "n_left"))])

    def rewrite(batches):
        for batch in batches:
            for part in tk.chunks(batch, text):
                n = part.num_rows
                data, offsets = tk.utf8(part.column(place))
                breaks = np.append(0, np.cumsum(data == 10))[offsets]
                total = np.where(np.diff(offsets) > 0, np.diff(breaks) + 1, 0)
                dropped, left = np.zeros(n, np.int64), [None] * n
                lost = part.column(len(columns)).is_valid()
                rows = np.flatnonzero(lost.to_numpy(zero_copy_only=False))
                texts = []
                for r, whole, gone in zip(rows.tolist(), part.column(place).filter(lost).to_pylist(), part.column(len(columns)).filter(lost).to_pylist(), strict=True):
                    drop = set(gone)
                    kept = [x for i, x in enumerate(whole.split("\n")) if i not in drop]
                    texts.append("\n".join(kept))
                    dropped[r], left[r] = len(drop), sum(bool(x.strip()) for x in kept)
                fresh = pc.replace_with_mask(part.column(place), lost, pa.array(texts, part.column(place).type))
                arrays = [fresh if i == place else part.column(i) for i in range(len(columns))]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array(total, pa.int64()), pa.array(dropped), pa.array(left, pa.int64())], schema.names)

    return joined.select(*columns, joined.columns[-1]).mapInArrow(rewrite, schema)


def digests(docs: DataFrame, exact_short: bool = False) -> DataFrame:
    """op6: (doc_id, n_lines, n_dropped, text_sha256) of each row."""
    found = deduplicated(docs.select("doc_id", "text"), exact_short=exact_short)
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def digest_of(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
