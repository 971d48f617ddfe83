"""N-gram Jaccard join by PartEnum signatures.

A document's set holds the hashes of its distinct word shingles. Sizes are cut into bands
l_0 < l_1 < ... of ratio RATIO; two sets with Jaccard similarity t or more, of which the
smaller one has its size in band i, differ in at most k elements, with k known from the
sizes. For each band the hash domain is partitioned into n_i parts, and each part into RANGES
second-level ranges. More than k / 2 parts that two sets both reach can't all hold two
differences or more, so one of them holds at most one, which lies in one range: the sets agree on
the part's other ranges. A set therefore signs, for each part, each subset of RANGES - 1 of its ranges
(its elements in them, hashed together): the signature covers several elements, and dissimilar
sets seldom agree on all of them. A part counts for this guarantee if the set has elements in two of its
ranges at least, so that whichever range differs, what is left isn't empty. A set signs
for its own band and for each lower band whose sets can be similar to it.

A set with too few such parts (mostly small ones) also signs each single element; two sets
of that kind meet there, as similar sets share t of their elements at least.

Similar sets share more than one signature: c = (parts that count) - floor(k / 2), or t
times their size of the single ones. Frequent passages give signatures that very many
dissimilar sets share; each set leaves out its most frequent signatures, c - 1 at most, in
one order for all sets: the rarest signature that a pair shares then stays with both, so no
pair is lost.

Signatures travel as packed words (48 bits of hash, 16 bits of row number in the chunk),
grouped by hash bucket, so that a shuffled row holds hundreds of them. Documents with equal
sets become one class before any comparison. Candidates are first linked as stars: each
class with that smallest class of its groups with which it shares the most signatures. Only groups that
this leaves in different components are looked at again: their classes' sets are brought together in
bounded blocks, where every pair of different components is decided exactly, and what leaves a block is
a spanning forest of its links, never its pairs. Before a star is verified, a histogram of 256
cells must allow it: the sum of the cells' differences is a lower bound of the number of
differing elements.

Shingle hashes have 48 bits: two different shingles of one document, or of one pair, are
taken for one with a probability of about size^2 / 2^49 (6e-10 for 600 shingles).
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkernel as tk
from .shared import bound_batches, components, discard, if_small, partitions, stored, written
from .signing import chunk_number, packed_rows, told_rows

WORDS = 5
#: Similarity as a fraction of whole numbers, compared without rounding.
THRESHOLD = (75, 100)
RATIO = 1.5
#: Second-level ranges of a part; a signature leaves out one of them.
RANGES = 3
#: Parts for each element of a band's smallest set.
PARTS = 0.34
#: Classes and elements that are compared as one block.
BLOCK = 1024
BLOCK_ELEMENTS = 500_000


def bands(threshold: tuple[int, int], largest: int) -> tuple[np.ndarray, np.ndarray]:
    """Lower bounds of the bands, one more than there are bands, and each band's number of parts."""
    p, q = threshold
    low, parts = [1], []
    while low[-1] <= largest:
        low.append(max(low[-1] + 1, math.floor(low[-1] * RATIO)))
        x = low[-1] - 1  # the largest size of the band
        k = int(_most(np.array([x + x * q // p]), threshold)[0])
        parts.append(max(k // 2 + 1, math.ceil(PARTS * low[-2])))
    return np.array(low, np.int64), np.array(parts, np.int64)


def _most(total: np.ndarray, threshold: tuple[int, int]) -> np.ndarray:
    """The most differing elements of a similar pair whose sizes add up to `total` or less."""
    p, q = threshold
    step = 2 * (p + q) // math.gcd(p, q)
    return np.max([np.maximum(total - i, 0) - 2 * -(-p * np.maximum(total - i, 0) // (p + q)) for i in range(step)], axis=0)


def shingle_sets(column: pa.Array, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct shingle hashes (48 bits, ascending), end to end, and their numbers."""
    hashes, counts = tk.word_hashes(column, tk.NOT_SPACE)
    per_row = np.where(counts >= words, counts - words + 1, np.minimum(counts, 1))
    row = tk.row_of(per_row)
    start = tk.starts_of(counts)[row] + np.arange(len(row)) - tk.starts_of(per_row)[row]
    size = np.minimum(counts, words)[row]
    total = np.zeros(len(row), np.uint64)
    for i in range(words):
        live = i < size
        total += np.where(live, tk.seeded(hashes[np.minimum(start + i, max(len(hashes) - 1, 0))], 100 + i), tk.U64(0)) if len(hashes) else total
    total = tk.mix64(total + size.astype(np.uint64))
    packed = np.sort(row.astype(np.uint64) << tk.U64(48) | total >> tk.U64(16))
    packed = packed[np.flatnonzero(np.diff(packed, prepend=packed[:1] ^ tk.U64(1)))] if len(packed) else packed
    return packed & tk.U64((1 << 48) - 1), np.bincount((packed >> tk.U64(48)).astype(np.int64), minlength=len(counts))


def signatures(elements: np.ndarray, counts: np.ndarray, threshold: tuple[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(signature, row) of each row's set, and how many signatures of ranges a row shares at least with a similar row, unless both sign single elements.

    The lowest bit tells the signatures of single elements from those of ranges.
    """
    least = np.full(len(counts), 1 << 30, np.int64)
    if not len(elements):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.ones(len(counts), np.int64)
    p, q = threshold
    low, parts = bands(threshold, int(counts.max()))
    own = np.searchsorted(low, counts, side="right") - 1
    mixed = tk.seeded(elements, 31)
    first = tk.starts_of(counts)
    poor = np.zeros(len(counts), bool)
    out_s, out_r = [], []
    for back in range(len(parts)):
        band = own - back
        at = np.clip(band, 0, len(parts) - 1)
        # the band's largest size and what it makes of the most differences with a partner from it
        top = low[at + 1] - 1
        most = _most(counts + (counts * q // p if back == 0 else np.minimum(top, counts)), threshold)
        rows = np.flatnonzero((counts > 0) & (band >= 0) & (top * q // p >= counts) & (most > 0))
        if not len(rows):
            if back:
                break
            continue
        size = counts[rows]
        row = np.repeat(rows, size)
        at = np.repeat(first[rows] - tk.starts_of(size)[:-1], size) + np.arange(size.sum())
        b = band[row]
        cell = ((elements[at] >> tk.U64(16)) * (RANGES * parts[b]).astype(np.uint64)) >> tk.U64(32)
        key = row.astype(np.uint64) << tk.U64(40) | cell
        start = np.flatnonzero(np.diff(key, prepend=key[:1] ^ tk.U64(1)))
        sums = tk.segment_sum(mixed[at], np.append(start, len(at)))
        # what each part of a row has in each of its ranges
        row, b, cell = row[start], b[start], cell[start].astype(np.int64)
        part, place = np.divmod(cell, RANGES)
        group = np.cumsum(np.diff(row * (int(parts.max()) + 1) + part, prepend=-1) != 0) - 1
        head = np.flatnonzero(np.diff(group, prepend=-1))
        table = np.zeros((len(head), RANGES), np.uint64)
        table[group, place] = sums
        held = np.zeros((len(head), RANGES), bool)
        held[group, place] = True
        reached = held.sum(axis=1)
        row, b, part = row[head], b[head], part[head]
        whole = table.sum(axis=1, dtype=np.uint64)
        for left_out in range(RANGES):
            some = reached > held[:, left_out]
            tag = (b[some].astype(np.uint64) << tk.U64(40) | part[some].astype(np.uint64)) * tk.U64(RANGES) + tk.U64(left_out)
            out_s.append(tk.mix64(whole[some] - table[some, left_out] + tk.seeded(tag, 41)) & ~tk.U64(1))
            out_r.append(row[some])
        sure = np.bincount(row[reached > 1], minlength=len(counts))[rows] - most[rows] // 2
        least[rows] = np.minimum(least[rows], sure)
        poor[rows[sure < 1]] = True
    alone = np.repeat(poor, counts)
    out_s.append(tk.seeded(elements[alone], 43) | tk.U64(1))
    out_r.append(np.repeat(np.arange(len(counts)), counts)[alone])
    return np.concatenate(out_s), np.concatenate(out_r), np.clip(least, 1, None)


def sketches(elements: np.ndarray, counts: np.ndarray) -> list[bytes]:
    """A histogram of each row's elements, cells cut off at 255."""
    cell = tk.row_of(counts) * 256 + (elements >> tk.U64(40)).astype(np.int64)
    table = np.minimum(np.bincount(cell, minlength=256 * len(counts)), 255).astype(np.uint8).tobytes()
    return [table[256 * i : 256 * i + 256] for i in range(len(counts))]


def most_differences(x: np.ndarray, y: np.ndarray, threshold: tuple[int, int]) -> np.ndarray:
    """The largest number of differing elements that sizes x and y allow a similar pair."""
    p, q = threshold
    total = x.astype(np.int64) + y
    return total - 2 * -(-p * total // (p + q))


def set_keys(elements: np.ndarray, counts: np.ndarray) -> list[bytes | None]:
    """16 bytes that equal sets have in common; None for an empty set."""
    first = tk.starts_of(counts)
    halves = [tk.seeded(tk.segment_sum(tk.seeded(elements, s), first) + counts.astype(np.uint64), s) for s in (51, 52)]
    keys = np.stack(halves, axis=1).astype(">u8").tobytes()
    return [keys[16 * i : 16 * i + 16] if c else None for i, c in enumerate(counts.tolist())]


def _signed(docs: DataFrame, words: int, threshold: tuple[int, int], buckets: int) -> DataFrame:
    """Rows (bucket, chunk, words) of signatures, and one (doc_ids, sizes, keys) row per chunk, under bucket -1."""
    schema = T.StructType([
        T.StructField("bucket", T.IntegerType()), T.StructField("chunk", T.LongType()), T.StructField("words", T.BinaryType()),
        T.StructField("members", T.ArrayType(T.StructType([T.StructField("doc_id", docs.schema["d"].dataType), T.StructField("n", T.LongType()), T.StructField("key", T.BinaryType()), T.StructField("least", T.LongType()), T.StructField("sketch", T.BinaryType())]))),
    ])
    arrow = [pa.field("bucket", pa.int32()), pa.field("chunk", pa.int64()), pa.field("words", pa.binary())]

    def sign(batches):
        number = 0
        for batch in batches:
            for part in tk.chunks(batch, "t", tk.SIGNED_BYTES):
                chunk, number = chunk_number(number), number + 1
                elements, counts = shingle_sets(part.column(1), words)
                keys = set_keys(elements, counts)
                # copies within the chunk sign once
                seen: dict = {}
                first = np.array([seen.setdefault(key, i) == i and key is not None for i, key in enumerate(keys)], bool)
                signature, row, least = signatures(elements[np.repeat(first, counts)], np.where(first, counts, 0), threshold)
                shape = [s if f else None for s, f in zip(sketches(elements, counts), first.tolist(), strict=True)]
                told = pa.StructArray.from_arrays([part.column(0), pa.array(counts, pa.int64()), pa.array(keys, pa.binary()), pa.array(least), pa.array(shape, pa.binary())], ["doc_id", "n", "key", "least", "sketch"])
                kind = pa.schema([*arrow, pa.field("members", pa.list_(told.type))])
                yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([chunk], pa.int64()), pa.array([None], pa.binary()), pa.ListArray.from_arrays(pa.array([0, len(told)], pa.int32()), told)], schema=kind)
                rows = list(packed_rows(signature, row, buckets))
                if rows:
                    n = len(rows)
                    yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in rows], pa.int32()), pa.array([chunk] * n, pa.int64()), tk.binary([w for _, w in rows]), pa.nulls(n, pa.list_(told.type))], schema=kind)

    return docs.mapInArrow(sign, schema)


def _sets(docs: DataFrame, keys: DataFrame, classes: DataFrame, words: int) -> DataFrame:
    """(key, elements) of the classes with the given keys, from one document each; elements: 6 bytes each."""
    wanted = stored(classes.join(keys, "key", "left_semi").select(F.col("top").alias("d"), "key"))
    ids = if_small(wanted.select(F.col("d").alias("w")).distinct())
    texts = docs.join(ids, docs["d"].eqNullSafe(ids["w"]), "left_semi").select("t")

    def sets(batches):
        for batch in batches:
            for part in tk.chunks(batch, "t"):
                elements, counts = shingle_sets(part.column(0), words)
                first = tk.starts_of(counts)
                cells = elements.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
                yield pa.RecordBatch.from_arrays([pa.array(set_keys(elements, counts), pa.binary()), tk.binary([cells[first[i] : first[i + 1]] for i in range(len(counts))])], ["key", "elements"])

    return stored(texts.mapInArrow(sets, "key binary, elements binary").join(if_small(wanted.select("key")), "key", "left_semi").dropDuplicates(["key"]))


def _unpack(data: bytes) -> np.ndarray:
    cells = np.zeros((len(data) // 6, 8), np.uint8)
    cells[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return cells.view("<u8").ravel()


def verified(pairs: DataFrame, sets: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """The pairs (a, b) of keys whose sets are similar enough."""
    p, q = threshold

    def check(batches):
        for batch in batches:
            keep, last, left = [], None, None
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if x is not last:
                    last, left = x, _unpack(x)
                right = _unpack(y)
                shared = len(left) + len(right) - len(np.unique(np.concatenate([left, right])))
                keep.append(q * shared >= p * (len(left) + len(right) - shared))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    one = sets.select(F.col("key").alias("a"), F.col("elements").alias("x"))
    two = sets.select(F.col("key").alias("b"), F.col("elements").alias("y"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y").mapInArrow(check, "a binary, b binary")


def similar_documents(docs: DataFrame, words: int = WORDS, threshold: tuple[int, int] = THRESHOLD, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id), one row per row of docs.

    Words are the runs of characters other than ASCII white space, A-Z lower-cased; a text
    of fewer than `words` words has one shingle, its whole sequence; a null or blank text
    has none and is linked with nothing. component_id is the smallest doc_id that links
    reach, by way of copies too. Rows with equal doc_ids stay separate rows; with a null
    doc_id, a row without links has a null component_id. Extra columns are ignored.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    parts = partitions(spark)
    buckets = 8 * parts
    p, q = threshold
    own = docs.select(F.col(doc_id).alias("d"), F.col(text).alias("t"))
    signed = _signed(own, words, threshold, buckets)
    # one pass over the texts: what a chunk says of its documents travels beside its signatures
    told = stored(told_rows(signed, parts))
    members = told.where("kind = 0").select("chunk", "row", "doc_id", "n", "key")
    classes = told.where("kind = 0 and key is not null").groupBy("key").agg(F.min("doc_id").alias("top"), F.first("n").alias("n"), F.min("least").alias("least"), F.first("sketch", True).alias("sketch"))
    classes = stored(classes)
    needed = written()
    grouped = stored(_class_groups(told.where("kind = 1"), members, classes, threshold))
    allowed = _allowed(_stars(grouped), classes, threshold)
    allowed = stored(allowed.groupBy("b").agg(F.max_by("a", F.struct("times", "a")).alias("a")))
    sets = _sets(own, allowed.select(F.col("a").alias("key")).union(allowed.select(F.col("b").alias("key"))).distinct(), classes, words)
    links = stored(verified(allowed.select("a", "b"), sets, threshold))
    roots = components(links)
    units = stored(_units(grouped, roots))
    if not units.isEmpty():
        sets = _sets(own, units.select("key").distinct(), classes, words)
        more = stored(_within_units(units, sets, threshold, parts))
        if not more.isEmpty():
            roots = components(links.union(more))
    roots = stored(roots)
    kept = roots.inputFiles()
    discard(spark, *(path for path in written() - needed if not any(path in f for f in kept)))
    tops = classes.select("key", "top")
    placed = roots.union(roots.select(F.col("root").alias("node"), "root").distinct())
    least = placed.join(tops, placed["node"] == tops["key"]).groupBy("root").agg(F.min("top").alias("component_id"))
    placed = placed.join(least, "root").select(F.col("node").alias("key"), "component_id")
    final = tops.join(placed, "key", "left").select("key", F.coalesce("component_id", "top").alias("component_id"))
    return members.join(final, "key", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def _class_groups(groups: DataFrame, members: DataFrame, classes: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """(gid, key, times, n): the groups of two classes or more, without each class's most frequent signatures of either family."""
    p, q = threshold
    groups = groups.groupBy("gid", "chunk", "row").agg(F.sum("times").alias("times"))
    found = groups.join(members.select("chunk", "row", "key"), ["chunk", "row"]).groupBy("gid", "key").agg(F.max("times").alias("times"))
    sizes = found.groupBy("gid").agg(F.count("*").alias("m")).where("m > 1")
    found = found.join(sizes, "gid").join(classes.select("key", "n", "least"), "key").withColumn("family", F.col("gid").bitwiseAND(F.lit(1)))
    order = Window.partitionBy("key", "family").orderBy(F.desc("m"), "gid").rowsBetween(Window.unboundedPreceding, 0)
    least = F.when(F.col("family") == 1, F.ceil(F.col("n") * p / q)).otherwise(F.col("least"))
    return found.withColumn("before", F.sum("times").over(order)).where(F.col("before") >= least).select("gid", "key", "times", "n")


def _stars(grouped: DataFrame) -> DataFrame:
    """(a, b, times): each class b with the smallest class a of each group, and the signatures by which they meet."""
    centre = grouped.groupBy("gid").agg(F.min("key").alias("a"))
    return grouped.join(centre, "gid").where("a <> key").groupBy("a", F.col("key").alias("b")).agg(F.sum("times").alias("times"))


def _allowed(pairs: DataFrame, classes: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """The stars (a, b, times) that sizes and sketches allow."""

    def check(batches):
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, 256).astype(np.int16) for i in (3, 4))
            n, m = (batch.column(i).to_numpy() for i in (5, 6))
            fits = _sizes_fit(n, m, threshold) & (np.abs(x - y).sum(axis=1) <= most_differences(n, m, threshold))
            yield pa.RecordBatch.from_arrays(batch.columns[:3], ["a", "b", "times"]).filter(pa.array(fits))

    x, y = (classes.select(F.col("key").alias(k), F.col("sketch").alias(f"s{k}"), F.col("n").alias(f"n{k}")) for k in "ab")
    both = pairs.join(x, "a").join(y, "b").select("a", "b", "times", "sa", "sb", "na", "nb")
    return both.mapInArrow(check, "a binary, b binary, times long")


def _sizes_fit(n: np.ndarray, m: np.ndarray, threshold: tuple[int, int]) -> np.ndarray:
    return threshold[1] * np.minimum(n, m) >= threshold[0] * np.maximum(n, m)


def _units(grouped: DataFrame, roots: DataFrame) -> DataFrame:
    """(unit, key, n, root, own, i, j): the classes to compare, those of each block of a unit.

    What the groups that hold several components have in common makes clusters. A cluster that
    fits into one block, or whose groups together have more pairs than it has, is a unit: so a
    class is sent once, not once for each of its groups. Otherwise the groups are the units. Units are cut into blocks of
    about BLOCK classes and BLOCK_ELEMENTS elements; each pair of blocks is a task's work of its own.
    """
    label = grouped.join(roots.select(F.col("node").alias("key"), "root"), "key", "left").select("gid", "key", "n", F.coalesce("root", "key").alias("root"))
    mixed = label.groupBy("gid").agg(F.min("root").alias("r"), F.max("root").alias("s"), F.min("key").alias("a"), F.count("*").alias("m")).where("r <> s").select("gid", "a", "m")
    label = stored(label.join(mixed, "gid"))
    stars = label.where("a <> key").select("a", F.col("key").alias("b"))
    clusters = components(stars)
    clusters = stored(clusters.union(clusters.select("root", "root").distinct()).select(F.col("node").alias("key"), F.col("root").alias("cluster")))
    label = label.join(clusters, "key")
    pairs = label.groupBy("cluster", "gid").agg(F.first("m").alias("m")).groupBy("cluster").agg(F.sum(F.col("m") * F.col("m")).alias("pairs"))
    one = label.groupBy("cluster", "key").agg(F.first("n").alias("n"), F.first("root").alias("root"))
    size = one.groupBy("cluster").agg(F.count("*").alias("m"), F.sum("n").alias("n"))
    whole = size.join(pairs, "cluster").where((_blocks() == 1) | (F.col("m") * F.col("m") <= F.col("pairs"))).select("cluster", _blocks().alias("blocks"))
    whole = stored(whole)
    by_cluster = one.join(whole, "cluster").select(F.xxhash64("cluster").alias("unit"), "key", "n", "root", "blocks")
    apart = label.join(whole, "cluster", "left_anti")
    cut = apart.groupBy("gid").agg(F.count("*").alias("m"), F.sum("n").alias("n")).select("gid", _blocks().alias("blocks"))
    by_group = apart.join(cut, "gid").select(F.col("gid").alias("unit"), "key", "n", "root", "blocks")
    rows = by_cluster.union(by_group).withColumn("own", F.pmod(F.xxhash64("key"), "blocks").cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), (F.col("blocks") - 1).cast("int"))))
    return rows.select("unit", "key", "n", "root", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))


def _blocks():
    """The number of blocks of m classes with n elements together."""
    return F.ceil(F.greatest(F.col("m") / BLOCK, F.col("n") / BLOCK_ELEMENTS))


def linked(elements: list[np.ndarray], root: np.ndarray, block: np.ndarray, across: bool, threshold: tuple[int, int]) -> list[tuple[int, int]]:
    """A spanning forest of the links between sets of different roots; with `across`, only between different blocks.

    Sets are taken in the order of their sizes; each is compared with all larger ones that
    its size allows, by counting its elements among theirs.
    """
    p, q = threshold
    order = np.argsort([len(e) for e in elements], kind="stable")
    size = np.array([len(elements[i]) for i in order], np.int64)
    label, block = root[order].copy(), block[order]
    _, ids, often = np.unique(np.concatenate([elements[i] for i in order]), return_inverse=True, return_counts=True)
    common = often[ids] > 1
    first = np.append(0, np.cumsum(common))[tk.starts_of(size)]
    ids = ids[common]
    here = np.zeros(len(often), np.int32)
    found = []
    reach = np.searchsorted(size, size * q // p, side="right")
    for x in range(len(size) - 1):
        wanted = label[x + 1 : reach[x]] != label[x]
        if across:
            wanted &= block[x + 1 : reach[x]] != block[x]
        if not wanted.any():
            continue
        mine = ids[first[x] : first[x + 1]]
        here[mine] = 1
        shared = tk.segment_sum(here[ids[first[x + 1] : first[reach[x]]]], first[x + 1 : reach[x] + 1] - first[x + 1])
        here[mine] = 0
        for y in (np.flatnonzero(wanted & (q * shared >= p * (size[x] + size[x + 1 : reach[x]] - shared))) + x + 1).tolist():
            if label[y] != label[x]:
                label[label == label[y]] = label[x]
                found.append((int(order[x]), int(order[y])))
    return found


def _within_units(units: DataFrame, sets: DataFrame, threshold: tuple[int, int], parts: int) -> DataFrame:
    """The links (a, b) that join the components of each unit, a forest for each pair of blocks."""

    def check(batches):
        held, unit = [], None

        def flush():
            names: dict = {}
            root = np.array([names.setdefault(h[1], len(names)) for h in held])
            pairs = linked([_unpack(h[3]) for h in held], root, np.array([h[2] for h in held]), unit[1] != unit[2], threshold)
            keys = [h[0] for h in held]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([keys[x] for x, _ in pairs], pa.binary()), pa.array([keys[y] for _, y in pairs], pa.binary())], ["a", "b"])

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in range(7)), strict=True):
                if row[:3] != unit:
                    if held:
                        yield flush()
                    unit = row[:3]
                held.append(row[3:])
        if held:
            yield flush()

    spread = units.join(sets, "key").select("unit", "i", "j", "key", "root", "own", "elements").repartition(parts, "unit", "i", "j").sortWithinPartitions("unit", "i", "j")
    return spread.mapInArrow(check, "a binary, b binary")
