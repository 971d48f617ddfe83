"""Benchmark decontamination over a distributed positional inverted index.

The training documents are cut into segments of whole documents. A segment's index holds,
for each term that the test set uses, the sorted positions at which the term stands in the
segment; segments are written to the shared folder, so a lost executor costs a re-read, and
the terms' corpus frequencies are summed from them. A search then takes each test phrase's
terms from the rarest to the most frequent one and intersects their position lists, each
shifted by the term's offset in the phrase; what is left are exact occurrences. Documents
never leave their segment, so no group of rows ever meets in one task.

The test set is searched in blocks of at most BLOCK_WORDS words (a longer item is a block of
its own): one block at a time is broadcast and removed again, a larger test set makes more
passes over the index. What the driver holds of the whole test set is its distinct terms, 16
bytes each, which also say what the index has to hold.

Null and empty texts have no words and hit nothing; items without an id count as the one item whose id is empty; extra columns are ignored, repeated
doc_ids are separate rows, and an empty test set or table gives rows without hits or no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkernel as tk
from .shared import bound_batches, stored
from .signing import chunk_number

WINDOW = 10
BLOCK_WORDS = 1_000_000


def _blocks(items: DataFrame, item_id: str, text: str) -> Iterator[tuple[list[str], np.ndarray, np.ndarray]]:
    """The test set in blocks: item ids, term hashes end to end, and each item's number of terms."""
    ids, texts, size = [], [], 0

    def block():
        hashes, counts = tk.word_hashes(pa.array(texts, pa.large_string()), tk.WORD_BYTE)
        return list(ids), hashes, counts

    for row in items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("i"), F.col(text).alias("t")).toLocalIterator():
        words = len(row.t or "") // 2 + 1
        if ids and size + words > BLOCK_WORDS:
            yield block()
            ids, texts, size = [], [], 0
        ids.append(row.i)
        texts.append(row.t)
        size += words
    if ids:
        yield block()


class Phrases:
    """A block's windows as rows of term numbers (-1 after a short window's end), with the item of each."""

    def __init__(self, ids: list[str], hashes: np.ndarray, counts: np.ndarray, window: int):
        self.ids = np.array(ids, object)
        self.terms, numbers = np.unique(hashes, return_inverse=True)
        first = tk.starts_of(counts)
        length = np.minimum(counts, window)
        per_item = np.where(counts > 0, counts - length + 1, 0)
        self.item = tk.row_of(per_item)
        start = first[self.item] + np.arange(len(self.item)) - tk.starts_of(per_item)[self.item]
        cells = start[:, None] + np.arange(window)
        self.length = length[self.item]
        live = np.arange(window) < self.length[:, None]
        self.rows = np.where(live, numbers[np.minimum(cells, max(len(numbers) - 1, 0))] if len(numbers) else -1, -1)
        # equal windows of several items are searched once
        self.rows, self.group = np.unique(self.rows, axis=0, return_inverse=True) if len(self.rows) else (self.rows, self.item)
        self.order = None

    def ranked(self, frequency: np.ndarray) -> Phrases:
        """Fixes, for each window, the order of its terms from the rarest one."""
        rank = np.where(self.rows >= 0, frequency[np.maximum(self.rows, 0)], np.iinfo(np.int64).max) if len(self.rows) else self.rows
        self.order = np.argsort(rank, axis=1, kind="stable")
        return self


def build_index(docs: DataFrame, terms, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per segment: its number, doc_ids, words per document, and the positions of each of `terms` (a broadcast, sorted)."""
    schema = T.StructType([
        T.StructField("segment", T.LongType()), T.StructField("doc_ids", T.ArrayType(docs.schema[doc_id].dataType)),
        *(T.StructField(x, T.BinaryType()) for x in ("doc_words", "terms", "starts", "positions")),
    ])

    def segments(batches):
        vocabulary, number_of = terms.value, 0
        sieve = np.zeros(1 << 20, bool)
        sieve[vocabulary & tk.U64((1 << 20) - 1)] = True
        for batch in batches:
            for part in tk.chunks(batch, "t"):
                hashes, counts = tk.word_hashes(part.column(1), tk.WORD_BYTE)
                at = np.flatnonzero(sieve[hashes & tk.U64((1 << 20) - 1)])
                number = np.searchsorted(vocabulary, hashes[at])
                number[number == len(vocabulary)] = 0
                known = vocabulary[number] == hashes[at] if len(vocabulary) else np.zeros(0, bool)
                at, number = at[known], number[known]
                order = np.argsort(number, kind="stable")
                number = number[order]
                starts = np.flatnonzero(np.diff(number, prepend=-1))
                row = [counts.astype(np.int32), vocabulary[number[starts]], starts.astype(np.int32), at[order].astype(np.int32)]
                ids = pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column(0))
                yield pa.RecordBatch.from_arrays([pa.array([chunk_number(number_of)], pa.int64()), ids, *(tk.binary([x]) for x in row)], schema.names)
                number_of += 1

    return docs.select(F.col(doc_id).alias("d"), F.col(text).alias("t")).mapInArrow(segments, schema)


def term_frequencies(index: DataFrame) -> DataFrame:
    """(term, n): the corpus frequency of each indexed term."""

    def counts(batches):
        total: dict[int, int] = {}
        for batch in batches:
            for words, terms, starts, positions in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                del words
                n = np.diff(np.frombuffer(starts, np.int32), append=len(positions) // 4)
                for term, k in zip(np.frombuffer(terms, np.int64).tolist(), n.tolist(), strict=True):
                    total[term] = total.get(term, 0) + k
        yield pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.int64()), pa.array(total.values(), pa.int64())], ["term", "n"])

    return index.select("doc_words", "terms", "starts", "positions").mapInArrow(counts, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))


class Segment:
    """One row of the index, ready to be searched."""

    def __init__(self, doc_words: bytes, terms: bytes, starts: bytes, positions: bytes):
        self.first = tk.starts_of(np.frombuffer(doc_words, np.int32))
        self.terms = np.frombuffer(terms, np.uint64)
        self.positions = np.frombuffer(positions, np.int32)
        self.starts = np.append(np.frombuffer(starts, np.int32), len(self.positions))

    def lists(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Begin and end of each wanted term's positions; both 0 if it's absent."""
        at = np.searchsorted(self.terms, wanted)
        at[at == len(self.terms)] = 0
        there = self.terms[at] == wanted if len(self.terms) else np.zeros(len(wanted), bool)
        return np.where(there, self.starts[at], 0), np.where(there, self.starts[np.minimum(at + 1, len(self.starts) - 1)], 0)

    def phrases(self, block: Phrases) -> Iterator[tuple[int, np.ndarray]]:
        """(row of block.rows, first positions of its occurrences), by intersection from the rarest term."""
        if not len(block.rows):
            return
        begin, end = self.lists(block.terms)
        held = np.append(end > begin, True)  # the last cell answers for -1
        for w in np.flatnonzero(held[block.rows].all(axis=1)):
            row, found = block.rows[w], None
            for offset in block.order[w]:
                term = row[offset]
                if term < 0:
                    break
                here = self.positions[begin[term] : end[term]] - offset
                if found is None:
                    found = here[here >= 0]
                else:
                    at = np.searchsorted(here, found)
                    at[at == len(here)] = 0
                    found = found[here[at] == found]
                if not len(found):
                    break
            if len(found):
                last = found + int((row >= 0).sum()) - 1
                found = found[self.document(found) == self.document(last)]
                if len(found):
                    yield w, found

    def near(self, numbers: np.ndarray, order: np.ndarray, begin: np.ndarray, end: np.ndarray, slop: int) -> np.ndarray:
        """Positions of the rarest term with every other term at most `slop` words away, in the same document; begin and end are those of the terms' lists."""
        found = self.positions[begin[numbers[order[0]]] : end[numbers[order[0]]]]
        for i in order[1:]:
            here = self.positions[begin[numbers[i]] : end[numbers[i]]]
            if not len(here) or not len(found):
                return found[:0]
            doc = self.document(found)
            low = np.searchsorted(here, np.maximum(found - slop, self.first[doc]), side="left")
            high = np.searchsorted(here, np.minimum(found + slop, self.first[doc + 1] - 1), side="right")
            found = found[high > low]
        return found

    def document(self, position: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, position, side="right") - 1


def _index(docs: DataFrame, blocks, doc_id: str, text: str) -> tuple[DataFrame, dict[int, int], int]:
    """The stored index of the blocks' terms, the terms' frequencies, and the number of blocks."""
    bound_batches(docs.sparkSession)
    terms, number = np.zeros(0, np.uint64), 0
    for _, hashes, _ in blocks():
        terms, number = np.union1d(terms, hashes), number + 1
    shared = docs.sparkSession.sparkContext.broadcast(terms)
    index = stored(build_index(docs, shared, doc_id, text))
    shared.destroy()
    # as many rows as the test set has terms
    frequency = {r.term & tk._MASK: r.n for r in term_frequencies(index).collect()} if len(terms) else {}
    return index, frequency, number


def _searched(docs: DataFrame, items: DataFrame, window: int, names: tuple[str, str, str, str], search, fields: list[T.StructField]) -> tuple[DataFrame, int]:
    """The rows (segment, row, doc_id and fields) that `search` tells of each segment and block, and the number of blocks.

    search(doc ids, segment, block) gives arrays: of rows, and of the fields.
    """
    doc_id, text, item_id, item_text = names
    sc = docs.sparkSession.sparkContext
    blocks = lambda: _blocks(items, item_id, item_text)
    index, frequency, number = _index(docs, blocks, doc_id, text)
    schema = T.StructType([T.StructField("segment", T.LongType()), T.StructField("row", T.IntegerType()), T.StructField("doc_id", docs.schema[doc_id].dataType), *fields])

    def over(shared):
        def run(batches):
            for batch in batches:
                for k in range(batch.num_rows):
                    ids, segment = _segment(batch, k)
                    for row, *columns in search(ids, segment, shared.value):
                        yield pa.RecordBatch.from_arrays([pa.repeat(batch.column(0)[k], len(row)), pa.array(row, pa.int32()), ids.take(pa.array(row)), *columns], schema.names)

        return index.mapInArrow(run, schema)

    found = None
    for block in blocks() if number else [([], np.zeros(0, np.uint64), np.zeros(0, np.int64))]:
        phrases = Phrases(*block, window)
        shared = sc.broadcast(phrases.ranked(np.array([frequency.get(int(t), 0) for t in phrases.terms], np.int64)))
        part = over(shared)
        if number > 1:
            part = stored(part)
            shared.destroy()
        found = part if found is None else found.unionByName(part)
    return found, number


def phrase_hits(docs: DataFrame, items: DataFrame, window: int = WINDOW, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, n_words, spans, items): where windows of the items occur, as disjoint ranges of words, and whose they are.

    A window is `window` consecutive words of an item; an item of fewer words, but not
    none, is one window. One row per row of docs.
    """
    fields = [
        T.StructField("n_words", T.LongType()),
        T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("stop", T.LongType())]))),
        T.StructField("items", T.ArrayType(T.StringType())),
    ]

    def search(ids, segment, block):
        n = len(ids)
        change = np.zeros(int(segment.first[-1]) + 1, np.int64)
        names: dict[int, set] = {}
        owners = np.argsort(block.group, kind="stable")
        bounds = np.searchsorted(block.group[owners], np.arange(len(block.rows) + 1))
        for w, found in segment.phrases(block):
            np.add.at(change, found, 1)
            np.add.at(change, found + int((block.rows[w] >= 0).sum()), -1)
            own = set(block.ids[block.item[owners[bounds[w] : bounds[w + 1]]]])
            for d in np.unique(segment.document(found)).tolist():
                names.setdefault(d, set()).update(own)
        starts, ends, counts = tk.runs(np.cumsum(change)[:-1] > 0, segment.first)
        base = np.repeat(segment.first[:-1], counts)
        spans = pa.StructArray.from_arrays([pa.array(starts - base, pa.int64()), pa.array(ends - base, pa.int64())], ["start", "stop"])
        yield np.arange(n), pa.array(np.diff(segment.first), pa.int64()), pa.ListArray.from_arrays(pa.array(tk.starts_of(counts), pa.int32()), spans), pa.array([sorted(names.get(d, ())) for d in range(n)], pa.list_(pa.string()))

    found, blocks = _searched(docs, items, window, (doc_id, text, item_id, item_text), search, fields)
    if blocks > 1:
        every = found.groupBy("segment", "row").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
        found = every.withColumn("spans", _joined("spans"))
    return found.select("doc_id", "n_words", "spans", "items")


def _joined(spans: str):
    """Sorted ranges, those that meet made one."""
    none = F.array().cast("array<struct<start:bigint,stop:bigint>>")

    def step(done, x):
        last = F.element_at(done, -1)
        longer = F.struct(last["start"].alias("start"), F.greatest(last["stop"], x["stop"]).alias("stop"))
        return F.when((F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["stop"] >= x["start"]), F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(longer))).otherwise(F.concat(done, F.array(x)))

    return F.aggregate(spans, none, step)


def proximity_hits(docs: DataFrame, items: DataFrame, slop: int = 20, window: int = WINDOW, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, position): words that are the rarest term of a window of the item and have each other term of the window at most `slop` words away."""

    def search(ids, segment, block):
        for item, found in _near_items(segment, block, slop):
            doc = segment.document(found)
            yield doc, pa.array([item] * len(found)), pa.array(found - segment.first[doc], pa.int64())

    fields = [T.StructField("item_id", T.StringType()), T.StructField("position", T.LongType())]
    return _searched(docs, items, window, (doc_id, text, item_id, item_text), search, fields)[0].select("doc_id", "item_id", "position")


def proximity_digests(docs: DataFrame, items: DataFrame, slop: int = 20, window: int = WINDOW) -> DataFrame:
    """op10's proximity half: (doc_id, n_near, n_near_items, near_items_sha256) of each row: positions of hits, and the items that they are of."""

    def search(ids, segment, block):
        hit = np.zeros(int(segment.first[-1]) + 1, bool)
        names: dict[int, set] = {}
        for item, found in _near_items(segment, block, slop):
            hit[found] = True
            for d in np.unique(segment.document(found)).tolist():
                names.setdefault(d, set()).add(item)
        at = np.flatnonzero(hit[:-1])
        cut = np.searchsorted(at, segment.first)
        yield np.arange(len(ids)), pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(at, pa.int64())), pa.array([sorted(names.get(d, ())) for d in range(len(ids))], pa.list_(pa.string()))

    fields = [T.StructField("at", T.ArrayType(T.LongType())), T.StructField("near", T.ArrayType(T.StringType()))]
    found, blocks = _searched(docs, items, window, ("doc_id", "text", "item_id", "text"), search, fields)
    if blocks > 1:
        found = found.groupBy("segment", "row").agg(F.first("doc_id").alias("doc_id"), F.array_distinct(F.flatten(F.collect_list("at"))).alias("at"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("near")))).alias("near"))
    return found.select("doc_id", F.size("at").cast("long").alias("n_near"), F.size("near").cast("long").alias("n_near_items"), F.sha2(F.array_join("near", ","), 256).alias("near_items_sha256"))


def _segment(batch: pa.RecordBatch, k: int) -> tuple[pa.Array, Segment]:
    return batch.column(1).slice(k, 1).flatten(), Segment(*(batch.column(i)[k].as_py() for i in range(2, 6)))


def _near_items(segment: Segment, block: Phrases, slop: int) -> Iterator[tuple[str, np.ndarray]]:
    """(item id, positions of its windows' hits, each once)."""
    if not len(block.rows):
        return
    begin, end = segment.lists(block.terms)
    held = np.append(end > begin, True)  # the last cell answers for -1
    found = {}
    for w in np.flatnonzero(held[block.rows].all(axis=1)).tolist():
        live = int((block.rows[w] >= 0).sum())
        here = segment.near(block.rows[w], block.order[w][:live], begin, end, slop)
        if len(here):
            found[w] = here
    own: dict[int, list[np.ndarray]] = {}
    for w, i in zip(block.group.tolist(), block.item.tolist(), strict=True) if found else ():
        if w in found:
            own.setdefault(i, []).append(found[w])
    for i, parts in own.items():
        yield block.ids[i], np.unique(np.concatenate(parts))


def digest(hits: DataFrame) -> DataFrame:
    """The columns of op10 from the operator's rows."""
    lengths = F.aggregate(F.transform("spans", lambda s: s["stop"] - s["start"]), F.lit(0).cast("long"), lambda a, b: a + b)
    return hits.select("doc_id", "n_words", lengths.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))
