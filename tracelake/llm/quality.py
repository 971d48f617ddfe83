"""Quality scores by nearest-neighbour voting in a latent-semantic space.

A text's features are its words and the shapes of its words (letter case, digits,
punctuation), hashed to FEATURES cells, and a few marks of the whole text (share of
distinct words, of repeated neighbours, of repeated lines). Counts are damped and weighted
by inverse document frequency over all documents. The latent space is the truncated
singular value decomposition of the labelled rows. Those rows' vectors are broadcast; the
cosines of every document with all of them are computed exactly, block by block, and the
labels of the NEIGHBOURS nearest are averaged with the similarities' POWER as weights.

Documented bound: the classifier is fitted on at most LABELLED labelled rows, those with the
smallest hash of the doc_id; that is the size of what is broadcast. The document
frequencies cover all documents, and every document is scored.

Null counts as the empty text, which has a mark of its own; a text without any known
feature, and every text when nothing is labelled, gets the labels' mean (0.5 without
labels). Rows are independent: repeated doc_ids and extra columns don't matter. Cosines are
rounded to five digits and ties go to the labelled row with the smaller hash, so a score
doesn't depend on how rows are batched.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkernel as tk
from .counters import summed
from .language_id import held_out

FEATURES = 1 << 14
LABELLED = 4096
RANK = 64
NEIGHBOURS = 25
POWER = 6
THRESHOLD = 0.7
#: Shares of words, shapes and marks in a text's vector, before idf.
SHARES = np.array([1.0, 1.0, 2.0])
_MASK = tk.U64(FEATURES - 1)
#: Shapes: capitals, small letters and what isn't ASCII, digits; punctuation stands for itself.
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[65:91], _SHAPE[97:123], _SHAPE[128:], _SHAPE[48:58] = 65, 97, 97, 48
_MARKS = tk.seeded(np.arange(4096, dtype=np.uint64), 71)


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cell, weight, count): each text's features with damped counts, end to end, and their numbers."""
    data, offsets = tk.utf8(column)
    starts, ends, counts = tk.runs(tk.NOT_SPACE[data], offsets)
    n = len(counts)
    row = tk.row_of(counts)
    words = tk.SpanHasher(tk.lower_ascii(data))(starts, ends)
    shape = _SHAPE[data]
    keep = np.ones(len(shape), bool)
    keep[1:] = shape[1:] != shape[:-1]
    keep[starts] = True
    at = np.append(0, np.cumsum(keep))
    shapes = tk.SpanHasher(shape[keep])(at[starts], at[ends], 73)
    again = np.zeros(len(words), bool)
    again[1:] = (words[1:] == words[:-1]) & (row[1:] == row[:-1])
    distinct = np.bincount(np.unique(np.stack([row.astype(np.uint64), words]), axis=1)[0].astype(np.int64), minlength=n) if len(words) < 64 else _distinct(row, words, n)
    line_starts, line_ends, line_counts = tk.runs(data != 10, offsets)
    lines = _distinct(tk.row_of(line_counts), tk.SpanHasher(data)(line_starts, line_ends), n)
    total, total_lines = np.maximum(counts, 1), np.maximum(line_counts, 1)
    marks = np.stack([
        np.where(counts > 0, 1 + 10 * distinct // total, 0), 100 + 10 * np.bincount(row[again], minlength=n) // total,
        200 + 10 * lines // total_lines, 300 + np.minimum(np.log2(total).astype(np.int64), 20), 400 + np.minimum(np.diff(offsets) // total, 30),
    ])
    cell = np.concatenate([words & _MASK, shapes & _MASK, _MARKS[marks.ravel()] & _MASK]).astype(np.int64)
    owner = np.concatenate([row, row, np.tile(np.arange(n), len(marks))])
    # each part has the same share of a text's length, however many words there are
    part = np.repeat([0, 1, 2], [len(row), len(row), len(marks) * n])
    key, times = np.unique((owner * 3 + part) * FEATURES + cell, return_counts=True)
    weight, of = np.log1p(times), key // FEATURES
    norm = np.sqrt(np.bincount(of, weight**2, minlength=3 * n))
    owner = of // 3
    return key % FEATURES, (weight / norm[of] * SHARES[of % 3]).astype(np.float32), np.bincount(owner, minlength=n)


def _distinct(row: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    packed = np.sort(row.astype(np.uint64) << tk.U64(40) | values >> tk.U64(24))
    first = np.flatnonzero(np.diff(packed, prepend=packed[:1] ^ tk.U64(1))) if len(packed) else np.zeros(0, np.int64)
    return np.bincount((packed[first] >> tk.U64(40)).astype(np.int64), minlength=n)


def inverse_frequencies(docs: DataFrame, text: str = "text") -> np.ndarray:
    def count(batches, totals):
        vector = totals.setdefault("df", np.zeros(FEATURES + 1, np.int64))
        for batch in batches:
            for part in tk.chunks(batch, "t"):
                cell, _, counts = features(part.column(0))
                vector[:-1] += np.bincount(cell, minlength=FEATURES)
                vector[-1] += len(counts)

    found = summed(docs.select(F.col(text).alias("t")), count, FEATURES + 1).get("df", np.zeros(FEATURES + 1))
    return (np.log((found[-1] + 1) / (found[:-1] + 1)) + 0.1).astype(np.float32)


class Model:
    """The projection (idf and right singular vectors), the labelled rows' unit vectors and their labels."""

    def __init__(self, idf: np.ndarray, cells: list[np.ndarray], weights: list[np.ndarray], labels: list[int]):
        self.labels = np.array(labels, np.float64)
        self.mean = float(self.labels.mean()) if len(labels) else 0.5
        self.base = np.zeros((FEATURES, 1), np.float32)
        self.vectors = np.zeros((len(labels), 1), np.float32)
        if not labels:
            return
        count = np.array([len(c) for c in cells])
        cell, weight = np.concatenate(cells), np.concatenate(weights) * idf[np.concatenate(cells)]
        weight /= np.repeat(np.maximum(np.sqrt(tk.segment_sum((weight**2).astype(np.float64), tk.starts_of(count))), 1e-9), count).astype(np.float32)
        right = _svd(cell, weight, count, min(RANK, len(labels)))
        self.base = idf[:, None] * right
        self.vectors = _unit(_times(cell, np.concatenate(weights), count, self.base))

    def score(self, column: pa.Array) -> np.ndarray:
        cell, weight, count = features(column)
        out = np.full(len(count), self.mean)
        n = len(self.labels)
        if not n:
            return out
        vectors = _unit(_times(cell, weight, count, self.base))
        k = min(NEIGHBOURS, n)
        for i in range(0, len(count), 512):
            near = np.rint(vectors[i : i + 512] @ self.vectors.T * 1e5).astype(np.int64) * n + np.arange(n - 1, -1, -1)
            top = np.sort(np.partition(near, n - k, axis=1)[:, n - k :], axis=1)
            similar = np.maximum(top // n, 0) / 1e5
            vote = similar**POWER
            said = vote @ np.ones(k) > 0
            mine = (vote * self.labels[n - 1 - top % n]).sum(axis=1)
            out[i : i + 512] = np.where(said, mine / np.maximum(vote.sum(axis=1), 1e-300), self.mean)
        return np.clip(out, 0, 1)


def _times(cell: np.ndarray, weight: np.ndarray, count: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The sparse rows times a dense matrix, a few rows at a time."""
    out = np.zeros((len(count), right.shape[1]), np.float32)
    first = tk.starts_of(count)
    step = 1 << 16
    a = 0
    while a < len(count):
        b = max(a + 1, int(np.searchsorted(first, first[a] + step, side="right")) - 1)
        s = slice(first[a], first[b])
        rows = np.flatnonzero(count[a:b])
        if len(rows):
            out[a + rows] = np.add.reduceat(weight[s, None] * right[cell[s]], first[a:b][rows] - first[a], axis=0)
        a = b
    return out


def _svd(cell: np.ndarray, weight: np.ndarray, count: np.ndarray, rank: int) -> np.ndarray:
    """Right singular vectors by subspace iteration from a fixed start."""
    order = np.argsort(cell, kind="stable")
    back = (tk.row_of(count)[order], weight[order], np.bincount(cell, minlength=FEATURES))
    right = np.random.default_rng(17).standard_normal((FEATURES, min(rank + 16, len(count)))).astype(np.float32)
    for _ in range(4):
        left, _ = np.linalg.qr(_times(cell, weight, count, right))
        right, _ = np.linalg.qr(_times(*back, left))
    _, _, turn = np.linalg.svd(_times(cell, weight, count, right), full_matrices=False)
    return (right @ turn.T[:, :rank]).astype(np.float32)


def _unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9).astype(np.float32)


def fit(docs: DataFrame, labels: DataFrame, bound: int = LABELLED, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> Model:
    """A model of at most `bound` rows of labels (doc_id, label 0 or 1) and of the statistics of all docs."""
    idf = inverse_frequencies(docs, text)
    known = labels.select(F.col(doc_id).alias("d"), F.col(label).cast("int").alias("l")).where("l in (0, 1) and d is not null")
    chosen = known.withColumn("h", F.xxhash64("d")).orderBy("h", "d", "l").limit(bound)

    def rows(batches):
        for batch in batches:
            for part in tk.chunks(batch, "t"):
                cell, weight, count = features(part.column(0))
                first = tk.starts_of(count)
                cut = list(zip(first, first[1:], strict=False))
                yield pa.RecordBatch.from_arrays([part.column(1), part.column(2), part.column(3), tk.binary([cell[a:b].astype(np.int32) for a, b in cut]), tk.binary([weight[a:b] for a, b in cut])], ["h", "d", "l", "cell", "weight"])

    kind = labels.schema[doc_id].dataType.simpleString()
    found = docs.select(F.col(doc_id).alias("d"), F.col(text).alias("t")).join(F.broadcast(chosen), "d").select("t", "h", "d", "l").mapInArrow(rows, f"h long, d {kind}, l int, cell binary, weight binary")
    # repeated doc_ids could exceed the bound
    held = found.orderBy("h", "d", "l", "cell").limit(bound).collect()
    return Model(idf, [np.frombuffer(r.cell, np.int32).astype(np.int64) for r in held], [np.frombuffer(r.weight, np.float32) for r in held], [r.l for r in held])


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score, predicted) of each row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([T.StructField("doc_id", docs.schema[doc_id].dataType), T.StructField("score", T.DoubleType())])

    def run(batches):
        for batch in batches:
            for part in tk.chunks(batch, "t"):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(shared.value.score(part.column(1)))], ["doc_id", "score"])

    found = docs.select(F.col(doc_id).alias("d"), F.col(text).alias("t")).mapInArrow(run, schema)
    return found.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def held_out_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """op9: learned from the labels of rows that aren't held out, for all rows."""
    model = fit(docs, labels.where(~held_out(F.col("doc_id"))))
    return score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
