"""Language identification: multinomial naive Bayes over hashed character n-grams.

Features are the bigrams and trigrams of letters, lower-cased, with one blank for each
stretch of other characters and at both ends of a text, hashed to FEATURES cells. Counts
per language are summed over all learnable rows; the matrix of log probabilities (FEATURES
x languages doubles) is broadcast, and texts are scored in batches: each n-gram's column is
gathered and added up per text, which is the product of the sparse count matrix and the
log-probability matrix.

A text that is null or has no letter is `und` with score 0. Equal scores go to the
language that comes first in alphabetical order. Without learnable rows every text is `und`.
Repeated doc_ids are separate rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bpe
from . import textkernel as tk
from .counters import summed

FEATURES = 1 << 16
UNKNOWN = "und"
_LOWER: dict[int, np.ndarray] = {}


def lower(cells: np.ndarray) -> np.ndarray:
    out = np.empty_like(cells)
    high = cells >> 12
    for h in np.unique(high).tolist():
        if h not in _LOWER:
            _LOWER[h] = np.array([ord(x) if len(x := chr(c).lower()) == 1 else c for c in range(h << 12, (h + 1) << 12)], np.uint32)
        at = slice(None) if (high == h).all() else np.flatnonzero(high == h)
        out[at] = _LOWER[h][cells[at] & 0xFFF]
    return out


def grams(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of each text end to end, and each text's number of them (0 without letters)."""
    cells, offsets = tk.codepoints(column)
    letter = bpe.classes(cells) == bpe.LETTER
    low = np.where(letter, lower(cells), np.uint32(0)) if len(cells) else cells
    # letters, the first of the other characters after a letter, and one blank before each text that has letters
    starts = np.zeros(len(low) + 1, bool)
    starts[offsets] = True
    keep = letter.copy()
    keep[1:] |= letter[:-1] & ~starts[1:-1]
    at = np.flatnonzero(keep)
    kept = np.diff(np.searchsorted(at, offsets))
    has = kept > 0
    flat = np.insert(low[at], np.searchsorted(at, offsets[:-1][has]), 0)
    length = np.where(has, kept + 1, 0)
    flat = np.append(flat, np.zeros(2, np.uint32)).astype(np.uint32)
    a, b, c = flat[:-2], flat[1:-1], flat[2:]
    end = np.zeros(len(a), bool)
    end[np.cumsum(length[has]) - 1] = True
    b = np.where(end, 0, b)
    skip = end | np.append(end[1:], True)
    two = a * np.uint32(0x9E3779B1) + b * np.uint32(0x85EBCA77)
    three = two * np.uint32(0x27D4EB2F) + np.where(skip, 0, c) * np.uint32(0xC2B2AE3D) + np.uint32(0x165667B1)
    out = np.empty((len(a), 2), np.uint32)
    for i, h in enumerate((two, three)):
        h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        out[:, i] = (h ^ (h >> np.uint32(13))) & np.uint32(FEATURES - 1)
    return out.ravel(), 2 * length


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


class Model:
    """Languages in alphabetical order, log priors, and log probabilities by language and feature."""

    def __init__(self, counts: dict[str, np.ndarray]):
        self.languages = sorted(counts)
        table = np.array([counts[x] for x in self.languages], np.float64).reshape(len(self.languages), FEATURES + 1)
        docs, cells = table[:, 0], table[:, 1:]
        self.prior = np.log(docs / docs.sum()) if len(docs) else docs
        self.weights = np.log((cells + 0.5) / (cells.sum(axis=1, keepdims=True) + 0.5 * FEATURES))

    def predict(self, column: pa.Array) -> tuple[list[str], np.ndarray]:
        features, counts = grams(column)
        names, score = [UNKNOWN] * len(counts), np.zeros(len(counts))
        rows = np.flatnonzero(counts)
        if len(self.languages) and len(rows):
            start = tk.starts_of(counts[rows])[:-1]
            total = np.stack([np.add.reduceat(w[features], start) for w in self.weights]) + self.prior[:, None]
            best = total.argmax(axis=0)
            score[rows] = 1 / np.exp(total - total.max(axis=0)).sum(axis=0)
            for r, b in zip(rows.tolist(), best.tolist(), strict=True):
                names[r] = self.languages[b]
        return names, score


def fit(docs: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """A model of all rows of docs that have a text and a language."""

    def count(batches, totals):
        for batch in batches:
            for part in tk.chunks(batch, "t"):
                features, counts = grams(part.column(0))
                names = part.column(1).dictionary_encode()
                row = np.repeat(np.arange(len(counts)), counts)
                code = names.indices.to_numpy(zero_copy_only=False)
                for k, name in enumerate(names.dictionary.to_pylist()):
                    vector = totals.setdefault(name, np.zeros(FEATURES + 1, np.int64))
                    vector[0] += int((code == k).sum())
                    vector[1:] += np.bincount(features[code[row] == k], minlength=FEATURES)

    rows = docs.select(F.col(text).alias("t"), F.col(lang).alias("l")).where("t is not null and l is not null")
    return Model(summed(rows, count, FEATURES + 1))


def predict(docs: DataFrame, model: Model, text: str = "text", lang_pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """docs with the columns lang_pred and score, or what they are to be called; columns of docs by those names are replaced, all others pass through."""
    docs = docs.drop(*{lang_pred, score} - {text})
    schema = T.StructType([*docs.schema.fields, T.StructField(lang_pred, T.StringType()), T.StructField(score, T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index(text)

    def run(batches):
        m = shared.value
        for batch in batches:
            for part in tk.chunks(batch, text):
                names, likely = m.predict(part.column(place))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(names, pa.string()), pa.array(likely)], schema.names)

    return docs.mapInArrow(run, schema)


def learnable(docs: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    return docs.where(~held_out(F.col(doc_id)))


def held_out_predictions(docs: DataFrame) -> DataFrame:
    """op1: learned from the rows that aren't held out, predicted for all."""
    model = fit(learnable(docs))
    found = predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
