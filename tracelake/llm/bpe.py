"""Byte-level BPE encoding and decoding without regular expressions.

Pre-tokens are found from arrays. Each code point has a class (letter, number, white
space, other). Read as an automaton, a code point of the same class as the one before is
the identity on "where did this run begin", any other code point is the constant function
"here"; composing such functions is associative, so one running maximum over all positions
(np.maximum.accumulate) is the scan of the whole text. With each position's run start and
run end known, a token boundary depends on a few neighbours only:

- a run of letters, numbers or others begins a token, or its token begins one earlier if a
  plain space stands before it;
- of a white-space run that other text follows, the last character leaves the token of the
  rest: a plain space joins the next run, any other stands alone;
- a lone apostrophe without a space before it and one of the contraction endings after it
  form a token, and the rest of the letter run begins another.

Equal slices are merged once: slices of a chunk are grouped by a hash and compared with
their group's first slice, each group's bytes are looked up in a bounded cache, and those
not found there are merged by rank, all together: a round joins one pair of each. The slices' offsets, the ids and
the ids' byte lengths are kept, so decoding is one gather from the vocabulary's bytes, and
every token has its span in the text.
"""

from __future__ import annotations

import base64
import hashlib
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkernel as tk
from .shared import bound_batches

OTHER, LETTER, NUMBER, SPACE = range(4)
#: Pre-tokens of more bytes are merged one by one and not cached.
LONG_PIECE = 64
#: Bytes that a worker's cache of merged slices may take, by a rough count of 200 for each entry besides its bytes.
CACHE_BYTES = 8 << 20
#: White space of the pattern's \s
_SPACES = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_PLANES: dict[int, np.ndarray] = {}


def _plane(high: int) -> np.ndarray:
    """Classes of the 4,096 code points from high * 4,096."""
    if high not in _PLANES:
        kinds = {"L": LETTER, "N": NUMBER}
        table = np.array([kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(high << 12, (high + 1) << 12)], np.uint8)
        for c in _SPACES:
            if c >> 12 == high:
                table[c & 0xFFF] = SPACE
        _PLANES[high] = table
    return _PLANES[high]


def classes(cells: np.ndarray) -> np.ndarray:
    high = cells >> 12
    out = _plane(0)[np.minimum(cells, 0xFFF)]
    for h in np.unique(high[high > 0]).tolist():
        at = np.flatnonzero(high == h)
        out[at] = _plane(h)[cells[at] & 0xFFF]
    return out


def boundaries(cells: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Ascending starts of the pre-tokens of each text (texts end to end, at `offsets`)."""
    n = len(cells)
    if not n:
        return np.zeros(0, np.int64)
    kind = classes(cells)
    begins = np.ones(n, bool)
    begins[1:] = kind[1:] != kind[:-1]
    text_start = np.zeros(n + 1, bool)
    text_start[offsets] = True
    begins |= text_start[:-1]
    # the scan: identities keep, constants reset
    run_start = np.maximum.accumulate(np.where(begins, np.arange(n), 0))
    ends = np.append(begins[1:], True)  # the last cell of a run
    text_end = text_start[1:]
    space = kind == SPACE
    plain = cells == 0x20
    before_space = np.zeros(n, bool)  # a plain space before, in the same text
    before_space[1:] = plain[:-1]
    before_space &= ~text_start[:-1]
    token = begins.copy()
    token[begins & ~space & before_space] = False
    # the last character of a white-space run that other text follows
    token[space & ends & ~text_end] = True
    # contractions: a lone apostrophe
    lone = np.flatnonzero((cells == 0x27) & begins & ends & ~before_space & ~text_end)
    if len(lone):
        limit = offsets[np.searchsorted(offsets, lone, side="right")]
        one, two = cells[np.minimum(lone + 1, n - 1)], np.where(lone + 2 < limit, cells[np.minimum(lone + 2, n - 1)], 0)
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = np.zeros(len(lone), bool)
        for a, b in ("re", "ve", "ll"):
            long |= (one == ord(a)) & (two == ord(b))
        size = np.where(short, 2, np.where(long, 3, 0))
        token[lone[size > 0] + 1] = False
        after = (lone + size)[size > 0]
        inside = after < limit[size > 0]
        after = after[inside]
        # the rest of the letter run begins a token; other classes have begun one, or leave it to the space rule
        token[after[run_start[after] < after]] = True
    return np.flatnonzero(token)


class Pairs:
    """The rank of each pair of tokens that together are a token, in a table with open addressing."""

    NONE = np.uint32(0xFFFFFFFF)
    BITS = 20

    def __init__(self, ranks: dict[bytes, int]):
        found = [(a << 32 | b, r) for w, r in ranks.items() for k in range(1, len(w)) if (a := ranks.get(w[:k])) is not None and (b := ranks.get(w[k:])) is not None]
        keys, values = np.array([k for k, _ in found], np.uint64), np.array([r for _, r in found], np.uint32)
        self.byte = np.array([ranks[bytes([i])] for i in range(256)], np.uint32)
        self.bits = max(self.BITS, (4 * len(keys)).bit_length())
        self.keys = np.full(1 << self.bits, ~tk.U64(0))
        self.values = np.full(1 << self.bits, self.NONE)
        slot = self._slot(keys)
        while len(keys):
            # of the keys that want an empty slot the first one gets it, all others try the next slot
            free = np.flatnonzero(self.keys[slot] == ~tk.U64(0))
            at, first = np.unique(slot[free], return_index=True)
            won = free[first]
            self.keys[at], self.values[at] = keys[won], values[won]
            rest = np.ones(len(keys), bool)
            rest[won] = False
            keys, values, slot = keys[rest], values[rest], self._after(slot[rest])

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (tk.mix64(keys) >> tk.U64(64 - self.bits)).astype(np.int64)

    def _after(self, slot: np.ndarray) -> np.ndarray:
        return (slot + 1) & ((1 << self.bits) - 1)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, NONE for those without."""
        keys = left.astype(np.uint64) << tk.U64(32) | right
        out = np.full(len(keys), self.NONE)
        slot, open_ = self._slot(keys), np.arange(len(keys))
        while len(open_):
            there = self.keys[slot]
            same = there == keys[open_]
            out[open_[same]] = self.values[slot[same]]
            more = ~same & (there != ~tk.U64(0))
            open_, slot = open_[more], self._after(slot[more])
        return out

    def merged(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each piece, all pieces at once: a round joins each one's leftmost pair of lowest rank."""
        if not pieces:
            return []
        size = np.array([len(x) for x in pieces])
        ids = self.byte[np.frombuffer(b"".join(pieces), np.uint8)]
        of = np.repeat(np.arange(len(pieces)), size)
        rank = np.full(len(ids), self.NONE)
        inner = np.flatnonzero(of[:-1] == of[1:])
        rank[inner] = self.rank(ids[inner], ids[inner + 1])
        done_ids, done_of = [], []
        while len(ids):
            head = np.flatnonzero(np.diff(of, prepend=-1))
            best = np.minimum.reduceat(rank, head)
            whole = np.repeat(best, np.diff(np.append(head, len(ids))))
            ended = whole == self.NONE
            if ended.any():
                done_ids.append(ids[ended])
                done_of.append(of[ended])
                ids, of, rank, whole = ids[~ended], of[~ended], rank[~ended], whole[~ended]
                if not len(ids):
                    break
            at = np.flatnonzero(rank == whole)
            at = at[np.diff(of[at], prepend=-1) != 0]
            ids[at] = rank[at]
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            at -= np.arange(len(at))  # each cut before moves the later ones to the left
            ids, of, rank = ids[keep], of[keep], rank[keep]
            for left in (at, at[at > 0] - 1):
                inside = left + 1 < len(ids)
                rank[left[~inside]] = self.NONE
                left = left[inside]
                same = of[left] == of[left + 1]
                rank[left[~same]] = self.NONE
                rank[left[same]] = self.rank(ids[left[same]], ids[left[same] + 1])
        ids, of = np.concatenate(done_ids), np.concatenate(done_of)
        order = np.argsort(of, kind="stable")
        raw = ids[order].astype("<u4").tobytes()
        cut = (4 * tk.starts_of(np.bincount(of, minlength=len(pieces)))).tolist()
        return [raw[a:b] for a, b in zip(cut, cut[1:], strict=False)]


class Vocabulary:
    """Ranks of a byte-level BPE as merge table and as decoding table."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            pairs = [line.split() for line in f if line.strip()]
        self.ranks = {base64.b64decode(a): int(b) for a, b in pairs}
        size = max(self.ranks.values()) + 1
        words = [b""] * size
        for word, rank in self.ranks.items():
            words[rank] = word
        self.first = tk.starts_of(np.array([len(w) for w in words]))
        self.data = np.frombuffer(b"".join(words), np.uint8)
        self.cache: dict[bytes, bytes] = {}
        self.cached = 0
        self.pairs = Pairs(self.ranks)

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each pre-token, 4 bytes each: the adjacent pair of lowest rank is joined until no pair has one."""
        out = [self.cache.get(x) for x in pieces]
        new = [i for i, x in enumerate(out) if x is None]
        short = []
        for i in new:
            piece = pieces[i]
            if (rank := self.ranks.get(piece)) is not None:
                out[i] = rank.to_bytes(4, "little")
            elif len(piece) > LONG_PIECE:
                out[i] = np.array(_merged_long([piece[k : k + 1] for k in range(len(piece))], self.ranks), "<u4").tobytes()
            else:
                short.append(i)
        for i, found in zip(short, self.pairs.merged([pieces[i] for i in short]), strict=True):
            out[i] = found
        if self.cached >= CACHE_BYTES:
            self.cache.clear()
            self.cached = 0
        for i in new:
            if len(pieces[i]) <= LONG_PIECE:
                self.cache[pieces[i]] = out[i]
                self.cached += 200 + len(pieces[i]) + len(out[i])
        return out

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of the ids end to end, and each id's offset."""
        ids = ids.astype(np.int64)
        size = self.first[ids + 1] - self.first[ids]
        at = tk.starts_of(size)
        cells = np.arange(at[-1]) + np.repeat(self.first[ids] - at[:-1], size)
        return self.data[cells], at


def _merged_long(parts: list[bytes], ranks: dict[bytes, int]) -> list[int]:
    """Ids of a long pre-token, by a heap over a linked list."""
    import heapq

    n = len(parts)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := ranks.get(parts[i] + parts[i + 1])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = after[i]
        if parts[i] != a or j >= n or parts[j] != b:
            continue
        parts[i], parts[j] = a + b, b""
        after[i] = after[j]
        if after[j] < n:
            before[after[j]] = i
        for left in (before[i], i):
            if left >= 0 and after[left] < n and (r := ranks.get(parts[left] + parts[after[left]])) is not None:
                heapq.heappush(heap, (r, left, parts[left], parts[after[left]]))
    return [ranks[p] for p in parts if p]


def _grouped(hasher: tk.SpanHasher, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first slice of each group of equal ones, and each slice's group; every slice is compared with its group's first byte by byte."""
    _, first, group = np.unique(hasher(start, end), return_index=True, return_inverse=True)
    size, own = end - start, first[group]
    odd = np.flatnonzero((size != size[own]) | ~hasher.equal(start, start[own], np.minimum(size, size[own])))
    if len(odd):  # unequal slices of equal hash: groups of their own
        names: dict[bytes, int] = {}
        extra = []
        for i in odd.tolist():
            piece = hasher.data[start[i] : end[i]].tobytes()
            if piece not in names:
                names[piece] = len(first) + len(extra)
                extra.append(i)
            group[i] = names[piece]
        first = np.append(first, extra)
    return first, group


def encode_column(column: pa.Array, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids of each text end to end, and each text's number of ids."""
    data, offsets = tk.utf8(column)
    if not len(data):
        return np.zeros(0, np.uint32), np.zeros(len(offsets) - 1, np.int64)
    cells, cell_offsets = tk.codepoints(column)
    byte_of = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
    start = byte_of[boundaries(cells, cell_offsets)]
    end = np.append(start[1:], len(data))
    first, group = _grouped(tk.SpanHasher(data), start, end)
    raw = data.tobytes()
    merged = vocabulary.merge([raw[a:b] for a, b in zip(start[first].tolist(), end[first].tolist(), strict=True)])
    size = np.array([len(m) for m in merged]) // 4
    flat, at = np.frombuffer(b"".join(merged), np.uint32), tk.starts_of(size)
    per_piece = size[group]
    cells_of = np.arange(per_piece.sum()) + np.repeat(at[group] - tk.starts_of(per_piece)[:-1], per_piece)
    before = tk.starts_of(per_piece)[np.searchsorted(start, offsets)]
    return flat[cells_of], np.diff(before)


_VOCABULARIES: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    """The vocabulary of a path, read once by each worker; the file must be where the workers run."""
    if path not in _VOCABULARIES:
        _VOCABULARIES[path] = Vocabulary(path)
    return _VOCABULARIES[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def encode(docs: DataFrame, path: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids, ends): the ids of each row's text, and the byte offset in the text at which each id's bytes end.

    Null counts as the empty text, which has no ids. No special tokens: their strings are
    ordinary text. Rows are independent, so repeated doc_ids and extra columns don't matter.
    """
    schema = T.StructType([T.StructField("doc_id", docs.schema[doc_id].dataType), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("ends", T.ArrayType(T.IntegerType()))])

    def run(batches):
        v = vocabulary(path or default_path())
        for batch in batches:
            for part in tk.chunks(batch, "t"):
                ids, counts = encode_column(part.column(1), v)
                at = tk.starts_of(counts)
                ends = np.cumsum(v.first[ids.astype(np.int64) + 1] - v.first[ids.astype(np.int64)])
                ends -= np.repeat(np.append(0, ends)[at[:-1]], counts)
                offsets = pa.array(at, pa.int32())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(offsets, pa.array(ids.astype(np.int32))), pa.ListArray.from_arrays(offsets, pa.array(ends.astype(np.int32)))], ["doc_id", "ids", "ends"])

    return docs.select(F.col(doc_id).alias("d"), F.col(text).alias("t")).mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str | None = None, doc_id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(doc_id, data): the bytes of each row's ids."""
    schema = T.StructType([T.StructField("doc_id", encoded.schema[doc_id].dataType), T.StructField("data", T.BinaryType())])

    def run(batches):
        v = vocabulary(path or default_path())
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.column(1).slice(i, 1).flatten().to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), tk.binary([v.decode(one)[0]])], ["doc_id", "data"])

    return encoded.select(F.col(doc_id).alias("d"), F.col(ids).alias("i")).mapInArrow(run, schema)


def digests(docs: DataFrame, path: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each row, encoded and decoded in one pass so that no ids leave the worker."""
    return _told(docs, path, doc_id, text, False)


def encoded(docs: DataFrame, path: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids, ends, n_tokens, ids_sha256, decoded_sha256) of each row: encode's columns and those of digests, in one pass."""
    return _told(docs, path, doc_id, text, True)


def _told(docs: DataFrame, path: str | None, doc_id: str, text: str, with_ids: bool) -> DataFrame:
    bound_batches(docs.sparkSession)
    lists = [T.StructField(c, T.ArrayType(T.IntegerType())) for c in ("ids", "ends")] if with_ids else []
    schema = T.StructType([T.StructField("doc_id", docs.schema[doc_id].dataType), *lists, T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])

    def run(batches):
        v = vocabulary(path or default_path())
        for batch in batches:
            for part in tk.chunks(batch, "t"):
                ids, counts = encode_column(part.column(1), v)
                data, at = v.decode(ids)
                first = tk.starts_of(counts)
                raw, back = memoryview(ids.astype("<u4").tobytes()), memoryview(data.tobytes())
                of_ids = [hashlib.sha256(raw[4 * a : 4 * b]).hexdigest() for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
                cut = at[first].tolist()
                of_text = [hashlib.sha256(back[a:b]).hexdigest() for a, b in zip(cut, cut[1:], strict=False)]
                kept = []
                if with_ids:
                    ends = at[1:] - np.repeat(at[first[:-1]], counts)
                    offsets = pa.array(first, pa.int32())
                    kept = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (ids, ends)]
                yield pa.RecordBatch.from_arrays([part.column(0), *kept, pa.array(counts, pa.int64()), pa.array(of_ids), pa.array(of_text)], schema.names)

    return docs.select(F.col(doc_id).alias("d"), F.col(text).alias("t")).mapInArrow(run, schema)
