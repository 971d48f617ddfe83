"""Texts on which a polynomial hash modulo a power of two collides: Thue-Morse strings and their complements."""

import hashlib

import numpy as np
import pyarrow as pa
import pytest

from tests.llm import brute
from tracelake.llm import bpe, decontamination, line_dedup, ngram_join
from tracelake.llm import textkernel as tk


def thue_morse(size, letters="ab"):
    return "".join(letters[bin(i).count("1") & 1] for i in range(size))


SIZES = (1024, 2048, 4096)


@pytest.mark.parametrize("size", SIZES)
def test_hash_tells_them_apart(size):
    a, b = thue_morse(size), thue_morse(size, "ba")
    for limit in (1 << 20, tk.LONG):
        old, tk.LONG = tk.LONG, limit
        try:
            h = tk.SpanHasher(np.frombuffer((a + b + a).encode(), np.uint8))
            x, y, z = h(np.arange(3) * size, np.arange(1, 4) * size).tolist()
        finally:
            tk.LONG = old
        assert x == z != y


def test_equal_compares_bytes():
    rng = np.random.default_rng(1)
    data = rng.integers(0, 2, 4000).astype(np.uint8)
    h = tk.SpanHasher(data)
    size = rng.integers(0, 600, 900)
    a, b = rng.integers(0, 3400, (2, 900))
    b[::3] = a[::3]
    size[::5] %= 4
    assert h.equal(a, b, size).tolist() == [bool((data[x : x + n] == data[y : y + n]).all()) for x, y, n in zip(a, b, size, strict=True)]
    hashes = h(a, a + size)
    by: dict = {}
    for x, n, v in zip(a.tolist(), size.tolist(), hashes.tolist(), strict=True):
        assert by.setdefault(v, data[x : x + n].tobytes()) == data[x : x + n].tobytes()


def docs(spark, texts, apart):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(len(texts) if apart else 1)


@pytest.mark.parametrize("apart", [False, True])
def test_operators_tell_them_apart(spark, apart):
    words = [x for n in SIZES for x in (thue_morse(n), thue_morse(n, "ba"))]
    got = {r.doc_id: r for r in bpe.digests(docs(spark, words, apart)).collect()}
    for i, w in enumerate(words):
        assert got[i].decoded_sha256 == hashlib.sha256(w.encode()).hexdigest()
    lines = docs(spark, [w + "\n" + w[::-1][:600] for w in words], apart)
    assert {r.n_dropped for r in line_dedup.digests(lines.where("doc_id < 2")).collect()} == {0}
    for x, y in zip(words[::2], words[1::2], strict=True):
        texts = [f"{w} k l m n {w}" for w in (x, y)] + [f"{x} k l m n {y}"]
        found = ngram_join.similar_documents(docs(spark, texts, apart))
        assert sorted(map(tuple, found.collect())) == brute.similar(list(enumerate(texts)))
    items = spark.createDataFrame([(1, words[0]), (2, "a " + words[2])], "item_id long, text string")
    hits = decontamination.digest(decontamination.phrase_hits(docs(spark, words, apart), items)).collect()
    assert {r.doc_id: r.n_hit for r in hits} == {0: 1, 1: 0, 2: 0, 3: 0, 4: 0, 5: 0}


def test_equal_hashes_of_unequal_slices_stay_apart(monkeypatch):
    monkeypatch.setattr(tk.SpanHasher, "__call__", lambda self, starts, ends, seed=0: np.zeros(len(starts), np.uint64))
    texts = ["one two one three", "two two", "one"]
    ids, counts = bpe.encode_column(pa.array(texts), bpe.vocabulary(bpe.default_path()))
    data, at = bpe.vocabulary(bpe.default_path()).decode(ids)
    cut = at[tk.starts_of(counts)]
    assert [data[a:b].tobytes().decode() for a, b in zip(cut, cut[1:], strict=False)] == texts
