import random

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm import brute
from tracelake.llm import line_dedup as ld
from tracelake.llm import textkernel as tk

words = st.text(alphabet="abé😀 ", max_size=12)


@settings(max_examples=600, deadline=None)
@given(words, words, st.integers(0, 3))
def test_banded_distance(a, b, edits):
    assert ld.within(a, b, edits) == (brute.distance(a, b) <= edits)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab", min_size=6, max_size=20), st.integers(0, 2), st.randoms())
def test_lines_within_reach_share_a_key(line, edits, rng):
    other = list(line)
    for _ in range(edits):
        at = rng.randrange(len(other) + 1)
        kind = rng.randrange(3)
        if kind == 0:
            other.insert(at, rng.choice("abc"))
        elif other:
            other[min(at, len(other) - 1) : min(at, len(other) - 1) + 1] = "" if kind == 1 else "c"
    other = "".join(other)
    if len(other) < 3 or brute.distance(line, other) > 2:
        return
    cells, start, length, _, _ = ld._lines(pa.array([line, other]), 3)
    signature, of = ld.signatures(*ld._bytes(pa.array([line, other])), start, length, 2)
    assert set(signature[of == 0].tolist()) & set(signature[of == 1].tolist())


def test_line_spans():
    texts = ["ab\ncd", None, "", "\n", "x\n\ny\n", "é😀\nz"]
    cells, start, length, row, number = ld._lines(pa.array(texts, pa.string()), 0)
    got = [("".join(map(chr, cells[a : a + n])), r, k) for a, n, r, k in zip(start, length, row, number, strict=True)]
    assert got == [(line, r, k) for r, t in enumerate(texts) for k, line in enumerate((t or "").split("\n"))]


def test_matches_brute_force(spark):
    random.seed(11)
    base = ["".join(random.choice("abcdefgh éß") for _ in range(random.choice([8, 24, 25, 26, 40]))) for _ in range(30)]
    docs = []
    for i in range(120):
        lines = []
        for _ in range(random.randrange(6)):
            line = list(random.choice(base))
            for _ in range(random.choice([0, 0, 0, 1, 2, 3])):
                at = random.randrange(len(line))
                line[at : at + random.randrange(2)] = random.choice(["", "x", "yz"])
            lines.append("".join(line))
        docs.append((random.randrange(100), "\n".join(lines)))
    docs = list({d: t for d, t in docs}.items())
    docs += [(200, None), (201, ""), (202, "\n\n"), (203, docs[0][1]), (203, docs[0][1]), (None, docs[1][1]), (204, "z" * 90000 + "\n" + "z" * 90001)]
    df = spark.createDataFrame([(*d, "x", 5) for d in docs], "doc_id long, text string, key string, n_lines long").repartition(4)
    got = ld.deduplicated(df).collect()
    near = lambda a, b, k: ld.within(a, b, k)  # noqa: E731  checked above; brute distance is too slow for the long lines
    expected = brute.line_dedup(docs, ld.EDITS, ld.MIN_CHARS, near)
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == sorted(((d, t) for (d, _), t in zip(docs, expected, strict=True)), key=str)
    assert sum(r.n_dropped for r in got) > 50 and got[0].key == "x"


def test_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    expected = {d: t for (d, _), t in zip(rows, brute.line_dedup(rows, ld.EDITS, ld.MIN_CHARS, ld.within), strict=True)}
    for r in ld.digests(docs).collect():
        assert r.text_sha256 == ld.digest_of(expected[r.doc_id])


def test_blocks_of_a_large_group(spark, monkeypatch):
    monkeypatch.setattr(ld, "BLOCK", 5)
    docs = [(i, f"a common beginning of this line {i * 7919 % 100000:05d}") for i in range(60)]
    got = sorted((r.doc_id, r.text) for r in ld.deduplicated(spark.createDataFrame(docs, "doc_id long, text string")).collect())
    assert got == sorted((d, t) for (d, _), t in zip(docs, brute.line_dedup(docs, ld.EDITS, ld.MIN_CHARS), strict=True))


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert ld.deduplicated(df).collect() == []
    assert np.array_equal(ld._lines(pa.array([], pa.string()), 3)[1], [])
