import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from tracelake.llm import bpe


@pytest.fixture(scope="module")
def reference():
    import base64

    import public_tokenizers as P
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids_of(texts):
    ids, counts = bpe.encode_column(pa.array(texts, pa.string()), bpe.vocabulary(bpe.default_path()))
    at = np.append(0, np.cumsum(counts))
    return [ids[a:b].tolist() for a, b in zip(at, at[1:], strict=False)]


ODD = [
    "", " ", "  ", "\n", " \n", "\n ", " \n a", "\n\na", "don't", "don'ts", " 's", "  's", "'s's", "''s", "!'s", "\n'sa", "'ll 're've'm'd'x", "'", "a'", "'r", "'l", "'lx", "I'LL", "'S",
    "x  y   z \t q\t", "naïve Ærø 你好世界 １２ ½  x　y\u0085z ", "😀 👩‍👩‍👧 é", "a1b2 3.14", "<|endoftext|>", "\x00\x1c\x1da", "'s " * 5, "x" * 3000, "ab" * 400 + "'t" + "!" * 900, " '\n's", "9's", "'ſ", "'tis 'twas",
]


def test_odd_texts_like_the_library(reference):
    assert ids_of(ODD) == [reference.encode_ordinary(t) for t in ODD]
    assert ids_of([None, "a"]) == [[], reference.encode_ordinary("a")]


def test_random_texts_like_the_library(reference):
    random.seed(3)
    texts = ["".join(random.choice(["'", "s", "re", "ll", " ", "  ", "\n", "\t", "a", "É", "1", "!", "你", " ", "don", "'t"]) for _ in range(random.randrange(40))) for _ in range(4000)]
    assert ids_of(texts) == [reference.encode_ordinary(t) for t in texts]


def test_information_separators_are_no_white_space(reference):
    assert ids_of(["\x1e're", "a\x1f's", "\x1c \x1d"]) == [reference.encode_ordinary(t) for t in ("\x1e're", "a\x1f's", "\x1c \x1d")]
    random.seed(9)
    texts = ["".join(random.choice(["\x1c", "\x1d", "\x1e", "\x1f", "'", "s", "re", "'ve", " ", "\n", "a", "\x85", "1"]) for _ in range(random.randrange(14))) for _ in range(8000)]
    assert ids_of(texts) == [reference.encode_ordinary(t) for t in texts]


def test_merges_of_many_pieces_like_the_library(reference):
    random.seed(11)
    pieces = ["".join(random.choices("abcdeéstring ü你", k=random.randrange(1, 90))).replace(" ", "") or "x" for _ in range(3000)]
    v = bpe.Vocabulary(bpe.default_path())
    got = [np.frombuffer(x, "<u4").tolist() for x in v.merge([p.encode() for p in pieces])]
    assert got == [reference.encode_ordinary(p) for p in pieces]
    assert [np.frombuffer(x, "<u4").tolist() for x in v.merge([p.encode() for p in pieces])] == got and v.merge([]) == []


def test_documents_round_trip(spark, sf, reference):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    docs = docs.union(spark.createDataFrame([(9001, None, "x"), (9001, "", "x"), (None, "a b", None), (9002, "long " * 40000, "")], docs.schema))
    texts = [(r.doc_id, r.text or "") for r in docs.collect()]
    expected = []
    for d, t in texts:
        ids = reference.encode_ordinary(t)
        expected.append((d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    assert sorted(map(tuple, bpe.digests(docs).collect()), key=str) == sorted(expected, key=str)
    encoded = bpe.encode(docs)
    assert sorted((r.doc_id, bytes(r.data).decode()) for r in bpe.decode(encoded).collect() if r.doc_id is not None) == sorted(x for x in texts if x[0] is not None)
    for r in encoded.limit(20).collect():
        assert r.ends == sorted(r.ends)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.digests(docs).collect() == [] and bpe.encode(docs).collect() == []
