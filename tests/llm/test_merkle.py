import hashlib
import random

from pyspark.sql import functions as F

from tests.llm.oracle import compare
from tracelake.llm import merkle as m


def test_oracle(spark):
    compare(spark, "/root/testdata/sf0.001", m.digests(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")), m.ORACLE)


def test_next_rows_and_edits(spark):
    random.seed(2)
    docs = [(random.randrange(-10**6, 10**6), "".join(random.choice("ab\né😀 ") for _ in range(random.randrange(60)))) for _ in range(300)]
    docs = list(dict(docs).items()) + [(10**7, None), (10**7 + 1, ""), (10**7 + 2, "x\n\n\ny" * 20000)]
    got = {r.doc_id: r for r in m.digests(spark.createDataFrame([(*d, "z") for d in docs], "doc_id long, text string, t string").repartition(5)).collect()}
    docs.sort()
    for (d, t), (_, x) in zip(docs, docs[1:] + docs[:1], strict=True):
        t, x = t or "", x or ""
        e = t[: len(t) - len(t) // 2] + x[: len(t) // 2]
        assert (got[d].n_chars, got[d].edited_sha256) == (len(t), hashlib.sha256(e.encode()).hexdigest())
        assert (got[d].near_edited == 1) == (e == t) and (got[d].near_next == 1) == (x == t)
        assert (got[d].fingerprint == got[d].edited_fingerprint) == (e == t)
    assert len({r.fingerprint for r in got.values()}) == len({t or "" for _, t in docs})


def test_odd_tables(spark):
    one = spark.createDataFrame([(5, "ab")], "doc_id long, text string")
    assert [(r.near_edited, r.near_next) for r in m.digests(one).collect()] == [(0.0, 1.0)]
    assert m.digests(one.where("false")).collect() == []
    same = spark.createDataFrame([(None, "a"), (None, "b"), (1, "c"), (1, "c")], "doc_id long, text string")
    assert sorted(r.n_chars for r in m.digests(same).collect()) == [1, 1, 1, 1]


def test_differing_branches(spark):
    a, b = "one\ntwo\n\nthree\nfour", "one\n2\n\nthree\nfour!"
    row = spark.range(1).select(m.edited_paragraphs(m.fingerprint(F.lit(a)), m.fingerprint(F.lit(b))).alias("e")).first()
    assert [tuple(x) for x in row.e] == [(0, 1), (1, 1)]
