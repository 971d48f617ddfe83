import pytest

from tests.llm import brute
from tracelake.llm import decontamination as dc


def run(spark, docs, items, **kw):
    d = spark.createDataFrame(docs, "doc_id long, text string, item_id string").repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string, doc_id long")
    return {r.doc_id: tuple(r)[1:] for r in dc.digest(dc.phrase_hits(d, b, **kw)).collect()}


def test_matches_brute_force(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    items += [(900, "the"), (901, "of the"), (902, None), (903, "!!"), (904, items[0][1])]
    docs += [(9001, None), (9002, ""), (9003, items[3][1].upper()), (9004, "x " * 50000 + items[5][1])]
    got = run(spark, [(*d, "x") for d in docs], [(*i, 1) for i in items])
    assert got == brute.decontamination(docs, items)
    assert any(v[-1] for v in got.values())


def test_windows_do_not_cross_documents(spark):
    item = " ".join(f"w{i}" for i in range(12))
    docs = [(1, " ".join(f"w{i}" for i in range(6)), ""), (2, " ".join(f"w{i}" for i in range(6, 12)), ""), (3, item, None), (3, item, None)]
    d = spark.createDataFrame(docs, "doc_id long, text string, item_id string").coalesce(1)
    b = spark.createDataFrame([(7, item)], "item_id long, text string")
    rows = sorted(tuple(r)[:3] for r in dc.digest(dc.phrase_hits(d, b)).collect())
    assert rows == [(1, 6, 0), (2, 6, 0), (3, 12, 12), (3, 12, 12)]


def test_empty_tables(spark):
    assert run(spark, [], [(1, "a b", 1)]) == {}
    assert run(spark, [(1, "a b", None)], []) == {1: (2, 0, 0, brute.sha(""), False)}


@pytest.mark.parametrize("slop,expected", [(2, []), (3, [(1, "5", 0)])])
def test_proximity(spark, slop, expected):
    d = spark.createDataFrame([(1, "rare x x common common"), (2, "rare"), (3, "common common common")], "doc_id long, text string")
    b = spark.createDataFrame([(5, "common rare")], "item_id long, text string")
    assert [tuple(r) for r in dc.proximity_hits(d, b, slop=slop).collect()] == expected
