"""The stored index answers as the scan does, prunes its read, and follows the table."""

import pytest

from tracelake.functions import storage
from tracelake.operators import search as x
from tracelake.operators.merge import Conflict
from tracelake.operators.search_index import Index

ROWS = [
    ("a", "The quick brown fox", "fox den"), ("b", "brown the fox, the brown fox!", ""), ("c", None, None), ("d", "", "Élan vital élan"), ("e", "a a a b a a", "the"),
    ("f", "fox one two three four brown", "quick"), ("g", "quicker quickest fox", "a b"), ("h", "brown", "fox"), ("i", "日本 fox 日本", "ÀÉ foxes"),
]
QUERIES = [
    "fox", "fox brown", '"brown fox"', "quick*", '"the quick*"', "fox NOT brown", "(fox OR elan) NOT quick", "^the", "^fox OR ^brown", "summary : fox", "- summary : fox", "{path summary} : brown",
    "NEAR(fox brown, 3)", "NEAR(fox brown, 4)", 'NEAR("the fox" brown quick, 2)', '"a a"', '"a a" b', '"fox fox"', "日本", "elan vital", "nothing", '""', 'NEAR("" fox)', "path : NEAR(brown fox)",
]


@pytest.fixture()
def table(spark):
    return spark.createDataFrame(ROWS, "id string, path string, summary string")


def answers(frame, key):
    return sorted((r[key], round(r["rank"], 9)) for r in frame.collect())


@pytest.mark.parametrize("text", QUERIES)
def test_index_equals_scan(spark, table, text, tmp_path_factory):
    index = _shared(spark, table)
    tree = x.parse(text, ("id", "path", "summary"))
    assert answers(index.hits(table, tree), "id") == answers(x.ranked(table, tree, "path", "summary"), "id")


_made = {}


def _shared(spark, table):
    if "index" not in _made:
        _made["index"] = Index(spark, storage.scratch(spark), "id", "path", "summary")
        _made["index"].refresh(table)
    return _made["index"]


def test_overlapping_places_count(spark, table):
    tree = x.parse('"a a"')
    (row,) = _shared(spark, table).hits(table, tree).collect()
    assert row["id"] == "e"
    assert x.ranked(table, tree, "path", "summary").count() == 1


def test_refresh_follows_the_table(spark, table):
    index = Index(spark, storage.scratch(spark), "id", "path", "summary")
    index.refresh(table)
    assert not index.refresh(table) and index.current(table)
    states = [
        [("a", "The slow brown fox", "den"), *ROWS[2:], ("z", "fox", "fox")],
        [("a", "The quick brown fox", "fox den"), ("z", None, "brown"), ("b", "fox", "x")],
        [],
        ROWS,
    ]
    for rows in states:
        now = spark.createDataFrame(rows, table.schema)
        assert not index.current(now)
        assert index.refresh(now) and index.current(now)
        for text in ("fox", "fox OR brown NOT quick", '"brown fox"', "qui*"):
            tree = x.parse(text)
            assert answers(index.hits(now, tree), "id") == answers(x.ranked(now, tree, "path", "summary"), "id"), (rows, text)
    before = answers(index.ranked(x.parse("fox")), "key")
    index.refresh(table, full=True)
    assert len(index._segments()) == 1
    assert answers(index.ranked(x.parse("fox")), "key") == before
    held = len(storage.names_in(spark, f"{index.path}/parts"))
    index.refresh(table.where("id <> 'a'"), full=True)
    assert held == 6 and len(storage.names_in(spark, f"{index.path}/parts")) == 2 and index.current(table.where("id <> 'a'"))


def test_one_of_two_writers_publishes(spark, table, monkeypatch):
    index = Index(spark, storage.scratch(spark), "id", "path")
    index.refresh(table)
    rival = Index(spark, index.path, "id", "path")
    real = storage.put_once

    def second(sp, path, text):
        monkeypatch.setattr(storage, "put_once", real)
        rival.refresh(table.where("id <> 'a'"))
        return real(sp, path, text)

    monkeypatch.setattr(storage, "put_once", second)
    with pytest.raises(Conflict):
        index.refresh(table.where("id <> 'b'"))
    assert index.current(table.where("id <> 'a'"))


def test_queries_read_what_they_ask_for(spark, table):
    plan = _shared(spark, table).ranked(x.parse("fox quick*"))._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(token,fox)" in plan and "StringStartsWith(token,quick)" in plan


def test_other_columns_are_refused(spark, table):
    index = _shared(spark, table)
    with pytest.raises(ValueError):
        Index(spark, index.path, "id", "path").ranked(x.parse("fox"))
    with pytest.raises(ValueError):
        Index(spark, storage.scratch(spark), "id", "path").ranked(x.parse("fox"))


def test_engine_searches_its_indexes(spark, tmp_path):
    from tracelake.plans import schema
    from tracelake.plans.engine import Engine

    rows = [("m1", "s", "the quick fox"), ("m2", "s", "a fox"), ("m3", "s", "nothing")]
    schema.migrated(spark.createDataFrame(rows, "uuid string, session_id string, text string"), "messages").write.parquet(f"{tmp_path}/t/messages")
    scan, stored = Engine.open(spark, f"{tmp_path}/t"), Engine.open(spark, f"{tmp_path}/t", indexes=f"file://{tmp_path}/i")
    for text in ("fox", "fox NOT quick", "none of these"):
        a, b = ([(r.uuid, round(r["rank"], 9)) for r in e.search(text)[0].collect()] for e in (scan, stored))
        assert a == b
    assert stored.memories(query="fox").count() == 0
