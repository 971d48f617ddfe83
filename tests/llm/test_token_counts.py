import random

import pytest

from tests.llm.oracle import compare
from tracelake.llm import token_counts as tc
from tracelake.llm.shared import shared_dir

SCHEMA = "op string, source string, lang string, tokenizer string, n_tokens long, old_tokens long"


def test_oracle(spark):
    compare(spark, "/root/testdata/sf0.001", tc.history(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")), tc.ORACLE)


def test_any_order_repeats_and_compaction_like_a_recount(spark):
    random.seed(4)
    live, batches = {}, []
    for _ in range(8):
        rows = []
        for _ in range(40):
            kind = random.choice(["insert", "insert", "delete", "revise"])
            if kind == "insert" or not live:
                key, n = (random.choice("ab") if random.random() < 0.9 else None, random.choice("xy"), "v1"), random.randrange(50)
                live[len(batches), len(rows)] = (key, n)
                rows.append(("insert", *key, n, None))
            else:
                at = random.choice(list(live))
                key, n = live[at]
                if kind == "delete":
                    del live[at]
                    rows.append(("delete", *key, n, None))
                else:
                    live[at] = (key, m := random.randrange(50))
                    rows.append(("revise", *key, m, n))
        batches.append(rows)
    expected = {}
    for key, n in live.values():
        d, t = expected.get(key, (0, 0))
        expected[key] = (d + 1, t + n)
    rollup = tc.TokenRollup(spark, shared_dir(spark))
    order = list(range(8)) + [0, 3, 7]
    random.shuffle(order)
    seen = set()
    for k, b in enumerate(order):
        assert rollup.apply(f"batch {b}", spark.createDataFrame(batches[b], SCHEMA)) == (b not in seen)
        seen.add(b)
        if k in (3, 6):
            rollup.compact()
            rollup.compact()
    assert {tuple(r)[:3]: tuple(r)[3:] for r in rollup.totals().collect()} == expected


def test_failed_batch_leaves_no_trace(spark):
    rollup = tc.TokenRollup(spark, shared_dir(spark))
    rollup.apply("a", spark.createDataFrame([("insert", "s", "l", "t", 5, None)], SCHEMA))
    with pytest.raises(Exception, match="unknown change"):
        rollup.apply("b", spark.createDataFrame([("insert", "s", "l", "t", 5, None), ("upsert", "s", "l", "t", 5, None)], SCHEMA))
    assert [tuple(r) for r in rollup.totals().collect()] == [("s", "l", "t", 1, 5)]
    assert rollup.apply("b", spark.createDataFrame([("delete", "s", "l", "t", 5, None)], SCHEMA))
    assert rollup.totals().collect() == []


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, None, None, 1), (2, "", "en", "s", 1), (3, "a b\nc", "en", "s", 1), (3, "a b\nc", "en", "s", 1), (4, "x " * 50000, "en", "s", 1)], "doc_id long, text string, lang string, source string, n_tokens int")
    got = {tuple(r)[:3]: tuple(r)[3:] for r in tc.history(docs).collect()}
    assert got[(None, None, "words-1")] == (1, 0) and got[("s", "en", "words-1")] == (4, 2) and got[("s", "en", "pieces-2")] == (4, 50006)
    assert tc.history(docs.where("false")).collect() == []
