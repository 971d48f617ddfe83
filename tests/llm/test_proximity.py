from collections import Counter

from tests.llm import brute
from tracelake.llm import decontamination as dc
from tracelake.llm import queries


def near(docs, items, slop, window):
    """(doc, item, position) by brute force."""
    frequency = Counter(w for _, t in docs for w in brute.words(t))
    out = set()
    for item, text in items:
        own = brute.words(text)
        for i in range(max(len(own) - window, 0) + 1 if own else 0):
            terms = own[i : i + window]
            # the rarest term; of equally rare ones, the first
            rarest = min(terms, key=lambda w: frequency[w])
            for d, t in docs:
                words = brute.words(t)
                for p, w in enumerate(words):
                    if w == rarest and set(terms) <= set(words[max(p - slop, 0) : p + slop + 1]):
                        out.add((d, str(item), p))
    return out


LONG = " ".join(f"word{i}" for i in range(60))
DOCS = [(1, f"some text before {LONG} and after"), (2, " ".join(reversed(LONG.split()))), (3, " ".join(LONG.split()[::9])), (4, None), (5, "short item here, and a short one"), (6, " x ".join(LONG.split()))]
ITEMS = [(7, LONG), (8, "item short"), (9, ""), (10, None)]


def test_verbatim_copy_of_a_long_item(spark):
    d, b = spark.createDataFrame(DOCS, "doc_id long, text string").repartition(2), spark.createDataFrame(ITEMS, "item_id long, text string")
    got = [tuple(r) for r in dc.proximity_hits(d, b).collect()]
    assert sorted(got) == sorted(near(DOCS, ITEMS, 20, dc.WINDOW))
    assert {(1, "7"), (2, "7"), (6, "7"), (5, "8")} == {r[:2] for r in got}


def test_verbatim_benchmark_items(spark, sf):
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    docs = spark.createDataFrame(items, "doc_id string, text string") if isinstance(items[0][0], str) else spark.createDataFrame(items, "doc_id long, text string")
    got = {(str(r.doc_id), r.item_id) for r in dc.proximity_hits(docs, spark.read.parquet(f"{sf}/benchmark.parquet")).collect()}
    assert {(str(i), str(i)) for i, t in items if brute.words(t)} <= got


def test_query(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    hits = dc.proximity_hits(docs, spark.read.parquet(f"{sf}/benchmark.parquet")).collect()
    got = {r.doc_id: (r.n_near, r.n_near_items, r.near_items_sha256) for r in queries.queries()["op10_proximity"](spark, sf).collect()}
    expected = {}
    for r in docs.select("doc_id").collect():
        own = [h for h in hits if h.doc_id == r.doc_id]
        names = sorted({h.item_id for h in own})
        expected[r.doc_id] = (len({h.position for h in own}), len(names), brute.sha(",".join(names)))
    assert got == expected and any(n for n, _, _ in got.values())
