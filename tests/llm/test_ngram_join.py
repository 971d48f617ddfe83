import random

import numpy as np
import pytest

from tests.llm import brute
from tracelake.llm import ngram_join as nj


def run(spark, docs):
    d = spark.createDataFrame([(a, b, "x", 1) for a, b in docs], "doc_id long, text string, key string, n int").repartition(3)
    return sorted((tuple(r) for r in nj.similar_documents(d).collect()), key=str)


def test_matches_brute_force(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = run(spark, docs)
    assert got == brute.similar(docs)
    assert any(c != d for d, _, c in got)


def test_edges_of_similarity_chains_and_odd_rows(spark):
    random.seed(5)
    docs = [(1000, None), (1001, ""), (1002, " \t\n"), (1003, "one two"), (1004, "One\ttwo"), (1005, "one two three"), (None, "one two"), (7, "dup"), (7, "dup"), (7, "other"), (1006, "y " * 30000)]
    n = 0
    for size in (6, 8, 9, 12, 20, 45, 130):
        base = [f"w{random.randrange(10**6)}" for _ in range(size)]
        for _ in range(25):
            words = list(base)
            for _ in range(random.randrange(4)):
                words[random.randrange(len(words))] = f"z{random.randrange(50)}"
            if random.random() < 0.3:
                words = words[random.randrange(3) :]
            if random.random() < 0.3:
                words += [f"t{random.randrange(9)}" for _ in range(random.randrange(1 + size // 4))]
            docs.append((n := n + 1, " ".join(words)))
            base = words if random.random() < 0.2 else base
    assert run(spark, docs) == brute.similar(docs)


def test_empty_table(spark):
    assert run(spark, []) == []


@pytest.mark.parametrize("size", [4, 5, 7, 11, 23, 60, 200])
def test_every_similar_pair_shares_a_signature(size):
    rng = np.random.default_rng(size)
    for _ in range(60):
        a = rng.integers(1 << 48, size=size, dtype=np.uint64)
        drop = int(rng.integers(size // 4 + 1))
        for add in range(size):
            left = size - drop
            if left / (size + add) < 0.75:
                break
            b = np.concatenate([a[drop:], rng.integers(1 << 48, size=add, dtype=np.uint64)])
            if len(b) == len(a) and drop == 0:
                continue
            (s, _, c), (t, _, d) = (nj.signatures(np.sort(x), np.array([len(x)]), (75, 100)) for x in (a, b))
            shared = np.intersect1d(s, t) & np.uint64(1)
            alone = int(shared.sum())
            assert len(shared) - alone >= max(c[0], d[0]) or alone >= -(-3 * max(len(a), len(b)) // 4), (size, drop, add)


def test_chunks_without_sets_or_signatures(spark):
    for texts in ([None, "", " "], ["one two"], [None, "one two", "one two"], ["a b c d e"], [" "]):
        assert run(spark, list(enumerate(texts))) == brute.similar(list(enumerate(texts)))


@pytest.mark.parametrize("threshold", [(20, 100), (75, 100), (95, 100)])
def test_any_threshold(spark, threshold):
    random.seed(threshold[0])
    docs = []
    for size in (5, 30, 90, 400):
        base = [f"w{random.randrange(10**6)}" for _ in range(size)]
        for _ in range(20):
            words = list(base)
            for _ in range(random.randrange(1 + size // 8)):
                words[random.randrange(len(words))] = f"z{random.randrange(50)}"
            docs.append((len(docs), " ".join(words[: random.randrange(1, size + 1)] if random.random() < 0.4 else words)))
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = sorted((tuple(r) for r in nj.similar_documents(d, threshold=threshold).collect()), key=str)
    assert got == brute.similar(docs, *threshold)


@pytest.mark.parametrize("block", [3, 16, 1000])
def test_blocks_and_units_lose_no_link(spark, monkeypatch, block):
    """A cluster of near copies around the threshold, and sets with a common passage, in blocks of any size."""
    monkeypatch.setattr(nj, "BLOCK", block)
    random.seed(block)
    base = [f"w{i}" for i in range(60)]
    docs = []
    for _ in range(60):
        words = [x if random.random() > 0.045 else f"z{random.randrange(10**6)}" for x in base]
        docs.append((len(docs), " ".join(words)))
    for _ in range(60):
        docs.append((len(docs), " ".join(base[:25] + [f"y{random.randrange(10**6)}" for _ in range(random.randrange(20))])))
    assert run(spark, docs) == brute.similar(docs)


def test_forest_of_links():
    rng = np.random.default_rng(4)
    base = rng.integers(1 << 48, size=40, dtype=np.uint64)
    sets = []
    for _ in range(80):
        own = base.copy()
        own[rng.random(40) < 0.16] = rng.integers(1 << 48, dtype=np.uint64)
        sets.append(np.unique(own))
    root = rng.integers(0, 70, 80)
    block = rng.integers(0, 2, 80)
    for across in (False, True):
        found = nj.linked(sets, root, block, across, (75, 100))
        top = {int(r): int(r) for r in root}
        top2 = dict(top)

        def find(t, x):
            while t[x] != x:
                x = t[x]
            return x

        for x, y in found:
            a, b = find(top, int(root[x])), find(top, int(root[y]))
            assert a != b and (not across or block[x] != block[y])
            top[a] = b
        for x in range(80):
            for y in range(x):
                s = len(np.intersect1d(sets[x], sets[y]))
                if 4 * s >= 3 * (len(sets[x]) + len(sets[y]) - s) and (not across or block[x] != block[y]):
                    top2[find(top2, int(root[x]))] = find(top2, int(root[y]))
        assert all((find(top, int(a)) == find(top, int(b))) == (find(top2, int(a)) == find(top2, int(b))) for a in root for b in root)
