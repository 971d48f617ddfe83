import numpy as np
import pyarrow as pa

from tracelake.llm import quality as q


def test_held_out_ranking(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    rows = q.held_out_scores(docs, labels).join(labels, "doc_id").where("held_out").collect()
    good, bad = ([r.score for r in rows if r.quality == k] for k in (1, 0))
    auc = np.mean([[(g > b) + 0.5 * (g == b) for b in bad] for g in good])
    right = np.mean([r.predicted == r.quality for r in rows])
    assert len(bad) > 80 and auc > 0.97 and right > 0.95, (auc, right)


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 5), (2, "", 5), (3, "fine words here", 5), (3, "BAD!! BAD!! BAD!!", 5), (None, "fine words", 5), (4, "w " * 60000, 1)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(1, 1), (3, 0), (None, 1), (4, None), (77, 1)], "doc_id long, quality int")
    rows = q.score(docs, q.fit(docs, labels)).collect()
    assert len(rows) == 6 and all(0 <= r.score <= 1 for r in rows)
    rows = q.held_out_scores(docs, labels.where("false")).collect()
    assert {r.score for r in rows} == {0.5}
    assert q.held_out_scores(docs.where("false"), labels).collect() == []


def test_neighbours_like_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    model = q.fit(docs, labels)
    texts = pa.array([r.text for r in docs.limit(40).collect()])
    cell, weight, count = q.features(texts)
    at = np.append(0, np.cumsum(count))
    got = model.score(texts)
    for i in range(40):
        v = (weight[at[i] : at[i + 1], None] * model.base[cell[at[i] : at[i + 1]]]).sum(axis=0)
        near = np.round(model.vectors @ (v / np.linalg.norm(v)), 5)
        top = sorted(range(len(near)), key=lambda j: (-near[j], j))[: q.NEIGHBOURS]
        votes = np.maximum(near[top], 0).astype(float) ** q.POWER
        assert abs(got[i] - (votes * model.labels[top]).sum() / votes.sum()) < 5e-3
