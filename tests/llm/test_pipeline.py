import hashlib

import numpy as np

import corpus_pipeline
from tests.llm import brute
from tests.llm.test_short_lines import deduplicated
from tracelake.llm import bpe, language_id


def test_stages_like_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    more = spark.createDataFrame([(7001, None, "en", "s", 0), (7002, "12 !!", "en", "s", 5), (None, "the end of the and", "en", "s", 18)], docs.schema)
    docs = docs.union(more).union(docs.limit(3))
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    out = docs
    for name, stage in corpus_pipeline.STAGES[:4]:
        before = [tuple(r) for r in out.collect()]
        out = spark.createDataFrame(stage(spark, out, sf).collect(), docs.schema)
        after = sorted(map(tuple, out.collect()), key=str)
        assert out.columns == docs.columns
        if name == "language ID":
            model = language_id.fit(language_id.learnable(docs))
            rejected = {r.doc_id for r in language_id.predict(docs, model).where("lang_pred = 'und' or score < 0.5").collect()}
            assert {7001, 7002} <= rejected and len(rejected) < 10
            expected = [r for r in before if r[0] not in rejected]
        elif name == "line dedup":
            texts = deduplicated([r[:2] for r in before])
            expected = [(r[0], t, *r[2:4], len(t)) for r, t in zip(before, texts, strict=True) if t == r[1] or t.strip()]
        elif name == "n-gram Jaccard join":
            expected = list({r[:2]: r for r in before if r[0] is None}.values())
            top = {d: c for d, _, c in brute.similar([r[:2] for r in before if r[0] is not None])}
            expected += list({r[:2]: r for r in before if r[0] is not None and top[r[0]] == r[0]}.values())
        else:
            hit = brute.decontamination([r[:2] for r in before], items)
            expected = [r for r in before if not hit[r[0]][-1]]
        assert after == sorted(expected, key=str), name
        assert len(after) < len(before)
    v = bpe.vocabulary(bpe.default_path())
    import pyarrow as pa

    for r in corpus_pipeline.encode(spark, out.limit(20), sf).collect():
        text = next(x.text for x in out.collect() if x.doc_id == r.doc_id)
        ids, _ = bpe.encode_column(pa.array([text]), v)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(ids.astype(np.uint32).tobytes()).hexdigest(), brute.sha(text))


def test_run(spark, sf):
    rows = corpus_pipeline.run(spark, sf).collect()
    assert 0 < len(rows) < 200 and len({r.doc_id for r in rows}) == len(rows)
