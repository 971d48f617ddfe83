import corpus_pipeline
from tests.llm import brute
from tracelake.llm import bpe


def test_ids_and_offsets_stay(spark):
    docs = [(1, "The end of thé 😀 line\n"), (2, ""), (3, None), (1, "another text")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    rows = corpus_pipeline.encode(spark, df, "").collect()
    assert sorted((r.doc_id, r.ids, r.ends) for r in rows) == sorted(map(tuple, bpe.encode(df).collect()))
    assert sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows) == sorted(map(tuple, bpe.digests(df).collect()))
    assert all(len(r.ids) == len(r.ends) == r.n_tokens for r in rows)
    data = bpe.decode(spark.createDataFrame([(i, r.ids) for i, r in enumerate(rows)], "doc_id long, ids array<int>")).collect()
    assert sorted(brute.sha(bytes(x.data)) for x in data) == sorted(brute.sha(t or "") for _, t in docs)
