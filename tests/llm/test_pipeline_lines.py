import corpus_pipeline
from tests.llm.test_short_lines import deduplicated
from tracelake.llm import line_dedup

LINE = "this long licence line stands in both of the documents"


def left(spark, docs):
    df = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in docs], "doc_id long, text string, lang string, source string, n_chars long")
    return sorted((r.doc_id, r.text, r.n_chars) for r in corpus_pipeline.drop_lines(spark, df, "").collect())


def test_short_lines_keep_a_document(spark):
    docs = [(1, f"{LINE}\nfirst"), (2, f"{LINE}\na poem\nin lines"), (3, LINE), (4, f"{LINE}\n \n")]
    assert left(spark, docs) == [(1, docs[0][1], len(docs[0][1])), (2, "a poem\nin lines", 15)]


def test_documents(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    texts = deduplicated(docs)
    expected = [(d, new, len(new)) for (d, old), new in zip(docs, texts, strict=True) if new == old or new.strip()]
    assert left(spark, docs) == sorted(expected)
    assert len(expected) < len(docs)
