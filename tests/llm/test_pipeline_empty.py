import corpus_pipeline


def test_stages_on_empty_tables(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    items.limit(0).write.parquet(f"{tmp_path}/none/benchmark.parquet")
    some = docs.limit(20)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf).collect() == []
    kept = corpus_pipeline.decontaminate(spark, some, f"{tmp_path}/none")
    assert sorted(map(tuple, kept.collect())) == sorted(map(tuple, some.collect()))


def test_columns_of_the_model_s_names_pass(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(30).selectExpr("*", "7 as score", "'x' as lang_pred")
    out = corpus_pipeline.identify_language(spark, docs, sf)
    assert out.columns == docs.columns and {(r.score, r.lang_pred) for r in out.collect()} == {(7, "x")}
