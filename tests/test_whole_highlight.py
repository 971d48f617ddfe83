from tracelake.plans import registry

SF = "/root/testdata/sf0.001"


def test_highlight_beyond_the_first_characters(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    shown = {r.doc_id: r.shown for r in registry.queries()["F20_highlight_whole"](spark, SF).collect()}
    assert {d: s.replace("<mark>", "").replace("</mark>", "") for d, s in shown.items() if s is not None} == {d: t for d, t in texts.items() if t is not None}
    assert all(s.count("<mark>") == texts[d].lower().count("the") for d, s in shown.items() if s and texts[d].isascii())
    assert any("<mark>" in s[400:] for s in shown.values() if s)
