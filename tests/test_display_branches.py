from tracelake.plans import registry

SF = "/root/testdata/sf0.001"


def test_every_branch_is_shown(spark):
    rows = registry.queries()["F21_display"](spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/events.parquet").count()
    assert {r.tokens[-1] for r in rows} >= {"M", "k"} and any(r.tokens.isdigit() for r in rows)
    assert any("h " in r.took for r in rows) and any("m " in r.took and r.took.endswith("s") for r in rows) and any("." in r.took for r in rows)
