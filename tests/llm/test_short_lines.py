import pyarrow as pa

from tracelake.llm import line_dedup as ld
from tracelake.llm import queries


def deduplicated(docs):
    """The texts after line dedup with exact_short, in the order of docs."""
    long, short, lost = [], set(), {}
    for d, t in sorted(dict.fromkeys(docs), key=lambda x: (x[0] is not None, x[0] or 0)):
        out = []
        for line in (t or "").split("\n"):
            if len(line) >= ld.MIN_CHARS:
                if not any(ld.within(line, s, ld.EDITS) for s in long):
                    out.append(line)
                long.append(line)
            elif not line.strip() or line not in short:
                out.append(line)
                short.add(line)
        lost[d, t] = t if t is None else "\n".join(out)
    return [lost[x] for x in docs]


def test_short_repeats(spark):
    docs = [(None, "z\nLes."), (1, "Les.\nonce\n\n \nLes."), (2, "\n Les.\n\u3000\n日本語の短い文。\nOnce"), (3, "日本語の短い文。\n\n\U0001f600"), (3, "\U0001f600 \nz"), (4, "Les."), (5, None), (6, ""), (7, "a line that is long enough to sign\nz"), (8, "a line that is long enough to sing\nnew")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = sorted(((r.doc_id, r.text) for r in ld.deduplicated(df, exact_short=True).collect()), key=str)
    expected = deduplicated([d for d in docs])
    # documents of one doc_id are ordered by their hash
    assert [r for r in got if r[0] != 3] == sorted(((d, t) for (d, _), t in zip(docs, expected, strict=True) if d != 3), key=str)
    assert {(3, "\n\U0001f600"), (3, "\U0001f600 ")} == {r for r in got if r[0] == 3}


def test_blank_lines_are_not_short_ones():
    _, _, length, _, number = ld._lines(pa.array(["a\n\n \t\nb\u2003"]), 24, True)
    assert (length.tolist(), number.tolist()) == ([1, 2], [0, 3])


def test_query(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    expected = {d: ld.digest_of(t or "") for (d, _), t in zip(docs, deduplicated(docs), strict=True)}
    assert {r.doc_id: r.text_sha256 for r in queries.queries()["op6_line_dedup"](spark, sf).collect()} == expected
