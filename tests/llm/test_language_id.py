import unicodedata

import pyarrow as pa

from tracelake.llm import language_id as li


def features(text):
    """Plain n-grams of one text, hashed one by one."""
    blank, kept = True, [0]
    for c in text or "":
        if unicodedata.category(c)[0] == "L":
            x = c.lower()
            kept.append(ord(x) if len(x) == 1 else ord(c))
            blank = False
        elif not blank:
            kept.append(0)
            blank = True
    if not any(kept):
        return []
    m = 0xFFFFFFFF

    def finish(h):
        h = (h ^ (h >> 15)) * 0x2C1B3C6D & m
        return (h ^ (h >> 13)) & (li.FEATURES - 1)

    out = []
    for i, a in enumerate(kept):
        b = kept[i + 1] if i + 1 < len(kept) else 0
        c = kept[i + 2] if i + 2 < len(kept) else 0
        two = (a * 0x9E3779B1 + b * 0x85EBCA77) & m
        out += [finish(two), finish((two * 0x27D4EB2F + c * 0xC2B2AE3D + 0x165667B1) & m)]
    return out


TEXTS = ["Ab c", None, "", "12 !", "a", " a ", "É--é x9y", "ÇA İ ß", "!!a", "a!!", "...", "z z", "你好 ok", "x"]


def test_grams_like_a_plain_loop():
    for texts in (TEXTS, TEXTS[::-1], ["", None], ["1"], ["a"], ["!a", "b!", "!"]):
        got, counts = li.grams(pa.array(texts, pa.string()))
        assert counts.tolist() == [len(features(t)) for t in texts]
        assert got.tolist() == [f for t in texts for f in features(t)]


def test_held_out_accuracy_and_odd_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang", "source")
    more = spark.createDataFrame([(90001, None, "en", "x"), (90002, "", None, "x"), (90003, "12 34 !!", "en", None), (None, "the of and", "en", "x"), (5, "der die und nicht", None, "x")], docs.schema)
    rows = li.held_out_predictions(docs.union(more)).collect()
    assert len(rows) == docs.count() + 5
    odd = {r.doc_id: r for r in rows if r.doc_id is None or r.doc_id > 90000}
    assert [odd[i].lang_pred for i in (90001, 90002, 90003, None)] == ["und", "und", "und", "en"] and odd[90001].score == 0
    truth = {r.doc_id: r.lang for r in docs.collect()}
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    right = sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held)
    assert len(held) > 150 and right > 0.97, right
    assert all(0 <= r.score <= 1 for r in rows)


def test_nothing_to_learn_and_empty(spark):
    one = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert [r.lang_pred for r in li.held_out_predictions(one).collect()] == ["und"]
    assert li.held_out_predictions(one.where("false")).collect() == []


def test_ties_go_to_the_first_name(spark):
    rows = spark.createDataFrame([(1, "abc", "zz"), (2, "abc", "aa")], "doc_id long, text string, lang string")
    model = li.fit(rows)
    assert [r.lang_pred for r in li.predict(rows, model).collect()] == ["aa", "aa"]
