"""Names that clash, ties, missing ids, several blocks of a test set, racing commits, and plain recounts."""

import hashlib
import math
import random
import threading

import pytest

from tests.llm import brute
from tests.llm.test_language_id import features
from tracelake.llm import chat, decontamination, language_id, line_dedup, privacy, token_counts
from tracelake.llm.shared import shared_dir


def test_language_scores_like_plain_bayes(spark):
    random.seed(2)
    letters = {"aa": "abcdé", "bb": "cdefg", "cc": "efgah"}
    rows = [(i, "".join(random.choices(letters[x] + " ", k=random.randrange(1, 40))), x) for i, x in enumerate(random.choices(sorted(letters), k=60))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    learned = [(t, x) for i, t, x in rows if __import__("zlib").crc32(str(i).encode()) % 4 != 2]
    names = sorted({x for _, x in learned})
    count = {x: {} for x in names}
    for t, x in learned:
        for f in features(t):
            count[x][f] = count[x].get(f, 0) + 1
    for r in language_id.held_out_predictions(docs).collect():
        own = features(rows[r.doc_id][1])
        if not own:
            assert (r.lang_pred, r.score) == ("und", 0)
            continue
        logs = []
        for x in names:
            total = sum(count[x].values()) + 0.5 * language_id.FEATURES
            logs.append(math.log(sum(y == x for _, y in learned) / len(learned)) + sum(math.log((count[x].get(f, 0) + 0.5) / total) for f in own))
        best = max(range(len(names)), key=lambda k: logs[k])
        assert r.lang_pred == names[best] and math.isclose(r.score, 1 / sum(math.exp(v - logs[best]) for v in logs), rel_tol=1e-9)


def test_clashing_names(spark):
    docs = spark.createDataFrame([(1, "the end of it, and the other", "en", 5, 6, 7, 8), (2, "mail a@b.cc", "en", 5, 6, 7, 8)], "doc_id long, text string, lang string, score int, __d int, __rk int, __s int")
    model = language_id.fit(docs)
    got = language_id.predict(docs, model, lang_pred="p", score="q")
    assert got.columns == [*docs.columns, "p", "q"] and got.select("score").distinct().collect()[0][0] == 5
    assert language_id.predict(docs, model).columns == ["doc_id", "text", "lang", "__d", "__rk", "__s", "lang_pred", "score"]
    kept = line_dedup.deduplicated(docs)
    assert kept.columns == [*docs.columns, "n_lines", "n_dropped", "n_left"] and [tuple(r)[4:7] for r in kept.collect()] == [(6, 7, 8)] * 2
    clean = privacy.sanitized(docs)
    assert clean.columns == docs.columns and {r.doc_id: r.text for r in clean.collect()}[2] == "mail <EMAIL>"


def test_turns_of_one_number_go_by_role_and_text(spark):
    turns = [("user", "ab!"), ("user", "ab"), ("user", "<|im_end|>"), ("user", "<|im_a"), ("user", "<|"), ("a%", "z"), ("a", "z")]
    rows = spark.createDataFrame([(1, 0, r, t) for r, t in turns], "conv_id long, turn long, role string, text string")
    got = chat.digests(chat.formatted_turns(rows)).collect()[0]
    assert got.turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in sorted(turns)).encode()).hexdigest()


@pytest.mark.parametrize("words", [1_000_000, 30])
def test_blocks_of_a_test_set_are_as_good_as_one(spark, monkeypatch, words):
    monkeypatch.setattr(decontamination, "BLOCK_WORDS", words)
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").select("item_id", "text").collect()][:12]
    items += [(None, docs[0][1]), (None, "no such words here"), (-5, " ".join(docs[1][1].split()[:14]))]
    table = spark.createDataFrame(items, f"item_id {spark.read.parquet('/root/testdata/sf0.001/benchmark.parquet').schema['item_id'].dataType.simpleString()}, text string") if not isinstance(items[0][0], str) else spark.createDataFrame([(None if a is None else str(a), b) for a, b in items], "item_id string, text string")
    source = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    hits = decontamination.phrase_hits(source, table)
    expected = brute.decontamination(docs, [("" if i is None else i, t) for i, t in items])
    assert {r[0]: tuple(r)[1:] for r in decontamination.digest(hits).collect()} == expected
    for r in hits.collect():
        assert all(a.stop < b.start for a, b in zip(r.spans, r.spans[1:], strict=False))
    near = decontamination.proximity_digests(source, table)
    found = {(r.doc_id, r.item_id, r.position) for r in decontamination.proximity_hits(source, table).collect()}
    by = {}
    for d, i, at in found:
        by.setdefault(d, (set(), set()))
        by[d][0].add(at)
        by[d][1].add(i)
    assert {r.doc_id: (r.n_near, r.n_near_items) for r in near.collect()} == {d: tuple(map(len, by.get(d, ((), ())))) for d, _ in docs}


def test_racing_commits_count_once(spark):
    rollup = token_counts.TokenRollup(spark, shared_dir(spark))
    changes = spark.createDataFrame([("insert", "s", "l", "t", 5, None)], "op string, source string, lang string, tokenizer string, n_tokens long, old_tokens long")
    told = []
    threads = [threading.Thread(target=lambda: told.append(rollup.apply("one/batch", changes))) for _ in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(told) == [False, False, False, True] and [tuple(r) for r in rollup.totals().collect()] == [("s", "l", "t", 1, 5)]
