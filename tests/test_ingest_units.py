"""Units are read whole, rows that a new reading lacks go, versions are published by one writer each."""

import json
import threading

import pytest
import zstandard

from tests.test_sources import log, user
from tracelake.operators import memories, merge
from tracelake.plans import results, schema
from tracelake.sources import base
from tracelake.streaming import ingest


def tables(store):
    return {n: {tuple(v for k, v in sorted(r.asDict().items()) if k not in ("ingest_seq", "turn_duration_ms")) for r in df.collect()} for n, df in store.tables().items()}


def write(root, path, data):
    (root / path).parent.mkdir(parents=True, exist_ok=True)
    (root / path).write_bytes(data)


def kimi(*texts):
    return log(*({"type": "context.append_message", "message": {"role": "user", "content": t}} for t in texts))


def test_changed_units_are_read_whole_and_retract(spark, tmp_path):
    root, at = tmp_path / "logs", "2024-01-01T00:00:0{}Z"
    write(root, "projects/-w/A.jsonl", log(user("a1", "one"), user("a2", "two", "a1")))
    write(root, "projects/-w/A/subagents/agent-S.jsonl", log(user("s1", "sub", at=at.format(1))))
    write(root, "projects/-w/B.jsonl", log(user("b1", "other")))
    write(root, "k/K/state.json", json.dumps({"id": "K", "title": "named", "agents": {"main": {}}}).encode())
    write(root, "k/K/agents/main/wire.jsonl", kimi("q1", "q2"))
    store = merge.Store(spark, str(tmp_path / "store"))
    ingest.reconcile(spark, str(root), store, "first")
    write(root, "projects/-w/A/subagents/agent-S.jsonl", log(user("s1", "sub", at=at.format(1)), user("s2", "more", "s1", at.format(2))))  # one file of a unit grows
    write(root, "k/K/agents/main/wire.jsonl", kimi("q1"))  # another is cut
    (root / "projects/-w/B.jsonl").unlink()
    found = base.files(spark, str(root), *base.REGISTRY.values())
    changed = {r.path.split("/logs/")[1] for r in base.changed_files(found, store.tables()["index_state"]).select("path").collect()}
    assert changed == {"projects/-w/A.jsonl", "projects/-w/A/subagents/agent-S.jsonl", "k/K/state.json", "k/K/agents/main/wire.jsonl"}
    ingest.reconcile(spark, str(root), store, "second")
    fresh = merge.Store(spark, str(tmp_path / "fresh"))
    ingest.reconcile(spark, str(root), fresh, "all")
    assert tables(store) == tables(fresh)
    now = store.tables()
    assert {r.title for r in now["sessions"].where("source = 'kimi'").collect()} == {"named"} and now["messages"].where("text = 'other'").count() == 0
    assert ingest.reconcile(spark, str(root), store, "third") == store.version()[0] == 2


def test_stream_brings_the_rest_of_a_unit(spark, tmp_path):
    root, store = tmp_path / "logs", merge.Store(spark, str(tmp_path / "store"))
    write(root, "k/K/state.json", json.dumps({"id": "K", "title": "named", "agents": {"main": {}}}).encode())
    ingest.ingest(spark, str(root), store, str(tmp_path / "state"), {"availableNow": True}).awaitTermination()
    write(root, "k/K/agents/main/wire.jsonl", kimi("q1"))
    ingest.ingest(spark, str(root), store, str(tmp_path / "state"), {"availableNow": True}).awaitTermination()
    assert [r.title for r in store.tables()["sessions"].collect()] == ["named"] and store.tables()["messages"].count() == 1


def test_records_are_numbered_by_unit(spark):
    rows = [("s", f"u{u:02d}", i, "messages", "x", "{}") for u in range(30) for i in range(u % 4 + 1)]
    got = base.numbered(spark.createDataFrame(rows, base.RECORDS))
    assert [r.seq for r in got.orderBy("unit", "seq").collect()] == list(range(len(rows)))


def message(spark, uuid):
    row = {**{c: None for c in schema.names_of("messages")}, "uuid": uuid, "session_id": "s", "text": uuid}
    struct = spark.createDataFrame([], schema.struct_of("messages")).schema
    df = spark.createDataFrame([tuple(row.get(f.name) for f in struct)], struct)
    return {"messages": df.withColumnRenamed("ingest_seq", "seq").fillna(0, ["seq"])}


def test_racing_writers_lose_nothing(spark, tmp_path):
    path = str(tmp_path / "store")
    with pytest.raises(merge.Conflict):
        a, b = merge.Store(spark, path), merge.Store(spark, path)
        empty = a.tables()
        a.publish(empty, "a/1", 0)
        b.publish(empty, "b/1", 0)
    done = []
    threads = [threading.Thread(target=lambda i=i: done.append(merge.Store(spark, path).merge(message(spark, f"m{i}"), f"batch/{i}"))) for i in range(3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    store = merge.Store(spark, path)
    assert sorted(done) == [2, 3, 4] and {r.uuid for r in store.tables()["messages"].collect()} == {"m0", "m1", "m2"}
    assert store.merge(message(spark, "again"), "batch/1") in done and store.version()[0] == 4 and store.tables(3)["messages"].count() == 2


def test_old_versions_go_after_the_grace_time(spark, tmp_path):
    store = merge.Store(spark, str(tmp_path / "s"), keep=1, grace=0)
    for i in range(3):
        store.merge(message(spark, f"m{i}"), str(i))
    assert len(list((tmp_path / "s" / "tables").iterdir())) == 1 and store.tables()["messages"].count() == 3


def test_results_and_memory_files(spark, tmp_path):
    said = []
    assert results.run(lambda: {"a": [1, "é"]}, said.append) == 0 and json.loads("".join(said)) == {"a": [1, "é"]} and "\n  " in said[0]
    said.clear()
    results.emit(spark.range(3), said.append)
    assert json.loads("".join(said)) == [{"id": 0}, {"id": 1}, {"id": 2}]
    said.clear()
    results.emit(spark.range(0), said.append)
    assert json.loads("".join(said)) == []
    said.clear()
    assert results.run(lambda: 1 / 0, said.append) == 1 and set(json.loads(said[0])) == {"error", "stack"}
    (tmp_path / "m.md").write_text("# é")
    assert memories.file_text(spark, f"file://{tmp_path}/m.md") == "# é" and memories.file_text(spark, f"file://{tmp_path}/none.md") is None


def test_a_unit_that_cannot_be_read_is_skipped_and_kept(spark, tmp_path):
    def rollout(*texts):
        return zstandard.ZstdCompressor().compress(log({"type": "session_meta", "payload": {"id": "R", "cwd": "/w"}}, *({"type": "event_msg", "payload": {"type": "user_message", "message": t}} for t in texts)))

    def texts(store):
        return sorted(r.text for r in store.tables()["messages"].collect())

    root, store, path = tmp_path / "logs", merge.Store(spark, str(tmp_path / "store")), "rollout-R.jsonl.zst"
    write(root, "projects/-w/A.jsonl", log(user("a1", "one")))
    write(root, path, rollout("first"))
    ingest.reconcile(spark, str(root), store, "whole")
    assert texts(store) == ["first", "one"]
    write(root, path, rollout("first", "second")[:-6])
    write(root, "projects/-w/A.jsonl", log(user("a1", "one"), user("a2", "two", "a1")))
    with pytest.raises(Exception, match="zstd"):
        ingest.reconcile(spark, str(root), store, "stopped", on_error="stop")
    assert texts(store) == ["first", "one"]
    number = ingest.reconcile(spark, str(root), store, "torn")
    assert texts(store) == ["first", "one", "two"]
    state = {r.jsonl_path.rsplit("/", 1)[1]: (r.replay_required, r.cursor) for r in store.tables()["index_state"].collect()}
    assert state["A.jsonl"][0] == 0 and state["rollout-R.jsonl.zst"][0] == 1 and "zstd" in state["rollout-R.jsonl.zst"][1]
    assert ingest.reconcile(spark, str(root), store, "unchanged") == number
    assert ingest.reconcile(spark, str(root), store, "tried again", retry=True) == number + 1 and texts(store) == ["first", "one", "two"]
    write(root, path, rollout("first", "second"))
    ingest.reconcile(spark, str(root), store, "mended")
    assert texts(store) == ["first", "one", "second", "two"]
    assert {r.replay_required for r in store.tables()["index_state"].collect()} == {0}
