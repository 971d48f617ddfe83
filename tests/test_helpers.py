"""Edge cases of the query helpers on small hand-made tables."""

import pytest
from pyspark.sql import functions as F

from tracelake.functions import predicates as p
from tracelake.functions import scalars
from tracelake.operators import assemble, finalize, guard, memories, merge, messages, search, sessions, tools
from tracelake.plans import schema
from tracelake.plans.engine import Engine, MemoryAdmin


class Fake:
    """Canonical tables from dictionaries."""

    def __init__(self, spark, **rows):
        self.spark = spark
        for name in schema.TABLES:
            names = [*schema.names_of(name), "ingest_seq"]
            data = [[r.get(c, i if c == "ingest_seq" else None) for c in names] for i, r in enumerate(rows.get(name, []))]
            setattr(self, name, spark.createDataFrame(data, schema.struct_of(name)))


def m(uuid, text="t", parent=None, at=None, **more):
    return {"uuid": uuid, "session_id": "s", "parent_uuid": parent, "timestamp": at, "role": "user", "text": text, "content_type": "text", **more}


@pytest.fixture(scope="module")
def found(spark):
    return Fake(
        spark,
        sessions=[{"id": "s", "title": "T", "project": "pr", "project_path": "/w", "started_at": "1", "ended_at": "5"}, {"id": "s2", "project": "pr", "started_at": "3"}, {"id": "x-s-y", "title": "", "project": None, "ended_at": "9", "source": "pi"}],
        messages=[
            m("a", "needle one", None, "2024-01-01T00:00:01.000Z"), m("b", "meta needle", "a", "2024-01-01T00:00:02.000Z", is_meta=1, harness_kind="other"), m("c", "needle hidden", "b", "2024-01-01T00:00:03.000Z", visibility="hidden"),
            m("d", "inactive needle", "c", "2024-01-01T00:00:04.000Z", visibility="inactive"), m("e", "odd needle", "d", None, visibility="odd"), m("f", "last café needle", "d", "2024-01-01T00:00:04.000Z"), m("g", None, "missing", "2024-01-01T00:00:06.000Z"),
            m("l1", "x", "l2", session_id="loop"), m("l2", "x", "l1", session_id="loop"), m("self", "x", "self", session_id="loop"),
            m("t", "u", "f", "2024-01-01T00:00:07.000Z", agent_id="ag", input_tokens=0), m("r", "Exit", None, "2024-01-01T00:00:05.000Z"),
        ],
        tool_calls=[{"id": "c1", "message_uuid": "a", "session_id": "s", "name": "Bash", "file_path": "/f"}, {"id": "c2", "message_uuid": "c", "session_id": "s", "name": "Bash"}],
        tool_results=[{"tool_use_id": "c1", "message_uuid": "r", "session_id": "s", "content": "exit CODE 3"}, {"tool_use_id": "c2", "message_uuid": "r", "session_id": "s", "content": "x", "is_error": 1}, {"tool_use_id": "none", "message_uuid": "nowhere", "session_id": "s", "content": "Exit code 1"}],
        subagents=[{"agent_id": "ag", "session_id": "s"}, {"agent_id": "idle", "session_id": "s", "total_tokens": 4}],
        memories=[{"id": "m1", "path": "/p", "summary": "needle", "project": "pr", "created_at": "2"}, {"id": "m2", "path": "/needle", "summary": "x", "deleted_at": "3", "deleted_reason": "old"}],
    )


def ids(df, c="uuid"):
    return [r[c] for r in df.collect()]


def test_search_filters_and_fallback(found):
    hits = lambda text, **o: set(ids(search.search(found.messages, found.sessions, text, **o)))
    assert hits("needle") == {"a", "f"} and hits("needle", include_meta=True) == {"a", "b", "f"} and hits("needle", include_inactive=True) == {"a", "d", "f"}
    assert hits("CAFE") == {"f"} and hits('"last cafe"') == {"f"} and hits("need*") == {"a", "f"} and hits("needle NOT one") == {"f"} and hits("NEAR(last needle, 1)") == {"f"}
    assert hits("one absent") == set() and hits("one absent", fallback="or") == {"a"} and hits("!!!") == set() and hits('needle "') == {"a", "f"}
    assert hits("needle", source="pi") == set() and hits("needle", after="2024-01-01T00:00:01.000Z") == {"f"}
    with pytest.raises(ValueError, match="non-negative"):
        search.search(found.messages, found.sessions, "a", limit=-1)
    assert search.best_window("a b c needle d e f", [search.Phrase(("needle",))], 3) == "…needle d e…"


def test_message_envelopes(found):
    ask = lambda **o: messages.query(found.messages, found.sessions, **o)
    got = ask(around="f", before_count=1, after_count=1, include_session=True)
    assert [x["uuid"] for x in got["messages"]] == ["a", "f", "r"] and got["has_more"] and got["session"]["id"] == "s"
    assert ask(uuid="c") is None and ask(uuid="d") is None and ask(uuid="d", include_inactive=True)["anchor"]["uuid"] == "d"
    up = ask(around="f", relation="parents", before_count=5)
    assert [x["uuid"] for x in up["messages"]] == ["a", "f"] and not up["has_more"]
    page = ask(session_id="s", limit=2)
    assert [x["uuid"] for x in page["messages"]] == ["a", "f"] and page["next_cursor"]["uuid"] == "f"
    assert [x["uuid"] for x in ask(session_id="s", cursor=page["next_cursor"])["messages"]] == ["r", "g", "t"]
    assert [x["uuid"] for x in ask(session_id="s", agent_id=None)["messages"]] == ["a", "f", "r", "g"]
    for anchor in ("l1", "self"):
        with pytest.raises(ValueError, match="cyclic"):
            ask(around=anchor, relation="parents")
    for bad, error in (({}, TypeError), ({"uuid": "a", "around": "b"}, TypeError), ({"uuid": " "}, TypeError), ({"uuid": "a", "limit": 1}, TypeError), ({"around": "a", "before_count": 501}, ValueError), ({"around": "a", "relation": "parents", "after_count": 1}, ValueError), ({"session_id": "s", "content_types": []}, TypeError), ({"session_id": "s", "cursor": {"uuid": ""}}, TypeError), ({"x": 1}, TypeError)):
        with pytest.raises(error):
            ask(**bad)


def test_chains_stop_at_cycles_and_gaps_and_are_deep(spark, found):
    chain = lambda u: [r.uuid for r in messages.parent_chains(found.messages, found.messages.where(F.col("uuid") == u), True).orderBy("depth").collect()]
    assert chain("f") == ["f", "b", "a"] and chain("g") == ["g"] and chain("l1") == ["l1", "l2"] and chain("self") == ["self"]
    deep = Fake(spark, messages=[m(f"n{i:05d}", parent=f"n{i - 1:05d}" if i else None) for i in range(1500)])
    assert messages.ancestors(deep.messages, deep.messages.where("uuid = 'n01499'")).agg(F.max("depth")).first()[0] == 1499


def test_context_nulls_first_and_order(found):
    hit = found.messages.where("uuid = 'f'")
    rows = tools.neighbours_in_time(hit, found.messages, 3, include_inactive=True).orderBy("k").collect()
    assert [r.uuid for r in rows] == ["d", "r", "g"]


def test_failures_keep_orphans_and_visibility(found):
    failed = tools.failures(found.tool_results, found.tool_calls, found.messages, found.sessions)
    assert [(r.tool_use_id, r.visibility) for r in failed.collect()] == [("c1", "visible"), ("none", "visible")]
    assert ids(tools.next_messages(failed, found.messages).orderBy("k")) == ["g", "t"]


def test_sessions_fragments_and_limits(found):
    assert ids(sessions.sessions(found.sessions, ["s"]), "id") == ["s"]
    assert ids(sessions.sessions(found.sessions, ["-s-"]), "id") == ["x-s-y"] and ids(sessions.sessions(found.sessions, ["-s-"], source="claude"), "id") == []
    assert ids(sessions.sessions(found.sessions, limit=0), "id") == [] and ids(sessions.sessions(found.sessions, project="PR"), "id") == ["s", "s2"]
    with pytest.raises(ValueError):
        sessions.sessions(found.sessions, limit=-2)
    page, total = sessions.catalogue(found.sessions, titled=False)
    assert ids(page, "id") == ["s2"] and total.first().total == 1


def test_engine(found):
    e = Engine(found, session_id="s")
    assert [(r.agent_id, r.total_tokens, r.message_count) for r in e.subagents("s").collect()] == [("ag", 0, 1), ("idle", 4, 0)]
    assert [r.is_invoking for r in e.sessions(1).collect()] == [False] and e.recent(3).count() == 3
    assert ids(e.memories(query="needle"), "id") == ["m1"] and ids(e.memories(query="!!"), "id") == [] and ids(e.memories(), "id") == ["m1"]
    assert ids(e.file_history("/f"), "id") == ["c1"] and ids(e.trace("f")) == ["a", "b", "f"] and e.context("c") is None and [x["uuid"] for x in e.context("f")["parent_chain"]] == ["a", "b"]
    got = e.overview(project="pr")
    assert got["current"]["project"]["confidence"] == "exact" and got["current_project"]["session_total"] == 2 and got["totals"]["memories"] == 1
    assert e.overview(cwd="/w/sub")["current"]["project"]["from"] == "cwd_project_path" and e.overview(project="zz%")["current"]["project"]["confidence"] == "unknown"
    with pytest.raises(ValueError, match="English"):
        e.memories(query="日本")


@pytest.mark.parametrize("bad", ["drop table sessions", "insert into sessions values (1)", "select 1; select 2", "create view v as select 1", "with a as (select 1) insert into sessions select * from a", "", "show tables", "set a=b"])
def test_guard_refuses(found, bad):
    with pytest.raises(guard.ReadOnlyError):
        guard.read_only(found, bad)


def test_guard_binds(found):
    assert [r[0] for r in Engine(found).sql("-- note\nselect id from sessions where id = ? or id = ? order by id", "s", "s2' or '1'='1").collect()] == ["s"]


def test_memories_are_soft_deleted_once(found):
    admin = MemoryAdmin(found)
    new = admin.remember(path="/n", summary="text", session_id="s", anchors=["u"])
    assert new["project"] == "pr" and admin.table.count() == 3
    assert admin.forget(new["id"], " why ")["deleted_reason"] == "why" and admin.forget(new["id"], "again")["deleted_reason"] == "why"
    assert admin.forget("m2", "x")["already_deleted"]
    for bad in ({"path": "", "summary": "x"}, {"path": "p", "summary": "記"}):
        with pytest.raises(ValueError):
            admin.remember(**bad)
    with pytest.raises(ValueError):
        admin.forget("none", "x")
    ids_ = iter(["m1", "m1", "free"])
    assert memories.remember(found.memories, found.sessions, "/p", "s", new_id=lambda: next(ids_))[1]["id"] == "free"


def test_merge_order_and_barriers(spark, found):
    empty = Fake(spark)
    tables = {n: getattr(empty, n) for n in schema.TABLES}
    rows = spark.createDataFrame([("u", "s", "old", 1), ("u", "s", "new", 5), ("v", "s", "gone", 2)], "uuid string, session_id string, text string, seq long")
    deletes = spark.createDataFrame([("s", 3)], "session_id string, seq long")
    out = merge.apply(tables, {"messages": rows, "deletes": deletes})
    assert [(r.uuid, r.text) for r in out["messages"].collect()] == [("u", "new")]
    again = merge.apply(out, {"messages": rows.where("seq = 5")})
    assert again["messages"].collect() == out["messages"].collect() and merge.changed(out["messages"], rows.where("seq = 5"), "messages").isEmpty()
    gone = merge.delete_sessions({n: getattr(found, n) for n in schema.TABLES}, spark.createDataFrame([("ag",)], "session_id string"))
    assert "t" not in ids(gone["messages"]) and gone["subagents"].count() == 1


def test_store_publishes_a_batch_once(spark, tmp_path):
    store = merge.Store(spark, str(tmp_path / "store"))
    rows = spark.createDataFrame([("u", "s", "x", 1)], "uuid string, session_id string, text string, seq long")
    assert store.merge({"messages": rows}, "b1") == 1 and store.merge({"messages": rows.withColumn("text", F.lit("y"))}, "b1") == 1
    assert ids(store.tables()["messages"], "text") == ["x"] and store.version() == (1, "b1")
    assert Engine.open(spark, store.folder(1)).t.messages.count() == 1


def test_assembly():
    call = {"id": "k", "message_uuid": "2", "name": "Agent", "presentation": "default"}
    rows = {
        "sessions": [{"id": "s", "title": "T", "source": "claude"}], "tool_calls": [call], "tool_results": [{"tool_use_id": "k", "message_uuid": "4", "content": "r", "is_error": 0}], "subagents": [{"agent_id": "ag", "session_id": "s", "parent_tool_use_id": "k"}], "workflows": [], "summaries": [{"id": "z", "visibility": "hidden"}],
        "messages": [m("1", "ask", None, "1"), m("2", None, "1", "3", role="assistant", content_type="tool_use"), m("1a", "say", "1", "2", role="assistant"), m("1a:think1", "hm", "1a", "2", role="assistant", content_type="thinking"), m("4", "r", "2", "4", content_type="tool_result"), m("5", "no", "4", "5", visibility="inactive"), m("6", "sub", None, "3", role="assistant", agent_id="ag"), m("7", "next", "4", "6")],
    }
    got = assemble.detail(rows)
    assert [x["uuid"] for x in got["messages"]] == ["1", "1a", "7"] and got["messages"][1]["_thinking"] == "hm" and got["messages"][1]["tool_calls"][0]["result"]["content"] == "r" and got["summaries"] == []
    found = assemble.usf(rows)
    assert len(found["turns"]) == 2 and assemble.problems(found) == [] and assemble.problems({"usf": 2, "turns": [{"steps": [{}]}]}) != []
    tool = next(s for t in found["turns"] for s in t["steps"] if s.get("tools"))
    assert [s["text"] for s in tool["runs"][0]["steps"]] == ["sub"]
    assert all("state" not in s for t in assemble.published(found)["turns"] for s in t["steps"])


def test_titles_paths_and_scalars(spark):
    texts = ["[agent x] <system-reminder>a\nb</system-reminder>\n\nWarm up\n  real   title ", "..\nab\n<tag>\nuse me", "x" * 90, "!!", None]
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(finalize.title_of("t")).collect()]
    assert got == ["real   title", "use me", "x" * 79 + "…", None, None]
    kinds = [("<command-name>/x</command-name>", 0), ("[Request interrupted by user]", 0), ("[Request interrupted by user] why", 0), ("Base directory for this skill: /x", 1), ("Base directory for this skill: /x", 0), ("x", 1), (None, 0)]
    assert [r[0] for r in spark.createDataFrame([(i, *k) for i, k in enumerate(kinds)], "i int, t string, m int").orderBy("i").select(scalars.harness_kind("t", "m")).collect()] == ["command", "interruption", None, "skill", None, "other", None]
    row = spark.range(1).select(
        scalars.canonical_timestamp(F.lit("2024-01-01T02:00:00+02:00")).alias("a"), scalars.canonical_timestamp(F.lit("2024-01-01T02:00")).alias("b"), scalars.canonical_timestamp(F.lit("junk")).alias("c"), scalars.canonical_timestamp(F.lit("")).alias("d"),
        scalars.folded_tokens(F.lit(None).cast("long"), F.lit(0)).alias("e"), scalars.folded_tokens(F.lit(None).cast("long")).alias("f"), scalars.shown_tokens(F.lit(1500)).alias("g"), scalars.shown_duration(F.lit(3_720_000)).alias("h"),
        p.shown_visibility(F.lit("odd")).alias("i"), p.is_failure(F.lit(None).cast("int"), F.lit("EXIT CODE 1")).alias("j"), p.project_label(F.lit(None).cast("string"), F.lit("-a-b")).alias("k"), scalars.highlighted(F.lit("a.b A.B"), "a.b").alias("l"),
    ).first()
    assert tuple(row) == ("2024-01-01T00:00:00.000Z", "2024-01-01T02:00", "junk", None, 0, None, "1.5k", "1h 2m", "hidden", True, "a-b", "<mark>a.b</mark> <mark>A.B</mark>")
