"""The work of assembling a session follows the number of its rows."""

from tracelake.operators import assemble


class Id(str):
    """A text that counts how often it is compared."""

    compared = 0
    __hash__ = str.__hash__

    def __eq__(self, other):
        Id.compared += 1
        return str.__eq__(self, other)


def m(uuid, at, **more):
    return {"uuid": uuid, "session_id": "s", "timestamp": at, "role": "assistant", "content_type": "text", "text": uuid, **more}


def rows(messages, calls=(), results=(), flows=()):
    return {"sessions": [{"id": "s"}], "messages": list(messages), "tool_calls": list(calls), "tool_results": list(results), "subagents": [], "workflows": list(flows), "summaries": []}


def test_calls_of_one_message_are_looked_up():
    n = 400
    calls = [{"id": Id(f"k{i}"), "message_uuid": "a"} for i in range(n)]
    results = [{"tool_use_id": Id(f"k{i}"), "message_uuid": f"r{i}", "content": str(i)} for i in reversed(range(n))]
    told = [m(f"r{i}", "2", role="user", content_type="tool_result") for i in range(n)]
    Id.compared = 0
    got = assemble.detail(rows([m("a", "1"), *told, m("z", "3", role="user", content_type="tool_result")], calls, results))
    assert Id.compared < 10 * n
    assert [x["uuid"] for x in got["messages"]] == ["a", "z"]
    assert [c["result"]["content"] for c in got["messages"][0]["tool_calls"]] == [str(i) for i in range(n)]


def test_runs_of_calls_and_of_thinking():
    n = 50
    uses = [m(f"u{i:02}", "2", content_type="tool_use", text=None) for i in range(n)]
    calls = [{"id": f"k{i}", "message_uuid": f"u{i:02}"} for i in range(n)]
    skill = [{"id": "s1", "message_uuid": "v", "presentation": "skill"}]
    thoughts = [m("w1", "4", content_type="thinking", text=None), m("w2", "4", content_type="thinking", text=""), m("w3", "4", content_type="thinking", text="hm"), m("w4", "4", content_type="thinking", text="so"), m("w5", "5", content_type="thinking", role="user", text=None)]
    got = assemble.detail(rows([m("a", "1"), *uses, m("v", "3", content_type="tool_use", text=None), m("v1", "3", content_type="skill_instructions", text="how"), *thoughts], calls + skill))["messages"]
    assert [(x["uuid"], x["text"], [c["id"] for c in x["tool_calls"]], x.get("_skillMd")) for x in got] == [
        ("a", "a", [f"k{i}" for i in range(n)], None), ("v", None, ["s1"], "how"), ("w1", "hm\n\nso", [], None), ("w5", None, [], None),
    ]


def test_a_message_twice_keeps_its_calls_apart():
    got = assemble.detail(rows([m("a", "1"), m("u", "2", content_type="tool_use"), m("u", "2", content_type="tool_use")], [{"id": "k", "message_uuid": "u"}]))["messages"]
    assert [[c["id"] for c in x["tool_calls"]] for x in got] == [["k", "k"]]
