"""Timeline items are made without the bodies that they don't show."""

import json
from types import SimpleNamespace

from pyspark.sql import functions as F

from tracelake.operators import assemble

LONG = "long " * 1000
MESSAGES = "uuid string, session_id string, parent_uuid string, timestamp string, role string, content_type string, is_meta int, visibility string, agent_id string, text string, ingest_seq long"


def tables(spark):
    said = [
        ("a", "s", None, "1", "user", "text", 0, None, None, LONG, 1), ("b", "s", "a", "2", "assistant", "text", None, None, "s", None, 2), ("c", "s", "b", "3", "assistant", "tool_use", None, "visible", None, None, 3),
        ("r1", "s", "c", "4", "user", "tool_result", 0, None, None, LONG, 4), ("r2", "s", "c", "5", "user", "tool_result", 0, None, None, "", 5), ("r3", "s", "c", "6", "user", "tool_result", 0, None, None, LONG, 6),
        ("d", "s", "c", "7", "assistant", "tool_use", None, None, None, None, 7), ("d1", "s", "d", "8", "user", "skill_instructions", 1, None, None, LONG, 8), ("e", "s", "d", "9", "assistant", "thinking", None, None, None, LONG, 9),
        ("f", "s", "e", "9", "assistant", "thinking", None, None, None, "", 10), ("g", "s", "f", "91", "system", "text", 1, None, None, LONG, 11), ("h", "s", "g", "92", "assistant", "text", None, "hidden", None, LONG, 12),
        ("i", "s", "g", "93", "user", "text", None, None, None, LONG, 13), ("j", "s", "i", "94", "assistant", "text", None, None, None, LONG, 14), ("j:think0", "s", "j", "94", "assistant", "thinking", None, None, None, LONG, 15),
        ("x", "t", None, None, "user", "text", None, None, "ag", LONG, 16),
    ]
    calls = [("k1", "c", "s", "default", LONG, 1), ("k2", "d", "s", "skill", LONG, 2), ("k3", "j", "s", "default", LONG, 3), ("k4", "j", "s", "default", LONG, 4)]
    return SimpleNamespace(
        sessions=spark.createDataFrame([("s", LONG, 1), ("only", LONG, 2)], "id string, title string, ingest_seq long"),
        messages=spark.createDataFrame(said, MESSAGES),
        tool_calls=spark.createDataFrame(calls, "id string, message_uuid string, session_id string, presentation string, input_json string, ingest_seq long"),
        tool_results=spark.createDataFrame([("k1", "r1", "s", LONG, 1), ("gone", "r3", "s", LONG, 2)], "tool_use_id string, message_uuid string, session_id string, content string, ingest_seq long"),
        subagents=spark.createDataFrame([("ag", "t", "k3", 1)], "agent_id string, session_id string, parent_tool_use_id string, ingest_seq long"),
        workflows=spark.createDataFrame([("w", "s", "k3", LONG, 1), ("v", "s", None, LONG, 2)], "run_id string, session_id string, parent_tool_use_id string, script string, ingest_seq long"),
        summaries=spark.createDataFrame([("z", "s", LONG, 1)], "id string, session_id string, content string, ingest_seq long"),
    )


def test_items_are_those_of_the_details(spark):
    t = tables(spark)
    want = sorted((r.session_id, k, i["kind"], i["uuid"]) for r in assemble.details(t).collect() for k, i in enumerate(assemble.items(json.loads(r.detail))))
    assert sorted(map(tuple, assemble.timeline(t).collect())) == want
    assert [(x[2], x[3]) for x in want] == [("message", "a"), ("message", "b"), ("message", "r3"), ("skill", "d"), ("thinking", "e"), ("meta", "g"), ("message", "i"), ("workflow", "j"), ("workflow-tools", "j")]


def test_no_body_is_dealt_out(spark):
    rows = assemble.item_rows(tables(spark))
    assert rows.count() == 16 + 4 + 2 + 2
    assert rows.agg(F.max(F.length("body"))).first()[0] < 250
