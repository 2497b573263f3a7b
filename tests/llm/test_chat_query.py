"""The registered chat query on conversations with calls, against its SQL and against an order worked out here."""

from __future__ import annotations

import json

import duckdb
import pytest
from pyspark.sql import functions as F

from graphloom.llm import chat_format, queries


def call(*calls):
    return json.dumps({"content": "so", "tool_calls": [dict(zip(("id", "name", "arguments", "depends_on"), c, strict=False)) for c in calls]}, separators=(",", ":"))


def result(name, content):
    return json.dumps({"tool_call_id": name, "content": content}, separators=(",", ":"))


ROWS = [
    (1, 0, "system", "be kind"), (1, 1, "user", "x"), (1, 2, "assistant", call(("a", "find", {"q": "x"}), ("b", "find", {"n": 2, "q": "y"}))), (1, 3, "tool", result("b", {"hits": 2})), (1, 4, "tool", result("a", "none")),
    (2, 0, "tool", result("early", 1)), (2, 1, "assistant", call(("early", "find", {}))), (2, 2, "tool", result("nobody", [])), (2, 3, "assistant", call(("open", "find", {"q": "z"}))), (2, 4, "user", '{"not a call": 1}'),
    (3, 0, "user", None), (3, 1, "assistant", ""), (4, 0, "assistant", '{"tool_calls": []}'),
]
SCHEMAS = [("find", "q", "string", True), ("find", "n", "integer", False)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("chat"))
    spark.createDataFrame(ROWS, "conv_id long, turn long, role string, text string").withColumn("k_conv", F.lit(7)).coalesce(1).write.parquet(f"{path}/conversations.parquet")
    return path


def test_the_query_equals_its_sql(spark, folder):
    found = queries.op3_chat_format(spark, folder)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{folder}/conversations.parquet/*.parquet'")
    columns = sorted(found.columns)
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({queries.OP3_SQL})").fetchall()
    assert sorted(map(str, (tuple(r) for r in found.select(*columns).collect()))) == sorted(map(str, want))
    status = {(r.conv_id, r.call_id, r.kind): r.status for r in found.collect() if r.call_id}
    assert status == {
        (1, "a", "call"): "linked", (1, "b", "call"): "linked", (1, "a", "result"): "linked", (1, "b", "result"): "linked",
        (2, "early", "result"): "early", (2, "early", "call"): "unanswered", (2, "nobody", "result"): "orphan", (2, "open", "call"): "unanswered",
    }


def test_calls_follow_what_they_need_and_are_checked(spark):
    rows = [(1, 0, "assistant", call(("c", "find", {"q": 1}, ["b"]), ("b", "find", {"q": "x", "z": 1}, ["a"]), ("a", "find", {"n": 3}))), (1, 1, "tool", result("c", 1)), (1, 2, "tool", result("a", 1)), (1, 3, "tool", result("b", 1))]
    messages = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = chat_format.format_chat(messages, spark.createDataFrame(SCHEMAS, "tool string, name string, type string, required boolean")).collect()
    order = [(r.kind, r.call_id) for r in sorted(found, key=lambda r: (r.anchor, r.level, r.turn, r.item)) if r.call_id]
    assert order == [("call", "a"), ("result", "a"), ("call", "b"), ("result", "b"), ("call", "c"), ("result", "c")]
    assert {r.call_id: list(r.violations) for r in found if r.kind == "call"} == {"a": ["missing:q"], "b": ["unknown:z"], "c": ["type:q"]}


def test_the_query_checks_calls_by_the_tools_of_their_conversation(spark, tmp_path):
    tools = json.dumps({"tools": [{"name": "find", "parameters": {"properties": {"q": {"type": "string"}, "n": {"type": "integer"}}, "required": ["q", "id"]}}, {"name": "stop"}]})
    calls = call(("a", "find", {"q": 1, "id": 2}), ("b", "find", {"n": 1}), ("c", "stop", {}), ("d", "stop", {"now": True}), ("e", "other", {"x": 1}), ("f", "find", {"q": "x", "id": 1}), ("g", "find", 3))
    rows = [(1, 0, "system", tools), (1, 1, "assistant", calls), (2, 0, "assistant", calls), (3, 0, "system", '{"tools": 1}'), (None, 0, "system", tools), (None, 1, "assistant", calls)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    found = queries.op3_chat_format(spark, str(tmp_path)).collect()
    want = {"a": "type:q", "b": "missing:id,missing:q", "c": "", "d": "unknown:now", "e": "", "f": "", "g": "arguments:not an object"}
    for conv in (1, None):
        assert {r.call_id: r.violations for r in found if r.kind == "call" and r.conv_id == conv} == want
    assert {r.violations for r in found if r.conv_id in (2, 3) or r.kind != "call"} == {""} and len(found) == 6 + 21
