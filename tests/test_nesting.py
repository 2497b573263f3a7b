"""Nodes and lists in place: nothing is left out, whatever keeps its label."""

from __future__ import annotations

import duckdb
import pytest

from graphloom.operators import nesting
from graphloom.plans.queries import QUERIES, SQL
from graphloom.schema import FIRST, NIL, QUAD, REST
from graphloom.sources import turtle


@pytest.mark.parametrize("chars", [nesting.IN_PLACE_CHARS, 200])
def test_long_lists_come_back_whole(spark, tmp_path, monkeypatch, chars):
    """More than 1,000 turns, texts with ``_:``, a number below zero; with few characters in place, lists keep labels over several documents (F2, F3)."""
    monkeypatch.setattr(nesting, "IN_PLACE_CHARS", chars)
    turns = [(7, i, "user", f"turn {i} of _:seven") for i in range(1200)] + [(-3, i, "user", f'say "{i}" _:x .') for i in range(3)] + [(c, i, "user", f"{c} {i}") for c in range(20, 40) for i in range(c % 5 + 1)]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").repartition(3).write.parquet(str(tmp_path / "conversations.parquet"))
    found = QUERIES["turtle_nested_roundtrip"](spark, str(tmp_path)).select("s", "position", "o", "note").collect()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    assert sorted(map(tuple, found)) == sorted(con.execute(f"SELECT s, position, o, note FROM ({SQL['turtle_nested_roundtrip']})").fetchall())


def test_large_and_deep_nodes_keep_all_triples(spark, monkeypatch):
    row = lambda s_kind, s, p, o_kind, o: (None, None, s_kind, s, p, o_kind, o, None, None)
    rows = [row(0, "http://e/top", "http://e/p", 1, "d|n0")] + [row(1, f"d|n{i}", "http://e/p", 1, f"d|n{i + 1}") for i in range(30)]
    rows += [row(0, "http://e/top", "http://e/wide", 1, "d|w")] + [row(1, "d|w", "http://e/q", 2, f"{i}") for i in range(150)]
    rows += [row(0, "http://e/top", "http://e/list", 1, "d|l0")] + [x for i in range(1100) for x in (row(1, f"d|l{i}", FIRST, 2, f"{i}"), row(1, f"d|l{i}", REST, *((1, f"d|l{i + 1}") if i < 1099 else (0, NIL))))]
    q = spark.createDataFrame(rows, QUAD)
    texts = [d.text for d in turtle.documents(q, {"e": "http://e/"}, 4, nested=True).collect()]
    assert sum(t.count("( ") for t in texts) == 1 and any('"148" ; e:q "149"' in t or '"98" ; e:q "99"' in t for t in texts)
    for chars in (nesting.IN_PLACE_CHARS, 60):
        monkeypatch.setattr(nesting, "IN_PLACE_CHARS", chars)
        back = turtle.parse_documents(turtle.documents(q, {"e": "http://e/"}, 4, nested=True), scope="one").collect()
        assert len(back) == len(rows) and len({r.s for r in back} | {r.o for r in back if r.o_kind == 1}) == 1 + 31 + 1 + 1100
        named = {r.s for r in back} | {"http://e/top"}
        assert all(r.o in named or r.o_kind != 1 for r in back if not (r.p == "http://e/p"))


def test_documents_are_read_once(spark, tmp_path):
    """Documents are cut by samples, anew whenever they are written, and name the nodes in place: these must not be mixed (F2)."""
    turns = [(c, i, "user", f"{c} {i}") for c in range(300) for i in range(2)]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").repartition(3).write.parquet(str(tmp_path / "conversations.parquet"))
    small = {"spark.sql.execution.rangeExchange.sampleSizePerPartition": "1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    for key, value in small.items():
        spark.conf.set(key, value)
    try:
        found = QUERIES["turtle_nested_roundtrip"](spark, str(tmp_path)).select("s", "position", "o", "note").collect()
    finally:
        for key in small:
            spark.conf.unset(key)
    assert sorted(map(tuple, found)) == sorted((f"http://data.example/conv/{c}", i, text, f"http://data.example/conv/{c}#") for c, i, _, text in turns)
