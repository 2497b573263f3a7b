"""Node objects per subject: read back as the same graph, whatever is folded."""

from __future__ import annotations

import json

import pytest

from graphloom.operators import canon
from graphloom.schema import FIRST, NIL, QUAD, REST, TYPE
from graphloom.sources import jsonld

S = "http://www.w3.org/2001/XMLSchema#string"


def quads(spark, rows):
    """(s, p, o[, g]): names that start with _ are blank nodes, with http IRIs, others strings; (text, dt, lang) a literal."""

    def term(x):
        if isinstance(x, tuple):
            return (2, *x)
        return (1, "d|" + x[1:], None, None) if x.startswith("_") else (0, x, None, None) if x.startswith("http") else (2, x, S, None)

    found = []
    for s, p, o, *g in rows:
        name = term(g[0])[:2] if g else (None, None)
        found.append((*name, *term(s)[:2], p if ":" in p else "http://e/" + p, *term(o)))
    return spark.createDataFrame(found, QUAD)


LIST = [("_l0", FIRST, "a"), ("_l0", REST, "_l1"), ("_l1", FIRST, "http://e/x"), ("_l1", REST, NIL)]
CASES = {
    "values": [("http://e/s", TYPE, "http://e/T"), ("http://e/s", TYPE, "http://e/A"), ("http://e/s", "p", "b\"\\\n"), ("http://e/s", "p", ("1", "http://www.w3.org/2001/XMLSchema#integer", None)), ("http://e/s", "p", ("hi", "http://www.w3.org/1999/02/22-rdf-syntax-ns#langString", "en"))],
    "lists": [("http://e/s", "l", "_l0"), *LIST, ("http://e/s", "empty", NIL)],
    "a list used twice": [("http://e/s", "l", "_l0"), ("http://e/t", "l", "_l0"), *LIST],
    "a list with a property": [("http://e/s", "l", "_l0"), *LIST, ("_l1", "p", "x")],
    "nodes in nodes": [("http://e/s", "p", "_a"), ("_a", "q", "_b"), ("_b", "r", "x"), ("_b", TYPE, "http://e/T"), ("http://e/s", "p", "_none")],
    "a circle": [("http://e/s", "p", "_a"), ("_a", "p", "_b"), ("_b", "p", "_c"), ("_c", "p", "_b")],
    "a class that is a blank node": [("http://e/s", TYPE, "_t"), ("_t", "p", "x")],
    "graphs": [("http://e/s", "p", "_a", "http://e/g"), ("_a", "q", "x", "http://e/g"), ("http://e/s", "p", "_b", "http://e/g"), ("_b", "q", "y"), ("http://e/s", "p", "z"), ("_a2", "p", "z", "_name"), ("_name", "q", "w")],
}


@pytest.mark.parametrize("case", CASES)
def test_objects_read_back(spark, case):
    q = quads(spark, CASES[case])
    objects = jsonld.node_objects(q)
    texts = [r.text for r in objects.collect()]
    docs = spark.createDataFrame([("d", "[" + ",".join(texts) + "]")], "doc string, text string")
    assert canon.isomorphic(jsonld.parse_documents(docs), q)
    if case == "lists":
        assert json.loads(texts[0])["http://e/l"] == [{"@list": [{"@value": "a"}, {"@id": "http://e/x"}]}] and json.loads(texts[0])["http://e/empty"] == [{"@list": []}]
    if case == "nodes in nodes":
        assert len(texts) == 1 and {"http://e/q": [{"@type": ["http://e/T"], "http://e/r": [{"@value": "x"}]}]} in json.loads(texts[0])["http://e/p"]
    if case == "values":
        assert list(json.loads(texts[0])) == ["@id", "@type", "http://e/p"] and json.loads(texts[0])["@type"] == ["http://e/A", "http://e/T"]


def test_a_large_subject_is_given_in_parts(spark, monkeypatch):
    monkeypatch.setattr(jsonld, "OBJECT_VALUES", 50)
    q = quads(spark, [("http://e/hub", "p", f"v{i}") for i in range(400)] + [("http://e/s", "p", "x")] * 2)
    found = jsonld.node_objects(q).collect()
    hub = [json.loads(r.text) for r in found if r.s == "http://e/hub"]
    assert 4 <= len(hub) <= 8 and {o["@id"] for o in hub} == {"http://e/hub"}
    assert sorted(v["@value"] for o in hub for v in o["http://e/p"]) == sorted(f"v{i}" for i in range(400))
    assert [json.loads(r.text)["http://e/p"] for r in found if r.s == "http://e/s"] == [[{"@value": "x"}]]
    assert jsonld.node_objects(q.limit(0)).count() == 0
