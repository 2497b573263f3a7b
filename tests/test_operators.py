from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from graphloom.functions import iri as I
from graphloom.functions.terms import label_table
from graphloom.operators import containers, mapping, traverse
from graphloom.plans.tables import quads
from graphloom.schema import BLANK, IRI, LITERAL, QUAD, RDF, STRING, TYPE

E = "http://e.x/"
SPEC = mapping.ClassSpec(E + "T", E + "t/{}", "k", (mapping.Property("n", E + "n"),))


@pytest.fixture(scope="module")
def small(spark):
    rows = [(None, None, IRI, E + "t/1", TYPE, IRI, E + "T", None, None), (None, None, IRI, E + "t/1", E + "n", LITERAL, "x", STRING, None)]
    more = [(None, None, IRI, E + "t/1", E + "of", IRI, E + "other", None, None), (None, None, IRI, E + "other", E + "n", LITERAL, "y", STRING, None)]
    return spark.createDataFrame(rows, QUAD), spark.createDataFrame(rows + more, QUAD)


def test_completeness_and_roots(small):
    whole, more = small
    assert [r.n for r in mapping.complete(whole, SPEC).collect()] == ["x"]
    with pytest.raises(ValueError, match="2 triples"):
        mapping.complete(more, SPEC)
    with pytest.warns(UserWarning, match="2 triples"):
        mapping.complete(more, SPEC, "warn")
    assert mapping.complete(more, SPEC, "lenient").count() == 1
    assert mapping.root_of(whole, SPEC) == mapping.root_of(more, SPEC) == E + "t/1"
    other = mapping.ClassSpec(E + "None", E + "{}", "k")
    assert mapping.root_of(more, other) == E + "t/1"
    with pytest.raises(ValueError, match="no subject"):
        mapping.root_of(whole.limit(0), SPEC)


@pytest.mark.parametrize(("template", "kind"), [("no place", "string"), ("{}/{}", "string"), ("{name}", "string"), (E + "{}", "number")])
def test_specifications_are_checked(template, kind):
    with pytest.raises(ValueError, match="template|kinds"):
        mapping.ClassSpec(E + "T", template, "k", (mapping.Property("n", E + "n", kind),))


def test_local_subjects_are_blank(spark):
    q = mapping.triplify(spark.sql("select 1 k, 'a' n"), mapping.ClassSpec(E + "T", "row|{}", "k", (mapping.Property("n", E + "n"),), local=True))
    assert {(r.s_kind, r.s) for r in q.collect()} == {(BLANK, "row|1")}
    labels = label_table(q).collect()
    assert len(labels) == 1 and labels[0].label.startswith("_:b")


def test_containers_skip_gaps_and_need_their_type(spark):
    member = lambda s, n, o: (None, None, IRI, s, f"{RDF}_{n}", LITERAL, o, STRING, None)
    rows = [(None, None, IRI, E + "a", TYPE, IRI, RDF + "Alt", None, None), member(E + "a", 3, "c"), member(E + "a", 1, "a"), member(E + "a", 1, "b"), member(E + "a", "0", "x"), member(E + "a", "x", "y"), member(E + "b", 1, "z")]
    q = spark.createDataFrame(rows, QUAD)
    assert sorted((r.s, r.position, r.o) for r in containers.container_items(q, "Alt").collect()) == [(E + "a", 1, "b"), (E + "a", 2, "c")]
    assert containers.container_items(q).count() == 0
    items = spark.createDataFrame([(IRI, E + "a", 1, LITERAL, None, STRING, None)], "s_kind byte, s string, position long, o_kind byte, o string, o_dt string, o_lang string")
    with pytest.raises(Exception, match="no value"):
        containers.container_quads(items).collect()
    with pytest.raises(ValueError, match="no container"):
        containers.container_quads(items, "Set")


def test_levels_and_circles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("d", None)], "node string, need string")
    assert {r.node: r.level for r in traverse.topological(edges).collect()} == {"c": 0, "d": 0, "b": 1, "a": 2}
    with pytest.raises(ValueError, match="circle"):
        traverse.topological(edges.union(spark.createDataFrame([("c", "a")], "node string, need string")))


def test_prefixes_are_made_and_kept(spark):
    assert I.prefix_from("http://www.w3.org/2001/XMLSchema#", I.PREFIXES) == "xsd"
    assert I.prefix_from("https://data.example.org/shop/2024#", {}) == "shop"
    assert I.prefix_from("https://data.example.org/shop/2024#", {"shop": "x"}) == "shop1"
    assert I.prefix_from("http://12.3/4/", {"ns1": "x"}) == "ns2"
    q = quads(spark, "/root/testdata/sf0.001", "nation")
    found = {tuple(r[0]) for r in q.select(I.compact_parts(F.col("p"), I.prefixes_for(q), "predicate")).distinct().collect()}
    assert ("special", None, "a") in found and all(k in ("special", "prefixed") for k, _, _ in found)
