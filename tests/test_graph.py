from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from graphloom.functions import iri as I
from graphloom.operators import canon, dataset, graph, mapping, traverse
from graphloom.operators.graph import Blank, Literal
from graphloom.schema import BLANK, FIRST, IRI, LITERAL, NIL, QUAD, REST, STRING
from graphloom.sources import nquads

E = "http://e.x/"


def quad(s, p, o, g=None, dt=STRING, lang=None):
    kind = lambda t: None if t is None else BLANK if t.startswith("d|") else IRI
    lit = isinstance(o, Literal)
    return (kind(g), g, kind(s), s, p, LITERAL if lit else kind(o), o[0] if lit else o, o[1] if lit else None, o[2] if lit else None)


@pytest.fixture(scope="module")
def make(spark):
    return lambda *rows: spark.createDataFrame(list(rows), QUAD)


def test_match_unites_single_and_set_and_empty_set_matches_nothing(make):
    q = make(quad(E + "a", E + "p", E + "b"), quad("d|x", E + "p", Literal("1")), quad(E + "a", E + "q", Literal("1", STRING)))
    assert graph.match(q, s=E + "a", s_in=[Blank("d|x")]).count() == 3
    assert graph.match(q, o_in=[]).count() == 0
    assert graph.match(q, o=Literal("1"), p=E + "q").count() == 1
    assert graph.exists(q, p=E + "p") and not graph.exists(q, p=E + "zz")


def test_bags_and_sets(make):
    a = quad(E + "a", E + "p", E + "b")
    q = make(a, a)
    assert graph.add(q, make(a)).count() == 1
    assert graph.add(q, make(a), dedup=False).count() == 3
    assert graph.same_graph(q, make(a))
    assert graph.remove_matching(q).count() == 2
    assert graph.remove(q, make()).count() == 1
    assert graph.graph_hash(q).first() == graph.graph_hash(make(a)).first()


def test_collapse(make):
    q = make(quad(E + "a", E + "p", E + "b"), quad(E + "a", E + "p", E + "b", g=E + "g"))
    with pytest.raises(ValueError, match="named graphs"):
        dataset.collapse(q)
    assert dataset.collapse(q, "ignore").count() == 1
    assert dataset.collapse(q, "merge").count() == 2


def test_reach_ends_on_circles(make):
    q = make(quad(E + "a", E + "p", E + "b"), quad(E + "b", E + "p", E + "a"), quad(E + "b", E + "n", Literal("x")), quad(E + "z", E + "p", E + "a"))
    found = traverse.reach(q, traverse.iri_node([E + "a"], q))
    assert sorted((r.s, r.depth) for r in found.collect()) == [(E + "a", 0), (E + "b", 1), (E + "b", 1)]
    assert [r.s for r in traverse.root_subjects(q).collect()] == [E + "z"]


def test_lists_of_any_length_and_broken_ones(make):
    def chain(name, n):
        out = []
        for i in range(n):
            out.append(quad(f"d|{name}{i}", FIRST, Literal(str(i))))
            out.append(quad(f"d|{name}{i}", REST, f"d|{name}{i + 1}" if i < n - 1 else NIL))
        return out

    circle = [quad("d|c0", FIRST, Literal("0")), quad("d|c0", REST, "d|c1"), quad("d|c1", FIRST, Literal("1")), quad("d|c1", REST, "d|c0")]
    q = make(*chain("a", 1), *chain("b", 9), *circle, quad("d|m", FIRST, Literal("0")))
    found = sorted((r.head, r.position, r.o) for r in traverse.list_items(q).collect())
    assert found == [("d|a0", 0, "0")] + [("d|b0", i, str(i)) for i in range(9)]
    assert [r.s for r in traverse.malformed_lists(q).collect()] == ["d|m"]


def test_closure_marks_circles(spark):
    pairs = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "a string, b string")
    found = {(r.a, r.b) for r in traverse.closure(pairs).collect()}
    assert found == {(x, y) for x in "abc" for y in "abcd"}


def test_canonical_form_tells_circles_of_six_from_two_of_three(make):
    ring = lambda names: [quad(f"d|{a}", E + "p", f"d|{b}") for a, b in zip(names, names[1:] + names[:1], strict=True)]
    one, other = make(*ring("abcdef")), make(*ring("abc"), *ring("def"))
    assert canon.isomorphic(one, make(*ring("fbdace")))
    assert not canon.isomorphic(one, other)


LINES = [
    ('<http://e.x/a> <http://e.x/p> "x\\"y\\u00e9\\n"@en-GB .', ("http://e.x/a", 'x"yé\n', "en-GB", None)),
    ("_:b1 <http://e.x/p> _:b2 <http://e.x/g> . # note", ("f|b1", "f|b2", None, "http://e.x/g")),
    ('<http://e.x/a><http://e.x/p>"1"^^<http://www.w3.org/2001/XMLSchema#integer>.', ("http://e.x/a", "1", None, None)),
]


def test_nquads_lines(spark):
    good = spark.createDataFrame([(x,) for x, _ in LINES] + [("# only a comment",), ("",), ("   ",)], "value string")
    parsed = nquads.parse_lines(good, doc=F.lit("f"))
    assert parsed.where("error is not null").count() == 0
    assert sorted(((r.s, r.o, r.o_lang, r.g) for r in parsed.collect()), key=str) == sorted((w for _, w in LINES), key=str)
    bad = spark.createDataFrame([('"lit" <http://e.x/p> <http://e.x/o> .',), ("<http://e.x/a> <http://e.x/p> <http://e.x/o>",), ("<a b> <http://e.x/p> _:x .",)], "value string")
    assert nquads.parse_lines(bad).where("error is not null").count() == 3
    assert nquads.checked(nquads.parse_lines(bad), "DROPMALFORMED").count() == 0
    with pytest.raises(Exception, match="not a statement"):
        nquads.checked(nquads.parse_lines(bad)).collect()


def test_nquads_files_and_stream(spark, make, tmp_path):
    q = make(quad(E + "a", E + "p", Literal('quote " back \\ tab\t')), quad(E + "a", E + "p", E + "b", g=E + "g"))
    nquads.write(q, str(tmp_path / "out"), canonical=True)
    assert graph.same_graph(nquads.read(spark, str(tmp_path / "out")), q)
    stream = nquads.read_stream(spark, str(tmp_path / "out")).writeStream.format("memory").queryName("quads").trigger(availableNow=True).start()
    stream.awaitTermination(60)
    assert spark.table("quads").count() == 2


@pytest.mark.parametrize(("reference", "wanted"), [
    ("g:h", "g:h"), ("g", "http://a/b/c/g"), ("./g", "http://a/b/c/g"), ("g/", "http://a/b/c/g/"), ("/g", "http://a/g"), ("//g", "http://g"), ("?y", "http://a/b/c/d;p?y"), ("g?y", "http://a/b/c/g?y"),
    ("#s", "http://a/b/c/d;p?q#s"), ("g#s", "http://a/b/c/g#s"), (";x", "http://a/b/c/;x"), ("", "http://a/b/c/d;p?q"), (".", "http://a/b/c/"), ("./", "http://a/b/c/"), ("..", "http://a/b/"), ("../g", "http://a/b/g"),
    ("../..", "http://a/"), ("../../g", "http://a/g"), ("../../../g", "http://a/g"), ("/./g", "http://a/g"), ("/../g", "http://a/g"), ("g.", "http://a/b/c/g."), ("..g", "http://a/b/c/..g"), ("./../g", "http://a/b/g"),
    ("g;x=1/../y", "http://a/b/c/y"), ("g?y/./x", "http://a/b/c/g?y/./x"),
])
def test_resolution_examples_of_the_standard(reference, wanted):
    assert I.resolve_one(reference, "http://a/b/c/d;p?q") == wanted


@pytest.mark.parametrize("iri", ["http://a/b/c/d;p?q", "http://a/b/c/x", "http://a/b/y#z", "http://a/", "http://z/b", "http://a/b/c/d;p?q#f", "http://a/b/c:d/e"])
def test_relative_forms_resolve_back(iri):
    short = I.relativize_one(iri, "http://a/b/c/d;p?q")
    assert I.resolve_one(short, "http://a/b/c/d;p?q") == iri and len(short) <= len(iri)


def test_iri_columns(spark):
    df = spark.createDataFrame([(E + "v#name",), ("http://www.w3.org/1999/02/22-rdf-syntax-ns#type",), (E + "a/",)], "i string")
    got = [tuple(r) for r in df.select(I.namespace(F.col("i")), I.local_name(F.col("i")), I.compact(F.col("i"))).collect()]
    assert got == [(E + "v#", "name", E + "v#name"), ("http://www.w3.org/1999/02/22-rdf-syntax-ns#", "type", "rdf:type"), (E + "a/", "", E + "a/")]
    assert df.limit(1).select(I.expand(F.lit("rdf:type"))).first()[0].endswith("#type")


def test_triplify_and_project_are_inverse(spark):
    spec = mapping.ClassSpec(E + "T", E + "t/{}", "k", (mapping.Property("n", E + "n", "integer"), mapping.Property("ref", E + "ref", "iri", E + "t/{}"), mapping.Property("tags", E + "tag", many=True), mapping.Property("day", E + "day", "date")))
    df = spark.sql("select '1' k, 5L n, '2' ref, array('b','a') tags, date'2024-02-03' day union all select '2', null, null, array(), null")
    back = mapping.project(mapping.triplify(df, spec), spec).orderBy("k").collect()
    assert [(r.k, r.n, r.ref, r.tags, str(r.day)) for r in back] == [("1", 5, "2", ["a", "b"], "2024-02-03"), ("2", None, None, [], "None")]
