from __future__ import annotations

import json

import pytest

from graphloom.operators import graph
from graphloom.plans.tables import quads
from graphloom.schema import QUAD
from graphloom.sources import jsonld, nquads, rdfxml, registry, turtle

X = "http://www.w3.org/2001/XMLSchema#"
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"


def short(rows):
    return {(r[1], r[3].partition("|")[2] or r[3], r[4], r[6].partition("|")[2] if r[5] == 1 else r[6], r[7] and r[7].rpartition("#")[2], r[8]) for r in rows}


def test_turtle_terms():
    rows = turtle.parse('@prefix e: <http://e/> .\ne:a a e:T ; e:p "x"@de-1996, 1, -1.5, 1e3, true, """l "q" \\n""" ;; e:q [ e:r () ] .\nPREFIX : <http://d/>\n:s\\-x :p%20 _:b .')
    assert short(rows) >= {(None, "http://e/a", RDF + "type", "http://e/T", None, None), (None, "http://e/a", "http://e/p", "x", "langString", "de-1996"), (None, "http://e/a", "http://e/p", "-1.5", "decimal", None), (None, "http://e/a", "http://e/p", "1e3", "double", None), (None, "http://e/a", "http://e/p", 'l "q" \n', "string", None), (None, ".1", "http://e/r", RDF + "nil", None, None), (None, "http://d/s-x", "http://d/p%20", "b", None, None)}


@pytest.mark.parametrize("text", ["e:a <http://p> 1 .", "<http://a> <http://p> .", '<http://a> "x" <http://b> .', "<http://a> <http://p> <http://b>", "@prefix e <http://e/> ."])
def test_turtle_faults(text):
    with pytest.raises(ValueError, match="line 1"):
        turtle.parse(text)


def test_trig_graphs():
    rows = turtle.parse("@base <http://b/> . <s> <p> <o> . <g> { <s> <p> 1 } GRAPH _:x { <s> <p> 2 . } { <t> <p> 3 }")
    assert {(r[1], r[3], r[6]) for r in rows} == {(None, "http://b/s", "http://b/o"), ("http://b/g", "http://b/s", "1"), ("doc|x", "http://b/s", "2"), (None, "http://b/t", "3")}


def test_jsonld_features():
    doc = {
        "@context": {"@vocab": "http://v/", "e": "http://e/", "ref": {"@id": "e:ref", "@type": "@id"}, "day": {"@type": X + "date"}, "names": {"@container": "@language"}, "steps": {"@container": "@list"}, "of": {"@reverse": "http://v/has"}, "id": "@id"},
        "id": "e:1", "@type": "T", "n": 5, "f": 1.5, "b": True, "ref": ["e:2", {"id": "e:3", "x": "y"}], "day": "2024-01-01", "names": {"en": "one", "de": ["eins"]}, "steps": ["a", 1], "of": {"@id": "e:9"}, "skip": None,
        "lang": {"@value": "t", "@language": "fr"}, "@graph": [{"@id": "e:in", "p": "q"}],
    }
    got = short(jsonld.parse(json.dumps(doc)))
    e = "http://e/1"
    assert got >= {
        (None, e, RDF + "type", "http://v/T", None, None), (None, e, "http://v/n", "5", "integer", None), (None, e, "http://v/f", "1.5E0", "double", None), (None, e, "http://v/b", "true", "boolean", None), (None, e, "http://e/ref", "http://e/2", None, None),
        (None, "http://e/3", "http://v/x", "y", "string", None), (None, e, "http://v/day", "2024-01-01", "date", None), (None, e, "http://v/names", "eins", "langString", "de"), (None, "http://e/9", "http://v/has", e, None, None),
        (None, e, "http://v/lang", "t", "langString", "fr"), ("http://e/1", "http://e/in", "http://v/p", "q", "string", None), (None, ".1", RDF + "first", "a", "string", None),
    }
    assert not any("skip" in str(r) for r in got)
    with pytest.raises(ValueError, match="preloaded"):
        jsonld.parse('{"@context": "http://far/", "a": 1}')


def test_rdfxml_features():
    text = f'''<rdf:RDF xmlns:rdf="{RDF}" xmlns:e="http://e/" xml:base="http://b/d">
    <e:T rdf:about="s" e:attr="v"><e:p xml:lang="en">hi</e:p><e:n rdf:datatype="{X}integer">3</e:n><e:r rdf:resource="#f"/>
    <e:l rdf:parseType="Collection"><rdf:Description rdf:about="i"/></e:l><e:q rdf:parseType="Resource"><e:z>1</e:z></e:q></e:T>
    <rdf:Seq rdf:ID="q"><rdf:li>a</rdf:li><rdf:li>b</rdf:li></rdf:Seq></rdf:RDF>'''
    got = short(rdfxml.parse(text))
    s = "http://b/s"
    assert got >= {(None, s, RDF + "type", "http://e/T", None, None), (None, s, "http://e/attr", "v", "string", None), (None, s, "http://e/p", "hi", "langString", "en"), (None, s, "http://e/n", "3", "integer", None), (None, s, "http://e/r", "http://b/d#f", None, None), (None, "http://b/d#q", RDF + "_2", "b", "string", None)}
    with pytest.raises(ValueError, match="line"):
        rdfxml.parse("<a>")


@pytest.mark.parametrize("kind", ["application/n-quads", "text/turtle", "application/trig", "application/ld+json", "application/rdf+xml"])
def test_files_round_trip_and_are_detected(spark, tmp_path, kind):
    q = quads(spark, "/root/testdata/sf0.001", "nation", "region")
    path = str(tmp_path / "out")
    registry.write_rdf(q, path, kind)
    assert graph.same_graph(registry.read_rdf(spark, path, kind), q)
    found = registry.detect(spark, path).name
    assert found == registry.format_of(kind).name or (kind == "text/turtle" and found == "trig")
    assert registry.format_of(kind.upper() + "; charset=utf-8") is registry.format_of(kind)


def test_unknown_type():
    with pytest.raises(ValueError, match="no format"):
        registry.format_of("text/plain")


def test_bad_documents_follow_the_mode(spark):
    docs = spark.createDataFrame([("a", "<http://s> <http://p> 1 ."), ("b", "oops")], "doc string, text string")
    assert turtle.parse_documents(docs, mode="DROPMALFORMED").count() == 1
    assert turtle.parse_documents(docs, mode="PERMISSIVE").where("error is not null").count() == 1
    assert jsonld.parse_documents(docs, mode="DROPMALFORMED").count() == 0


@pytest.mark.parametrize("kind", ["application/n-quads", "text/turtle", "application/ld+json", "application/rdf+xml"])
def test_nodes_of_two_files_stay_two_nodes(spark, tmp_path, kind):
    """Both files call their nodes b0, x-1 and x_1."""
    rows = [(None, None, 1, f"{doc}|{a}", "http://e/p", 1, f"{doc}|{b}", None, None) for doc in ("file:///A", "file:///B|c") for a, b in (("b0", "x-1"), ("x-1", "x_1"), ("x_1", "b0"))]
    q = spark.createDataFrame(rows, QUAD).coalesce(1)
    path = str(tmp_path / "out")
    registry.write_rdf(q, path, kind)
    back = registry.read_rdf(spark, path, kind).select("s", "o").collect()
    assert len(back) == 6 and len({r.s for r in back} | {r.o for r in back}) == 6
    to = {r.s: r.o for r in back}
    assert all(to[to[to[s]]] == s for s in to)  # two rings of three


def test_escapes_in_lines(spark):
    lines = spark.createDataFrame([(x,) for x in ['<http://e/a\\u00e9> <http://e/p> "\\t\\\\\\"" .', '<http://e/a\\tb> <http://e/p> "x" .', '<http://e/a> <http://e/p> "\\x" .', '<http://e/a> <http://e/p> "a\\u0001\x01b"@en .', '<http://e/a> <http://e/p> "' + "long \\\\ " * 20000 + '" .', "\x01oops"]], "value string")
    found = nquads.parse_lines(lines)
    assert sorted(len(r.error) for r in found.where("error is not null").collect()) == [5, 32, 34]
    good = {r.o[:6]: r for r in found.where("error is null").collect()}
    assert set(good) == {'\t\\"', "a\x01\x01b", "long \\"} and good['\t\\"'].s == "http://e/aé" and len(good["long \\"].o) == 7 * 20000


def test_canonical_lines_escape_all_control_characters(spark):
    q = spark.createDataFrame([(None, None, 0, "http://e/a b", "http://e/p", 2, "".join(map(chr, [*range(32), 127])), "http://www.w3.org/2001/XMLSchema#string", None)], QUAD)
    line = nquads.lines(q, canonical=True).first().value
    assert line == '<http://e/a\\u0020b> <http://e/p> "' + "".join({8: "\\b", 9: "\\t", 10: "\\n", 12: "\\f", 13: "\\r"}.get(c, f"\\u{c:04X}") for c in [*range(32), 127]) + '" .'
    back = nquads.checked(nquads.parse_lines(spark.createDataFrame([(line,)], "value string")))
    assert [tuple(r) for r in back.collect()] == [tuple(r) for r in q.collect()]


def test_deep_documents_are_faults_not_crashes(spark):
    deep = [("t", "<http://s> <http://p> " + "[ <http://p> " * 20000 + "1" + " ]" * 20000 + " ."), ("ok", "<http://s> <http://p> 1 .")]
    assert turtle.parse_documents(spark.createDataFrame(deep, "doc string, text string"), mode="DROPMALFORMED").count() == 1
    assert jsonld.parse_documents(spark.createDataFrame([("j", '{"http://p":' * 3000 + "1" + "}" * 3000)], "doc string, text string"), mode="DROPMALFORMED").count() == 0
    xml = f'<rdf:RDF xmlns:rdf="{RDF}" xmlns:e="http://e/">' + '<e:T><e:p>' * 3000 + "</e:p></e:T>" * 3000 + "</rdf:RDF>"
    bomb = '<!DOCTYPE r [<!ENTITY a "aaaa"><!ENTITY b "&a;&a;">]><rdf:RDF xmlns:rdf="' + RDF + '"/>'
    assert rdfxml.parse_documents(spark.createDataFrame([("x", xml), ("b", bomb)], "doc string, text string"), mode="PERMISSIVE").where("error is not null").count() == 2


def test_rdfxml_li_within_a_resource():
    text = f'<rdf:RDF xmlns:rdf="{RDF}" xmlns:e="http://e/"><rdf:Description rdf:about="http://s"><e:p rdf:parseType="Resource"><rdf:li>a</rdf:li><rdf:li>b</rdf:li></e:p></rdf:Description></rdf:RDF>'
    assert {(r[4], r[6]) for r in rdfxml.parse(text)} >= {(RDF + "_1", "a"), (RDF + "_2", "b")}


def test_rdfxml_strict_rules_and_literals():
    doc = lambda body: f'<rdf:RDF xmlns:rdf="{RDF}" xmlns:e="http://e/" xml:base="http://b/">{body}</rdf:RDF>'
    bad = [
        '<rdf:Description rdf:ID="1a"/>', '<rdf:Description rdf:ID="a"/><rdf:Description rdf:ID="a"/>', '<rdf:Description rdf:about="x" rdf:nodeID="y"/>', '<rdf:li/>',
        '<e:T><e:p rdf:resource="x" rdf:nodeID="y"/></e:T>', '<e:T rdf:bagID="z"/>', "<e:T><rdf:Description/></e:T>",
    ]
    for body in bad:
        rdfxml.parse(doc(body))
        with pytest.raises(ValueError, match="name|twice|exclude|allowed"):
            rdfxml.parse(doc(body), strict=True)
    good = rdfxml.parse(doc('<e:T rdf:ID="a"><e:x rdf:parseType="Literal">1 &lt; 2 <e:b z="1" a="2"/> tail</e:x></e:T>'), strict=True)
    found = next(r[6] for r in good if r[7] == RDF + "XMLLiteral")
    assert found.startswith("1 &lt; 2 <") and found.endswith("> tail") and 'a="2" z="1"></' in found


def test_jsonld_direction():
    doc = '{"http://e/p": {"@value": "x", "@language": "AR", "@direction": "rtl"}}'
    assert {r[7] for r in jsonld.parse(doc)} == {RDF + "langString"}
    assert {r[7] for r in jsonld.parse(doc, direction="i18n-datatype")} == {"https://www.w3.org/ns/i18n#ar_rtl"}
    assert {(r[4], r[6]) for r in jsonld.parse(doc, direction="compound-literal")} >= {(RDF + "value", "x"), (RDF + "language", "ar"), (RDF + "direction", "rtl")}
    with pytest.raises(ValueError, match="direction"):
        jsonld.parse(doc, direction="up")


def test_turtle_writes_nodes_in_place(spark):
    text = """@prefix e: <http://e/> . e:a e:list (1 "two" e:c) ; e:none () ; e:of [ a e:T ; e:deep [ e:n 1.5 ] ] . e:b e:shared _:x . e:c e:shared _:x . _:x e:n 2 . _:r e:next _:r2 . _:r2 e:next _:r ."""
    docs = spark.createDataFrame([("d", text)], "doc string, text string")
    q = turtle.parse_documents(docs)
    out = turtle.documents(q, {"e": "http://e/"}, partitions=1, nested=True).first().text
    assert '( 1 "two" e:c )' in out and "e:none ()" in out and "[ a e:T ; e:deep [ e:n 1.5 ] ]" in out and out.count("_:") == 7
    back = turtle.parse_documents(spark.createDataFrame([("d", out)], "doc string, text string"))
    assert back.count() == q.count()
    based = turtle.documents(q.where("s = 'http://e/b'"), {}, 1, base="http://e/").first().text
    assert based.startswith("@base <http://e/> .\n") and "<b> <http://e/shared>" in based
    many = turtle.documents(q.where("o_kind = 2"), {}, 1)
    assert many.count() == 1


@pytest.mark.parametrize("deep", [jsonld.DEPTH - 2, jsonld.DEPTH + 2, 100_000])
def test_json_depth_is_counted(deep):
    text = '{"http://p":' * deep + '"x"' + "}" * deep
    if deep < jsonld.DEPTH:
        assert len(jsonld.parse(text)) == deep
    else:
        with pytest.raises(ValueError, match="within each other"):
            jsonld.parse(text)


def test_readers_don_t_depend_on_what_ran_before(spark):
    """The same worker names tied nodes, then reads a deep document: it stays a fault."""
    from graphloom.operators import canon

    chain = spark.createDataFrame([(None, None, 1, f"d|n{i}", "http://p", 1, f"d|n{i + 1}", None, None) for i in range(50)], QUAD)
    docs = spark.createDataFrame([("j", '{"http://p":' * 3000 + "1" + "}" * 3000)], "doc string, text string").coalesce(1)
    before = jsonld.parse_documents(docs, mode="DROPMALFORMED").count()
    canon.canonical_lines(chain).count()
    assert before == jsonld.parse_documents(docs, mode="DROPMALFORMED").count() == 0


def test_a_line_is_matched_once(spark):
    lines = nquads.lines(quads(spark, "/root/testdata/sf0.001", "nation", graphs=True))
    plan = nquads.checked(nquads.parse_lines(lines))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("(?:[ \\t]*") <= 1 and plan.count(nquads.LINE[:40]) == 1 and "Python" not in plan


@pytest.mark.parametrize("kind", ["application/n-quads", "text/turtle"])
def test_nodes_of_one_output_in_many_files_are_the_same(spark, tmp_path, kind):
    rows = [(None, None, 1, f"d|n{i}", "http://e/p", 1, f"d|n{i + 1}", None, None) for i in range(40)]
    path = str(tmp_path / "out")
    registry.write_rdf(spark.createDataFrame(rows, QUAD).repartition(4), path, kind, **({"partitions": 4} if kind == "text/turtle" else {}))
    one = registry.read_rdf(spark, path, kind, scope="out").select("s", "o").collect()
    assert len({r.s for r in one} | {r.o for r in one}) == 41
    each = registry.read_rdf(spark, path, kind).select("s", "o").collect()
    assert len({r.s for r in each} | {r.o for r in each}) > 41
