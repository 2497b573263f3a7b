from __future__ import annotations

import pytest

from graphloom.operators import graph
from graphloom.plans.tables import quads
from graphloom.schema import BLANK, IRI, LITERAL
from graphloom.sources import jelly, registry

S = "http://www.w3.org/2001/XMLSchema#string"
ROWS = [
    ((None, None, None, None), (IRI, "http://e/a", None, None), (IRI, "http://e/p", None, None), (LITERAL, "x", S, None)),
    ((None, None, None, None), (IRI, "http://e/a", None, None), (IRI, "http://e/p", None, None), (LITERAL, "x", None, "de")),
    ((IRI, "http://e/g#1", None, None), (BLANK, "b", None, None), (IRI, "http://e/q", None, None), (LITERAL, "1", "http://www.w3.org/2001/XMLSchema#integer", None)),
    ((BLANK, "g", None, None), (BLANK, "b", None, None), (IRI, "urn:x", None, None), (BLANK, "c", None, None)),
]


def encoded(physical, rows):
    enc = jelly.Encoder(physical)
    return b"".join(filter(None, [*(enc.add(*r) for r in rows), enc.end()]))


def flat(rows):
    name = lambda t: f"doc|{t[1]}" if t[0] == BLANK else t[1]
    dt = lambda t: "http://www.w3.org/1999/02/22-rdf-syntax-ns#langString" if t[3] else t[2]
    return [(g[0], name(g), s[0], name(s), p[1], o[0], name(o), dt(o), o[3]) for g, s, p, o in rows]


@pytest.mark.parametrize("physical", ["triples", "quads", "graphs"])
def test_streams_of_each_kind(physical, monkeypatch):
    monkeypatch.setattr(jelly, "FRAME_ROWS", 2)
    rows = ROWS[:2] if physical == "triples" else ROWS
    data = encoded(physical, rows)
    assert [r for part in jelly.parse(data) for r in part] == flat(rows)
    assert jelly.can_parse(data) and not jelly.can_parse(b"<http://a> <http://b> <http://c> .") and not jelly.can_parse(b"")


def test_small_tables_give_their_numbers_away(monkeypatch):
    for name, size in (("NAMES", 8), ("PREFIXES", 2), ("DATATYPES", 1)):
        monkeypatch.setattr(jelly, name, size)
    rows = [((None,) * 4, (IRI, f"http://e{i % 5}/{i % 13}", None, None), (IRI, f"http://p/{i % 3}", None, None), (LITERAL, str(i), f"http://d/{i % 4}", None)) for i in range(500)]
    assert [r for part in jelly.parse(encoded("quads", rows)) for r in part] == flat(rows)


# Bytes of a stream written by hand from the format's definition: options (triples, tables of 8, 8 and 8),
# prefix "http://e/", names "a" and "p", and the triple a p "x" with a as a blank node "z" for the object's twin.
def test_bytes_by_hand():
    row = lambda field, body: bytes([0x0A, len(body) + 2, field << 3 | 2, len(body)]) + body
    frame = row(1, b"\x10\x01\x48\x08\x50\x08\x58\x08\x78\x01") + row(10, b"\x12\x09http://e/") + row(9, b"\x12\x01a") + row(9, b"\x12\x01p")
    frame += row(2, b"\x0a\x02\x08\x01" + b"\x2a\x00" + b"\x5a\x03\x0a\x01x") + row(2, b"\x52\x01z")
    want = [(None, None, IRI, "http://e/a", "http://e/p", LITERAL, "x", S, None), (None, None, IRI, "http://e/a", "http://e/p", BLANK, "doc|z", None, None)]
    assert [r for part in jelly.parse(bytes([len(frame)]) + frame) for r in part] == want
    assert [r for part in jelly.parse(frame) for r in part] == want


@pytest.mark.parametrize("data", [b"\x05\x0a", b"\x04\x0a\x02\x12\x00", b"\xff", encoded("quads", ROWS)[:-3], encoded("quads", ROWS).replace(b"\x10\x02", b"\x10\x01", 1)])
def test_faults(data):
    with pytest.raises(ValueError, match="jelly"):
        list(jelly.parse(data))


def test_tables_round_trip(spark, tmp_path):
    q = quads(spark, "/root/testdata/sf0.001", "nation", "region", graphs=True)
    for physical in ("quads", "graphs"):
        assert graph.same_graph(jelly.parse_documents(jelly.documents(q, physical)), q)
    path = tmp_path / "one.jelly"
    path.write_bytes(bytes(jelly.documents(q, partitions=1).first().content))
    assert graph.same_graph(registry.read_rdf(spark, str(path), "application/x-jelly-rdf"), q)
    assert registry.detect(spark, str(path)).name == "jelly"
    assert jelly.parse_documents(spark.createDataFrame([("d", b"\x05oops")], "doc string, content binary"), "DROPMALFORMED").count() == 0
    with pytest.raises(Exception, match="no graphs"):
        jelly.documents(q, "triples").collect()
