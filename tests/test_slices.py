"""Turtle and TriG files in slices: the same quads as the whole document read at once."""

from __future__ import annotations

import random

import pandas as pd
import pytest

from graphloom.operators import canon
from graphloom.schema import QUAD
from graphloom.sources import slices, turtle

HEAD = '@prefix e: <http://e/> . # a . comment\n@base <http://b/> .\nPREFIX f:\n # between\n <f#>\n'
STATEMENTS = [
    'e:s e:p "it\'s . not" ; e:q 1.5, 2 .', '<x#y\'z> <p> "a . b # c"@en .', 'e:l e:p """one .\n@prefix e: <http://wrong/> .\n "two" . \\""" three\n. """ .', "e:l2 e:p '''x .\n'' y\n''', \"\" .",
    "[ e:p [ e:q ( 1 . 5 ) ] ] ." .replace("1 . 5", "1 5"), "e:c e:list ( e:a [] ( \"deep . \" ) ) .", "@prefix e: <http://e2/> .", "e:o\\'neil e:p\\. _:n.1 .", "_:n.1 e:p true .", "f:x f:y f:z.w.", "<s> a <T> , <U> .", "@base <sub/> .", "<rel> e:p <> .", "PREFIX e: <http://e/>",
    "e:many " + " ;\n  ".join(f"e:p{i} {i}" for i in range(40)) + " .",
]
GRAPHS = ["e:g {", "GRAPH <g2> { ", "[] {", "{", "_:gn {", "[ ] # c {\n {"]


def document(seed, trig):
    rng, out, last = random.Random(seed), [HEAD], False
    for _ in range(60):
        one = rng.choice(STATEMENTS)
        if trig and rng.random() < 0.2:
            out.append(rng.choice(GRAPHS) + "\n" + "\n".join(rng.choice([s for s in STATEMENTS if not s.startswith(("@", "PREFIX"))]) for _ in range(rng.randint(1, 12))) + rng.choice([" }", "\n}\n", "}"]))
        else:
            out.append(one)
    return "\n".join(out) + rng.choice(["", "\n", "\n# end"])


def parsed(text, doc, graphs=True):
    return turtle.parse(text, doc, doc, graphs)


def cut(text, size, trig, doc):
    """The steps of the reader on one file, without Spark: ranges of ``size`` bytes, wrong starts read again, statements put together, states carried on."""
    lines = text.split("\n")
    rows, at = [], 0
    for line in lines if lines[-1] else lines[:-1]:
        rows.append((doc, at // size * size, 0, line))
        at += len(line.encode()) + 1
    ranges = pd.DataFrame(rows, columns=["doc", "block", "mode", "line"])
    out = pd.concat(list(slices._scan([ranges])))
    mode = dict(slices._starts(out[out.kind == "end"][["doc", "block", "ends"]])[["block", "mode"]].itertuples(index=False))
    if mode:
        again = ranges[ranges.block.isin(mode)].copy()
        out = pd.concat([out[~out.block.isin(mode)], *slices._scan([again.assign(mode=again.block.map(mode))])])
    parts = out.sort_values(["block", "piece"])[lambda x: x.kind.isin(["head", "through", "tail"])]
    whole = [(doc, g.block.iloc[0], g.piece.iloc[0], "".join(g.text)) for _, g in parts.groupby((parts.kind == "tail").cumsum())]
    whole = pd.concat(list(slices._rescan([pd.DataFrame(whole, columns=["doc", "block", "piece", "text"])])))
    found, said, state = [], [], None
    for r in pd.concat([out[out.kind == "body"], whole]).sort_values(["block", "piece"]).itertuples():
        preamble = "\n".join(said) + "\n" + (state[0][1:] + " {\n" if state and state[0][0] == "{" else "")
        within = f"{doc}|.{state[1]}-{state[2]}.g{state[3]}" if state and state[0].startswith("{[") else None
        state = (r.graph, r.block, r.piece, r.opened) if r.graph else state
        text = preamble + r.text + ("\n}" if state and state[0][0] == "{" else "")
        found += turtle._Reader(text, doc, doc, trig, f"{r.block}-{r.piece}.", within, preamble.endswith("{\n")).document()
        said += r.directives
    return found, len(mode)


def test_cuts_anywhere(monkeypatch):
    monkeypatch.setattr(slices, "FEED_CHARS", 70)
    monkeypatch.setattr(slices.Scanner.__init__, "__defaults__", (0, 300, True))
    plain = lambda rs: sorted(str((r[1] if r[0] != 1 else "", r[3] if r[2] == 0 else "", r[4], r[6] if r[5] != 1 else "", *r[7:9])) for r in rs)
    wrong = 0
    for seed in range(40):
        for size in (100, 150, 400, 1000):
            text, trig = document(seed, seed % 2 == 1), seed % 2 == 1
            found, started = cut(text, size, trig, "file:///d")
            wrong += started
            assert plain(found) == plain(parsed(text, "file:///d", trig)), (seed, size)
    assert wrong > 10  # ranges that start within a long string


@pytest.mark.parametrize("seed", range(2))
@pytest.mark.parametrize("trig", [False, True])
def test_slices_equal_the_whole(spark, tmp_path, seed, trig, monkeypatch):
    text = document(seed, trig)
    path = tmp_path / "in"
    path.mkdir()
    (path / "a.trig").write_bytes(text.encode())
    (path / "b.trig").write_bytes(HEAD.encode() + b"e:only e:p 1 .")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str([400, 1000][seed]))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    old = slices._scan

    def small(batches):  # the workers' own constants
        slices.PIECE_CHARS, slices.FEED_CHARS = 300, 70
        slices.Scanner.__init__.__defaults__ = (0, 300, True)
        return old(batches)

    monkeypatch.setattr(slices, "_scan", small)
    try:
        lines = slices.file_lines(spark, str(path))
        found = turtle.read(spark, str(path), graphs=trig)
        rows = [tuple(r) for r in found.collect()]
        assert lines.select("block").distinct().count() > 2
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    docs = {r.doc for r in lines.select("doc").distinct().collect()}
    want = [r for doc in docs for r in parsed(text if doc.endswith("a.trig") else HEAD + "e:only e:p 1 .", doc, trig)]
    assert len(rows) == len(want)
    plain = lambda rs: sorted(str((r[1] if r[0] != 1 else "", r[3] if r[2] == 0 else "", r[4], r[6] if r[5] != 1 else "", *r[7:9])) for r in rs)
    assert plain(rows) == plain(want)
    names = lambda rs: {v for r in rs for k, v in ((r[0], r[1]), (r[2], r[3]), (r[5], r[6])) if k == 1}
    assert len(names(rows)) == len(names(want))
    hashed = lambda rs: sorted(canon.first_degree_hashes(spark.createDataFrame(rs, QUAD)).select("hash").collect())
    assert hashed(rows) == hashed(want)


def test_scanner_tells_how_a_range_ends():
    ends = {}
    for mode in (0, 1, 2):
        scanner = slices.Scanner(mode, keep=mode == 0)
        list(scanner.feed('a """ b . \n'))
        list(scanner.feed("c ''' d\n"))
        ends[mode] = scanner.mode
    assert ends == {0: 1, 1: 2, 2: 0}


def test_a_fault_costs_its_piece(spark, tmp_path):
    (tmp_path / "x.ttl").write_text("<http://a> <http://p> 1 .\n<http://a> oops .\n")
    assert turtle.read(spark, str(tmp_path), mode="PERMISSIVE").where("error like '%piece%'").count() == 1
    with pytest.raises(Exception, match="oops"):
        turtle.read(spark, str(tmp_path)).collect()


def test_depth_is_counted():
    deep = lambda n: "<http://s> <http://p> " + "[ <http://p> " * n + "1" + " ]" * n + " ."
    assert len(turtle.parse(deep(turtle.DEPTH))) == turtle.DEPTH + 1
    with pytest.raises(ValueError, match="brackets"):
        turtle.parse(deep(turtle.DEPTH + 1))


def test_only_directives_in_force_are_carried_on(spark, tmp_path, monkeypatch):
    """A file that declares its base and prefixes again and again, as it is or in turn: each piece gets them once (turtle_files)."""
    one = "@prefix e: <http://e/{0}> . @base <http://b/{0}/> .\nPREFIX f: <f#>\n@base <sub/> .\n<x{1}> e:p f:y .\n"
    text = "".join(one.format(i % 3, i) for i in range(400))
    (tmp_path / "a.ttl").write_text(text)
    old = slices._scan

    def small(batches):  # the workers' own constants
        slices.PIECE_CHARS, slices.FEED_CHARS = 300, 70
        slices.Scanner.__init__.__defaults__ = (0, 300, True)
        return old(batches)

    monkeypatch.setattr(slices, "_scan", small)
    pieces = slices.pieces(slices.file_lines(spark, str(tmp_path))).select("preamble").collect()
    assert len(pieces) > 50 and max(len(p.preamble) for p in pieces) < 150
    found = turtle.read(spark, str(tmp_path)).select("s", "p", "o").collect()
    assert sorted(map(tuple, found)) == sorted((r[3], r[4], r[6]) for r in turtle.parse(text)) and len(found) == 400


def test_directives_in_force():
    said = ["@prefix e: <http://e/> .", "@base <http://b/> .", "@prefix f: <f#> .", "@base <sub/> .", "@prefix e: <http://e/> .", "@base <sub/> ."]
    assert slices._in_force(said) == said[1:]
    assert slices._in_force([*said, "@base <http://c/> ."]) == [said[1], said[2], said[4], "@base <http://c/> ."]
    assert slices._resolved(said, "file:///d") == ["@prefix f: <http://b/f#> .", "@prefix e: <http://e/> .", "@base <http://b/sub/sub/> ."]
    odd = ["@base <a b/> .", "@prefix f: <\\u0066#> .", "@base <x> ."]  # faults and escapes are left to the parser
    assert slices._resolved(odd, "file:///d") == odd
