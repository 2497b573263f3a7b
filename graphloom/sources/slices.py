"""Large Turtle and TriG files in slices of whole statements, however few files there are.

Spark deals a file's lines to tasks by byte ranges.  A first pass over the lines
of each range looks for the ends of statements: a dot before white space, outside
strings, IRIs and comments, ends one wherever it stands.  The range is cut there
into pieces of whole statements.  What comes before the first end and after the
last one is put together with the neighbouring ranges' by (file, statement).

A range may start inside a long string.  The pass takes it that it doesn't, and
notes for every way to start how the range ends; from these notes, a row per
range, follows how each really starts, and the few that were taken wrongly are
read again.  Prefixes, the base and the open graph before each piece come from
one walk over the file's pieces without their text, which carries on only what
is in force.  Then every piece is read on its own.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.iri import resolve_one
from ..storage import written

#: Characters after which a piece is closed at the next end of a statement, and that are looked at together.
PIECE_CHARS, FEED_CHARS = 1 << 19, 1 << 16
#: Rows and characters of states up to which they are broadcast to the pieces.
SMALL_STATES, SMALL_CHARS = 100_000, 1 << 25

_TOKEN = re.compile(
    r"""(?P<long>\"\"\"|''')
    |(?P<short>"(?:[^"\\\n\r]|\\.)*"|'(?:[^'\\\n\r]|\\.)*')
    |(?P<iri><[^\x00-\x20<>"{}|^`]*>)
    |(?P<comment>\#[^\n\r]*)
    |(?P<escape>\\.)
    |(?P<end>\.(?=\s))
    |(?P<brace>[{}])
    |(?P<word>(?<!["'])@(?:prefix|base)(?![\w-])|(?<![\w:.@\\%-])(?:[pP][rR][eE][fF][iI][xX]|[bB][aA][sS][eE])(?![\w:.-]))""",
    re.VERBOSE,
)
_BLANK = r"(?:\s|\#[^\n\r]*[\n\r])*"
_DIRECTIVE = re.compile(rf"@?(?:(?i:prefix){_BLANK}(?P<prefix>[^\s:<>\"']*):{_BLANK}|(?i:base){_BLANK})<(?P<iri>[^>\n]*)>")
_LABEL = re.compile(r"(?:^|[\s.}])(<[^<>\s]*>|\[\s*\]|_:[^\s<>\"{}]*[^\s<>\"{}.]|[^\s<>\"{}()\[\];,#:]*:(?:[^\s<>\"{}]*[^\s<>\"{}.])?)\s*$")
_CLOSE = {1: re.compile(r'(?:[^"\\]|\\.|"(?!""))*?"""', re.DOTALL), 2: re.compile(r"(?:[^'\\]|\\.|'(?!''))*?'''", re.DOTALL)}
_LAST = re.compile(r"(?:\s|\#[^\n\r]*(?:[\n\r]|$))*$")

_ABSOLUTE = re.compile(r"[a-zA-Z][a-zA-Z0-9+.-]*:")
_PLAIN = re.compile(_ABSOLUTE.pattern + r"[^\x00-\x20<>\"{}|^`\\]*")

PIECE = "doc string, block long, piece int, kind string, text string, directives array<string>, graph string, opened int, ends array<int>"
STATE = "doc string, block long, piece int, preamble string, graph_at string, ends_open boolean"


@dataclass
class Piece:
    text: str
    directives: list[str] = field(default_factory=list)
    graph: str | None = None  # None: no brace; "}": closed; "{label": open
    opened: int = 0  # number of the last opening brace within the piece, from 0


class Scanner:
    """Cuts text that comes in portions of whole lines at ends of statements.

    ``mode``: 0 outside long strings, 1 within double quotes, 2 within single ones.
    """

    def __init__(self, mode: int = 0, piece_chars: int = PIECE_CHARS, keep: bool = True) -> None:
        self.mode, self.piece_chars, self.keep = mode, piece_chars, keep
        self.text, self.at, self.safe, self.since = "", 0, 0, 0
        self.events: list[tuple[int, str, str]] = []
        self.head_done = False

    def piece(self, end: int) -> Piece:
        """The text up to a place, with its events; the rest stays."""
        mine, self.events = [e for e in self.events if e[0] <= end], [(at - end, what, text) for at, what, text in self.events if at > end]
        braces = [text for _, what, text in mine if what == "brace"]
        opened = sum(b.startswith("{") for b in braces) - 1
        out = Piece(self.text[:end], [text for _, what, text in mine if what == "directive"], braces[-1] if braces else None, opened)
        self.text, self.at, self.safe, self.since = self.text[end:], self.at - end, 0, max(self.since - end, 0)
        return out

    def feed(self, text: str) -> Iterator[tuple[str, Piece]]:
        """Pieces that are complete: the head, up to the first end, then bodies."""
        self.text += text
        while self.at < len(self.text):
            if self.mode:
                closed = _CLOSE[self.mode].match(self.text, self.at)
                if not closed:
                    back = len(self.text) - 1 if self.text.endswith("\n") else len(self.text)
                    self.at = max(self.at, self.resume(back))
                    break
                self.mode, self.at = 0, closed.end()
                continue
            m = _TOKEN.search(self.text, self.at)
            if not m:
                self.at = len(self.text)
                break
            kind, self.at = m.lastgroup, m.end()
            if kind == "long":
                self.mode = 1 if m[0][0] == '"' else 2
            elif kind == "word":
                directive = _DIRECTIVE.match(self.text, m.start())
                if directive:
                    self.events.append((m.start(), "directive", f"@prefix {directive['prefix']}: <{directive['iri']}> ." if directive["prefix"] is not None else f"@base <{directive['iri']}> ."))
                    self.at = self.since = directive.end()
                elif ">" not in self.text[m.start() :]:  # it goes on in the next portion
                    self.at = m.start()
                    break
            elif kind == "brace":
                label = _LABEL.search(re.sub(r"#[^\n\r]*[\n\r]", " ", self.text[self.since : m.start()])) if m[0] == "{" else None
                self.events.append((m.start(), "brace", m[0] + (label[1] if label else "")))
                self.since = self.at
            elif kind == "end":
                self.safe = self.since = self.at
                if not self.head_done and self.keep:
                    self.head_done = True
                    yield "head", self.piece(self.at)
                elif self.at >= self.piece_chars and self.keep:
                    yield "body", self.piece(self.at)
        if not self.keep:
            self.piece(self.at)
            self.events.clear()

    def resume(self, end: int) -> int:
        """A place within an open long string from which its end can be looked for again: no quote or escape is cut."""
        start = max(self.at, end - 64)
        while start > self.at and self.text[start - 1] in "\\\"'":
            start -= 1
        return start

    def rest(self) -> Iterator[tuple[str, Piece]]:
        """What is left at the end of a range: a body of whole statements, and the open one."""
        if not self.head_done:
            yield "through", self.piece(len(self.text))
            return
        if self.safe:
            yield "body", self.piece(self.safe)
        yield "tail", self.piece(len(self.text))


def _in_force(directives: list[str]) -> list[str]:
    """Those that still count behind them all, in order: the last of each prefix, the last base, and bases that these are relative to."""
    out, names, relative = [], set(), True
    for directive in reversed(directives):
        name, _, iri = directive.partition("<")
        if name == "@base ":
            keep = relative
            relative = relative and not _ABSOLUTE.match(iri)
        else:
            keep = name not in names
            relative = relative or keep and not _ABSOLUTE.match(iri)
            names.add(name)
        if keep:
            out.append(directive)
    return out[::-1]


def _resolved(directives: list[str], base: str | None) -> list[str]:
    """The same, in force and with whole IRIs, so that what is relative to a base doesn't pile up; one that can't be resolved stays."""
    out = []
    for directive in directives:
        name, _, iri = directive[:-3].partition("<")
        try:
            whole = resolve_one(iri, base) if "\\" not in iri else ""
        except ValueError:
            whole = ""
        if not _PLAIN.fullmatch(whole):
            whole = ""
        if name == "@base ":
            base = whole or None
        out.append(f"{name}<{whole or iri}> .")
    return _in_force(out)


def _carried(batches: Iterable[pd.DataFrame], base: str | None) -> Iterator[pd.DataFrame]:
    """What is in force before each piece, from the pieces of each file in order, without their text."""
    now, start, said, preamble, open_at = None, None, [], "", None
    for batch in batches:
        out = []
        for doc, block, piece, directives, graph, opened in batch[["doc", "block", "piece", "directives", "graph", "opened"]].itertuples(index=False, name=None):
            if doc != now:
                start = base or doc
                now, start, said, preamble, open_at = doc, start if "://" in start else base, [], "\n", None
            label = open_at[0] if open_at else "}"
            within = f"{open_at[1]}-{open_at[2]}.g{open_at[3]}" if label.startswith("{[") else None
            before = preamble + (f"{label[1:]} {{\n" if label.startswith("{") else "")
            if graph is not None:
                open_at = graph, block, piece, opened
            out.append((doc, block, piece, before, within, bool(open_at) and open_at[0].startswith("{")))
            if len(directives):
                said = _resolved([*said, *directives], start)
                preamble = "".join(f"{d}\n" for d in said)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in STATE.split(", ")])


def _row(doc: str, block: int, number: int, kind: str, piece: Piece) -> tuple:
    return doc, block, number, kind, piece.text, _in_force(piece.directives), piece.graph, piece.opened, None


def _scan(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pieces of the ranges dealt to a task, from its lines (doc, block, mode, line) in order; a row of kind ``end`` tells how a range ends."""
    columns = [c.split()[0] for c in PIECE.split(", ")]
    now, lines, size, number, scanners, out = None, [], 0, 0, [], []

    def fed() -> None:
        nonlocal lines, size, number
        text, lines, size = "".join(lines), [], 0
        for kind, piece in scanners[0].feed(text):
            out.append(_row(*now, number, kind, piece))
            number += 1
        for other in scanners[1:]:
            for _ in other.feed(text):
                pass

    def closed() -> None:
        nonlocal number
        fed()
        for kind, piece in scanners[0].rest():
            out.append(_row(*now, number, kind, piece))
            number += 1
        out.append((*now, number, "end", None, None, None, 0, [s.mode for s in scanners]))

    for batch in batches:
        for doc, block, mode, line in zip(batch.doc, batch.block, batch["mode"], batch.line, strict=True):
            if (doc, block) != now:
                if now is not None:
                    closed()
                now, number = (doc, block), 0
                scanners = [Scanner(mode)] + [Scanner(m, keep=False) for m in (1, 2) if mode == 0]
            lines.append(line + "\n")
            size += len(line) + 1
            if size >= FEED_CHARS:
                fed()
            if len(out) >= 16:
                yield pd.DataFrame(out, columns=columns)
                out.clear()
    if now is not None:
        closed()
    if out:
        yield pd.DataFrame(out, columns=columns)


def _starts(rows: pd.DataFrame) -> pd.DataFrame:
    """How the ranges of one file really start, those that were taken wrongly: (doc, block, mode)."""
    rows, mode, out = rows.sort_values("block"), 0, []
    for doc, block, ends in zip(rows.doc, rows.block, rows.ends, strict=True):
        if mode:
            out.append((doc, block, mode))
        mode = int(ends[mode])
    return pd.DataFrame(out, columns=["doc", "block", "mode"])


def _rescan(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Events of statements that were put together from several ranges."""
    for batch in batches:
        out = []
        for doc, block, number, text in zip(batch.doc, batch.block, batch.piece, batch.text, strict=True):
            scanner = Scanner(piece_chars=1 << 62)
            parts = [p for _, p in [*scanner.feed(text + "\n"), *scanner.rest()]]
            braces = [p.graph for p in parts if p.graph]
            whole = Piece(text, [d for p in parts for d in p.directives], braces[-1] if braces else None, sum(p.opened + 1 for p in parts) - 1)
            out.append(_row(doc, block, number, "body", whole))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in PIECE.split(", ")])


def pieces(lines: DataFrame, base: str | None = None) -> DataFrame:
    """(doc, block, piece, text, preamble, graph_at, ends_open) of lines (doc, block, line), whose order within a range is that of the rows.

    ``preamble`` has the directives in force and the opening of the graph in
    which a piece starts; ``graph_at`` names that opening where the graph is a
    blank node without a label; ``ends_open`` tells whether the graph is still
    open behind the piece.  Of directives only those in force are carried on,
    however often a file repeats or changes them; ``base`` (or the file) is
    what the first ones are relative to.
    """
    at = ["doc", "block", "piece"]
    lines = lines.select("doc", F.col("block").cast("long").alias("block"), F.lit(0).alias("mode"), F.coalesce("line", F.lit("")).alias("line"))
    found = written(lines.mapInPandas(_scan, PIECE), "slices")
    wrong = found.where("kind = 'end'").select("doc", "block", "ends").groupBy("doc").applyInPandas(_starts, "doc string, block long, mode int")
    wrong = written(wrong, "slices-starts")  # a row per range that starts within a string
    rounds = -(-wrong.count() // SMALL_STATES)
    if rounds:
        found = found.join(wrong.drop("mode"), ["doc", "block"], "left_anti")
    for i in range(rounds):  # a broadcast keeps the order of lines; about SMALL_STATES rows at a time
        some = wrong.where(F.pmod(F.xxhash64("doc", "block"), F.lit(rounds)) == i)
        again = lines.drop("mode").join(F.broadcast(some), ["doc", "block"]).select("doc", "block", "mode", "line")
        found = found.unionByName(written(again.mapInPandas(_scan, PIECE), "slices"))
    cut = found.where("kind in ('head', 'through', 'tail')")
    order = Window.partitionBy("doc").orderBy("block", "piece")
    statement = F.sum(F.when(F.col("kind") == "tail", 1).otherwise(0)).over(order)
    whole = cut.select(*at, "text", statement.alias("statement")).groupBy("doc", "statement").agg(F.sort_array(F.collect_list(F.struct("block", "piece", "text"))).alias("parts"))
    whole = whole.select("doc", F.col("parts")[0]["block"].alias("block"), F.col("parts")[0]["piece"].alias("piece"), F.array_join(F.col("parts.text"), "").alias("text"))
    body = written(found.where("kind = 'body'").unionByName(whole.mapInPandas(_rescan, PIECE)), "slices-whole")

    dealt = body.select(*at, "directives", "graph", "opened").repartition("doc").sortWithinPartitions(*at)
    states = written(dealt.mapInPandas(lambda batches: _carried(batches, base), STATE), "slices-states")
    size = states.agg(F.count("*"), F.sum(F.length("preamble"))).first()
    states = F.broadcast(states) if size[0] <= SMALL_STATES and (size[1] or 0) <= SMALL_CHARS else states
    return body.select(*at, "text").join(states, at)


def file_lines(spark: SparkSession, path: str) -> DataFrame:
    """(doc, block, line): the lines of files, in ranges of bytes."""
    rows = spark.read.option("lineSep", "\n").option("recursiveFileLookup", True).text(path)
    return rows.select(F.col("_metadata.file_path").alias("doc"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("line"))
