"""Turtle and TriG: files read in slices of whole statements, written as a stream per partition.

However large a file is, its ranges of bytes are dealt to all tasks (``slices``),
and what a task parses is a piece of some thousands of statements.  Documents in
cells of a table are parsed a cell at a time.  For writing, quads are dealt by
range and sorted, and each partition is written as a document of its own while
its rows pass by.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.iri import PREFIXES, resolve_one
from ..functions.terms import escape_iri, escape_literal, term_text
from ..operators.nesting import nest
from ..schema import BLANK, BOOLEAN, COLUMNS, DECIMAL, DOUBLE, FIRST, INTEGER, IRI, LANG_STRING, LITERAL, NIL, REST, STRING, TYPE
from . import slices
from .nquads import checked

#: Brackets that may be open within each other; more are a fault of the document, on every machine.
DEPTH = 150
#: Characters after which a document is closed.
DOCUMENT_CHARS = 1 << 25

_LEX = re.compile(
    r"""(?P<skip>(?:\s|\#[^\n\r]*)+)
    |(?P<iri><(?:[^\x00-\x20<>"{}|^`\\]|\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8})*>)
    |(?P<text>\"\"\"(?:\"{0,2}(?:[^"\\]|\\.))*\"\"\"|'''(?:'{0,2}(?:[^'\\]|\\.))*'''|"(?:[^"\\\n\r]|\\.)*"|'(?:[^'\\\n\r]|\\.)*')
    |(?P<lang>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)
    |(?P<number>[+-]?(?:\d+\.\d*[eE][+-]?\d+|\.?\d+[eE][+-]?\d+|\d*\.\d+|\d+)(?![\w:]))
    |(?P<blank>_:[\w·](?:[\w.·-]*[\w·-])?)
    |(?P<name>(?:[^\W\d_](?:[\w.·-]*[\w·-])?)?:(?:(?:[\w:·]|%[0-9A-Fa-f]{2}|\\[_~.\-!$&'()*+,;=/?\#@%])(?:(?:[\w.:·-]|%[0-9A-Fa-f]{2}|\\[_~.\-!$&'()*+,;=/?\#@%])*(?:[\w:·-]|%[0-9A-Fa-f]{2}|\\[_~.\-!$&'()*+,;=/?\#@%]))?)?)
    |(?P<word>[A-Za-z]+)
    |(?P<mark>\^\^|[.;,\[\](){}])""",
    re.VERBOSE | re.DOTALL,
)
_ESCAPE = re.compile(r"\\(u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|.)", re.DOTALL)
_SHORT = {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f", '"': '"', "'": "'", "\\": "\\"}


def _plain(text: str) -> str:
    def one(m: re.Match) -> str:
        code = m[1]
        if len(code) > 1:
            return chr(int(code[1:], 16))
        if code not in _SHORT:
            raise ValueError(f"unknown escape \\{code}")
        return _SHORT[code]

    return _ESCAPE.sub(one, text) if "\\" in text else text


class _Reader:
    """Statements of one document, or of a piece of one; terms are (kind, value, datatype, language).

    ``scope`` tells pieces of a document apart; ``within`` is the blank node that
    names the graph in which a piece starts, if it has no label; ``labels``, the
    document if not given, is where labels of blank nodes belong.
    """

    def __init__(self, text: str, doc: str, base: str | None, graphs: bool, scope: str = "", within: str | None = None, starts_open: bool = False, labels: str | None = None) -> None:
        self.doc, self.base, self.graphs, self.prefixes, self.scope, self.within = doc, base, graphs, {}, scope, within
        self.labels = doc if labels is None else labels
        self.rows: list[tuple] = []
        self.graph: tuple | None = None
        self.made, self.depth, self.opened = 0, 0, -1 if starts_open else 0
        self.tokens: list[tuple[str, str, int]] = []
        at = 0
        while at < len(text):
            m = _LEX.match(text, at)
            if not m:
                raise ValueError(f"line {text.count(chr(10), 0, at) + 1}: can't read {text[at : at + 20]!r}")
            if m.lastgroup != "skip":
                self.tokens.append((m.lastgroup, m[0], at))
            at = m.end()
        self.text, self.i = text, 0

    def fail(self, what: str) -> ValueError:
        at = self.tokens[self.i][2] if self.i < len(self.tokens) else len(self.text)
        return ValueError(f"line {self.text.count(chr(10), 0, at) + 1}: {what}")

    def peek(self) -> tuple[str, str]:
        return self.tokens[self.i][:2] if self.i < len(self.tokens) else ("end", "")

    def take(self, mark: str | None = None) -> tuple[str, str]:
        token = self.peek()
        if mark is not None and token[1] != mark or token[0] == "end":
            raise self.fail(f"{mark or 'a term'} is missing")
        self.i += 1
        return token

    def new_blank(self) -> tuple:
        self.made += 1
        return (BLANK, f"{self.doc}|.{self.scope}{self.made}", None, None)

    def graph_name(self) -> tuple:
        if self.peek() != ("mark", "["):
            return self.node(False)[:2]
        self.take("[")
        self.take("]")
        return (BLANK, self.within if self.opened < 0 and self.within else f"{self.doc}|.{self.scope}g{self.opened}")

    def iri(self) -> tuple:
        kind, raw = self.take()
        if kind == "iri":
            value = _plain(raw[1:-1])
            return (IRI, value if re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*:", value) else resolve_one(value, self.base), None, None)
        if kind == "name":
            prefix, _, local = raw.partition(":")
            if prefix not in self.prefixes:
                raise self.fail(f"unknown prefix {prefix}:")
            return (IRI, self.prefixes[prefix] + re.sub(r"\\(.)", r"\1", local), None, None)
        raise self.fail(f"an IRI is expected, not {raw!r}")

    def emit(self, s: tuple, p: tuple, o: tuple) -> None:
        g = self.graph or (None, None)
        self.rows.append((g[0], g[1], s[0], s[1], p[1], *o))

    def verb(self) -> tuple:
        if self.peek() == ("word", "a"):
            self.i += 1
            return (IRI, TYPE, None, None)
        return self.iri()

    def node(self, literals: bool) -> tuple:
        kind, raw = self.peek()
        if kind == "blank":
            self.i += 1
            return (BLANK, f"{self.labels}|{raw[2:]}", None, None)
        if kind == "mark" and raw in "[(":
            self.i += 1
            self.depth += 1
            if self.depth > DEPTH:
                raise self.fail(f"more than {DEPTH} brackets are open")
        if raw == "[" and kind == "mark":
            node = self.new_blank()
            if self.peek() != ("mark", "]"):
                self.properties(node)
            self.take("]")
            self.depth -= 1
            return node
        if raw == "(" and kind == "mark":
            items = []
            while self.peek() != ("mark", ")"):
                items.append(self.node(True))
            self.i += 1
            self.depth -= 1
            nodes = [self.new_blank() for _ in items] + [(IRI, NIL, None, None)]
            for node, item, rest in zip(nodes, items, nodes[1:], strict=False):
                self.emit(node, (IRI, FIRST), item)
                self.emit(node, (IRI, REST), rest)
            return nodes[0]
        if literals and kind in ("text", "number", "word"):
            return self.literal()
        return self.iri()

    def literal(self) -> tuple:
        kind, raw = self.take()
        if kind == "number":
            return (LITERAL, raw, DOUBLE if "e" in raw.lower() else DECIMAL if "." in raw else INTEGER, None)
        if kind == "word":
            if raw not in ("true", "false"):
                raise self.fail(f"unknown word {raw!r}")
            return (LITERAL, raw, BOOLEAN, None)
        quotes = 3 if raw[:3] in ('"""', "'''") and len(raw) >= 6 else 1
        value = _plain(raw[quotes:-quotes])
        if self.peek()[0] == "lang":
            return (LITERAL, value, LANG_STRING, self.take()[1][1:])
        if self.peek()[1] == "^^":
            self.i += 1
            return (LITERAL, value, self.iri()[1], None)
        return (LITERAL, value, STRING, None)

    def properties(self, subject: tuple) -> None:
        while True:
            verb = self.verb()
            self.emit(subject, verb, self.node(True))
            while self.peek()[1] == ",":
                self.i += 1
                self.emit(subject, verb, self.node(True))
            while self.peek()[1] == ";":
                self.i += 1
                ended = self.peek()[1] in (".", "]", "}", ";") or self.peek()[0] == "end"
            if self.tokens[self.i - 1][1] != ";":
                return
            if ended:
                return

    def directive(self) -> bool:
        kind, raw = self.peek()
        word = raw.lstrip("@").lower()
        if kind not in ("lang", "word") or word not in ("prefix", "base") or (kind == "lang") != raw.startswith("@"):
            return False
        self.i += 1
        if word == "prefix":
            prefix = self.take()[1]
            if not prefix.endswith(":"):
                raise self.fail("a prefix ends with a colon")
            self.prefixes[prefix[:-1]] = self.iri()[1]
        else:
            self.base = self.iri()[1]
        if raw.startswith("@"):
            self.take(".")
        return True

    def triples(self) -> None:
        nested = self.peek()[1] == "["
        before = len(self.rows)
        subject = self.node(False)
        if nested and len(self.rows) > before and (self.peek()[1] in (".", "}") or self.peek()[0] == "end"):
            return
        self.properties(subject)

    def block(self) -> None:
        self.take("{")
        self.opened += 1
        while self.peek()[1] != "}":
            self.triples()
            if self.peek()[1] == ".":
                self.i += 1
            elif self.peek()[1] != "}":
                raise self.fail(". is missing")
        self.i += 1

    def document(self) -> list[tuple]:
        while self.peek()[0] != "end":
            if self.directive():
                continue
            if self.graphs:
                named = self.peek()[0] == "word" and self.peek()[1].upper() == "GRAPH"
                if named:
                    self.i += 1
                if not named and self.peek()[1] == "{":
                    self.block()
                    continue
                ahead = self.tokens[self.i + (2 if self.peek()[1] == "[" else 1)][1] if self.i + 2 < len(self.tokens) else ""
                if named or ahead == "{":
                    self.graph = self.graph_name()
                    self.block()
                    self.graph = None
                    continue
            self.triples()
            self.take(".")
        return self.rows


def parse(text: str, doc: str = "doc", base: str | None = None, graphs: bool = True) -> list[tuple]:
    """Quad rows of one document; raises ValueError with the line of a fault."""
    return _Reader(text, doc, base, graphs).document()


_QUADS = "g_kind byte, g string, s_kind byte, s string, p string, o_kind byte, o string, o_dt string, o_lang string, error string"


def parse_documents(docs: DataFrame, graphs: bool = True, base: str | None = None, mode: str = "FAILFAST", scope: str | None = None) -> DataFrame:
    """Quads of documents (doc, text), each parsed whole by one task.

    A label of a blank node belongs to its document; with ``scope`` to all that
    are read with it, such as those of one written output.
    """

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for doc, text in zip(batch.doc, batch.text, strict=True):
                try:
                    rows = [(*r, None) for r in _Reader(text or "", doc, base or doc if "://" in (base or doc) else base, graphs, labels=scope).document()]
                except ValueError as fault:
                    rows = [(None,) * 9 + (f"{doc}: {fault}",)]
                yield from _frames(rows)

    return checked(docs.select("doc", "text").mapInPandas(run, _QUADS), mode)


def _frames(rows: list[tuple]) -> Iterator[pd.DataFrame]:
    for at in range(0, len(rows), 10_000):
        part = pd.DataFrame(rows[at : at + 10_000], columns=[*COLUMNS, "error"])
        yield part.astype({c: "Int8" for c in ("g_kind", "s_kind", "o_kind")})


def parse_pieces(pieces: DataFrame, graphs: bool = True, base: str | None = None, scope: str | None = None) -> DataFrame:
    """Quads, with ``error``, of the pieces of files that ``slices.pieces`` gives; a fault costs its piece only."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for doc, block, piece, text, preamble, at, ends_open in batch[["doc", "block", "piece", "text", "preamble", "graph_at", "ends_open"]].itertuples(index=False, name=None):
                whole = preamble + text + ("\n}" if ends_open else "")
                within = f"{doc}|.{at}" if at is not None else None
                try:
                    found = _Reader(whole, doc, base or doc if "://" in (base or doc) else base, graphs, f"{block}-{piece}.", within, preamble.endswith("{\n"), scope).document()
                    rows = [(*r, None) for r in found]
                except ValueError as fault:
                    rows = [(None,) * 9 + (f"{doc}, from byte {block}, piece {piece}: {fault}",)]
                yield from _frames(rows)

    return pieces.mapInPandas(run, _QUADS)


def read(spark: SparkSession, path: str, graphs: bool = True, base: str | None = None, mode: str = "FAILFAST", scope: str | None = None) -> DataFrame:
    """Quads of files, each of which is read by as many tasks as it has ranges of bytes.

    A label of a blank node belongs to its file; with ``scope`` to all files that
    are read with it, such as those of one written output.
    """
    return checked(parse_pieces(slices.pieces(slices.file_lines(spark, path), base), graphs, base, scope), mode)


def _short(kind: str, value: str, prefixes: dict[str, str], base: str | None = None) -> Column:
    """``prefix:local`` where the local part is plain, a relative reference below the base, else the full term."""
    full = term_text(F.col(kind), F.col(value)) if kind else F.concat(F.lit("<"), escape_iri(F.col(value)), F.lit(">"))
    after = lambda ns: F.substring(F.col(value), F.lit(len(ns) + 1), F.length(value))
    own = (F.col(kind) == IRI) if kind else F.lit(True)
    out = full
    if base and kind:
        out = F.when(own & F.col(value).startswith(base) & after(base).rlike(r"^[A-Za-z0-9_-][A-Za-z0-9_./-]*$"), F.concat(F.lit("<"), after(base), F.lit(">"))).otherwise(out)
    for prefix, ns in sorted(prefixes.items(), key=lambda x: len(x[1])):
        out = F.when(own & F.col(value).startswith(ns) & after(ns).rlike(r"^[A-Za-z_][A-Za-z0-9_-]*$"), F.concat(F.lit(prefix + ":"), after(ns))).otherwise(out)
    return out


def _object(prefixes: dict[str, str], base: str | None) -> Column:
    number = (F.col("o_dt").isin(INTEGER) & F.col("o").rlike(r"^[+-]?\d+$")) | ((F.col("o_dt") == DECIMAL) & F.col("o").rlike(r"^[+-]?\d*\.\d+$")) | ((F.col("o_dt") == BOOLEAN) & F.col("o").isin("true", "false"))
    typed = F.concat(F.lit('"'), escape_literal(F.col("o")), F.lit('"^^'), _short("", "o_dt", prefixes))
    plain = F.col("o_lang").isNotNull() | F.col("o_dt").isNull() | (F.col("o_dt") == STRING)
    literal = F.when(number, F.col("o")).when(plain, term_text(F.col("o_kind"), F.col("o"), F.col("o_dt"), F.col("o_lang"))).otherwise(typed)
    return F.when(F.col("o_kind") == LITERAL, literal).otherwise(_short("o_kind", "o", prefixes, base))


def _predicate(prefixes: dict[str, str]) -> Column:
    return F.when(F.col("p") == TYPE, "a").otherwise(_short("", "p", prefixes))


def _nested(rows: DataFrame, prefixes: dict[str, str], base: str | None) -> DataFrame:
    """Rows (quads with ``text``, the object as written) in which blank nodes used once are written where they are used: lists as ``( )``, others as ``[ ]``."""
    rows = rows.withColumn("text", F.when((F.col("o_kind") == IRI) & (F.col("o") == NIL), "()").otherwise(F.col("text")))
    wrapped = lambda left, parts, sep, right: F.when(F.size(parts) == 0, left + right).otherwise(F.concat(F.lit(left + " "), F.array_join(parts, sep), F.lit(" " + right)))
    written_list = lambda items: wrapped("(", items, " ", ")")
    written_node = lambda entries: wrapped("[", F.transform(entries, lambda e: F.concat(e["name"], F.lit(" "), e["text"])), " ; ", "]")
    return nest(rows, _object(prefixes, base), _predicate(prefixes), written_list, written_node)


def documents(q: DataFrame, prefixes: dict[str, str] | None = None, partitions: int | None = None, nested: bool = False, base: str | None = None, keyword: bool = False) -> DataFrame:
    """(doc, text): TriG documents in the order of graph, subject and predicate, rdf:type first.

    A partition is one document, or several where it is long: a document is
    closed at the subject that fills it.  A subject whose triples fill several
    partitions is simply named again in each, so no subject is ever gathered.
    ``nested`` writes blank nodes that are used once, and lists, in place;
    ``base`` gives an ``@base`` and references below it; ``keyword`` writes
    GRAPH before the name of a graph.
    """
    prefixes = PREFIXES if prefixes is None else prefixes
    rows = q.select(*COLUMNS, _object(prefixes, base).alias("text"))
    if nested:
        rows = _nested(rows, prefixes, base)
    keys = ["g_kind", "g", "s_kind", "s", "later", "p", "text"]
    rows = rows.withColumn("later", F.col("p") != TYPE)
    dealing = [*keys[:-1], F.substring("text", 1, 64), F.xxhash64("text")]  # the driver gets samples of these
    dealt = rows.repartitionByRange(partitions, *dealing) if partitions else rows.repartitionByRange(*dealing)
    rows = dealt.sortWithinPartitions(*keys).select(term_text(F.col("g_kind"), F.col("g")).alias("g"), _short("s_kind", "s", prefixes, base).alias("s"), _predicate(prefixes).alias("p"), "text")
    head = (f"@base <{base}> .\n" if base else "") + "".join(f"@prefix {p}: <{ns}> .\n" for p, ns in sorted(prefixes.items()))
    graph = "GRAPH " if keyword else ""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, seq, held = TaskContext.get().partitionId(), 0, len(head)
        out, last = [head], (None, None, None)

        def closed() -> pd.DataFrame:
            return pd.DataFrame({"doc": [f"part-{part:05d}-{seq:04d}"], "text": ["".join([*out, " .\n", "}\n" if last[0] is not None else ""])]})

        for batch in batches:
            for g, s, p, o in batch.itertuples(index=False, name=None):
                fresh = (g, s) != last[:2]
                if fresh and last[1] is not None and held > DOCUMENT_CHARS:
                    yield closed()
                    out, last, held, seq = [head], (None, None, None), len(head), seq + 1
                if fresh:
                    if last[1] is not None:
                        out.append(" .\n" + ("}\n" if last[0] is not None and g != last[0] else ""))
                    if g is not None and (last[1] is None or g != last[0]):
                        out.append(f"{graph}{g} {{\n")
                    out.append(f"{s} {p} {o}")
                elif p != last[2]:
                    out.append(f" ;\n    {p} {o}")
                else:
                    out.append(f", {o}")
                held += len(out[-1])
                last = (g, s, p)
        if last[1] is not None:
            yield closed()

    return rows.mapInPandas(run, "doc string, text string")


def write(q: DataFrame, path: str, prefixes: dict[str, str] | None = None, partitions: int | None = None, **options) -> None:
    """Files of a document each, or of several that repeat their prefixes."""
    documents(q, prefixes, partitions, **options).select("text").write.text(path)


def can_parse(text: str) -> bool:
    """A cheap look at the head of a document."""
    head = text[:4000]
    return not re.match(r"\s*<(!DOCTYPE|html|\?xml|rdf:RDF)", head, re.IGNORECASE) and bool(re.search(r"(?im)^\s*@?(prefix|base)\b|(\s|^)a\s+[\w<:]|<[^>\s]+>\s+\S+\s+.*[.;,]\s*$", head))
