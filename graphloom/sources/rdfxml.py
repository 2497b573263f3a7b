"""RDF/XML: documents to triples, one task per file, and triples to description elements."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from xml.etree import ElementTree as ET
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.iri import resolve_one
from ..functions.terms import blank_label
from ..schema import BLANK, COLUMNS, FIRST, IRI, LANG_STRING, LITERAL, NIL, RDF, REST, STRING, TYPE

#: Elements that may stand within each other; more are a fault of the document, on every machine.
DEPTH = 200
#: Characters after which a document is closed.
DOCUMENT_CHARS = 1 << 25
# The characters of XML names without a colon.
_NCNAME = re.compile("[A-Za-z_\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u02ff\u0370-\u037d\u037f-\u1fff\u200c\u200d\u2070-\u218f\u2c00-\u2fef\u3001-\ud7ff\uf900-\ufdcf\ufdf0-\ufffd][\\w.\\-\u00b7\u0300-\u036f\u203f\u2040]*")
_X = "{http://www.w3.org/XML/1998/namespace}"
_R = "{" + RDF + "}"


def _name(tag: str) -> str:
    return tag[1:].replace("}", "", 1) if tag.startswith("{") else tag


def copy_of(e: ET.Element) -> ET.Element:
    """The element without what follows it."""
    out = ET.Element(e.tag, e.attrib)
    out.text = e.text
    out.extend(e)
    return out


class _Reader:
    """Triples of one document; ``strict`` adds the rules on names and identifiers."""

    def __init__(self, doc: str, base: str | None, strict: bool = False) -> None:
        self.doc, self.base, self.rows, self.made, self.strict, self.names = doc, base, [], 0, strict, set()

    def rules(self, e: ET.Element, base: str | None, node: bool) -> None:
        """Identifiers are XML names and unique for their base; only one way to name a node; no old or misplaced attributes."""
        if not self.strict:
            return
        ident, label = e.get(_R + "ID"), e.get(_R + "nodeID")
        for name in (ident, label):
            if name is not None and not _NCNAME.fullmatch(name):
                raise ValueError(f"no XML name: {name!r}")
        if ident is not None:
            if (base, ident) in self.names:
                raise ValueError(f"rdf:ID {ident!r} is there twice")
            self.names.add((base, ident))
        ways = [a for a in ("about", "ID", "nodeID") if e.get(_R + a) is not None] if node else [a for a in ("resource", "nodeID", "parseType") if e.get(_R + a) is not None]
        if len(ways) > 1:
            raise ValueError(f"rdf:{ways[0]} and rdf:{ways[1]} exclude each other")
        wrong = {_R + x for x in ("aboutEach", "aboutEachPrefix", "bagID", "li")} & e.attrib.keys() or ({e.tag} & {_R + x for x in ("RDF", "ID", "about", "bagID", "parseType", "resource", "nodeID", "datatype", "aboutEach", "aboutEachPrefix", *(("li",) if node else ("Description",)))})
        if wrong:
            raise ValueError(f"not allowed here: {_name(wrong.pop())}")

    def blank(self, label: str | None = None) -> tuple:
        self.made += label is None
        return (BLANK, f"{self.doc}|{label if label is not None else f'.{self.made}'}", None, None)

    def ref(self, value: str, base: str | None) -> tuple:
        return (IRI, resolve_one(value, base) if base or re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*:", value) else value, None, None)

    def emit(self, s: tuple, p: str, o: tuple, reified: tuple | None = None) -> None:
        self.rows.append((None, None, s[0], s[1], p, *o))
        if reified:
            for q, v in ((TYPE, (IRI, RDF + "Statement", None, None)), (RDF + "subject", s), (RDF + "predicate", (IRI, p, None, None)), (RDF + "object", o)):
                self.rows.append((None, None, reified[0], reified[1], q, *v))

    def node(self, e: ET.Element, base: str | None, lang: str | None) -> tuple:
        base, lang = e.get(_X + "base", base), e.get(_X + "lang", lang) or None
        self.rules(e, base, True)
        about, ident, label = e.get(_R + "about"), e.get(_R + "ID"), e.get(_R + "nodeID")
        s = self.ref(about, base) if about is not None else self.ref("#" + ident, base) if ident is not None else self.blank(label)
        if e.tag != _R + "Description":
            self.emit(s, TYPE, (IRI, _name(e.tag), None, None))
        for k, v in e.attrib.items():
            if k == _R + "type":
                self.emit(s, TYPE, self.ref(v, base))
            elif not k.startswith((_X, _R)) and k.startswith("{"):
                self.emit(s, _name(k), (LITERAL, v, LANG_STRING if lang else STRING, lang))
        self.entries(s, e, base, lang)
        return s

    def entries(self, s: tuple, e: ET.Element, base: str | None, lang: str | None) -> None:
        """Property elements; every rdf:li gets the next number."""
        n = 0
        for child in e:
            n += child.tag == _R + "li"
            self.entry(s, f"{RDF}_{n}" if child.tag == _R + "li" else _name(child.tag), child, base, lang)

    def entry(self, s: tuple, p: str, e: ET.Element, base: str | None, lang: str | None) -> None:
        base, lang = e.get(_X + "base", base), e.get(_X + "lang", lang) or None
        self.rules(e, base, False)
        kind, ident = e.get(_R + "parseType"), e.get(_R + "ID")
        reified = self.ref("#" + ident, base) if ident is not None else None
        extra = {k: v for k, v in e.attrib.items() if k.startswith("{") and not k.startswith(_X) and k not in {_R + x for x in ("resource", "nodeID", "ID", "parseType", "datatype")}}
        if kind == "Literal":
            inner = escape(e.text or "") + "".join(ET.canonicalize(ET.tostring(copy_of(c), encoding="unicode")) + escape(c.tail or "") for c in e)
            self.emit(s, p, (LITERAL, inner, RDF + "XMLLiteral", None), reified)
        elif kind == "Resource":
            o = self.blank()
            self.emit(s, p, o, reified)
            self.entries(o, e, base, lang)
        elif kind == "Collection":
            items = [self.node(c, base, lang) for c in e]
            nodes = [self.blank() for _ in items] + [(IRI, NIL, None, None)]
            self.emit(s, p, nodes[0], reified)
            for node, item, rest in zip(nodes, items, nodes[1:], strict=False):
                self.emit(node, FIRST, item)
                self.emit(node, REST, rest)
        elif len(e):
            self.emit(s, p, self.node(e[0], base, lang), reified)
        elif e.get(_R + "resource") is not None or e.get(_R + "nodeID") is not None or extra:
            o = self.ref(e.get(_R + "resource"), base) if e.get(_R + "resource") is not None else self.blank(e.get(_R + "nodeID"))
            self.emit(s, p, o, reified)
            for k, v in extra.items():
                self.emit(o, _name(k), self.ref(v, base) if k == _R + "type" else (LITERAL, v, LANG_STRING if lang else STRING, lang))
        else:
            dt = e.get(_R + "datatype")
            self.emit(s, p, (LITERAL, e.text or "", dt or (LANG_STRING if lang else STRING), None if dt else lang), reified)


def parse(text: str, doc: str = "doc", base: str | None = None, strict: bool = False) -> list[tuple]:
    """Triples of one document; raises ValueError where it is no RDF/XML."""
    if "<!ENTITY" in text and re.search(r"<!ENTITY\s[^>]*&", text):
        raise ValueError("an entity that is made of others")
    try:
        root = ET.fromstring(text)
    except ET.ParseError as fault:
        raise ValueError(str(fault)) from None
    level, depth = [root], 0
    while level:
        level, depth = [x for e in level for x in e], depth + 1
        if depth > DEPTH:
            raise ValueError(f"more than {DEPTH} elements within each other")
    reader = _Reader(doc, base, strict)
    if root.tag == _R + "RDF":
        for e in root:
            reader.node(e, root.get(_X + "base", base), root.get(_X + "lang"))
    else:
        reader.node(root, base, None)
    return reader.rows


def parse_documents(docs: DataFrame, base: str | None = None, mode: str = "FAILFAST", strict: bool = False) -> DataFrame:
    """Triples of documents (doc, text)."""
    from .nquads import checked

    schema = "g_kind byte, g string, s_kind byte, s string, p string, o_kind byte, o string, o_dt string, o_lang string, error string"

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for doc, text in zip(batch.doc, batch.text, strict=True):
                try:
                    rows = [(*r, None) for r in parse(text or "", doc, base, strict)]
                except ValueError as fault:
                    rows = [(None,) * 9 + (f"{doc}: {fault}",)]
                if rows:
                    yield pd.DataFrame(rows, columns=[*COLUMNS, "error"]).astype({c: "Int8" for c in ("g_kind", "s_kind", "o_kind")})

    return checked(docs.select("doc", "text").mapInPandas(run, schema), mode)


def read(spark: SparkSession, path: str, base: str | None = None, mode: str = "FAILFAST", strict: bool = False) -> DataFrame:
    files = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True).select(F.col("_metadata.file_path").alias("doc"), F.col("value").alias("text"))
    return parse_documents(files, base, mode, strict)


def _xml(text):
    for old, new in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("\r", "&#13;")):
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def descriptions(q: DataFrame) -> DataFrame:
    """(subject, text): an rdf:Description element per triple; a predicate must end in an XML name."""
    local = F.regexp_extract("p", r"([A-Za-z_][A-Za-z0-9_.-]*)$", 1)
    ns = F.substring("p", F.lit(1), F.length("p") - F.length(local))
    node = lambda k, v, iri: F.concat(F.when(F.col(k) == BLANK, F.concat(F.lit(' rdf:nodeID="'), F.regexp_replace(blank_label(F.col(v)), "^_:", ""))).otherwise(F.concat(F.lit(f' {iri}="'), _xml(F.col(v)))), F.lit('"'))
    open_tag = F.concat(F.lit("<p:"), local, F.lit(' xmlns:p="'), _xml(ns), F.lit('"'))
    attribute = F.when(F.col("o_lang").isNotNull(), F.concat(F.lit(' xml:lang="'), "o_lang", F.lit('"'))).when(F.col("o_dt") != STRING, F.concat(F.lit(' rdf:datatype="'), _xml(F.col("o_dt")), F.lit('"'))).otherwise("")
    body = F.when(F.col("o_kind") == LITERAL, F.concat(open_tag, attribute, F.lit(">"), _xml(F.col("o")), F.lit("</p:"), local, F.lit(">"))).otherwise(F.concat(open_tag, node("o_kind", "o", "rdf:resource"), F.lit("/>")))
    checked = F.when(local == "", F.raise_error(F.concat(F.lit("no XML name ends "), "p"))).otherwise(body)
    return q.select(F.concat(F.lit("<rdf:Description"), node("s_kind", "s", "rdf:about"), F.lit(">"), checked, F.lit("</rdf:Description>")).alias("text"))


def documents(q: DataFrame) -> DataFrame:
    """(doc, text): documents of at most some ``DOCUMENT_CHARS``, their elements in the order of subjects."""
    rows = descriptions(q.repartitionByRange("s", "p", "o").sortWithinPartitions("s", "p", "o"))

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, seq, held, parts = TaskContext.get().partitionId(), 0, 0, []

        def closed() -> pd.DataFrame:
            return pd.DataFrame({"doc": [f"part-{part:05d}-{seq:04d}"], "text": [f'<rdf:RDF xmlns:rdf="{RDF}">\n' + "\n".join(parts) + "\n</rdf:RDF>\n"]})

        for batch in batches:
            for text in batch.text:
                parts.append(text)
                held += len(text)
                if held > DOCUMENT_CHARS:
                    yield closed()
                    seq, held, parts = seq + 1, 0, []
        if parts:
            yield closed()

    return rows.mapInPandas(run, "doc string, text string")


def write(q: DataFrame, path: str) -> None:
    """A folder of files, one for each document: several in one file would be no XML."""
    docs = documents(q)
    docs.select("text", "doc").write.partitionBy("doc").text(path)


def can_parse(text: str) -> bool:
    return bool(re.match(r"\s*(<\?xml[^>]*>\s*)?(<!--.*?-->\s*|<!DOCTYPE[^>\[]*(\[.*?\])?>\s*)*<([A-Za-z]+:)?RDF\b", text[:8000], re.DOTALL))
