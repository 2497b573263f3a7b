"""JSON-LD: documents to quads, and quads to node objects, one line each.

Reading follows the to-RDF rules for contexts given inline or preloaded by the
caller (tasks never fetch anything): term definitions with @id, @type,
@container, @language and @reverse, @vocab, @base, keyword aliases, @graph,
@included, @list, @set, language, index, id and type maps, native numbers and
booleans, @json.  Each document is one unit; files of one document per line are
split like any text.  Writing is plain expressions: a line per quad, or a node
object per subject with lists and single-use blank nodes in place.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.iri import resolve_one
from ..functions.terms import blank_label
from ..operators.nesting import entry, nest
from ..schema import BLANK, BOOLEAN, COLUMNS, DOUBLE, FIRST, INTEGER, IRI, LANG_STRING, LITERAL, NIL, RDF, REST, STRING, TYPE
from ..storage import written

#: Values after which a subject is given in several objects.
OBJECT_VALUES = 2000
#: Objects and arrays that may stand within each other; more are a fault of the document, on every machine.
DEPTH = 100
_ABSOLUTE = re.compile(r"^[a-zA-Z][a-zA-Z0-9+.-]*:")
_KEYWORDS = frozenset(f"@{k}" for k in "base container context graph id included index json language list nest none reverse set type value version vocab direction import prefix propagate protected".split())


class _Context:
    def __init__(self, base: str | None) -> None:
        self.base, self.vocab, self.language, self.terms = base, None, None, {}

    def extended(self, local, loaded: dict) -> _Context:
        out = _Context(self.base)
        out.vocab, out.language, out.terms = self.vocab, self.language, dict(self.terms)
        for part in local if isinstance(local, list) else [local]:
            if part is None:
                out = _Context(self.base)
                continue
            if isinstance(part, str):
                if part not in loaded:
                    raise ValueError(f"context {part} is not preloaded")
                out = out.extended(loaded[part].get("@context", {}), loaded)
                continue
            if "@base" in part:
                out.base = part["@base"] and (resolve_one(part["@base"], out.base) if out.base else part["@base"])
            if "@language" in part:
                out.language = part["@language"]
            out.terms |= {k: v for k, v in part.items() if not k.startswith("@")}
            if "@vocab" in part:
                out.vocab = part["@vocab"] if part["@vocab"] in (None, "") or ":" in part["@vocab"] else out.iri(part["@vocab"], True)
        return out

    def definition(self, term: str) -> dict:
        found = self.terms.get(term)
        return found if isinstance(found, dict) else {}

    def keyword(self, key: str) -> str:
        """The keyword a key stands for, or the key itself."""
        if key in _KEYWORDS:
            return key
        found = self.terms.get(key)
        name = found.get("@id") if isinstance(found, dict) else found
        return name if isinstance(name, str) and name in _KEYWORDS else key

    def iri(self, value: str, vocab: bool, seen: tuple = ()) -> str | None:
        """The IRI or blank label of a name; None where it has none."""
        if value in _KEYWORDS:
            return value
        if vocab and value in self.terms and value not in seen:
            found = self.terms[value]
            name = found.get("@id", found.get("@reverse")) if isinstance(found, dict) else found
            if name is not None:
                return self.iri(name, True, (*seen, value))
            if found is None or (isinstance(found, dict) and "@id" in found):
                return None
        if ":" in value:
            prefix, _, rest = value.partition(":")
            if prefix == "_" or rest.startswith("//"):
                return value
            if prefix in self.terms and prefix not in seen:
                return (self.iri(prefix, True, seen) or "") + rest
            return value
        if vocab:
            return self.vocab + value if self.vocab is not None else None
        return resolve_one(value, self.base) if self.base else value


class _Document:
    def __init__(self, doc: str, base: str | None, loaded: dict, direction: str | None = None) -> None:
        self.doc, self.loaded, self.rows, self.made, self.direction = doc, loaded, {}, 0, direction
        self.start = _Context(base)

    def blank(self, label: str | None = None) -> tuple:
        self.made += label is None
        return (BLANK, f"{self.doc}|{label if label is not None else f'.{self.made}'}", None, None)

    def node_term(self, name: str | None) -> tuple | None:
        if name is None:
            return None
        if name.startswith("_:"):
            return self.blank(name[2:])
        return (IRI, name, None, None) if _ABSOLUTE.match(name) and " " not in name else None

    def emit(self, g, s, p: str, o) -> None:
        if s and o and _ABSOLUTE.match(p):
            self.rows[((g or (None, None))[0], (g or (None, None))[1], s[0], s[1], p, *o)] = None

    def literal(self, ctx: _Context, value, datatype: str | None, language: str | None) -> tuple | None:
        if datatype == "@json":
            return (LITERAL, json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False), RDF + "JSON", None)
        if isinstance(value, bool):
            return (LITERAL, "true" if value else "false", datatype or BOOLEAN, None)
        if isinstance(value, int | float):
            whole = float(value).is_integer() and abs(value) < 1e21
            if whole and datatype != DOUBLE:
                return (LITERAL, str(int(value)), datatype or INTEGER, None)
            if not math.isfinite(value):
                return None
            mantissa, _, exponent = f"{float(value):.15E}".partition("E")
            mantissa = mantissa.rstrip("0")
            return (LITERAL, f"{mantissa}{'0' if mantissa.endswith('.') else ''}E{int(exponent)}", datatype or DOUBLE, None)
        if isinstance(value, str):
            return (LITERAL, value, LANG_STRING, language) if language and not datatype else (LITERAL, value, datatype or STRING, None)
        return None

    def values(self, ctx: _Context, g, value, term: dict, listed: bool = False) -> Iterator[tuple]:
        """The terms that a property's value stands for."""
        if value is None:
            return
        if isinstance(value, list):
            for item in value:
                yield from self.values(ctx, g, item, term)
            return
        kind = term.get("@type")
        if isinstance(value, dict) and kind != "@json":
            keys = {ctx.keyword(k): k for k in value}
            if "@context" in keys and "@value" not in keys:
                yield self.node(ctx, g, value)
            elif "@value" in keys:
                dt = value.get(keys.get("@type"))
                if self.direction and dt is None and isinstance(value[keys["@value"]], str) and value.get(keys.get("@direction")) in ("ltr", "rtl"):
                    yield self.directed(g, value[keys["@value"]], value.get(keys.get("@language")), value[keys["@direction"]])
                    return
                found = self.literal(ctx, value[keys["@value"]], dt if dt == "@json" or dt is None else ctx.iri(dt, True), value.get(keys.get("@language")))
                if found:
                    yield found
            elif "@list" in keys:
                yield self.list_of(ctx, g, value[keys["@list"]], term)
            elif "@set" in keys:
                yield from self.values(ctx, g, value[keys["@set"]], term)
            else:
                yield self.node(ctx, g, value)
            return
        if kind in ("@id", "@vocab") and isinstance(value, str):
            found = self.node_term(ctx.iri(value, kind == "@vocab") or (ctx.iri(value, False) if kind == "@vocab" else None))
        else:
            language = term["@language"] if "@language" in term else ctx.language
            found = self.literal(ctx, value, None if kind in (None, "@none", "@id", "@vocab") else kind if kind == "@json" else ctx.iri(kind, True), language)
        if found:
            yield found

    def directed(self, g, text: str, language: str | None, direction: str) -> tuple:
        """A string with a base direction: a datatype that names both, or a node of its own."""
        if self.direction == "i18n-datatype":
            return (LITERAL, text, f"https://www.w3.org/ns/i18n#{(language or '').lower()}_{direction}", None)
        node = self.blank()
        for p, value in (("value", text), ("language", language and language.lower()), ("direction", direction)):
            if value is not None:
                self.emit(g, node, RDF + p, (LITERAL, value, STRING, None))
        return node

    def list_of(self, ctx: _Context, g, items, term: dict) -> tuple:
        found = []
        for item in items if isinstance(items, list) else [items]:
            found += [self.list_of(ctx, g, item, term)] if isinstance(item, list) else list(self.values(ctx, g, item, term))
        nodes = [self.blank() for _ in found] + [(IRI, NIL, None, None)]
        for node, item, rest in zip(nodes, found, nodes[1:], strict=False):
            self.emit(g, node, FIRST, item)
            self.emit(g, node, REST, rest)
        return nodes[0]

    def property_values(self, ctx: _Context, g, value, term: dict) -> Iterator[tuple]:
        containers = term.get("@container", [])
        containers = containers if isinstance(containers, list) else [containers]
        if "@list" in containers and not (isinstance(value, dict) and "@list" in value):
            if value is not None:
                yield self.list_of(ctx, g, value, term)
        elif "@language" in containers and isinstance(value, dict):
            for tag, texts in value.items():
                for text in texts if isinstance(texts, list) else [texts]:
                    if text is not None:
                        yield (LITERAL, text, STRING, None) if ctx.keyword(tag) == "@none" else (LITERAL, text, LANG_STRING, tag)
        elif "@graph" in containers:
            for part in value if isinstance(value, list) else [value]:
                name = self.blank()
                self.nodes(ctx, name[:2], part)
                yield name
        elif any(c in containers for c in ("@index", "@id", "@type")) and isinstance(value, dict):
            for key, items in value.items():
                for item in items if isinstance(items, list) else [items]:
                    if isinstance(item, dict) and ctx.keyword(key) != "@none":
                        item = {**item, "@id": key} if "@id" in containers and "@id" not in item else {**item, "@type": [key, *(item["@type"] if isinstance(item.get("@type"), list) else [item["@type"]] if "@type" in item else [])]} if "@type" in containers else item
                    elif isinstance(item, str) and "@type" in containers:
                        item = {"@id": item, "@type": key}
                    yield from self.values(ctx, g, item, term)
        else:
            yield from self.values(ctx, g, value, term)

    def nodes(self, ctx: _Context, g, value) -> None:
        for part in value if isinstance(value, list) else [value]:
            if isinstance(part, dict):
                if not {"@value", "@list", "@set"} & {ctx.keyword(k) for k in part}:
                    self.node(ctx, g, part)
                elif "@set" in part:
                    self.nodes(ctx, g, part["@set"])

    def node(self, ctx: _Context, g, obj: dict) -> tuple | None:
        """The node's term; its triples are emitted."""
        if "@context" in obj:
            ctx = ctx.extended(obj["@context"], self.loaded)
        keys = {}
        for k in obj:
            keys.setdefault(ctx.keyword(k), k)
        types = obj.get(keys.get("@type"), [])
        types = types if isinstance(types, list) else [types]
        outer = ctx
        for t in sorted(x for x in types if isinstance(x, str)):
            if "@context" in ctx.definition(t):
                ctx = ctx.extended(ctx.definition(t)["@context"], self.loaded)
        name = obj.get(keys.get("@id"))
        subject = self.node_term(outer.iri(name, False)) if isinstance(name, str) else self.blank()
        for t in types:
            found = self.node_term(outer.iri(t, True) or outer.iri(t, False))
            self.emit(g, subject, TYPE, found)
        self.entries(ctx, g, subject, obj, bool(name) or any(not ctx.keyword(k).startswith("@") for k in obj))
        return subject

    def entries(self, ctx: _Context, g, subject, obj: dict, named: bool) -> None:
        for key, value in obj.items():
            word = ctx.keyword(key)
            if word == "@graph":
                self.nodes(ctx, subject[:2] if named and subject else g, value)
            elif word == "@included":
                self.nodes(ctx, g, value)
            elif word == "@nest":
                for part in value if isinstance(value, list) else [value]:
                    self.entries(ctx, g, subject, part, named)
            elif word == "@reverse":
                for name, items in value.items():
                    for o in self.values(ctx, g, items, {"@type": "@id"}):
                        self.emit(g, o if o[0] != LITERAL else None, ctx.iri(name, True) or "", subject)
            elif not word.startswith("@"):
                term = ctx.definition(key)
                inner = ctx.extended(term["@context"], self.loaded) if "@context" in term else ctx
                p = ctx.iri(key, True)
                if p is None:
                    continue
                for o in self.property_values(inner, g, value, term):
                    if "@reverse" in term:
                        self.emit(g, o if o and o[0] != LITERAL else None, p, subject)
                    else:
                        self.emit(g, subject, p, o)


def parse(text: str, doc: str = "doc", base: str | None = None, contexts: dict | None = None, direction: str | None = None) -> list[tuple]:
    """Distinct quad rows of one document, or of one per line; raises ValueError where it is none.

    ``direction``: None, ``i18n-datatype`` or ``compound-literal``.
    """
    if direction not in (None, "i18n-datatype", "compound-literal"):
        raise ValueError(f"unknown direction: {direction}")
    try:
        try:
            values = [json.loads(text)]
        except json.JSONDecodeError:  # one document per line, as written here
            values = [json.loads(line) for line in text.splitlines() if line.strip()]
    except RecursionError:  # far deeper than DEPTH
        raise ValueError(f"more than {DEPTH} values within each other") from None
    level, depth = values, 0
    while level:
        level, depth = [x for v in level for x in (v.values() if isinstance(v, dict) else v if isinstance(v, list) else ())], depth + 1
        if depth > DEPTH:
            raise ValueError(f"more than {DEPTH} values within each other")
    value = values[0] if len(values) == 1 else [part for v in values for part in (v if isinstance(v, list) else [v])]
    if not isinstance(value, dict | list):
        raise ValueError("a document is an object or an array of objects")
    found = _Document(doc, base, contexts or {}, direction)
    found.nodes(found.start, None, value)
    return list(found.rows)


def parse_documents(docs: DataFrame, base: str | None = None, contexts: dict | None = None, mode: str = "FAILFAST", direction: str | None = None) -> DataFrame:
    """Quads of documents (doc, text)."""
    from .nquads import checked

    schema = "g_kind byte, g string, s_kind byte, s string, p string, o_kind byte, o string, o_dt string, o_lang string, error string"

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc, text in zip(batch.doc, batch.text, strict=True):
                try:
                    rows += [(*r, None) for r in parse(text or "", doc, base, contexts, direction)]
                except (ValueError, TypeError, AttributeError) as fault:
                    rows.append((None,) * 9 + (f"{doc}: {fault}",))
            if rows:
                yield pd.DataFrame(rows, columns=[*COLUMNS, "error"]).astype({c: "Int8" for c in ("g_kind", "s_kind", "o_kind")})

    return checked(docs.select("doc", "text").mapInPandas(run, schema), mode)


def read(spark: SparkSession, path: str, lines: bool = False, base: str | None = None, contexts: dict | None = None, mode: str = "FAILFAST") -> DataFrame:
    """Files of one document each, or with ``lines`` of one document per line."""
    files = spark.read.text(path, wholetext=not lines).select(F.col("_metadata.file_path").alias("doc"), F.col("value").alias("text"))
    return parse_documents(files, base, contexts, mode)


def _quoted(text: Column) -> Column:
    """The text as a JSON string."""
    array = F.to_json(F.array(text))
    return F.substring(array, F.lit(2), F.length(array) - 2)


def _ref(kind: str, value: str) -> Column:
    return F.when(F.col(kind) == BLANK, blank_label(F.col(value))).otherwise(F.col(value))


def _value(native: bool = False, classes: bool = True) -> Column:
    """The object as a value object, a reference, or, with ``classes`` where it is one, a bare name."""
    plain = F.lit(False)
    if native:
        plain = ((F.col("o_dt") == INTEGER) & F.col("o").rlike(r"^-?(0|[1-9]\d{0,14})$")) | ((F.col("o_dt") == BOOLEAN) & F.col("o").isin("true", "false"))
    value = F.when(plain, F.concat(F.lit('{"@value":'), "o", F.lit("}"))).when(F.col("o_lang").isNotNull(), F.concat(F.lit('{"@value":'), _quoted(F.col("o")), F.lit(',"@language":'), _quoted(F.col("o_lang")), F.lit("}")))
    value = value.when(F.col("o_dt").isNull() | (F.col("o_dt") == STRING), F.concat(F.lit('{"@value":'), _quoted(F.col("o")), F.lit("}"))).otherwise(F.concat(F.lit('{"@value":'), _quoted(F.col("o")), F.lit(',"@type":'), _quoted(F.col("o_dt")), F.lit("}")))
    name = _quoted(_ref("o_kind", "o"))
    found = F.when(F.col("o_kind") == LITERAL, value)
    return (found.when(F.col("p") == TYPE, name) if classes else found).otherwise(F.concat(F.lit('{"@id":'), name, F.lit("}")))


def _key() -> Column:
    return F.when((F.col("p") == TYPE) & (F.col("o_kind") != LITERAL), F.lit('"@type"')).otherwise(_quoted(F.col("p")))


def _in_graph(node: Column) -> Column:
    return F.when(F.col("g").isNull(), node).otherwise(F.concat(F.lit('{"@id":'), _quoted(_ref("g_kind", "g")), F.lit(',"@graph":['), node, F.lit("]}")))


def documents(q: DataFrame, native: bool = False) -> DataFrame:
    """(text): expanded node objects, one per quad; ``native`` writes valid numbers and booleans as such."""
    node = F.concat(F.lit('{"@id":'), _quoted(_ref("s_kind", "s")), F.lit(","), _key(), F.lit(":["), _value(native), F.lit("]}"))
    return q.select(_in_graph(node).alias("text"))


def _members(entries: Column) -> Column:
    """Members of an object from sorted entries: each name once, with all its values."""
    names = F.array_distinct(F.transform(entries, lambda e: e["name"]))
    values = lambda name: F.transform(F.filter(entries, lambda e: e["name"] == name), lambda e: e["text"])
    return F.array_join(F.transform(names, lambda name: F.concat(name, F.lit(":["), F.array_join(values(name), ","), F.lit("]"))), ",")


def node_objects(q: DataFrame, native: bool = False, nested: bool = True) -> DataFrame:
    """(g_kind, g, s_kind, s, text): an expanded node object for every subject of every graph, lists and single-use blank nodes in place.

    Members are ordered: @id, @type, then predicates and their values by code
    point.  A subject with more than ``OBJECT_VALUES`` values is given in
    several objects that share its @id, dealt by a hash of the value, so no
    subject is one task's work.
    """
    rows = q.select(*COLUMNS, F.when((F.col("o_kind") == IRI) & (F.col("o") == NIL) & (F.col("p") != TYPE), '{"@list":[]}').otherwise(_value(native)).alias("text")).distinct()
    if nested:
        item = F.when((F.col("o_kind") == IRI) & (F.col("o") == NIL), '{"@list":[]}').otherwise(_value(native, classes=False))
        rows = nest(rows, item, _key(), lambda items: F.concat(F.lit('{"@list":['), F.array_join(items, ","), F.lit("]}")), lambda entries: F.concat(F.lit("{"), _members(entries), F.lit("}")), types=False)
    keys = ["g_kind", "g", "s_kind", "s"]
    large = written(rows.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > OBJECT_VALUES), "objects-large")
    large = large.select(*[F.col(k).alias("_" + k) for k in keys], F.ceil(F.col("n") / OBJECT_VALUES).cast("long").alias("_parts"))
    if not large.isEmpty():
        rows = rows.join(large, [F.col(k).eqNullSafe(F.col("_" + k)) for k in keys], "left")
        part = F.pmod(F.xxhash64("p", "text"), F.coalesce("_parts", F.lit(1).cast("long")))
    else:
        part = F.lit(0).cast("long")
    entries = F.sort_array(F.collect_list(entry(_key()))).alias("entries")
    found = rows.withColumn("_part", part).groupBy(*keys, "_part").agg(entries)
    node = F.concat(F.lit('{"@id":'), _quoted(_ref("s_kind", "s")), F.lit(","), _members(F.col("entries")), F.lit("}"))
    return found.select(*keys, _in_graph(node).alias("text"))


def write(q: DataFrame, path: str, native: bool = False, objects: bool = False) -> None:
    """A node object per line: one per quad, or with ``objects`` one per subject."""
    (node_objects(q, native).select("text") if objects else documents(q, native)).write.text(path)


def can_parse(text: str) -> bool:
    head = text.lstrip()
    return head[:1] in ("{", "[") and any(f'"@{k}"' in head for k in ("context", "id", "graph", "type"))
