"""Jelly: a binary stream of length-delimited frames of triples, quads or graphs.

Names are written once and referred to by number, and a term that repeats is
left out, so a file is read from its start: files are the grain of parallelism.
A frame at a time is decoded and its quads are handed on; the writer turns each
partition into a file of frames of ``FRAME_ROWS`` statements.
"""

from __future__ import annotations

import struct
from collections import OrderedDict
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.terms import blank_label
from ..schema import BLANK, COLUMNS, IRI, LANG_STRING, LITERAL, STRING

#: Statements of a written frame, and entries of its tables of names, prefixes and datatypes.
FRAME_ROWS, NAMES, PREFIXES, DATATYPES = 256, 4000, 150, 32
# Field numbers of the format's messages.
ROW = {"options": 1, "triple": 2, "quad": 3, "graph_start": 4, "graph_end": 5, "namespace": 6, "name": 9, "prefix": 10, "datatype": 11}
KIND = {number: name for name, number in ROW.items()}
OPTIONS = {"name": 1, "physical": 2, "generalized": 3, "star": 4, "names": 9, "prefixes": 10, "datatypes": 11, "logical": 14, "version": 15}
PHYSICAL = {"triples": 1, "quads": 2, "graphs": 3}
VERSION = 1


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        if at >= len(data) or shift > 63:
            raise ValueError("jelly: a number is cut off")
        byte = data[at]
        at += 1
        value |= (byte & 0x7F) << shift
        if byte < 0x80:
            return value, at
        shift += 7


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a message."""
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        kind = tag & 7
        if kind == 0:
            value, at = _varint(data, at)
        elif kind in (1, 5):
            size = 8 if kind == 1 else 4
            value, at = data[at : at + size], at + size
        elif kind == 2:
            size, at = _varint(data, at)
            value, at = data[at : at + size], at + size
        else:
            raise ValueError(f"jelly: unknown wire type {kind}")
        if at > len(data):
            raise ValueError("jelly: a field is cut off")
        yield tag >> 3, value


def frames(data: bytes) -> Iterator[bytes]:
    """Frames of a file: delimited by their lengths, or the file is one frame."""
    if data[:1] == b"\n" and len(data) > 2 and data[2:3] == b"\n":  # a row in a row: the first frame is not delimited
        yield data
        return
    at = 0
    while at < len(data):
        size, at = _varint(data, at)
        if at + size > len(data):
            raise ValueError("jelly: a frame is cut off")
        yield data[at : at + size]
        at += size


class Decoder:
    """Tables and repeated terms of one stream."""

    def __init__(self, doc: str) -> None:
        self.doc, self.sizes, self.physical = doc, None, None
        self.tables: dict[str, dict[int, str]] = {"name": {}, "prefix": {}, "datatype": {}}
        self.last_entry = dict.fromkeys(self.tables, 0)
        self.last_name = self.last_prefix = 0
        self.terms: list[tuple | None] = [None] * 4
        self.graph: tuple = (None, None)

    def entry(self, table: str, data: bytes) -> None:
        found = dict(fields(data))
        number = found.get(1, 0) or self.last_entry[table] + 1
        if not 0 < number <= self.sizes[table]:
            raise ValueError(f"jelly: {table} {number} is outside its table")
        self.last_entry[table] = number
        self.tables[table][number] = found.get(2, b"").decode()

    def look_up(self, table: str, number: int) -> str:
        if number not in self.tables[table]:
            raise ValueError(f"jelly: {table} {number} is not there")
        return self.tables[table][number]

    def iri(self, data: bytes) -> tuple:
        found = dict(fields(data))
        self.last_prefix = found.get(1, 0) or self.last_prefix
        self.last_name = found.get(2, 0) or self.last_name + 1
        prefix = self.look_up("prefix", self.last_prefix) if self.last_prefix and self.sizes["prefix"] else ""
        return (IRI, prefix + self.look_up("name", self.last_name), None, None)

    def term(self, kind: int, value: int | bytes) -> tuple:
        """``kind``: 0 IRI, 1 blank node, 2 literal."""
        if kind == 0:
            return self.iri(value)
        if kind == 1:
            return (BLANK, f"{self.doc}|{value.decode()}", None, None)
        found = dict(fields(value))
        lex = found.get(1, b"").decode()
        if 2 in found:
            return (LITERAL, lex, LANG_STRING, found[2].decode())
        return (LITERAL, lex, self.look_up("datatype", found[3]) if found.get(3) else STRING, None)

    def statement(self, data: bytes, quad: bool) -> tuple:
        for number, value in fields(data):
            if number >= 13 if not quad else number > 16:
                raise ValueError(f"jelly: unknown field {number}")
            place, kind = divmod(number - 1, 4)
            if place == 3:
                self.terms[3] = (None, None, None, None) if kind == 2 else self.term(min(kind, 2), value)
            elif kind == 3:
                raise ValueError("jelly: quoted triples are no RDF 1.1")
            else:
                self.terms[place] = self.term(kind, value)
        s, p, o = self.terms[:3]
        if None in (s, p, o) or (quad and self.terms[3] is None):
            raise ValueError("jelly: the first statement lacks a term")
        g = self.terms[3] if quad else self.graph
        if s[0] == LITERAL or p[0] != IRI or g[0] == LITERAL:
            raise ValueError("jelly: generalized statements are no RDF 1.1")
        return (g[0], g[1], s[0], s[1], p[1], *o)

    def rows(self, frame: bytes) -> Iterator[tuple]:
        """Quads of a frame."""
        for number, row in fields(frame):
            if number != 1:
                continue
            for field, data in fields(row):
                kind = KIND.get(field)
                if kind == "options":
                    self.options(dict(fields(data)))
                elif self.sizes is None:
                    raise ValueError("jelly: a stream begins with its options")
                elif kind in self.tables:
                    self.entry(kind, data)
                elif kind in ("triple", "quad"):
                    if (kind == "quad") != (self.physical == PHYSICAL["quads"]):
                        raise ValueError(f"jelly: a {kind} in a stream of another kind")
                    yield self.statement(data, kind == "quad")
                elif kind == "graph_start":
                    field, value = next(fields(data))
                    self.graph = (None, None) if field == 3 else self.term(field - 1, value)[:2]
                elif kind == "graph_end":
                    self.graph = (None, None)

    def options(self, found: dict) -> None:
        sizes = {"name": found.get(OPTIONS["names"], 0), "prefix": found.get(OPTIONS["prefixes"], 0), "datatype": found.get(OPTIONS["datatypes"], 0)}
        if found.get(OPTIONS["version"], 0) > 2 or found.get(OPTIONS["generalized"]) or found.get(OPTIONS["star"]):
            raise ValueError("jelly: this version or kind of stream is not read")
        if found.get(OPTIONS["physical"]) not in PHYSICAL.values() or sizes["name"] < 8:
            raise ValueError("jelly: wrong options")
        if self.sizes not in (None, sizes):
            raise ValueError("jelly: the options change")
        self.sizes, self.physical = sizes, found[OPTIONS["physical"]]


def parse(data: bytes, doc: str = "doc") -> Iterator[list[tuple]]:
    """Quads of a file, a frame at a time; raises ValueError where it is none."""
    decoder = Decoder(doc)
    for frame in frames(data):
        yield list(decoder.rows(frame))


def parse_documents(docs: DataFrame, mode: str = "FAILFAST") -> DataFrame:
    """Quads of documents (doc, content)."""
    from .nquads import checked

    schema = "g_kind byte, g string, s_kind byte, s string, p string, o_kind byte, o string, o_dt string, o_lang string, error string"

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for doc, data in zip(batch.doc, batch.content, strict=True):
                try:
                    for rows in parse(data or b"", doc):
                        yield pd.DataFrame([(*r, None) for r in rows], columns=[*COLUMNS, "error"]).astype({c: "Int8" for c in ("g_kind", "s_kind", "o_kind")})
                except (ValueError, StopIteration, AttributeError, TypeError, struct.error) as fault:
                    yield pd.DataFrame([(None,) * 9 + (f"{doc}: {fault}",)], columns=[*COLUMNS, "error"]).astype({c: "Int8" for c in ("g_kind", "s_kind", "o_kind")})

    return checked(docs.select("doc", "content").mapInPandas(run, schema), mode)


def read(spark: SparkSession, path: str, mode: str = "FAILFAST") -> DataFrame:
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("doc"), "content")
    return parse_documents(files, mode)


def _number(value: int) -> bytes:
    out = bytearray()
    while value > 0x7F:
        out.append(value & 0x7F | 0x80)
        value >>= 7
    out.append(value)
    return bytes(out)


def _bytes(field: int, data: bytes) -> bytes:
    return _number(field << 3 | 2) + _number(len(data)) + data


def _int(field: int, value: int) -> bytes:
    return _number(field << 3) + _number(value) if value else b""


class _Table:
    """Numbers of the strings met last; the one not used for longest gives its number away."""

    def __init__(self, kind: str, size: int) -> None:
        self.kind, self.size, self.known, self.last = kind, size, OrderedDict(), 0

    def number(self, value: str, out: list[bytes]) -> int:
        found = self.known.get(value)
        if found is not None:
            self.known.move_to_end(value)
            return found
        found = len(self.known) + 1 if len(self.known) < self.size else self.known.popitem(last=False)[1]
        self.known[value] = found
        out.append(_bytes(ROW[self.kind], _int(1, 0 if found == self.last + 1 else found) + _bytes(2, value.encode())))
        self.last = found
        return found


class Encoder:
    """Frames of one file; rows are quads in which blank nodes have labels already."""

    def __init__(self, physical: str = "quads") -> None:
        self.physical = physical
        self.names, self.prefixes, self.datatypes = _Table("name", NAMES), _Table("prefix", PREFIXES), _Table("datatype", DATATYPES)
        self.last: list[tuple | None] = [None] * 4
        self.last_name = self.last_prefix = 0
        self.held: list[bytes] = [_bytes(ROW["options"], b"".join(_int(OPTIONS[k], v) for k, v in (("physical", PHYSICAL[physical]), ("names", NAMES), ("prefixes", PREFIXES), ("datatypes", DATATYPES), ("version", VERSION))))]
        self.statements, self.graph = 0, False

    def iri(self, value: str) -> bytes:
        cut = max(value.rfind("#"), value.rfind("/")) + 1
        prefix, name = self.prefixes.number(value[:cut], self.held), self.names.number(value[cut:], self.held)
        out = _int(1, 0 if prefix == self.last_prefix else prefix) + _int(2, 0 if name == self.last_name + 1 else name)
        self.last_prefix, self.last_name = prefix, name
        return out

    def term(self, first: int, term: tuple) -> bytes:
        kind, value, dt, lang = term
        if kind == IRI:
            return _bytes(first, self.iri(value))
        if kind == BLANK:
            return _bytes(first + 1, value.encode())
        tail = _bytes(2, lang.encode()) if lang is not None else _int(3, self.datatypes.number(dt, self.held)) if dt not in (None, STRING) else b""
        return _bytes(first + 2, _bytes(1, value.encode()) + tail)

    def add(self, g: tuple, s: tuple, p: tuple, o: tuple) -> bytes | None:
        """A frame, where this statement fills one."""
        if self.physical == "graphs" and self.graph != g:
            if self.graph is not False:
                self.held.append(_bytes(ROW["graph_end"], b""))
            name = self.term(1, g) if g[0] is not None else _bytes(3, b"")
            self.held.append(_bytes(ROW["graph_start"], name))
            self.graph = g
        body = b""
        for place, term in enumerate((s, p, o, g) if self.physical == "quads" else (s, p, o)):
            if term != self.last[place]:
                body += _bytes(15, b"") if place == 3 and term[0] is None else self.term(4 * place + 1, term)
                self.last[place] = term
        self.held.append(_bytes(ROW["quad" if self.physical == "quads" else "triple"], body))
        self.statements += 1
        return self.frame() if self.statements >= FRAME_ROWS else None

    def frame(self) -> bytes:
        data = b"".join(_bytes(1, row) for row in self.held)
        self.held, self.statements = [], 0
        return _number(len(data)) + data

    def end(self) -> bytes:
        if self.physical == "graphs" and self.graph is not False:
            self.held.append(_bytes(ROW["graph_end"], b""))
        return self.frame() if self.held else b""


def documents(q: DataFrame, physical: str = "quads", partitions: int | None = None) -> DataFrame:
    """(doc, content): a file per partition, in the order of graphs and subjects; ``physical``: triples, quads or graphs.

    ``triples`` needs a single graph, and is an error where a quad names one.
    """
    if physical not in PHYSICAL:
        raise ValueError(f"unknown kind of stream: {physical}")
    keys = ["g_kind", "g", "s_kind", "s", "p"]
    dealt = q.select(*COLUMNS).repartitionByRange(partitions, *keys) if partitions else q.select(*COLUMNS).repartitionByRange(*keys)
    labelled = lambda c: F.when(F.col(f"{c}_kind") == BLANK, F.substring(blank_label(F.col(c)), F.lit(3), F.lit(64))).otherwise(F.col(c)).alias(c)
    g = F.when(F.lit(physical == "triples") & F.col("g").isNotNull(), F.raise_error("a stream of triples has no graphs")).otherwise(labelled("g")).alias("g")
    rows = dealt.sortWithinPartitions(*keys).select(F.coalesce("g_kind", F.lit(-1)).cast("int").alias("g_kind"), g, "s_kind", labelled("s"), "p", "o_kind", labelled("o"), "o_dt", "o_lang")

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, seq, encoder, out = TaskContext.get().partitionId(), 0, Encoder(physical), []

        def closed() -> pd.DataFrame:
            return pd.DataFrame({"doc": [f"part-{part:05d}-{seq:04d}"], "content": [b"".join([*out, encoder.end()])]})

        size = 0
        for batch in batches:
            for gk, g, sk, s, p, ok, o, dt, lang in batch.itertuples(index=False, name=None):
                frame = encoder.add((None, None, None, None) if gk < 0 else (gk, g, None, None), (sk, s, None, None), (IRI, p, None, None), (ok, o, dt, lang))
                if frame:
                    out.append(frame)
                    size += len(frame)
                    if size > 1 << 26:  # a cell stays well below what a row may hold
                        yield closed()
                        seq, encoder, out, size = seq + 1, Encoder(physical), [], 0
        if out or encoder.statements:
            yield closed()

    return rows.mapInPandas(run, "doc string, content binary")


def write(q: DataFrame, path: str, physical: str = "quads", partitions: int | None = None) -> None:
    """A folder of Parquet rows (doc, content), a file of the format in each row: Spark has no sink for bare bytes."""
    documents(q, physical, partitions).write.parquet(path)


def read_written(spark: SparkSession, path: str, mode: str = "FAILFAST") -> DataFrame:
    return parse_documents(spark.read.parquet(path), mode)


def can_parse(data: bytes) -> bool:
    """Whether the first frame parses and has rows."""
    try:
        frame = next(frames(data))
        decoder = Decoder("doc")
        next(decoder.rows(frame), None)
        return decoder.sizes is not None
    except (ValueError, StopIteration, AttributeError, TypeError):
        return False
