"""Formats by content type, and detection from the head of a document."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import jelly, jsonld, nquads, rdfxml, turtle


@dataclass(frozen=True)
class Format:
    """A format: its content types, reader and writer, and a test on a document's head."""

    name: str
    types: tuple[str, ...]
    read: Callable[..., DataFrame]
    write: Callable[..., None]
    looks: Callable[[str], bool]


def _lines_look(text: str) -> bool:
    lines = [x.strip() for x in text.splitlines()]
    lines = [x for x in lines if x and not x.startswith("#")]
    good = [x.startswith(("<", "_:")) and x.endswith(".") and len(x.split()) >= 3 for x in lines]
    return bool(good) and sum(good) > 0.8 * len(good)


FORMATS: dict[str, Format] = {}


def register(fmt: Format) -> None:
    for kind in fmt.types:
        FORMATS[kind.lower()] = fmt


for _f in (
    Format("nquads", ("application/n-quads",), nquads.read, nquads.write, _lines_look),
    Format("ntriples", ("application/n-triples",), lambda spark, path, **o: nquads.read(spark, path, graphs=False, **o), nquads.write, _lines_look),
    Format("turtle", ("text/turtle", "application/x-turtle", "application/turtle", "text/n3", "text/rdf+n3", "application/rdf+n3"), lambda spark, path, **o: turtle.read(spark, path, graphs=False, **o), turtle.write, turtle.can_parse),
    Format("trig", ("application/trig", "application/x-trig"), turtle.read, turtle.write, turtle.can_parse),
    Format("jsonld", ("application/ld+json", "application/json+ld"), jsonld.read, jsonld.write, jsonld.can_parse),
    Format("rdfxml", ("application/rdf+xml", "application/xml", "text/xml"), rdfxml.read, rdfxml.write, rdfxml.can_parse),
    Format("jelly", ("application/x-jelly-rdf",), jelly.read, jelly.write, lambda text: False),
):
    register(_f)


def content_types() -> list[str]:
    return sorted(FORMATS)


def supports(content_type: str) -> bool:
    return content_type.split(";")[0].strip().lower() in FORMATS


def format_of(content_type: str) -> Format:
    found = FORMATS.get(content_type.split(";")[0].strip().lower())
    if found is None:
        raise ValueError(f"no format for {content_type}; known: {', '.join(content_types())}")
    return found


def detect(spark: SparkSession, path: str) -> Format:
    """The format of the first file, from its first bytes or characters."""
    head = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(F.substring("content", 1, 1 << 20)).first()
    if head and jelly.can_parse(bytes(head[0])):
        return FORMATS["application/x-jelly-rdf"]
    head = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True).select(F.substring("value", 1, 8000)).first()
    text = head[0] if head else ""
    for name in ("application/rdf+xml", "application/ld+json", "application/n-quads", "text/turtle", "application/trig"):
        if FORMATS[name].looks(text):
            return FORMATS["application/trig"] if name == "text/turtle" else FORMATS[name]
    raise ValueError(f"no known format: {path}")


def read_rdf(spark: SparkSession, path: str, content_type: str | None = None, **options) -> DataFrame:
    """Quads of files in the format named, or in the one detected."""
    return (format_of(content_type) if content_type else detect(spark, path)).read(spark, path, **options)


def write_rdf(q: DataFrame, path: str, content_type: str, **options) -> None:
    format_of(content_type).write(q, path, **options)
