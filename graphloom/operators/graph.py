"""Operators on one graph: scans, projections and set algebra over a quad table.

A graph is a bag: only the operators that say so remove duplicates.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import BLANK, COLUMNS, IRI, LITERAL, OBJECT, STRING, SUBJECT

#: Values of an ``In`` set up to which it is a filter that reaches the scan; beyond, a semi-join.
IN_FILTER = 10_000


class Literal(tuple):
    """A literal term: value, datatype, language."""

    def __new__(cls, value: str, datatype: str = STRING, language: str | None = None) -> Literal:
        return super().__new__(cls, (value, datatype, language))


class Blank(str):
    """A blank node by its scoped value."""


def _is(term: str | Literal, kind: str, value: str) -> Column:
    if isinstance(term, Literal):
        test = (F.col("o_kind") == LITERAL) & (F.col("o") == term[0]) & (F.col("o_dt") == term[1])
        return test & (F.col("o_lang").isNull() if term[2] is None else F.coalesce(F.col("o_lang") == term[2], F.lit(False)))
    return (F.col(kind) == (BLANK if isinstance(term, Blank) else IRI)) & (F.col(value) == term)


def _any(terms: list, kind: str, value: str) -> Column:
    """One of the terms; plain IRIs become an IN list that the scan can use."""
    iris = [t for t in terms if not isinstance(t, Literal | Blank)]
    tests = [_is(t, kind, value) for t in terms if isinstance(t, Literal | Blank)]
    if iris:
        tests.append((F.col(kind) == IRI) & F.col(value).isin(iris))
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def match(q: DataFrame, s=None, p=None, o=None, s_in: Iterable | None = None, p_in: Iterable | None = None, o_in: Iterable | None = None) -> DataFrame:
    """Triples that match all positions; duplicates stay.

    Within a position the single term and the set are united; nothing given
    matches all, an empty set matches nothing.
    """
    for one, many, kind, value in ((s, s_in, "s_kind", "s"), (o, o_in, "o_kind", "o")):
        if one is None and many is None:
            continue
        terms = ([one] if one is not None else []) + list(many or [])
        plain = [t for t in terms if not isinstance(t, Literal | Blank)]
        if len(plain) > IN_FILTER and len(plain) == len(terms):
            wanted = q.sparkSession.createDataFrame([(t,) for t in set(plain)], "wanted string")
            q = q.where(F.col(kind) == IRI).join(wanted, F.col(value) == F.col("wanted"), "left_semi")
        else:
            q = q.where(_any(terms, kind, value))
    if p is not None or p_in is not None:
        names = ([p] if p is not None else []) + list(p_in or [])
        q = q.where(F.col("p").isin(names) if names else F.lit(False))
    return q


def exists(q: DataFrame, **pattern) -> bool:
    return not match(q, **pattern).limit(1).isEmpty()


def objects_of(q: DataFrame, s, p) -> DataFrame:
    return match(q, s=s, p=p).select(*OBJECT)


def subjects_of(q: DataFrame, p, o) -> DataFrame:
    return match(q, p=p, o=o).select(*SUBJECT)


def subjects(q: DataFrame) -> DataFrame:
    return q.select(*SUBJECT).distinct()


def predicates(q: DataFrame) -> DataFrame:
    return q.select("p").distinct()


def objects(q: DataFrame) -> DataFrame:
    return q.select(*OBJECT).distinct()


def add(q: DataFrame, more: DataFrame, dedup: bool = True) -> DataFrame:
    """Union; by default without duplicates, also those that were there before."""
    both = q.unionByName(more)
    return both.distinct() if dedup else both


merge = add


def remove(q: DataFrame, gone: DataFrame) -> DataFrame:
    """Set difference; duplicates of what stays are removed as well."""
    return q.select(*COLUMNS).subtract(gone.select(*COLUMNS))


def remove_matching(q: DataFrame, s=None, p=None, o=None) -> DataFrame:
    """Drop what matches any given position (or, not and); without any, nothing goes."""
    tests = [_any([t], k, v) for t, k, v in ((s, "s_kind", "s"), (o, "o_kind", "o")) if t is not None]
    tests += [F.col("p") == p] if p is not None else []
    return q.where(~reduce(lambda a, b: a | b, tests)) if tests else q


def same_graph(a: DataFrame, b: DataFrame) -> bool:
    """Equal as sets of triples."""
    return differences(a, b).isEmpty()


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows on one side only, with ``side``: one shuffle, whatever the sizes."""
    sides = a.select(*COLUMNS).withColumn("side", F.lit(1)).unionAll(b.select(*COLUMNS).withColumn("side", F.lit(2)))
    return sides.groupBy(*COLUMNS).agg(F.min("side").alias("lo"), F.max("side").alias("hi")).where("lo = hi").withColumnRenamed("lo", "side").drop("hi")


def size(q: DataFrame) -> DataFrame:
    """One row: the number of triples, duplicates counted."""
    return q.agg(F.count("*").alias("size"))


def graph_hash(q: DataFrame) -> DataFrame:
    """One row: an order-free hash of the set of triples."""
    return q.select(*COLUMNS).distinct().agg(F.bit_xor(F.xxhash64(*COLUMNS)).alias("hash"), F.count("*").alias("size"))
