"""Named graphs over a quad table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import COLUMNS, GRAPH, IRI
from .graph import differences


def in_graph(triples: DataFrame, name: str | None, kind: int = IRI) -> DataFrame:
    """The triples as quads of one graph (None: the default graph)."""
    return triples.withColumn("g_kind", F.lit(kind if name is not None else None).cast("byte")).withColumn("g", F.lit(name).cast("string")).select(*COLUMNS)


def graph(q: DataFrame, name: str | None) -> DataFrame:
    return q.where(F.col("g").isNull() if name is None else F.col("g") == name)


def graph_names(q: DataFrame, empty: DataFrame | None = None) -> DataFrame:
    """Names of the named graphs; ``empty`` adds graphs without a quad."""
    names = q.where("g is not null").select(*GRAPH)
    return (names.unionByName(empty) if empty is not None else names).distinct()


def contains_graph(q: DataFrame, name: str) -> bool:
    return not graph(q, name).limit(1).isEmpty()


def named_graphs(q: DataFrame) -> DataFrame:
    """(g_kind, g, triples): every named graph with its number of triples; ``graph`` gives its rows."""
    return q.where("g is not null").groupBy(*GRAPH).agg(F.count("*").alias("triples"))


def cross_graph_objects(q: DataFrame) -> DataFrame:
    """(o, graphs): IRIs that are objects in several graphs."""
    return q.where(F.col("o_kind") == IRI).groupBy("o").agg(F.countDistinct(F.coalesce("g", F.lit(""))).alias("graphs")).where("graphs > 1")


def collapse(q: DataFrame, handling: str = "strict") -> DataFrame:
    """One graph of a dataset: ``strict`` (raises on named graphs), ``ignore`` or ``merge`` (keeps duplicates)."""
    if handling == "strict" and not q.where("g is not null").limit(1).isEmpty():
        raise ValueError("the dataset has named graphs")
    if handling not in ("strict", "ignore", "merge"):
        raise ValueError(f"unknown handling: {handling}")
    kept = q if handling == "merge" else q.where("g is null")
    return in_graph(kept, None)


def from_graphs(parts: DataFrame, sequence: str) -> DataFrame:
    """Quads of named graphs given several times: the last one of each name wins whole.

    The last sequence number of a name is an aggregate, so a graph of any size
    is never one task's work.
    """
    last = parts.groupBy("g").agg(F.max(sequence).alias("_last"))
    return parts.join(last, "g").where(F.col(sequence) == F.col("_last")).select(*COLUMNS)


def same_dataset(a: DataFrame, b: DataFrame) -> bool:
    return differences(a, b).isEmpty()
