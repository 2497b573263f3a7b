"""Graph statistics in one pass of distinct counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import BLANK, IRI, LITERAL


def prefix_of(iri: Column) -> Column:
    """Up to the last ``#``, else the last ``/``, else the whole."""
    return F.when(iri.contains("#"), F.regexp_extract(iri, "^(.*#)", 1)).when(iri.contains("/"), F.regexp_extract(iri, "^(.*/)", 1)).otherwise(iri)


def _iris(q: DataFrame, datatypes: bool = True) -> DataFrame:
    every = [F.when(F.col("s_kind") == IRI, F.col("s")), F.col("p"), F.when(F.col("o_kind") == IRI, F.col("o"))] + ([F.col("o_dt")] if datatypes else [])
    return q.select(F.explode(F.array_compact(F.array_distinct(F.array(*every)))).alias("iri")).distinct()


def profile(q: DataFrame) -> DataFrame:
    """One row: triples, distinct subjects, predicates, objects, IRIs, prefixes; blank and literal counts."""
    iris = _iris(q).agg(F.count("*").alias("iris"), F.countDistinct(prefix_of(F.col("iri"))).alias("prefixes"))
    blanks = q.select(F.explode(F.array(F.when(F.col("s_kind") == BLANK, F.col("s")), F.when(F.col("o_kind") == BLANK, F.col("o")))).alias("b")).agg(F.countDistinct("b").alias("blanks"))
    term = F.struct("o_kind", "o", F.coalesce("o_dt", F.lit("")), F.coalesce("o_lang", F.lit("")))
    counts = q.agg(F.count("*").alias("triples"), F.countDistinct("s").alias("subjects"), F.countDistinct("p").alias("predicates"), F.countDistinct(term).alias("objects"), F.count_if(F.col("o_kind") == LITERAL).alias("literals"))
    return counts.crossJoin(iris).crossJoin(blanks)  # one row each


def top_prefixes(q: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` prefixes with the most distinct IRIs."""
    return _iris(q).groupBy(prefix_of(F.col("iri")).alias("prefix")).agg(F.count("*").alias("iris")).orderBy(F.desc("iris"), "prefix").limit(k)


def dataset_profile(q: DataFrame) -> DataFrame:
    """The same over all graphs of a dataset, each triple counted once, with the number of named graphs; datatypes are no IRIs here."""
    triples = q.drop("g_kind", "g").distinct()
    iris = _iris(triples, datatypes=False).agg(F.count("*").alias("iris"), F.countDistinct(prefix_of(F.col("iri"))).alias("prefixes"))
    counts = triples.agg(F.count("*").alias("triples"), F.countDistinct("s").alias("subjects"), F.countDistinct("p").alias("predicates"), F.count_if(F.col("o_kind") == LITERAL).alias("literals"))
    graphs = q.agg(F.countDistinct("g").alias("graphs"))
    return counts.crossJoin(iris).crossJoin(graphs)  # one row each
