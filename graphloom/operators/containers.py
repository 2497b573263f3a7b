"""rdf:List, rdf:Seq, rdf:Bag and rdf:Alt: ordered items as triples, and back.

Items are rows with a position, so no list or container is ever gathered: the
nodes of a list are named after its head and the position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import BLANK, COLUMNS, FIRST, IRI, NIL, OBJECT, RDF, REST, SUBJECT, TYPE

#: The container classes.
KINDS = ("Seq", "Bag", "Alt")


def _default_graph(rows: DataFrame) -> DataFrame:
    return rows.withColumn("g_kind", F.lit(None).cast("byte")).withColumn("g", F.lit(None).cast("string")).select(*COLUMNS)


def list_node(head: Column, position: Column) -> Column:
    """The blank node of a place in a list: the head itself, then numbered ones."""
    return F.when(position == 0, head).otherwise(F.concat(head, F.lit("-"), position.cast("string")))


def list_quads(items: DataFrame) -> DataFrame:
    """Quads of lists given as items (head, position from 0, o_kind, o, o_dt, o_lang); no items are rdf:nil and need none.

    The last position of each head is one aggregate; the inverse is ``list_items``.
    """
    ends = items.groupBy("head").agg(F.max("position").alias("end"))
    node, last = list_node(F.col("head"), F.col("position")), F.col("position") == F.col("end")
    none = F.lit(None).cast("string")
    first = F.struct(F.lit(FIRST).alias("p"), *OBJECT)
    rest = F.struct(F.lit(REST).alias("p"), F.when(last, IRI).otherwise(BLANK).cast("byte").alias("o_kind"), F.when(last, F.lit(NIL)).otherwise(list_node(F.col("head"), F.col("position") + 1)).alias("o"), none.alias("o_dt"), none.alias("o_lang"))
    rows = items.join(ends, "head").select(F.lit(BLANK).cast("byte").alias("s_kind"), node.alias("s"), F.explode(F.array(first, rest)).alias("t"))
    return _default_graph(rows.select(*SUBJECT, "t.*"))


def container_quads(items: DataFrame, kind: str = "Seq") -> DataFrame:
    """Quads of containers given as items (s_kind, s, position from 1, o_kind, o, o_dt, o_lang); an item without a value is an error."""
    if kind not in KINDS:
        raise ValueError(f"no container: {kind}")
    value = F.coalesce("o", F.raise_error(F.concat(F.lit("a container's item has no value: "), "s")))
    none = F.lit(None).cast("string")
    typed = items.select(*SUBJECT).distinct().select(*SUBJECT, F.lit(TYPE).alias("p"), F.lit(IRI).cast("byte").alias("o_kind"), F.lit(RDF + kind).alias("o"), none.alias("o_dt"), none.alias("o_lang"))
    members = items.select(*SUBJECT, F.concat(F.lit(RDF + "_"), F.col("position").cast("string")).alias("p"), "o_kind", value.alias("o"), "o_dt", "o_lang")
    return _default_graph(typed.unionByName(members))


def container_items(q: DataFrame, kind: str = "Seq") -> DataFrame:
    """(s_kind, s, position, o_kind, o, o_dt, o_lang) of every container of a kind.

    A subject needs the container's type.  Positions count from 1 without gaps
    in the order of the numbered predicates; of several values of one number
    the greatest is taken.
    """
    number = F.regexp_extract("p", "^" + RDF.replace(".", r"\.") + r"_([1-9]\d{0,17})$", 1)
    numbered = q.withColumn("n", F.when(number != "", number.cast("long"))).where("n is not null").groupBy(*SUBJECT, "n").agg(F.max(F.struct(*OBJECT)).alias("item"))
    typed = q.where((F.col("p") == TYPE) & (F.col("o") == RDF + kind)).select(*SUBJECT).distinct()
    own = numbered.join(typed, SUBJECT, "left_semi")
    # ranks in two steps, so that a container of any size is many tasks' work
    parts = own.withColumn("part", F.floor(F.col("n") / 10_000))
    sizes = parts.groupBy(*SUBJECT, "part").agg(F.count("*").alias("size"))
    from pyspark.sql import Window

    before = sizes.withColumn("before", F.sum("size").over(Window.partitionBy(*SUBJECT).orderBy("part")) - F.col("size")).drop("size")
    ranked = parts.join(before, [*SUBJECT, "part"]).withColumn("position", F.col("before") + F.row_number().over(Window.partitionBy(*SUBJECT, "part").orderBy("n")))
    return ranked.select(*SUBJECT, "position", "item.*")


def reify(q: DataFrame, node: Column) -> DataFrame:
    """The four triples of an rdf:Statement for every triple; ``node`` gives the statement's IRI."""
    none = F.lit(None).cast("string")

    def part(p: str, kind: Column, value: Column, dt: Column = none, lang: Column = none) -> Column:
        return F.struct(F.lit(p).alias("p"), kind.cast("byte").alias("o_kind"), value.alias("o"), dt.alias("o_dt"), lang.alias("o_lang"))

    iri = F.lit(IRI)
    rows = F.array(part(TYPE, iri, F.lit(RDF + "Statement")), part(RDF + "subject", F.col("s_kind"), F.col("s")), part(RDF + "predicate", iri, F.col("p")), part(RDF + "object", *[F.col(c) for c in OBJECT]))
    return q.select("g_kind", "g", F.lit(IRI).cast("byte").alias("s_kind"), node.alias("s"), F.explode(rows).alias("t")).select("g_kind", "g", *SUBJECT, "t.*")


def statements(q: DataFrame) -> DataFrame:
    """(st, s_kind, s, p, o_kind, o, o_dt, o_lang) of every reified statement that has a type and all three parts."""
    of = lambda p, *columns: F.max(F.when(F.col("p") == RDF + p, F.struct(*columns)))
    typed = F.max((F.col("p") == TYPE) & (F.col("o") == RDF + "Statement"))
    found = q.groupBy(F.col("s").alias("st")).agg(of("subject", F.col("o_kind").alias("s_kind"), F.col("o").alias("s")).alias("a"), of("predicate", "o").alias("b"), of("object", *OBJECT).alias("c"), typed.alias("typed"))
    return found.where("typed and a is not null and b is not null and c is not null").select("st", "a.s_kind", "a.s", F.col("b.o").alias("p"), "c.*")


def inline_candidates(q: DataFrame) -> DataFrame:
    """(node, uses): blank nodes that are the object of one triple only, so that they can be written inside it."""
    return q.where(F.col("o_kind") == BLANK).groupBy(F.col("o").alias("node")).agg(F.count("*").alias("uses")).where("uses = 1")
