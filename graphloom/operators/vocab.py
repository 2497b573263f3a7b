"""Vocabulary analytics: term classification, hierarchy, properties of classes, lock files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import IRI, OWL, RDF, RDFS, TYPE
from .traverse import closure

SUBCLASS, EQUIVALENT, DOMAIN, RANGE, LABEL, COMMENT = RDFS + "subClassOf", OWL + "equivalentClass", RDFS + "domain", RDFS + "range", RDFS + "label", RDFS + "comment"
# Types that make a term a class, a property or a datatype.
CLASS_TYPES = [RDFS + "Class", OWL + "Class"]
PROPERTY_TYPES = [RDF + "Property", OWL + "ObjectProperty", OWL + "DatatypeProperty", OWL + "AnnotationProperty"]
DATATYPE_TYPES = [RDFS + "Datatype"]


def classify(q: DataFrame, namespace: str) -> DataFrame:
    """(iri, kind) of every IRI of a namespace: class, property, datatype or other.

    A predicate in use is a property; a term with a superclass is a class.
    """
    marks = q.select(F.explode(F.array(
        F.struct(F.when(F.col("s_kind") == IRI, F.col("s")).alias("iri"), ((F.col("p") == TYPE) & F.col("o").isin(CLASS_TYPES) | (F.col("p") == SUBCLASS)).alias("c"), ((F.col("p") == TYPE) & F.col("o").isin(PROPERTY_TYPES)).alias("p"), ((F.col("p") == TYPE) & F.col("o").isin(DATATYPE_TYPES)).alias("d")),
        F.struct(F.col("p").alias("iri"), F.lit(False).alias("c"), F.lit(True).alias("p"), F.lit(False).alias("d")),
        F.struct(F.when(F.col("o_kind") == IRI, F.col("o")).alias("iri"), F.lit(False).alias("c"), F.lit(False).alias("p"), F.lit(False).alias("d")),
    )).alias("m")).select("m.*").where(F.col("iri").startswith(namespace))
    return marks.groupBy("iri").agg(F.max("c").alias("c"), F.max("p").alias("p"), F.max("d").alias("d")).select("iri", F.when(F.col("c"), "class").when(F.col("p"), "property").when(F.col("d"), "datatype").otherwise("other").alias("kind"))


def scheme_free(iri: Column) -> Column:
    """http and https name the same term."""
    return F.regexp_replace(iri, "^https?:", "")


def class_closure(q: DataFrame) -> DataFrame:
    """(a, b): every proper superclass or equivalent class b of a, both relations taken together."""
    edges = q.where(F.col("p").isin(SUBCLASS, EQUIVALENT) & (F.col("o_kind") == IRI)).select(F.col("s").alias("a"), F.col("o").alias("b"), "p")
    both = edges.select("a", "b").unionAll(edges.where(F.col("p") == EQUIVALENT).select(F.col("b").alias("a"), F.col("a").alias("b")))
    return closure(both).where("a <> b")


def class_properties(q: DataFrame, hierarchy: DataFrame) -> DataFrame:
    """(class, property): properties whose domain is the class or one of its closure."""
    domains = q.where((F.col("p") == DOMAIN) & (F.col("o_kind") == IRI)).select(F.col("o").alias("b"), F.col("s").alias("property"))
    classes = hierarchy.select("a").unionAll(hierarchy.select("b")).distinct().select(F.col("a"), F.col("a").alias("b"))
    return hierarchy.select("a", "b").unionAll(classes).join(domains, "b").select(F.col("a").alias("class"), "property").distinct()


def subtypes(q: DataFrame, classes: list[str]) -> DataFrame:
    """(class, subtype): every class below one of ``classes``, circles or not."""
    wanted = q.sparkSession.createDataFrame([(c,) for c in classes], "b string")
    return class_closure(q).join(F.broadcast(wanted), "b", "left_semi").select(F.col("b").alias("class"), F.col("a").alias("subtype"))


def terms(q: DataFrame, namespace: str) -> DataFrame:
    """(iri, labels, comments, superclasses, equivalents, domains, ranges, see_also) of a namespace: sorted distinct values."""
    of = lambda p, name: F.array_sort(F.collect_set(F.when(F.col("p") == p, F.col("o")))).alias(name)
    parts = [(LABEL, "labels"), (COMMENT, "comments"), (SUBCLASS, "superclasses"), (EQUIVALENT, "equivalents"), (DOMAIN, "domains"), (RANGE, "ranges"), (RDFS + "seeAlso", "see_also")]
    own = q.where((F.col("s_kind") == IRI) & F.col("s").startswith(namespace))
    return own.groupBy(F.col("s").alias("iri")).agg(*[of(p, name) for p, name in parts])


def properties_for_classes(q: DataFrame, hierarchy: DataFrame) -> DataFrame:
    """(class, property, origin): properties that a class of ``hierarchy`` (a, b) may have.

    ``own``: of the class's namespace, with a domain among the class and its
    closure; ``universal``: of its namespace and without any domain;
    ``external``: of another namespace, with such a domain.  http and https
    name the same term.
    """
    from ..functions.iri import namespace

    home = lambda iri: scheme_free(namespace(iri))
    declared = q.where((F.col("p") == TYPE) & F.col("o").isin(PROPERTY_TYPES)).select(F.col("s").alias("property"))
    domains = q.where((F.col("p") == DOMAIN) & (F.col("o_kind") == IRI)).select(F.col("s").alias("property"), F.col("o").alias("b"))
    pairs = hierarchy.select("a", "b").unionAll(hierarchy.select(F.col("a"), F.col("a").alias("b"))).unionAll(hierarchy.select(F.col("b").alias("a"), "b")).distinct()
    typed = pairs.withColumn("key", scheme_free(F.col("b"))).join(domains.select("property", scheme_free(F.col("b")).alias("key")), "key").select(F.col("a").alias("class"), "property")
    typed = typed.withColumn("origin", F.when(home(F.col("class")) == home(F.col("property")), "own").otherwise("external"))
    classes = pairs.select(F.col("a").alias("class")).distinct().withColumn("home", home(F.col("class")))
    free = declared.join(domains, "property", "left_anti").distinct().withColumn("home", home(F.col("property")))
    return typed.unionByName(classes.join(free, "home").select("class", "property", F.lit("universal").alias("origin"))).distinct()


def referenced_namespaces(q: DataFrame, known: list[str]) -> DataFrame:
    """(namespace, uses): namespaces of superclasses, domains, ranges and predicates that no loaded vocabulary has."""
    from ..functions.iri import namespace

    named = q.where(F.col("p").isin(SUBCLASS, EQUIVALENT, DOMAIN, RANGE) & (F.col("o_kind") == IRI)).select(F.col("o").alias("iri")).unionAll(q.select("p"))
    found = named.groupBy(namespace(F.col("iri")).alias("namespace")).agg(F.count("*").alias("uses"))
    return found.where(~F.col("namespace").isin(known) if known else F.lit(True))


def ontology(spec, vocabulary: str, spark) -> DataFrame:
    """(s, p, o): the ontology triples of a ClassSpec's properties."""
    props = spark.createDataFrame([(p.predicate,) for p in spec.properties], "s string")
    rows = F.array(*[F.struct(F.lit(p).alias("p"), F.lit(o).alias("o")) for p, o in ((DOMAIN, spec.iri), (RDFS + "isDefinedBy", vocabulary), (TYPE, RDF + "Property"))])
    return props.select("s", F.explode(rows).alias("t")).select("s", "t.*")


def lock_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(name, problem): terms (name, iri, auto) that vanished or changed their IRI; error if generated."""
    old, new = before.select("name", F.col("iri").alias("old"), "auto"), after.select("name", F.col("iri").alias("new"))
    joined = old.join(new, "name", "left")
    problem = F.when(F.col("new").isNull(), "vanished").when(F.col("new") != F.col("old"), "renamed")
    return joined.where(problem.isNotNull()).select("name", problem.alias("problem"), F.when(F.col("auto"), "error").otherwise("info").alias("level"))
