"""Graphs and wide rows: triplify tables by a specification, project objects back."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.terms import lexical_is_valid
from ..schema import BLANK, BOOLEAN, COLUMNS, DATE, DATE_TIME, DECIMAL, DOUBLE, IRI, INTEGER, LITERAL, STRING, TYPE


@dataclass(frozen=True)
class Property:
    """A column and its predicate.

    ``kind``: a literal kind of KINDS or ``iri`` with ``template`` (``{}`` is the
    column's value).  ``many`` collects all values.
    """

    column: str
    predicate: str
    kind: str = "string"
    template: str = "{}"
    required: bool = False
    many: bool = False
    language: str | None = None


@dataclass(frozen=True)
class ClassSpec:
    """A class: its IRI, the template of its subjects over ``key``, and its properties.

    With ``local`` the subjects are blank nodes, named by the template within
    the table.
    """

    iri: str
    template: str
    key: str
    properties: tuple[Property, ...] = field(default_factory=tuple)
    local: bool = False

    def __post_init__(self) -> None:
        for place, template in [("subject", self.template), *((p.column, p.template) for p in self.properties if p.kind == "iri")]:
            if template.count("{}") != 1 or "{" in template.replace("{}", "") or "}" in template.replace("{}", ""):
                raise ValueError(f"{place}: a template has one place for the value, {{}}: {template}")
        unknown = [p.kind for p in self.properties if p.kind != "iri" and p.kind not in KINDS]
        if unknown:
            raise ValueError(f"unknown kinds: {', '.join(unknown)}; known: {', '.join(KINDS)}")


#: Literal kinds: datatype and how a column is written.
KINDS = {"string": STRING, "integer": INTEGER, "decimal": DECIMAL, "double": DOUBLE, "boolean": BOOLEAN, "date": DATE, "dateTime": DATE_TIME}
_TYPES = {"string": "string", "integer": "bigint", "decimal": "decimal(18,2)", "double": "double", "boolean": "boolean", "date": "date", "dateTime": "timestamp_ntz"}


def _filled(template: str, value: Column) -> Column:
    before, _, after = template.partition("{}")
    return F.concat(F.lit(before), value.cast("string"), F.lit(after))


def lexical(value: Column, kind: str) -> Column:
    if kind == "decimal":
        return value.cast("decimal(18,2)").cast("string")
    if kind == "date":
        return F.date_format(value, "yyyy-MM-dd")
    if kind == "dateTime":
        return F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return value.cast("string")


def triplify(df: DataFrame, spec: ClassSpec, graph: str | None = None) -> DataFrame:
    """Quads of a table: the type and one triple per non-null column (per item of an array).

    One pass over the table and no shuffle: each row gives an array of triples.
    """
    none = F.lit(None).cast("string")

    def term(p: str, kind: int, value: Column, dt: Column = none, lang: Column = none) -> Column:
        return F.struct(F.lit(p).alias("p"), F.lit(kind).cast("byte").alias("o_kind"), value.alias("o"), dt.alias("o_dt"), lang.alias("o_lang"))

    def of(prop: Property, value: Column) -> Column:
        if prop.kind == "iri":
            return term(prop.predicate, IRI, _filled(prop.template, value))
        dt = F.lit(KINDS[prop.kind]) if prop.language is None else F.lit("http://www.w3.org/1999/02/22-rdf-syntax-ns#langString")
        return term(prop.predicate, LITERAL, lexical(value, prop.kind), dt, F.lit(prop.language).cast("string"))

    def each(prop: Property) -> Column:
        return F.transform(prop.column, lambda v: of(prop, v))

    singles = F.array(term(TYPE, IRI, F.lit(spec.iri)), *[of(p, F.col(p.column)) for p in spec.properties if not p.many])
    every = F.concat(singles, *[F.coalesce(each(p), F.array()) for p in spec.properties if p.many]) if any(p.many for p in spec.properties) else singles
    rows = df.where(F.col(spec.key).isNotNull()).select(_filled(spec.template, F.col(spec.key)).alias("s"), F.explode(F.filter(every, lambda t: t["o"].isNotNull())).alias("t"))
    return rows.select(F.lit(IRI if graph else None).cast("byte").alias("g_kind"), F.lit(graph).cast("string").alias("g"), F.lit(BLANK if spec.local else IRI).cast("byte").alias("s_kind"), "s", "t.*").select(*COLUMNS)


def _value(prop: Property) -> Column:
    if prop.kind == "iri":
        before, _, after = prop.template.partition("{}")
        inner = F.substring(F.col("o"), F.lit(len(before) + 1), F.length("o") - len(before) - len(after))
        return F.when((F.col("o_kind") == IRI) & F.col("o").startswith(before) & F.col("o").endswith(after), inner)
    good = (F.col("o_kind") == LITERAL) & (F.col("o_dt") == KINDS[prop.kind]) & lexical_is_valid(F.col("o"), F.col("o_dt"))
    if prop.language is not None:
        return F.when((F.col("o_kind") == LITERAL) & (F.col("o_lang") == prop.language), F.col("o"))
    return F.when(good, F.col("o"))


def project(q: DataFrame, spec: ClassSpec) -> DataFrame:
    """One row per subject of the class, one column per property.

    One shuffle on the subject: each property is an aggregate over its triples.
    A single-valued property with several values takes the least; ``violations``
    reports those.
    """
    hit = {p: F.col("p") == p.predicate for p in spec.properties}
    aggregates = []
    for p in spec.properties:
        value = F.when(hit[p], _value(p)).try_cast(_TYPES.get(p.kind, "string"))
        aggregates.append((F.sort_array(F.collect_list(value)) if p.many else F.min(value)).alias(p.column))
    wanted = [p.predicate for p in spec.properties]
    rows = q.where(F.col("p").isin([*wanted, TYPE])).groupBy("s").agg(F.max((F.col("p") == TYPE) & (F.col("o") == spec.iri)).alias("_typed"), *aggregates)
    before, _, after = spec.template.partition("{}")
    key = F.substring(F.col("s"), F.lit(len(before) + 1), F.length("s") - len(before) - len(after))
    return rows.where("_typed").select("s", key.alias(spec.key), *[p.column for p in spec.properties if p.column != spec.key])


def violations(q: DataFrame, spec: ClassSpec) -> DataFrame:
    """(s, predicate, problem, n): too many values, missing ones, wrong datatypes; one shuffle for all properties."""
    hit = [F.col("p") == p.predicate for p in spec.properties]
    typed = (F.col("p") == TYPE) & (F.col("o") == spec.iri)
    counts = [F.count_if(h).alias(f"n{i}") for i, h in enumerate(hit)]
    wrong = [F.count_if(h & _value(p).isNull()).alias(f"w{i}") for i, (h, p) in enumerate(zip(hit, spec.properties, strict=True))]
    rows = q.where(F.col("p").isin([TYPE, *(p.predicate for p in spec.properties)])).groupBy("s").agg(F.max(typed).alias("typed"), *counts, *wrong).where("typed")

    def problem(p: Property, what: str, when: Column, n: Column) -> Column:
        return F.when(when, F.struct(F.lit(p.predicate).alias("predicate"), F.lit(what).alias("problem"), n.cast("long").alias("n")))

    found = []
    for i, p in enumerate(spec.properties):
        n, w = F.col(f"n{i}"), F.col(f"w{i}")
        found += [problem(p, "too many values", n > 1, n)] * (not p.many) + [problem(p, "datatype", w > 0, w)] + [problem(p, "missing", n == 0, n)] * p.required
    return rows.select("s", F.explode(F.array_compact(F.array(*found))).alias("v")).select("s", "v.*")


def unmapped(q: DataFrame, spec: ClassSpec) -> DataFrame:
    """Triples that the projection of the class doesn't read."""
    typed = q.where((F.col("p") == TYPE) & (F.col("o") == spec.iri)).select("s").distinct().withColumn("_own", F.lit(True))
    read = F.coalesce("_own", F.lit(False)) & (F.col("p").isin([p.predicate for p in spec.properties]) | ((F.col("p") == TYPE) & (F.col("o") == spec.iri)))
    return q.join(typed, "s", "left").where(~read).select(*COLUMNS)


def predicates_map(q: DataFrame) -> DataFrame:
    """(s, values): a map from predicate to its sorted values, catch-all for open data."""
    pairs = q.groupBy("s", "p").agg(F.sort_array(F.collect_list("o")).alias("os"))
    return pairs.groupBy("s").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("p", "os")))).alias("values"))


def complete(q: DataFrame, spec: ClassSpec, mode: str = "strict") -> DataFrame:
    """The projection, and what ``mode`` makes of triples that it doesn't read.

    ``strict`` raises a ValueError that tells their number, ``warn`` warns,
    ``lenient`` looks at nothing.
    """
    if mode not in ("strict", "warn", "lenient"):
        raise ValueError(f"unknown mode: {mode}")
    if mode != "lenient":
        left = unmapped(q, spec).count()
        if left and mode == "strict":
            raise ValueError(f"{left} triples are not part of {spec.iri}")
        if left:
            import warnings

            warnings.warn(f"{left} triples are not part of {spec.iri}", stacklevel=2)
    return project(q, spec)


def root_of(q: DataFrame, spec: ClassSpec) -> str:
    """The one subject that a document is about: its only subject, else the only one of the class, else the least that no other refers to."""
    from .traverse import root_subjects

    for subjects in (q.select("s").distinct(), q.where((F.col("p") == TYPE) & (F.col("o") == spec.iri)).select("s").distinct()):
        found = subjects.limit(2).collect()
        if len(found) == 1:
            return found[0].s
    least = root_subjects(q).agg(F.min("s")).first()[0]
    if least is None:
        raise ValueError("no subject is a root")
    return least


def native_values(q: DataFrame) -> DataFrame:
    """(s, p, i, n, t): literals as numbers and text by their datatypes; invalid forms are null."""
    good = lexical_is_valid(F.col("o"), F.col("o_dt"))
    of = lambda dt: F.when((F.col("o_dt") == dt) & good, F.col("o"))
    return q.where(F.col("o_kind") == LITERAL).select("s", "p", of(INTEGER).try_cast("bigint").alias("i"), of(DECIMAL).try_cast("decimal(18,2)").alias("n"), F.when(F.col("o_dt") == STRING, F.col("o")).alias("t"))


def json_triples(df: DataFrame, subject: Column, column: str, vocabulary: str) -> DataFrame:
    """(s, p, o, o_dt) of a column of JSON objects: whole numbers become integers, the rest strings."""
    rows = df.select(subject.alias("s"), F.explode(F.from_json(column, "map<string,string>")).alias("k", "v"))
    return rows.select("s", F.concat(F.lit(vocabulary), "k").alias("p"), F.col("v").alias("o"), F.when(F.col("v").rlike("^-?[0-9]+$"), INTEGER).otherwise(STRING).alias("o_dt"))
