"""Column expressions on terms: tests, constructors and N-Quads text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import BLANK, IRI, LANG_STRING, LITERAL, STRING


def iri_is_valid(iri: Column) -> Column:
    """Not empty, a scheme, no blanks."""
    return F.coalesce(iri.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:") & ~iri.contains(" "), F.lit(False))


def lexical_is_valid(value: Column, datatype: Column) -> Column:
    """Whether a lexical form belongs to its datatype; true for unknown datatypes."""
    from ..schema import BOOLEAN, DATE, DATE_TIME, DECIMAL, DOUBLE, INTEGER

    day = r"^-?\d{4,}-\d{2}-\d{2}"
    return (
        F.when(datatype == INTEGER, value.rlike(r"^[+-]?\d+$")).when(datatype == DECIMAL, value.rlike(r"^[+-]?(\d+(\.\d*)?|\.\d+)$"))
        .when(datatype == DOUBLE, value.rlike(r"^([+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?|[+-]?INF|NaN)$")).when(datatype == BOOLEAN, value.isin("true", "false", "1", "0"))
        .when(datatype == DATE, value.rlike(day + r"(Z|[+-]\d{2}:\d{2})?$"))
        .when(datatype == DATE_TIME, value.rlike(day + r"T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})?$")).otherwise(F.lit(True))
    )


def literal(value: Column, datatype: str = STRING, language: Column | None = None) -> list[Column]:
    """o_kind, o, o_dt, o_lang of a literal."""
    kind, lang = F.lit(LITERAL).cast("byte"), language if language is not None else F.lit(None).cast("string")
    dt = F.when(lang.isNotNull(), F.lit(LANG_STRING)).otherwise(F.lit(datatype))
    return [kind.alias("o_kind"), value.alias("o"), dt.alias("o_dt"), lang.alias("o_lang")]


def _escaped(value: Column, pairs: list[tuple[str, str]]) -> Column:
    """Each first text of the pairs replaced by the second; values that hold none, nearly all, are only looked at once."""
    held = "[" + "".join(f"\\x{ord(old):02X}" for old, _ in pairs) + "]"
    text = value
    for old, new in pairs:
        text = F.replace(text, F.lit(old), F.lit(new))
    return F.when(value.rlike(held), text).otherwise(value)


def escape_literal(value: Column, canonical: bool = False) -> Column:
    """Escapes of N-Quads strings; the canonical form escapes all other control characters too."""
    pairs = [("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\b", "\\b"), ("\f", "\\f")]
    if canonical:
        named = {old for old, _ in pairs}
        pairs += [(chr(c), f"\\u{c:04X}") for c in [*range(32), 127] if chr(c) not in named]
    return _escaped(value, pairs)


def escape_iri(value: Column) -> Column:
    """Characters that an IRI may not hold become numeric escapes."""
    return _escaped(value, [(c, f"\\u{ord(c):04X}") for c in "\\<>\"{}|^`" + "".join(map(chr, range(33)))])


def blank_label(value: Column) -> Column:
    """A label of its own for every blank node, whatever documents the nodes come from.

    The label is a 128-bit hash of the scoped value: labels of different
    documents don't meet, and a node has one label in all files of an output.
    """
    return F.concat(F.lit("_:b"), F.md5(value))


def label_table(nodes: DataFrame) -> DataFrame:
    """(node, label) of the blank nodes of a quad table, to find written labels again."""
    places = F.array(*[F.when(F.col(f"{c}_kind") == BLANK, F.col(c)) for c in ("s", "o", "g")])
    return nodes.select(F.explode(F.array_compact(places)).alias("node")).distinct().select("node", blank_label(F.col("node")).alias("label"))


def term_text(kind: Column, value: Column, datatype: Column | None = None, language: Column | None = None, canonical: bool = False, blank: Column | None = None) -> Column:
    """The term in N-Quads notation; ``blank`` overrides how blank nodes are written."""
    text = F.when(kind == IRI, F.concat(F.lit("<"), escape_iri(value), F.lit(">"))).when(kind == BLANK, blank if blank is not None else blank_label(value))
    if datatype is None:
        return text
    quoted = F.concat(F.lit('"'), escape_literal(value, canonical), F.lit('"'))
    return text.otherwise(
        F.when(language.isNotNull(), F.concat(quoted, F.lit("@"), language)).when(datatype.isNull() | (datatype == STRING), quoted).otherwise(F.concat(quoted, F.lit("^^<"), escape_iri(datatype), F.lit(">")))
    )


def quad_text(canonical: bool = False, s: Column | None = None, o: Column | None = None, g: Column | None = None) -> Column:
    """A line of N-Quads for the columns of a quad table (without its line end)."""
    graph = term_text(F.col("g_kind"), F.col("g"), blank=g)
    return F.concat(
        term_text(F.col("s_kind"), F.col("s"), blank=s), F.lit(" <"), escape_iri(F.col("p")), F.lit("> "),
        term_text(F.col("o_kind"), F.col("o"), F.col("o_dt"), F.col("o_lang"), canonical, o),
        F.when(F.col("g").isNull(), F.lit("")).otherwise(F.concat(F.lit(" "), graph)), F.lit(" ."),
    )
