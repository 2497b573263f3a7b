"""N-Triples and N-Quads: line formats, read and written as text that Spark can split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.terms import quad_text
from ..schema import BLANK, COLUMNS, IRI, LANG_STRING, LITERAL, STRING

_BASE = "A-Za-zÀ-ÖØ-öø-˿Ͱ-ͽͿ-῿‌-‍⁰-↏Ⰰ-⿯、-퟿豈-﷏ﷰ-�\\x{10000}-\\x{EFFFF}"
_NODE = f"_:[{_BASE}_0-9](?:[{_BASE}_0-9.\\-·̀-ͯ‿-⁀]*[{_BASE}_0-9\\-·̀-ͯ‿-⁀])?"
_IRI = r"<[^\x00-\x20<>\"{}|^`]*>"
_STRING = r"\"[^\"\\\n\r]*+(?:\\.[^\"\\\n\r]*+)*+\""
_LITERAL = rf"{_STRING}(?:@[A-Za-z]+(?:-[A-Za-z0-9]+)*|\^\^{_IRI})?"
#: A whole statement, a comment or a blank line; groups: s, p, o, g.
LINE = rf"^[ \t]*(?:({_IRI}|{_NODE})[ \t]*({_IRI})[ \t]*({_IRI}|{_NODE}|{_LITERAL})[ \t]*({_IRI}|{_NODE})?[ \t]*\.)?[ \t\r]*(?:#[^\n]*)?$"
#: What stands before and between the terms of a line that was taken apart: no term but a literal, which comes last, can hold it.
_CUT = "\x01"
_POINT = r"u(?![dD][89a-fA-F])[0-9A-Fa-f]{4}|U0000(?![dD][89a-fA-F])[0-9A-Fa-f]{4}|U000[1-9A-Fa-f][0-9A-Fa-f]{4}|U0010[0-9A-Fa-f]{4}"
#: Escapes of literals and of IRIs, and the parts of a text that has only good ones.
_ESCAPES = {False: rf"\\(?:[tbnrf\"'\\]|{_POINT})", True: rf"\\(?:{_POINT})"}
_PARTS = r"(?s)\\U.{8}|\\u.{4}|\\.|[^\\]+"


def unescape(text: Column, iri: bool = False) -> Column:
    """Escapes resolved, null for wrong ones; a text without a backslash is only looked at."""
    wrong = F.regexp_replace(text, _ESCAPES[iri], "").contains("\\")
    named = lambda part: F.translate(F.substring(part, 2, 1), "tbnrf", "\t\b\n\r\f")
    point = lambda part: F.decode(F.unhex(F.lpad(F.substring(part, 3, 8), 8, "0")), "UTF-32")
    plain = lambda part: F.when(~part.startswith("\\"), part).when(F.length(part) > 2, point(part)).otherwise(named(part))
    resolved = F.array_join(F.transform(F.regexp_extract_all(text, F.lit(_PARTS), F.lit(0)), plain), "")
    return F.when(~text.contains("\\"), text).when(~wrong, resolved)


def parse_lines(lines: DataFrame, column: str = "value", doc: Column | None = None, graphs: bool = True) -> DataFrame:
    """Quads of statement lines, with ``error``: the text of a line that is none.

    ``doc`` scopes blank nodes.  With ``graphs`` False a fourth term is an error.
    A line is matched once: the match, and then its parts, go through an
    ``explode`` of one row, which the optimiser can't copy into their uses.
    """
    once = lambda c: F.explode(F.array(c))
    cut = F.regexp_replace(F.col("_line"), LINE, _CUT + f"$1{_CUT}$2{_CUT}$4{_CUT}$3")
    rows = lines.select(F.col(column).alias("_line"), (doc if doc is not None else F.lit("doc")).alias("_doc"))
    rows = rows.select("_line", "_doc", once(cut).alias("_cut"))
    rows = rows.select("_line", "_doc", once(F.when(~F.col("_line").startswith(_CUT) & F.col("_cut").startswith(_CUT), F.split("_cut", _CUT, 5))).alias("_terms"))
    term = lambda i: F.get("_terms", i)
    # the last quote ends a literal: neither a tag nor an IRI can hold one
    rows = rows.select("_line", "_doc", F.col("_terms").isNotNull().alias("_ok"), *[term(i).alias(c) for i, c in ((1, "_s"), (2, "_p"), (3, "_g"), (4, "_o"))], F.when(term(4).startswith('"'), F.substring_index(term(4), '"', -1)).alias("_tail"))
    rows = rows.where("not _ok or _s <> ''")
    ok = F.col("_ok") & ((F.col("_g") == "") if not graphs else F.lit(True))
    rest = lambda c, n, less=0: F.substring(F.col(c), F.lit(n), F.length(c) - less)

    def kind(c: str) -> Column:
        return F.when(F.col(c).startswith("<"), IRI).when(F.col(c).startswith("_:"), BLANK).when(F.col(c).startswith('"'), LITERAL).cast("byte")

    def value(c: str) -> Column:
        return F.when(F.col(c).startswith("<"), unescape(rest(c, 2, 2), True)).when(F.col(c).startswith("_:"), F.concat("_doc", F.lit("|"), rest(c, 3)))

    literal = F.col("_tail").isNotNull()
    text = F.substring(F.col("_o"), F.lit(2), F.length("_o") - F.length("_tail") - 2)
    lang, dt = F.when(F.startswith("_tail", F.lit("@")), rest("_tail", 2)), F.when(F.startswith("_tail", F.lit("^^")), unescape(rest("_tail", 4, 4), True)).otherwise(F.lit(STRING))
    out = rows.select(
        "_line", ok.alias("_ok"), kind("_g").alias("g_kind"), value("_g").alias("g"), kind("_s").alias("s_kind"), value("_s").alias("s"), unescape(rest("_p", 2, 2), True).alias("p"),
        kind("_o").alias("o_kind"), F.when(literal, unescape(text)).otherwise(value("_o")).alias("o"),
        F.when(literal, F.when(lang.isNotNull(), F.lit(LANG_STRING)).otherwise(dt)).alias("o_dt"), lang.alias("o_lang"),
    )
    good = F.col("_ok") & F.col("s").isNotNull() & F.col("p").isNotNull() & F.col("o").isNotNull() & (F.col("g_kind").isNull() | F.col("g").isNotNull()) & ((F.col("o_kind") != LITERAL) | F.col("o_dt").isNotNull())
    found = out.select("_line", *COLUMNS, once(F.coalesce(good, F.lit(False))).alias("_good"))
    return found.select(*[F.when(F.col("_good"), F.col(c)).alias(c) for c in COLUMNS], F.when(~F.col("_good"), F.col("_line")).alias("error"))


def checked(parsed: DataFrame, mode: str = "FAILFAST") -> DataFrame:
    """Errors handled as Spark's readers do: FAILFAST, DROPMALFORMED or PERMISSIVE (keeps ``error``)."""
    if mode == "PERMISSIVE":
        return parsed
    if mode == "DROPMALFORMED":
        return parsed.where("error is null").drop("error")
    if mode != "FAILFAST":
        raise ValueError(f"unknown mode: {mode}")
    return parsed.where(F.when(F.col("error").isNotNull(), F.raise_error(F.concat(F.lit("not a statement: "), "error"))).otherwise(F.lit(True))).drop("error")


def read(spark: SparkSession, path: str, mode: str = "FAILFAST", graphs: bool = True, scope: str | None = None) -> DataFrame:
    """Quads of text files; a blank node belongs to its file, with ``scope`` to all files that are read with it."""
    rows = spark.read.text(path).withColumn("_file", F.col("_metadata.file_path") if scope is None else F.lit(scope))
    return checked(parse_lines(rows, doc=F.col("_file"), graphs=graphs), mode)


def read_stream(spark: SparkSession, path: str, mode: str = "DROPMALFORMED") -> DataFrame:
    """The same as a stream of the files that arrive in a folder."""
    return checked(parse_lines(spark.readStream.text(path).withColumn("_file", F.col("_metadata.file_path")), doc=F.col("_file")), mode)


def lines(q: DataFrame, canonical: bool = False) -> DataFrame:
    """One line per quad; the canonical form has each line once (sorting is left to the sink)."""
    out = q.select(quad_text(canonical).alias("value"))
    return out.distinct() if canonical else out


def write(q: DataFrame, path: str, canonical: bool = False) -> None:
    """Text files; canonical ones are sorted by range, so that their concatenation in order is sorted."""
    out = lines(q, canonical)
    (out.orderBy("value") if canonical else out).write.text(path)


def can_parse(texts: DataFrame, column: str = "value", key: str | None = None) -> DataFrame:
    """Share of lines that look like statements; over 0.8 counts as this format."""
    rows = texts.select(*([key] if key else []), F.explode(F.split(column, "\n")).alias("line")).where((F.trim("line") != "") & ~F.trim("line").startswith("#"))
    like = F.trim("line").rlike(r"^(<|_:)") & F.trim("line").endswith(".") & (F.size(F.split(F.trim("line"), " ")) >= 3)
    share = F.avg(like.cast("double"))
    return rows.groupBy(*([key] if key else [])).agg(share.alias("share"), (share > 0.8).alias("can_parse"))
