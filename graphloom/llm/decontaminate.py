"""Benchmark decontamination by winnowing, in DataFrame functions only.

Texts become words; k-grams of words are hashed; in every run of ``WINDOW -
GRAM + 1`` neighbouring k-grams the least hash is kept.  Two texts that share
``WINDOW`` consecutive words share such a run, so they share a kept hash: no
span of that length is missed.  Kept hashes of documents meet those of the
benchmark in a join; around each hit the windows that hold the k-gram are
spelled out and joined to the benchmark's windows word for word, which extends
the hit to the whole shared span and drops chance hits.

Items shorter than a window are one window of their own length.  They can't be
winnowed with the others, so for each such length that occurs all grams of that
length are kept.

Documents are read twice: once for their hashes, once - only those with hits -
for their windows.  The benchmark side is broadcast while it is small (its rows
are counted first) and shuffled beyond that.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, row_hash, small, text_or_empty, written

#: Words of a window, and of the hashed grams within it.
WINDOW, GRAM = 13, 5
#: A document is contaminated if one in so many of its words is hit.
SHARE = 20


def words_of(column: Column) -> Column:
    """Words: runs of digits, a-z and everything beyond ASCII."""
    return F.array_remove(F.split(lower_ascii(column), "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"), "")


def _gram(hashes: Column, at: Column, length: int, kind: int) -> Column:
    return F.xxhash64(F.lit(kind), *[F.get(hashes, at + j) for j in range(length)])


def _grams(hashes: Column, length: int, kind: int) -> Column:
    """Hashes of all grams of a length; an empty array for shorter texts."""
    n = F.size(hashes) - length
    return F.when(n >= 0, F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(0))), lambda i: _gram(hashes, i, length, kind))).otherwise(F.array().cast("array<bigint>"))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, though ``use`` names it in a lambda."""
    return F.get(F.transform(F.array(value), use), 0)


def _winnowed(hashes: Column, window: int, gram: int) -> Column:
    """Distinct least hashes of all runs of neighbouring grams."""
    run = window - gram + 1

    def least(grams: Column) -> Column:
        n = F.size(grams) - run
        return F.when(n >= 0, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(0)) + 1), lambda i: F.array_min(F.slice(grams, i, run))))).otherwise(F.array().cast("array<bigint>"))

    return _let(_grams(hashes, gram, window), least)


def _kept(hashes: Column, window: int, gram: int, short: list[int]) -> Column:
    return _let(hashes, lambda h: F.concat(_winnowed(h, window, gram), *[F.array_distinct(_grams(h, m, m)) for m in short]))


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """One row per document: doc_id, text_hash, n_words, n_hit, items, contaminated.

    ``docs`` has doc_id and text, ``benchmark`` item_id and text.  A word is hit
    if it lies inside an occurrence of a window of any item; ``items`` holds the
    distinct ids of those items as sorted strings.  Null and empty texts have no
    words and are clean; an empty benchmark leaves every document clean; no
    documents give no rows; repeated rows each give a row; a null item_id counts
    as the item ``null``; other columns are ignored; nothing is cut.
    """
    hashed = lambda words: F.transform(words, lambda w: F.xxhash64(w))
    items = written(benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), words_of(text_or_empty()).alias("words")).where(F.size("words") > 0), "benchmark-words")
    short = sorted(r[0] for r in items.where(F.size("words") < window).select(F.size("words")).distinct().collect())  # fewer than a window

    n = F.size("words") - window
    every = F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(0)) + 1), lambda i: F.slice("words", i, window))).otherwise(F.array("words"))
    windows = items.select("item", F.explode(F.transform(every, lambda w: F.array_join(w, " "))).alias("window")).groupBy("window").agg(F.collect_set("item").alias("items"))
    windows = written(windows, "benchmark-windows")
    marks = items.withColumn("hashes", hashed("words")).select(F.explode(F.when(F.size("words") >= window, _winnowed(F.col("hashes"), window, gram)).otherwise(F.array(_whole(F.col("hashes"), short)))).alias("mark")).distinct()
    marks = written(marks, "benchmark-marks")

    source = docs.select("doc_id", text_or_empty().alias("text")).withColumn("text_hash", row_hash())
    kept = source.select("doc_id", "text_hash", words_of(F.col("text")).alias("words")).withColumn("hashes", hashed("words")).select("doc_id", "text_hash", F.size("words").cast("long").alias("n_words"), _kept(F.col("hashes"), window, gram, short).alias("kept"))
    kept = written(kept, "document-marks")
    hits = kept.select("doc_id", "text_hash", F.explode("kept").alias("mark")).join(small(marks), "mark").groupBy("doc_id", "text_hash").agg(F.collect_set("mark").alias("marks"))
    hits = written(hits, "document-hits").withColumnRenamed("doc_id", "hit_id").withColumnRenamed("text_hash", "hit_hash")

    suspects = source.join(small(hits), F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("text_hash") == F.col("hit_hash")))
    suspects = suspects.dropDuplicates(["doc_id", "text_hash"]).select("doc_id", "text_hash", "marks", words_of(F.col("text")).alias("words")).withColumn("hashes", hashed("words"))
    # starts of all windows that may be shared: those around each gram that hit
    last = F.size("words") - window
    around = F.array_distinct(F.flatten(F.transform(
        F.filter(F.sequence(F.lit(0), F.greatest(F.size("words") - gram, F.lit(0))), lambda i: F.array_contains("marks", _gram(F.col("hashes"), i, gram, window))),
        lambda i: F.sequence(F.greatest(i - (window - gram), F.lit(0)), F.least(i, last)),
    )))
    spans = F.when(last >= 0, F.transform(around, lambda i: F.struct(i.alias("at"), F.lit(window).alias("n")))).otherwise(F.array().cast("array<struct<at:int,n:int>>"))
    for m in short:
        spans = F.concat(spans, _whole_hits(m))
    spelled = F.transform(spans, lambda s: F.struct(s["at"].alias("at"), s["n"].alias("n"), F.array_join(F.slice("words", s["at"] + 1, s["n"]), " ").alias("window")))
    shared = suspects.select("doc_id", "text_hash", F.explode(spelled).alias("s")).select("doc_id", "text_hash", "s.*").join(small(windows), "window")
    covered = F.array_distinct(F.flatten(F.transform(F.collect_set(F.struct("at", "n")), lambda s: F.sequence(s["at"], s["at"] + s["n"] - 1))))
    found = shared.groupBy("doc_id", "text_hash").agg(F.size(covered).cast("long").alias("n_hit"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    found = written(found, "contaminated").withColumnRenamed("doc_id", "hit_id").withColumnRenamed("text_hash", "hit_hash")

    rows = kept.select("doc_id", "text_hash", "n_words").join(small(found), F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("text_hash") == F.col("hit_hash")), "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return rows.select("doc_id", "text_hash", "n_words", n_hit.alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), ((n_hit > 0) & (SHARE * n_hit >= F.col("n_words"))).alias("contaminated"))


def _whole_hits(m: int) -> Column:
    """Where grams of ``m`` words may be short items, for rows with words, hashes and marks."""
    at = F.filter(F.sequence(F.lit(0), F.greatest(F.size("words") - m, F.lit(0))), lambda i: F.array_contains("marks", _gram(F.col("hashes"), i, m, m)))
    return F.when(F.size("words") >= m, F.transform(at, lambda i: F.struct(i.alias("at"), F.lit(m).alias("n")))).otherwise(F.array().cast("array<struct<at:int,n:int>>"))


def _whole(hashes: Column, short: list[int]) -> Column:
    """The hash of a whole short item."""
    out = F.lit(None).cast("bigint")
    for m in short:
        out = F.when(F.size(hashes) == m, _gram(hashes, F.lit(0), m, m)).otherwise(out)
    return out
