"""Divergence of sources from each other and from their language, by joint count histograms.

Terms are counted within tasks (a running table per task, closed when it is
full) and shuffled as sums.  The counts of a term in the groups of its language
make one row.  For a pair of groups only the pairs of counts matter, not the
terms: each task tallies how many of its terms have which two counts in which
two groups, and only those tallies are shuffled.  Cells with a zero are never
met as rows: they are what is left of a group's own histogram, and of the
vocabulary, once the met cells are taken off.  The divergence is then evaluated
once per cell and multiplied.

All arithmetic is whole: probabilities are billionths, products that outgrow 64
bits are decimals.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import small, text_or_empty, written

#: Documents of a language that must hold a term for it to be kept.
MIN_DOCS = 3
#: Terms that are reported for each group.
TOP = 200
#: Terms, and cells, that a task holds at most before it hands them on.
HELD_TERMS, HELD_CELLS = 500_000, 500_000
#: Pairs of groups of one term that are laid out at a time.
PAIRS_AT_ONCE = 200_000
#: Parts into which a group is dealt for its first ranking.
PARTS = 64
BILLION = 1_000_000_000
#: Lower-cases A-Z and blanks the other bytes that are in no term; bytes of other letters stay.
_PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if b >= 0x80 or 97 <= b <= 122 else 32 for b in range(256))
_COUNTS = "lang string, source string, term string, n long, docs long"


def _count_terms(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, docs) of lower-cased texts, summed within the task."""
    n: dict[tuple[str, str], Counter] = {}
    docs: dict[tuple[str, str], Counter] = {}

    def told() -> Iterator[pa.RecordBatch]:
        for (lang, source), counts in n.items():
            held, pairs = docs[lang, source], iter(counts.items())
            while part := list(islice(pairs, 50_000)):
                terms, times = zip(*part, strict=True)
                columns = [pa.repeat(lang, len(terms)), pa.repeat(source, len(terms)), pa.array(terms, pa.binary()).cast(pa.string()), pa.array(times, pa.int64()), pa.array(map(held.__getitem__, terms), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "docs"])

    for batch in batches:
        texts = batch.column("text").cast(pa.binary())
        for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), texts, strict=True):
            found = text.as_py().translate(_PLAIN).split()
            n.setdefault((lang, source), Counter()).update(found)
            docs.setdefault((lang, source), Counter()).update(set(found))
        if sum(map(len, n.values())) > HELD_TERMS:
            yield from told()
            n, docs = {}, {}
    yield from told()


def _cells(parts: list[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(parts, ignore_index=True).groupby(["lang", "a", "b", "ca", "cb"], sort=False, as_index=False).n.sum()


def _tally(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, a, b, ca, cb, n): terms with count ca > 0 in source a and cb > 0 in source b, a before b; summed within the task.

    Rows are terms with the sorted ``sources`` that hold them and their ``counts``.
    """
    names: dict[str, int] = {}  # sources and languages met by this task
    held: list[pd.DataFrame] = []
    rows = 0

    def told(cells: pd.DataFrame) -> Iterator[pa.RecordBatch]:
        of = np.array(list(names), object)
        for at in range(0, len(cells), 50_000):
            part = cells.iloc[at : at + 50_000]
            columns = [pa.array(of[part[c].to_numpy()], pa.string()) for c in ("lang", "a", "b")] + [pa.array(part[c].to_numpy(), pa.int64()) for c in ("ca", "cb", "n")]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "a", "b", "ca", "cb", "n"])

    def codes(texts: pa.Array) -> np.ndarray:
        coded = texts.dictionary_encode()
        known = np.array([names.setdefault(x, len(names)) for x in coded.dictionary.to_pylist()], np.int64)
        return known[coded.indices.to_numpy(zero_copy_only=False)] if len(known) else np.zeros(0, np.int64)

    for batch in batches:
        lang, sources, counts = (batch.column(c) for c in ("lang", "sources", "counts"))
        size = sources.value_lengths().to_numpy(zero_copy_only=False)
        start = np.concatenate(([0], np.cumsum(size)[:-1])).astype(np.int64)
        source, count, lang = codes(sources.flatten()), counts.flatten().to_numpy(zero_copy_only=False), codes(lang)
        for k in np.unique(size[size > 1]):  # terms that are in k sources, side by side
            at, i = np.flatnonzero(size == k), 0
            while i < k - 1:  # pairs (i, any later one), several i at a time
                j = i + 1
                while j < k - 1 and (j - i) * (k - i) * len(at) < PAIRS_AT_ONCE:
                    j += 1
                one = np.concatenate([np.full(k - 1 - x, x) for x in range(i, j)])
                two = np.concatenate([np.arange(x + 1, k) for x in range(i, j)])
                x, y = (start[at][:, None] + one).ravel(), (start[at][:, None] + two).ravel()
                held.append(_cells([pd.DataFrame({"lang": np.repeat(lang[at], len(one)), "a": source[x], "b": source[y], "ca": count[x], "cb": count[y], "n": 1})]))
                rows, i = rows + len(held[-1]), j
                if rows > HELD_CELLS:
                    held = [_cells(held)]
                    if len(held[0]) > HELD_CELLS // 2:
                        yield from told(held[0])
                        held = []
                    rows = sum(map(len, held))
    if held:
        yield from told(_cells(held))


def billionths(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(10^9 (count + 1) / (total + terms)), exact for counts of any size; null where there is no term."""
    part = (count + 1).cast("decimal(20,0)") * F.lit(BILLION).cast("decimal(10,0)")
    return 1 + F.call_function("div", part, F.nullif(total + terms, F.lit(0).cast("long")).cast("decimal(20,0)"))


def divergence(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q) of billionths, which 64 bits hold."""
    return F.call_function("div", (p - q) * (p - q), q)


def term_rows(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The kept terms, (lang, term, n_lang, sources, counts), and the groups, (lang, source, terms, total, total_lang).

    Every occurring group has a row, also without a term; its ``terms`` are
    those that its language keeps.
    """
    or_empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = docs.select(or_empty("lang"), or_empty("source"), text_or_empty().alias("text"))
    # one shuffle by language and term serves both sums; rare terms go before lists are made
    counts = rows.mapInArrow(_count_terms, _COUNTS).repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    common = counts.withColumn("docs", F.sum("docs").over(Window.partitionBy("lang", "term"))).where(F.col("docs") >= MIN_DOCS)
    kept = common.groupBy("lang", "term").agg(F.sum("n").alias("n_lang"), F.sort_array(F.collect_list(F.struct("source", "n"))).alias("v"))
    kept = written(kept.select("lang", "term", "n_lang", F.col("v.source").alias("sources"), F.col("v.n").alias("counts")), "divergence-terms")
    langs = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("n_lang").alias("total_lang"))
    totals = exploded(kept).groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = rows.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return kept, written(groups.select("lang", "source", zero("terms"), zero("total"), zero("total_lang")), "divergence-groups")


def exploded(kept: DataFrame) -> DataFrame:
    """(lang, term, n_lang, source, n): a row for each group that holds a term."""
    return kept.select("lang", "term", "n_lang", F.explode(F.arrays_zip("sources", "counts")).alias("x")).select("lang", "term", "n_lang", F.col("x.sources").alias("source"), F.col("x.counts").alias("n"))


def joint_cells(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, a, b, ca, cb, n): kept terms of a language with each pair of counts in two of its sources, zeros included.

    Terms that neither holds, and those that one lacks, are implied: the met
    cells are taken from the histograms of both groups and from the vocabulary.
    """
    cell = lambda ca, cb, n: F.struct(ca.alias("ca"), cb.alias("cb"), n.alias("n"))
    none, ca, cb, n = F.lit(0).cast("long"), F.col("ca"), F.col("cb"), F.col("n")
    met = kept.where(F.size("sources") > 1).select("lang", "sources", "counts").mapInArrow(_tally, "lang string, a string, b string, ca long, cb long, n long")
    met = met.groupBy("lang", "a", "b", "ca", "cb").agg(F.sum("n").alias("n"))
    key = ["lang", "a", "b"]
    parts = met.select(*key, F.explode(F.array(cell(ca, cb, n), cell(ca, none, -n), cell(none, cb, -n), cell(none, none, n))).alias("x"))
    names = small(groups.select("lang", "source"))
    pairs = groups.select("lang", F.col("source").alias("a"), "terms").join(names.withColumnRenamed("source", "b"), "lang").where("a < b")
    pairs = written(pairs, "divergence-pairs")
    histogram = written(exploded(kept).groupBy("lang", "source", F.col("n").alias("c")).agg(F.count("*").alias("n")), "divergence-histograms")
    for side, own in (("a", cell(F.col("c"), none, n)), ("b", cell(none, F.col("c"), n))):
        parts = parts.unionByName(pairs.join(histogram.withColumnRenamed("source", side), ["lang", side]).select(*key, F.explode(F.array(own, cell(none, none, -n))).alias("x")))
    parts = parts.unionByName(pairs.select(*key, cell(none, none, F.col("terms")).alias("x")))
    return parts.groupBy(*key, F.col("x.ca").alias("ca"), F.col("x.cb").alias("cb")).agg(F.sum("x.n").alias("n"))


def pair_values(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value) for each ordered pair of sources of a language."""
    sizes = small(groups.select("lang", "source", "terms", "total"))
    side = lambda x: sizes.select("lang", F.col("source").alias(x), F.col("terms").alias("terms_" + x), F.col("total").alias("total_" + x))
    cells = joint_cells(kept, groups).join(side("a"), ["lang", "a"]).join(side("b"), ["lang", "b"])
    p, q = (billionths(F.col("c" + x), F.col("total_" + x), F.col("terms_" + x)) for x in ("a", "b"))
    cells = cells.select("lang", "a", "b", "n", p.alias("p"), q.alias("q"))
    worth = lambda p, q: F.sum(F.when(F.col("n") > 0, divergence(F.col(p), F.col(q)) * F.col("n")).otherwise(0))
    both = cells.groupBy("lang", "a", "b").agg(worth("p", "q").alias("ab"), worth("q", "p").alias("ba"))
    way = lambda source, item, value: F.struct(F.col(source).alias("source"), F.col(item).alias("item"), F.col(value).alias("value"))
    return both.select("lang", F.explode(F.array(way("a", "b", "ab"), way("b", "a", "ba"))).alias("x")).select("lang", "x.*")


def term_values(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value) for each term that a group holds more of than its language."""
    rows = exploded(kept).join(small(groups), ["lang", "source"])
    p, q = billionths(F.col("n"), F.col("total"), F.col("terms")), billionths(F.col("n_lang"), F.col("total_lang"), F.col("terms"))
    return rows.select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q")).where("p > q").select("lang", "source", "item", divergence(F.col("p"), F.col("q")).alias("value"))


def _ranked(rows: DataFrame, *more: str) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source", *more).orderBy(F.desc("value"), "item")))


def audit_sources(docs: DataFrame, top: int = TOP) -> DataFrame:
    """How far each (lang, source) group is from the other sources of its language, and by which terms from the language.

    Rows (lang, source, part, item, value, rank): part ``pair`` has every other
    source, part ``term`` the ``top`` terms.  Ties are ordered by the item.  Null
    text, lang and source are ''.  A group without a term still takes part (all
    its counts are zero); a language that keeps no term gives pairs of value 0.
    Repeated rows each count; an empty table gives no row; other columns are
    ignored; whole texts are read.
    """
    kept, groups = term_rows(docs)
    pairs = _ranked(pair_values(kept, groups)).withColumn("part", F.lit("pair"))
    # a large group is first ranked in parts
    parts = _ranked(term_values(kept, groups).withColumn("deal", F.pmod(F.xxhash64("item"), F.lit(PARTS))), "deal").where(F.col("rank") <= top).drop("deal", "rank")
    terms = _ranked(parts).where(F.col("rank") <= top).withColumn("part", F.lit("term"))
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.select(*columns).unionByName(terms.select(*columns))
