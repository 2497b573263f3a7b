"""Interaction of quality filters, in every order, from signed parity sums.

A document's failures are a mask with a bit per filter.  For each part and
pair of labels one aggregation takes the Walsh-Hadamard sums of the masks: for
every subset s of the filters, +1 for a document that fails an even number of
s and -1 for an odd one.  The transform is its own inverse up to a factor, so
the sums give back exactly how many documents have each mask.  All orders of
the filters, and Shapley's shares, then follow from those few counts; no
document is looked at again.

Only narrow rows (doc_id, part, digest, mask) are shuffled.  A part of any size
is summed within tasks first; copies of a text meet as one least doc_id per
task, and a document finds out whether it is that first one by joining on its
digest *and* its doc_id, so that no group of copies meets in one task.
"""

from __future__ import annotations

import math
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty, written

LETTERS = "ABCDE"


def text_failures(text: Column) -> Column:
    """Bits of the filters that a text decides alone: A short, B repetitive, C capitals, D symbols."""
    words = F.array_remove(F.split(text, "[\\x20\\x09-\\x0D]+"), "")
    n, distinct = F.size(words).cast("long"), F.size(F.array_distinct(words)).cast("long")
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long")
    fails = [n < 200, 100 * distinct < 50 * n, 100 * capitals > 2 * F.length(text).cast("long"), text.rlike("[#$%&*|]")]
    return sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails)), F.lit(0))


def failure_masks(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """(part, mask, good, toxic), a row per document: bits 0 to 4 are A to E.

    E is a copy of a text with a smaller doc_id; ``good`` and ``toxic`` (0 or 1)
    tell whether any label of the doc_id says so.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), text_or_empty().alias("text"))
    rows = written(rows.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), text_failures(F.col("text")).alias("mask")), "audit-rows")
    # rows without a doc_id are no one's copies and have no label; they may be many and stay out of the joins
    known, nameless = rows.where("doc_id is not null"), rows.where("doc_id is null")
    first = known.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("is_first", F.lit(True))
    said = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)).cast("int")).alias(c)
    told = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(said("quality"), said("toxic"))
    joined = known.join(first, ["digest", "doc_id"], "left").join(told, "doc_id", "left")
    mask = F.when(F.col("is_first"), F.col("mask")).otherwise(F.col("mask") + (1 << 4))
    bit = lambda c: F.coalesce(c, F.lit(0))
    joined = joined.select("part", mask.alias("mask"), bit("quality").alias("good"), bit("toxic").alias("toxic"))
    return joined.unionByName(nameless.select("part", "mask", F.lit(0).alias("good"), F.lit(0).alias("toxic")))


def _sign(both: Column) -> Column:
    """1 for an even number of bits, -1 for an odd one."""
    return 1 - 2 * (F.bit_count(both) % 2)


def parity_sums(masks: DataFrame, keys: list[str], filters: int) -> DataFrame:
    """(keys, w): the 2^filters signed parity sums of ``mask``, one aggregation."""
    sums = [F.sum(_sign(F.col("mask").bitwiseAND(s)).cast("long")).alias(f"w{s}") for s in range(1 << filters)]
    return masks.groupBy(*keys).agg(*sums).select(*keys, F.array(*[f"w{s}" for s in range(1 << filters)]).alias("w"))


def mask_cells(sums: DataFrame, keys: list[str], filters: int) -> DataFrame:
    """(keys, cells): documents of each mask, the sums inverted; a remainder, which no sums of masks leave, is an error."""
    last = (1 << filters) - 1
    whole = F.expr(f"transform(sequence(0, {last}), m -> aggregate(sequence(0, {last}), 0L, (acc, s) -> acc + (1 - 2 * (bit_count(m & s) % 2)) * w[s]))")
    exact = F.expr(f"transform(whole, x -> if(x % {last + 1} = 0, x div {last + 1}, raise_error('parity sums of no table')))")
    return sums.select(*keys, whole.alias("whole")).select(*keys, exact.alias("cells"))


def orders_of(cells: DataFrame, letters: str = LETTERS) -> DataFrame:
    """A row for every part, order and step, from (part, good, toxic, cells).

    ``clear[p]`` counts the documents that fail none of the filters in p; every
    number of a step is a difference of two of them.
    """
    n, last = len(letters), (1 << len(letters)) - 1
    total = lambda name, when: F.array(*[F.sum(F.when(when, F.get("cells", m)).otherwise(0)).alias(f"{name}{m}") for m in range(last + 1)]).alias(name)
    parts = cells.groupBy("part").agg(total("all", F.lit(True)), total("good", F.col("good") == 1), total("toxic", F.col("toxic") == 1))
    clear = lambda c: F.expr(f"transform(sequence(0, {last}), p -> aggregate(sequence(0, {last}), 0L, (acc, m) -> acc + if(m & p = 0, {c}[m], 0L)))").alias(f"{c}_clear")
    share = lambda f: sum((F.get("all", m) * (math.factorial(n) // m.bit_count()) for m in range(1, last + 1) if m >> f & 1), F.lit(0).cast("long"))
    parts = parts.select("part", "all", clear("all"), clear("good"), clear("toxic"), F.array(*[share(f) for f in range(n)]).alias("shares"))
    names = ",".join("".join(p) for p in permutations(letters))
    rows = parts.select("*", F.explode(F.split(F.lit(names), ",")).alias("filter_order")).select("*", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("step"))
    before = F.substring("filter_order", F.lit(1), F.col("step") - 1)
    mask = sum((F.when(before.contains(x), 1 << i).otherwise(0) for i, x in enumerate(letters)), F.lit(0))
    rows = rows.withColumn("f", F.instr(F.lit(letters), F.substring("filter_order", F.col("step"), F.lit(1))) - 1).withColumn("before", mask)
    rows = rows.withColumn("bit", F.expr("shiftleft(1, f)")).withColumn("after", F.col("before").bitwiseOR(F.col("bit")))
    gone = lambda c: F.get(f"{c}_clear", "before") - F.get(f"{c}_clear", "after")
    failing = F.get("all_clear", F.lit(0)) - F.get("all_clear", "bit")
    return rows.select(
        "part", "filter_order", "step", F.get("all_clear", "after").alias("kept"), gone("all").alias("removed"), (failing - gone("all")).alias("redundant"),
        F.get("all", "bit").alias("unique_fails"), gone("good").alias("good_lost"), gone("toxic").alias("toxic_lost"), F.get("shares", "f").alias("shapley"),
    )


def audit_filters(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """What each of five filters removes in every order of them, for every part.

    One row per part, order (all 120) and step: kept, removed, redundant,
    unique_fails, good_lost, toxic_lost, shapley.  A null text is the empty text
    (which is short, and a copy of any other empty one); a null part is ''.
    Repeated rows each count; rows of one doc_id are never copies of each other;
    a row without a doc_id is no copy and has no label.  A doc_id with several
    labels is good, or toxic, if one says so.  An empty table gives no row;
    other columns are ignored; whole texts are read.
    """
    keys = ["part", "good", "toxic"]
    sums = parity_sums(failure_masks(docs, labels, part), keys, len(LETTERS))
    return orders_of(mask_cells(sums, keys, len(LETTERS)))
