"""Blank nodes written where they are used, for any notation that has a form for lists and for nodes in place."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import BLANK, COLUMNS, REST, TYPE
from ..storage import written
from .traverse import list_places

#: Characters of a list or node, and levels of nodes, that are written in place: one value of one row, and brackets that readers count.
IN_PLACE_CHARS, NESTED_LEVELS = 1 << 22, 16


def entry(name: Column, text: str = "text") -> Column:
    """A predicate and an object of a node as written, in the order in which they are written: rdf:type first."""
    return F.struct((F.col("p") != TYPE).alias("later"), "p", F.col(text).alias("text"), name.alias("name"))


def nest(rows: DataFrame, item: Column, name: Column, list_text: Callable[[Column], Column], node_text: Callable[[Column], Column], types: bool = True) -> DataFrame:
    """Rows (quads with ``text``, the object as written) without the blank nodes that are written in place.

    ``item`` writes an object, ``name`` a predicate; ``list_text`` makes a list
    from its written items, ``node_text`` a node from its entries.  Lists of
    plain items come first, then other nodes from the innermost outwards.  What
    is large, deep, in a circle, used more than once or in another graph keeps
    its rows and its label, by which readers find it (in other documents too,
    with a ``scope``); with ``types`` False, so does a class.
    """
    none = lambda c: F.coalesce(c, F.lit(""))
    rows = written(rows.select(*COLUMNS, "text"), "nest-rows")
    used = rows.where(F.col("o_kind") == BLANK).groupBy(F.col("o").alias("node")).agg(F.count("*").alias("uses"), F.min(none("g")).alias("in_g"), F.max(F.col("p") == REST).alias("in_list"), F.max(F.col("p") == TYPE).alias("in_type"), F.max((F.col("s_kind") == BLANK) & (F.col("s") == F.col("o"))).alias("in_self"))
    own = rows.where(F.col("s_kind") == BLANK).groupBy(F.col("s").alias("node")).agg(F.count("*").alias("size"), F.min(none("g")).alias("least_g"), F.max(none("g")).alias("most_g"))
    names = rows.where(F.col("g_kind") == BLANK).select(F.col("g").alias("node")).distinct()
    once = used.join(own, "node", "left").where("uses = 1 and not in_self and (size is null or (least_g = in_g and most_g = in_g))").join(names, "node", "left_anti")
    once = written(once.where("true" if types else "not in_type").select("node", "in_list", F.coalesce("size", F.lit(0)).alias("size")), "nest-once")

    places = written(list_places(rows.select(*COLUMNS)).join(once.select("node", "in_list", "size"), "node", "left").withColumn("text", item), "nest-places")
    good = F.count_if((F.col("size") == 2) & (F.col("in_list") == (F.col("position") > 0)) & (F.col("o_kind") != BLANK))
    fit = places.groupBy("head").agg(F.count("*").alias("n"), good.alias("good"), F.sum(F.length("text") + 1).alias("chars")).where(f"n = good and chars <= {IN_PLACE_CHARS}").select("head")
    texts = places.join(fit, "head", "left_semi").groupBy(F.col("head").alias("node")).agg(F.sort_array(F.collect_list(F.struct("position", "text"))).alias("items"))
    texts = texts.select("node", list_text(F.transform("items", lambda i: i["text"])).alias("inner"))
    texts = written(texts, "nest-lists")
    gone = places.join(texts.select(F.col("node").alias("head")), "head", "left_semi").select("node")

    def folded(rows: DataFrame, texts: DataFrame, gone: DataFrame) -> DataFrame:
        kept = rows.join(gone.select(F.lit(BLANK).cast("byte").alias("s_kind"), F.col("node").alias("s")), ["s_kind", "s"], "left_anti")
        joined = kept.join(texts, (F.col("o_kind") == BLANK) & (F.col("o") == F.col("node")), "left")
        return written(joined.withColumn("text", F.coalesce("inner", "text")).withColumn("open", F.col("open") & F.col("inner").isNull()).select(*COLUMNS, "text", "open"), "nest-rows")

    rows = folded(rows.withColumn("open", F.col("o_kind") == BLANK), texts, gone)
    pending = written(once.where("not in_list").select("node").join(texts, "node", "left_anti"), "nest-pending")
    for _ in range(NESTED_LEVELS):
        held = rows.where("open").join(pending, F.col("o") == F.col("node"), "left_semi").select(F.col("s").alias("node"))
        leaf = written(pending.join(held, "node", "left_anti"), "nest-leaves")
        if leaf.isEmpty():
            break
        entries = F.sort_array(F.collect_list(F.when(F.col("p").isNotNull(), entry(name))))
        own = leaf.join(rows.where(F.col("s_kind") == BLANK).withColumnRenamed("s", "node"), "node", "left")
        chars = F.sum(F.coalesce(F.length("text") + F.length(name) + 4, F.lit(0))).alias("chars")
        fit = written(own.groupBy("node").agg(chars).where(f"chars <= {IN_PLACE_CHARS}").select("node"), "nest-fit")
        texts = own.join(fit, "node", "left_semi").groupBy("node").agg(entries.alias("entries"))
        rows = folded(rows, texts.select("node", node_text(F.col("entries")).alias("inner")), fit)
        pending = written(pending.join(leaf, "node", "left_anti"), "nest-pending")
    return rows
