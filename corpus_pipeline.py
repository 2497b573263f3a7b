"""From raw documents to packed training sequences, one table per stage.

Every stage takes the documents that the stage before kept, in the columns of
``documents``, and its decisions take effect: toxic documents go, one document
of each group of near duplicates stays (the one of smallest doc_id), those
contaminated with benchmark text go, secrets are replaced by a mark.  The last
stage packs what is left.  ``run`` writes each stage's result as Parquet and
reads it again for the next.

Decisions travel as narrow keys (doc_id and a hash of the text) and are joined
to the texts; the key table is broadcast only after it has been counted.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import row_hash, same_row, small, table, written


def _without(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """Documents whose (doc_id, text_hash) is not among the keys."""
    keys = small(written(keys.select("doc_id", "text_hash").distinct(), "stage-keys"))
    marked = docs.withColumn("text_hash", row_hash())
    return marked.join(keys, same_row(marked, keys), "left_anti").select(*docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents not predicted toxic; the labels of the data folder teach."""
    from graphloom.llm.toxicity import score_toxicity

    return _without(docs, score_toxicity(docs, table(spark, sf_dir, "labels")).where("predicted = 1"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: the smallest doc_id, then the smallest text hash.

    A row without doc_id stays only in a group that has none with one; a row
    that repeats both id and text stays once.
    """
    from graphloom.llm.near_dup import near_duplicates

    found = near_duplicates(docs).groupBy("component", "doc_id", "text_hash").agg(F.count("*").alias("n"))
    found = written(found.withColumn("key", F.struct(F.col("doc_id").isNull().alias("blank"), "doc_id", "text_hash")), "stage-groups")
    first = found.groupBy("component").agg(F.min("key").alias("first"), F.count("*").alias("members")).where("members > 1").drop("members")
    kept = _without(docs, found.join(first, "component").where(~F.col("key").eqNullSafe(F.col("first"))))
    repeated = found.where("n > 1").select("doc_id", "text_hash").distinct()
    if repeated.isEmpty():
        return kept
    marked, keys = kept.withColumn("text_hash", row_hash()), small(written(repeated, "stage-keys"))
    once = marked.join(keys, same_row(marked, keys), "left_semi").dropDuplicates(["doc_id", "text_hash"])
    return marked.join(keys, same_row(marked, keys), "left_anti").unionByName(once).select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no more benchmark text than the contamination rule allows."""
    from graphloom.llm.decontaminate import find_contamination

    return _without(docs, find_contamination(docs, table(spark, sf_dir, "benchmark")).where("contaminated"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, every secret span replaced; n_chars follows the text."""
    from graphloom.llm.secret_scan import redact, scan_secrets

    marked = docs.withColumn("text_hash", row_hash())
    found = scan_secrets(marked, keep=["doc_id", "text_hash"]).where(F.size("spans") > 0).dropDuplicates(["doc_id", "text_hash"])
    found = small(written(found, "stage-spans"))
    joined = marked.join(found, same_row(marked, found), "left")
    text = F.when(found["spans"].isNull(), marked["text"]).otherwise(redact(marked["text"], found["spans"]))
    columns = {"text": text, "n_chars": F.when(found["spans"].isNull(), marked["n_chars"]).otherwise(F.length(text)).cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {"text": text}
    return joined.select(*[columns[c].alias(c) if c in columns else marked[c] for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in the sequences, and their ids."""
    from graphloom.llm.packing import pack_documents

    return pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", mask_secrets),
    ("packing", pack),
]

#: SQL can't express the stages: ids of a tokenizer, fitted scores and linked fingerprints.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; returns the packed pieces.

    Null and empty texts pass every stage and pack as their end id alone, but
    for copies of each other, of which one stays.  Ties are decided by doc_id,
    then by a hash of the text; repeated rows stay once; rows without a doc_id
    take part; an empty table gives no piece; columns besides those of
    ``documents`` are carried to the last stage and decide nothing.
    """
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
