"""Shared helpers: tables in the shared scratch folder, and text normalisation."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import scratch_dir

#: White space of the token patterns: blank, tab, LF, VT, FF, CR.
WORD = "[^\\x20\\x09-\\x0D]+"

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LOWER = _UPPER.lower()
_LOWER_TABLE = str.maketrans(_UPPER, _LOWER)


#: Rows that go to Python at a time while a table is written: whole texts may be long.
BATCH_ROWS = 1000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Makes Spark drop the shuffle files of a query as soon as it has ended, not when the driver collects its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    This cuts the lineage: a lost executor costs the tasks it ran, not the
    stages before, and later readers see the very same rows.  The shuffle files
    it was made from go at once, so that those of several tables don't add up.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    rows, cleanup = spark.conf.get(_BATCH), spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_BATCH, str(min(int(rows), BATCH_ROWS) if int(rows) > 0 else BATCH_ROWS))
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", codec).parquet(path)
    finally:
        spark.conf.set(_BATCH, rows)
        spark.conf.set(_CLEANUP, cleanup)
    return spark.read.schema(df.schema).parquet(path)


_MEMORY: dict[str, dict] = {}


def worker_memory(owner: str) -> dict:
    """What this Python worker keeps for an operator from task to task; what it kept for others goes."""
    for other in [o for o in _MEMORY if o != owner]:
        del _MEMORY[other]
    return _MEMORY.setdefault(owner, {})


def tidy(run: Callable[[Iterable], Iterator], owner: str = "") -> Callable[[Iterable], Iterator]:
    """A task's function that begins without what other operators left in its worker and gives unused Arrow memory back.

    Spark keeps idle workers for a minute and uses them again, so what they
    hold adds up over the steps of a pipeline.
    """

    def tidied(batches: Iterable) -> Iterator:
        import pyarrow as pa

        worker_memory(owner)
        yield from run(batches)
        pa.default_memory_pool().release_unused()

    return tidied


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def lower_ascii(column: Column | str) -> Column:
    """Lower-case A-Z only, leaving every other letter as it is."""
    return F.translate(column, _UPPER, _LOWER)


def py_lower_ascii(text: str) -> str:
    return text.lower() if text.isascii() else text.translate(_LOWER_TABLE)


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def crc_mod(key: Column | str, modulus: int) -> Column:
    """crc32 of a key written as text, modulo ``modulus``."""
    return F.crc32(F.col(key).cast("string") if isinstance(key, str) else key.cast("string")) % modulus


#: Rows of a table, and bytes of them written as JSON, up to which it is broadcast.
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 1 << 26


def is_small(df: DataFrame) -> bool:
    """Whether a table, counted and weighed, may be broadcast."""
    rows, weight = df.agg(F.count("*"), F.sum(F.octet_length(F.to_json(F.struct(*df.columns))))).first()
    return rows <= BROADCAST_ROWS and (weight or 0) <= BROADCAST_BYTES


def small(df: DataFrame) -> DataFrame:
    """The table, marked for broadcast if it is small."""
    return F.broadcast(df) if is_small(df) else df


def row_hash() -> Column:
    """Tells rows of one doc_id apart by their text."""
    return F.xxhash64(text_or_empty())


def same_row(left: DataFrame, right: DataFrame) -> Column:
    """Rows with the same doc_id (null equals null) and the same text_hash."""
    return left["doc_id"].eqNullSafe(right["doc_id"]) & (left["text_hash"] == right["text_hash"])
