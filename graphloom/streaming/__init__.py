"""Streams of quads: files that arrive in a folder are read, filtered and written on.

Reading is ``sources.nquads.read_stream``; every operator without a loop or a
global order works on its result as on a table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.terms import quad_text
from ..schema import COLUMNS


def counts(quads: DataFrame, time: str, window: str = "1 minute", late: str = "5 minutes") -> DataFrame:
    """(start, p, n): quads per predicate and window of the column ``time``; rows later than ``late`` are left out."""
    return quads.withWatermark(time, late).groupBy(F.window(time, window).alias("w"), "p").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "p", "n")


def distinct(quads: DataFrame, time: str, late: str = "5 minutes") -> DataFrame:
    """Each quad once within the watermark, whatever files repeat it."""
    return quads.withWatermark(time, late).dropDuplicatesWithinWatermark(COLUMNS)


def write_lines(quads: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """A running query that appends the quads as N-Quads files, exactly once by its checkpoint."""
    return quads.select(quad_text().alias("value")).writeStream.format("text").option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start(path)
