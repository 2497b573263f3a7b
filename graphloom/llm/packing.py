"""Packing documents into fixed-length training sequences.

Shortest-pack-first over the length histogram: every document is cut into full
pieces of ``max_tokens`` and a remainder; the histogram of piece lengths (at
most ``max_tokens`` rows, whatever the corpus) is packed on the driver, longest
length first, each time into the emptiest packs that it fits.  A pack here is a
*pattern* with a count, so the work depends on the number of lengths alone.
The patterns are then joined back to the pieces by their rank within a length.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import text_or_empty, tidy, written
from .tokens import default_vocabulary, encoder

#: Parts that the pieces of one length are ranked in, so that no length is one task's work.
RANK_PARTS = 1024
#: Words in each half of a worker's memory: few, as workers of earlier stages may still hold theirs.
HELD_WORDS = 120_000


def pack_histogram(counts: dict[int, int], max_tokens: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths, number of packs) for a histogram of lengths.

    Lengths go longest first; each goes into the shortest packs so far that it
    fits, splitting a pattern where only some of its packs are needed, and
    opens new packs for what is left.
    """
    room: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)
    free: list[int] = []  # negative room, the emptiest first

    def put(pattern: tuple[int, ...], n: int) -> None:
        left = max_tokens - sum(pattern)
        if left not in room or not room[left]:
            heapq.heappush(free, -left)
        room[left].append((pattern, n))

    for length in sorted(counts, reverse=True):
        todo = counts[length]
        while todo and free and -free[0] >= length:
            left = -free[0]
            pattern, n = room[left].pop()
            if not room[left]:
                heapq.heappop(free)
            used = min(n, todo)
            put((*pattern, length), used)
            if n > used:
                put(pattern, n - used)
            todo -= used
        if todo:
            per = max_tokens // length
            if todo >= per:
                put((length,) * per, todo // per)
            if todo % per:
                put((length,) * (todo % per), 1)
    merged: dict[tuple[int, ...], int] = defaultdict(int)
    for packs in room.values():
        for pattern, n in packs:
            merged[pattern] += n
    return sorted(merged.items(), key=lambda x: (-sum(x[0]), x[0]))


def placement_table(patterns: list[tuple[tuple[int, ...], int]]) -> pd.DataFrame:
    """One row per pattern slot: ranks [rank, next) of a length go to sequences from ``sequence`` on."""
    rows, used, base = [], defaultdict(int), 0
    for pattern, n in patterns:
        at = 0
        for length in pattern:
            rows.append((length, used[length], base, at))
            used[length] += n
            at += length
        base += n
    return pd.DataFrame(rows, columns=["length", "rank", "sequence", "offset"]).sort_values(["length", "rank"]).reset_index(drop=True)


def _pieces(vocabulary: str, end_id: int, max_tokens: int, batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    from pyspark import TaskContext

    enc, end = encoder(vocabulary, HELD_WORDS), np.array([end_id], "<u2").tobytes()
    uid = TaskContext.get().partitionId() << 36
    for batch in batches:
        out = defaultdict(list)
        for doc_id, text in zip(batch.doc_id.tolist(), batch.text.tolist(), strict=True):
            ids = enc.encode(text) + end
            total = len(ids) // 2
            for start in range(0, total, max_tokens):
                piece = ids[2 * start : 2 * (start + max_tokens)]
                for k, v in (("uid", uid), ("doc_id", None if doc_id is None else int(doc_id)), ("start", start), ("length", len(piece) // 2), ("doc_tokens", total), ("ids", piece)):
                    out[k].append(v)
                uid += 1
        if out:
            yield pd.DataFrame(dict(out) | {"doc_id": pd.array(out["doc_id"], "Int64")})


PIECE_SCHEMA = "uid long, doc_id long, start long, length int, doc_tokens long, ids binary"


def pack_documents(docs: DataFrame, max_tokens: int = 2048, vocabulary: str | None = None, end_id: int = 1) -> DataFrame:
    """Pack ``docs`` (doc_id, text) into sequences of at most ``max_tokens`` ids.

    Returns one row per piece: doc_id, start, length, doc_tokens, sequence_id,
    offset and ids (16-bit little-endian).  A null or empty text is its end id
    alone; repeated rows and null ids are packed like any other row; an empty
    table gives no rows; other columns are ignored; a text of any length is cut
    into pieces.  Ties within a length are ranked by (doc_id, start, a row
    number given when the pieces are written), so the written pieces have one
    placement only.
    """
    spark, vocabulary = docs.sparkSession, vocabulary or default_vocabulary()
    # as decimals the ids reach Python as exact integers or None
    rows = docs.select(F.col("doc_id").cast("decimal(20,0)").alias("doc_id"), text_or_empty().alias("text"))
    pieces = written(rows.mapInPandas(tidy(lambda it: _pieces(vocabulary, end_id, max_tokens, it), "tokens"), PIECE_SCHEMA), "packing-pieces", "lz4")

    keys = pieces.select("uid", "doc_id", "start", "length").withColumn("part", F.pmod(F.xxhash64("uid"), F.lit(RANK_PARTS)).cast("int"))
    sizes = keys.groupBy("length", "part").agg(F.count("*").alias("n"))
    counts = {r.length: r.n for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots = placement_table(pack_histogram(counts, max_tokens))
    first = slots["length"].to_numpy(np.int64) << 44 | slots["rank"].to_numpy(np.int64)
    sequence, offset = slots["sequence"].to_numpy(np.int64), slots["offset"].to_numpy(np.int64)
    table = spark.sparkContext.broadcast((first, sequence, offset))  # a few slots per length: bounded by max_tokens, not by the corpus

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        firsts, sequences, offsets = table.value
        rank = rank.to_numpy(np.int64)
        at = np.searchsorted(firsts, length.to_numpy(np.int64) << 44 | rank, "right") - 1
        return pd.DataFrame({"sequence_id": sequences[at] + rank - (firsts[at] & ((1 << 44) - 1)), "offset": offsets[at]})

    before = sizes.select("length", "part", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("before"))
    ranked = keys.withColumn("inside", F.row_number().over(Window.partitionBy("length", "part").orderBy("doc_id", "start", "uid")) - 1)
    placed = ranked.join(before, ["length", "part"]).select("uid", place("length", F.col("before") + F.col("inside")).alias("at"))
    return pieces.join(placed, "uid").select("doc_id", "start", F.col("length").cast("long").alias("length"), "doc_tokens", "at.sequence_id", "at.offset", "ids")
