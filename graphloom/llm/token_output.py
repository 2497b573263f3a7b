"""Token-ID output: an adaptive context-mixing range coder over blocks of ids.

A block holds whole documents.  Its ids are split into lanes, coded side by
side with one shared model, so that a step of the coder is a few vector
operations.  The model mixes three predictions of the next id:

* order 0: counts of all ids so far, spread over the whole id range;
* order 1: the id that last followed the id before, with a confidence;
* order 2: the same for the two ids before (a hashed table).

A point prediction weighs as much as its confidence has earned in this block
(hits against misses).  The mixture drives a carry-less 64-bit range coder
that emits 32-bit words.  Each block starts from an empty model and carries a
CRC-32, so that any block can be read alone and damage is noticed.

Block layout (little-endian): magic ``GLTB``, version u16, lanes u16, number of
documents u32, number of ids u32, length u32 of the deflated document table
(doc_id i64, null flag u8, n_tokens u32 each), that table, words per lane u32,
the words of all lanes, CRC-32 of everything before.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small, text_or_empty, written
from .tokens import default_vocabulary, encoder

MAGIC, VERSION = b"GLTB", 2
HEAD = struct.Struct("<4sHHIII")
#: Ids after which a block is closed at the next end of a document.
BLOCK_IDS = 1 << 22
#: Bytes of text for which a file is written.
FILE_BYTES = 1 << 24
#: Most lanes of a block, and the ids a lane has at least.  Wide steps cost less: more of each is arithmetic.
LANES, LANE_IDS = 16384, 256
#: Total weight of the order-0 counts, and the most steps between renewals of the weights.
BASE, RENEW = 1 << 20, 64
#: Levels of confidence in a point prediction, and bits of the hash of two ids.
LEVELS, HASH_BITS = 16, 17
_IDS = 1 << 16
_PAIR = np.int32(-1640531527), np.int32(40503 << 15 | 1)
#: What a point prediction gains when right (second half) and loses when wrong; at level 0 the id is replaced.
_STEP = np.array([-((k + 1) // 2) << 16 for k in range(LEVELS)] + [(k < LEVELS - 1) << 16 for k in range(LEVELS)], np.int32)
_LOW = np.uint64((1 << 32) - 1)
_W = np.uint64(32)
_ONE32 = np.uint64(1 << 32)


class _Model:
    """The adaptive predictions; coder and decoder feed it the same ids.

    A point prediction is one number: the id, and above it the confidence.
    Counts and earned weights are renewed after 1, 2, 4, ... steps and then every
    ``RENEW`` ones.
    """

    def __init__(self, lanes: int, decodes: bool) -> None:
        self.decodes = decodes
        self.counts = np.zeros(_IDS, np.int64)
        self.points = np.zeros(_IDS, np.int32), np.zeros(1 << HASH_BITS, np.int32)
        self.hits = np.full((2, LEVELS), 0.5)
        self.misses = np.full((2, LEVELS), 16.0)
        self.recent: list[np.ndarray] = []
        self.met: tuple[list[np.ndarray], list[np.ndarray]] = ([], [])
        self.last, self.pair = np.zeros(lanes, np.int32), np.zeros(lanes, np.int32)
        self.steps = self.due = 0

    def _renew(self) -> None:
        if self.recent:
            self.counts += np.bincount(np.concatenate(self.recent), minlength=_IDS)
            for k in (0, 1):
                met = np.bincount(np.concatenate(self.met[k]), minlength=2 * LEVELS)
                self.misses[k] += met[:LEVELS]
                self.hits[k] += met[LEVELS:]
                self.met[k].clear()
            self.recent.clear()
        freq = (self.counts * ((BASE - _IDS) / max(int(self.counts.sum()), 1))).astype(np.int32) + 1
        freq[0] += BASE - int(freq.sum())
        self.freq, self.cum = freq, np.cumsum(freq, dtype=np.int32) - freq
        if self.decodes:
            self.slots = np.repeat(np.arange(_IDS, dtype=np.uint16), freq)
        self.weights = (np.minimum(self.hits / self.misses, 64.0) * BASE).astype(np.int32)
        self.due += min(max(self.due, 1), RENEW)

    def predict(self, n: int) -> None:
        """Point predictions and weights for the first ``n`` lanes."""
        if self.steps == self.due:
            self._renew()
        self.steps += 1
        self.at = self.last[:n], self.pair[:n]
        self.held = [table.take(at, mode="clip") for table, at in zip(self.points, self.at, strict=True)]
        self.level = [held >> 16 for held in self.held]
        self.guess = [held & 0xFFFF for held in self.held]
        self.mass = [weights.take(level, mode="clip") for weights, level in zip(self.weights, self.level, strict=True)]
        self.total = self.mass[0] + self.mass[1] + BASE

    def interval(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and width of each id within the mixture's total."""
        start, width = self.cum.take(ids, mode="clip"), self.freq.take(ids, mode="clip")
        self.right = [(guess == ids).astype(np.int32) for guess in self.guess]
        for guess, mass, right in zip(self.guess, self.mass, self.right, strict=True):
            start += mass * (guess < ids)
            width += mass * right
        return start, width

    def find(self, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids in whose intervals the values lie, each a guess or that of the order-0 slot, and their intervals."""
        (a, b), (mass_a, mass_b) = self.guess, self.mass
        same = a == b
        start_a, start_b = self.cum.take(a, mode="clip") + mass_b * (b < a), self.cum.take(b, mode="clip") + mass_a * (a < b)
        past_a = value >= start_a + self.freq.take(a, mode="clip") + mass_a + mass_b * same
        past_b = value >= start_b + self.freq.take(b, mode="clip") + mass_b + mass_a * same
        before = mass_a * past_a + mass_b * past_b  # of the guesses below the id
        ids = self.slots.take(value - before, mode="clip").astype(np.int32)
        in_a, in_b = (value >= start_a) > past_a, (value >= start_b) > past_b
        np.copyto(ids, a, where=in_a)
        np.copyto(ids, b, where=in_b)
        self.right = [in_a.astype(np.int32), in_b.astype(np.int32)]
        return ids, self.cum.take(ids, mode="clip") + before, self.freq.take(ids, mode="clip") + mass_a * self.right[0] + mass_b * self.right[1]

    def update(self, ids: np.ndarray) -> None:
        for k in (0, 1):
            held, met = self.held[k], self.level[k] + self.right[k] * LEVELS
            self.met[k].append(met)
            self.points[k][self.at[k]] = held + _STEP.take(met, mode="clip") + (ids - held) * (met == 0)
        n = len(ids)
        pair = (self.last[:n] * _PAIR[0] + ids * _PAIR[1] >> 15) & ((1 << HASH_BITS) - 1)
        self.last, self.pair = (ids, pair) if n == len(self.last) else (np.concatenate((ids, self.last[n:])), np.concatenate((pair, self.pair[n:])))
        self.recent.append(ids)


def _lanes(n: int, lanes: int = 0) -> tuple[int, int, np.ndarray]:
    """Lanes (as many as suit ``n`` ids, if not given), steps and where each lane's run of consecutive ids begins."""
    lanes = lanes or max(1, min(LANES, n // LANE_IDS))
    steps = -(-n // lanes)
    lengths = np.full(lanes, steps)
    lengths[n - lanes * (steps - 1) :] -= 1  # the last lanes have one id less
    return lanes, steps, np.concatenate(([0], np.cumsum(lengths)))


def _narrow(low: np.ndarray, width: np.ndarray, m: int, unit: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The intervals of the first ``m`` lanes narrowed; lanes whose leading word is settled."""
    low[:m] += unit * start.astype(np.uint64)
    width[:m] = unit * size.astype(np.uint64)
    return np.flatnonzero(width[:m] < _ONE32)


def _shifted(low: np.ndarray, width: np.ndarray, tight: np.ndarray) -> np.ndarray:
    """Takes the leading words of the tight lanes off and returns them."""
    a, b = low[tight], width[tight]
    # an interval that spans two leading words is cut to the first
    low[tight], width[tight] = a << _W, np.minimum(b, _ONE32 - (a & _LOW)) << _W
    return a >> _W


def encode_ids(ids: np.ndarray) -> bytes:
    """Words per lane, and the words of all lanes."""
    n = len(ids)
    if not n:
        return b""
    lanes, steps, begin = _lanes(n)
    ids = ids.astype(np.int32)
    model = _Model(lanes, False)
    low, width = np.zeros(lanes, np.uint64), np.full(lanes, ~np.uint64(0))
    words, owners = [], []
    full = n - lanes * (steps - 1)
    for t in range(steps):
        m = lanes if t < steps - 1 else full
        now = ids.take(begin[:m] + t)
        model.predict(m)
        start, size = model.interval(now)
        tight = _narrow(low, width, m, width[:m] // model.total.astype(np.uint64), start, size)
        if len(tight):
            words.append(_shifted(low, width, tight).astype("<u4"))
            owners.append(tight.astype(np.uint16))
        model.update(now)
    for _ in range(2):
        words.append((low >> _W).astype("<u4"))
        owners.append(np.arange(lanes, dtype=np.uint16))
        low = low << _W
    owner = np.concatenate(owners)
    return np.bincount(owner, minlength=lanes).astype("<u4").tobytes() + np.concatenate(words)[np.argsort(owner, kind="stable")].tobytes()


def decode_ids(data: bytes, n: int, lanes: int = 0) -> np.ndarray:
    """The ids again; ``lanes`` is how many they were written in, if not what suits ``n`` ids now."""
    if not n:
        return np.zeros(0, "<u2")
    lanes, steps, begin = _lanes(n, lanes)
    fill = np.frombuffer(data, "<u4", lanes).astype(np.int64)
    words = np.concatenate((np.frombuffer(data, "<u4", offset=4 * lanes), np.zeros(2, "<u4"))).astype(np.uint64)
    at = np.cumsum(fill) - fill
    code = words[at] << _W | words[at + 1]
    at = at + 2
    model = _Model(lanes, True)
    low, width = np.zeros(lanes, np.uint64), np.full(lanes, ~np.uint64(0))
    ids = np.zeros(n, "<u2")
    full = n - lanes * (steps - 1)
    for t in range(steps):
        m = lanes if t < steps - 1 else full
        model.predict(m)
        unit = width[:m] // model.total.astype(np.uint64)
        value = np.minimum((code[:m] - low[:m]) // unit, (model.total - 1).astype(np.uint64)).astype(np.int32)
        now, start, size = model.find(value)
        tight = _narrow(low, width, m, unit, start, size)
        if len(tight):
            _shifted(low, width, tight)
            place = at[tight]
            code[tight] = code[tight] << _W | words.take(place, mode="clip")
            at[tight] = place + 1
        model.update(now)
        ids[begin[:m] + t] = now
    return ids


def pack_block(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray) -> bytes:
    """One block; the lengths add up to the number of ids."""
    docs = zlib.compress(np.array([d or 0 for d in doc_ids], "<i8").tobytes() + np.array([d is None for d in doc_ids], "u1").tobytes() + np.array(lengths, "<u4").tobytes(), 6)
    body = HEAD.pack(MAGIC, VERSION, _lanes(len(ids))[0], len(doc_ids), len(ids), len(docs)) + docs + encode_ids(ids)
    return body + struct.pack("<I", zlib.crc32(body))


def unpack_block(block: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Document ids, lengths and ids of a block; raises ValueError on damage."""
    if len(block) < HEAD.size + 4 or zlib.crc32(block[:-4]) != struct.unpack("<I", block[-4:])[0]:
        raise ValueError("token block: wrong checksum")
    magic, version, lanes, n_docs, n_ids, size = HEAD.unpack_from(block)
    if (magic, version) != (MAGIC, VERSION):
        raise ValueError("token block: unknown format")
    docs = zlib.decompress(block[HEAD.size : HEAD.size + size])
    doc_ids = np.frombuffer(docs, "<i8", n_docs).tolist()
    missing = np.frombuffer(docs, "u1", n_docs, 8 * n_docs)
    lengths = np.frombuffer(docs, "<u4", n_docs, 9 * n_docs).astype(np.int64)
    return [None if m else d for d, m in zip(doc_ids, missing, strict=True)], lengths, decode_ids(block[HEAD.size + size : -4], n_ids, lanes)


def _write_blocks(vocabulary: str, end_id: int, batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    from pyspark import TaskContext

    enc, part, seq = encoder(vocabulary), TaskContext.get().partitionId(), 0
    doc_ids: list[int | None] = []
    lengths: list[int] = []
    parts: list[bytes] = []
    held, end = 0, np.array([end_id], "<u2").tobytes()

    def close() -> pd.DataFrame:
        block = pack_block(doc_ids, lengths, np.frombuffer(b"".join(parts), "<u2"))
        return pd.DataFrame({"part": [part], "seq": [seq], "n_docs": [len(doc_ids)], "n_tokens": [held], "block": [block]})

    for batch in batches:
        for doc_id, text in zip(batch.doc_id.tolist(), batch.text.tolist(), strict=True):
            ids = enc.encode(text) + end
            doc_ids.append(None if doc_id is None or doc_id != doc_id else int(doc_id))
            lengths.append(len(ids) // 2)
            parts.append(ids)
            held += len(ids) // 2
            if held >= BLOCK_IDS:
                yield close()
                doc_ids, lengths, parts, held, seq = [], [], [], 0, seq + 1
    if doc_ids:
        yield close()


BLOCK_SCHEMA = "part int, seq int, n_docs long, n_tokens long, block binary"


def write_token_files(docs: DataFrame, vocabulary: str | None = None, end_id: int = 2) -> DataFrame:
    """Encode ``docs`` (doc_id, text) and write block files in doc_id order.

    Returns the written files as a DataFrame (part, seq, n_docs, n_tokens,
    block); (part, seq) ascends with doc_id, nulls first and equal ids in the
    order of a hash of their texts.  Null and empty texts give the end id alone;
    no documents give no blocks.  Other columns are ignored.  A block is closed
    at the end of the document that fills it, so a very long text makes one
    larger block; nothing is cut.  The number of files grows with the bytes of
    the texts, and rows of one doc_id, or of none, are dealt by their texts and
    the partition that they are read in, so no id is one task's work.
    """
    vocabulary = vocabulary or default_vocabulary()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    files = -(-(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // FILE_BYTES)
    keys = ["doc_id", "hash", "part"]
    ordered = rows.withColumn("hash", F.xxhash64("text")).withColumn("part", F.spark_partition_id()).repartitionByRange(max(8, files), *keys).sortWithinPartitions(*keys)
    ordered = ordered.select(F.struct(F.col("doc_id").cast("decimal(20,0)").alias("doc_id"), "text").alias("row")).select("row.doc_id", "row.text")
    return written(ordered.mapInPandas(lambda it: _write_blocks(vocabulary, end_id, it), BLOCK_SCHEMA), "token-blocks", "uncompressed")


def _read_blocks(with_ids: bool, batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for start, block in zip(batch.start.tolist(), batch.block.tolist(), strict=True):
            doc_ids, lengths, ids = unpack_block(block)
            ends = np.cumsum(lengths)
            cuts = [0, *ends.tolist()]
            wide = ids.astype("<u4")
            out = {"doc_id": pd.array(doc_ids, "Int64"), "start": start + ends - lengths, "n_tokens": lengths, "ids_crc32": [zlib.crc32(wide[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]}
            if with_ids:
                out["ids"] = [ids[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            yield pd.DataFrame(out)


def read_token_files(blocks: DataFrame, with_ids: bool = True) -> DataFrame:
    """Decode block files: doc_id, start, n_tokens, ids_crc32, ids (16-bit little-endian).

    ``start`` counts the ids of all documents before: block totals are summed
    within each file and file totals over the files, of which there are as many
    as tasks wrote.  ``ids_crc32`` is the crc32 of the ids as 32-bit integers;
    without ``with_ids`` it is all that is told of them.
    """
    sizes = blocks.select("part", "seq", "n_tokens")
    files = sizes.groupBy("part").agg(F.sum("n_tokens").alias("size"))
    files = files.select("part", (F.sum("size").over(Window.orderBy("part")) - F.col("size")).alias("before"))
    inside = (F.sum("n_tokens").over(Window.partitionBy("part").orderBy("seq")) - F.col("n_tokens")).alias("inside")
    starts = sizes.select("part", "seq", inside).join(files, "part").select("part", "seq", (F.col("before") + F.col("inside")).alias("start"))
    located = blocks.select("part", "seq", "block").join(small(starts), ["part", "seq"]).select("start", "block")
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids binary" if with_ids else "")
    return located.mapInPandas(lambda it: _read_blocks(with_ids, it), schema)
