"""Language by averaged hashed subword embeddings and a linear softmax.

A text's subwords are the runs of 1 to ``MAX_N`` characters within its words,
word edges included; each is hashed to one of ``BUCKETS`` embeddings.  The
average embedding goes through a linear layer and a softmax.  Both are trained
together by stochastic gradient descent in numpy on the driver, on a sample of
labelled texts whose bound is ``SAMPLE`` (rows in all) and ``PER_LANG``; a row
comes to the driver as its bucket counts, not as text.  A fifth of the sample is
left out of the descent: on it a scale is fitted that makes the score a
probability, growing with the number of subwords, and the threshold of
acceptance is set.

Scoring takes whole texts, in slices: the linear layer is folded into the
embeddings, so a subword is one row of a small table.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import crc_mod, text_or_empty, written

#: Rows that the classifier is fitted on at most: in all, and of one language; and languages that it learns, the most frequent ones.
SAMPLE, PER_LANG, LANGUAGES = 4000, 500, 500
#: Longest subword, buckets, width of an embedding.
MAX_N, BUCKETS, DIM = 4, 1 << 16, 16
EPOCHS, BATCH, RATE, SEED = 5, 32, 4.0, 13
#: Share of correct answers that accepted ones must reach on the left-out rows.
PRECISION = 0.99
#: Words of the shortest and longest piece that a sampled text also gives.
PIECE = (1, 24)
#: Characters that are worked on at a time.
SLICE = 1 << 19
UNKNOWN = "und"


@cache
def _is_letter() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def _codes(text: str) -> np.ndarray:
    """Lower-cased letters as numbers, everything else 0; a 0 in front and MAX_N - 1 behind."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    out = np.zeros(len(codes) + MAX_N, np.uint32)
    np.multiply(codes, _is_letter()[codes], out=out[1 : len(codes) + 1], casting="unsafe")
    return out


def _subwords(codes: np.ndarray, starts: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, buckets) of the subwords of each length that start before ``starts``: all letters but for the edges."""
    letter, hashed, inner = codes != 0, np.zeros(len(codes), np.uint32), np.ones(len(codes), bool)
    for n in range(1, MAX_N + 1):
        size = max(0, min(len(codes) - n + 1, starts))
        hashed = hashed[:size] * np.uint32(0x01000193) + codes[n - 1 : n - 1 + size] + np.uint32(1)
        if n > 2:
            inner = inner[:size] & letter[n - 2 : n - 2 + size]
        good = inner[:size] & (letter[:size] | letter[n - 1 : n - 1 + size]) if n > 1 else letter[:size]
        places = np.flatnonzero(good)
        mixed = (hashed[places] ^ (hashed[places] >> np.uint32(15)) ^ np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)
        yield places, (mixed >> np.uint32(32 - BUCKETS.bit_length() + 1)).astype(np.int64)


def _slices(texts: Iterable[str]) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(codes, number of the text at each place, places that may start a subword), long texts in overlapping parts."""
    held, owners, size = [], [], 0
    for i, text in enumerate(texts):
        codes = _codes(text)
        if len(codes) > SLICE:
            for at in range(0, len(codes), SLICE):
                part = codes[at : at + SLICE + MAX_N - 1]
                yield part, np.full(len(part), i), min(SLICE, len(codes) - at)
            continue
        held.append(codes)
        owners.append(np.full(len(codes), i))
        size += len(codes)
        if size > SLICE:
            yield np.concatenate(held), np.concatenate(owners), size
            held, owners, size = [], [], 0
    if held:
        yield np.concatenate(held), np.concatenate(owners), size


def bucket_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text's subwords, and how many fall into each."""
    total = np.zeros(BUCKETS, np.int64)
    for codes, _, starts in _slices([text]):
        total += np.bincount(np.concatenate([b for _, b in _subwords(codes, starts)]), minlength=BUCKETS)
    held = np.flatnonzero(total)
    return held, total[held]


@dataclass(frozen=True)
class Model:
    langs: list[str]
    table: np.ndarray  # bucket x language: embeddings times the linear layer
    bias: np.ndarray
    scale: tuple[float, float]
    threshold: float

    def answers(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Number of the language (-1: no letter) and calibrated probability for each text."""
        sums, n = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts), np.int64)
        for codes, owner, starts in _slices(texts):
            for places, buckets in _subwords(codes, starts):
                if not len(places):
                    continue
                whose = owner[places]
                first = np.flatnonzero(np.concatenate(([True], whose[1:] != whose[:-1])))
                sums[whose[first]] += np.add.reduceat(self.table[buckets], first, axis=0)
                n[whose[first]] += np.diff(np.append(first, len(places)))
        logits = sums / np.maximum(n, 1)[:, None] + self.bias
        p = probabilities(logits, n, self.scale)
        best = np.where(n > 0, p.argmax(1), -1)
        return best, np.where(n > 0, p.max(1), 0.0)


def probabilities(logits: np.ndarray, n: np.ndarray, scale: tuple[float, float]) -> np.ndarray:
    """Softmax of logits that are scaled by exp(a + b log(1 + subwords))."""
    z = logits * np.exp(scale[0] + scale[1] * np.log1p(n))[:, None]
    z = np.exp(z - z.max(1, keepdims=True))
    return z / z.sum(1, keepdims=True)


class _Bags:
    """Bucket counts of many texts, side by side."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> None:
        self.n = np.array([c.sum(dtype=np.int64) for _, c in rows])
        self.start = np.concatenate(([0], np.cumsum([len(b) for b, _ in rows]))).astype(np.int64)
        self.buckets = np.concatenate([b for b, _ in rows])
        self.shares = np.concatenate([c for _, c in rows]).astype(np.float32)
        self.shares /= np.repeat(np.maximum(self.n, 1), np.diff(self.start))

    def some(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Buckets, shares and first places of some rows, none of which is empty."""
        size = self.start[rows + 1] - self.start[rows]
        first = np.concatenate(([0], np.cumsum(size)[:-1]))
        at = np.arange(size.sum()) + np.repeat(self.start[rows] - first, size)
        return self.buckets[at], self.shares[at], first


def train(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, groups: np.ndarray, langs: list[str], precision: float = PRECISION) -> Model:
    """Fit on bags of buckets with the numbers of their languages; rows of one group (a text and its piece) stay on one side of the split."""
    bags, rng = _Bags(rows), np.random.default_rng(SEED)
    left_out = groups % 5 == 0
    if set(labels[left_out].tolist()) != set(range(len(langs))) or set(labels[~left_out].tolist()) != set(range(len(langs))):
        left_out[:] = False  # too few rows: everything is learnt from, and calibrated on
    learn = np.flatnonzero(~left_out)
    embed = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM))
    layer, bias = np.zeros((DIM, len(langs))), np.zeros(len(langs))
    even = 1 / np.bincount(labels[learn], minlength=len(langs)).clip(1)  # every language weighs the same
    weight = even[labels] / even[labels[learn]].mean()
    steps, done = EPOCHS * -(-len(learn) // BATCH), 0
    for _ in range(EPOCHS):
        order = rng.permutation(learn)
        for at in range(0, len(order), BATCH):
            some = order[at : at + BATCH]
            rate, done = RATE * (1 - done / steps), done + 1
            buckets, shares, first = bags.some(some)
            mean = np.add.reduceat(embed[buckets] * shares[:, None], first, axis=0)
            z = mean @ layer + bias
            z = np.exp(z - z.max(1, keepdims=True))
            wrong = z / z.sum(1, keepdims=True)
            wrong[np.arange(len(some)), labels[some]] -= 1
            wrong *= weight[some][:, None] / len(some)
            back = np.repeat(wrong @ layer.T, np.diff(np.append(first, len(buckets))), axis=0) * shares[:, None]
            layer -= rate * mean.T @ wrong
            bias -= rate * wrong.sum(0)
            where, whose = np.unique(buckets, return_inverse=True)
            step = np.stack([np.bincount(whose, back[:, d], len(where)) for d in range(DIM)], 1)
            embed[where] -= rate * len(some) * step  # a bucket is met by few texts of a batch
    test = np.flatnonzero(left_out) if left_out.any() else learn
    buckets, shares, first = bags.some(test)
    logits = np.add.reduceat(embed[buckets] * shares[:, None], first, axis=0) @ layer + bias
    scale = calibrated(logits, bags.n[test], labels[test])
    p = probabilities(logits, bags.n[test], scale)
    return Model(langs, embed @ layer, bias, scale, accepted_from(p.max(1), p.argmax(1) == labels[test], precision))


def calibrated(logits: np.ndarray, n: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """The scale with the least log loss: the best of a grid, refined twice."""
    best, width = (0.0, 0.0), (3.0, 1.0)
    loss = lambda s: -np.log(np.maximum(probabilities(logits, n, s)[np.arange(len(labels)), labels], 1e-12)).mean() + 1e-4 * (s[0] ** 2 + s[1] ** 2)
    for _ in range(3):
        tries = [(best[0] + i * width[0] / 6, best[1] + j * width[1] / 6) for i in range(-6, 7) for j in range(-6, 7)]
        best = min(tries, key=loss)
        width = (width[0] / 6, width[1] / 6)
    return best


def accepted_from(score: np.ndarray, right: np.ndarray, precision: float) -> float:
    """The least score from which on the share of right answers reaches ``precision``; over 1 if none does."""
    order = np.argsort(-score, kind="stable")
    share = np.cumsum(right[order]) / np.arange(1, len(order) + 1)
    good = np.flatnonzero(share >= precision)
    return float(score[order][good[-1]]) if len(good) else 1.1


def _bags_of(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Bucket counts, as bytes, of whole texts and of a piece of each, drawn by the text's own hash."""
    for batch in batches:
        out = []
        for lang, key, text in zip(batch.lang, batch["key"], batch.text, strict=True):
            words, rng = text.split(), np.random.default_rng(key & 0xFFFFFFFFFFFFFFFF)
            size = int(rng.integers(PIECE[0], PIECE[1] + 1))
            at = int(rng.integers(0, max(len(words) - size, 0) + 1))
            for piece, part in enumerate((text, " ".join(words[at : at + size]))):
                buckets, counts = bucket_counts(part)
                if len(buckets):
                    out.append((lang, key, piece, buckets.astype("<u2").tobytes(), counts.astype("<u4").tobytes()))
        yield pd.DataFrame(out, columns=["lang", "key", "piece", "buckets", "counts"])


def sample_bags(rows: DataFrame) -> DataFrame:
    """(lang, key, piece, buckets, counts) of a sample of different texts of each language, from (lang, text).

    The bound is ``SAMPLE`` and ``PER_LANG``.  Languages are counted first, so a
    row is taken or left by its own hash alone and only about twice the sample
    is ever shuffled, however frequent a language is.
    """
    common = written(rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES), "language-counts")
    each = min(PER_LANG, max(1, SAMPLE // max(1, common.count())))
    keyed = rows.join(F.broadcast(common), "lang").withColumn("key", F.xxhash64("text"))  # at most LANGUAGES rows
    near = keyed.where((F.col("key").cast("double") / 2.0**64 + 0.5) * F.col("n") <= 2 * each)
    once = near.groupBy("lang", "key").agg(F.min("text").alias("text"))
    first = once.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("key"))).where(F.col("place") <= each)
    return first.select("lang", "key", "text").mapInPandas(_bags_of, "lang string, key long, piece int, buckets binary, counts binary")


def identify_languages(docs: DataFrame, folds: int = 3, held_out_fold: int = 1, precision: float = PRECISION) -> DataFrame:
    """One row per document: doc_id, text_hash, held_out, lang_pred, score, accepted.

    ``docs`` has doc_id, text and lang.  Languages are learnt only from rows with
    a lang and a doc_id whose crc32(doc_id as text) modulo ``folds`` is not
    ``held_out_fold``; nothing but the text enters a prediction.  ``score`` is
    the calibrated probability of ``lang_pred``; ``accepted`` tells whether it
    reaches the threshold from which on left-out answers were right in
    ``precision`` of the cases.  A text that is null or has no letter is
    ``und`` with score 0, as is every text if there is nothing to learn from.
    Copies of a text are learnt once per language; ties of languages go to the
    first in order; a document with a null doc_id is scored and is not held
    out; repeated rows each give a row; an empty table gives none; other columns
    are ignored; whole texts are read.
    """
    spark = docs.sparkSession
    key = F.col("doc_id").cast("long")
    rows = docs.select(key.alias("doc_id"), F.col("lang").cast("string").alias("lang"), text_or_empty().alias("text"))
    usable = rows.where(F.col("lang").isNotNull() & F.coalesce(crc_mod("doc_id", folds) != held_out_fold, F.lit(False)))
    found = written(sample_bags(usable.select("lang", "text")), "language-sample").orderBy("lang", "key", "piece").collect()  # bounded by SAMPLE
    langs = sorted({r.lang for r in found})
    model = None
    if langs:
        number = {x: i for i, x in enumerate(langs)}
        bags = [(np.frombuffer(r.buckets, "<u2"), np.frombuffer(r.counts, "<u4")) for r in found]
        labels, groups = np.array([number[r.lang] for r in found]), np.array([r.key & 0x7FFFFFFFFFFFFFFF for r in found])
        model = train(bags, labels, groups, langs, precision)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = shared.value
        for batch in batches:
            if known is None:
                best, score = np.full(len(batch), -1), np.zeros(len(batch))
            else:
                best, score = known.answers(batch.text.to_list())
            names = [UNKNOWN if i < 0 else known.langs[i] for i in best]
            accepted = (best >= 0) & (score >= (known.threshold if known else 2))
            yield batch.drop(columns=["text"]).assign(lang_pred=names, score=score, accepted=accepted)

    exact = rows.select(F.col("doc_id").cast("decimal(20,0)").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    scored = exact.mapInPandas(run, "doc_id decimal(20,0), text_hash long, lang_pred string, score double, accepted boolean")
    doc_id = F.col("doc_id").cast("long")
    return scored.select(doc_id.alias("doc_id"), "text_hash", F.coalesce(crc_mod(doc_id, folds) == held_out_fold, F.lit(False)).alias("held_out"), "lang_pred", "score", "accepted")
