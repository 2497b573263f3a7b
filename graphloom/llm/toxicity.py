"""Toxicity by the nearest labelled examples under exact TF-IDF cosine.

Terms are the words of a text (letters and digits) and their stems (the first
four characters of words that have as many), so that inflected forms meet.
Every term of the sampled examples (``SAMPLE`` of each class, the documented
bound) is kept.  One pass over all whole texts counts them; document
frequencies are taken over all documents.  A term's weight is (1 + ln tf) idf, times a factor that tells how
surely its rates differ between the classes of the sample: a likelihood ratio
r (2 ln) gives FLOOR + (1 - FLOOR) (r / (r + HALF))^2.  Terms that say nothing
of toxicity keep a small weight and none is dropped.

The sample's unit vectors become a block-max inverted index, which is
broadcast: its size is bounded by the sample, not by the corpus.  Posting lists
that hold a good part of all examples are kept as rows of numbers, summed for
all examples at once; the others have a greatest weight per block.

A document's ``K`` nearest examples are found exactly: blocks of examples are
visited by falling upper bound and left out once none can reach the k-th best.
Votes are weighted by closeness and by how many labelled rows an example stands
for, then calibrated by a logistic fit on left-out sample rows.  A text that an
example equals term for term is scored by its labels (``COPY``).
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, row_hash, text_or_empty, tidy, written

#: Labelled rows of each class that the classifier is fitted on, at most.
SAMPLE = 1024
#: Neighbours that vote, examples in a block of the index, and the share of all examples from which on a posting list is a row.
K, BLOCK, DENSE = 15, 64, 1 / 8
#: Least factor of a term, and the likelihood ratio at which it has a quarter of the greatest one.
FLOOR, HALF = 1e-3, 10.0
#: Share of the score of a text that comes from the labels of its copies among the examples (cosine 1), where there are any.
COPY = 0.9
#: Letters of a stem.
STEM = 4
#: Sample rows of each class that the calibration is fitted on, and its pull towards none.
CALIBRATION, RIDGE = 500, 1.0
#: Texts that are scored at a time, and pieces of texts that are counted at a time.
TEXTS, PIECES_AT_ONCE = 64, 100_000
#: Pieces that a task remembers, and the letters of one that it does.
HELD_PIECES, PIECE = 200_000, 64
_WORD = re.compile(r"[^\W_]+")


def terms_of(text: str) -> list[str]:
    """Terms of a text: its words, and a stem (marked ^) for each that is long enough."""
    words = _WORD.findall(text.lower())
    return words + ["^" + w[:STEM] for w in words if len(w) >= STEM]


def class_factor(benign: np.ndarray, toxic: np.ndarray, n_benign: int, n_toxic: int) -> np.ndarray:
    """FLOOR to 1 for each term, by the likelihood ratio of its two rates (smoothed by half a row) against one common rate."""
    p, q, r = (toxic + 0.5) / (n_toxic + 1), (benign + 0.5) / (n_benign + 1), (toxic + benign + 0.5) / (n_toxic + n_benign + 1)
    side = lambda k, n, own: k * np.log(own / r) + (n - k) * np.log((1 - own) / (1 - r))
    ratio = np.maximum(2 * (side(toxic, n_toxic, p) + side(benign, n_benign, q)), 0)
    return FLOOR + (1 - FLOOR) * (ratio / (ratio + HALF)) ** 2


class BlockMaxIndex:
    """Unit vectors in blocks, with the greatest weight of each term in each block; lists of many rows are laid out whole."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]], n_terms: int, block: int = BLOCK, dense: float = DENSE) -> None:
        # neighbours by their heaviest term, so that bounds are tight
        order = sorted(range(len(rows)), key=lambda i: (int(rows[i][0][np.argmax(rows[i][1])]) if len(rows[i][0]) else n_terms, i))
        self.order, self.block = np.array(order, np.int64), block
        terms = np.concatenate([rows[i][0] for i in order]) if order else np.zeros(0, np.int64)
        at = np.repeat(np.arange(len(order)), [len(rows[i][0]) for i in order])
        weights = np.concatenate([rows[i][1] for i in order]) if order else np.zeros(0)
        whole = np.bincount(terms, minlength=n_terms) >= max(1, dense * len(order))
        self.row_of = np.where(whole, np.cumsum(whole) - 1, -1)
        self.rows = np.zeros((int(whole.sum()), len(order)))
        laid = whole[terms]
        self.rows[self.row_of[terms[laid]], at[laid]] = weights[laid]
        terms, at, weights = terms[~laid], at[~laid], weights[~laid]
        sort = np.lexsort((at, terms))
        self.at, self.weights, terms = at[sort], weights[sort], terms[sort]
        key = terms * (len(order) + 1) + self.at // block
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
        self.run = np.concatenate((first, [len(key)]))  # postings of each (term, block)
        self.run_block = self.at[first] // block if len(first) else first
        self.run_most = np.maximum.reduceat(self.weights, first) if len(first) else np.zeros(0)
        self.term_run = np.searchsorted(terms[first] if len(first) else first, np.arange(n_terms + 1))
        self.blocks = -(-len(order) // block)
        self.place = np.argsort(self.order)
        self.rows = np.pad(self.rows, ((0, 0), (0, self.blocks * block - len(order))))

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int, skip: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """Rows and cosines (rounded to 12 digits) of the k nearest with a cosine over 0.

        Ties go to the row that comes first in the index; ``skip`` is left out.
        """
        return self.nearest_all(np.array([len(terms)]), terms, weights, k, np.array([skip]))[1:]

    def nearest_all(self, size: np.ndarray, terms: np.ndarray, weights: np.ndarray, k: int, skip: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same for several queries that lie end to end, ``size`` different terms each: how many rows each has, the rows and cosines.

        Blocks are visited in two rounds: the four of the greatest bounds, then
        all that may still hold one of the k nearest.
        """
        m, width = len(size), self.blocks * self.block
        if not width or not m:
            return np.zeros(m, np.int64), np.zeros(0, np.int64), np.zeros(0)
        of, laid = np.repeat(np.arange(m), size), self.row_of[terms]
        whole = laid >= 0
        dense = np.zeros((m, len(self.rows)))
        dense[of[whole], laid[whole]] = weights[whole]
        score = dense @ self.rows
        of, terms, weights = of[~whole], terms[~whole], weights[~whole]
        begin, n = self.term_run[terms], self.term_run[terms + 1] - self.term_run[terms]
        runs = np.arange(n.sum()) + np.repeat(begin - (np.cumsum(n) - n), n)  # (term, block) lists of the queries
        of, power = np.repeat(of, n), np.repeat(weights, n)
        cell = of * self.blocks + self.run_block[runs]
        bound = np.bincount(cell, power * self.run_most[runs], m * self.blocks).reshape(m, -1) + score.reshape(m, self.blocks, self.block).max(2)

        def visit(wanted: np.ndarray) -> None:
            at = np.flatnonzero(wanted.ravel()[cell])
            first, n = self.run[runs[at]], self.run[runs[at] + 1] - self.run[runs[at]]
            postings = np.arange(n.sum()) + np.repeat(first - (np.cumsum(n) - n), n)
            places = np.repeat(of[at] * width, n) + self.at[postings]
            score.ravel()[:] += np.bincount(places, np.repeat(power[at], n) * self.weights[postings], m * width)

        def standing(visited: np.ndarray) -> np.ndarray:
            """Cosines within the visited blocks, others 0."""
            known = np.where(visited[:, :, None], np.round(score, 12).reshape(m, self.blocks, self.block), 0).reshape(m, width)
            if skip is not None:
                out = np.flatnonzero(skip >= 0)
                known[out, self.place[skip[out]]] = 0
            return known

        first = np.argsort(-np.round(bound, 12), axis=1, kind="stable")[:, :4]
        visited = np.zeros((m, self.blocks), bool)
        np.put_along_axis(visited, first, True, 1)
        visit(visited)
        best = np.take_along_axis(standing(visited).reshape(m, self.blocks, self.block), first[:, :, None], 1).reshape(m, -1)
        # the k-th best so far; of fewer, all that is over 0 may come
        least = np.partition(best, best.shape[1] - k, axis=1)[:, best.shape[1] - k] if k <= best.shape[1] else np.zeros(m)
        more = (bound > 0) & (bound >= least[:, None] - 1e-11) & ~visited
        visit(more)
        known = standing(visited | more)
        query, at = np.nonzero((known > 0) & (known >= least[:, None]))
        cosine = known[query, at]
        sort = np.lexsort((at, -cosine, query))
        begin = np.searchsorted(query, np.arange(m + 1))
        sort = sort[np.arange(len(sort)) - begin[query] < k]
        return np.minimum(np.diff(begin), k), self.order[at[sort]], cosine[sort]


class Voter:
    """The index with labels, class weights and calibration; ``power`` is a term's idf times its factor."""

    def __init__(self, ids: list[int], labels: np.ndarray, vectors: list[tuple[np.ndarray, np.ndarray]], power: np.ndarray, stands_for: tuple[float, float]) -> None:
        self.ids, self.power, self.labels = ids, power, labels
        self.weight = np.where(labels == 1, stands_for[1], stands_for[0])
        self.index = BlockMaxIndex([self.unit(t, c) for t, c in vectors], len(power))
        rate = float(self.weight[labels == 1].sum()) / max(float(self.weight.sum()), 1e-9)
        self.prior = min(max(rate, 1e-3), 0.5)
        self.slope, self.shift = 1.0, 0.0

    def unit(self, terms: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        weights = (1 + np.log(counts)) * self.power[terms]
        return terms, weights / np.linalg.norm(weights) if len(terms) else weights

    def vote(self, size: np.ndarray, terms: np.ndarray, counts: np.ndarray, skip: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Raw scores of texts whose terms lie end to end, and number, rows and cosines of their voters; without a voter, the rate of the toxic class."""
        of, weights = np.repeat(np.arange(len(size)), size), (1 + np.log(counts)) * self.power[terms]
        weights /= np.sqrt(np.bincount(of, weights * weights, len(size)))[of]
        n, rows, cosine = self.index.nearest_all(size, terms, weights, K, skip)
        of, power = np.repeat(np.arange(len(n)), n), self.weight[rows] * cosine / (1.05 - np.minimum(cosine, 1.0))
        pull = float(self.weight.mean()) * 0.5
        toxic, total = np.bincount(of, power * self.labels[rows], len(n)), np.bincount(of, power, len(n))
        return (toxic + pull * self.prior) / (total + pull), n, rows, cosine

    def calibrate(self, vectors: list[tuple[np.ndarray, np.ndarray]]) -> None:
        """Logistic fit on left-out votes; kept only if it rises with the vote."""
        pick = np.concatenate([np.flatnonzero(self.labels == c)[:CALIBRATION] for c in (0, 1)])
        if len(pick) < 20 or len(set(self.labels[pick].tolist())) < 2:
            return
        texts = [pick[at : at + TEXTS] for at in range(0, len(pick), TEXTS)]
        raw = np.concatenate([self.vote(np.array([len(vectors[i][0]) for i in part]), *(np.concatenate([vectors[i][k] for i in part]) for k in (0, 1)), skip=part)[0] for part in texts])
        x, y, w = _logit(raw), self.labels[pick].astype(float), self.weight[pick] / self.weight[pick].mean()
        beta = np.array([1.0, 0.0])
        for _ in range(30):
            p = _logistic(beta[0] * x + beta[1])
            grad = np.array([(w * (p - y)) @ x + RIDGE * (beta[0] - 1), (w * (p - y)).sum() + RIDGE * beta[1]])
            v = w * p * (1 - p)
            hess = np.array([[(v * x) @ x + RIDGE, v @ x], [v @ x, v.sum() + RIDGE]])
            step = np.linalg.solve(hess, grad)
            beta = np.clip(beta - step, -20, 20)
            if np.abs(step).max() < 1e-9:
                break
        if np.isfinite(beta).all() and beta[0] > 0:
            self.slope, self.shift = float(beta[0]), float(beta[1])

    def score(self, size: np.ndarray, terms: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        raw, n, rows, cosine = self.vote(size, terms, counts)
        score = _logistic(self.slope * _logit(raw) + self.shift)
        copy = cosine > 1 - 1e-9
        of, weight = np.repeat(np.arange(len(n)), n)[copy], self.weight[rows[copy]]
        held = np.bincount(of, weight, len(n))
        has = held > 0  # the fit, made on left-out rows, has seen no copy
        score[has] = COPY * np.bincount(of, weight * self.labels[rows[copy]], len(n))[has] / held[has] + (1 - COPY) * score[has]
        return np.clip(score, 0, 1), raw, n, rows, cosine


def _logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def _term_counts(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Documents of each class that hold a term, summed within the task."""
    seen: tuple[Counter, Counter] = (Counter(), Counter())
    for batch in batches:
        for text, toxic in zip(batch.text, batch.toxic, strict=True):
            seen[toxic].update(set(terms_of(text)))
        if len(seen[0]) + len(seen[1]) > 2_000_000:
            yield from _told(seen)
            seen = (Counter(), Counter())
    yield from _told(seen)


def _told(seen: tuple[Counter, Counter]) -> Iterator[pd.DataFrame]:
    names = list(seen[0].keys() | seen[1].keys())
    for at in range(0, len(names), 50_000):
        part = names[at : at + 50_000]
        yield pd.DataFrame({"term": part, "benign": [seen[0][t] for t in part], "toxic": [seen[1][t] for t in part]})


class _Pieces(dict):
    """Maps a blank-separated piece of a text to the numbers of its word and stem, as one number.

    A piece of several words, or of none, is a negative number: the place of its
    words' numbers in ``several``.  The memory is bounded.
    """

    def __init__(self, vocabulary: dict[str, int]) -> None:
        super().__init__()
        self.words = {t: i + 1 for t, i in vocabulary.items() if not t.startswith("^")}
        self.stems = {t[1:]: i + 1 for t, i in vocabulary.items() if t.startswith("^")}
        self.base = len(vocabulary) + 1
        self.several: list[list[int]] = []

    def __missing__(self, piece: str) -> int:
        word = piece.rstrip(".,;:!?").lower()
        found = [word] if word.isalnum() else _WORD.findall(piece.lower())
        numbers = [self.words.get(w, 0) * self.base + self.stems.get(w[:STEM], 0) for w in found]  # a shorter word is no stem
        if len(numbers) == 1:
            number = numbers[0]
        else:
            self.several.append(numbers)
            number = -len(self.several)
        if len(piece) <= PIECE:
            self[piece] = number
        return number

    def fresh(self) -> None:
        """Forgets all pieces once they are too many."""
        if len(self) > HELD_PIECES or len(self.several) > HELD_PIECES:
            self.clear()
            self.several = []


def _term_vectors(pieces: _Pieces, numbers: list[list[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of terms of each text, and all terms (ascending within a text) and their counts."""
    size = np.array([len(x) for x in numbers], np.int64)
    flat = np.fromiter(chain.from_iterable(numbers), np.int64, int(size.sum()))
    of = np.repeat(np.arange(len(size)), size)
    split = np.flatnonzero(flat < 0)
    if len(split):
        parts = [pieces.several[-1 - i] for i in flat[split].tolist()]
        of = np.concatenate((np.delete(of, split), np.repeat(of[split], [len(x) for x in parts])))
        flat = np.concatenate((np.delete(flat, split), np.fromiter(chain.from_iterable(parts), np.int64)))
    key = np.concatenate([of[held > 0] * pieces.base + held[held > 0] for held in np.divmod(flat, pieces.base)])
    key.sort()
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    of, terms = np.divmod(key[first], pieces.base)
    return np.bincount(of, minlength=len(size)), (terms - 1).astype(np.int32), np.diff(first, append=len(key)).astype(np.int32)


def _vectors(vocabulary: dict[str, int], batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Numbers and counts of the terms of the vocabulary that a text holds, beside the columns before ``text``."""
    pieces = _Pieces(vocabulary)
    del vocabulary  # in its place ``pieces`` has the words and the stems
    for batch in batches:
        texts = batch.column("text")
        at = 0
        while at < len(texts):  # a few texts at a time, by their length
            pieces.fresh()
            numbers, held, begin = [], 0, at
            while at < len(texts) and (held < PIECES_AT_ONCE or at == begin):
                numbers.append(list(map(pieces.__getitem__, texts[at].as_py().split())))
                held, at = held + len(numbers[-1]), at + 1
            size, terms, counts = _term_vectors(pieces, numbers)
            ends = pa.array(np.concatenate(([0], np.cumsum(size))), pa.int32())
            part = batch.slice(begin, at - begin)
            keep = [n for n in batch.schema.names if n != "text"]
            lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (terms, counts)]
            yield pa.RecordBatch.from_arrays([part.column(n) for n in keep] + lists, names=[*keep, "terms", "counts"])


def _document_counts(n_terms: int, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents that hold each term, summed within the task."""
    seen = np.zeros(n_terms, np.int64)
    for batch in batches:
        seen += np.bincount(batch.column("terms").flatten().to_numpy(), minlength=n_terms)
    held = np.flatnonzero(seen)
    yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(seen[held])], names=["term", "n"])


def score_toxicity(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out_fold: int = 0, sample: int = SAMPLE) -> DataFrame:
    """One row per document: doc_id, text_hash, held_out, score, predicted, vote, evidence.

    ``docs`` has doc_id and text, ``labels`` doc_id and toxic.  Labels are learnt
    only from rows whose crc32(doc_id as text) modulo ``folds`` is not
    ``held_out_fold``.  ``evidence`` lists the voters (doc_id, label, cosine),
    ``vote`` is their vote before calibration.  A text that shares no term with
    an example, such as a null or empty one, has no voter: its vote is the rate
    of the toxic class.  Without usable labels every score is 0.  A doc_id
    with several labels counts as toxic if one says so; rows of labels with a
    null are left out; a document with a null doc_id is scored and is not held
    out; repeated rows each give a row; an empty table gives none; other columns
    are ignored; whole texts are read.
    """
    spark = docs.sparkSession
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & (crc_mod("doc_id", folds) != held_out_fold))
    usable = usable.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    sizes = {r.toxic: r["count"] for r in usable.groupBy("toxic").count().collect()}
    benign, toxic = (usable.where(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for label in (0, 1))
    chosen = written(benign.unionByName(toxic), "toxicity-chosen")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))

    # the text of each example: of several with one doc_id, that of the least hash
    own = rows.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min(F.struct(row_hash().alias("text_hash"), "text")).alias("v"))  # a bounded sample
    train = written(own.select("doc_id", "toxic", "v.text_hash", "v.text"), "toxicity-examples")
    n = {r.toxic: r["count"] for r in train.groupBy("toxic").count().collect()}
    counted = train.mapInPandas(tidy(_term_counts), "term string, benign long, toxic long").groupBy("term").agg(F.sum("benign").alias("benign"), F.sum("toxic").alias("toxic"))
    counted = sorted((r.term, r.benign, r.toxic) for r in counted.collect())  # terms of the sample
    vocabulary, n_terms = [r[0] for r in counted], len(counted)
    factor = class_factor(*(np.array([r[i] for r in counted], float) for i in (1, 2)), n.get(0, 0), n.get(1, 0))

    words = spark.sparkContext.broadcast("\n".join(vocabulary))  # as one text, which takes the least memory of workers
    vectors = rows.select("doc_id", row_hash().alias("text_hash"), "text").mapInArrow(tidy(lambda it: _vectors({t: i for i, t in enumerate(words.value.splitlines())}, it)), "doc_id long, text_hash long, terms array<int>, counts array<int>")
    vectors = written(vectors, "toxicity-vectors")

    total = vectors.count()
    summed = written(vectors.select("terms").mapInArrow(tidy(lambda it: _document_counts(n_terms, it)), "term int, n long"), "toxicity-frequencies").groupBy("term").agg(F.sum("n").alias("n"))
    seen = np.zeros(n_terms)
    for r in summed.collect():  # a row per term of the sample
        seen[r.term] = r.n
    power = (np.log((1 + total) / (1 + seen)) + 1) * factor
    keys = F.broadcast(train.select("doc_id", "text_hash", "toxic"))
    examples = vectors.join(keys, ["doc_id", "text_hash"]).groupBy("doc_id", "text_hash", "toxic").agg(F.min(F.struct("terms", "counts")).alias("v")).collect()
    examples.sort(key=lambda r: (r.text_hash, r.toxic, r.v.terms))  # a doc_id decides no tie
    as_arrays = [(np.array(r.v.terms, np.int64), np.array(r.v.counts, float)) for r in examples]
    y = np.array([r.toxic for r in examples], np.int64)
    if len(examples):
        stands_for = tuple(sizes.get(c, 0) / max(1, int((y == c).sum())) for c in (0, 1))
        voter = Voter([r.doc_id for r in examples], y, as_arrays, power, stands_for)
        voter.calibrate(as_arrays)
    else:
        voter = None
    shared = spark.sparkContext.broadcast(voter)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        ids = np.array(model.ids, np.int64) if model else None
        for batch in batches:
            for at in range(0, len(batch), TEXTS):
                part = batch.slice(at, TEXTS)
                terms, counts = part.column("terms"), part.column("counts")
                size = terms.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
                if model:
                    score, vote, n, voters, cosine = model.score(size, terms.flatten().to_numpy().astype(np.int64), counts.flatten().to_numpy().astype(float))
                    who = [pa.array(ids[voters]), pa.array(model.labels[voters].astype(np.int32)), pa.array(cosine)]
                else:
                    score, vote, n = np.zeros(len(part)), np.zeros(len(part)), np.zeros(len(part), np.int64)
                    who = [pa.array([], t) for t in (pa.int64(), pa.int32(), pa.float64())]
                ends = pa.array(np.concatenate(([0], np.cumsum(n))), pa.int32())
                evidence = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays(who, ["doc_id", "toxic", "cosine"]))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_hash"), pa.array(score), pa.array(vote), evidence], names=["doc_id", "text_hash", "score", "vote", "evidence"])

    scored = vectors.mapInArrow(tidy(run), "doc_id long, text_hash long, score double, vote double, evidence array<struct<doc_id:bigint,toxic:int,cosine:double>>")
    held_out = F.coalesce(crc_mod("doc_id", folds) == held_out_fold, F.lit(False))
    return scored.select("doc_id", "text_hash", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "vote", "evidence")
