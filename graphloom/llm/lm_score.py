"""Language-model scores by a weighted backoff automaton learnt from the corpus.

The model is an n-gram model with absolute discounting, written as an
automaton.  Its states are the contexts seen in training, its arcs the n-grams
seen: an arc carries the smoothed probability of its word, and a state's
failure arc, with the weight that discounting took off, leads to the state of
the context less its oldest word, down to the root, which knows every word.  A
text is read once from left to right; the state it has reached and the next
word give an arc, or failure arcs and then one, and the logarithms add up.

The automaton grows with the corpus, so no task holds it whole.  Texts lie in
blocks of ``BLOCK_TOKENS`` tokens.  A block sends each distinct n-gram it holds
once, with its training count, to the bucket of its context; the bucket sums
the counts of all blocks and answers every block with the sums for just those
n-grams.  With the answers a block has the part of the automaton that its texts
can reach.  Buckets grow in number, not in size; contexts so common that one
bucket could not hold them (fewer than ``HEAVY`` words can be) are split by
their next word.

Words and contexts travel as 64-bit hashes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty, written

#: Tokens of a block (it closes at the end of the text that fills it), and n-grams aimed at in a bucket.
BLOCK_TOKENS, BUCKET_GRAMS = 1_500_000, 2_000_000
#: Length of the n-grams, and what is taken off each count.
ORDER, DISCOUNT = 2, 0.75
#: A context with over 1/HEAVY of all tokens is split into SPLIT buckets.
HEAVY, SPLIT = 1000, 64
#: Rows of one batch of messages to buckets, and blocks that a task scores, one after another.
SENT_ROWS, TASK_BLOCKS = 4096, 2
_MIX1, _MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_S32, _S29 = np.uint64(32), np.uint64(29)


def _join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A 64-bit hash of two hashes, in order."""
    x = (a * _MIX1) ^ ((b + _MIX2) * _MIX2)
    x ^= x >> _S32
    x *= _MIX1
    return x ^ (x >> _S29)


def _blocks(folds: int, held_out_fold: int, batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of texts as ids of the block's own words; id 0 is the end of a text."""
    import xxhash
    from pyspark import TaskContext

    class Ids(dict):
        def __missing__(self, word: bytes) -> int:
            self[word] = found = len(self) + 1
            return found

    block = TaskContext.get().partitionId() << 24
    ids, parts, names, lengths, held = Ids(), [], [], [], 0

    def close() -> pd.DataFrame:
        hashes = np.array([xxhash.xxh64_intdigest(b"end of text", 1), *(xxhash.xxh64_intdigest(w, 0) for w in ids)], "<u8")
        out = [n is not None and zlib.crc32(str(n).encode()) % folds == held_out_fold for n in names]
        return pd.DataFrame({
            "block": [block], "n_tokens": [held], "doc_ids": [np.array([n or 0 for n in names], "<i8").tobytes()], "no_id": [np.array([n is None for n in names], "u1").tobytes()],
            "held_out": [np.array(out, "u1").tobytes()], "lengths": [np.array(lengths, "<i4").tobytes()], "tokens": [np.concatenate(parts).astype("<i4").tobytes()], "hashes": [hashes.tobytes()],
        })

    for batch in batches:
        for name, text in zip(batch.doc_id, batch.text, strict=True):
            words = text.encode("utf-8", "replace").lower().split()  # bytes: A-Z and the six ASCII blanks only
            parts.append(np.fromiter(map(ids.__getitem__, words), np.int32, len(words)))
            parts.append(np.zeros(1, np.int32))
            names.append(None if name is None else int(name))
            lengths.append(len(words) + 1)
            held += len(words) + 1
            if held >= BLOCK_TOKENS:
                yield close()
                ids, parts, names, lengths, held, block = Ids(), [], [], [], 0, block + 1
    if names:
        yield close()


BLOCK_SCHEMA = "block long, n_tokens long, doc_ids binary, no_id binary, held_out binary, lengths binary, tokens binary, hashes binary"


class _Block:
    """The arrays of a block row."""

    def __init__(self, row: pd.Series) -> None:
        self.block = int(row.block)
        self.lengths = np.frombuffer(row.lengths, "<i4").astype(np.int64)
        self.held_out = np.frombuffer(row.held_out, "u1").astype(bool)
        self.tokens = np.frombuffer(row.tokens, "<i4").astype(np.int64)
        self.hashes = np.frombuffer(row.hashes, "<u8")
        self.ends = np.cumsum(self.lengths)
        self.begins = self.ends - self.lengths
        self.trained = np.repeat(~self.held_out, self.lengths)

    def runs(self, length: int) -> np.ndarray:
        """Hash of the ``length`` words that end at each position; it means nothing where a text has fewer before it."""
        words = self.hashes[self.tokens]
        out = words
        for back in range(1, length):
            out = out.copy()
            out[back:] = _join(words[:-back], out[back:])
        return out

    def grams(self, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(positions, their gram, first positions, contexts, next words, training counts) of the distinct n-grams.

        Distinct grams are sorted by context hash and next hash; positions are
        those of a gram's last word and lie within one text.
        """
        since = np.arange(len(self.tokens)) - np.repeat(self.begins, self.lengths)
        at = np.flatnonzero(since >= order - 1)
        nxt = self.hashes[self.tokens[at]]
        context = self.runs(order - 1)[at - 1] if order > 1 else np.zeros(len(at), np.uint64)
        key = _join(context, nxt)
        _, first, which = np.unique(key, return_index=True, return_inverse=True)
        sort = np.lexsort((nxt[first], context[first]))
        rank = np.empty(len(sort), np.int64)
        rank[sort] = np.arange(len(sort))
        gram, first = rank[which], first[sort]
        return at, gram, at[first], context[first], nxt[first], np.bincount(gram, self.trained[at], len(sort)).astype(np.int64)


def _bucket(order: int, context: np.ndarray, nxt: np.ndarray, heavy: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each n-gram: that of its context, one of several for a heavy one.

    Single words have no context and go by themselves.
    """
    if order == 1:
        context = nxt
    split = np.isin(context, heavy)
    own = context * _MIX2 + np.where(split, (nxt >> np.uint64(40)) % np.uint64(SPLIT) * _MIX1, np.uint64(0))
    return ((own >> _S32) % np.uint64(buckets)).astype(np.int64)


def _runs(context: np.ndarray) -> np.ndarray:
    """Where each run of equal contexts begins, and the end."""
    return np.flatnonzero(np.concatenate((np.ones(min(1, len(context)), bool), context[1:] != context[:-1], [True])))


def _send(order: int, heavy: np.ndarray, buckets: int, batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A row for each bucket that holds grams of a block: never more rows than the block has grams."""
    for batch in batches:
        for _, row in batch.iterrows():
            block = _Block(row)
            _, _, _, context, nxt, count = block.grams(order)
            bucket = _bucket(order, context, nxt, heavy, buckets)
            sort = np.argsort(bucket, kind="stable")
            bucket, context, nxt, count = bucket[sort], context[sort], nxt[sort], count[sort].astype("<u4")
            cuts = _runs(bucket)
            for at in range(0, len(cuts) - 1, SENT_ROWS):
                ends = cuts[at : at + SENT_ROWS + 1].tolist()
                parts = [slice(a, b) for a, b in zip(ends[:-1], ends[1:], strict=True)]
                runs = [_runs(context[own]) for own in parts]
                yield pd.DataFrame({
                    "bucket": bucket[ends[:-1]], "block": block.block, "contexts": [context[own][r[:-1]].tobytes() for own, r in zip(parts, runs, strict=True)],
                    "sizes": [np.diff(r).astype("<u4").tobytes() for r in runs], "words": [nxt[own].tobytes() for own in parts], "counts": [count[own].tobytes() for own in parts],
                })


SENT_SCHEMA = "bucket int, block long, contexts binary, sizes binary, words binary, counts binary"
#: Answers to a block (its grams' counts; totals and kinds of its contexts), and with negative blocks what concerns all.
ANSWER_SCHEMA = "bucket int, block long, counts binary, totals binary, kinds binary"


def _sum_bucket(order: int, heavy: np.ndarray, most: float, rows: pd.DataFrame) -> pd.DataFrame:
    """Counts of all blocks summed; block -1 gets sums over all or the parts of heavy contexts, block -2 grams that are heavy contexts themselves."""
    rows = rows.sort_values("block")
    contexts = [np.repeat(np.frombuffer(c, "<u8"), np.frombuffer(n, "<u4")) for c, n in zip(rows.contexts, rows.sizes, strict=True)]
    cuts = np.cumsum([0, *map(len, contexts)])
    context = np.concatenate(contexts)
    nxt = np.concatenate([np.frombuffer(w, "<u8") for w in rows.words])
    count = np.concatenate([np.frombuffer(c, "<u4") for c in rows.counts]).astype(np.int64)
    _, first, which = np.unique(_join(context, nxt), return_index=True, return_inverse=True)
    total = np.bincount(which, count, len(first)).astype(np.int64)
    names, place = np.unique(context[first], return_inverse=True)
    totals = np.bincount(place, total, len(names)).astype(np.int64)
    kinds = np.bincount(place, total > 0, len(names)).astype(np.int64)
    answer = total[which]
    out = []
    for i, block in enumerate(rows.block):
        own = slice(cuts[i], cuts[i + 1])
        state = np.searchsorted(names, np.frombuffer(rows.contexts.iloc[i], "<u8"))
        out.append((block, answer[own], totals[state], kinds[state]))
    if order == 1:
        out.append((-1, context[:0].view(np.int64), totals.sum(keepdims=True), kinds.sum(keepdims=True)))
    else:
        part = np.isin(names, heavy)
        out.append((-1, names[part].view(np.int64), totals[part], kinds[part]))
    common = first[total > most]
    out.append((-2, (nxt if order == 1 else _join(context, nxt))[common].view(np.int64), totals[:0], kinds[:0]))
    wide = lambda x: x.astype("<i8").tobytes()
    return pd.DataFrame({"bucket": int(rows.bucket.iloc[0]), "block": [o[0] for o in out], "counts": [wide(o[1]) for o in out], "totals": [wide(o[2]) for o in out], "kinds": [wide(o[3]) for o in out]})


def _exchange(blocks: DataFrame, order: int, heavy: np.ndarray, buckets: int, most: float) -> DataFrame:
    sent = blocks.mapInPandas(lambda it: _send(order, heavy, buckets, it), SENT_SCHEMA)
    return written(sent.repartition(max(8, buckets), "bucket").groupBy("bucket").applyInPandas(lambda rows: _sum_bucket(order, heavy, most, rows), ANSWER_SCHEMA).withColumn("gram", F.lit(order)), f"lm-answers-{order}")


def _numbers(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<i8")


class Automaton:
    """The states and arcs that the texts of one block can reach.

    State 0 is the root.  A word without an arc from a state takes the failure
    arc, whose weight is what discounting left, to the state of the context less
    its oldest word.  An arc carries the word's whole probability in its state
    and leads to the longest known context that it ends.
    """

    def __init__(self, block: _Block, answers: pd.DataFrame, plan: dict) -> None:
        self.block, n, v = block, plan["tokens"], plan["distinct"]
        self.words = len(block.hashes)
        levels = [self._level(order, answers, plan) for order in range(1, plan["order"] + 1)]
        # states of contexts of 1, 2, ... words: those that training goes on from
        begin, self.names = [0, 1], [np.zeros(1, np.uint64)]
        for _, _, _, context, _, total, _ in levels[1:]:
            self.names.append(np.unique(context[total > 0]))
            begin.append(begin[-1] + len(self.names[-1]))
        self.begin = begin
        self.fail_to, self.fail = np.zeros(begin[-1], np.int64), np.zeros(begin[-1])
        at, gram, first, _, count, _, _ = levels[0]
        lower, of_position = (count + 0.5) / (n + 0.5 * (v + 1)), np.empty(len(block.tokens), np.int64)
        of_position[at] = gram
        self.known = np.add.reduceat((count[gram] > 0).astype(np.int64), block.begins)
        word = block.tokens[first]
        self.root, self.root_to = np.zeros(self.words), np.zeros(self.words, np.int64)
        self.root[word], self.root_to[word] = np.log10(lower), self._longest(first, min(1, plan["order"] - 1))
        keys, weights, targets = [np.zeros(0, np.int64)], [np.zeros(0)], [np.zeros(0, np.int64)]
        for k, (at, gram, first, context, count, total, kinds) in enumerate(levels[1:], 1):
            fail = np.where(total > 0, DISCOUNT * kinds / np.maximum(total, 1), 1.0)
            lower = np.where(total > 0, np.maximum(count - DISCOUNT, 0) / np.maximum(total, 1), 0.0) + fail * lower[of_position[first]]
            of_position[at] = gram
            state = begin[k] + np.searchsorted(self.names[k], context)
            is_state, is_arc = total > 0, (total > 0) & (count > 0)
            self.fail[state[is_state]], self.fail_to[state[is_state]] = np.log10(fail[is_state]), self._longest(first[is_state] - 1, k - 1)
            keys.append(state[is_arc] * self.words + block.tokens[first[is_arc]])
            weights.append(np.log10(lower[is_arc]))
            targets.append(self._longest(first[is_arc], min(k + 1, plan["order"] - 1)))
        sort = np.argsort(np.concatenate(keys))
        self.keys, self.weights, self.targets = (np.concatenate(x)[sort] for x in (keys, weights, targets))

    def _level(self, order: int, answers: pd.DataFrame, plan: dict) -> tuple:
        at, gram, first, context, nxt, _ = self.block.grams(order)
        bucket = _bucket(order, context, nxt, plan["heavy_contexts"][order], plan["buckets"][order])
        sort = np.argsort(bucket, kind="stable")
        own = answers[answers.gram == order].sort_values("bucket")
        count, total, kinds = (np.zeros(len(context)) for _ in range(3))
        count[sort] = np.concatenate([_numbers(x) for x in own["counts"]]) if len(own) else 0
        cuts = np.searchsorted(bucket[sort], own.bucket.to_numpy()), np.searchsorted(bucket[sort], own.bucket.to_numpy(), "right")
        for a, b, t, k in zip(*cuts, own["totals"], own["kinds"], strict=True):
            grams = sort[a:b]
            size = np.diff(_runs(context[grams]))
            total[grams], kinds[grams] = np.repeat(_numbers(t), size), np.repeat(_numbers(k), size)
        heavy, totals_of_heavy, kinds_of_heavy = plan["heavy"][order]
        if order > 1 and len(heavy):
            place = np.minimum(np.searchsorted(heavy, context), len(heavy) - 1)
            is_heavy = heavy[place] == context
            total[is_heavy], kinds[is_heavy] = totals_of_heavy[place[is_heavy]], kinds_of_heavy[place[is_heavy]]
        return at, gram, first, context, count, total, kinds

    def _longest(self, at: np.ndarray, most: int) -> np.ndarray:
        """The state of the longest context, of ``most`` words at most, that ends at each position."""
        out = np.zeros(len(at), np.int64)
        since = at - np.repeat(self.block.begins, self.block.lengths)[at]
        for length in range(1, most + 1):
            names, wanted = self.names[length], self.block.runs(length)[at]
            place = np.minimum(np.searchsorted(names, wanted), max(len(names) - 1, 0))
            found = (names[place] == wanted) & (since >= length - 1) if len(names) else np.zeros(len(at), bool)
            out[found] = self.begin[length] + place[found]
        return out

    def traverse(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per text: known tokens, log10 probability at the root only, and by the automaton.

        All texts of the block are read side by side, each from left to right
        with the state that it has reached.
        """
        block = self.block
        base, score = (np.zeros(len(block.lengths)) for _ in range(2))
        order = np.argsort(-block.lengths, kind="stable")
        begins, reading = block.begins[order], np.searchsorted(-block.lengths[order], -np.arange(block.lengths.max(initial=0)), "left")
        state = np.zeros(len(order), np.int64)
        for t, n in enumerate(reading.tolist()):
            word = block.tokens[begins[:n] + t]
            base[:n] += self.root[word]
            todo = np.flatnonzero(state[:n])
            while len(todo):
                key = state[todo] * self.words + word[todo]
                place = np.minimum(np.searchsorted(self.keys, key), max(len(self.keys) - 1, 0))
                hit = self.keys[place] == key if len(self.keys) else np.zeros(len(todo), bool)
                done, place, left = todo[hit], place[hit], todo[~hit]
                score[done] += self.weights[place]
                state[done] = -1 - self.targets[place]  # this word is read
                score[left] += self.fail[state[left]]
                state[left] = self.fail_to[state[left]]
                todo = left[state[left] > 0]
            at_root = np.flatnonzero(state[:n] == 0)
            score[at_root] += self.root[word[at_root]]
            state[at_root] = -1 - self.root_to[word[at_root]]
            state[:n] = -1 - state[:n]
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        return self.known, base[back], score[back]


SCORE_SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def score_texts(docs: DataFrame, order: int = ORDER, folds: int = 5, held_out_fold: int = 1) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    ``docs`` has doc_id and text.  The model is learnt from the whole texts of
    rows whose crc32(doc_id as text) modulo ``folds`` is not ``held_out_fold``;
    all rows are scored, each text with one end token.  Null and empty texts are
    that end alone.  A row with a null doc_id is learnt from; repeated rows are
    learnt and scored each; an empty table gives no rows; other columns are
    ignored; a very long text makes one larger block and is scored whole.  With
    ``order`` 1 the score is the base score; it is 3 at most.
    """
    if order not in (1, 2, 3):
        raise ValueError("order is 1, 2 or 3")
    rows = docs.select(F.col("doc_id").cast("decimal(20,0)").alias("doc_id"), text_or_empty().alias("text"))
    blocks = written(rows.mapInPandas(lambda it: _blocks(folds, held_out_fold, it), BLOCK_SCHEMA), "lm-blocks")
    size = blocks.agg(F.sum("n_tokens")).first()[0] or 0
    plan = {"order": order, "buckets": {k: max(8, -(-size // BUCKET_GRAMS)) for k in range(1, order + 1)}, "heavy": {}}

    heavy, every = np.zeros(0, np.uint64), []
    plan["heavy_contexts"] = {}
    for k in range(1, order + 1):
        plan["heavy_contexts"][k] = heavy
        more = _exchange(blocks, k, heavy, plan["buckets"][k], size / HEAVY if k < order else float("inf"))
        every.append(more)
        about_all = more.where("block < 0").select("block", "counts", "totals", "kinds").collect()  # a few numbers per bucket, fewer than HEAVY names
        numbers = lambda column, block: np.concatenate([_numbers(r[column]) for r in about_all if r.block == block] or [np.zeros(0, np.int64)])  # noqa: B023, E731
        if k == 1:
            plan["tokens"], plan["distinct"] = int(numbers("totals", -1).sum()), int(numbers("kinds", -1).sum())
        names, place = np.unique(numbers("counts", -1).view(np.uint64), return_inverse=True)
        plan["heavy"][k] = (names, *(np.bincount(place, numbers(c, -1), len(names)) for c in ("totals", "kinds"))) if k > 1 else (names, None, None)
        heavy = np.unique(numbers("counts", -2).view(np.uint64))

    def score(row: pd.DataFrame, mine: pd.DataFrame) -> pd.DataFrame:
        if not len(row):
            return pd.DataFrame({c.split()[0]: [] for c in SCORE_SCHEMA.split(", ")})
        block = _Block(row.iloc[0])
        known, base, full = Automaton(block, mine, plan).traverse()
        missing = np.frombuffer(row.iloc[0].no_id, "u1")
        ids = [None if m else int(i) for i, m in zip(np.frombuffer(row.iloc[0].doc_ids, "<i8"), missing, strict=True)]
        return pd.DataFrame({"doc_id": pd.array(ids, "Int64"), "held_out": block.held_out, "n_tokens": block.lengths, "n_known": known, "base_score": base, "score": full})

    mine = every[0]
    for more in every[1:]:
        mine = mine.unionByName(more)
    tasks = max(8, -(-size // (BLOCK_TOKENS * TASK_BLOCKS)))
    here, there = blocks.repartition(tasks, "block"), mine.where("block >= 0").repartition(tasks, "block")
    scored = here.groupBy("block").cogroup(there.groupBy("block")).applyInPandas(score, SCORE_SCHEMA)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(plan["tokens"]).cast("long").alias("train_tokens"), "base_score", "score")
