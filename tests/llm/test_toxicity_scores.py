"""Toxicity on a sampled table against dense vectors over every term of the examples."""

from __future__ import annotations

import math
import re
import weakref
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from graphloom.llm import queries, tokens, toxicity
from graphloom.llm.common import tidy

SF = "/root/testdata/sf0.01"


def terms(text):
    words = re.findall(r"[^\W_]+", (text or "").lower())
    return Counter(words + ["^" + w[:4] for w in words if len(w) >= 4])


def brute(docs, labels):
    """By doc_id: sorted cosines over 0 of the examples with their labels, and the vote, from dense vectors."""
    texts = {}
    for i, t in docs:
        texts.setdefault(i, t)
    known = {i: x for i, x in labels if zlib.crc32(str(i).encode()) % 5 and i in texts}
    ids = sorted(known)
    y = np.array([known[i] for i in ids])
    held = [terms(texts[i]) for i in ids]
    names = {t: k for k, t in enumerate(sorted(set().union(*held)))}
    n = [int((y == c).sum()) for c in (0, 1)]
    power = np.zeros(len(names))
    frequency = Counter(t for _, text in docs for t in terms(text))
    for t, k in names.items():
        with_t = [sum(t in h for h, c in zip(held, y, strict=True) if c == label) for label in (0, 1)]
        same = (sum(with_t) + 0.5) / (sum(n) + 1)
        ratio = 0.0
        for label in (0, 1):
            own = (with_t[label] + 0.5) / (n[label] + 1)
            ratio += 2 * (with_t[label] * math.log(own / same) + (n[label] - with_t[label]) * math.log((1 - own) / (1 - same)))
        ratio = max(ratio, 0.0)
        power[k] = (math.log((1 + len(docs)) / (1 + frequency[t])) + 1) * (1e-3 + 0.999 * (ratio / (ratio + 10)) ** 2)

    def vector(text):
        v = np.zeros(len(names))
        for t, c in terms(text).items():
            if t in names:
                v[names[t]] = (1 + math.log(c)) * power[names[t]]
        size = np.linalg.norm(v)
        return v / size if size else v

    matrix = np.array([vector(texts[i]) for i in ids])
    usable = [x for i, x in labels if zlib.crc32(str(i).encode()) % 5]
    weight = np.where(y == 1, usable.count(1) / n[1], usable.count(0) / n[0])
    prior = min(max(weight[y == 1].sum() / weight.sum(), 1e-3), 0.5)
    out = {}
    for i, text in texts.items():
        cosine = matrix @ vector(text)
        best = [j for j in np.argsort(-np.round(cosine, 12), kind="stable")[: toxicity.K] if cosine[j] > 1e-13]
        out[i] = cosine, best, ids, y, weight, prior
    return out


@pytest.fixture(scope="module")
def sample(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id % 3 = 0").select("doc_id", "text")
    odd = spark.createDataFrame([(5001, None), (5002, "!! 12"), (5003, "Ω unheard"), (5004, "scum " * 50_000), (5005, "SCUM! scum")], "doc_id long, text string")
    docs = docs.unionByName(odd).withColumn("terms", F.lit("clash")).withColumn("score", F.lit(1.0)).withColumn("toxic", F.lit(7))
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "toxic")
    return docs.cache(), labels.cache()


def test_neighbours_and_votes_equal_dense_vectors(sample):
    docs, labels = sample
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    known = [(r.doc_id, r.toxic) for r in labels.collect()]
    want = brute(rows, known)
    found = {r.doc_id: r for r in toxicity.score_toxicity(docs, labels).collect()}
    assert found.keys() == want.keys()
    without = 0
    for i, r in found.items():
        cosine, best, ids, y, weight, prior = want[i]
        assert np.allclose([e.cosine for e in r.evidence], cosine[best], atol=1e-9)
        at = {x: j for j, x in enumerate(ids)}
        voters = np.array([at[e.doc_id] for e in r.evidence], int)
        assert np.allclose(cosine[voters], cosine[best], atol=1e-9) and [e.toxic for e in r.evidence] == y[voters].tolist()
        power = weight[voters] * cosine[voters] / (1.05 - np.minimum(cosine[voters], 1))
        pull = weight.mean() * 0.5
        assert abs(r.vote - (power @ y[voters] + pull * prior) / (power.sum() + pull)) < 1e-8
        assert bool(r.evidence) == bool((cosine > 1e-13).any())
        without += not r.evidence
    assert without == 3  # no letter, or no shared term
    # the score is one rising logistic of the vote
    logit = lambda p: np.log(np.clip(p, 1e-4, 1 - 1e-4) / (1 - np.clip(p, 1e-4, 1 - 1e-4)))
    apart = [r for r in found.values() if not any(e.cosine > 1 - 1e-9 for e in r.evidence)]
    x, z = logit(np.array([r.vote for r in apart])), np.array([r.score for r in apart])
    z = np.log(z / (1 - z))
    slope, shift = np.polyfit(x, z, 1)
    assert slope > 0 and np.allclose(z, slope * x + shift, atol=1e-6)
    assert found[5004].predicted == found[5005].predicted == 1 and found[5001].predicted == 0


def test_held_out_rows(spark):
    found = queries.op6_toxicity(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "toxic"), "doc_id").where("held_out").collect()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in found)
    toxic, clean = ([r.predicted for r in found if r.toxic == c] for c in (1, 0))
    assert sum(toxic) / len(toxic) >= 0.7 and sum(clean) / len(clean) <= 0.02


def test_repeated_rows_without_doc_id(spark):
    rows = [(None, "scum you are")] * 3 + [(i, "scum trash" if i % 3 == 0 else "kind words here") for i in range(1, 40)] + [(3, "scum trash")]
    labels = [(i, int(i % 3 == 0)) for i in range(1, 40)]
    found = toxicity.score_toxicity(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    blank = [r for r in found if r.doc_id is None]
    assert len(found) == len(rows) and len(blank) == 3 and len({(r.score, r.held_out) for r in blank}) == 1 and blank[0].predicted == 1 and not blank[0].held_out


def test_equal_cosines_at_the_last_place():
    """Copies tie: the first ones of the index vote, whether their lists are rows or runs."""
    rows = [(np.array([0, 1]), np.array([0.6, 0.8]))] * 30
    for dense in (0.1, 2.0):
        index = toxicity.BlockMaxIndex(rows, 3, block=4, dense=dense)
        places, cosine = index.nearest(np.array([1]), np.array([1.0]), 7)
        assert places.tolist() == list(range(7)) and np.allclose(cosine, 0.8)
        assert index.nearest(np.array([2]), np.array([1.0]), 7)[0].size == 0


def test_many_queries_at_once_equal_each_alone():
    rng = np.random.default_rng(7)
    vectors = [(np.sort(rng.choice(50, 6, replace=False)), rng.random(6)) for _ in range(90)]
    index = toxicity.BlockMaxIndex(vectors[:70], 50, block=8, dense=0.2)
    skip = np.where(np.arange(90) < 70, np.arange(90), -1)
    n, rows, cosine = index.nearest_all(np.full(90, 6), *(np.concatenate([v[i] for v in vectors]) for i in (0, 1)), 5, skip)
    ends = np.cumsum(n)
    for i, (terms, weights) in enumerate(vectors):
        want = np.round([sum(w * dict(zip(*v, strict=True)).get(t, 0.0) for t, w in zip(terms, weights, strict=True)) for v in vectors[:70]], 12)
        want[[x for x in [skip[i]] if x >= 0]] = 0
        got, alone = rows[ends[i] - n[i] : ends[i]], index.nearest(terms, weights, 5, int(skip[i]))[0]
        assert got.tolist() == alone.tolist() and np.allclose(want[got], np.sort(want)[::-1][: len(got)]) and len(got) == min(5, (want > 0).sum())


def test_pieces_of_a_text_give_the_terms_of_the_whole(monkeypatch):
    monkeypatch.setattr(toxicity, "PIECES_AT_ONCE", 3)
    monkeypatch.setattr(toxicity, "HELD_PIECES", 4)
    texts = ["Don't stop, (stopping) co_op co-op!", "", "\x85nbsp\xa0Here ΣΑΣ. Σ İstanbul ... ²x", "stop " * 9 + "a" * 100, "... !!"]
    names = {t: i for i, t in enumerate(sorted({t for x in texts for t in toxicity.terms_of(x)}))}
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(5)), "text": texts})
    found = pa.Table.from_batches(list(toxicity._vectors(names, [batch, batch.slice(2, 2)]))).to_pylist()
    assert [r["doc_id"] for r in found] == [0, 1, 2, 3, 4, 2, 3]
    for r in found:
        assert dict(zip(r["terms"], r["counts"], strict=True)) == Counter(names[t] for t in toxicity.terms_of(texts[r["doc_id"]])) and r["terms"] == sorted(r["terms"])


def test_a_task_drops_what_other_operators_left_in_its_worker():
    left = weakref.ref(tokens.encoder(tokens.default_vocabulary(), 10))
    batch = pa.RecordBatch.from_pydict({"doc_id": [1], "text": ["stop it"]})
    (found,) = tidy(lambda it: toxicity._vectors({"it": 0, "stop": 1}, it))([batch])
    assert found.column("terms").to_pylist() == [[0, 1]] and left() is None
    kept = tokens.encoder(tokens.default_vocabulary())
    assert list(tidy(lambda it: it, "tokens")([1])) == [1] and tokens.encoder(tokens.default_vocabulary()) is kept
