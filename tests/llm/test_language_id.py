"""Languages: held-out accuracy, the folded model against a plain one, slices, odd rows."""

from __future__ import annotations

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import language_id, queries

SF = "/root/testdata/sf0.01"


def plain_subwords(text):
    """Buckets by walking over the text, one run of characters at a time."""
    codes = [0, *(ord(c) if c.isalpha() else 0 for c in text.lower()), 0, 0, 0]
    out = []
    for n in range(1, language_id.MAX_N + 1):
        for i in range(len(codes) - n + 1):
            part = codes[i : i + n]
            if all(part[1:-1]) and (part[0] or part[-1]):
                h = 0
                for c in part:
                    h = (h * 0x01000193 + c + 1) % 2**32
                mixed = (h ^ (h >> 15) ^ (n * 0x9E3779B1 % 2**32)) * 0x85EBCA6B % 2**32
                out.append(mixed >> (32 - language_id.BUCKETS.bit_length() + 1))
    return out


@pytest.mark.parametrize("text", ["", "a", "Ab c", "1 2 3", "Été où  l'eau\n", "ab" * 40, "x" * 31 + " y", "漢字 かな \U0001d400 z"])
@pytest.mark.parametrize("size", [7, 16, 1 << 19])
def test_subwords_of_slices(monkeypatch, text, size):
    monkeypatch.setattr(language_id, "SLICE", size)
    buckets, counts = language_id.bucket_counts(text)
    want = np.bincount(np.array(plain_subwords(text), np.int64), minlength=language_id.BUCKETS)
    assert dict(zip(buckets.tolist(), counts.tolist(), strict=True)) == {i: int(n) for i, n in enumerate(want) if n}


def test_a_score_is_the_softmax_of_the_average():
    rng = np.random.default_rng(1)
    table, bias = rng.normal(size=(language_id.BUCKETS, 3)), rng.normal(size=3)
    model = language_id.Model(["a", "b", "c"], table, bias, (0.2, 0.1), 0.5)
    texts = ["one two", "", "drei vier fünf", "!!", "x"]
    best, score = model.answers(texts)
    for text, b, s in zip(texts, best, score, strict=True):
        ids = plain_subwords(text)
        if not ids:
            assert (b, s) == (-1, 0.0)
            continue
        z = (table[ids].mean(0) + bias) * np.exp(0.2) * (1 + len(ids)) ** 0.1
        p = np.exp(z) / np.exp(z).sum()
        assert b == p.argmax() and abs(s - p.max()) < 1e-9


def test_accepted_answers_reach_the_precision():
    score, right = np.array([0.9, 0.8, 0.7, 0.6, 0.5]), np.array([1, 1, 0, 1, 0])
    assert [language_id.accepted_from(score, right, p) for p in (1.0, 0.75, 0.6)] == [0.8, 0.6, 0.5]
    assert language_id.accepted_from(score, 1 - right, 1.0) == 1.1


def test_held_out_accuracy(spark):
    found = queries.op13_language_id(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert len(found) == 1000 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in found)
    held = [r for r in found if r.held_out]
    assert sum(r.lang_pred == r.lang for r in held) / len(held) >= 0.98
    assert abs(np.mean([r.score for r in held]) - np.mean([r.lang_pred == r.lang for r in held])) < 0.03
    assert sum(r.lang_pred == r.lang for r in held if r.accepted) / sum(r.accepted for r in held) >= 0.98
    assert all(0 <= r.score <= 1 for r in found)


@pytest.fixture(scope="module")
def odd(spark):
    fold = lambda i: zlib.crc32(str(i).encode()) % 3
    rows = [(i, ("der und das nicht " if i % 2 else "the and that not ") * (1 + i % 5), "de" if i % 2 else "en", "x") for i in range(60)]
    rows += [(100, None, "en", "x"), (101, "", "de", "x"), (102, "12 !?", None, "x"), (None, "und das", "en", "x"), (103, "the not", None, "x"), (104, "and that " * 100_000, "en", "x"), (5, "der und das nicht ", "de", "x"), (5, "der und das nicht ", "de", "x")]
    only = next(i for i in range(200, 300) if fold(i) == 1)
    return spark.createDataFrame([*rows, (only, "ceci est", "never learnt", "x")], "doc_id long, text string, lang string, score string")


def test_odd_rows(spark, odd):
    found = language_id.identify_languages(odd).collect()
    assert len(found) == odd.count()
    by = {}
    for r in found:
        by.setdefault(r.doc_id, []).append(r)
    assert all((by[i][0].lang_pred, by[i][0].score, by[i][0].accepted) == ("und", 0.0, False) for i in (100, 101, 102))
    assert by[None][0].held_out is False and by[None][0].lang_pred == "de" and by[103][0].lang_pred == by[104][0].lang_pred == "en"
    assert len({(r.lang_pred, r.score) for r in by[5] if r.text_hash == by[5][-1].text_hash}) == 1
    assert {r.lang_pred for r in found} == {"de", "en", "und"}


def test_nothing_to_learn_from(spark, odd):
    blank = language_id.identify_languages(odd.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {(r.lang_pred, r.score, r.accepted) for r in blank} == {("und", 0.0, False)}
    assert language_id.identify_languages(odd.limit(0)).count() == 0
