"""Each operator against a plain version of its contract, on odd rows."""

from __future__ import annotations

import json
import math
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import ann, chat_format, components, decontaminate, html_extract, lm_score, near_dup, secret_scan, toxicity
from graphloom.llm.common import written

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TEXTS = [None, "", "  \n", "One", "One two THREE four five six seven", "one two three four five six seven", "Été été x y", "a " * 3000, "a " * 3000, "lorem ipsum dolor sit amet " * 40 + "end"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i if i != 3 else None, t, "s", 9) for i, t in enumerate(TEXTS)] + [(5, TEXTS[5], "s", 9)]
    return spark.createDataFrame(rows, "doc_id long, text string, block string, score long").cache()


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


# --- language model ----------------------------------------------------------


def model_score(rows, order, text):
    train = [words(t) + [0] for i, t in rows if i is None or zlib.crc32(str(i).encode()) % 5 != 1]
    grams = [Counter() for _ in range(order + 1)]
    for w in train:
        for k in range(1, order + 1):
            grams[k].update(tuple(w[i - k + 1 : i + 1]) for i in range(k - 1, len(w)))
    n, v = sum(grams[1].values()), len(grams[1])
    total, kinds = [Counter() for _ in range(order + 1)], [Counter() for _ in range(order + 1)]
    for k in range(2, order + 1):
        for g, c in grams[k].items():
            total[k][g[:-1]] += c
            kinds[k][g[:-1]] += 1
    w, base, score = words(text) + [0], 0.0, 0.0
    for i in range(len(w)):
        p = (grams[1][(w[i],)] + 0.5) / (n + 0.5 * (v + 1))
        base += math.log10(p)
        for k in range(2, order + 1):
            h = tuple(w[i - k + 1 : i])
            if i >= k - 1 and total[k][h]:
                p = max(grams[k][(*h, w[i])] - lm_score.DISCOUNT, 0) / total[k][h] + lm_score.DISCOUNT * kinds[k][h] / total[k][h] * p
        score += math.log10(p)
    return n, len(w), base, score


@pytest.mark.parametrize("order", [1, 2, 3])
def test_lm_scores(docs, order, monkeypatch):
    monkeypatch.setattr(lm_score, "BLOCK_TOKENS", 50)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = sorted(((r.n_tokens, round(r.base_score, 6), round(r.score, 6), r.train_tokens) for r in lm_score.score_texts(docs, order).collect()))
    want = sorted((k, round(b, 6), round(s, 6), n) for n, k, b, s in (model_score(rows, order, t) for _, t in rows))
    assert np.allclose(np.array(got, float), np.array(want, float), atol=1e-5)
    assert lm_score.score_texts(docs.limit(0), order).count() == 0


def test_common_contexts_are_split_at_every_order(docs, monkeypatch):
    """With nearly every context a heavy one, the scores stay the same."""
    monkeypatch.setattr(lm_score, "BLOCK_TOKENS", 50)
    monkeypatch.setattr(lm_score, "SENT_ROWS", 3)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    score = lambda: sorted(round(r.score, 6) for r in lm_score.score_texts(docs, 3).collect())
    monkeypatch.setattr(lm_score, "HEAVY", 50)
    assert np.allclose(score(), sorted(model_score(rows, 3, t)[3] for _, t in rows), atol=1e-5)
    with pytest.raises(ValueError, match="order"):
        lm_score.score_texts(docs, 4)


# --- near duplicates ---------------------------------------------------------


def plain_fingerprint(text):
    import xxhash

    w = words(text)
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))]
    votes = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            votes[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * votes[b] > len(shingles))


def test_fingerprints_and_groups(docs):
    for t in TEXTS:
        assert near_dup.fingerprint(t) == plain_fingerprint(t)
    found = {(r.doc_id, r.component_id) for r in near_dup.near_duplicates(docs).collect()}
    assert {(0, 0), (1, 0), (2, 0), (4, 4), (5, 4), (7, 7), (8, 7)} <= found and near_dup.near_duplicates(docs).count() == docs.count()
    assert near_dup.near_duplicates(docs.limit(0)).count() == 0


@pytest.mark.parametrize("small", [3, 256])
def test_links_have_the_components_of_all_pairs(spark, small):
    rng = np.random.default_rng(5)
    centres = rng.integers(0, 1 << 63, 30, dtype=np.uint64)
    fps = {int(c) for c in centres}
    for c in centres[:12].tolist():
        for _ in range(25):
            x = c
            for b in rng.choice(64, rng.integers(1, 6), replace=False).tolist():
                x ^= 1 << b
            fps.add(x)
    fps |= {0, (1 << 64) - 1, 15, 255, (1 << 64) - 16}
    fps = sorted(fps)
    parent = {f: f for f in fps}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= 4:
                parent[top(a)] = top(b)
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    links = near_dup.link_fingerprints(spark.createDataFrame([(f,) for f in signed], "fp long"), small=small)
    label = {r.node % (1 << 64): r.component for r in components.components(links).collect()}
    groups = {}
    for f in fps:
        groups.setdefault(top(f), set()).add(label.get(f, ("alone", f)))
    assert all(len(g) == 1 for g in groups.values())
    assert len({next(iter(g)) for g in groups.values()}) == len(groups)


# --- decontamination ---------------------------------------------------------


def item_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def plain_hits(doc, bench):
    w, hit, items = item_words(doc), set(), set()
    for item, text in bench:
        b = item_words(text)
        n = min(13, len(b))
        for i in range(len(b) - n + 1 if b else 0):
            for j in range(len(w) - n + 1):
                if w[j : j + n] == b[i : i + n]:
                    hit |= set(range(j, j + n))
                    items.add(str(item))
    return len(w), len(hit), sorted(items)


def test_contamination(spark):
    passage = " ".join(f"w{i}" for i in range(40))
    bench = [(1, passage), (2, "short item here"), (3, ""), (4, None), (5, "x " * 20), (10, passage), (6, "five word item is this")]
    texts = [None, "", "no match at all " * 9, "lead, " + passage.upper() + " tail", " ".join(f"w{i}" for i in range(5, 17)), " ".join(f"w{i}" for i in range(5, 18)), "a Short-item HERE b", "x " * 200, "x " * 12, "five word item is this five word item is this", passage + " " + "filler " * 2000]
    docs = spark.createDataFrame([(i if i else None, t, 1) for i, t in enumerate(texts)] + [(3, texts[3], 1)], "doc_id long, text string, mark int")
    items = spark.createDataFrame(bench, "item_id long, text string")
    for r in decontaminate.find_contamination(docs, items).collect():
        n, hit, names = plain_hits(texts[r.doc_id or 0], bench)
        assert (r.n_words, r.n_hit, r["items"]) == (n, hit, names), r
        assert r.contaminated == (hit > 0 and 20 * hit >= n)
    assert decontaminate.find_contamination(docs, items).count() == docs.count()
    assert decontaminate.find_contamination(docs, items.limit(0)).where("contaminated").count() == 0
    assert decontaminate.find_contamination(docs.limit(0), items).count() == 0


# --- secrets -----------------------------------------------------------------


def test_secret_spans(spark):
    key = "AKIA" + "Q7" * 8
    texts = {
        1: f"x {key} y Password: 'abcdef' token=short z {'ab12' * 7}", 2: "api_key=12345", 3: None, 4: "", 5: f"{key} wJalrXUtnFEMI/K7MDENG/bPxRfiCYEX1 at https://s3.host.example/b",
        6: "wJalrXUtnFEMI/K7MDENG/bPxRfiCYEX1 alone https://s3.host.example/b", 7: f"{key} " + "pad " * 400 + "wJalrXUtnFEMI/K7MDENG/bPxRfiCYEX1", 8: "\U0001f600 secret = abcdefgh",
    }
    docs = spark.createDataFrame([(i, t, "k") for i, t in texts.items()] + [(None, texts[8], "k"), (8, texts[8], "k")], "doc_id long, text string, kind string")
    found = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans] for r in secret_scan.scan_secrets(docs).collect()}
    for i, t in texts.items():
        base = sorted(secret_scan.strong_spans(t or ""), key=lambda s: (s[1], secret_scan.KINDS.index(s[0])))
        assert [s for s in found[i] if s[0] in ("assign", "access", "hex")] == base
    assert [s[0] for s in found[1]] == ["access", "assign", "hex"] and found[2] == [] and found[6] == [] and found[None] == found[8]
    assert [s[0] for s in found[5]] == ["access", "weak", "endpoint"]
    assert [s[0] for s in found[7]] == ["access"]
    masked = docs.where("doc_id = 8").limit(1).crossJoin(secret_scan.scan_secrets(docs).where("doc_id = 8").limit(1).select("spans")).select(secret_scan.redact(F.col("text"), F.col("spans"))).first()[0]
    assert masked == "\U0001f600 [SECRET]"
    assert secret_scan.scan_secrets(docs.limit(0)).count() == 0


# --- toxicity ----------------------------------------------------------------


def test_block_max_index_is_exact():
    rng = np.random.default_rng(3)
    rows = []
    for _ in range(500):
        t = np.sort(rng.choice(40, rng.integers(0, 6), replace=False))
        w = rng.random(len(t)) + 0.1
        rows.append((t, w / np.linalg.norm(w) if len(t) else w))
    rows += rows[:100]
    index = toxicity.BlockMaxIndex(rows, 40, block=8)
    place = {int(r): i for i, r in enumerate(index.order)}
    dense = np.zeros((len(rows), 40))
    for i, (t, w) in enumerate(rows):
        dense[i, t] = w
    for t, w in rows[:150]:
        got, cosine = index.nearest(t, w, 10)
        q = np.zeros(40)
        q[t] = w
        score = np.round(dense @ q, 12)
        order = sorted((i for i in range(len(rows)) if score[i] > 0), key=lambda i: (-round(score[i], 9), place[i]))[:10]
        assert np.allclose(cosine, score[order], atol=1e-9)


def test_toxicity_learns_and_generalises(spark):
    rng = np.random.default_rng(1)
    vocab = [f"word{i}" for i in range(200)]
    rows, labels = [], []
    for i in range(600):
        toxic = i % 5 == 0
        text = " ".join(rng.choice(vocab, 60)) + (" grumblefoo" + str(rng.choice(["ing", "ed", "er", ""])) + " snarl" if toxic else "")
        rows.append((i, text, "en"))
        labels.append((i, int(toxic)))
    rows += [(10_000, None, "en"), (10_001, "", "en"), (None, "snarl grumblefooish", "en"), (10_002, "snarl " * 50_000, "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    known = spark.createDataFrame(labels + [(None, 1), (3, None)], "doc_id long, toxic int")
    found = {r.doc_id: r for r in toxicity.score_toxicity(docs, known).collect()}
    held = [(i, t) for i, t in labels if found[i].held_out]
    assert held and all(found[i].predicted == t for i, t in held)
    assert found[10_000].score == found[10_001].score < 0.5 and found[None].predicted == 1 and found[10_002].predicted == 1
    assert all(0 <= r.score <= 1 for r in found.values()) and found[0].evidence
    assert toxicity.score_toxicity(docs.limit(0), known).count() == 0
    assert {r.score for r in toxicity.score_toxicity(docs.limit(5), known.limit(0)).collect()} == {0.0}


def test_a_copy_of_a_toxic_example_is_toxic_without_any_telling_word(spark):
    """No word tells the classes apart; copies, ties and the doc_ids change nothing."""
    rng = np.random.default_rng(4)
    texts = [" ".join(rng.choice([f"w{i}" for i in range(300)], 12)) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(1000 + i, t) for i, t in enumerate(texts)]
    labels = [(i, int(i % 3 == 0)) for i in range(60)]
    one = {r.doc_id: r for r in toxicity.score_toxicity(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    taught = [i for i in range(60) if not one[i].held_out]
    assert any(i % 3 == 0 for i in taught) and all(one[1000 + i].predicted == one[i].predicted == int(i % 3 == 0) for i in taught)
    assert all(one[1000 + i].score == one[i].score for i in range(60))


# --- nearest neighbours ------------------------------------------------------


@pytest.mark.parametrize("part", [50, 4096])
def test_outliers_get_all_their_neighbours(spark, monkeypatch, part):
    monkeypatch.setattr(ann, "PART", part)
    rng = np.random.default_rng(2)
    dense = np.repeat(np.eye(24)[:10], 300, axis=0) + rng.normal(0, 0.01, (3000, 24))
    lone = rng.normal(0, 1, (40, 24)) * 4
    vectors = np.concatenate((dense, lone[:, :] * (np.arange(24) > 11)))
    is_query = (F.col("vec_id") % 10 == 0) & (F.col("vec_id") < 3000) | (F.col("vec_id") >= 3037)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    found: dict[int, list[int]] = {}
    for r in ann.search(rows, is_query).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append(r.vec_id)
    asked = [*range(0, 3000, 10), *range(3037, 3040)]
    assert {i: len(found.get(i, [])) for i in asked} == dict.fromkeys(asked, 20)
    right = sum(len({j for j in np.argsort(-(vectors @ vectors[i]), kind="stable")[:21].tolist() if j != i} & set(found[i])) for i in asked)
    assert right >= 0.9 * 20 * len(asked)


def test_neighbours_of_odd_vectors(spark):
    """Null, zero, non-finite and odd-length vectors, null ids, ties, repeats and clashing columns against brute force."""
    rng = np.random.default_rng(8)
    good = {i: rng.integers(-3, 4, 6).astype(float).tolist() for i in range(0, 300)}  # small whole numbers: many ties and equal vectors
    good = {i: v for i, v in good.items() if any(v)}
    odd = [(1000, None), (1020, [0.0] * 6), (1040, [float("nan")] + [1.0] * 5), (1060, [float("inf")] + [1.0] * 5), (1080, [1.0, None] + [1.0] * 4), (1100, [1.0] * 5), (1120, []), (None, [1.0] * 6)]
    rows = [(i, v, 1, 0.5) for i, v in [*good.items(), *list(good.items())[:40], *odd]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int, score double")
    found: dict[int, list] = {}
    for r in ann.search(df, F.col("vec_id") % 20 == 0, recall=1.0).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.score, r.vec_id))
    asked = [i for i in good if i % 20 == 0]
    assert sorted(found) == asked
    met = wanted = 0
    for i in asked:
        exact = sorted(((-float(np.dot(good[i], v)), j) for j, v in good.items() if j != i))[:20]
        assert [r for r, _, _ in found[i]] == list(range(1, 21))
        assert all(s == float(np.dot(good[i], good[j])) for _, s, j in found[i]) and found[i] == sorted(found[i], key=lambda x: (-x[1], x[2]))
        met, wanted = met + len({j for _, j in exact} & {j for _, _, j in found[i]}), wanted + 20
    assert met >= 0.9 * wanted
    assert ann.search(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    few = ann.search(df.where("vec_id in (0, 1, 2)").dropDuplicates(["vec_id"]), F.col("vec_id") == 0)
    assert [r.vec_id for r in few.orderBy("rank").collect()] == [j for _, j in sorted((-float(np.dot(good[0], good[j])), j) for j in (1, 2))]


def test_recall_beyond_the_calibration(spark):
    """12,000 vectors in clusters; every query but the calibrated ones counts."""
    rng = np.random.default_rng(9)
    vectors = rng.normal(0, 1, (40, 16))[rng.integers(0, 40, 12_000)] + rng.normal(0, 0.4, (12_000, 16))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    found: dict[int, set] = {}
    for r in ann.search(df, F.col("vec_id") % 60 == 0).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    products = vectors[::60] @ vectors.T
    right = sum(len({j for j in np.argsort(-p)[:21].tolist() if j != 60 * n} & found[60 * n]) for n, p in enumerate(products))
    assert right >= 0.9 * 20 * len(products) and all(len(x) == 20 for x in found.values())


# --- pages -------------------------------------------------------------------


def test_names_inside_an_article_count_as_a_whole():
    inside = '<section id="related-work"><p>one</p></section><div class="alert-history">two</div><p class="skip-intro">three</p>'
    beside = '<div class="related-posts">x</div><div class="ad-slot">x</div><a class="skip-link" href="#">x</a><ul class="social-links"><li>x</li></ul>'
    assert html_extract.main_text(f"<nav>menu</nav><article>{inside}{beside}</article>", None)[0] == "one two three"
    assert html_extract.main_text('<article title="a > b <c>">a < b &amp; c</article>', None)[0] == "a < b & c"


@pytest.mark.parametrize("part", ['<a "', "<a ", "<", '<a href="x>', "<!-- ", '<script "', "<p>x", '<div class="a'])
def test_broken_pages_take_time_in_proportion(part):
    import time

    began = time.process_time()
    html_extract.tokens(part * (1_000_000 // len(part)))
    assert time.process_time() - began < 30

PAGE = '<!DOCTYPE html><html><head><title>t</title><script>var a="</p>";</script></head><body><nav><ul>{nav}</ul></nav><div class="ad">buy {n}</div><article><h1>Head {n}</h1>{paras}<div class="comments"><p>reader {n}</p></div></article><footer>&copy; {n}</footer></body></html>'


def page(n, paras):
    return PAGE.format(n=n, nav="".join(f"<li><a href='/{i}'>menu{i}</a></li>" for i in range(n % 4 + 1)), paras="".join(f"<p>para &amp; <b>bold</b>{i} of {n}\n x</p>" for i in range(paras)))


def test_main_text(spark):
    rows = [(i, f"http://h{i % 3}.example/{i}", page(i, i % 5)) for i in range(40)]
    rows += [(100, None, None), (101, "not a url", ""), (102, "http://h0.example/x", "<p>unclosed <b>only"), (103, "http://other.example/", "a < b &lt; c"), (None, "http://h1.example/1", page(1, 2))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("clash"))
    found = {r.page_id: r for r in html_extract.extract_main_text(pages).collect()}
    for i in range(40):
        assert found[i].text == " ".join([f"Head {i}", *[f"para & bold{k} of {i} x" for k in range(i % 5)]])
    assert (found[100].text, found[101].text, found[102].text, found[103].text) == ("", "", "unclosed only", "a < b < c")
    assert found[None].text.startswith("Head 1") and sum(found[i].fits for i in range(40)) > 20
    assert html_extract.extract_main_text(pages.limit(0)).count() == 0


def test_wrapper_grows_by_groups():
    a, b = ["x", "p", "", "/p", "y"], ["x", "p", "", "/p", "p", "", "/p", "p", "", "/p", "z", "y"]
    w = html_extract.align(html_extract.fold(a), html_extract.fold(b))
    assert html_extract.fit(w, a) is not None and html_extract.fit(w, b) is not None
    assert html_extract.fit(w, ["x", "q", "y"]) is None


def test_every_page_of_a_host_teaches(spark):
    extra = lambda i: "".join(f"<h{k + 1}>s{i}</h{k + 1}>" for k in range(6) if i >> k & 1)
    note = lambda i: "same" if i else "other"
    rows = [(i, f"http://one.example/{i}", f"<body><div>{extra(i)}<p>text {i}</p><i>fixed</i><u>{note(i)}</u></div></body>") for i in range(64)]
    pages = spark.createDataFrame(rows * 2, "page_id long, url string, html string")
    found = {r.page_id: r for r in html_extract.extract_main_text(pages).collect()}
    assert all(r.fits for r in found.values())
    for i in range(64):
        assert found[i].text == " ".join([f"s{i}"] * i.bit_count() + [f"text {i}", note(i)])


def test_long_repeated_cards_are_folded():
    card = ["div", *[x for k in range(12) for x in (f"t{k}", "", f"/t{k}")], "/div"]
    w = html_extract.fold(["body", *card * 3, "/body"])
    assert w == ["body", ["+", card], "/body"] and html_extract.fit(w, ["body", *card * 7, "/body"]) is not None


def test_a_wrapper_fits_whatever_it_was_aligned_with():
    rng = np.random.default_rng(4)
    pages = [rng.choice(["a", "b", "", "c"], rng.integers(1, 14)).tolist() for _ in range(60)]
    w = html_extract.fold(pages[0])
    for p in pages[1:]:
        w = html_extract.align(w, html_extract.fold(p))
    assert all(len(html_extract.fit(w, p)) == p.count("") for p in pages)


# --- chat --------------------------------------------------------------------


def test_chat(spark):
    call = {"content": "ok", "tool_calls": [{"id": "a", "name": "f", "arguments": {"z": 1, "b": {"y": 2, "x": [1, None]}}}, {"id": "b", "name": "g", "arguments": {"q": "s"}, "depends_on": ["a"]}]}
    rows = [
        (1, 0, "user", "hi"), (1, 1, "assistant", json.dumps(call)), (1, 2, "tool", json.dumps({"tool_call_id": "b", "content": "B"})), (1, 3, "tool", json.dumps({"tool_call_id": "a", "content": {"k": 1}})),
        (1, 4, "assistant", "{broken"), (1, 5, "tool", json.dumps({"tool_call_id": "zz", "content": 1})), (2, 0, "assistant", json.dumps({"tool_calls": [{"id": "c", "name": "f", "arguments": "x", "depends_on": ["c", "missing"]}]})),
        (None, None, None, None), (3, 0, "user", ""), (3, 0, "user", ""), (4, 0, "user", "long " * 50_000),
    ]
    chat = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("level", F.lit("clash"))
    schemas = spark.createDataFrame([("f", "z", "string", True), ("f", "b", "object", False), ("f", "w", "integer", True), ("g", "q", "string", True)], "tool string, name string, type string, required boolean")
    found = chat_format.format_chat(chat, schemas)
    assert found.count() == len(rows) + 3
    one = [(r.kind, r.call_id, r.status, r.violations) for r in found.where("conv_id = 1").orderBy("anchor", "level", "turn", "item").collect()]
    assert one == [("message", None, "plain", []), ("message", None, "plain", []), ("call", "a", "linked", ["missing:w", "type:z"]), ("result", "a", "linked", []), ("call", "b", "linked", []), ("result", "b", "linked", []), ("message", None, "plain", []), ("result", "zz", "orphan", [])]
    assert found.where("call_id = 'a' and kind = 'call'").first().json == '{"arguments":{"b":{"x":[1,null],"y":2},"z":1},"id":"a","name":"f","type":"tool_call"}'
    assert found.where("call_id = 'c'").first().violations == ["arguments:not an object"]
    assert chat_format.format_chat(chat.limit(0), schemas).count() == 0


def test_long_chains_and_real_circles(spark):
    call = lambda i, *needs: {"id": i, "name": "f", "arguments": {}, "depends_on": list(needs)}
    chain = [call(f"c{i:02}", *([f"c{i + 1:02}"] if i < 39 else [])) for i in range(40)]
    # two circles, x before p, a call between them, and calls ahead of and behind both
    rings = [call("end", "q"), call("p", "q", "mid"), call("q", "p"), call("mid", "x"), call("x", "y"), call("y", "z"), call("z", "x", "first"), call("first"), call("self", "self")]
    rows = [(1, 0, "assistant", json.dumps({"tool_calls": chain})), (2, 0, "assistant", json.dumps({"tool_calls": rings}))]
    found = chat_format.format_chat(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).where("kind = 'call'").collect()
    at = {r.call_id: (r.anchor, r.level) for r in found}
    assert {r.call_id for r in found if r.status == "cyclic"} == {"p", "q", "x", "y", "z"}
    assert [at[f"c{i:02}"] for i in range(40)] == [(0, 79 - 2 * i) for i in range(40)]
    assert at["first"] < at["z"] and at["x"] < at["mid"] < at["p"] and at["q"] < at["end"]


def test_shuffle_files_of_a_written_table_go_at_once(spark, docs):
    """Those of the language model's exchanges would add up on the disk."""
    held = docs.select(F.col("doc_id").alias("k")).repartition(3, "k")
    manager = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager()
    shuffles = lambda: {str(b) for b in manager.getAllBlocks().mkString(" ").split() if b.startswith("shuffle_")}
    before, setting = shuffles(), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(setting)
    table = written(held, "shuffled")
    ends = time.time() + 10
    while shuffles() - before and time.time() < ends:
        time.sleep(0.1)
    assert not shuffles() - before and table.count() == docs.count() and spark.conf.get(setting) == was
