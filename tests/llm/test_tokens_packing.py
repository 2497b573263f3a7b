from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from graphloom.llm import packing, token_output
from graphloom.llm.tokens import default_vocabulary, encoder

ODD = [
    None, "", " \n\t", "plain words here", "don't STOP <|endoftext|>x ab<|endoftext|>", "éa É\x1cb a\xa0b ΑΣ ΑΣΑ İstanbul x_y a1b2", "漢字 “q” \U0001d4b3 ß, ǅ a'b's ​z",
    "#&&& a--b (c) 3.14 10,000", "ﬁ ŉ K Å ͅx", "word " * 5000,
]


def test_cached_words_give_the_ids_of_whole_texts():
    enc = encoder(default_vocabulary())
    for text in ODD:
        got = np.frombuffer(enc.encode(text), "<u2").tolist()
        assert got == enc.tokenizer.encode(text or "", add_special_tokens=False).ids


def library_ids(text):
    """Ids of a whole text by the library alone."""
    return encoder(default_vocabulary()).tokenizer.encode(text or "", add_special_tokens=False).ids


def test_ids_are_the_library_s_for_all_of_unicode():
    """Every code point beside letters, digits and marks, and random words of the lower blocks."""
    enc, rng = encoder(default_vocabulary()), random.Random(3)
    points = [c for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    words = [f"a{chr(c)}b, {chr(c)}x 1{chr(c)}" for c in [*points[:0x3400], *rng.sample(points, 4000)]]
    words += ["".join(chr(rng.randint(33, 0x250)) for _ in range(rng.randint(1, 7))) for _ in range(20_000)] + ["m² x½ café² a① ⅷⅧ 日本² Ⅷ ³"]
    wrong = [w for w in words if np.frombuffer(enc.encode(w), "<u2").tolist() != library_ids(w)]
    assert not wrong


def test_a_full_memory_changes_no_ids(monkeypatch):
    from graphloom.llm import tokens

    monkeypatch.setattr(tokens, "CACHE_WORDS", 3)
    enc = tokens.WordEncoder(default_vocabulary())
    text = "one two, three one four! five two six one seven, one"
    assert all(np.frombuffer(enc.encode(text), "<u2").tolist() == library_ids(text) and len(enc) <= 3 and len(enc.older) <= 3 for _ in range(3))


@pytest.mark.parametrize("n", [0, 1, 2, 63, 64, 129, 5000, 140_000])
@pytest.mark.parametrize("kind", ["zipf", "same", "uniform"])
def test_coder_round_trip(n, kind):
    rng = np.random.default_rng(n)
    ids = {"zipf": lambda: np.minimum(rng.zipf(1.3, n), 49407), "same": lambda: np.full(n, 7), "uniform": lambda: rng.integers(0, 65536, n)}[kind]().astype("<u2")
    data = token_output.encode_ids(ids)
    assert np.array_equal(token_output.decode_ids(data, n), ids)
    if kind == "same" and n > 100_000:
        assert len(data) < n / 4


def test_blocks_notice_damage():
    block = token_output.pack_block([3, None], [2, 1], np.array([5, 2, 2], "<u2"))
    ids, lengths, tokens = token_output.unpack_block(block)
    assert (ids, lengths.tolist(), tokens.tolist()) == ([3, None], [2, 1], [5, 2, 2])
    for i in (0, len(block) // 2, len(block) - 1):
        with pytest.raises(ValueError, match="checksum"):
            token_output.unpack_block(block[:i] + bytes([block[i] ^ 1]) + block[i + 1 :])


@pytest.fixture(scope="module")
def odd_docs(spark):
    rows = [(i * 3 - 5 if i else None, t, "junk") for i, t in enumerate(ODD)] + [(4, "again", "x"), (4, "again", "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, part string")


def expected(docs, end):
    return [(r.doc_id, library_ids(r.text) + [end], r.text) for r in docs.collect()]


def test_token_files(spark, odd_docs, monkeypatch):
    monkeypatch.setattr(token_output, "BLOCK_IDS", 16)
    files = token_output.write_token_files(odd_docs)
    found = token_output.read_token_files(files).orderBy("start").collect()
    assert [r.doc_id for r in found][1:] == sorted(r.doc_id for r in found[1:]) and found[0].doc_id is None
    at = 0
    for r in found:
        assert r.start == at
        at += r.n_tokens
    key = lambda d, ids: (str(d), ids)
    assert sorted(key(r.doc_id, np.frombuffer(r.ids, "<u2").tolist()) for r in found) == sorted(key(d, ids) for d, ids, _ in expected(odd_docs, 2))
    for r in found:
        ids = np.frombuffer(r.ids, "<u2").astype("<u4")
        assert (r.n_tokens, r.ids_crc32) == (len(ids), zlib.crc32(ids.tobytes()))
    short = token_output.read_token_files(files, with_ids=False)
    assert short.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and sorted(map(tuple, short.collect()), key=str) == sorted((tuple(r)[:4] for r in found), key=str)
    assert token_output.read_token_files(token_output.write_token_files(odd_docs.limit(0))).count() == 0


def test_rows_of_one_id_are_dealt_over_files(spark, monkeypatch):
    monkeypatch.setattr(token_output, "FILE_BYTES", 200)
    docs = spark.range(400, numPartitions=4).selectExpr("cast(null as long) as doc_id", "concat('word ', id % 7) as text")
    files = token_output.write_token_files(docs)
    assert files.groupBy("part").agg({"n_docs": "sum"}).agg({"sum(n_docs)": "max"}).first()[0] < 200
    assert token_output.read_token_files(files).count() == 400


@pytest.mark.parametrize("seed", range(4))
def test_histogram_packing_places_everything(seed):
    rng = random.Random(seed)
    counts = Counter(min(64, 1 + int(rng.expovariate(1 / 20))) for _ in range(3000))
    patterns = packing.pack_histogram(dict(counts), 64)
    placed: Counter = Counter()
    for lengths, n in patterns:
        assert sum(lengths) <= 64
        for x in lengths:
            placed[x] += n
    assert placed == counts
    filled = sum(k * n for k, n in counts.items()) / 64 / sum(n for _, n in patterns)
    assert filled > 0.98
    assert packing.pack_histogram({}, 64) == []


def test_pieces_fill_sequences_without_gaps(spark, odd_docs):
    found = packing.pack_documents(odd_docs, max_tokens=32).collect()
    rows = defaultdict(list)
    for r in found:
        rows[r.sequence_id].append(r)
    assert sorted(rows) == list(range(len(rows)))
    for pieces in rows.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at and r.length * 2 == len(r.ids)
            at += r.length
        assert at <= 32
    want = Counter(zlib.crc32(np.array(ids, "<u2").tobytes()) for _, ids, _ in expected(odd_docs, 1))
    docs = defaultdict(list)
    for r in found:
        docs[r.doc_id].append(r)
    assert sum(r.length for r in found) == sum(len(ids) for _, ids, _ in expected(odd_docs, 1))
    long = sorted(docs[22], key=lambda r: r.start)
    assert zlib.crc32(b"".join(r.ids for r in long)) in want and {r.doc_tokens for r in long} == {sum(r.length for r in long)}
    assert packing.pack_documents(odd_docs.limit(0)).count() == 0


def test_a_known_word_with_a_capital_or_a_mark_is_not_cut_again(monkeypatch):
    from graphloom.llm import tokens

    encoder = tokens.WordEncoder(tokens.default_vocabulary())
    cut = []
    monkeypatch.setattr(encoder, "_piece", lambda piece, real=encoder._piece: cut.append(piece) or real(piece))
    whole = lambda text: b"".join(i.to_bytes(2, "little") for i in encoder.tokenizer.encode(text, add_special_tokens=False).ids)
    text = "Grumbling, grumbling GRUMBLING. grumbling Éclairs éclairs, Éclairs"
    assert encoder.encode(text) == whole(text)
    assert [x for x in cut if x.isalpha()] == ["grumbling", "éclairs"]
    encoder.words = 1  # what is forgotten is cut once more, and right
    assert encoder.encode(text * 3) == whole(text * 3)


def test_words_of_any_case_are_remembered_once_and_right():
    """Texts are lower-cased first, but not where a mark joins the small letter alone or a special token would arise."""
    from graphloom.llm import tokens

    enc = tokens.WordEncoder(default_vocabulary())
    enc.encode("Grumbling GRUMBLING, grumbling gRumbling,")
    assert len(enc) == 2  # the word, and the word with its mark
    texts = ["J\u030cA J\u030c AJ\u030c H\u0331 I\u0307 A\u0301", "<|ENDOFTEXT|> Ab<|EndOfText|>C <|endoftext|>D", "ÉÈÀ Ÿ\u017dŠ Ǆ I'LL Don'T X\u02b0Y", "\x1cA\x85B\xa0C"]
    for text in [*texts, " ".join(texts)]:
        assert np.frombuffer(enc.encode(text), "<u2").tolist() == library_ids(text)


def test_blocks_written_in_other_lanes_are_read(monkeypatch):
    ids = np.random.default_rng(5).integers(0, 49000, 9000).astype("<u2")
    monkeypatch.setattr(token_output, "LANES", 7)
    block = token_output.pack_block([1], [9000], ids)
    monkeypatch.setattr(token_output, "LANES", 16384)
    assert np.array_equal(token_output.unpack_block(block)[2], ids)
