"""The source audit against whole-number arithmetic on every kept term of every group."""

from __future__ import annotations

import re
from collections import Counter

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from graphloom.llm import queries, source_audit

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
BASE = "the cat sat on the mat Été été ÉTÉ x1y2 THE"
ROWS = (
    [("en", "a", BASE + f" own{i % 2}") for i in range(4)] + [("en", "b", "the cat " * (i + 1)) for i in range(3)] + [("en", "c", None), ("en", "d", "1234 !!"), ("en", "b", "cat " * 50_000)]
    + [("de", None, "der hund") for _ in range(3)] + [("de", "a", "der der"), ("fr", "a", "le"), ("fr", "b", "la"), (None, "z", "q q q"), (None, None, "")]
    + [("en", "a", BASE)] * 3
)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sources"))
    rows = [(i, t, lang, source, "x", 1) for i, (lang, source, t) in enumerate(ROWS)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, term string, n int").coalesce(2).write.parquet(f"{path}/documents.parquet")
    return path


def brute(rows, top=200):
    docs = [(lang or "", source or "", Counter(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(LOWER)))) for lang, source, t in rows]
    out = set()
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        df = Counter(t for d in own for t in d[2])
        kept = sorted(t for t, n in df.items() if n >= source_audit.MIN_DOCS)

        def p_of(group, kept=kept):
            count = Counter()
            for d in group:
                count.update({t: d[2][t] for t in kept if d[2][t]})
            n = sum(count.values())
            return count, {t: 1 + 10**9 * (count[t] + 1) // (n + len(kept)) for t in kept}

        groups = {s: p_of([d for d in own if d[1] == s]) for s in {d[1] for d in own}}
        q = p_of(own)[1]
        f = lambda p, q: (p - q) ** 2 // q
        for s, (count, p) in groups.items():
            pairs = [(sum(f(p[t], other[1][t]) for t in kept), item) for item, other in groups.items() if item != s]
            terms = [(f(p[t], q[t]), t) for t in kept if count[t] and p[t] > q[t]]
            for part, found in (("pair", pairs), ("term", terms)):
                for rank, (value, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode())), 1):
                    if part == "pair" or rank <= top:
                        out.add((lang, s, part, item, value, rank))
    return out


def test_audit_equals_brute_force_and_its_sql(spark, folder, monkeypatch):
    df = queries.op12_source_audit(spark, folder)
    found = [tuple(r) for r in df.collect()]
    assert len(found) == len(set(found)) and set(found) == brute(ROWS)
    assert ("en", "c", "pair") in {r[:3] for r in found} and not {r for r in found if r[:3] == ("en", "c", "term")}
    assert {r[4] for r in found if r[0] == "fr"} == {0}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    assert set(con.execute(f"SELECT {', '.join(df.columns)} FROM ({queries.OP12_SQL})").fetchall()) == set(found)


def test_top_and_empty_table(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert {tuple(r) for r in source_audit.audit_sources(docs, top=1).collect()} == brute(ROWS, 1)
    assert source_audit.audit_sources(docs.limit(0)).count() == 0


def test_tallies_in_small_steps(monkeypatch):
    """Terms in few and many sources, tallied a few pairs at a time and handed on early."""
    vectors = [("l", [f"s{i:02d}" for i in range(k)], [(i + k) % 3 + 1 for i in range(k)]) for k in (1, 2, 7, 7, 19)]
    batch = pa.RecordBatch.from_arrays([pa.array([v[0] for v in vectors]), pa.array([v[1] for v in vectors]), pa.array([v[2] for v in vectors], pa.list_(pa.int64()))], names=["lang", "sources", "counts"])
    monkeypatch.setattr(source_audit, "PAIRS_AT_ONCE", 5)
    monkeypatch.setattr(source_audit, "HELD_CELLS", 20)
    found = Counter()
    for part in source_audit._tally([batch, batch.slice(2, 3)]):
        for r in part.to_pylist():
            found[r["a"], r["b"], r["ca"], r["cb"]] += r["n"]
    want = Counter((s[i], s[j], c[i], c[j]) for _, s, c in vectors + vectors[2:] for i in range(len(s)) for j in range(i + 1, len(s)))
    assert found == want


def test_shares_of_counts_beyond_64_bits(spark):
    n = 5 * 10**12
    row = spark.range(1).select(source_audit.billionths(F.lit(n), F.lit(3 * n), F.lit(7)).alias("p"), source_audit.billionths(F.lit(0), F.lit(0), F.lit(0)).alias("none")).first()
    assert row.p == 1 + 10**9 * (n + 1) // (3 * n + 7) and row.none is None


def test_terms_are_counted_with_one_shuffle_and_cut_at_ascii_alone(spark, monkeypatch):
    plan = source_audit.term_rows
    monkeypatch.setattr(source_audit, "written", lambda df, name: df if name == "divergence-terms" else df.limit(0))
    kept, _ = plan(spark.createDataFrame([(i, "Ab\xa0c\x85d ab3X_ é" + chr(0x1680), "xx", "s" + str(i % 2)) for i in range(4)], "doc_id long, text string, lang string, source string"))
    assert kept._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert {(r.term, r.n_lang, tuple(r.sources), tuple(r.counts)) for r in kept.collect()} == {(t, 4, ("s0", "s1"), (2, 2)) for t in ("ab\xa0c\x85d", "ab", "x", " é ")}
