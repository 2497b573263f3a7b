"""The filter audit against counting every document in every order."""

from __future__ import annotations

import re
from itertools import permutations

import duckdb
import pytest
from pyspark.sql import functions as F

from graphloom.llm import filter_audit, queries

LONG = " ".join(f"w{i}" for i in range(250))
TEXTS = [None, "", LONG, LONG, "Same Same same", "Same Same same", "x " * 300, LONG + " #", "ÀÉÎ " * 210, LONG.upper(), "\tA\x0bB\x0cC\r\n", "v" * 100_000 + " " + LONG]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("audit"))
    rows = [(i, t, None if i == 2 else "a" if i % 3 else "", 1, "x") for i, t in enumerate(TEXTS)] + [(4, TEXTS[4], "a", 1, "x"), (3, LONG, "b", 1, "x"), (None, LONG, "b", 1, "x"), (None, None, "b", 1, "x")]
    spark.createDataFrame(rows, "doc_id long, text string, source string, mask int, part string").coalesce(1).write.parquet(f"{path}/documents.parquet")
    labels = [(0, 1, 0), (0, 0, 1), (2, 1, None), (3, 1, 1), (3, 1, 1), (6, None, 1), (9, 0, 0), (99, 1, 1), (None, 1, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{path}/labels.parquet")
    return path


def brute(rows, labels):
    good, toxic = ({i for i, *x in labels if x[k] == 1 and i is not None} for k in (0, 1))
    least, docs = {}, []
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(least.get(t or "", i), i)
    for i, t, part in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = [len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), bool(re.search(r"[#$%&*|]", t)), i is not None and i > least[t]]
        docs.append((part or "", {x for x, f in zip("ABCDE", fails, strict=True) if f}, i in good, i in toxic))
    out, shares = {}, {}
    for part in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == part]
        for order in map("".join, permutations("ABCDE")):
            for step, x in enumerate(order, 1):
                earlier = set(order[: step - 1])
                here = [d for d in own if x in d[1] and not d[1] & earlier]
                shares[part, x] = shares.get((part, x), 0) + len(here)
                out[part, order, step] = (sum(not d[1] & {*earlier, x} for d in own), len(here), sum(x in d[1] and bool(d[1] & earlier) for d in own), sum(d[1] == {x} for d in own), sum(d[2] for d in here), sum(d[3] for d in here))
    return {(*k, *v, shares[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_audit_equals_brute_force_and_its_sql(spark, folder):
    df = queries.op11_filter_audit(spark, folder)
    found = [tuple(r) for r in df.collect()]
    rows = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    labels = [tuple(r) for r in spark.read.parquet(f"{folder}/labels.parquet").collect()]
    assert len(found) == len(set(found)) == 600 * len({r[2] or "" for r in rows})
    assert set(found) == brute(rows, labels)
    con = duckdb.connect()
    for name in ("documents", "labels"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet/*.parquet'")
    assert set(con.execute(f"SELECT {', '.join(df.columns)} FROM ({queries.OP11_SQL})").fetchall()) == set(found)


def test_empty_tables(spark, folder):
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    assert filter_audit.audit_filters(docs.limit(0), labels).count() == 0
    lost = filter_audit.audit_filters(docs, labels.limit(0)).agg(F.sum("good_lost"), F.sum("toxic_lost"), F.sum("removed")).first()
    assert lost[:2] == (0, 0) and lost[2] > 0


@pytest.mark.parametrize("filters", [1, 3])
def test_sums_are_inverted_exactly(spark, filters):
    masks = spark.range(100).select(F.lit("p").alias("part"), (F.col("id") * F.col("id") % (1 << filters)).cast("int").alias("mask"))
    cells = filter_audit.mask_cells(filter_audit.parity_sums(masks, ["part"], filters), ["part"], filters).first().cells
    assert cells == [sum(i * i % (1 << filters) == m for i in range(100)) for m in range(1 << filters)]
    with pytest.raises(Exception, match="parity sums of no table"):
        filter_audit.mask_cells(spark.createDataFrame([("p", [3, 2])], "part string, w array<long>"), ["part"], 1).collect()
