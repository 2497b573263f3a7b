"""The operators applied to the tables of a data folder, and SQL to hold them against."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table


def _crc32(ids: pd.Series) -> pd.Series:
    return ids.map(lambda b: zlib.crc32(np.frombuffer(b, "<u2").astype("<u4").tobytes())).astype("int64")


def ids_crc32(ids: str) -> Column:
    """crc32 of 16-bit ids written as unsigned 32-bit little-endian integers."""
    return F.pandas_udf(_crc32, "long")(ids)


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_output import read_token_files, write_token_files

    return read_token_files(write_token_files(table(spark, sf_dir, "documents")), with_ids=False)


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm_score import score_texts

    return score_texts(table(spark, sf_dir, "documents"))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat_format import format_chat, tool_definitions

    messages = table(spark, sf_dir, "conversations")
    tools = tool_definitions(messages)
    return format_chat(messages, None if tools.isEmpty() else tools).withColumn("violations", F.array_join("violations", ","))


def op4_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_extract import extract_main_text

    return extract_main_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "fits")


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secret_scan import scan_secrets, span_text

    found = scan_secrets(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"].isin("assign", "access", "hex"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(span_text(base), 256).alias("base_sha256"), span_text(F.col("spans")).alias("spans"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import score_toxicity

    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("text_hash")


def op7_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dup import fp_hex, near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", fp_hex(F.col("fp")).alias("fingerprint"), "component_id")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import find_contamination

    found = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ann import search

    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    pieces = pack_documents(table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", ids_crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .filter_audit import audit_filters

    return audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .source_audit import audit_sources

    return audit_sources(table(spark, sf_dir, "documents"))


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import identify_languages

    return identify_languages(table(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score", "accepted")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


#: Every 13-word window of the benchmark against every one of the documents.
OP8_SQL = """
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '') AS words FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '') AS words FROM benchmark),
bw AS (SELECT DISTINCT item, least(len(words), 13) AS n, array_to_string(words[i:i + least(len(words), 13) - 1], ' ') AS win FROM (SELECT item, words, unnest(range(1, greatest(len(words) - 12, 1) + 1)) AS i FROM b WHERE len(words) > 0)),
lens AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(words[i:i + n - 1], ' ') AS win FROM (SELECT doc_id, words, n, unnest(range(1, len(words) - n + 2)) AS i FROM d, lens WHERE len(words) >= n)),
hit AS (SELECT doc_id, i, dw.n AS n, item FROM dw JOIN bw ON dw.win = bw.win AND dw.n = bw.n),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM hit)) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(words) AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""


#: Messages, calls and results with their links; no conversation here depends on calls.
OP3_SQL = """
WITH m AS (SELECT *, CASE WHEN role = 'assistant' AND ltrim(text, ' ') LIKE '{%' AND contains(text, '"tool_calls"') THEN TRY_CAST(text AS JSON) END AS call,
                  CASE WHEN role IN ('tool', 'function') AND ltrim(text, ' ') LIKE '{%' THEN TRY_CAST(text AS JSON) END AS result FROM conversations),
e AS (SELECT conv_id, turn, 0 AS item, CASE WHEN result ->> 'tool_call_id' IS NOT NULL THEN 'result' ELSE 'message' END AS kind, role, result ->> 'tool_call_id' AS call_id, result -> 'content' AS value, NULL AS name, CASE WHEN json_array_length(call -> 'tool_calls') > 0 THEN call ->> 'content' ELSE text END AS content FROM m
      UNION ALL
      SELECT conv_id, turn, i, 'call', role, call ->> ('$.tool_calls[' || (i - 1) || '].id'), call -> ('$.tool_calls[' || (i - 1) || '].arguments'), call ->> ('$.tool_calls[' || (i - 1) || '].name'), NULL
      FROM (SELECT *, unnest(range(1, coalesce(CAST(json_array_length(call -> 'tool_calls') AS BIGINT), 0) + 1)) AS i FROM m)),
c AS (SELECT conv_id, call_id, min(turn) AS call_turn FROM e WHERE kind = 'call' AND call_id IS NOT NULL GROUP BY ALL),
r AS (SELECT conv_id, call_id, max(turn) AS answer_turn FROM e WHERE kind = 'result' GROUP BY ALL)
SELECT e.conv_id, e.turn, CAST(item AS INTEGER) AS item, kind, role, e.call_id,
  CASE WHEN kind = 'message' THEN e.turn ELSE coalesce(call_turn, e.turn) END AS anchor,
  CAST(CASE WHEN kind = 'call' THEN 1 WHEN kind = 'result' AND call_turn IS NOT NULL THEN 2 ELSE 0 END AS INTEGER) AS level,
  CASE WHEN kind = 'call' THEN CASE WHEN answer_turn >= call_turn THEN 'linked' ELSE 'unanswered' END
       WHEN kind = 'result' THEN CASE WHEN call_turn IS NULL THEN 'orphan' WHEN e.turn < call_turn THEN 'early' ELSE 'linked' END ELSE 'plain' END AS status,
  '' AS violations,
  CAST(CASE kind WHEN 'call' THEN to_json({'arguments': value, 'id': e.call_id, 'name': name, 'type': 'tool_call'}) WHEN 'result' THEN to_json({'content': value, 'role': role, 'tool_call_id': e.call_id}) ELSE to_json({'content': content, 'role': role}) END AS VARCHAR) AS json
FROM e LEFT JOIN c ON e.conv_id = c.conv_id AND e.call_id = c.call_id LEFT JOIN r ON e.conv_id = r.conv_id AND e.call_id = r.call_id
"""


#: Every document tested by every filter, then counted for every order and step.
OP11_SQL = """
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
firsts AS (SELECT t, min(doc_id) AS least FROM d GROUP BY t),
lab AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS tox FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, 0) AS good, coalesce(tox, 0) AS tox,
             concat(CASE WHEN len(w) < 200 THEN 'A' ELSE '' END, CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END,
                    CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) THEN 'C' ELSE '' END,
                    CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END, CASE WHEN d.doc_id > least THEN 'E' ELSE '' END) AS fails
      FROM d LEFT JOIN firsts USING (t) LEFT JOIN lab ON d.doc_id = lab.doc_id),
c AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(tox) AS tox FROM f GROUP BY ALL),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM l a, l b, l c, l d, l e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT filter_order, CAST(step AS INTEGER) AS step, filter_order[step] AS x, substr(filter_order, 1, step - 1) AS earlier FROM o, range(1, 6) AS r(step)),
j AS (SELECT part, filter_order, step, x, n, good, tox, fails = x AS alone, contains(fails, x) AS own, length(translate(fails, earlier, '')) < length(fails) AS gone FROM c, s)
SELECT part, filter_order, step, CAST(coalesce(sum(n) FILTER (NOT own AND NOT gone), 0) AS BIGINT) AS kept, CAST(coalesce(sum(n) FILTER (own AND NOT gone), 0) AS BIGINT) AS removed,
  CAST(coalesce(sum(n) FILTER (own AND gone), 0) AS BIGINT) AS redundant, CAST(coalesce(sum(n) FILTER (alone), 0) AS BIGINT) AS unique_fails,
  CAST(coalesce(sum(good) FILTER (own AND NOT gone), 0) AS BIGINT) AS good_lost, CAST(coalesce(sum(tox) FILTER (own AND NOT gone), 0) AS BIGINT) AS toxic_lost,
  CAST(sum(coalesce(sum(n) FILTER (own AND NOT gone), 0)) OVER (PARTITION BY part, x) AS BIGINT) AS shapley
FROM j GROUP BY part, filter_order, step, x
"""


#: Every kept term of a language in every one of its groups, zeros written out.
OP12_SQL = """
WITH d AS (SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents),
t AS (SELECT i, lang, source, unnest(w) AS term FROM d),
k AS (SELECT lang, term, CAST(count(*) AS HUGEINT) AS n FROM t GROUP BY ALL HAVING count(DISTINCT i) >= 3),
l AS (SELECT lang, count(*) AS v, sum(n) AS total FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN k USING (lang, term) GROUP BY ALL),
gt AS (SELECT lang, source, CAST(sum(n) AS HUGEINT) AS total FROM c GROUP BY ALL),
grid AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + 1000000000 * (coalesce(c.n, 0) + 1)::HUGEINT // (coalesce(gt.total, 0) + l.v) AS p, 1 + 1000000000 * (k.n + 1) // (l.total + l.v) AS q
         FROM g JOIN k USING (lang) JOIN l USING (lang) LEFT JOIN gt ON g.lang = gt.lang AND g.source = gt.source LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
pv AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM grid a JOIN grid b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pv ON pv.lang = a.lang AND pv.source = a.source AND pv.item = b.source),
terms AS (SELECT lang, source, term AS item, (p - q) * (p - q) // q AS value FROM grid WHERE n > 0 AND p > q),
r AS (SELECT 'pair' AS part, *, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pairs UNION ALL SELECT * FROM (SELECT 'term' AS part, *, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM terms) WHERE rank <= 200)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM r
"""


def oracle_sql() -> dict[str, str]:
    return {"op11_filter_audit": OP11_SQL, "op12_source_audit": OP12_SQL, "op3_chat_format": OP3_SQL, "op8_decontaminate": OP8_SQL}
