"""Secret scan: strong patterns, and weak parts of multi-part credentials.

Strong spans (an assignment to a secret name, an access identifier, a long hex
string) are always reported.  Endpoints and opaque strings alone are far too
common to report; they become spans only where complementary parts meet:

* ``weak``: an opaque string of mixed letters and digits within ``SCOPE``
  characters of an access identifier;
* ``endpoint``: a URL or host:port within ``SCOPE`` of an access identifier
  that also has a secret part (assignment, hex or weak) within ``SCOPE``.

Parts are linked by an interval join on cells of ``SCOPE`` characters: a part
meets the summary (first start, last end) of each kind in its own and the two
neighbouring cells, so the work is linear in the parts however many share a
scope.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty, tidy, written

# The strong patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_LEAST, ACCESS_LEAST = 6, 20

OPAQUE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{16,}={0,2}")
ENDPOINT = re.compile(r"""(?:https?|s3|wss?)://[^\s"'<>]+|\b[a-z0-9-]+(?:\.[a-z0-9-]+)+:\d{2,5}\b""")
#: Characters within which the parts of one credential are looked for.
SCOPE = 400
#: Kinds in the order in which spans of one start are listed.
KINDS = ("assign", "access", "hex", "weak", "endpoint")


def strong_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the strong kinds, leftmost and non-overlapping within a kind."""
    found = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_LEAST]
    return found + [("hex", m.start(), m.end()) for m in HEX.finditer(text)]


def loose_spans(text: str, strong: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Endpoints, and opaque strings that overlap no other part."""
    found = [("endpoint", m.start(), m.end()) for m in ENDPOINT.finditer(text)]
    taken = sorted((a, b) for _, a, b in strong + found)
    k = 0
    for m in OPAQUE.finditer(text):
        word = m[0]
        while k < len(taken) and taken[k][1] <= m.start():
            k += 1
        if k < len(taken) and taken[k][0] < m.end():
            continue
        if re.search(r"\d", word) and re.search(r"[a-z]", word) and re.search(r"[A-Z]", word):
            found.append(("weak", m.start(), m.end()))
    return found


SPANS = "array<struct<kind:string,start:int,end:int>>"


def _parts(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    from pyspark import TaskContext

    uid = TaskContext.get().partitionId() << 36
    as_rows = lambda spans: [{"kind": k, "start": a, "end": b} for k, a, b in spans]
    for batch in batches:
        base, loose = [], []
        for text in batch["_text"]:
            strong = strong_spans(text)
            base.append(as_rows(strong))
            # a loose part counts near an access identifier only
            loose.append(as_rows(loose_spans(text, strong) if any(s[0] == "access" for s in strong) else []))
        out = batch.drop(columns=["_text"])
        yield out.assign(_uid=range(uid, uid + len(batch)), _base=base, _loose=loose)
        uid += len(batch)


def _linked(part: DataFrame, others: DataFrame) -> DataFrame:
    """Rows of ``part`` (uid, kind, start, end) near some row of ``others``."""
    cell = lambda c: F.floor(F.col(c) / SCOPE)
    # a long part covers several cells
    cells = others.select("uid", "start", "end", F.explode(F.sequence(cell("start"), cell("end"))).alias("cell")).groupBy("uid", "cell").agg(F.min("start").alias("first_start"), F.max("end").alias("last_end"))
    wide = part.select("uid", "kind", "start", "end", F.explode(F.sequence(cell("start") - 1, cell("end") + 1)).alias("cell"))
    near = (F.col("first_start") - F.col("end") <= SCOPE) & (F.col("start") - F.col("last_end") <= SCOPE)
    return wide.join(cells, ["uid", "cell"]).where(near).select("uid", "kind", "start", "end").distinct()


def scan_secrets(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Spans of secrets in the whole text of every row of ``docs``.

    Returns the columns ``keep`` (by default doc_id) and ``spans``, an array of
    (kind, start, end) in code points, end exclusive, by start and then by the
    order of KINDS.  Null and empty texts have no spans; every row, repeated or
    with a null id, gives one row; an empty table gives none; texts of any
    length are scanned whole; columns not in ``keep`` are ignored.
    """
    keep = keep or ["doc_id"]
    names = {c: f"keep_{i}" for i, c in enumerate(keep)}
    rows = docs.select(*[F.col(c).alias(n) for c, n in names.items()], text_or_empty().alias("_text"))
    kept = rows.select(*names.values()).schema
    # whole numbers pass pandas as decimals, so that nulls leave them exact
    via = {f.name: "decimal(20,0)" if f.dataType.simpleString() in ("bigint", "int") else f.dataType.simpleString() for f in kept}
    found = rows.select(*[F.col(n).cast(t).alias(n) for n, t in via.items()], "_text").mapInPandas(tidy(_parts), ", ".join([*(f"{n} {t}" for n, t in via.items()), "_uid long", f"_base {SPANS}", f"_loose {SPANS}"]))
    found = found.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in kept], "_uid", "_base", "_loose")
    parts = written(found, "secret-parts")

    one = lambda column: parts.where(F.size("_loose") > 0).select(F.col("_uid").alias("uid"), F.explode(column).alias("p")).select("uid", "p.*")
    strong, loose = one("_base"), one("_loose")
    access = strong.where("kind = 'access'")
    weak = _linked(loose.where("kind = 'weak'"), access)
    secret = strong.where("kind in ('assign', 'hex')").unionByName(weak)
    complete = _linked(access, secret)
    extra = weak.unionByName(_linked(loose.where("kind = 'endpoint'"), complete))
    extra = extra.groupBy("uid").agg(F.collect_list(F.struct("kind", "start", "end")).alias("extra"))
    order = F.array(*[F.lit(k) for k in KINDS])
    every = F.concat("_base", F.coalesce("extra", F.array().cast(SPANS)))
    ranked = F.array_sort(F.transform(every, lambda s: F.struct(s["start"].alias("start"), F.array_position(order, s["kind"]).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"))))
    spans = F.transform(ranked, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return parts.join(extra, parts["_uid"] == extra["uid"], "left").select(*[F.col(n).alias(c) for c, n in names.items()], spans.alias("spans"))


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with every span, or union of overlapping spans, replaced by ``mark``."""
    start = F.aggregate(
        spans, F.struct(F.lit("").alias("out"), F.lit(0).alias("at")),
        lambda acc, s: F.when(s["start"] < acc["at"], F.struct(acc["out"].alias("out"), F.greatest(acc["at"], s["end"]).alias("at"))).otherwise(
            F.struct(F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark)).alias("out"), s["end"].alias("at"))
        ),
        lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))),
    )
    return F.when(F.size(spans) > 0, start).otherwise(text)


def span_text(spans: Column) -> Column:
    """``kind:start:end`` of all spans, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
