"""Main text of web pages by wrappers inferred per host.

A page is a stream of tags and texts.  Pages of one host come from templates,
so their streams are aligned into a union-free regular expression: a sequence
of tags, text slots, optional groups and repeated groups.  Inference starts
from one page of the host and takes in one page after another; where a page
differs, runs that repeat become a repeated group, what only one side has
becomes an optional group, and texts become a slot.  A slot whose text never
changes over different pages is part of the template; one inside a menu, an
advert, a form or reader comments is not article either.  The wrapper then
labels the texts of every page of the host.  A page of which it keeps nothing
is its own wrapper of one page.

All pages of a host teach.  They are reduced to their symbol sequences, distinct
ones per host are counted, and the wrappers are widened in rounds: of the
sequences that don't fit yet, up to ``PICKED`` a host (twice as many each round,
``PICKED_MOST`` at most) are aligned, until every sequence fits.  A round bounds
what one task aligns, not what is learnt.  The votes and texts of the slots are
then summed over all different pages, so a host with a third of all pages is
never one task's work.
"""

from __future__ import annotations

import hashlib
import html
import json
import re
from collections.abc import Iterable, Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import is_small, written

#: Sequences of a host that the first round aligns, and that any round aligns at most.
PICKED, PICKED_MOST = 64, 1024
#: Parts that the pages of a host are dealt in where the wrappers are too many to be broadcast.
SALTS = 32

#: Elements that are left out with all that they hold, and a tag with its quoted values.
_SILENT = "script|style|noscript|template|textarea|svg|iframe|title|select|button"
_INSIDE = r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>"
_TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<({_SILENT})\b{_INSIDE}.*?(?:</\1\s*>|\Z)|<[a-zA-Z/!?]{_INSIDE}|(?P<rest><?[^<]+|<)", re.DOTALL | re.IGNORECASE)
#: The same where quotes are not to be trusted: a tag ends at the next ``>``.
_PLAIN_TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<({_SILENT})\b[^>]*>.*?(?:</\1\s*>|\Z)|<[a-zA-Z/!?][^>]*>|(?P<rest><?[^<]+|<)", re.DOTALL | re.IGNORECASE)
_TEXT_ONLY = re.compile(r"()(?P<rest><?[^<]+|<)")
_TAG_BEGINS = re.compile(r"<[a-zA-Z/!?]")
_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
_NAME = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.IGNORECASE)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
#: Tags that an open tag of the same name ends.
_ALONE = frozenset("p li dt dd tr td th option".split())
_OUTSIDE = frozenset("nav aside footer form head dialog menu fieldset".split())
_MAIN = frozenset("article main".split())
#: Words of class, id and role that name what is not the article, and words that say nothing beside them.
_OUTSIDE_NAMES = frozenset(
    "ad ads advert adverts advertisement sponsor sponsored promo banner cookie cookies consent notice notices alert popup modal overlay nav navigation navbar menu breadcrumb breadcrumbs "
    "sidebar side aside widget footer related share sharing social subscribe newsletter signup login search comment comments commentlist replies disqus pagination pager complementary contentinfo skip".split()
)
_LAYOUT_NAMES = frozenset(
    "area bar block body bottom box btn button buttons column col container content footer form fixed grid group header holder inner item items left link links list main mobile outer page panel post posts primary right row secondary section site slot sticky "
    "stories story text thread title to top unit user wrap wrapper articles article news icons by the".split()
)


def _is_outside(names: list[str]) -> bool:
    """Whether one whole name is made of words for what is not the article, and of layout words beside them."""
    for name in names:
        words = [w for w in re.split(r"[_-]+", name) if w and not w.isdigit()]
        if any(w in _OUTSIDE_NAMES for w in words) and all(w in _OUTSIDE_NAMES or w in _LAYOUT_NAMES for w in words):
            return True
    return False


TEXT = ""


def _raw_tokens(page: str) -> Iterator[tuple[str, bool]]:
    """(token, whether it is left out) in time that grows with the page alone.

    A tag whose quotes never close is looked at to the end of the page once;
    from there on tags end at the next ``>``, and after the last one all is text.
    """
    at, last, pattern = 0, page.rfind(">"), _TOKEN
    while at < len(page):
        if pattern is not _TEXT_ONLY and at > last and not page.startswith("<!--", at):
            pattern = _TEXT_ONLY
        m = pattern.match(page, at)
        if pattern is _TOKEN and m["rest"] and _TAG_BEGINS.match(page, at):
            pattern = _PLAIN_TOKEN
            continue
        yield m[0], bool(m[1])
        at = m.end()


def tokens(page: str) -> list[tuple[str, str]]:
    """(symbol, text) of a page: a tag's name with its class, id and role names, or TEXT.

    Comments, scripts, styles and the like are left out, blank texts too.
    """
    out: list[tuple[str, str]] = []
    held: list[str] = []  # parts of the text that is open
    for raw, silent in _raw_tokens(page):
        if silent or raw.startswith("<!"):
            continue
        tag = _TAG.match(raw)
        if tag and raw.endswith(">"):
            if held:
                out.append((TEXT, "".join(held)))
                held = []
            name = tag[2].lower()
            if tag[1]:
                out.append(("/" + name, ""))
            else:
                names = " ".join(sorted({w for n in _NAME.findall(raw) for w in "".join(n).lower().split() if not w.isdigit()})) if "=" in raw else ""
                out.append((f"{name} {names}" if names else name, ""))
        elif held or not raw.isspace():
            held.append(raw)
        elif out:
            out.append((" ", raw))
    return [*out, (TEXT, "".join(held))] if held else out


class _Stack:
    """Open elements, tolerant of tags that are never closed."""

    def __init__(self) -> None:
        self.open: list[tuple[str, bool, bool]] = []  # name, outside the article, inside it

    def feed(self, symbol: str) -> None:
        name, _, names = symbol.partition(" ")
        if name.startswith("/"):
            for i in range(len(self.open) - 1, -1, -1):
                if self.open[i][0] == name[1:]:
                    del self.open[i:]
                    return
            return
        if name in _VOID:
            return
        if name in _ALONE and any(o[0] == name for o in self.open[-3:]):
            self.feed("/" + name)
        outside, inside = (self.open[-1][1], self.open[-1][2]) if self.open else (False, False)
        inside = inside or name in _MAIN
        outside = outside or name in _OUTSIDE or (name == "header" and not inside) or bool(names) and name not in ("body", "html", "article", "main") and _is_outside(names.split())
        self.open.append((name, outside, inside))

    def label(self) -> str:
        """"main" inside an article, "out" in what surrounds it, "?" elsewhere."""
        _, outside, inside = self.open[-1] if self.open else ("", False, False)
        return "out" if outside else "main" if inside else "?"


def labels_of(stream: list[tuple[str, str]]) -> list[str]:
    """The label of each text of a stream."""
    stack, out = _Stack(), []
    for symbol, _ in stream:
        if symbol == TEXT:
            out.append(stack.label())
        elif symbol != " ":
            stack.feed(symbol)
    return out


# A wrapper is a list of nodes: a symbol, ["?", nodes] or ["+", nodes].


def fold(symbols: list) -> list:
    """Runs that repeat become repeated groups, the shortest first, until none is left."""
    out, period, ids = list(symbols), 1, None
    while period <= len(out) // 2:
        if period > 1:
            if ids is None:
                names: dict[str, int] = {}
                ids = np.array([names.setdefault(_key(n), len(names)) for n in out])
            apart = np.flatnonzero(np.concatenate(([True], ids[:-period] != ids[period:], [True])))
            if (np.diff(apart) <= period).all():  # nothing repeats at this distance
                period += 1
                continue
        i, new, changed = 0, [], False
        while i < len(out):
            unit, n = out[i : i + period], 1
            while len(unit) == period and out[i + n * period : i + (n + 1) * period] == unit:
                n += 1
            body = unit[0][1] if n == 1 and period == 1 and isinstance(unit[0], list) and unit[0][0] == "+" else None
            if n > 1:
                new.append(unit[0] if period == 1 and isinstance(unit[0], list) and unit[0][0] == "+" else ["+", unit])
                i, changed = i + n * period, True
            elif body and out[i + 1 : i + 1 + len(body)] == body:
                new.append(unit[0])  # one more round of the group beside it
                i, changed = i + 1 + len(body), True
            else:
                new.append(out[i])
                i += 1
        if changed:
            ids = None
        out, period = new, 1 if changed else period + 1
    return out


def _key(node: str | list) -> str:
    return node if isinstance(node, str) else "\0" + json.dumps(node)


def align(wrapper: list, page: list) -> list:
    """The wrapper widened so that it also fits the folded page."""
    out: list = []
    a, b = [_key(_bare(n)) for n in wrapper], [_key(n) for n in page]
    for op, i, j, k, m in SequenceMatcher(None, a, b, autojunk=False).get_opcodes():
        if op == "equal":
            out += wrapper[i:j]
            continue
        left, right = wrapper[i:j], page[k:m]
        if len(left) == len(right) and all(_both_repeat(x, y) for x, y in zip(left, right, strict=True)):
            out += [_merge(x, y) for x, y in zip(left, right, strict=True)]
        else:
            for part in (left, right):
                fixed = [n for n in part if not (isinstance(n, list) and n[0] == "?")]
                out += [["?", fixed]] if fixed and len(fixed) == len(part) else [n if isinstance(n, list) and n[0] == "?" else ["?", [n]] for n in part]
    return out


def _bare(node: str | list) -> str | list:
    """What an optional group of one node stands for."""
    return node[1][0] if isinstance(node, list) and node[0] == "?" and len(node[1]) == 1 else node


def _both_repeat(x: str | list, y: str | list) -> bool:
    return isinstance(x, list) and isinstance(y, list) and x[0] == y[0] == "+"


def _merge(x: list, y: list) -> list:
    return ["+", align(x[1], y[1])]


def _fit(nodes: list, symbols: list[str], at: int, slot: int, slots: list[int]) -> tuple[int, int] | None:
    """Where the nodes end if they fit from ``at``, greedily; slots get the slot of each text met."""
    for node in nodes:
        if isinstance(node, str):
            if at >= len(symbols) or symbols[at] != node:
                return None
            at += 1
            if node == TEXT:
                slots.append(slot)
                slot += 1
            continue
        width, rounds = _slots_in(node[1]), 0
        while True:
            mark = len(slots)
            end = _fit(node[1], symbols, at, slot, slots)
            if end is None or end[0] == at:
                del slots[mark:]
                break
            at, rounds = end[0], rounds + 1
            if node[0] == "?":
                break
        if node[0] == "+" and not rounds:
            return None
        slot += width
    return at, slot


def _slots_in(nodes: list) -> int:
    return sum(_slots_in(n[1]) if isinstance(n, list) else n == TEXT for n in nodes)


class Matcher:
    """Fits pages to a wrapper: greedily, and where that fails by all ways at once."""

    def __init__(self, wrapper: list) -> None:
        self.wrapper = wrapper
        self.code: list[tuple] = []  # (symbol, slot), or (None, first choice, second choice)
        self.after: dict[int, dict[str | None, list[int]]] = {}

    def slots(self, symbols: list[str]) -> list[int] | None:
        """The slot of each text of a page, or None where the wrapper doesn't fit."""
        slots: list[int] = []
        end = _fit(self.wrapper, symbols, 0, 0, slots)
        return slots if end and end[0] == len(symbols) else self._exact(symbols)

    def _compile(self, nodes: list, slot: int) -> int:
        for node in nodes:
            if isinstance(node, str):
                self.code.append((node, slot))
                slot += node == TEXT
                continue
            start = len(self.code)
            if node[0] == "?":
                self.code.append(())
                slot = self._compile(node[1], slot)
                self.code[start] = (None, start + 1, len(self.code))
            else:
                slot = self._compile(node[1], slot)
                self.code.append((None, start, len(self.code) + 1))
        return slot

    def _next(self, at: int) -> dict[str | None, list[int]]:
        """Places that read a symbol next, by symbol and in the order of a greedy walk; None is the end."""
        found = self.after.get(at)
        if found is None:
            found, todo, seen = {}, [at], set()
            while todo:
                i = todo.pop()
                if i in seen:
                    continue
                seen.add(i)
                if i == len(self.code):
                    found.setdefault(None, []).append(i)
                elif self.code[i][0] is None:
                    todo += [self.code[i][2], self.code[i][1]]
                else:
                    found.setdefault(self.code[i][0], []).append(i)
            self.after[at] = found
        return found

    def _exact(self, symbols: list[str]) -> list[int] | None:
        if not self.code:
            self._compile(self.wrapper, 0)
        steps: list[dict[int, int]] = [{-1: -1}]  # place: the place read before it
        for symbol in [*symbols, None]:
            now: dict[int, int] = {}
            for before in steps[-1]:
                for place in self._next(before + 1).get(symbol, ()):
                    now.setdefault(place, before)
            if not now:
                return None
            steps.append(now)
        place, slots = len(self.code), []
        for step in reversed(steps[1:]):
            if place < len(self.code) and self.code[place][0] == TEXT:
                slots.append(self.code[place][1])
            place = step[place]
        return slots[::-1]


def fit(wrapper: list, symbols: list[str]) -> list[int] | None:
    """The slot of each text of a page, or None where the wrapper doesn't fit."""
    return Matcher(wrapper).slots(symbols)


def main_text(page: str | None, model: dict | None) -> tuple[str, bool]:
    """The article's text, and whether the wrapper fits the page."""
    stream = tokens(page or "")
    symbols = [s for s, _ in stream if s != " "]
    slots = model["matcher"].slots(symbols) if model else None
    wanted = [s in model["keep"] for s in slots] if slots is not None else []
    if not any(wanted):  # no wrapper, or none of its slots: the page is its own wrapper
        labels = labels_of(stream)
        best = "main" if "main" in labels else "?"
        wanted = [x == best for x in labels]
    blocks, block, i = [], [], 0
    for symbol, text in stream:
        if symbol == TEXT:
            if wanted[i]:
                block.append(html.unescape(text))
            i += 1
        elif symbol == " ":
            block.append(" ")
        elif symbol.lstrip("/").partition(" ")[0] not in _INLINE:
            blocks.append(block)
            block = []
    blocks.append(block)
    return " ".join(filter(None, (" ".join("".join(b).split()) for b in blocks))), slots is not None


class _Matchers(dict):
    """Matchers by the wrapper's JSON, kept while a task meets it."""

    def __missing__(self, wrapper: str) -> Matcher:
        if len(self) >= 1000:
            self.clear()
        self[wrapper] = made = Matcher(json.loads(wrapper))
        return made


def _sequences(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Symbols of each page, and a hash of each of its texts."""
    for batch in batches:
        symbols, texts = [], []
        for page in batch.html:
            stream = tokens(page)
            symbols.append(json.dumps([s for s, _ in stream if s != " "]))
            texts.append([int.from_bytes(hashlib.blake2b(x.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True) for s, x in stream if s == TEXT])
        yield batch[["host", "page"]].assign(symbols=symbols, texts=texts)


def _widen(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """The host's wrapper, if it has one, widened by the picked sequences."""
    rows = rows.sort_values("hash")
    known = rows["wrapper"].iloc[0]
    matcher = Matcher(json.loads(known)) if isinstance(known, str) else None
    for symbols in map(json.loads, rows["symbols"]):
        if matcher is None:
            matcher = Matcher(fold(symbols))
        elif matcher.slots(symbols) is None:
            matcher = Matcher(align(matcher.wrapper, fold(symbols)))
    return pd.DataFrame({"host": [key[0]], "wrapper": [json.dumps(matcher.wrapper)]})


def _unfit(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    matchers = _Matchers()
    for batch in batches:
        yield batch[[matchers[w].slots(json.loads(s)) is None for w, s in zip(batch.wrapper, batch.symbols, strict=True)]][["host", "symbols"]]


def _votes(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For each slot, summed within the task: texts, votes to keep it, whether one is in an article, least and greatest text hash."""
    matchers, seen, met = _Matchers(), {}, {}
    columns = ["host", "slot", "n", "votes", "inside", "least", "most"]
    for batch in batches:
        for host, wrapper, symbols, texts in zip(batch.host, batch.wrapper, batch.symbols, batch.texts, strict=True):
            if (host, symbols) not in met:
                if len(met) >= 5000:
                    met.clear()
                names = json.loads(symbols)
                labels = labels_of([(s, "") for s in names])
                best = "main" if "main" in labels else "?"
                met[host, symbols] = [(slot, x == best, x == "main") for slot, x in zip(matchers[wrapper].slots(names), labels, strict=True)]
            for (slot, vote, inside), text in zip(met[host, symbols], texts, strict=True):
                got = seen.get((host, slot))
                if got is None:
                    seen[host, slot] = [1, int(vote), inside, text, text]
                else:
                    got[0] += 1
                    got[1] += vote
                    got[2] |= inside
                    got[3], got[4] = min(got[3], text), max(got[4], text)
        if len(seen) > 200_000:
            yield pd.DataFrame([(*k, *v) for k, v in seen.items()], columns=columns)
            seen = {}
    if seen:
        yield pd.DataFrame([(*k, *v) for k, v in seen.items()], columns=columns)


def _extract(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    models: dict[str | None, dict | None] = {None: None}
    for batch in batches:
        out = []
        for page, model in zip(batch.html, batch.model, strict=True):
            if model not in models:
                if len(models) > 1000:
                    models = {None: None}
                parts = json.loads(model)
                models[model] = {"matcher": Matcher(json.loads(parts["wrapper"])), "keep": set(parts["keep"])}
            out.append(main_text(page, models[model]))
        yield batch[["page_id", "url"]].assign(text=[t for t, _ in out], fits=[f for _, f in out])


def _joined(rows: DataFrame, by_host: DataFrame, spread: str, how: str = "left") -> DataFrame:
    """Rows with their host's row; where there are many hosts, dealt by host and the column ``spread``."""
    if is_small(by_host):
        return rows.join(F.broadcast(by_host), "host", how)
    salted = by_host.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int")).join(salted, ["host", "salt"], how)


def _wrappers(sequences: DataFrame) -> DataFrame:
    """(host, wrapper): a wrapper for each host that fits all of its distinct sequences (host, symbols)."""
    wrappers, left, classes = None, sequences, PICKED
    while True:
        hashed = left.withColumn("hash", F.xxhash64("symbols"))
        picked = hashed.groupBy("host", F.pmod("hash", F.lit(classes)).alias("class")).agg(F.min("hash").alias("hash"), F.min_by("symbols", F.struct("hash", "symbols")).alias("symbols"))
        picked = picked.withColumn("wrapper", F.lit(None).cast("string")) if wrappers is None else picked.join(wrappers, "host", "left")
        grown = written(picked.groupBy("host").applyInPandas(_widen, "host string, wrapper string"), "wrappers")
        wrappers = grown if wrappers is None else written(wrappers.join(grown, "host", "left_anti").unionByName(grown), "wrappers")
        left = written(_joined(left, grown, "symbols", "inner").select("host", "symbols", "wrapper").mapInPandas(_unfit, "host string, symbols string"), "unfit-sequences")
        if left.isEmpty():
            return wrappers
        classes = min(2 * classes, PICKED_MOST)


def extract_main_text(pages: DataFrame) -> DataFrame:
    """Main text of every page: page_id, url, text, fits (the host's wrapper fits).

    ``pages`` has page_id, url and html.  Null, empty and text-free pages give
    an empty text; a null or odd url belongs to the host "" ; repeated rows each
    give a row; an empty table gives none; other columns are ignored; pages of
    any length are read whole.  A slot is kept if most of the texts that it takes
    are in an article, or - on pages that have none - outside what surrounds
    articles and not the same on every different page of the host.
    """
    host = F.lower(F.coalesce(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit("")))
    rows = pages.select(F.col("page_id").cast("decimal(20,0)").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"), host.alias("host"))
    read = rows.where("html <> ''").select("host", F.xxhash64("html").alias("page"), "html").mapInPandas(_sequences, "host string, page long, symbols string, texts array<long>")
    read = written(read.where("symbols <> '[]'").dropDuplicates(["host", "page"]), "page-sequences")
    wrappers = _wrappers(written(read.select("host", "symbols").distinct(), "host-sequences"))
    counted = _joined(read, wrappers, "page").select("host", "wrapper", "symbols", "texts").mapInPandas(_votes, "host string, slot int, n long, votes long, inside boolean, least long, most long")
    slots = counted.groupBy("host", "slot").agg(*[F.sum(c).alias(c) for c in ("n", "votes")], F.max("inside").alias("inside"), F.min("least").alias("least"), F.max("most").alias("most"))
    fixed = (F.col("n") > 2) & (F.col("least") == F.col("most"))
    keep = slots.where((F.col("votes") * 2 > F.col("n")) & (F.col("inside") | ~fixed)).groupBy("host").agg(F.sort_array(F.collect_list("slot")).alias("keep"))
    models = wrappers.join(keep, "host", "left").select("host", F.to_json(F.struct("wrapper", F.coalesce("keep", F.array().cast("array<int>")).alias("keep"))).alias("model"))
    joined = _joined(rows, written(models, "wrappers"), "html")
    out = joined.select("page_id", "url", "html", "model").mapInPandas(_extract, "page_id decimal(20,0), url string, text string, fits boolean")
    return out.select(F.col("page_id").cast("long").alias("page_id"), "url", "text", "fits")
