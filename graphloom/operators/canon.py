"""Canonical form and isomorphism of datasets (RDF Dataset Canonicalization 1.0).

Blank nodes are told apart by the hash of their own quads first: one shuffle on
the node.  Nodes whose hash is unique get their identifier from its rank.  The
rest, tied nodes, are few in real data.  They fall into components: tied nodes
that a quad mentions together.  The first run of the N-degree hash within a
component names all of its nodes, and nothing that it reads depends on another
component, so components are worked on side by side; only their order by hash
is global, and it is a prefix sum.  The identifiers are those of the standard.
"""

from __future__ import annotations

import hashlib
from collections.abc import Generator
from itertools import pairwise, permutations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.terms import quad_text
from ..schema import BLANK, COLUMNS
from ..storage import written
from .traverse import connected

#: Runs of the N-degree hash that one component may take, besides ``RUNS`` times the square of its nodes.
BUDGET, RUNS = 200_000, 4
#: Rounds in which the colours of a component must settle to be made use of.
COLOUR_ROUNDS = 16
#: Quads of tied nodes that one task works on, if no component is larger.
TASK_QUADS = 50_000


def _mentions(q: DataFrame) -> DataFrame:
    """A row for each blank node that a quad mentions."""
    places = F.array_distinct(F.array_compact(F.array(*[F.when(F.col(f"{c}_kind") == BLANK, F.col(c)) for c in ("s", "o", "g")])))
    return q.select("*", F.explode(places).alias("node"))


def first_degree_hashes(q: DataFrame, bits: int = 256) -> DataFrame:
    """(node, hash): sha2 of the node's sorted quads, itself written ``_:a`` and others ``_:z``."""
    return _first_degree(q.select(F.lit("").alias("ds"), *COLUMNS).distinct(), bits).drop("ds")


def _first_degree(q: DataFrame, bits: int) -> DataFrame:
    own = lambda c: F.when(F.col(c) == F.col("node"), "_:a").otherwise("_:z")
    line = F.concat(quad_text(True, own("s"), own("o"), own("g")), F.lit("\n"))
    rows = _mentions(q).select("ds", "node", line.alias("line"))
    return rows.groupBy("ds", "node").agg(F.sha2(F.array_join(F.sort_array(F.collect_list("line")), ""), bits).alias("hash"))


def _ranked(rows: DataFrame, key: str, size: Column, name: str) -> DataFrame:
    """``name``: the sum of ``size`` of all rows of a data set before, in the order of a hex ``key``, without one window over everything."""
    rows = rows.withColumn("_part", F.substring(key, 1, 3)).withColumn("_size", size)
    sums = rows.groupBy("ds", "_part").agg(F.sum("_size").alias("_sum"))
    before = sums.select("ds", "_part", (F.sum("_sum").over(Window.partitionBy("ds").orderBy("_part")) - F.col("_sum")).alias("_before"))
    inside = F.sum("_size").over(Window.partitionBy("ds", "_part").orderBy(key).rowsBetween(Window.unboundedPreceding, 0)) - F.col("_size")
    return rows.withColumn("_inside", inside).join(before, ["ds", "_part"]).withColumn(name, F.col("_before") + F.col("_inside")).drop("_part", "_size", "_before", "_inside")


def _data_set(by: str | None) -> Column:
    """A name of a quad's data set, of one length; '' where there is one only."""
    return F.md5(F.coalesce(F.concat(F.lit("="), F.col(by).cast("string")), F.lit(""))) if by else F.lit("")


def _scoped(q: DataFrame, by: str | None) -> DataFrame:
    """Distinct quads with ``ds``; blank nodes of different data sets have different names."""
    rows = q.select(_data_set(by).alias("ds"), *COLUMNS).distinct()
    if by is None:
        return rows
    for c in ("s", "o", "g"):
        rows = rows.withColumn(c, F.when(F.col(f"{c}_kind") == BLANK, F.concat("ds", F.lit("|"), c)).otherwise(F.col(c)))
    return rows


class Issuer:
    """Identifiers in the order in which they are asked for."""

    def __init__(self, prefix: str = "b") -> None:
        self.prefix, self.issued = prefix, {}

    def copy(self) -> Issuer:
        out = Issuer(self.prefix)
        out.issued = dict(self.issued)
        return out

    def issue(self, node: str) -> str:
        return self.issued.setdefault(node, f"{self.prefix}{len(self.issued)}")


class _Ways(dict):
    """The steps from a step of a line to the end, cut when they are asked for."""

    def __init__(self, *lines: list[tuple[str, str]]) -> None:
        self.place = {step: (line, i) for line in lines for i, step in enumerate(line)}

    def __missing__(self, step: tuple[str, str]) -> list[tuple[str, str]]:
        line, i = self.place[step]
        return line[i:]


class Component:
    """N-degree hashes within one component of tied nodes.

    ``quads`` are (s, p, o, g) with None in places that hold no blank node;
    ``settled`` are the identifiers of nodes with a unique hash.
    """

    def __init__(self, quads: list[tuple], hashes: dict[str, str], settled: dict[str, str], bits: int, budget: int) -> None:
        self.hashes, self.settled, self.digest, self.known = hashes, settled, {256: hashlib.sha256, 384: hashlib.sha384, 512: hashlib.sha512}[bits], {}
        self.budget = budget + RUNS * len(hashes) ** 2 if budget >= BUDGET else budget
        self.about: dict[str, list[tuple[str, str, str]]] = {n: [] for n in hashes}
        for s, p, o, g in quads:
            for node in {s, o, g} & hashes.keys():
                self.about[node] += [(place, p, other) for place, other in (("s", s), ("o", o), ("g", g)) if other is not None and other != node]

    def hash(self, text: str) -> str:
        return self.digest(text.encode("utf-8", "surrogatepass")).hexdigest()

    def related(self, node: str, issued: dict[str, str]) -> list[tuple[str, list[str]]]:
        """Blank nodes beside a node, by the hash of how they are related, in the order of the hashes."""
        out: dict[str, list[str]] = {}
        for place, p, other in self.about[node]:
            key = self.key_of(place, p, self.settled.get(other) or issued.get(other), other)
            if key not in out:
                out[key] = [other]
            elif other not in out[key]:
                out[key].append(other)
        return sorted(out.items())

    def n_degree(self, node: str, issuer: Issuer) -> Generator:
        """Asks for the runs that it needs, (node, issuer), and returns (hash, issuer): ``run`` keeps the stack."""
        self.budget -= 1
        if self.budget < 0:
            raise ValueError("canonical identifiers: a component of tied blank nodes needs more work than the budget allows")
        data = ""
        for key, nodes in self.related(node, issuer.issued):
            if len(nodes) == 1:  # one order only: nothing to try, nothing to undo
                other = nodes[0]
                name = self.settled.get(other) or issuer.issued.get(other)
                if name:
                    data += f"{key}_:{name}"
                else:
                    name = issuer.issue(other)
                    found, issuer = yield other, issuer
                    data += f"{key}_:{name}_:{name}<{found}>"
                continue
            best = kept = None
            for order in permutations(nodes):
                tried = yield from self.path(order, issuer.copy(), best)
                if tried and (best is None or tried[0] < best):
                    best, kept = tried
            data += key + best
            issuer = kept
        return self.hash(data), issuer

    def path(self, order: tuple[str, ...], issuer: Issuer, best: str | None) -> Generator:
        """The path that visits the nodes in an order, or None as soon as it can't be the least."""
        worse = lambda: best is not None and len(path) >= len(best) and path > best
        path, ahead = "", []
        for other in order:
            if other in self.settled:
                path += f"_:{self.settled[other]}"
            else:
                if other not in issuer.issued:
                    ahead.append(other)
                path += f"_:{issuer.issue(other)}"
            if worse():
                return None
        for other in ahead:
            found, after = yield other, issuer
            path += f"_:{issuer.issue(other)}<{found}>"
            issuer = after
            if worse():
                return None
        return path, issuer

    def run(self, node: str) -> tuple[str, list[str]]:
        """Hash of a first node, and all nodes in the order in which it names them; as deep as need be, without recursion."""
        issuer = Issuer()
        issuer.issue(node)
        stack, answer = [self.n_degree(node, issuer)], None
        while stack:
            try:
                stack.append(self.n_degree(*stack[-1].send(answer)))
                answer = None
            except StopIteration as end:
                stack.pop()
                answer = end.value
        return answer[0], list(answer[1].issued)

    def key_of(self, place: str, p: str, name: str | None, other: str) -> str:
        what = (place, p, name, None if name else self.hashes[other])
        key = self.known.get(what)
        if key is None:
            key = self.known[what] = self.hash(place + (f"<{p}>" if place != "g" else "") + (f"_:{name}" if name else self.hashes[other]))
        return key

    def is_path(self) -> bool:
        """Whether the tied nodes form one line; then each way along it is a loop over its nodes."""
        self.beside = {n: list(dict.fromkeys(o for _, _, o in around if o in self.about)) for n, around in self.about.items()}
        if sum(map(len, self.beside.values())) != 2 * len(self.about) - 2 or any(len(b) > 2 for b in self.beside.values()):
            return False
        self.links = {(n, o): list(dict.fromkeys((place, p) for place, p, x in around if x == o)) for n, around in self.about.items() for o in self.beside[n]}
        self.fixed = {n: list({self.key_of(place, p, self.settled[o], o): f"_:{self.settled[o]}" for place, p, o in around if o in self.settled}.items()) for n, around in self.about.items()}
        self.seen: dict[tuple, bytes] = {}
        line, end = [], next(n for n, b in self.beside.items() if len(b) < 2)
        while end is not None:
            line.append(end)
            end = next((o for o in self.beside[end] if len(line) < 2 or o != line[-2]), None)
        there, back = list(pairwise(line)), list(pairwise(reversed(line)))
        self.ways = _Ways(there, back)
        # steps (last, now) that differ in nothing but their place are of one kind, and share what is made ready for a number
        kinds: dict[tuple, int] = {}
        self.ready: dict[tuple, tuple[bytes, bytes]] = {}
        self.kinds = {}
        for now, beside in self.beside.items():
            for last in beside:
                ahead = next((o for o in beside if o != last), None)
                what = (tuple(self.fixed[now]), tuple(self.links[now, last]), ahead and (tuple(self.links[now, ahead]), self.hashes[ahead]))
                self.kinds[last, now] = kinds.setdefault(what, len(kinds))
        return True

    def along(self, node: str, came: str, d: int, keep: bool) -> tuple[str, list[str]]:
        """N-degree hash of a node named b<d>, away from its neighbour b0, and the nodes on the way: from the far end back."""
        way = self.ways[came, node]  # the steps from here to the end
        found, todo = (self.seen.get((way[1], d + 1)), 1) if len(way) > 1 else (None, 0)
        if found is None:
            found, todo = b"", len(way)
        ready, kinds, digest = self.ready, self.kinds, self.digest
        for k in range(todo - 1, -1, -1):
            what = (kinds[way[k]], d + k, k > 0)
            before, behind = ready.get(what) or self.step(what, way, k, d)
            found = digest(before + found + behind).hexdigest().encode()
            if keep and k:
                self.seen[way[k], d + k] = found
        self.budget -= todo
        return found.decode(), [now for _, now in way]

    def step(self, what: tuple, way: list[tuple[str, str]], k: int, d: int) -> tuple[bytes, bytes]:
        """What stands before and behind the hash of the nodes ahead in the data of a node: all that depends on its number and kind."""
        last, now = way[k]
        name = f"b{d + k - 1}" if k else "b0"
        parts = self.fixed[now] + [(self.key_of(place, p, name, last), f"_:{name}") for place, p in self.links[now, last]]
        if k + 1 < len(way):
            name, ahead = f"_:b{d + k + 1}", way[k + 1][1]
            keys = sorted(self.key_of(place, p, None, ahead) for place, p in self.links[now, ahead])
            parts += [(key, name if i else f"{name}{name}<\0>") for i, key in enumerate(keys)]
        before, _, behind = "".join(x for part in sorted(parts) for x in part).partition("\0")
        self.ready[what] = out = before.encode(), behind.encode()
        return out

    def run_path(self, node: str) -> tuple[str, list[str]] | None:
        """``run`` on a line; None where both neighbours are related in the same way, so that their order must be tried."""
        parts = [(key, text, None) for key, text in self.fixed[node]]
        for other in self.beside[node]:
            parts += [(self.key_of(place, p, None, other), "", other) for place, p in self.links[node, other]]
        if len({key for key, _, _ in parts}) < len(parts):
            return None
        names, nodes, data = {}, [node], ""
        for key, text, other in sorted(parts, key=lambda t: t[0]):
            if other in names:
                text = names[other]
            elif other is not None:
                d = len(nodes)
                # on the second way a node's number is the same for nearly all first nodes: it is remembered
                found, way = self.along(other, node, d, bool(names))
                names[other] = f"_:b{d}"
                nodes, text = nodes + way, f"_:b{d}_:b{d}<{found}>"
            data += key + text
        return self.hash(data), nodes

    def starts(self, nodes: list[str]) -> list[str]:
        """One of all nodes that only their labels tell apart, where that is cheap to see; else all.

        In a tree, or in a ring, nodes of one stable colour (a node's hash,
        refined by the colours around it) can be swapped without changing the
        graph, so that they have the same hash.
        """
        edges = {frozenset((n, other)) for n, around in self.about.items() for _, _, other in around if other in self.about}
        ring = len(edges) == len(self.about) and all(sum(o in self.about for o in {x for _, _, x in around}) == 2 for around in self.about.values())
        if len(edges) != len(self.about) - 1 and not ring:
            return nodes
        colour, classes = dict(self.hashes), len(set(self.hashes.values()))
        for _ in range(COLOUR_ROUNDS):
            seen: dict[tuple, int] = {}
            near = {n: (colour[n], *sorted((place, p, str(colour.get(other, self.settled.get(other)))) for place, p, other in around)) for n, around in self.about.items()}
            colour = {n: seen.setdefault(k, len(seen)) for n, k in near.items()}
            if len(seen) == classes:
                return list({colour[n]: n for n in reversed(nodes)}.values())
            classes = len(seen)
        return nodes

    def order(self) -> tuple[str, str, list[str]]:
        """Least first-degree hash, least N-degree hash of its bearers, and all nodes in the order in which they are named."""
        least = min(self.hashes.values())
        line = self.is_path()
        best = None
        for node in self.starts(sorted(n for n, h in self.hashes.items() if h == least)):
            found = (self.run_path(node) if line else None) or self.run(node)
            if best is None or found[0] < best[0]:
                best = found
        return least, *best


def _name_components(bits: int, budget: int, rows: pd.DataFrame) -> pd.DataFrame:
    """(component, node, key, size, place) of the components dealt to one task; rows hold their quads and hashes."""
    columns = ["component", "p", *[f"{c}{x}" for c in ("s", "o", "g") for x in ("", "_hash", "_id")]]
    rows = rows[columns].astype(object).where(rows[columns].notna(), None).sort_values("component", kind="stable")
    out = []

    def name(component: str, quads: list[tuple], hashes: dict[str, str], settled: dict[str, str]) -> None:
        least, found, nodes = Component(quads, hashes, settled, bits, budget).order()
        out.extend((component, node, least + found, len(nodes), i) for i, node in enumerate(nodes))

    last, quads, hashes, settled = None, [], {}, {}
    for component, p, *terms in rows.itertuples(index=False, name=None):
        if component != last and quads:
            name(last, quads, hashes, settled)
            quads, hashes, settled = [], {}, {}
        last = component
        for node, hash_, known in (terms[:3], terms[3:6], terms[6:]):
            if known is not None:
                settled[node] = known
            elif hash_ is not None:
                hashes[node] = hash_
        quads.append((terms[0], p, terms[3], terms[6]))
    if quads:
        name(last, quads, hashes, settled)
    return pd.DataFrame(out, columns=["component", "node", "key", "size", "place"])


def _identifiers(q: DataFrame, prefix: str, bits: int, budget: int) -> DataFrame:
    """(ds, node, id) for distinct quads with ``ds``, whose nodes are of one data set each."""
    hashes = written(_first_degree(q, bits), "canon-hashes")
    counts = hashes.groupBy("ds", "hash").agg(F.count("*").alias("n"))
    alone = lambda test: hashes.join(counts.where(test).select("ds", "hash"), ["ds", "hash"], "left_semi")
    name = lambda number: F.concat(F.lit("_:" + prefix), number.cast("string"))
    unique = written(_ranked(alone("n = 1"), "hash", F.lit(1).cast("long"), "rank").select("ds", "node", name(F.col("rank")).alias("id")), "canon-unique")
    tied = written(alone("n > 1").select("ds", "node", "hash"), "canon-tied")
    if tied.isEmpty():
        return unique

    # quads that mention a tied node, with what is known of each of their blank nodes
    rows = _mentions(q).join(tied.select("node"), "node", "left_semi").select(*COLUMNS).distinct()
    for c in ("s", "o", "g"):
        blank = F.when(F.col(f"{c}_kind") == BLANK, F.col(c))
        known = tied.join(unique, "node", "full").select(F.col("node").alias(f"{c}_node"), F.col("hash").alias(f"{c}_hash"), F.expr("substring(id, 3)").alias(f"{c}_id"))
        rows = rows.withColumn(c, blank).join(known, F.col(c) == F.col(f"{c}_node"), "left").drop(f"{c}_node")
    rows = written(rows.select("s", "p", "o", "g", *[f"{c}_{x}" for c in ("s", "o", "g") for x in ("hash", "id")]), "canon-tied-quads")
    tied_in = lambda c: F.when(F.col(f"{c}_hash").isNotNull(), F.col(c))
    present = F.array_distinct(F.array_compact(F.array(*[tied_in(c) for c in ("s", "o", "g")])))
    pairs = rows.select(present.alias("n")).select(F.get("n", 0).alias("a"), F.explode("n").alias("b"))
    of = written(tied.join(connected(pairs), "node", "left").select("node", F.coalesce("component", "node").alias("component")), "canon-components")
    placed = rows.withColumn("node", F.get(present, 0)).join(of, "node").drop("node")
    tasks = max(1, rows.count() // TASK_QUADS)
    schema = "component string, node string, key string, size long, place long"
    named = placed.groupBy(F.pmod(F.xxhash64("component"), F.lit(tasks))).applyInPandas(lambda part: _name_components(bits, budget, part), schema)
    named = written(named.join(tied.select("ds", "node"), "node"), "canon-named")
    order = _ranked(named.where("place = 0").select("ds", "component", F.concat("key", F.sha2("component", 256)).alias("key"), "size"), "key", F.col("size"), "start").select("component", "start")
    first = unique.groupBy("ds").agg(F.count("*").alias("first"))
    late = named.join(order, "component").join(first, "ds", "left")
    return unique.unionByName(late.select("ds", "node", name(F.coalesce("first", F.lit(0)) + F.col("start") + F.col("place")).alias("id")))


def canonical_ids(q: DataFrame, prefix: str = "c14n", bits: int = 256, budget: int = BUDGET, by: str | None = None) -> DataFrame:
    """(node, id): the canonical identifier of every blank node, by structure alone.

    Ids are ``_:`` with the prefix and a number: first the nodes of unique
    first-degree hash in the order of their hashes, then those of the components
    of tied nodes.  A component of n nodes takes up to n^2 runs of the N-degree
    hash, by the standard; one that takes more than ``budget`` + 4 n^2 raises a
    ValueError: only orders of alike neighbours, tried one by one, come to that.

    With ``by``, a column of the quads, every value of it (null is one) is a data
    set of its own: (by, node, id), in as many jobs as for one data set.
    """
    found = _identifiers(written(_scoped(q, by), "canon-quads"), prefix, bits, budget)
    if by is None:
        return found.select("node", "id")
    names = q.select(by, _data_set(by).alias("ds")).distinct()
    return found.join(names, "ds").select(by, F.expr("substring(node, 34)").alias("node"), "id")


def canonical_lines(q: DataFrame, prefix: str = "c14n", bits: int = 256, budget: int = BUDGET, by: str | None = None) -> DataFrame:
    """Canonical N-Quads, one distinct line per quad (of each data set ``by``); no label is made up for a node without an identifier."""
    rows = written(_scoped(q, by), "canon-quads")
    ids = written(_identifiers(rows, prefix, bits, budget).select("node", "id"), "canon-ids")
    for c in ("s", "o", "g"):
        rows = rows.join(ids.select(F.col("node").alias(f"{c}_node"), F.col("id").alias(f"{c}_id")), (F.col(f"{c}_kind") == BLANK) & (F.col(c) == F.col(f"{c}_node")), "left")
    issued = lambda c: F.coalesce(f"{c}_id", F.when(F.col(f"{c}_kind") == BLANK, F.raise_error(F.concat(F.lit("no canonical identifier: "), c))))
    lines = rows.select("ds", quad_text(True, issued("s"), issued("o"), issued("g")).alias("value")).distinct()
    return lines.drop("ds") if by is None else lines.join(q.select(by, _data_set(by).alias("ds")).distinct(), "ds").select(by, "value")


def canonical_hash(q: DataFrame, bits: int = 256, by: str | None = None) -> DataFrame:
    """One row with the hash of the canonical form, or one per data set ``by``: equal for isomorphic datasets, whatever their labels.

    Lines are hashed by range of their own hashes, and the ranges then in order,
    so that no task holds all lines.
    """
    keys = [by] if by else []
    hashed = canonical_lines(q, bits=bits, by=by).select(*keys, F.sha2("value", bits).alias("h"))
    parts = hashed.groupBy(*keys, F.substring("h", 1, 4).alias("part")).agg(F.sha2(F.array_join(F.sort_array(F.collect_list("h")), ""), bits).alias("h"))
    return parts.groupBy(*keys).agg(F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part", "h"))), lambda x: x["h"]), ""), bits).alias("hash"))


def isomorphism_classes(q: DataFrame, by: str) -> DataFrame:
    """(by, hash, same): data sets of a table by their canonical form; ``same`` is the least of those that are isomorphic."""
    hashed = written(canonical_hash(q, by=by), "canon-classes")
    return hashed.join(hashed.groupBy("hash").agg(F.min(by).alias("same")), "hash").select(by, "hash", "same")


def isomorphic(a: DataFrame, b: DataFrame) -> bool:
    """Equal up to the naming of blank nodes; unequal hash counts end it early."""
    hashes = lambda q: first_degree_hashes(q).groupBy("hash").count()
    x, y = hashes(a), hashes(b)
    if not x.subtract(y).isEmpty() or not y.subtract(x).isEmpty():
        return False
    x, y = canonical_lines(a), canonical_lines(b)
    return x.subtract(y).isEmpty() and y.subtract(x).isEmpty()
