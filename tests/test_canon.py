"""Canonical identifiers against the standard's examples, relabelled copies and hard graphs."""

from __future__ import annotations

import random

import pytest

from graphloom.operators import canon
from graphloom.schema import BLANK, IRI, QUAD

E = "http://example.com/#"


def graph(spark, edges, names=None):
    """Edges (s, p, o): one-letter-and-digit names are blank nodes, others IRIs; ``names`` relabels."""
    names = names or {}

    def term(x):
        return (IRI, E + x[1:]) if x.startswith(":") else (BLANK, "d|" + names.get(x, x))

    return spark.createDataFrame([(None, None, *term(s), E + p, *term(o), None, None) for s, p, o in edges], QUAD)


def ids(q, **options):
    return {r.node.partition("|")[2]: r.id for r in canon.canonical_ids(q, **options).collect()}


# Graphs, hashes and identifiers of the examples in the recommendation.
UNIQUE = [(":p", "q", "e0"), (":p", "r", "e1"), ("e0", "s", ":u"), ("e1", "t", ":u")]
SHARED = [(":p", "q", "e0"), (":p", "q", "e1"), ("e0", "p", "e2"), ("e1", "p", "e3"), ("e2", "r", "e3")]
UNIQUE_HASHES = {"e0": "21d1dd5ba21f3dee9d76c0c00c260fa6f5d5d65315099e553026f4828d0dc77a", "e1": "6fa0b9bdb376852b5743ff39ca4cbf7ea14d34966b2828478fbf222e7c764473"}
SHARED_HASHES = {
    "e0": "3b26142829b8887d011d779079a243bd61ab53c3990d550320a17b59ade6ba36", "e1": "3b26142829b8887d011d779079a243bd61ab53c3990d550320a17b59ade6ba36",
    "e2": "15973d39de079913dac841ac4fa8c4781c0febfba5e83e5c6e250869587f8659", "e3": "7e790a99273eed1dc57e43205d37ce232252c85b26ca4a6ff74ff3b5aea7bccd",
}
SHARED_IDS = {"e2": "_:c14n0", "e3": "_:c14n1", "e1": "_:c14n2", "e0": "_:c14n3"}


def test_examples_of_the_standard(spark):
    hashes = lambda q: {r.node.partition("|")[2]: r.hash for r in canon.first_degree_hashes(q).collect()}
    assert hashes(graph(spark, UNIQUE)) == UNIQUE_HASHES
    assert hashes(graph(spark, SHARED)) == SHARED_HASHES
    assert ids(graph(spark, SHARED)) == SHARED_IDS


def ring(names):
    return [(a, "p", b) for a, b in zip(names, names[1:] + names[:1], strict=True)]


CASES = {
    "a ring of six beside two of three": [*ring(["a1", "a2", "a3", "a4", "a5", "a6"]), *ring(["b1", "b2", "b3"]), *ring(["c1", "c2", "c3"])],
    "clique": [(a, "p", b) for a in ("a1", "a2", "a3", "a4") for b in ("a1", "a2", "a3", "a4") if a != b],
    "a chain of equal nodes": [(f"n{i}", "p", f"n{i + 1}") for i in range(120)],
    "many equal pairs": [(f"x{i}", "p", f"y{i}") for i in range(300)],
    "tied nodes beside a named one": [("a1", "p", "m"), ("a2", "p", "m"), ("m", "q", ":z"), ("a1", "r", "a2"), ("a2", "r", "a1")],
}


def alone(edges):
    """Names of the nodes of one component in canonical order, without Spark."""
    nodes = sorted({x for s, _, o in edges for x in (s, o) if not x.startswith(":")})
    place = lambda x: x if not x.startswith(":") else None
    own = lambda x, n: "a" if x == n else "z"
    hashes = {n: str(sorted((own(s, n), p, own(o, n)) for s, p, o in edges if n in (s, o))) for n in nodes}
    work = canon.Component([(place(s), p, place(o), None) for s, p, o in edges], hashes, {}, 256, 100_000)
    return work.order()


@pytest.mark.parametrize("seed", range(30))
def test_components_don_t_depend_on_labels(seed):
    rng = random.Random(seed)
    nodes = [f"n{i}" for i in range(rng.randint(2, 6))]
    edges = [(nodes[i], "p", nodes[rng.randrange(i)]) for i in range(1, len(nodes))] + [(rng.choice(nodes), rng.choice("pq"), rng.choice(nodes)) for _ in range(rng.randint(0, 5))]
    names = dict(zip(nodes, rng.sample(nodes, len(nodes)), strict=True))
    other = [(names[s], p, names[o]) for s, p, o in rng.sample(edges, len(edges))]
    one, two = alone(sorted(set(edges))), alone(sorted(set(other)))
    assert one[:2] == two[:2]
    numbered = lambda edges, order: sorted((order.index(s), p, order.index(o)) for s, p, o in set(edges))
    assert numbered(edges, one[2]) == numbered(other, two[2])


def test_relabelled_copies_have_the_same_lines(spark):
    edges, rng = [tuple(f"{x[0]}{k}{x[1:]}" if len(x) > 1 and i != 1 and not x.startswith(":") else f"{x}{k}" if i != 1 and not x.startswith(":") else x for i, x in enumerate(e)) for k, case in enumerate(CASES.values()) for e in case], random.Random(1)
    names = sorted({x for s, _, o in edges for x in (s, o) if not x.startswith(":")})
    mixed = rng.sample(names, len(names))
    one, two = graph(spark, edges), graph(spark, rng.sample(edges, len(edges)), dict(zip(names, mixed, strict=True)))
    lines = lambda q: sorted(r.value for r in canon.canonical_lines(q).collect())
    found = lines(one)
    assert found == lines(two) and len(found) == len(set(edges)) and len({w for x in found for w in x.split() if w.startswith("_:")}) == len(names)


def test_rings_differ(spark):
    six, threes = graph(spark, ring(["a1", "a2", "a3", "a4", "a5", "a6"])), graph(spark, [*ring(["a1", "a2", "a3"]), *ring(["b1", "b2", "b3"])])
    assert not canon.isomorphic(six, threes)
    assert not canon.isomorphic(six, six.limit(5))


def test_options_and_budget(spark):
    q = graph(spark, SHARED)
    assert set(ids(q, prefix="x", bits=384).values()) == {f"_:x{i}" for i in range(4)}
    with pytest.raises(ValueError, match="budget"):
        canon.Component([(s, p, o, None) for s, p, o in CASES["clique"]], dict.fromkeys(["a1", "a2", "a3", "a4"], "h"), {}, 256, 3).order()


def test_hash_of_a_dataset(spark):
    q = graph(spark, UNIQUE)
    assert canon.canonical_hash(q).first() == canon.canonical_hash(graph(spark, UNIQUE[::-1], {"e0": "e1", "e1": "e0"})).first() != canon.canonical_hash(q.limit(0)).first()


def component(edges, settled=()):
    nodes = sorted({x for s, _, o in edges for x in (s, o)} - set(settled))
    return canon.Component([(s, p, o, None) for s, p, o in edges], dict.fromkeys(nodes, "h"), {x: f"c14n{i}" for i, x in enumerate(settled)}, 256, canon.BUDGET)


@pytest.mark.parametrize("seed", range(40))
def test_a_line_is_walked_as_any_graph(seed):
    """The loop along a line gives what the general run gives, for every first node."""
    rng, edges = random.Random(seed), set()
    for i in range(rng.randint(1, 12)):
        for _ in range(rng.randint(1, 2)):
            a, b = rng.sample((f"n{i}", f"n{i + 1}"), 2) if rng.random() < 0.4 else (f"n{i}", f"n{i + 1}")
            edges.add((a, rng.choice("pq"), b))
        if rng.random() < 0.3:
            edges.add((f"n{i}", "r", rng.choice(["z0", "z1"])))
    work = component(sorted(edges), [z for z in ("z0", "z1") if any(z in e for e in edges)])
    assert work.is_path()
    for node in work.hashes:
        found = work.run_path(node)
        assert found is None or found == work.run(node)


@pytest.mark.parametrize("seed", range(20))
def test_one_of_all_alike_nodes_is_enough(seed):
    """In trees and rings the nodes that are left out have the hash of one that is tried."""
    rng = random.Random(seed)
    n = rng.randint(3, 9)
    edges = ring([f"n{i}" for i in range(n)]) if seed % 2 else [(f"n{i}", "p", f"n{rng.randrange(i)}") for i in range(1, n)]
    work = component(edges)
    nodes = sorted(work.hashes)
    tried = work.starts(nodes)
    assert {work.run(x)[0] for x in tried} == {work.run(x)[0] for x in nodes} and (seed % 2 == 0 or len(tried) == 1)


def test_long_rings_and_lists(spark):
    assert len(component(ring([f"n{i}" for i in range(5000)])).order()[2]) == 5000
    chain = [("head", "first", ":x"), (":s", "list", "head"), ("head", "rest", "n0"), *[(f"n{i}", "rest", f"n{i + 1}") for i in range(460)], *[(f"n{i}", "first", ":x") for i in range(461)], ("n460", "rest", ":nil")]
    rng = random.Random(5)
    names = sorted({x for s, _, o in chain for x in (s, o) if not x.startswith(":")})
    one, two = graph(spark, chain), graph(spark, rng.sample(chain, len(chain)), dict(zip(names, rng.sample(names, len(names)), strict=True)))
    lines = lambda q: sorted(r.value for r in canon.canonical_lines(q).collect())
    assert lines(one) == lines(two)


def test_no_recursion_limit_is_moved():
    import sys

    before = sys.getrecursionlimit()
    branch = [(f"n{i}", p, f"n{2 * i + j}") for i in range(1, 1 << 6) for j, p in enumerate("pq")]  # a binary tree
    deep = [*branch, *[(f"m{i}", "p", f"m{i + 1}") for i in range(3000)], *[(f"m{i}", "q", f"n{i}") for i in (1, 2)]]
    assert len(component(deep).run("m0")[1]) == 3000 + 1 + 127 and sys.getrecursionlimit() == before


def test_data_sets_of_a_table(spark):
    """Each data set has the identifiers that it has alone; nodes may have the same names in several, and a null names one too."""
    from functools import reduce

    from pyspark.sql import functions as F

    sets = {"shared": SHARED, "unique": UNIQUE, "ring": ring(["a1", "a2", "a3"]), "other ring": ring(["e0", "e1", "e2"]), "two": [*ring(["a1", "a2"]), *ring(["b1", "b2"])], None: [("e0", "p", ":x")]}
    parts = [graph(spark, edges).withColumn("set", F.lit(name).cast("string")) for name, edges in sets.items()]
    q = reduce(lambda a, b: a.unionByName(b), [*parts, parts[0]])
    found = {}
    for r in canon.canonical_ids(q, by="set").collect():
        found.setdefault(r.set, {})[r.node.partition("|")[2]] = r.id
    assert found.keys() == sets.keys()
    for name in ("shared", "unique", None):
        assert found[name] == ids(graph(spark, sets[name]))
    lines = {}
    for r in canon.canonical_lines(q, by="set").collect():
        lines.setdefault(r.set, []).append(r.value)
    assert all(sorted(lines[name]) == sorted(r.value for r in canon.canonical_lines(graph(spark, edges)).collect()) for name, edges in sets.items() if name in ("ring", "two", "shared"))
    same = {r.set: r.same for r in canon.isomorphism_classes(q.where("set is not null"), "set").collect()}
    assert same == {"shared": "shared", "unique": "unique", "ring": "other ring", "other ring": "other ring", "two": "two"}
    assert canon.canonical_hash(q.limit(0), by="set").count() == 0
