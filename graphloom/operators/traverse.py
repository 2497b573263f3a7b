"""Recursive operators: reachability, lists, roots and closures as frontier loops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import BLANK, COLUMNS, FIRST, IRI, LITERAL, NIL, REST, SUBJECT
from ..storage import written


def reach(q: DataFrame, roots: DataFrame, emit: Column | None = None, descend: Column | None = None, max_depth: int | None = None) -> DataFrame:
    """Triples met on the way along objects from ``roots`` (s_kind, s).

    ``emit`` and ``descend`` are conditions on a triple and its ``depth``: the
    shortest number of hops from a root.  Each subject is expanded once.
    """
    emit, descend = F.lit(True) if emit is None else emit, F.lit(True) if descend is None else descend
    visited = frontier = written(roots.select(*SUBJECT).distinct(), "reach")
    found, depth = None, 0
    while max_depth is None or depth <= max_depth:
        step = written(q.join(frontier, SUBJECT, "left_semi").withColumn("depth", F.lit(depth)), "reach-step")
        out = step.where(emit)
        found = out if found is None else found.unionByName(out)
        heads = step.where(descend & (F.col("o_kind") != LITERAL)).select(F.col("o_kind").alias("s_kind"), F.col("o").alias("s")).distinct()
        frontier = written(heads.join(visited, SUBJECT, "left_anti"), "reach")
        if frontier.isEmpty():
            break
        visited, depth = visited.unionByName(frontier), depth + 1
    return found.select(*COLUMNS, "depth")


def describe(q: DataFrame, roots: DataFrame) -> DataFrame:
    """Triples of the roots and of the blank nodes below them."""
    return reach(q, roots, descend=F.col("o_kind") == BLANK).select(*COLUMNS)


def root_subjects(q: DataFrame) -> DataFrame:
    """Subjects that are no object of another subject's triple."""
    used = q.where((F.col("o_kind") != LITERAL) & ~((F.col("o_kind") == F.col("s_kind")) & (F.col("o") == F.col("s")))).select(F.col("o_kind").alias("s_kind"), F.col("o").alias("s"))
    return q.select(*SUBJECT).distinct().join(used, SUBJECT, "left_anti")


def closure(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """All pairs (a, b) connected by a path of ``edges`` (a, b); pairs (x, x) lie on cycles.

    Paths double each round, and only pairs that are new take part.
    """
    known = new = written(edges.select("a", "b").distinct(), "closure")
    for _ in range(max_rounds):
        ahead = new.alias("x").join(known.alias("y"), F.col("x.b") == F.col("y.a")).select("x.a", "y.b")
        behind = known.alias("x").join(new.alias("y"), F.col("x.b") == F.col("y.a")).select("x.a", "y.b")
        new = written(ahead.unionAll(behind).distinct().join(known, ["a", "b"], "left_anti"), "closure")
        if new.isEmpty():
            return known
        known = known.unionAll(new)
    raise RuntimeError(f"closure: still growing after {max_rounds} rounds")


def topological(edges: DataFrame) -> DataFrame:
    """(node, level): each node of the edges (node, need) one level above the highest that it needs; a circle is a ValueError.

    A round takes the nodes whose needs are all placed: as many rounds as the
    longest chain has nodes.
    """
    needs = written(edges.where("need is not null").select("node", "need").distinct(), "order-needs")
    left = written(edges.select("node").union(needs.select("need")).distinct(), "order-left")
    placed, level = None, 0
    while not left.isEmpty():
        held = needs.join(left.withColumnRenamed("node", "need"), "need", "left_semi").select("node")
        ready = written(left.join(held, "node", "left_anti"), "order-ready")
        if ready.isEmpty():
            raise ValueError("topological: the needs run in a circle")
        now = ready.withColumn("level", F.lit(level))
        placed = now if placed is None else placed.unionByName(now)
        left, level = written(left.join(ready, "node", "left_anti"), "order-left"), level + 1
    return placed if placed is not None else left.withColumn("level", F.lit(0))


def connected(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(node, component) for every node of the edges (a, b) between different nodes; a component is its least node.

    Every node is linked to the least node that it or a neighbour is linked to,
    and links are then followed: the distance to the least node falls by about
    half each round.
    """
    both = edges.where("a <> b").select("a", "b").union(edges.where("a <> b").select("b", "a")).distinct()
    both = written(both, "connected-edges")
    now = written(both.groupBy(F.col("a").alias("node")).agg(F.least("a", F.min("b")).alias("component")), "connected")
    for _ in range(max_rounds):
        near = both.join(now.select(F.col("node").alias("b"), F.col("component").alias("theirs")), "b").groupBy(F.col("a").alias("node")).agg(F.min("theirs").alias("theirs"))
        # the component that a node names hears of the least that its members met, too
        met = now.join(near, "node").select("node", "component", F.least("component", "theirs").alias("least"))
        told = met.groupBy("component").agg(F.min("least").alias("hooked"))
        hooked = met.join(told, "component").select("node", "component", F.least("least", "hooked").alias("least"))
        jump = hooked.select(F.col("node").alias("least"), F.col("least").alias("far"))
        nxt = written(hooked.join(jump, "least", "left").select("node", F.least("least", F.coalesce("far", "least")).alias("component"), (F.least("least", F.coalesce("far", "least")) < F.col("component")).alias("moved")), "connected")
        now = nxt.drop("moved")
        if nxt.where("moved").isEmpty():
            return now
    raise RuntimeError(f"connected: still changing after {max_rounds} rounds")


def list_items(q: DataFrame) -> DataFrame:
    """(head, position, o_kind, o, o_dt, o_lang) of every well-formed rdf:List."""
    return list_places(q).drop("node")


def list_places(q: DataFrame) -> DataFrame:
    """The same with ``node``, the list node of each place.

    Node ranks are found by pointer doubling: log n joins.  A node needs exactly
    one rdf:first and one rdf:rest; lists that break this or run in a circle
    give no rows (``malformed_lists`` names them).
    """
    nodes = written(_list_nodes(q), "list-nodes")
    good = nodes.where("firsts = 1 and rests = 1")
    most = 2 * good.count() + 2
    jump = written(good.select(F.col("s").alias("node"), F.col("rest").alias("to"), F.lit(1).cast("long").alias("steps")), "list-jump")
    while not jump.where(F.col("to") != NIL).join(good.select(F.col("s").alias("to")), "to", "left_semi").limit(1).isEmpty():
        far = jump.select(F.col("node").alias("to"), F.col("to").alias("to2"), F.col("steps").alias("steps2"))
        nxt = jump.join(far, "to", "left").select("node", F.coalesce("to2", "to").alias("to"), (F.col("steps") + F.coalesce("steps2", F.lit(0))).alias("steps"))
        jump = written(nxt, "list-jump")
        if jump.agg(F.max("steps")).first()[0] > most:  # a circle
            jump = jump.where(F.col("to") == NIL)
            break
    ended = jump.where(F.col("to") == NIL).select("node", "steps")
    heads = ended.join(good.select(F.col("rest").alias("node")), "node", "left_anti")
    # the list of a node: walk again with heads, by the same doubling on parents
    parent = good.select(F.col("rest").alias("node"), F.col("s").alias("up")).where(F.col("node") != NIL)
    owner = written(ended.join(parent, "node", "left").select("node", F.coalesce("up", "node").alias("head"), "steps"), "list-owner")
    while True:
        up = owner.select(F.col("node").alias("head"), F.col("head").alias("head2"))
        nxt = written(owner.join(up, "head", "left").select("node", F.coalesce("head2", "head").alias("head"), "steps", (F.coalesce("head2", "head") != F.col("head")).alias("moved")), "list-owner")
        owner = nxt.drop("moved")
        if nxt.where("moved").limit(1).isEmpty():
            break
    size = owner.where(F.col("node") == F.col("head")).select("head", F.col("steps").alias("size"))
    items = owner.join(heads.select(F.col("node").alias("head")), "head", "left_semi").join(size, "head")
    return items.join(good.select(F.col("s").alias("node"), "item"), "node").select("head", (F.col("size") - F.col("steps")).alias("position"), "node", "item.*")


def _list_nodes(q: DataFrame) -> DataFrame:
    parts = q.where(F.col("p").isin(FIRST, REST))
    item = F.when(F.col("p") == FIRST, F.struct("o_kind", "o", "o_dt", "o_lang"))
    return parts.groupBy("s").agg(F.count_if(F.col("p") == FIRST).alias("firsts"), F.count_if(F.col("p") == REST).alias("rests"), F.max(item).alias("item"), F.max(F.when(F.col("p") == REST, F.col("o"))).alias("rest"))


def malformed_lists(q: DataFrame) -> DataFrame:
    """List nodes without exactly one rdf:first and one rdf:rest, with their counts."""
    return _list_nodes(q).where("firsts <> 1 or rests <> 1").select("s", "firsts", "rests")


def iri_node(iris: list[str], q: DataFrame) -> DataFrame:
    """Root rows for IRIs."""
    return q.sparkSession.createDataFrame([(IRI, i) for i in iris], "s_kind byte, s string")
