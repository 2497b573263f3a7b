"""Nearest neighbours by inner product: a hierarchical k-means tree.

The tree is fitted on a bounded sample (``SAMPLE_FLOATS`` numbers at most);
every vector of the table is then routed to its leaf.  A query walks the tree
best bin first: a priority queue holds the open nodes by the inner product of
the query with their centre, the best is opened, and leaves are visited in the
order in which they come out.  How many leaves a query visits is calibrated:
``CALIBRATION`` queries are answered by brute force over all rows, and visits
widen until the leaves hold ``recall`` of their true neighbours.  A query whose
leaves hold fewer than ``k + 1`` rows goes on until they do.

Equal vectors are one node with the ``k + 1`` smallest ids it has, which is all
that ties by smaller id can ask of it; equal queries are searched once.  A leaf
is dealt in parts of ``PART`` vectors and its queries in blocks of as many, so
neither a common vector nor a dense or much-asked region is one task's work.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: Numbers in the sample that the tree is fitted on, and its rows at most.
SAMPLE_FLOATS, SAMPLE_ROWS = 4_000_000, 20_000
#: Children of a node, vectors aimed at in a leaf, and vectors and queries of one search task.
BRANCH, LEAF, PART = 16, 400, 4096
#: Queries for the calibration and the recall it aims at.
CALIBRATION, RECALL = 64, 0.97
#: Parts that equal vectors are gathered in before they become one.
SALTS = 1024


class Tree:
    """Centres of all nodes; ``children[i]`` is empty for a leaf."""

    def __init__(self, sample: np.ndarray, leaf_rows: int, seed: int = 7) -> None:
        self.centres: list[np.ndarray] = [sample.mean(axis=0)]
        self.children: list[list[int]] = [[]]
        rng, todo = np.random.default_rng(seed), [(0, sample)]
        while todo:
            node, rows = todo.pop()
            if len(rows) <= max(leaf_rows, 1):
                continue
            label, centres = _kmeans(rows, min(BRANCH, -(-len(rows) // max(leaf_rows, 1)) + 1), rng)
            if len(centres) < 2:
                continue
            for k, centre in enumerate(centres):
                self.children[node].append(len(self.centres))
                todo.append((len(self.centres), rows[label == k]))
                self.centres.append(centre)
                self.children.append([])
        self.matrix = [np.array([self.centres[c] for c in kids]) for kids in self.children]

    def leaves_of(self, rows: np.ndarray) -> np.ndarray:
        """The leaf of each row: at every node the nearest centre."""
        out, todo = np.zeros(len(rows), np.int64), [(0, np.arange(len(rows)))]
        while todo:
            node, at = todo.pop()
            if not self.children[node]:
                out[at] = node
                continue
            best = np.argmin(_distances(rows[at], self.matrix[node]), axis=1)
            todo += [(kid, at[best == k]) for k, kid in enumerate(self.children[node]) if (best == k).any()]
        return out

    def visits(self, query: np.ndarray, least: int, held: dict[int, int] | None = None, enough: int = 0) -> list[int]:
        """Leaves in the order of a best-bin-first walk: ``least`` of them, and on until they hold ``enough`` rows."""
        heap, found, rows = [(0.0, 0)], [], 0
        while heap and (len(found) < least or rows < enough):
            _, node = heapq.heappop(heap)
            if not self.children[node]:
                found.append(node)
                rows += held.get(node, 0) if held else 0
                continue
            for kid, product in zip(self.children[node], self.matrix[node] @ query, strict=True):
                heapq.heappush(heap, (-product, kid))
        return found


def _distances(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (centres**2).sum(axis=1)[None, :] - 2 * rows @ centres.T


def _kmeans(rows: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> tuple[np.ndarray, np.ndarray]:
    centres = rows[rng.choice(len(rows), k, replace=False)]
    for _ in range(rounds):
        label = np.argmin(_distances(rows, centres), axis=1)
        used, label = np.unique(label, return_inverse=True)
        centres = np.array([rows[label == j].mean(axis=0) for j in range(len(used))])
    label = np.argmin(_distances(rows, centres), axis=1)
    used, label = np.unique(label, return_inverse=True)
    return label, centres[used]


def _products(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products of paired rows, each summed alone and in the same order."""
    return (queries * rows).sum(axis=1)


def _best(queries: np.ndarray, rows: np.ndarray, ids: list[np.ndarray], k: int) -> Iterator[list[tuple[float, int]]]:
    """For each query its ``k`` nearest (score, id) among the rows' ids."""
    for at in range(0, len(queries), 256):
        block = queries[at : at + 256]
        rough = block @ rows.T
        for query, score in zip(block, rough, strict=True):
            take = np.arange(len(rows))
            if len(rows) > k:
                floor = np.partition(score, len(rows) - k)[len(rows) - k]
                take = np.flatnonzero(score >= floor - 1e-9 * max(1.0, abs(floor)))
            exact = _products(np.broadcast_to(query, (len(take), len(query))), rows[take])
            yield sorted(((float(s), int(i)) for s, t in zip(exact, take, strict=True) for i in ids[t]), key=lambda x: (-x[0], x[1]))[:k]


def _usable(column: str) -> Column:
    """Vectors without nulls and non-finite numbers that are not all zero."""
    numbers = F.col(column)
    fine = F.forall(numbers, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return numbers.isNotNull() & (F.size(numbers) > 0) & fine & F.exists(numbers, lambda x: x != 0)


FOUND = "array<struct<score:double,id:bigint>>"


def _merged(found: DataFrame, key: str, k: int) -> DataFrame:
    """The ``k`` best of all lists of a key; there is one list per visited part."""
    every = F.flatten(F.collect_list("found"))
    order = F.array_sort(F.transform(every, lambda x: F.struct((-x["score"]).alias("far"), x["id"].alias("id"), x["score"].alias("score"))))
    return found.groupBy(key).agg(F.transform(F.slice(order, 1, k), lambda x: F.struct(x["score"].alias("score"), x["id"].alias("id"))).alias("found"))


def search(vectors: DataFrame, is_query: Column, k: int = 20, recall: float = RECALL) -> DataFrame:
    """The ``k`` nearest rows of every query row, itself excepted.

    ``vectors`` has vec_id and embedding; ``is_query`` picks the queries.
    Returns query_id, rank, vec_id, score: the largest inner products in double
    precision, ties to the smaller vec_id, fewer than ``k`` where there are
    fewer rows.  Null, zero or non-finite vectors and rows without vec_id take
    no part, nor do vectors of another length than the most common one (the
    longer on a tie).  Rows that repeat id and vector count once.  An empty
    table gives no rows; other columns are ignored.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("q")).where(F.col("vec_id").isNotNull() & _usable("v"))
    top = rows.groupBy(F.size("v").alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).first()
    dims = top.dims if top else 0
    rows = rows.where(F.size("v") == dims)
    salted = rows.groupBy("v", F.pmod(F.xxhash64("vec_id"), F.lit(SALTS)).alias("salt"))
    ids = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, k + 1)
    own = salted.agg(F.slice(F.array_sort(F.collect_set("vec_id")), 1, k + 1).alias("ids"))
    nodes = own.groupBy("v").agg(ids.alias("ids")).withColumn("node", F.xxhash64("v", F.element_at("ids", 1)))
    nodes = written(nodes, "ann-nodes")

    n = nodes.count()
    size = min(SAMPLE_ROWS, SAMPLE_FLOATS // max(dims, 1))
    sample = nodes.orderBy("node").limit(size).select("v").toPandas()["v"].tolist() if n else []
    tree = Tree(np.array(sample, float) if sample else np.zeros((1, max(dims, 1))), max(8, round(LEAF * min(1.0, size / max(n, 1)))))
    shared = spark.sparkContext.broadcast(tree)  # centres of a bounded sample

    def route(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield batch.assign(leaf=shared.value.leaves_of(np.stack(batch.v.to_list())))

    placed = written(nodes.mapInPandas(route, "v array<double>, ids array<bigint>, node long, leaf long"), "ann-leaves")
    counted = placed.groupBy("leaf").agg(F.count("*").alias("n"), F.sum(F.size("ids")).alias("ids")).collect()  # a row per leaf of the tree
    held = {r.leaf: r.ids for r in counted}
    asked = written(rows.where("q").select("vec_id", "v").distinct(), "ann-queries")
    # equal queries have one key; its vector is looked up by value, not by hash alone
    queries = asked.groupBy("v").agg(F.min("vec_id").alias("key"))

    def brute(probes: list[tuple[int, np.ndarray]], batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Leaves of each probe's nearest nodes of a batch; a node that is the probe's own row alone is none."""
        matrix = np.array([p for _, p in probes])
        for batch in batches:
            if len(batch):
                rows, leaves, single = np.stack(batch.v.to_list()), batch.leaf.tolist(), batch.ids.map(len).to_numpy() == 1
                lists = _best(matrix, rows, [np.array([i]) for i in range(len(rows))], k + 1)
                others = ([(s, i) for s, i in x if not (single[i] and (rows[i] == p).all())][:k] for x, p in zip(lists, matrix, strict=True))
                yield pd.DataFrame({"key": [key for key, _ in probes], "found": [[{"score": s, "id": leaves[i]} for s, i in x] for x in others]})

    probes = [(r.key, np.array(r.v)) for r in queries.orderBy(F.xxhash64("key"), "key").limit(CALIBRATION).collect()]
    leaves, visits = sum(not c for c in tree.children), 1
    if probes:
        truth = _merged(placed.mapInPandas(lambda it: brute(probes, it), f"key long, found {FOUND}"), "key", k).collect()
        order = {key: {leaf: i for i, leaf in enumerate(tree.visits(p, leaves))} for key, p in probes}
        depth = np.sort([order[r.key][x.id] for r in truth for x in r.found])
        visits = int(depth[min(len(depth) - 1, int(np.ceil(recall * len(depth))))]) + 1

    def walk(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for key, v in zip(batch.key, batch.v, strict=True):
                stops = shared.value.visits(np.array(v), visits, held, k + 1)
                yield pd.DataFrame({"key": key, "leaf": stops})

    def scan(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(rows):
            return pd.DataFrame({"key": np.zeros(0, np.int64), "found": np.zeros(0, object)})
        lists = _best(np.stack(queries.v.to_list()), np.stack(rows.v.to_list()), rows.ids.to_list(), k + 1)
        return pd.DataFrame({"key": queries.key.to_numpy(), "found": [[{"score": s, "id": i} for s, i in x] for x in lists]})

    stops = written(queries.mapInPandas(walk, "key long, leaf long"), "ann-stops")
    asking = {r.leaf: r["count"] for r in stops.groupBy("leaf").count().collect()}
    shares = F.broadcast(spark.createDataFrame([(r.leaf, -(-r.n // PART), -(-asking[r.leaf] // PART)) for r in counted if r.leaf in asking], "leaf long, parts int, blocks int"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    share = lambda key, n: F.pmod(F.xxhash64(key, F.lit(1)), F.col(n)).cast("int")
    asks = stops.join(shares, "leaf").join(queries, "key").select("key", "v", "leaf", every("parts").alias("part"), share("key", "blocks").alias("block"))
    dealt = placed.join(shares, "leaf").select("v", "ids", "leaf", share("node", "parts").alias("part"), every("blocks").alias("block"))
    found = asks.groupBy("leaf", "part", "block").cogroup(dealt.groupBy("leaf", "part", "block")).applyInPandas(scan, f"key long, found {FOUND}")
    answers = asked.join(queries, "v").select("vec_id", "key").join(_merged(found, "key", k + 1), "key")
    ranked = answers.select(F.col("vec_id").alias("query_id"), F.slice(F.filter("found", lambda x: x["id"] != F.col("vec_id")), 1, k).alias("found"))
    return ranked.select("query_id", F.posexplode("found").alias("at", "hit")).select("query_id", (F.col("at") + 1).alias("rank"), F.col("hit.id").alias("vec_id"), F.col("hit.score").alias("score"))
