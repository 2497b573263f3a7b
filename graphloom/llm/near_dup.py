"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints that differ in at most 2r bits have a common point within r
bits of each: if every fingerprint emits all points of its ball of radius r,
linked ones meet in a shuffle on the points.

Over 64 bits and 4 differing bits a whole ball holds 2,081 points.  Of 4
differing bits at most 2 fall into one of the two 32-bit halves, so the balls
are laid in the halves first: radius 1 and 33 points each, 66 rows per distinct
fingerprint in place of 2,081.  What meets on a half is verified against the
whole fingerprints.  Where more than ``SMALL`` fingerprints meet on one point,
they take the whole 64-bit ball instead: there a common point alone proves the
link, so a group of any size gives a star and never its pairs.

Copies share a fingerprint and are one node from the start.  Only fingerprints
and their links travel; the texts are read once.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import row_hash, text_or_empty, tidy, written
from .components import components

#: Differing bits at which two fingerprints are linked, and words of a shingle.
RADIUS, SHINGLE = 4, 4
#: Fingerprints on one point of a half that are verified pair by pair.
SMALL = 256
#: Fingerprints whose whole balls are laid out at a time.
CHUNK = 2048


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """SimHash of the lower-cased word shingles of a whole text, unsigned."""
    import xxhash

    words = (text or "").encode("utf-8", "replace").lower().split()  # bytes: A-Z and the six ASCII blanks only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    n = max(1, len(words) - shingle + 1)
    first = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    last = ends[-n:].tolist()
    hash64 = xxhash.xxh64_intdigest
    hashes = np.array([hash64(joined[a:b], 42) for a, b in zip(first, last, strict=True)], "<u8")
    votes = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, text_hash and fp (the 64 bits as a long) of every row."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            bits = np.array([fingerprint(t, shingle) for t in batch.text], np.uint64).view(np.int64)
            yield batch[["doc_id", "text_hash"]].assign(fp=bits)

    rows = docs.select(F.col("doc_id").cast("decimal(20,0)").alias("doc_id"), text_or_empty().alias("text"), row_hash().alias("text_hash"))
    return rows.mapInPandas(tidy(run), "doc_id decimal(20,0), text_hash long, fp long").select(F.col("doc_id").cast("long").alias("doc_id"), "text_hash", "fp")


def _ball(bits: int, radius: int) -> np.ndarray:
    """Masks of at most ``radius`` bits out of ``bits``."""
    return np.array([sum(1 << b for b in c) for r in range(radius + 1) for c in combinations(range(bits), r)], np.uint64)


def _half_points(radius: int) -> Column:
    """Array of the points that a fingerprint emits in its two halves."""
    masks = F.array(*[F.lit(int(m)).cast("long") for m in _ball(32, radius // 4)])
    low = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))
    high = F.shiftrightunsigned("fp", 32)
    return F.concat(F.transform(masks, lambda m: low.bitwiseXOR(m)), F.transform(masks, lambda m: high.bitwiseXOR(m) + F.lit(1 << 32)))


def _spanning(fp: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links that keep the fingerprints of one point connected as they are."""
    near = np.bitwise_count(fp[:, None] ^ fp[None, :]) <= radius
    label = np.arange(len(fp))
    while True:
        least = np.where(near, label[None, :], len(fp)).min(axis=1)
        least = np.minimum(least, least[least])
        if (least == label).all():
            break
        label = least
    return [(i, int(k)) for i, k in enumerate(label) if k != i]


def _verify(radius: int, most: int, batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """From rows sorted by (point, fp): links of small runs, and the members of large ones."""
    held_key, held = None, []  # the last run, which may go on; None in ``held`` once it is large

    def small(keys: np.ndarray, fps: np.ndarray) -> Iterator[pd.DataFrame]:
        cuts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1], [True])))
        size = np.diff(cuts)
        two = cuts[:-1][size == 2]
        a, b = fps[two], fps[two + 1]
        ok = np.bitwise_count(a ^ b) <= radius
        yield pd.DataFrame({"a": a[ok].view(np.int64), "b": b[ok].view(np.int64)})
        for start, k in zip(cuts[:-1][size > 2], size[size > 2], strict=True):
            run = fps[start : start + k]
            if k > most:
                yield large(run)
            else:
                links = np.array(_spanning(run, radius), int).reshape(-1, 2)
                yield pd.DataFrame({"a": run[links[:, 0]].view(np.int64), "b": run[links[:, 1]].view(np.int64)})

    def large(run: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({"a": run.view(np.int64), "b": pd.array([None] * len(run), "Int64")})

    for batch in batches:
        keys, fps = batch.point.to_numpy(np.int64), batch.fp.to_numpy(np.int64).view(np.uint64)
        if not len(keys):
            continue
        if held_key is not None:
            go = int((keys == held_key).sum())  # sorted: they come first
            if held is None:
                yield large(fps[:go])
                if go == len(keys):
                    continue
                keys, fps = keys[go:], fps[go:]
            else:
                keys, fps = np.concatenate((np.full(len(held), held_key), keys)), np.concatenate((held, fps))
        tail = int(np.searchsorted(keys, keys[-1], "left"))
        if tail:
            yield from small(keys[:tail], fps[:tail])
        held_key, held = keys[-1], fps[tail:]
        if len(held) > most:
            yield large(held)
            held = None
    if held is not None and len(held):
        yield from small(np.full(len(held), held_key), held)


def _whole_balls(radius: int, batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(point, fp): of each chunk's whole balls only the least fingerprint per point, with links to it."""
    masks = _ball(64, radius // 2)
    for batch in batches:
        every = np.unique(batch.fp.to_numpy(np.int64).view(np.uint64))
        for at in range(0, len(every), CHUNK):
            fps = every[at : at + CHUNK]
            points = (fps[:, None] ^ masks[None, :]).ravel()
            owner = np.repeat(np.arange(len(fps)), len(masks))
            order = np.argsort(points, kind="stable")
            points, owner = points[order], owner[order]
            first = np.flatnonzero(np.concatenate(([True], points[1:] != points[:-1])))
            least = owner[first]  # stable: owners ascend within a point
            star = np.repeat(least, np.diff(np.concatenate((first, [len(points)]))))
            links = np.unique(owner[owner != star] * len(fps) + star[owner != star])
            yield pd.DataFrame({"point": pd.array([None] * len(links), "Int64"), "a": fps[links // len(fps)].view(np.int64), "b": pd.array(fps[links % len(fps)].view(np.int64), "Int64")})
            yield pd.DataFrame({"point": points[first].view(np.int64), "a": fps[least].view(np.int64), "b": pd.array([None] * len(first), "Int64")})


def _stars(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """From rows sorted by (point, fp): links of every fingerprint to the first on its point."""
    key = head = None
    for batch in batches:
        keys, fps = batch.point.to_numpy(np.int64), batch.fp.to_numpy(np.int64)
        if not len(keys):
            continue
        first = np.concatenate(([key is None or keys[0] != key], keys[1:] != keys[:-1]))
        at = np.maximum.accumulate(np.where(first, np.arange(len(keys)), -1))
        heads = np.where(at >= 0, fps[np.maximum(at, 0)], head if head is not None else 0)
        differ = heads != fps
        yield pd.DataFrame({"a": fps[differ], "b": heads[differ]}).drop_duplicates()
        key, head = keys[-1], heads[-1]


def link_fingerprints(fps: DataFrame, radius: int = RADIUS, small: int = SMALL) -> DataFrame:
    """Links (a, b) whose components are those of all pairs within ``radius`` bits.

    ``fps`` has one row per distinct fingerprint.  ``radius`` is a multiple of 4.
    """
    points = fps.select("fp", F.explode(_half_points(radius)).alias("point"))
    # a point with a single fingerprint links nothing; sorted runs are read as a stream
    met = points.repartition("point").sortWithinPartitions("point", "fp").mapInPandas(lambda it: _verify(radius, small, it), "a long, b long")
    met = written(met, "simhash-links")
    balls = met.where("b is null").select(F.col("a").alias("fp")).distinct().repartition("fp").mapInPandas(lambda it: _whole_balls(radius, it), "point long, a long, b long")
    balls = written(balls, "simhash-balls")
    stars = balls.where("point is not null").select("point", F.col("a").alias("fp")).repartition("point").sortWithinPartitions("point", "fp").mapInPandas(_stars, "a long, b long")
    return met.where("b is not null").unionAll(balls.where("point is null").select("a", "b")).unionAll(stars).distinct()


def near_duplicates(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """One row per document: doc_id, text_hash, fp, component, component_id.

    ``component`` is the least fingerprint of the component and ``component_id``
    the smallest doc_id reachable.

    Null, empty and blank texts have fingerprint 0 and are linked like any
    other.  Repeated rows each give a row.  A null doc_id is never a component
    unless the whole component has none.  No documents give no rows; other
    columns are ignored; texts are hashed whole.
    """
    marked = written(fingerprints(docs, shingle), "simhash")
    nodes = marked.groupBy("fp").agg(F.min("doc_id").alias("least"))
    groups = components(link_fingerprints(nodes, radius)).withColumnRenamed("node", "fp")
    labelled = nodes.join(groups, "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    least = labelled.groupBy("component").agg(F.min("least").alias("component_id"))
    lookup = labelled.join(least, "component").select("fp", "component", "component_id")
    return marked.join(lookup, "fp").select("doc_id", "text_hash", "fp", "component", "component_id")


def fp_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
