"""Connected components of a distributed edge list, and local forests that keep edge lists short."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from offerloom.llm.common import written


def local_roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest reachable index of every node 0..n-1 over the edges (a[i], b[i]); whole arrays at a time."""
    root = np.arange(n)
    while True:
        ra, rb = root[a], root[b]
        low, high = np.minimum(ra, rb), np.maximum(ra, rb)
        if np.array_equal(low, high):
            return root
        np.minimum.at(root, high, low)
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root = up


def forest(ids_a: np.ndarray, ids_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(member, root) edges that connect what the given edges connect: one edge per node but the roots."""
    ids, back = np.unique(np.concatenate([ids_a, ids_b]), return_inverse=True)
    k = len(ids_a)
    root = local_roots(back[:k], back[k:], len(ids))
    keep = root != np.arange(len(ids))
    return ids[keep], ids[root[keep]]


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component) for every node of edges (a, b): component is the smallest id reachable.

    Each round hooks every node to its smallest neighbour, halves the resulting chains until all point to a
    root, and replaces the edges by the distinct edges between roots. At least half of the live nodes vanish
    per round, so rounds grow with the logarithm of the longest chain. All steps are joins and aggregates
    that combine on the map side: a hub's edges are never brought together, skewed joins are split at run
    time. Null ends and self loops are ignored; an empty edge list gives an empty result.
    """
    live = written(_between(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).dropna()))
    pointers = None
    while not live.isEmpty():
        both = live.union(live.select("b", "a"))
        hooks = both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("low")).select("id", F.least("id", "low").alias("to"))
        hooks = _flatten(written(hooks))
        pointers = hooks if pointers is None else _follow(pointers, hooks).union(_new(hooks, pointers))
        pointers = written(pointers)
        live = written(_between(_rename(_rename(live, hooks, "a"), hooks, "b")))
    if pointers is None:
        return live.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return pointers.select("id", F.col("to").alias("component"))


def _between(edges: DataFrame) -> DataFrame:
    return edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _rename(edges: DataFrame, hooks: DataFrame, end: str) -> DataFrame:
    other = "b" if end == "a" else "a"
    named = edges.join(hooks.select(F.col("id").alias(end), "to"), end, "left")
    return named.select(F.coalesce("to", end).alias(end), other).select("a", "b")


def _follow(pointers: DataFrame, hooks: DataFrame) -> DataFrame:
    """Pointers moved one hook further."""
    step = hooks.select(F.col("id").alias("to"), F.col("to").alias("next"))
    return pointers.join(step, "to", "left").select("id", F.coalesce("next", "to").alias("to"))


def _new(hooks: DataFrame, pointers: DataFrame) -> DataFrame:
    return hooks.join(pointers.select("id"), "id", "left_anti")


def _flatten(hooks: DataFrame) -> DataFrame:
    """Pointer doubling until every node points to a root."""
    while True:
        moved = written(_follow(hooks, hooks.where("id <> to")))
        changed = moved.join(hooks.where("id <> to").select(F.col("id").alias("to")), "to", "left_semi")
        if changed.isEmpty():
            return moved
        hooks = moved
