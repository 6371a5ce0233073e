"""Connected components of a link table by alternating large and small stars."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.plans.storage import discard, stored


def _labels(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    label = np.arange(n)
    while len(i):
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return label


def thinned(n: int, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the pairs (i, j), i > j, sorted by i, among ``n`` rows few that connect whatever all of them connect."""
    if not len(i):
        return i, j
    first = np.r_[True, i[1:] != i[:-1]]  # the least neighbour of each row
    kept_i, kept_j = [i[first]], [j[first]]
    while True:
        label = _labels(n, np.concatenate(kept_i), np.concatenate(kept_j))
        apart = label[i] != label[j]
        if not apart.any():
            return np.concatenate(kept_i), np.concatenate(kept_j)
        _, one = np.unique(np.maximum(label[i], label[j])[apart], return_index=True)
        kept_i.append(i[apart][one])
        kept_j.append(j[apart][one])


def _to_least(arcs: DataFrame, keep: str) -> DataFrame:
    """Hang the neighbours of every u on the least of u and its neighbours.

    The least is aggregated map-side and joined back, so a hub never sits in one task:
    the adaptive skew join splits its arcs.
    """
    least = arcs.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    hung = arcs.where(keep).join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return hung.union(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).where("a <> b").distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) for every id in ``links``; component is the smallest id connected with it.

    Null ends and loops are ignored; repeated links count once; no links give no rows. Rounds go on until nothing
    changes: about the square of the logarithm of the longest path.
    """
    edges = stored(
        links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where(f"{a} is not null and {b} is not null and a <> b").distinct()
    )
    mark = None
    while True:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
        both = both.union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = _to_least(both, "v > u")
        large = large.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        small = stored(_to_least(large, "v <= u"))
        new = small.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        discard(edges)
        edges = small
        if new == mark:
            break
        mark = new
    ends = edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return ends.union(edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
