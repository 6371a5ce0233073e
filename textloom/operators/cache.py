"""Semantic query cache: decisions over ordered requests, routed search and statistics."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions import vectors as V
from textloom.operators.fuzzy import FuzzyModel
from textloom.operators.similarity import QUERY_BLOCK, _matrix, _unit, near_duplicates_removed

THETA = 0.85
ROUTES = 2
BLOCK = 512  # requests whose similarities to what is held are computed at once


@dataclass
class Held:
    """What a cache holds, as growing arrays: unit vectors, keys, the cluster each lives in."""

    dim: int
    n: int = 0
    unit: np.ndarray = field(default=None)
    key: np.ndarray = field(default=None)
    home: np.ndarray = field(default=None)

    def __post_init__(self):
        if self.unit is None:
            self.unit, self.key, self.home = np.zeros((0, self.dim)), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def take(self, unit: np.ndarray, key: np.ndarray, home: np.ndarray) -> None:
        if (size := self.n + len(key)) > len(self.key):
            room = max(size, 2 * len(self.key), 256)
            for name in ("unit", "key", "home"):
                old = getattr(self, name)
                new = np.zeros((room, *old.shape[1:]), old.dtype)
                new[: self.n] = old[: self.n]
                setattr(self, name, new)
        self.unit[self.n : size], self.key[self.n : size], self.home[self.n : size] = unit, key, home
        self.n = size


def placed(vecs: np.ndarray, model: FuzzyModel | None, routes: int = ROUTES) -> tuple[np.ndarray, np.ndarray]:
    """(unit vectors, strongest clusters of each, strongest first; ties to the smaller). Without a model all live in cluster 0."""
    u = np.asarray(vecs, np.float64)
    u = u / (np.linalg.norm(u, axis=1, keepdims=True) + V.EPSILON)
    if model is None or not len(u):
        return u, np.zeros((len(u), 1), np.int32)
    return u, np.argsort(-model.memberships(model.project(u)), axis=1, kind="stable")[:, :routes].astype(np.int32)


def decide(held: Held, keys: np.ndarray, unit: np.ndarray, routes: np.ndarray, theta: float, routed: tuple | None = None, over_all: tuple | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(matched key or -1, similarity) of requests in order; each miss is held from then on.

    A request is compared with what its strongest clusters hold; only if they hold nothing, with everything. Ties go to
    the stronger cluster, then to what was held first. The similarities to what is held before a block of requests come
    from one product per cluster, those within the block from another, so only the choice itself is sequential.
    ``routed`` and ``over_all``: (key or -1, similarity) of the best among entries kept elsewhere, which count as held first.
    """
    n, ways = routes.shape
    matched, found = np.full(n, -1, np.int64), np.full(n, -np.inf)
    for lo in range(0, n, BLOCK):
        rows = np.arange(lo, min(n, lo + BLOCK))
        best, at = np.full((len(rows), ways), -np.inf), np.full((len(rows), ways), -1)
        for c in np.unique(routes[rows]):
            inside = np.flatnonzero(held.home[: held.n] == c)
            if inside.size:
                i, way = np.nonzero(routes[rows] == c)
                sims = unit[rows[i]] @ held.unit[inside].T
                top = sims.argmax(1)
                best[i, way], at[i, way] = sims[np.arange(len(i)), top], held.key[inside[top]]
        near = unit[rows] @ unit[rows].T
        fresh: list[int] = []
        for i, row in enumerate(rows):
            sim, key, any_routed = -np.inf, -1, False
            if routed is not None and routed[0][row] >= 0:
                sim, key, any_routed = routed[1][row], routed[0][row], True
            for way in range(ways):
                mine = [j for j in fresh if routes[rows[j], 0] == routes[row, way]]
                options = [(best[i, way], at[i, way])] if at[i, way] >= 0 else []
                options += [(near[i, j], keys[rows[j]]) for j in mine]
                for value, k in options:
                    any_routed = True
                    if value > sim:
                        sim, key = value, k
            if not any_routed:
                if over_all is not None and over_all[0][row] >= 0:
                    sim, key = over_all[1][row], over_all[0][row]
                if held.n:
                    sims = held.unit[: held.n] @ unit[row]
                    if sims.max() > sim:
                        sim, key = sims.max(), held.key[int(sims.argmax())]
                for j in fresh:
                    if near[i, j] > sim:
                        sim, key = near[i, j], keys[rows[j]]
            if key >= 0 and round(float(sim), 6) >= theta:
                matched[row], found[row] = key, sim
            else:
                fresh.append(i)
        if fresh:
            held.take(unit[rows[fresh]], keys[rows[fresh]], routes[rows[fresh], 0])
    return matched, found


def replay(log: DataFrame, model: FuzzyModel | None, dim: int, theta: float = THETA) -> DataFrame:
    """(epoch, id, hit, matched, similarity, cluster): every request looked up and, on a miss, held, in order.

    log: (epoch, seq, id, vec), ids of 0 or more. Routing with its fallback depends on all earlier decisions, so the time
    between two flushes of the cache is replayed in order by one task, epochs side by side. One pass over sorted
    batches: the task keeps what is held, not the log.
    """
    shared = log.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, None
        for batch in batches:
            epochs = batch.column(0).to_pylist()
            edges = [0, *(i for i in range(1, len(epochs)) if epochs[i] != epochs[i - 1]), len(epochs)] if epochs else []
            for a, b in zip(edges, edges[1:]):
                if held is None or epochs[a] != now:
                    now, held = epochs[a], Held(dim)
                part = batch.slice(a, b - a)
                keys = part.column(1).to_numpy()
                unit, routes = placed(_matrix(part.column(2), dim), shared.value)
                matched, sims = decide(held, keys, unit, routes, theta)
                hit = matched >= 0
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(hit), pa.array(matched, mask=~hit), pa.array(np.round(sims, 4), mask=~hit), pa.array(routes[:, 0], mask=hit)],
                    ["epoch", "id", "hit", "matched", "similarity", "cluster"],
                )

    ordered = log.select("epoch", "id", "vec", "seq").repartition("epoch").sortWithinPartitions("epoch", "seq", "id").select("epoch", "id", "vec")
    return ordered.mapInArrow(run, "epoch string, id bigint, hit boolean, matched bigint, similarity double, cluster int")


def replay_flat(vecs: DataFrame, theta: float, dim: int) -> DataFrame:
    """(id, hit) of one unrouted cache over (id, vec) in order of id: a request hits iff an earlier stored
    one is within ``theta``, so the stored set is that of greedy removal and needs no sequential task."""
    kept = near_duplicates_removed(vecs, theta, dim).select("id", F.lit(True).alias("kept"))
    return vecs.select("id").join(kept, "id", "left").select("id", F.col("kept").isNull().alias("hit"))


def routed_nearest(queries: DataFrame, entries: DataFrame, dim: int, routes: int = ROUTES, other_only: bool = True) -> DataFrame:
    """(query_id, id, cosine, routed): nearest entry within each query's strongest clusters; where these hold no entry, of all.

    queries: (id, vec, u); entries: (id, vec, u). Queries are broadcast in blocks of bounded size; each task compares its
    entries of a cluster with the queries routed there and keeps the best of each query, so a few rows per query and
    task are shuffled. Ties: the stronger cluster, then the smaller id.
    """
    spark = queries.sparkSession
    asked = queries.select("id", "vec", F.transform(V.top_n(F.col("u"), routes), lambda p: p.k).alias("routes"))
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    out = None
    for block in range(blocks):
        part = asked.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == block).orderBy("id").toArrow()
        to = np.array(part.column(2).to_pylist(), np.int32).reshape(part.num_rows, -1)
        shared = spark.sparkContext.broadcast((part.column(0).to_numpy(), _unit(_matrix(part.column(1), dim)), to))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            qid, q, to = shared.value
            n, ways = to.shape if len(qid) else (0, 0)
            best = np.full((n, ways + 1), -np.inf)  # the last column: over all entries
            at = np.zeros((n, ways + 1), np.int64)

            def better(rows: np.ndarray, way: int, sims: np.ndarray, ids: np.ndarray) -> None:
                order = np.argsort(ids, kind="stable")
                sims = sims[:, order]
                top = sims.argmax(1)
                value, key = sims[np.arange(len(rows)), top], ids[order][top]
                use = (value > best[rows, way]) | ((value == best[rows, way]) & (key < at[rows, way]) & np.isfinite(value))
                best[rows[use], way], at[rows[use], way] = value[use], key[use]

            for batch in batches:
                for lo in range(0, batch.num_rows if n else 0, 2048):
                    piece = batch.slice(lo, 2048)
                    ids, home = piece.column(0).to_numpy(), piece.column(2).to_numpy()
                    c = np.round(q @ _unit(_matrix(piece.column(1), dim)).T, 6)
                    if other_only:
                        c[qid[:, None] == ids[None]] = -np.inf
                    better(np.arange(n), ways, c, ids)
                    for k in np.unique(home):
                        inside = np.flatnonzero(home == k)
                        for way in range(ways):
                            if (rows := np.flatnonzero(to[:, way] == k)).size:
                                better(rows, way, c[np.ix_(rows, inside)], ids[inside])
            i, way = np.nonzero(np.isfinite(best))
            yield pa.RecordBatch.from_arrays([pa.array(qid[i]), pa.array(way.astype(np.int32)), pa.array(way < ways), pa.array(at[i, way]), pa.array(best[i, way])], ["query_id", "way", "routed", "id", "cosine"])

        made = entries.select("id", "vec", V.argmax(F.col("u")).alias("home")).mapInArrow(run, "query_id bigint, way int, routed boolean, id bigint, cosine double")
        out = made if out is None else out.unionByName(made)
    top = out.groupBy("query_id").agg(F.max(F.struct("routed", "cosine", (-F.col("way")).alias("w"), (-F.col("id")).alias("i"))).alias("b"))
    return top.select("query_id", (-F.col("b.i")).alias("id"), F.col("b.cosine").alias("cosine"), F.col("b.routed").alias("routed"))


def stats(log: DataFrame, *keys: str, hit: str = "cache_hit") -> DataFrame:
    """Hits, misses and hit rate (4 places, 0 for none) of a decision log, by ``keys``."""
    hits, total = F.count_if(hit), F.count(hit)
    out = log.groupBy(*keys).agg(total.alias("requests"), hits.alias("hits"))
    rate = F.when(F.col("requests") > 0, F.round(F.col("hits") / F.col("requests"), 4)).otherwise(0.0)
    return out.select(*keys, "requests", "hits", (F.col("requests") - F.col("hits")).alias("misses"), rate.alias("hit_rate"))


def theta_sweep(log: DataFrame, thetas: list[float], similarity: str = "similarity") -> DataFrame:
    """Hits at each threshold in one pass; a request without a similarity is a miss."""
    rows = F.array(*[F.struct(F.lit(t).alias("theta"), F.coalesce(F.col(similarity) >= t, F.lit(False)).alias("hit")) for t in thetas])
    return stats(log.select(F.explode(rows).alias("r")).select("r.theta", "r.hit"), "theta", hit="hit")
