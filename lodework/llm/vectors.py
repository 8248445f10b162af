"""The k most similar vectors for every vector: robust-pruned directed graphs, one per shard, searched by beams.

Insertion is batched: a batch searches the graph greedily, and what its beams meet (with the nearest of its own batch)
are the proposals. Relaxed pruning takes the nearest proposal and drops every other one that is closer to it, by a
factor, than to the point, so edges stay diverse. Every vector then queries the shards around it with a beam.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodework.session import stored

_NONE = np.int32(-1)


class Graph:
    """A directed neighbour graph over unit vectors; similarity is the dot product."""

    def __init__(self, x: np.ndarray, degree: int = 24, beam: int = 40, relax: float = 1.2, seed: int = 11) -> None:
        self.x, self.degree, self.beam, self.relax = x, degree, beam, relax
        self.edges = np.full((len(x), degree), _NONE, dtype=np.int32)
        order = np.random.default_rng(seed).permutation(len(x)).astype(np.int32)
        self.entries = order[: min(len(x), 16)]
        first = min(len(x), 4 * degree)
        self._insert(order[:first], None)
        done = first
        while done < len(order):
            size = min(1024, done, len(order) - done)
            batch = order[done : done + size]
            found, _ = self.search(x[batch], beam, beam)
            self._insert(batch, found)
            done += size

    @classmethod
    def of(cls, x: np.ndarray, edges: np.ndarray, entries: np.ndarray) -> Graph:
        g = cls.__new__(cls)
        g.x, g.edges, g.entries = x, edges, entries
        return g

    def _insert(self, batch: np.ndarray, found: np.ndarray | None) -> None:
        near = self.x[batch] @ self.x[batch].T
        np.fill_diagonal(near, -2)
        width = min(len(batch) - 1, self.degree if found is None else 8)
        if width <= 0:
            return
        own = np.argpartition(-near, width - 1, axis=1)[:, :width]
        proposals = batch[own] if found is None else np.concatenate([found, batch[own]], axis=1)
        chosen = self._prune(batch, proposals)
        self.edges[batch] = chosen
        # and back: every neighbour learns of the new point
        source = np.repeat(batch, self.degree)
        target = chosen.reshape(-1)
        source, target = source[target >= 0], target[target >= 0]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        nodes, at, count = np.unique(target, return_index=True, return_counts=True)
        rank = np.arange(len(target)) - np.repeat(at, count)
        new = np.full((len(nodes), int(count.max())), _NONE, dtype=np.int32)
        new[np.repeat(np.arange(len(nodes)), count), rank] = source
        old = self.edges[nodes]
        room = (old >= 0).sum(axis=1) + count <= self.degree
        for part in np.array_split(np.flatnonzero(~room), max(1, (~room).sum() * new.shape[1] // 100_000)):
            if len(part):
                self.edges[nodes[part]] = self._prune(nodes[part], np.concatenate([old[part], new[part]], axis=1))
        if room.any():
            both = np.concatenate([old[room], new[room]], axis=1)
            both = np.take_along_axis(both, np.argsort(both < 0, axis=1, kind="stable"), axis=1)
            self.edges[nodes[room]] = both[:, : self.degree]

    def _prune(self, points: np.ndarray, proposals: np.ndarray) -> np.ndarray:
        """Up to `degree` diverse edges per point, nearest first. Distances are 1 - dot."""
        out = np.full((len(points), self.degree), _NONE, dtype=np.int32)
        for lo in range(0, len(points), 256):
            p, c = points[lo : lo + 256], proposals[lo : lo + 256]
            c = np.sort(c, axis=1)
            bad = (c < 0) | (c == p[:, None])
            bad[:, 1:] |= c[:, 1:] == c[:, :-1]
            vectors = self.x[np.where(bad, 0, c)]
            far = 1 - np.einsum("bcd,bd->bc", vectors, self.x[p])
            far[bad] = np.inf
            keep = min(c.shape[1], 2 * self.degree)
            order = np.argsort(far, axis=1)[:, :keep]
            c, far = np.take_along_axis(c, order, axis=1), np.take_along_axis(far, order, axis=1)
            vectors = np.take_along_axis(vectors, order[:, :, None], axis=1)
            between = 1 - vectors @ vectors.transpose(0, 2, 1)
            alive, rows = np.isfinite(far), np.arange(len(p))
            for k in range(self.degree):
                pick = np.argmax(alive, axis=1)
                some = alive[rows, pick]
                if not some.any():
                    break
                out[lo + rows[some], k] = c[rows[some], pick[some]]
                alive &= ~(some[:, None] & (self.relax * between[rows, pick] <= far))
                alive[rows, pick] = False
        return out

    def search(self, queries: np.ndarray, k: int, beam: int, step: int = 4) -> tuple[np.ndarray, np.ndarray]:
        """Nodes and similarities of the k best found per query, best first; -1 fills up."""
        parts = [self._search(queries[i : i + 256], k, beam, step) for i in range(0, len(queries), 256)]
        return np.concatenate([a for a, _ in parts]), np.concatenate([b for _, b in parts])

    def _search(self, q: np.ndarray, k: int, beam: int, step: int) -> tuple[np.ndarray, np.ndarray]:
        n, m, degree = len(self.x), len(q), self.edges.shape[1]
        beam = max(beam, k)
        seen = np.zeros(m * n, dtype=bool)
        ids = np.full((m, beam), _NONE, dtype=np.int32)
        sims = np.full((m, beam), -np.inf, dtype=np.float32)
        fresh = np.zeros((m, beam), dtype=bool)
        flat = (np.arange(m)[:, None] * n + self.entries[None, :]).reshape(-1)
        while True:
            seen[flat] = True
            row, node = np.divmod(flat, n)
            near = np.einsum("ij,ij->i", q[row], self.x[node])
            better = near > sims[row, -1]
            row, node, near = row[better], node[better], near[better]
            count = np.bincount(row, minlength=m)
            if len(row):
                at = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                wide = int(count.max())
                new_ids, new_sims = np.full((m, wide), _NONE, dtype=np.int32), np.full((m, wide), -np.inf, dtype=np.float32)
                new_ids[row, at], new_sims[row, at] = node, near
                all_sims = np.concatenate([sims, new_sims], axis=1)
                order = np.argsort(-all_sims, axis=1, kind="stable")[:, :beam]
                sims = np.take_along_axis(all_sims, order, axis=1)
                ids = np.take_along_axis(np.concatenate([ids, new_ids], axis=1), order, axis=1)
                fresh = np.take_along_axis(np.concatenate([fresh, new_ids >= 0], axis=1), order, axis=1)
            turn = fresh & (np.cumsum(fresh, axis=1) <= step)
            row, col = np.nonzero(turn)
            if not len(row):
                return ids[:, :k], sims[:, :k]
            fresh[row, col] = False
            nodes = self.edges[ids[row, col]]
            flat = (row[:, None] * n + nodes)[nodes >= 0]
            flat = np.unique(flat[~seen[flat]])


def unit(rows: pd.Series) -> np.ndarray:
    x = np.stack(rows.to_numpy()).astype(np.float64)
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def _build(f: pd.DataFrame, degree: int, beam: int) -> pd.DataFrame:
    f = f.sort_values("key", ignore_index=True)
    g = Graph(unit(f["vector"]), degree, beam)
    entry = np.zeros(len(f), dtype=bool)
    entry[g.entries] = True
    return f[["group_id", "cell", "shard", "key", "vector"]].assign(node=np.arange(len(f), dtype=np.int32), edges=list(g.edges), entry=entry)


def _query(graph: pd.DataFrame, queries: pd.DataFrame, k: int, beam: int) -> pd.DataFrame:
    names = ["key", "other", "cosine"]
    if not len(graph) or not len(queries):
        return pd.DataFrame({"key": pd.Series(dtype="int64"), "other": pd.Series(dtype="int64"), "cosine": pd.Series(dtype="float64")})
    graph = graph.sort_values("node", ignore_index=True)
    g = Graph.of(unit(graph["vector"]), np.stack(graph["edges"].to_numpy()).astype(np.int32), np.flatnonzero(graph["entry"].to_numpy()).astype(np.int32))
    ids, _ = g.search(unit(queries["vector"]), k + 1, beam)
    row, col = np.nonzero(ids >= 0)
    a = np.stack(queries["vector"].to_numpy()).astype(np.float64)
    b = np.stack(graph["vector"].to_numpy()).astype(np.float64)
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    node = ids[row, col]
    out = pd.DataFrame(dict(zip(names, (queries["key"].to_numpy()[row], graph["key"].to_numpy()[node], np.einsum("ij,ij->i", a[row], b[node])), strict=True)))
    return out[out["key"] != out["other"]]


def usable(vector: Column, size: int) -> Column:
    """A vector of `size` finite numbers that are not all zero; false for null."""
    finite = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return F.coalesce((F.size(vector) == size) & finite & F.exists(vector, lambda v: v != 0), F.lit(False))


def centroids(sample: np.ndarray, cells: int, rounds: int = 8, seed: int = 3) -> np.ndarray:
    """Unit centroids of `cells` cells of unit vectors, by a few rounds of spherical k-means."""
    rng = np.random.default_rng(seed)
    c = sample[rng.permutation(len(sample))[:cells]].copy()
    for _ in range(rounds):
        home = np.concatenate([(sample[i : i + 4096] @ c.T).argmax(axis=1) for i in range(0, len(sample), 4096)])
        for k in range(len(c)):
            mine = sample[home == k]
            if len(mine):
                m = mine.mean(axis=0)
                c[k] = m / (np.linalg.norm(m) or 1.0)
    return c


def _route(frames: Iterator[pd.DataFrame], cells: dict[str, np.ndarray], probes: int) -> Iterator[pd.DataFrame]:
    """Every vector with the cells nearest to it, its own first."""
    for f in frames:
        near = np.empty(len(f), dtype=object)
        for g, at in f.groupby("group_id").indices.items():
            if g not in cells:
                for i in at:
                    near[i] = [0]
                continue
            c = cells[g]
            sims = unit(f["vector"].iloc[at]) @ c.T
            order = np.argsort(-sims, axis=1, kind="stable")[:, :probes]
            for i, row in zip(at, order, strict=True):
                near[i] = row.tolist()
        yield f.assign(near=near)


def nearest(items: DataFrame, key: str, group: str, vector: str, k: int = 5, shard_rows: int = 16_384, query_rows: int = 16_384, degree: int = 24, beam: int = 40, probes: int = 8, sample: int = 50_000) -> DataFrame:
    """The k most similar others of every vector within its group, nearly always found: (key, other, rank, cosine).

    items must hold usable vectors of one size under unique integer keys; a null group is a group. Cosines are computed
    in double from the vectors as stored; equal ones are ranked by key. Equal vectors are indexed once: a vector with copies has
    them as its most similar others (the lowest keys first), and copies of a neighbour follow each other, so a group
    of copies of any size costs a few rows per copy. An empty table gives an empty table.

    A group of more than shard_rows vectors is cut into cells around centroids, fitted on at most `sample` of its vectors;
    every vector is indexed in its nearest cell and queries the `probes` nearest, so it is copied to that many shards
    however large the group is (with no more cells than probes, to all). A cell of more than shard_rows vectors is dealt
    out over several shards. No task holds more than one shard and about query_rows queries.
    """
    clean = F.transform(F.col(vector), lambda v: v + F.lit(0.0).cast("float"))  # one zero, so that equal vectors have one digest
    rows = items.select(F.coalesce(F.concat(F.lit("="), F.col(group)), F.lit("~")).alias("group_id"), F.col(key).cast("long").alias("key"), clean.alias("vector"))
    rows = rows.withColumns({"h1": F.xxhash64("vector"), "h2": F.xxhash64(F.lit(1), "vector")})
    spark = rows.sparkSession
    reps = stored(rows.groupBy("group_id", "h1", "h2", "vector").agg(F.min("key").alias("key"), F.count(F.lit(1)).alias("copies")), "vectors")
    sizes = {r["group_id"]: r["count"] for r in reps.groupBy("group_id").count().collect()}  # one row a group
    cells: dict[str, np.ndarray] = {}
    for g, n in sizes.items():
        if n > shard_rows:
            part = reps.where(F.col("group_id") == g).where(F.pmod(F.xxhash64("key", F.lit(7)), F.lit(n)) < sample).select("vector").limit(2 * sample).toPandas()
            cells[g] = centroids(unit(part["vector"]), -(-n // shard_rows))
    kept = reps.select("group_id", "key", "vector", "copies")
    routed = stored(kept.mapInPandas(partial(_route, cells=cells, probes=probes), "group_id string, key long, vector array<float>, copies long, near array<int>"), "routed")
    routed = routed.withColumn("cell", F.col("near")[0])
    parts = lambda c, n, rows: c.groupBy("group_id", "cell").agg(F.ceil(F.count(F.lit(1)) / rows).cast("int").alias(n))
    shards, asks = parts(routed, "n_shards", shard_rows), parts(routed.select("group_id", F.explode("near").alias("cell")), "n_parts", query_rows)
    told = stored(shards.join(asks, ["group_id", "cell"]), "cells")  # one row a cell
    n_shards, n_tasks = told.agg(F.sum("n_shards"), F.sum(F.col("n_shards") * F.col("n_parts"))).first()
    keys = ["group_id", "cell", "shard"]
    graphs = routed.join(told, ["group_id", "cell"]).withColumn("shard", F.pmod(F.xxhash64("key"), "n_shards").cast("int"))
    graphs = graphs.select(*keys, "key", "vector").repartition(max(1, 4 * (n_shards or 0)), *keys)
    schema = "group_id string, cell int, shard int, key long, vector array<float>, node int, edges array<int>, entry boolean"
    graphs = stored(graphs.groupBy(*keys).applyInPandas(partial(_build, degree=degree, beam=beam), schema), "graphs")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    keys = [*keys, "part"]
    left = graphs.join(told, ["group_id", "cell"]).withColumn("part", each("n_parts")).repartition(max(1, 4 * (n_tasks or 0)), *keys)
    right = routed.select("group_id", "key", "vector", F.explode("near").alias("cell")).join(told, ["group_id", "cell"])
    right = right.withColumn("part", F.pmod(F.xxhash64("key", F.lit(1)), "n_parts").cast("int")).select("group_id", "cell", "part", "key", "vector", each("n_shards").alias("shard"))
    right = right.repartition(max(1, 4 * (n_tasks or 0)), *keys)
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(partial(_query, k=k, beam=beam), "key long, other long, cosine double")
    top = Window.partitionBy("key").orderBy(F.desc("cosine"), "other")
    links = found.withColumn("r", F.row_number().over(top)).where(F.col("r") <= k).drop("r")

    # copies: the first k + 1 of each class stand for it towards others
    classes = reps.where("copies > 1").select("group_id", "h1", "h2", F.col("vector").alias("v"), F.col("key").alias("rep"), "copies")
    members = rows.join(classes, ["group_id", "h1", "h2"]).where(F.col("vector") == F.col("v")).select("key", "rep", "copies")
    firsts = members.withColumn("nth", F.row_number().over(Window.partitionBy("rep").orderBy("key"))).where(F.col("nth") <= k + 1)
    inside = members.join(firsts.select("rep", F.col("key").alias("other")), "rep").where("key <> other")
    inside = inside.select("key", "other", F.lit(1.0).cast("double").alias("cosine"))
    others = links.join(firsts.select(F.col("rep").alias("other"), F.col("key").alias("copy")), "other", "left").withColumn("other", F.coalesce("copy", "other")).drop("copy")
    few = firsts.where(F.col("copies") <= k).select(F.col("rep").alias("key"), F.col("key").alias("copy"))
    others = others.join(few, "key", "left").withColumn("key", F.coalesce("copy", "key")).drop("copy")
    both = others.unionByName(inside).withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= k)
    return both.select("key", "other", "rank", "cosine")
