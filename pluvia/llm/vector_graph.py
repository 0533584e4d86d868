"""Approximate nearest neighbours by inner product on robust-pruned directed graphs.

Vectors are dealt to shards of about ``shard_rows``.  In each shard every vector starts with a few random neighbours;
then, twice over, a greedy search from a central vector proposes candidates for each vector, and robust pruning keeps
those that no kept one is much closer to: a candidate goes if ``alpha`` times its distance to a kept neighbour is at
most its distance to the vector.  Backward edges are added and pruned alike.  Queries run a beam search in each shard;
the shards' lists are merged, and scores are exact inner products in double precision.

The largest inner product becomes the smallest distance by one more coordinate, which gives all vectors the length of
the longest.  Equal vectors are one node; of its members the ``k + 1`` smallest ids can matter to a query, and these
are kept in a table of their own.

Defined cases: vectors that are null, zero, of another length than most, or hold null or non-finite components take no
part, neither as queries nor as candidates; null ids take no part; an id that occurs twice keeps its first vector in
order; extra columns play no part; with fewer than ``k`` candidates a query lists all of them; an empty table gives an
empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pluvia.functions.storage import materialise

SHARD_ROWS = 8192
QUERY_BLOCK = 4096


class Graph:
    """One shard: vectors with the added coordinate, neighbour lists (-1: none) and the entry vector."""

    def __init__(self, vectors: np.ndarray, degree: int, neighbours: np.ndarray | None = None):
        self.x, self.degree = np.ascontiguousarray(vectors, np.float32), degree
        self.square = (self.x ** 2).sum(1)
        self.entry = int(np.argmin(((self.x - self.x.mean(0)) ** 2).sum(1))) if len(vectors) else 0
        self.out = neighbours

    def search(self, queries: np.ndarray, beam: int, width: int = 4) -> tuple[np.ndarray, np.ndarray]:
        """(ids, distances) of the ``beam`` nearest nodes that greedy search finds for each query; -1 where there are fewer."""
        q, rows = len(queries), np.arange(len(queries))[:, None]
        ids = np.full((q, beam), -1, np.int32)
        dist = np.full((q, beam), np.inf, np.float32)
        done = np.ones((q, beam), bool)
        own = (queries ** 2).sum(1)
        ids[:, 0] = self.entry
        dist[:, 0] = own + self.square[self.entry] - 2 * queries @ self.x[self.entry]
        done[:, 0] = False
        active = np.arange(q)
        while len(active):
            open_dist = np.where(done[active], np.inf, dist[active])
            near = np.argpartition(open_dist, min(width, beam) - 1, axis=1)[:, :width]
            r = np.arange(len(active))[:, None]
            usable = np.isfinite(open_dist[r, near])
            done[active[:, None], near] = True
            nodes = np.where(usable, ids[active[:, None], near], -1)
            new = np.where(nodes[:, :, None] >= 0, self.out[nodes], -1).reshape(len(active), -1)
            new.sort(axis=1)
            fresh = new >= 0
            fresh[:, 1:] &= new[:, 1:] != new[:, :-1]
            known = np.zeros_like(fresh)
            for i in range(beam):
                known |= new == ids[active, i][:, None]
            fresh &= ~known
            d = self.square[new] + own[active][:, None] - 2 * np.einsum("qnd,qd->qn", self.x[new], queries[active], optimize=True)
            d = np.where(fresh, d, np.inf)
            all_d = np.concatenate((dist[active], d), 1)
            best = np.argpartition(all_d, beam - 1, axis=1)[:, :beam]
            ids[active] = np.concatenate((ids[active], np.where(fresh, new, -1)), 1)[r, best]
            done[active] = np.concatenate((done[active], ~fresh), 1)[r, best]
            dist[active] = all_d[r, best]
            active = active[~done[active].all(1)]
        order = np.argsort(dist, axis=1)
        return ids[rows, order], dist[rows, order]

    def prune(self, node: np.ndarray, candidates: np.ndarray, alpha: float) -> np.ndarray:
        """Robust pruning of each node's candidates (-1: none) to at most ``degree``."""
        candidates = np.sort(candidates, axis=1)
        bad = (candidates < 0) | (candidates == node[:, None])
        bad[:, 1:] |= candidates[:, 1:] == candidates[:, :-1]
        c = self.x[candidates]
        d = ((c - self.x[node][:, None]) ** 2).sum(2)
        d[bad] = np.inf
        square = self.square[candidates]
        between = square[:, :, None] + square[:, None, :] - 2 * np.matmul(c, c.transpose(0, 2, 1))
        out = np.full((len(node), self.degree), -1, np.int32)
        rows, left = np.arange(len(node)), d.copy()
        for k in range(self.degree):
            best = left.argmin(1)
            alive = np.isfinite(left[rows, best])
            if not alive.any():
                break
            out[alive, k] = candidates[rows, best][alive]
            left[alpha * alpha * between[rows, best] <= d] = np.inf
            left[rows, best] = np.inf
        return out

    def build(self, beam: int, alpha: float, batch: int = 256, seed: int = 7) -> None:
        n, rng = len(self.x), np.random.default_rng(seed)
        self.out = np.full((max(n, 1), self.degree), -1, np.int32)
        if n < 2:
            return
        start = min(8, self.degree)
        self.out[:, :start] = rng.integers(0, n, (n, start))
        self.out[self.out == np.arange(n)[:, None]] = -1
        for a in (1.0, alpha):
            order = rng.permutation(n)
            for i in range(0, n, batch):
                node = order[i: i + batch]
                found, _ = self.search(self.x[node], beam)
                chosen = self.prune(node, np.concatenate((found, self.out[node]), 1), a)
                self.out[node] = chosen
                self._backward(node, chosen, a)

    def _backward(self, node: np.ndarray, chosen: np.ndarray, alpha: float) -> None:
        source = np.repeat(node, (chosen >= 0).sum(1)).astype(np.int32)
        target = chosen[chosen >= 0]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        ends, first, count = np.unique(target, return_index=True, return_counts=True)
        more = np.full((len(ends), int(count.max(initial=0))), -1, np.int32)
        more[np.repeat(np.arange(len(ends)), count), np.arange(len(target)) - np.repeat(first, count)] = source
        joined = np.concatenate((self.out[ends], more), 1)
        joined.sort(axis=1)
        twice = np.zeros(joined.shape, bool)
        twice[:, 1:] = joined[:, 1:] == joined[:, :-1]
        joined[twice] = -1
        full = (joined >= 0).sum(1) > self.degree
        short = ~full
        packed = -np.sort(-joined[short], axis=1)[:, : self.degree]
        self.out[ends[short]] = packed
        at = np.flatnonzero(full)
        for i in range(0, len(at), 512):
            part = at[i: i + 512]
            self.out[ends[part]] = self.prune(ends[part], joined[part], alpha)


def usable_vectors(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v) of the rows that take part; v as an array of doubles."""
    v = F.col(vector_col).cast("array<double>")
    rows = rows.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)).filter(finite)
    rows = rows.filter(F.exists("v", lambda x: x != 0))
    usual = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if usual:
        rows = rows.filter(F.size("v") == usual.d)
    return rows.groupBy("vec_id").agg(F.min("v").alias("v"))


def build_index(nodes: DataFrame, shards: int, longest: float, degree: int, beam: int, alpha: float) -> DataFrame:
    """One row for each shard: node numbers, vectors and neighbour lists, as bytes."""

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("node")
        x = np.array(rows["v"].tolist(), np.float64)
        graph = Graph(lifted(x, longest), degree)
        graph.build(beam, alpha)
        return pd.DataFrame({"shard": [int(rows["shard"].iloc[0])], "nodes": [rows["node"].to_numpy("<i8").tobytes()],
                             "vectors": [x.astype("<f8").tobytes()], "graph": [graph.out.astype("<i4").tobytes()]})

    placed = nodes.withColumn("shard", F.pmod(F.xxhash64("node"), F.lit(shards)))
    return placed.groupBy("shard").applyInPandas(build, "shard long, nodes binary, vectors binary, graph binary")


def lifted(x: np.ndarray, longest: float) -> np.ndarray:
    rest = np.sqrt(np.maximum(longest ** 2 - (x ** 2).sum(1), 0))
    return np.column_stack((x, rest)).astype(np.float32)


def nearest(
    rows: DataFrame, is_query, k: int = 20, degree: int = 32, beam: int = 64, query_beam: int = 128, alpha: float = 1.2,
    shard_rows: int = SHARD_ROWS, id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` largest inner products found for each query, without the query itself.

    ``is_query``: a condition on ``vec_id``.
    """
    vectors = materialise(usable_vectors(rows, id_col, vector_col))
    by_vector = Window.partitionBy("v").orderBy("vec_id")
    members = vectors.withColumn("_n", F.row_number().over(by_vector)).filter(F.col("_n") <= k + 1)
    members = materialise(members.withColumn("node", F.first("vec_id").over(by_vector)).select("node", "vec_id", "v"))
    nodes = members.filter("node = vec_id").select("node", "v")
    size, longest = nodes.agg(F.count(F.lit(1)), F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)))).first()
    shards = max(1, math.ceil(size / shard_rows))
    index = materialise(build_index(nodes, shards, longest or 1.0, degree, beam, alpha))

    asking = vectors.filter(is_query).join(nodes.select("node", F.col("v").alias("_v")), F.col("v") == F.col("_v"))
    asking = materialise(asking.select(F.col("vec_id").alias("query_id"), "node"))
    wanted = nodes.join(asking.select("node").distinct(), "node", "left_semi")
    blocks = max(1, math.ceil(wanted.count() / QUERY_BLOCK))
    # Every query goes to every shard, in blocks; a shard is read once for each block.
    to_shards = wanted.select(F.pmod(F.xxhash64("node", F.lit(1)), F.lit(blocks)).alias("block"), "node", "v",
                              F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"))
    to_blocks = index.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))

    def search(shard: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query": np.zeros(0, np.int64), "node": np.zeros(0, np.int64), "score": np.zeros(0)})
        if not len(shard) or not len(queries):
            return empty
        ids = np.frombuffer(shard["nodes"].iloc[0], "<i8")
        x = np.frombuffer(shard["vectors"].iloc[0], "<f8").reshape(len(ids), -1)
        graph = Graph(lifted(x, longest), degree, np.frombuffer(shard["graph"].iloc[0], "<i4").reshape(-1, degree))
        q = np.array(queries["v"].tolist(), np.float64)
        direction = np.column_stack((q / np.linalg.norm(q, axis=1, keepdims=True) * longest, np.zeros(len(q)))).astype(np.float32)
        keep, parts = min(k + 1, len(ids)), []
        for i in range(0, len(q), 512):
            found, _ = graph.search(direction[i: i + 512], max(query_beam, k + 1))
            score = np.einsum("qnd,qd->qn", x[found], q[i: i + 512])
            score[found < 0] = -np.inf
            best = np.argsort(-score, axis=1, kind="stable")[:, :keep]
            r = np.arange(len(found))[:, None]
            parts.append((np.repeat(queries["node"].to_numpy()[i: i + 512], keep), ids[found[r, best]].ravel(),
                          score[r, best].ravel(), found[r, best].ravel()))
        query, node, score, place = (np.concatenate(p) for p in zip(*parts, strict=True))
        ok = place >= 0
        return pd.DataFrame({"query": query[ok], "node": node[ok], "score": score[ok]})

    found = to_blocks.groupBy("shard", "block").cogroup(to_shards.groupBy("shard", "block")).applyInPandas(
        search, "query long, node long, score double")
    itself = wanted.select(F.col("node").alias("query"), "node", F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x).alias("score"))
    candidates = found.unionByName(itself).groupBy("query", "node").agg(F.max("score").alias("score"))
    listed = candidates.join(members.select("node", "vec_id"), "node")
    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    listed = listed.withColumn("_n", F.row_number().over(best)).filter(F.col("_n") <= k + 1)
    answer = asking.join(listed.select("query", "vec_id", "score"), F.col("node") == F.col("query")).filter("query_id <> vec_id")
    own = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    answer = answer.withColumn("rank", F.row_number().over(own)).filter(F.col("rank") <= k)
    return answer.select("query_id", "rank", "vec_id", "score")
