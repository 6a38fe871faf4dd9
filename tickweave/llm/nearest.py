"""Approximate nearest neighbours by navigable small-world graphs, one per shard.

Distinct vectors are dealt to shards of about ``SHARD`` by a hash. A task inserts its
shard's vectors one by one (Malkov and Yashunin, 2018) and returns one row per node with
its links as one flat array, level by level. Queries are searched in every shard, a block of
queries and a shard at a time, and the shards' results are merged by exact distance.

Equal vectors are one node that carries its smallest ids, as many as a result can need.
After insertion, nodes that the entry point does not reach at the lowest level are linked
to their nearest reached node, so a search that may visit a whole shard finds all of it.
"""

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from tickweave.llm.common import written
from tickweave.llm.vectors import clean, matrix

SHARD = 4096
QUERY_BLOCK = 2048
LINKS = 12              # per node above the lowest level, twice as many there
SPARE = 6               # places for links that repair reachability
BREADTH = 48            # of the search while inserting
SEARCH_BREADTH = 128    # of a query


class Graph:
    """Vectors and flat neighbour arrays (-1: free), one per level."""

    def __init__(self, vectors: np.ndarray, levels: np.ndarray):
        self.vectors, self.levels = vectors, levels
        self.squares = (vectors * vectors).sum(1)
        top = int(levels.max()) if len(levels) else 0
        n = len(vectors)
        self.links = [np.full((n, 2 * LINKS + SPARE if k == 0 else LINKS), -1, np.int32) for k in range(top + 1)]
        self.far = [np.full(x.shape, np.inf) for x in self.links]
        self.entry, self.seen, self.mark = -1, np.zeros(n, np.int64), 0

    def distances(self, q: np.ndarray, square: float, nodes: np.ndarray) -> np.ndarray:
        return self.squares[nodes] - 2 * (self.vectors[nodes] @ q) + square

    def search(self, q, square, entries: list[tuple[float, int]], breadth: int, level: int) -> list[tuple[float, int]]:
        """The ``breadth`` nearest that a best-first walk finds, nearest first."""
        self.mark += 1
        seen, mark, links = self.seen, self.mark, self.links[level]
        for _, e in entries:
            seen[e] = mark
        ahead = list(entries)
        heapq.heapify(ahead)
        best = [(-d, e) for d, e in entries]
        heapq.heapify(best)
        while ahead:
            d, node = heapq.heappop(ahead)
            if d > -best[0][0] and len(best) >= breadth:
                break
            near = links[node]
            near = near[near >= 0]
            near = near[seen[near] != mark]
            if not len(near):
                continue
            seen[near] = mark
            away = self.distances(q, square, near)
            if len(best) >= breadth:
                closer = away < -best[0][0]
                near, away = near[closer], away[closer]
            for x, e in zip(away.tolist(), near.tolist()):
                if len(best) < breadth:
                    heapq.heappush(best, (-x, e))
                elif x < -best[0][0]:
                    heapq.heapreplace(best, (-x, e))
                else:
                    continue
                heapq.heappush(ahead, (x, e))
        return sorted((-d, e) for d, e in best)

    def descend(self, q, square, down_to: int) -> list[tuple[float, int]]:
        at = [(float(self.distances(q, square, np.array([self.entry]))[0]), self.entry)]
        for level in range(int(self.levels[self.entry]), down_to, -1):
            at = self.search(q, square, at, 1, level)
        return at

    def _choose(self, found: list[tuple[float, int]], most: int) -> list[tuple[float, int]]:
        """Near nodes, leaving out those that are nearer to a chosen one than to the new node."""
        if len(found) <= 1:
            return found
        nodes = np.array([e for _, e in found])
        v = self.vectors[nodes]
        between = self.squares[nodes][:, None] - 2 * (v @ v.T) + self.squares[nodes]
        lowest, chosen = np.full(len(nodes), np.inf), []
        for k, (d, e) in enumerate(found):
            if d <= lowest[k]:
                chosen.append((d, e))
                if len(chosen) == most:
                    break
                lowest = np.minimum(lowest, between[k])
        return chosen

    def _link(self, level: int, node: int, to: int, d: float) -> None:
        """A link back; a full node gives up its farthest one for a nearer."""
        width = self.links[level].shape[1] - (SPARE if level == 0 else 0)
        far = self.far[level][node, :width]
        free = np.flatnonzero(self.links[level][node, :width] < 0)
        k = int(free[0]) if len(free) else int(far.argmax())
        if len(free) or d < far[k]:
            self.links[level][node, k], self.far[level][node, k] = to, d

    def insert(self, node: int) -> None:
        if self.entry < 0:
            self.entry = node
            return
        q, square = self.vectors[node], float(self.squares[node])
        top, own = int(self.levels[self.entry]), int(self.levels[node])
        at = self.descend(q, square, min(top, own))
        for level in range(min(top, own), -1, -1):
            at = self.search(q, square, at, BREADTH, level)
            for k, (d, e) in enumerate(self._choose(at, LINKS)):
                self.links[level][node, k], self.far[level][node, k] = e, d
                self._link(level, e, node, d)
        if own > top:
            self.entry = node

    def reached(self) -> np.ndarray:
        done = np.zeros(len(self.vectors), bool)
        done[self.entry] = True
        at = np.array([self.entry])
        while len(at):
            near = self.links[0][at].ravel()
            near = np.unique(near[near >= 0])
            at = near[~done[near]]
            done[at] = True
        return done

    def repair(self) -> None:
        done = self.reached()
        while not done.all():
            lost = int(np.flatnonzero(~done)[0])
            free = np.flatnonzero(done & (self.links[0] < 0).any(1))
            near = int(free[self.distances(self.vectors[lost], float(self.squares[lost]), free).argmin()])
            self.links[0][near, np.flatnonzero(self.links[0][near] < 0)[0]] = lost
            done = self.reached()

    def nearest(self, q: np.ndarray, breadth: int) -> np.ndarray:
        square = float(q @ q)
        found = self.search(q, square, self.descend(q, square, 0), breadth, 0)
        return np.array([e for _, e in found])


def build(vectors: np.ndarray, seed: int) -> Graph:
    rng = np.random.default_rng(seed)
    levels = np.minimum(-np.log(1 - rng.random(len(vectors))) / np.log(LINKS), 8).astype(int)
    graph = Graph(vectors, levels)
    for node in range(len(vectors)):
        graph.insert(node)
    graph.repair()
    return graph


def _build_shard(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame.sort_values("first_id", kind="stable").reset_index(drop=True)
    graph = build(matrix(frame["vector"]), int(frame["shard"][0]))
    flat = np.concatenate(graph.links, axis=1)
    return frame[["dim", "shard", "ids", "vector"]].assign(
        node=np.arange(len(frame), dtype=np.int32), level=graph.levels.astype(np.int32),
        entry=np.int32(graph.entry), links=list(flat))


def _restored(frame: pd.DataFrame) -> Graph:
    levels = frame["level"].to_numpy()
    graph = Graph.__new__(Graph)
    graph.vectors, graph.levels = matrix(frame["vector"]), levels
    graph.squares = (graph.vectors * graph.vectors).sum(1)
    flat, at, graph.links = np.stack(frame["links"].to_numpy()), 0, []
    for k in range(int(levels.max()) + 1):
        width = 2 * LINKS + SPARE if k == 0 else LINKS
        graph.links.append(np.ascontiguousarray(flat[:, at:at + width]))
        at += width
    graph.entry, graph.seen, graph.mark = int(frame["entry"].iloc[0]), np.zeros(len(levels), np.int64), 0
    return graph


def _search_shard(nodes: pd.DataFrame, queries: pd.DataFrame, k: int) -> pd.DataFrame:
    """Up to ``k`` rows for each query: exact distances on the original vectors, ties to smaller ids."""
    out = []
    if len(nodes) and len(queries):
        nodes = nodes.sort_values("node")
        graph = _restored(nodes)
        ids = nodes["ids"].to_numpy()
        for query_id, q in zip(queries["query_id"].to_numpy(), matrix(queries["vector"])):
            found = graph.nearest(q, max(SEARCH_BREADTH, 2 * k))
            away = np.sqrt(((graph.vectors[found] - q) ** 2).sum(1))
            rows = sorted((d, int(i)) for d, e in sorted(zip(away.tolist(), found.tolist()))[:2 * k + 2]
                          for i in ids[e] if i != query_id)[:k]
            out += [(query_id, i, d) for d, i in rows]
    return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])


def index(df: DataFrame, k: int) -> DataFrame:
    """The shards' graphs as rows: dim, shard, node, ids, vector, level, entry, links. Every usable row is in it."""
    rows = clean(df).distinct()
    nth = F.row_number().over(Window.partitionBy("vector").orderBy("vec_id"))
    few = rows.withColumn("nth", nth).where(F.col("nth") <= k + 1)
    nodes = written(few.groupBy("vector").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")), "nodes")
    shards = max(1, -(-nodes.count() // SHARD))
    dealt = nodes.select(F.size("vector").alias("dim"), F.pmod(F.xxhash64("vector", F.lit(9)), F.lit(shards)).alias("shard"),
                         "ids", F.col("ids")[0].alias("first_id"), "vector")
    return written(dealt.groupBy("dim", "shard").applyInPandas(
        _build_shard, "dim int, shard long, ids array<long>, vector array<double>, node int, level int, entry int, "
                      "links array<int>"), "graphs")


def search(graphs: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found of each query (``query_id``, ``vector``)."""
    asked = written(queries.select("query_id", "vector", F.size("vector").alias("dim")), "queries")
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    shards = graphs.select(F.col("dim").alias("of_dim"), F.col("shard").alias("in_shard")).distinct()
    asked = asked.join(shards, F.col("dim") == F.col("of_dim")).select(
        "query_id", "vector", "dim", F.col("in_shard").alias("shard"),
        F.pmod(F.xxhash64("query_id", F.lit(2)), F.lit(blocks)).alias("block"))
    every_block = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint")))
    key = ["dim", "shard", "block"]
    found = graphs.withColumn("block", every_block).groupBy(*key).cogroup(asked.groupBy(*key)).applyInPandas(
        lambda a, b: _search_shard(a, b, k), "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest_neighbours(df: DataFrame, is_query, k: int = 10) -> DataFrame:
    """For each row with ``is_query`` its ``k`` nearest other rows by Euclidean distance.

    Rows with a null vec_id or an unusable vector (null, empty, zero, or with null or
    non-finite components) take no part, neither as query nor as candidate. A query sees
    only vectors of its own length, and none with its own vec_id. Repeated rows are one
    candidate; of a repeated query id with different vectors, the smallest vector is asked.
    Other columns of ``df`` are not used.
    """
    asked = clean(df.where(is_query)).groupBy("vec_id").agg(F.min("vector").alias("vector"))
    return search(index(df, k), asked.withColumnRenamed("vec_id", "query_id"), k)
