"""Pairs of similar vectors by cover trees and dual traversal.

Only vectors with the same label are compared. Equal vectors are one class. Each label's
classes are dealt to cells around pivots and cells to blocks of bounded size; two blocks
meet in a task only if their cells' covering radii allow a pair. The task builds a cover
tree of each block (nested centres, the radius halves from level to level) and walks both
trees together, level by level: a pair of nodes is dropped if its centres are further apart
than both covering radii and the limit. The pairs of points that are left are compared exactly.

A task returns link counts and a spanning forest, so its output never grows with the
number of pairs.
"""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from tickweave.llm.common import written
from tickweave.llm.components import components
from tickweave.llm.vectors import clean, matrix, usable

COSINE = 0.93
BLOCK = 2048        # classes that one side of a task holds, about
PIVOTS = 64         # cells of a label at most; larger cells are cut into blocks by a hash
LEAF = 24
PAIRS = 1 << 22     # distances that are computed at a time
SLACK = 1e-6        # for rounding in the bounds; the comparison itself has none


class CoverTree:
    """Nodes of unit vectors in arrays: centre, covering radius, and what lies below: nodes, or points as ``~point``.

    A node with one point, or with equal ones only, has its points below it.
    """

    def __init__(self, points: np.ndarray):
        self.points = points
        self.centres, self.radii, self.down = [], [], []
        todo = [self._node(0, np.arange(len(points)), np.linalg.norm(points - points[0], axis=1))]
        while todo:
            todo += self._split(*todo.pop())
        self.centre, self.radius = np.array(self.centres), np.array(self.radii)

    def _node(self, centre: int, members: np.ndarray, distance: np.ndarray):
        self.centres.append(centre)
        self.radii.append(float(distance.max()))
        self.down.append(None)
        return len(self.centres) - 1, members, distance

    def _split(self, node: int, members: np.ndarray, distance: np.ndarray) -> list:
        reach = self.radii[node] / 2
        if len(members) <= LEAF or reach == 0:
            self.down[node] = ~members
            return []
        below, new, at, gone = [], [], self.centres[node], distance
        own, left = self.points[members], np.ones(len(members), bool)
        while True:                     # the node's own centre first: levels are nested
            near = np.flatnonzero(left & (gone <= reach))
            if len(near) == 1:
                below.append(~members[near[0]])
            else:
                new.append(self._node(at, members[near], gone[near]))
                below.append(new[-1][0])
            left[near] = False
            first = int(left.argmax())
            if not left[first]:
                break
            at = int(members[first])
            gone = np.sqrt(np.maximum(2 - 2 * (own @ own[first]), 0))
            gone[first] = 0.0
        self.down[node] = np.array(below)
        return new

    def below(self, entries: np.ndarray) -> np.ndarray:
        """The next level of some nodes; points stay."""
        return np.concatenate([entries[entries < 0], *[self.down[e] for e in entries[entries >= 0]]])

    def balls(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Centres (numbers of points) and radii."""
        node = np.maximum(entries, 0)
        return np.where(entries < 0, ~entries, self.centre[node]), np.where(entries < 0, 0.0, self.radius[node])


def near_points(a: CoverTree, b: CoverTree, limit: float):
    """Pairs of points that may be within ``limit``: both trees are walked down together.

    One node of ``a`` meets at a time all entries of ``b`` that can hold points near to its
    own; both go down a level, and of each new entry of ``a`` only the near ones of ``b`` go on.
    """
    todo = [(np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while todo:
        entry, others = todo.pop()
        others = b.below(others)
        cb, rb = b.balls(others)
        every = a.below(entry)
        width = max(1, PAIRS // len(others))
        for own in (every[k:k + width] for k in range(0, len(every), width)):
            ca, ra = a.balls(own)
            apart = np.sqrt(np.maximum(2 - 2 * (a.points[ca] @ b.points[cb].T), 0))      # of unit vectors
            near = apart <= ra[:, None] + rb + limit + SLACK
            final = (own < 0)[:, None] & (others < 0)
            x, y = np.nonzero(near & final)
            if len(x):
                yield ca[x], cb[y]
            near &= ~final
            for k in np.flatnonzero(near.any(1)):
                todo.append((own[k:k + 1], others[near[k]]))


def links(va: np.ndarray, vb: np.ndarray, cosine: float):
    """Index pairs (x in va, y in vb) with a cosine of at least ``cosine``, in chunks."""
    na, nb = np.linalg.norm(va, axis=1), np.linalg.norm(vb, axis=1)
    a = CoverTree(va / na[:, None])
    b = a if vb is va else CoverTree(vb / nb[:, None])
    limit = np.sqrt(max(0.0, 2 - 2 * cosine))
    for x, y in near_points(a, b, limit):
        for k in range(0, len(x), PAIRS // 64):
            p, q = x[k:k + PAIRS // 64], y[k:k + PAIRS // 64]
            near = np.einsum("ij,ij->i", va[p], vb[q]) / (na[p] * nb[q]) >= cosine
            yield p[near], q[near]


def forest(n: int, pairs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The smallest index that each of ``n`` points reaches."""
    low = np.arange(n)
    x = np.concatenate([p[0] for p in pairs]) if pairs else np.zeros(0, np.int64)
    y = np.concatenate([p[1] for p in pairs]) if pairs else np.zeros(0, np.int64)
    while True:
        new = low.copy()
        small = np.minimum(low[x], low[y])
        np.minimum.at(new, x, small)
        np.minimum.at(new, y, small)
        np.minimum.at(new, low[x], small)
        np.minimum.at(new, low[y], small)
        new = new[new]
        if (new == low).all():
            return low
        low = new


def _compare(frame: pd.DataFrame, cosine: float) -> pd.DataFrame:
    """Links within a task's block or between its two blocks, per class, with the forest."""
    left, right = frame[frame["side"] == 0], frame[frame["side"] == 1]
    alone = not len(right)
    va = matrix(left["vector"])
    vb = va if alone else matrix(right["vector"])
    both = left if alone else pd.concat([left, right])
    weight = both["n"].to_numpy()
    shift = 0 if alone else len(left)
    count, pairs = np.zeros(len(both), np.int64), []
    for x, y in links(va, vb, cosine):
        y = y + shift
        other = x != y
        x, y = x[other], y[other]
        np.add.at(count, x, weight[y])
        if not alone:
            np.add.at(count, y, weight[x])
        pairs.append((x, y))
    root = forest(len(both), pairs)
    out = pd.DataFrame({"rep": both["rep"].to_numpy(), "h": both["h"].to_numpy(), "n_links": count,
                        "root_rep": both["rep"].to_numpy()[root], "root_h": both["h"].to_numpy()[root]})
    return out[count > 0]


def _to_cells(chunk: pd.DataFrame, pivots: pd.DataFrame) -> pd.DataFrame:
    """Each class with its nearest pivot and the distance to it, on unit vectors."""
    if not len(chunk):
        return pd.DataFrame(columns=["label", "dim", "rep", "h", "n", "vector", "cell", "away"])
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    v, p = unit(matrix(chunk["vector"])), unit(matrix(pivots["vector"]))
    near = np.sqrt(np.maximum(2 - 2 * (v @ p.T), 0))
    cell = near.argmin(1)
    exact = np.linalg.norm(v - p[cell], axis=1)
    return chunk[["label", "dim", "rep", "h", "n", "vector"]].assign(cell=pivots["nth"].to_numpy()[cell], away=exact)


def similar_vectors(df: DataFrame, cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id of every row.

    Rows with a null label or vec_id and unusable vectors (null, empty, zero, or with null
    or non-finite components) have no links and are their own component. Vectors of
    different length are not compared. Repeated rows count as vectors of their own; a
    vec_id that stands for several vectors is in one row for each. Other columns are not used.
    """
    rows = clean(df.where("label is not null"), "label").select(
        "vec_id", "vector", "label", F.size("vector").alias("dim"),
        F.xxhash64("vector").alias("h"), F.xxhash64("vector", F.lit(1)).alias("g"))
    classes = written(rows.groupBy("label", "dim", "h", "g", "vector").agg(
        F.min("vec_id").alias("rep"), F.count("*").alias("n")), "classes")
    key = ["label", "dim"]
    sizes = classes.groupBy(*key).agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    first = classes.withColumn("nth", F.row_number().over(Window.partitionBy(*key).orderBy("h", "g", "rep"))).where(
        F.col("nth") <= PIVOTS)
    pivots = written(first.join(sizes, key).where("nth <= blocks").select(*key, "nth", "vector", "blocks"), "pivots")
    dealt = classes.join(sizes, key).withColumn("chunk", F.pmod("h", "blocks"))
    to_chunks = pivots.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
    kind = dict(df.dtypes)["label"]
    shape = f"label {kind}, dim int, rep long, h long, n long, vector array<double>, cell int, away double"
    cells = dealt.groupBy(*key, "chunk").cogroup(to_chunks.groupBy(*key, "chunk")).applyInPandas(_to_cells, shape)
    cells = written(cells, "cells")

    spread = cells.groupBy(*key, "cell").agg(F.max("away").alias("radius"), F.ceil(F.count("*") / BLOCK).alias("parts"))
    spread = written(spread.join(pivots.select(*key, F.col("nth").alias("cell"), F.col("vector").alias("pivot")),
                                 [*key, "cell"]), "spread")
    blocks = spread.withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)))
    norm = lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, x: s + x * x))
    a = blocks.select(*key, *[F.col(c).alias(f"a_{c}") for c in ("cell", "part", "radius", "pivot")])
    b = blocks.select(*key, *[F.col(c).alias(f"b_{c}") for c in ("cell", "part", "radius", "pivot")])
    apart = norm(F.zip_with(F.col("a_pivot"), F.col("b_pivot"), lambda x, y: x / norm(F.col("a_pivot")) - y / norm(F.col("b_pivot"))))
    limit = float(np.sqrt(max(0.0, 2 - 2 * cosine)))
    in_order = (F.col("a_cell") < F.col("b_cell")) | ((F.col("a_cell") == F.col("b_cell")) & (F.col("a_part") <= F.col("b_part")))
    meets = a.join(b, key).where(in_order & (apart <= F.col("a_radius") + F.col("b_radius") + limit + SLACK))
    meets = meets.withColumn("task", F.struct("a_cell", "a_part", "b_cell", "b_part"))
    same = (F.col("a_cell") == F.col("b_cell")) & (F.col("a_part") == F.col("b_part"))
    sides = meets.select(*key, "task", F.col("a_cell").alias("cell"), F.col("a_part").alias("part"), F.lit(0).alias("side"))
    sides = sides.unionByName(meets.where(~same).select(
        *key, "task", F.col("b_cell").alias("cell"), F.col("b_part").alias("part"), F.lit(1).alias("side")))
    placed = cells.join(spread.select(*key, "cell", "parts"), [*key, "cell"]).withColumn(
        "part", F.pmod(F.xxhash64("h", "rep"), "parts"))
    tasks = placed.join(sides, [*key, "cell", "part"]).select(*key, "task", "side", "rep", "h", "n", "vector")
    found = tasks.groupBy(*key, "task").applyInPandas(
        lambda frame: _compare(frame, cosine), "rep long, h long, n_links long, root_rep long, root_h long")
    found = written(found, "found")

    counts = found.groupBy("rep", "h").agg(F.sum("n_links").alias("linked"))
    groups = components(found.select(F.struct("rep", "h").alias("a"), F.struct(
        F.col("root_rep").alias("rep"), F.col("root_h").alias("h")).alias("b")))
    named = groups.select(F.col("node.rep").alias("rep"), F.col("node.h").alias("h"), F.col("root.rep").alias("root"))
    known = (classes.select("label", "dim", "h", "g", "rep", "n").join(counts, ["rep", "h"], "left")
             .join(named, ["rep", "h"], "left")
             .select("label", "dim", "h", "g", (F.coalesce("linked", F.lit(0)) + F.col("n") - 1).alias("n_links"),
                     F.coalesce("root", "rep").alias("component_id")))
    linked = rows.select("vec_id", "label", "dim", "h", "g").join(known, ["label", "dim", "h", "g"]).select(
        "vec_id", "n_links", "component_id")
    takes_part = F.col("label").isNotNull() & F.col("vec_id").isNotNull() & usable(F.col("embedding"))
    alone = df.where(~takes_part).select(
        F.col("vec_id").cast("bigint").alias("vec_id"), F.lit(0).cast("bigint").alias("n_links"),
        F.col("vec_id").cast("bigint").alias("component_id"))
    return linked.unionByName(alone)
