"""Clustering of vectors around centroids, with Orchard's search for the nearest one.

Components become integers, so sums, means and distances are exact and the result is the
same on any partitioning. A round sends the centroids (a fixed number of them) to all
tasks; a task assigns its vectors and hands on one sum for each centroid, which are added
up in two steps.

Orchard's search (1991): each centroid has the list of all others by distance from it. A
vector starts at one centroid and walks its list; when a closer centroid comes up, the walk
goes on in that one's list, without those seen before. It ends where the list is strictly
beyond twice the vector's distance, since by the triangle inequality nothing further can
be as close. All vectors of a batch walk together.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tickweave.llm.common import free_names, written

DIMENSIONS = 64
SCALE = 64
CLUSTERS = 16
ROUNDS = 3
SAFE = float(1 << 25)       # integers up to here keep 4 * DIMENSIONS * difference**2 within 64 bits
MERGE = 1000                # partial sums are merged in so many groups for each centroid, then these

_LONG = range(-(1 << 63), 1 << 63)


def fits(vector: Column, dimensions: int = DIMENSIONS) -> Column:
    """Exactly so many components, none of them null or non-finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double"))
                      & (F.abs(x.cast("double")) != float("inf")))
    return F.coalesce((F.size(vector) == dimensions) & finite, F.lit(False))


def quantised(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """floor(SCALE * x) as 64-bit integers, and which rows are too large for that (0 there)."""
    whole = np.floor(values * SCALE)
    large = ~(np.abs(whole) <= SAFE).all(1)
    whole[large] = 0
    return whole.astype(np.int64), large


def exact(values) -> list[int]:
    """floor(SCALE * x) of any finite doubles, as Python integers."""
    return [int(x) * SCALE if abs(x) >= 1 << 53 else int(np.floor(x * SCALE)) for x in map(float, values)]


class Orchard:
    """Centroids (lists of integers) with their distance-ordered lists."""

    def __init__(self, centroids: list[list[int]]):
        small = all(abs(x) <= SAFE for c in centroids for x in c)
        self.at = np.array(centroids, np.int64 if small else object)
        k = len(centroids)
        apart = np.array([[((a - b) ** 2).sum() for b in self.at] for a in self.at], self.at.dtype).reshape(k, k)
        self.lists = np.array([sorted((j for j in range(k) if j != c), key=lambda j: (apart[c, j], j)) for c in range(k)],
                              np.int64).reshape(k, k - 1)
        self.apart = np.take_along_axis(apart, self.lists, 1)
        self.visits = 0         # distances computed so far

    def nearest(self, points: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest centroid of each point and its squared distance; ties go to the smaller number."""
        n, k = len(points), len(self.at)
        kind = object if object in (points.dtype, self.at.dtype) else np.int64
        points = points.astype(kind)
        centroids = self.at.astype(kind)
        best, place = start.copy(), np.zeros(n, np.int64)
        distance = ((points - centroids[best]) ** 2).sum(1)
        seen = np.zeros((n, k), bool)
        seen[np.arange(n), best] = True
        self.visits += n
        walking = np.arange(n)
        while k > 1 and len(walking):
            walking = walking[place[walking] < k - 1]
            own, at = best[walking], place[walking]
            within = ~(self.apart[own, at] > 4 * distance[walking]).astype(bool)     # squares: twice the distance
            walking, own, at = walking[within], own[within], at[within]
            place[walking] += 1
            other = self.lists[own, at]
            new = ~seen[walking, other]
            who, other = walking[new], other[new]
            seen[who, other] = True
            self.visits += len(who)
            there = ((points[who] - centroids[other]) ** 2).sum(1)
            closer = ((there < distance[who]) | ((there == distance[who]) & (other < best[who]))).astype(bool)
            who = who[closer]
            best[who], distance[who], place[who] = other[closer], there[closer], 0
        return best, distance


def _assigned(batch, column: str, orchard: Orchard):
    """Cluster and squared distance of a batch's vectors, their integers, and the rows and integers of large ones."""
    values = batch.column(column).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
    points, large = quantised(values)
    start = np.zeros(len(points), np.int64)
    best, distance = orchard.nearest(points, start)
    rows = np.flatnonzero(large)
    huge = np.array([exact(values[i]) for i in rows], object).reshape(len(rows), values.shape[1])
    distance = distance.astype(object) if len(rows) else distance
    if len(rows):
        best[rows], distance[rows] = orchard.nearest(huge, start[rows])
    return best, distance, points, rows, huge


def _sums(vectors: DataFrame, column: str, centroids: list[list[int]]) -> list:
    """For each centroid with vectors: its number, how many, and their sum as decimal strings."""
    shared = vectors.sparkSession.sparkContext.broadcast(centroids)

    def partial(batches):
        orchard = Orchard(shared.value)
        k, d = orchard.at.shape
        count, total = np.zeros(k, np.int64), np.zeros((k, d), object)
        for batch in batches:
            best, _, points, rows, huge = _assigned(batch, column, orchard)
            count += np.bincount(best, minlength=k)
            part = np.zeros((k, d), np.int64)       # SAFE * rows of a batch stay far below 2**63
            np.add.at(part, best, points)
            total += part
            np.add.at(total, best[rows], huge)
        some = np.flatnonzero(count)
        if len(some):
            yield pa.RecordBatch.from_arrays(
                [pa.array(some.astype(np.int32)), pa.array(count[some]),
                 pa.array([[str(x) for x in total[c]] for c in some], pa.list_(pa.string()))], names=["cluster", "n", "total"])

    def merged(frame):
        total = sum(np.array([int(x) for x in row], object) for row in frame["total"])
        return frame.iloc[:1][["cluster"]].assign(n=frame["n"].sum(), total=[[str(x) for x in total]])

    shape = "cluster int, n long, total array<string>"
    parts = vectors.select(column).mapInArrow(partial, shape)
    parts = parts.groupBy("cluster", F.pmod(F.xxhash64("total"), F.lit(MERGE))).applyInPandas(merged, shape)
    return parts.groupBy("cluster").applyInPandas(merged, shape).collect()


def first_centroids(vectors: DataFrame, column: str, clusters: int = CLUSTERS) -> list[list[int]]:
    """The vectors with the smallest sha256 of ``1:<vec_id>``, equal hashes by vector; a null id gives none."""
    name = F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256)
    found = vectors.where("vec_id is not null").select(name.alias("name"), column).orderBy("name", column).limit(clusters)
    return [exact(r[column]) for r in found.collect()]


def moved(centroids: list[list[int]], sums: list) -> list[list[int]]:
    """Each centroid with vectors at the floor of their mean."""
    out = list(centroids)
    for r in sums:
        out[r["cluster"]] = [int(x) // r["n"] for x in r["total"]]
    return out


def cluster(df: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every vector that ``fits``.

    Vectors that don't (null, of another length, or with null or non-finite components) are
    left out, as in a table without rows. Zero vectors and repeated rows take part like any
    others. A null vec_id is clustered but starts no centroid; if no row has an id there is
    no result. With fewer vectors than clusters there are fewer centroids. Squared distances
    and their sums are null if they don't fit 64 bits. Other columns are not used.
    """
    vector, name, of = free_names(df, "vector", "hash", "of")
    vectors = df.where(fits(F.col("embedding"), dimensions)).select("vec_id", F.col("embedding").cast("array<double>").alias(vector))
    centroids = first_centroids(vectors, vector, clusters)
    kind = df.schema["vec_id"].dataType
    if not centroids:
        return df.sparkSession.createDataFrame([], T.StructType([T.StructField("vec_id", kind)])).selectExpr(
            "vec_id", "0 AS cluster", "0L AS distance", "0L AS cluster_inertia", "0L AS inertia", "'' AS centroid_sha256")
    for _ in range(rounds):
        centroids = moved(centroids, _sums(vectors, vector, centroids))
    shared = df.sparkSession.sparkContext.broadcast(centroids)

    def assign(batches):
        orchard = Orchard(shared.value)
        for batch in batches:
            best, distance, *_ = _assigned(batch, vector, orchard)
            if distance.dtype == object:
                distance = [x if x in _LONG else None for x in distance.tolist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), pa.array(best.astype(np.int32)), pa.array(distance, pa.int64())],
                names=["vec_id", "cluster", "distance"])

    found = written(vectors.mapInArrow(assign, f"vec_id {kind.simpleString()}, cluster int, distance long"), "assigned")
    whole = lambda x: F.when(F.count("*") == F.count(x), F.sum(F.col(x).cast("decimal(38,0)")))
    each = found.groupBy("cluster").agg(whole("distance").alias("sum")).collect()      # a row for each centroid
    total = sum(r["sum"] for r in each) if all(r["sum"] is not None for r in each) else None
    long = lambda x: int(x) if x is not None and int(x) in _LONG else None
    facts = df.sparkSession.createDataFrame(
        [(r["cluster"], long(r["sum"]), long(total), ",".join(map(str, centroids[r["cluster"]]))) for r in each],
        f"{of} int, cluster_inertia long, inertia long, {name} string")
    return found.join(F.broadcast(facts), F.col("cluster") == F.col(of)).select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", F.sha2(F.col(name).cast("binary"), 256).alias("centroid_sha256"))
