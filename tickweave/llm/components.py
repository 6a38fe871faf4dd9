"""Connected components by alternating stars (Kiveris et al., 2014), as joins and aggregations."""

from pyspark.sql import DataFrame, functions as F

from tickweave.llm.common import written


def _toward_smallest(pairs: DataFrame, larger_only: bool) -> DataFrame:
    """Every node's neighbours (or only those larger than it) hung onto the smallest of them and itself."""
    lowest = pairs.groupBy("a").agg(F.min("b").alias("m"))
    near = pairs.join(lowest, "a").withColumn("m", F.least("a", "m"))
    if larger_only:
        return near.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return _both(near, ("b", "m"), ("a", "m"))


def _both(rows: DataFrame, *pairs: tuple[str, str]) -> DataFrame:
    """Each of the ``pairs`` of columns as a row (``a``, ``b``); the rows are read once, a union would read them twice."""
    each = F.array(*[F.struct(F.col(x).alias("a"), F.col(y).alias("b")) for x, y in pairs])
    return rows.select(F.explode(each).alias("pair")).select("pair.a", "pair.b")


def _is_settled(edges: DataFrame) -> bool:
    """Whether every larger end hangs on one node and that node hangs on none: then that node is its root."""
    mark = lambda node, hangs: F.struct(
        F.col(node).alias("node"), F.lit(hangs).alias("hangs"), F.lit(1 - hangs).alias("holds"))
    ends = edges.select(F.explode(F.array(mark("a", 1), mark("b", 0))).alias("end")).select("end.*")
    nodes = ends.groupBy("node").agg(F.sum("hangs").alias("hangs"), F.max("holds").alias("holds"))
    open_nodes = nodes.where((F.col("hangs") > 1) | ((F.col("hangs") == 1) & (F.col("holds") == 1)))
    return open_nodes.agg(F.count("*")).first()[0] == 0


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``root``, the smallest node it reaches, for every node in ``links`` (``a``, ``b``).

    Rows with a null end and self-links add nothing. Each round is written to the shared
    folder and aggregates before it joins, so a hub's links are spread like any skewed join.
    Rounds end once all links are stars, which one aggregation over the nodes tells.
    """
    edges = links.where("a is not null and b is not null and a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = written(edges, "links")
    while not _is_settled(edges):
        large = _toward_smallest(_both(edges, ("a", "b"), ("b", "a")), True).where("a <> b").distinct()
        small = _toward_smallest(written(large, "links"), False).where("a <> b").distinct()
        edges = written(small, "links")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
