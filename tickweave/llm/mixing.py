"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame operations only.

Every document has the key ``-ln(u) / w``, exponential with its quality weight ``w`` as
rate; taking documents by ascending key is weighted sampling without replacement
(Efraimidis and Spirakis, 2006). ``u`` comes from an md5 of the document id, so reruns agree.
Rows that share an id, or have none, are told apart by a hash of the row, and equal rows by
their number among themselves: each has a draw of its own.

A source with budget ``target`` gives all its documents ``floor(target / size)`` times;
what is left goes to the documents first by key, up to the one whose middle the budget
still reaches. To find that place without sorting a source in one task, keys are cut into
ranges of about ``ROWS_PER_RANGE`` rows, and word counts are summed over ranges first, then
within each range.
"""

from pyspark.sql import Column, DataFrame, Window, functions as F

from tickweave.functions.uniform import open_uniform
from tickweave.llm.common import free_names, row_key, written

WEIGHTS = (5, 2, 1)         # of sources by code point, repeating
MOST_EPOCHS = 3
SEED = 7
ROWS_PER_RANGE = 20_000
EQUAL_ROWS = 10_000         # equal rows that one task numbers
BROADCAST_SOURCES = 100_000     # up to so many sources, their table is sent to every task
_WORD = r"[^\x20\x09-\x0D]+"


def words_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(_WORD)), F.lit(0)).cast("bigint")


def source_targets(sizes: DataFrame) -> DataFrame:
    """``target`` of each source from ``source``, ``source_size``, ``rows``.

    Sources are listed once, which is one row for each; the weights cycle in code point
    order with null last. The budget is the sum of all sizes. A level is raised evenly
    over the weights; sources whose level exceeds MOST_EPOCHS sizes stop there. These are
    the first by ``size / weight``, so one ordered pass finds where the level settles.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (place % len(WEIGHTS) + 1).cast("int"))
    ranked = sizes.withColumn("weight", weight).withColumn("most", F.col("source_size") * float(MOST_EPOCHS))
    order = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").isNull(), "source")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    level = left / F.sum("weight").over(after)
    stopped = (ranked.withColumn("level", level).withColumn("nth", F.row_number().over(order))
               .withColumn("stops", F.col("most") <= F.col("level") * F.col("weight")))
    settled = F.min_by("level", F.when(~F.col("stops"), F.col("nth"))).over(everything)
    return stopped.select("source", "source_size", "rows", F.when(F.col("stops"), F.col("most")).otherwise(
        F.least("most", settled * F.col("weight"))).alias("target"))


def mix(docs: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """doc_id, source, size, source_size, target, taken and ``copies`` of every document.

    ``weights`` has doc_id and a positive ``weight``; documents without one, or with a null
    or non-positive one, weigh 1. A null or empty text has size 0 and is taken 0 times over.
    A null source is a source. Repeated rows each count; equal keys go by doc_id, then size.
    No document is taken more than MOST_EPOCHS times. Without rows there is no result.
    """
    return _mixed(_classes(docs), weights).select("doc_id", "source", "size", "source_size", "target", "taken", "copies")


def _classes(docs: DataFrame) -> DataFrame:
    """Rows that are equal in all columns, once: doc_id, source, size, h, g, and how many ``equal`` ones there are."""
    h, g = row_key(docs)
    own = docs.select("doc_id", "source", words_of(F.col("text")).alias("size"), h.alias("h"), g.alias("g"))
    return written(own.groupBy("doc_id", "source", "size", "h", "g").agg(F.count("*").alias("equal")), "rows")


def _draws(classes: DataFrame) -> DataFrame:
    """One row for each document, with its uniform draw ``u``."""
    shared = classes.where("doc_id is not null").groupBy("doc_id").agg(F.sum("equal").alias("of_id")).where("of_id > 1")
    numbers = lambda a, b: F.explode(F.sequence(a, b))
    told = classes.join(shared, "doc_id", "left").withColumn(
        "part", numbers(F.lit(0).cast("bigint"), F.floor((F.col("equal") - 1) / EQUAL_ROWS)))
    first = F.col("part") * EQUAL_ROWS
    told = told.repartition("h", "g", "part").withColumn(
        "nth", numbers(first + 1, F.least(first + EQUAL_ROWS, "equal"))).drop("part")
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    alone = F.col("of_id").isNull() & F.col("doc_id").isNotNull()
    return told.withColumn("u", F.when(alone, open_uniform(SEED, [name], "mix")).otherwise(
        open_uniform(SEED, [name, *[F.col(c).cast("string") for c in ("h", "g", "nth")]], "mix"))).drop("of_id", "equal")


def _mixed(classes: DataFrame, weights: DataFrame | None) -> DataFrame:
    """What ``mix`` returns, with all columns of ``classes``."""
    own = _draws(classes)
    if weights is None:
        own = own.withColumn("weight", F.lit(1.0))
    else:
        one = weights.groupBy("doc_id").agg(F.max("weight").alias("weight"))
        own = own.join(one, "doc_id", "left").withColumn(
            "weight", F.when(F.col("weight") > 0, F.col("weight").cast("double")).otherwise(F.lit(1.0)))
    keyed = written(own.withColumn("key", -F.log("u") / F.col("weight")).drop("weight"), "mixing")

    sizes = written(source_targets(
        keyed.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))), "sources")
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    plan = (sizes.withColumn("epochs", F.least(epochs, F.lit(MOST_EPOCHS)).cast("bigint"))
            .withColumn("rest", F.greatest(F.col("target") - F.col("epochs") * F.col("source_size"), F.lit(0.0)))
            .withColumn("ranges", F.ceil(F.col("rows") / ROWS_PER_RANGE))
            .withColumnRenamed("source", "of"))
    plan = F.broadcast(plan) if sizes.count() <= BROADCAST_SOURCES else plan
    rows = keyed.join(plan, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    rows = rows.withColumn("range", F.floor((1 - F.exp(-F.col("key"))) * F.col("ranges")))

    by_range = rows.groupBy("source", "range").agg(F.sum("size").alias("words"))
    so_far = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = by_range.select(F.col("source").alias("of"), F.col("range").alias("in"),
                             F.coalesce(F.sum("words").over(so_far), F.lit(0)).alias("ahead"))
    placed = rows.join(starts, F.col("source").eqNullSafe(F.col("of")) & (F.col("range") == F.col("in"))).drop("of", "in")
    earlier = (Window.partitionBy("source", "range").orderBy("key", "doc_id", "size", "h", "g", "nth")
               .rowsBetween(Window.unboundedPreceding, -1))
    middle = F.col("ahead") + F.coalesce(F.sum("size").over(earlier), F.lit(0)) + F.col("size") / 2
    chosen = (F.col("epochs") < MOST_EPOCHS) & (F.col("size") > 0) & (middle <= F.col("rest"))
    copies = F.when(F.col("size") > 0, F.col("epochs") + chosen.cast("bigint")).otherwise(F.lit(0)).cast("bigint")
    return placed.withColumn("copies", copies).withColumn("taken", F.col("copies") * F.col("size"))


def mixed_rows(docs: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """Each row of ``docs`` as many times as the mix takes it, all columns as they are.

    Rows that are equal in all columns are one row here, taken as often as all of them together.
    """
    h, g, copies, copy = free_names(docs, "h", "g", "copies", "copy")
    counts = _mixed(_classes(docs), weights).groupBy(F.col("h").alias(h), F.col("g").alias(g)).agg(F.sum("copies").alias(copies))
    counts = written(counts.where(F.col(copies) > 0), "copies")
    # equal rows become one in each task before they are shuffled
    rows = docs.withColumns(dict(zip((h, g), row_key(docs)))).dropDuplicates([h, g]).join(counts, [h, g])
    return rows.select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col(copies).cast("int"))).alias(copy)).drop(copy)
