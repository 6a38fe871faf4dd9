"""Removal of lines that many sites share.

A site is a document's ``source``. Each distinct line gets a HyperLogLog sketch of its
sites (64 registers, merged by the aggregation itself), so hot lines are one small sketch
per task before any shuffle. A line whose estimate is far below the bound is done; far
above, it is boilerplate; between, its distinct sites are counted exactly. Every line whose
estimate is not far below is looked up, so all counts that decide are exact or clear.

Of a boilerplate line, the occurrence in the smallest doc_id (first position) stays; all
others go. So copies of a document lose their lines to the first copy, not all of them.
"""

from pyspark.sql import Column, DataFrame, functions as F

from tickweave.llm.common import free_names, written

SITES = 5               # lines on at least so many sites are boilerplate
_WORD = r"[^\x20\x09-\x0D]"     # a line without is blank, and stays
ERROR = 0.15            # of the sketch: 64 registers
BELOW, ABOVE = 0.3, 3.0     # times SITES: exact counts between


def line_key(line: Column) -> tuple[Column, Column]:
    """Two independent 64-bit hashes of a line without the blanks around it."""
    plain = F.trim(line)
    return F.xxhash64(plain, F.lit(0)), F.xxhash64(plain, F.lit(1))


def lines_of(docs: DataFrame) -> DataFrame:
    """doc_id, row (hash of the row's text), site, place, and the two hashes of each line that is not blank."""
    each = docs.select("doc_id", F.xxhash64("text", "source").alias("row"), F.col("source").alias("site"),
                       F.posexplode(F.split("text", "\n")).alias("place", "line"))
    each = each.where(F.col("line").rlike(_WORD))
    h, g = line_key(F.col("line"))
    return each.select("doc_id", "row", "site", "place", h.alias("h"), g.alias("g"))


def boilerplate(lines: DataFrame) -> DataFrame:
    """h, g and ``doc_id``, ``row``, ``place`` of the occurrence that stays, for each boilerplate line."""
    return _boilerplate(lines)[1]


def _boilerplate(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    spread = lines.groupBy("h", "g").agg(F.approx_count_distinct("site", ERROR).alias("sites"))
    candidates = written(spread.where(F.col("sites") >= SITES * BELOW), "lines")
    found = written(lines.join(candidates, ["h", "g"]), "occurrences")
    near = found.where(F.col("sites") <= SITES * ABOVE)
    exact = (near.where("site is not null").select("h", "g", "site").distinct()
             .groupBy("h", "g").agg(F.count("*").alias("n")).where(F.col("n") >= SITES))
    shared = candidates.where(F.col("sites") > SITES * ABOVE).select("h", "g").unionByName(exact.select("h", "g"))
    first = found.groupBy("h", "g").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row", "place")).alias("first"))
    kept = first.join(shared, ["h", "g"]).select("h", "g", "first.doc_id", "first.row", "first.place")
    return found, kept


def remove_boilerplate(docs: DataFrame) -> DataFrame:
    """``docs`` with lines removed from ``text``, and the columns ``n_lines``, ``n_removed``.

    Lines are split at newlines and compared without blanks around them; blank lines stay. A null text stays null with 0 lines, an empty one has one empty line.
    Rows with a null source have no site, so they don't count, but lose boilerplate too.
    A null doc_id comes after all others. Rows with the same doc_id, source and text are
    treated alike. A text that loses all lines becomes empty. Columns of these two names
    are replaced, all others stay.
    """
    own = docs.drop("n_lines", "n_removed")
    found, kept = _boilerplate(lines_of(own))
    hits = found.join(kept.select("h", "g", F.col("doc_id").alias("kd"), F.col("row").alias("kr"),
                                  F.col("place").alias("kp")), ["h", "g"])
    gone = hits.where(~(F.col("doc_id").eqNullSafe(F.col("kd")) & (F.col("row") == F.col("kr"))
                        & (F.col("place") == F.col("kp"))))
    per_row = gone.select("doc_id", "row", "place").distinct().groupBy("doc_id", "row").agg(
        F.collect_list("place").alias("places"))
    own_id, own_row, key, places = free_names(own, "id", "row", "key", "places")
    per_row = written(per_row, "removals").select(
        F.col("doc_id").alias(own_id), F.col("row").alias(own_row), F.col("places").alias(places))
    parts = F.split("text", "\n")
    left = F.filter(parts, lambda _, i: ~F.array_contains(places, i))
    joined = own.withColumn(key, F.xxhash64("text", "source")).join(
        per_row, F.col("doc_id").eqNullSafe(F.col(own_id)) & (F.col(key) == F.col(own_row)), "left")
    return joined.select(
        *[F.when(F.col(places).isNull(), F.col("text")).otherwise(F.concat_ws("\n", left)).alias("text")
          if c == "text" else F.col(c) for c in own.columns],
        F.coalesce(F.array_size(parts), F.lit(0)).cast("bigint").alias("n_lines"),
        F.coalesce(F.array_size(places), F.lit(0)).cast("bigint").alias("n_removed"))
