"""Binary search in a sorted array column, inside the JVM."""

from pyspark.sql import Column, DataFrame, functions as F


_STEP_BITS = (4, 8, 12)     # arrays below these sizes (as powers of two) need that many steps only


def rank_in_sorted(array: Column, x: Column, max_size: int) -> Column:
    """Number of leading entries of the ascending ``array`` that are <= ``x``.

    Costs log2(size) steps per row, rounded up to a few lengths, where ``size(filter(...))``
    would cost the whole array. ``max_size`` must be an upper bound of the array's size.
    """
    longest = max(1, max_size).bit_length()

    def steps(bits: int) -> Column:
        return F.array(*[F.lit(1 << b) for b in reversed(range(bits))])

    chosen = steps(longest)
    for bits in reversed([b for b in _STEP_BITS if b < longest]):
        chosen = F.when(F.size(array) < (1 << bits), steps(bits)).otherwise(chosen)

    def search(v: Column) -> Column:
        # get() gives null past the end, and null <= v is not true
        return F.aggregate(chosen, F.lit(0), lambda pos, step: F.when(F.get(array, pos + step - 1) <= v, pos + step).otherwise(pos))

    # as a lambda's variable, x is worked out once instead of at every step
    return F.get(F.transform(F.array(x), search), F.lit(0))


def compiled_apart(df: DataFrame, out: str, x: Column) -> DataFrame:
    """Add ``x`` as a column; what is done with the rows from there on is a method of its own when it is compiled.

    A chain of projections is one method, and the JVM leaves methods of over 8,000 bytes
    of bytecode to its interpreter, at a fifth of the speed. A generator starts a new one.
    """
    return df.select("*", F.posexplode(F.array(x)).alias("_place", out)).drop("_place")


def with_rank(df: DataFrame, out: str, array: Column, x: Column, max_size: int) -> DataFrame:
    """Add ``rank_in_sorted`` as a column, one projection per step of the search.

    The steps are plain expressions, compiled into one method. The lambda of
    ``rank_in_sorted`` is interpreted for each row, and so is the whole projection
    it stands in, so this is the form for many rows.
    """
    df = compiled_apart(df.withColumns({"_sorted": array, "_rank_so_far": F.lit(0)}), "_sought", x)
    rank = F.col("_rank_so_far")
    for bit in reversed(range(max(1, max_size).bit_length())):
        # the lower bits are still zero, so these are sums; an addition would be checked for overflow
        last, ahead = rank.bitwiseOR(F.lit((1 << bit) - 1)), rank.bitwiseOR(F.lit(1 << bit))
        # get() gives null past the end, and null <= x is not true
        df = df.withColumn("_rank_so_far", F.when(F.get("_sorted", last) <= F.col("_sought"), ahead).otherwise(rank))
    return compiled_apart(df.drop("_sorted", "_sought"), out, rank).drop("_rank_so_far")
