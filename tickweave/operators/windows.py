"""Batch windows over ticks: tumbling, sliding by time, landmark, co-occurrence.

Tumbling windows combine on the map side, so a hot device shrinks before it is
shuffled. Sliding and landmark windows are running aggregates inside blocks of
ticks. If a block or key holds too many readings for one task (a cheap count
tells), readings are first combined per (key, tick), which bounds a block by
its ticks; otherwise that step and the join back to the readings are saved.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tickweave.operators.aggregates import Agg, State, result, states_for

LANDMARK_BLOCK = 4096
MAX_ROWS_PER_TASK = 2_000_000
_RUNNING = (Window.unboundedPreceding, Window.currentRow)


def tumbling(
    df: DataFrame,
    size: int,
    aggs: Sequence[Agg],
    keys: Sequence[str] = ("device_id",),
    start: int = 0,
    closed_at: Column | None = None,
    tick: str = "tick",
    tie: str = "event_id",
    gated: bool = False,
) -> DataFrame:
    """Windows [start + k*size, start + (k+1)*size): one row per key and window with data.

    ``gated`` makes the window at ``start`` the first one: readings before it belong to none.
    ``closed_at`` keeps only windows that end at or before that tick, i.e. those a
    running system would already have fired (see ``last_tick``).
    """
    index = F.floor((F.col(tick) - start) / F.lit(size)).cast("bigint")
    states = states_for(aggs, tick, tie)
    exprs = [s.from_rows.alias(s.name) for s in states] or [F.count(F.lit(1)).alias("_rows")]
    df = df.filter(F.col(tick) >= start) if gated else df
    out = df.groupBy(*keys, index.alias("_window")).agg(*exprs)
    window_start = F.col("_window") * size + F.lit(start)
    out = out.select(
        *keys,
        window_start.cast("bigint").alias("window_start"),
        (window_start + size).cast("bigint").alias("window_end"),
        *[result(a) for a in aggs],
    )
    return out if closed_at is None else out.filter(F.col("window_end") <= closed_at)


def last_tick(df: DataFrame, tick: str = "tick") -> Column:
    """The latest tick of a table as a scalar subquery."""
    return df.agg(F.max(tick)).scalar()


def tick_series(df: DataFrame, states: Sequence[State], keys: Sequence[str],
                tick: str = "tick", *extra: Column) -> DataFrame:
    """One row per (key, tick) with the states of its readings."""
    return df.groupBy(*keys, tick).agg(*[s.from_rows.alias(s.name) for s in states], *extra)


def _row_states(df: DataFrame, states: Sequence[State]) -> DataFrame:
    """The states of single readings, beside all columns of the reading."""
    return df.withColumns({s.name: s.of_row for s in states})


def _is_heavy(df: DataFrame, by: Sequence[Column], max_rows: int) -> bool:
    """Whether any group has more than ``max_rows`` readings: one narrow, map-side-combined count."""
    sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > max_rows)
    return not sizes.isEmpty()


def _sliding_states(rows: DataFrame, size: int, states: Sequence[State],
                    keys: Sequence[str], tick: str) -> DataFrame:
    """Merge the states of (tick - size, tick] for every row.

    Ticks are cut into blocks as long as the window, so a window is a prefix of its
    own block plus a suffix of the block before. Both are running aggregates: the
    cost per row does not depend on the window length, and nothing is subtracted.
    Every row is placed in its own block and, as history, in the next one; one
    shuffle brings both together. History rows carry the states only.
    """
    names = [s.name for s in states]
    payload = [c for c in rows.columns if c not in (*keys, tick, *names)]
    block = F.floor(F.col(tick) / F.lit(size)).cast("bigint")
    placed = rows.withColumn("_own", F.explode(F.array(F.lit(True), F.lit(False)))).select(
        *keys, tick, "_own", *names,
        (block + F.when(F.col("_own"), 0).otherwise(1)).alias("_block"),
        *[F.when(F.col("_own"), F.col(c)).alias(c) for c in payload],
    ).repartition(*keys, "_block")

    # history: suffix of the previous block from this row on; it takes effect when the row
    # before it has left the window
    backwards = Window.partitionBy(*keys, "_block", "_own").orderBy(F.col(tick).desc())
    suffix = backwards.rangeBetween(*_RUNNING)
    left_at = F.lead(tick).over(backwards) + size
    placed = placed.select(
        *keys, tick, "_block", "_own", *payload, *names,
        F.struct(
            F.max(tick).over(suffix).alias("until"),
            *[s.merge(F.col(s.name)).over(suffix).alias(s.name) for s in states],
        ).alias("_suffix"),
        F.coalesce(left_at, F.col("_block") * size).alias("_from"),
    )
    # peers (readings of one tick) see each other; history that takes effect at a tick
    # comes before its readings
    forwards = (
        Window.partitionBy(*keys, "_block")
        .orderBy(F.when(F.col("_own"), F.col(tick)).otherwise(F.col("_from")), "_own", tick)
        .rangeBetween(*_RUNNING)
    )
    own = lambda c: F.when(F.col("_own"), c)
    merged = placed.select(
        *keys, tick, "_own", *payload,
        *[s.merge(own(F.col(s.name))).over(forwards).alias(f"_p{s.name}") for s in states],
        F.last(F.when(~F.col("_own"), F.col("_suffix")), ignorenulls=True).over(forwards).alias("_h"),
    ).filter(F.col("_own"))
    alive = F.col("_h.until") + size > F.col(tick)
    return merged.select(
        *keys, tick, *payload,
        *[s.combine(F.col(f"_p{s.name}"), F.when(alive, F.col(f"_h.{s.name}"))).alias(s.name)
          for s in states],
    )


def sliding_time(
    df: DataFrame,
    size: int,
    aggs: Sequence[Agg],
    keys: Sequence[str] = ("device_id",),
    start: int = 0,
    emit: str = "reading",
    tick: str = "tick",
    tie: str = "event_id",
    max_rows: int = MAX_ROWS_PER_TASK,
) -> DataFrame:
    """Aggregates over (tick - size, tick], from tick start + size on.

    ``emit="tick"`` gives one row per key and tick with readings; ``emit="reading"``
    repeats it on every reading of that tick.
    """
    states = states_for(aggs, tick, tie)
    block = F.floor(F.col(tick) / F.lit(size))
    if emit == "reading" and not _is_heavy(df, [*keys, block], max_rows):
        out = _sliding_states(_row_states(df, states), size, states, keys, tick)
        out = out.filter(F.col(tick) - start >= size)
        return out.select(*df.columns, *[result(a) for a in aggs])
    series = _sliding_states(tick_series(df, states, keys, tick), size, states, keys, tick)
    series = series.filter(F.col(tick) - start >= size)
    return _emit(df, series, aggs, keys, tick, emit)


def sliding_every_tick(
    df: DataFrame,
    size: int,
    aggs: Sequence[Agg],
    keys: Sequence[str] = ("device_id",),
    start: int = 0,
    until: Column | None = None,
    slide: int = 1,
    tick: str = "tick",
    tie: str = "event_id",
) -> DataFrame:
    """Sliding window fired every ``slide`` ticks as long as it holds data.

    Also fires on ticks without arrivals, up to ``until``. Readings are first
    combined per pane of ``slide`` ticks; a pane feeds size/slide windows.
    """
    if size % slide:
        raise ValueError("size must be a multiple of slide")
    states = states_for(aggs, tick, tie)
    pane_end = (F.floor((F.col(tick) - start - 1) / F.lit(slide)) + 1).cast("bigint") * slide + start
    panes = df.groupBy(*keys, pane_end.alias("_pane")).agg(*[s.from_rows.alias(s.name) for s in states])
    fired = panes.withColumn(
        tick, F.explode(F.sequence(F.col("_pane"), F.col("_pane") + (size - slide), F.lit(slide).cast("bigint")))
    ).filter(F.col(tick) - start >= size)
    if until is not None:
        fired = fired.filter(F.col(tick) <= until)
    out = fired.groupBy(*keys, tick).agg(*[s.merge(F.col(s.name)).alias(s.name) for s in states])
    return out.select(*keys, tick, *[result(a) for a in aggs])


def landmark(
    df: DataFrame,
    aggs: Sequence[Agg],
    keys: Sequence[str] = ("device_id",),
    emit: str = "reading",
    block_ticks: int = LANDMARK_BLOCK,
    tick: str = "tick",
    tie: str = "event_id",
    max_rows: int = MAX_ROWS_PER_TASK,
) -> DataFrame:
    """Aggregates over everything since the start, up to and with the current tick."""
    states = states_for(aggs, tick, tie)
    if emit == "reading" and not _is_heavy(df, [F.col(k) for k in keys], max_rows):
        so_far = Window.partitionBy(*keys).orderBy(tick).rangeBetween(*_RUNNING)
        running = df.select("*", *[s.from_rows.over(so_far).alias(s.name) for s in states])
        return running.select(*df.columns, *[result(a) for a in aggs])
    names = [s.name for s in states]
    series = tick_series(df, states, keys, tick)
    series = series.withColumn("_block", F.floor(F.col(tick) / F.lit(block_ticks)).cast("bigint"))
    # total of all earlier blocks: one row per key and block, a few per year of ticks
    totals = series.groupBy(*keys, "_block").agg(*[s.merge(F.col(s.name)).alias(s.name) for s in states])
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(
        *[F.col(k).alias(f"_b_{k}") for k in (*keys, "_block")],
        *[s.merge(F.col(s.name)).over(earlier).alias(f"_e{s.name}") for s in states],
    )
    inside = Window.partitionBy(*keys, "_block").orderBy(tick).rowsBetween(*_RUNNING)
    series = series.select(
        *keys, tick, "_block", *[s.merge(F.col(s.name)).over(inside).alias(s.name) for s in states]
    )
    same = [F.col(k).eqNullSafe(F.col(f"_b_{k}")) for k in (*keys, "_block")]
    series = series.join(totals, same, "left").select(
        *keys, tick, *[s.combine(F.col(s.name), F.col(f"_e{s.name}")).alias(s.name) for s in states]
    )
    return _emit(df, series, aggs, keys, tick, emit)


def _emit(df: DataFrame, series: DataFrame, aggs: Sequence[Agg], keys: Sequence[str],
          tick: str, emit: str) -> DataFrame:
    values = series.select(*keys, tick, *[result(a) for a in aggs])
    if emit == "tick":
        return values
    if emit != "reading":
        raise ValueError(f"emit must be 'reading' or 'tick', not {emit!r}")
    renamed = values.select(
        *[F.col(c).alias(f"_s_{c}") for c in (*keys, tick)], *[a.out for a in aggs]
    )
    same = [F.col(c).eqNullSafe(F.col(f"_s_{c}")) for c in (*keys, tick)]
    return df.join(renamed, same).drop(*[f"_s_{c}" for c in (*keys, tick)])


def cooccur_same_window(
    df: DataFrame,
    size: int,
    first: Column,
    second: Column,
    keys: Sequence[str] = ("device_id",),
    start: int = 0,
    tick: str = "tick",
) -> DataFrame:
    """Tumbling windows of a key in which both conditions were seen."""
    index = F.floor((F.col(tick) - start) / F.lit(size)).cast("bigint")
    out = df.groupBy(*keys, index.alias("_window")).agg(
        F.count_if(first).alias("n_first"), F.count_if(second).alias("n_second")
    ).filter((F.col("n_first") > 0) & (F.col("n_second") > 0))
    window_start = F.col("_window") * size + F.lit(start)
    return out.select(
        *keys,
        window_start.cast("bigint").alias("window_start"),
        (window_start + size).cast("bigint").alias("window_end"),
        "n_first", "n_second",
    )


def cooccur_within(
    left: DataFrame,
    right: DataFrame,
    within: int,
    keys: Sequence[str] = ("device_id",),
    tick: str = "tick",
) -> DataFrame:
    """Left readings that have a right reading of the same key within +-``within`` ticks.

    Adds ``n_matches``, ``first_match`` and ``last_match`` (ticks). Pairs are never
    formed: the right side is a sliding count read at tick + ``within``, so a device
    with many readings on both sides costs their sum, not their product.
    """
    probes = left.select(*keys, (F.col(tick) + within).alias(tick))
    probes = probes.withColumn("_hit", F.lit(None).cast("bigint")).withColumn("_probe", F.lit(True))
    hits = right.select(*keys, tick, F.col(tick).alias("_hit"), F.lit(False).alias("_probe"))
    hit = F.col("_hit")
    states = [
        State("_n", F.count(hit), hit.isNotNull().cast("bigint"), F.sum, _plus),
        State("_first", F.min(hit), hit, F.min, F.least),
        State("_last", F.max(hit), hit, F.max, F.greatest),
    ]
    series = tick_series(hits.unionByName(probes), states, keys, tick, F.bool_or("_probe").alias("_probe"))
    found = _sliding_states(series, 2 * within + 1, states, keys, tick)
    found = found.filter(F.col("_probe") & (F.col("_n") > 0)).select(
        *[F.col(k).alias(f"_s_{k}") for k in keys],
        (F.col(tick) - within).alias("_s_tick"),
        F.col("_n").alias("n_matches"), F.col("_first").alias("first_match"),
        F.col("_last").alias("last_match"),
    )
    same = [F.col(k).eqNullSafe(F.col(f"_s_{k}")) for k in keys] + [F.col(tick) == F.col("_s_tick")]
    return left.join(found, same).drop("_s_tick", *[f"_s_{k}" for k in keys])


def _plus(a: Column, b: Column) -> Column:
    return F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))
