"""Windows against plain Python, on both the direct and the pre-combined path."""

import random

import pytest
from pyspark.sql import functions as F

from tickweave.operators.aggregates import Agg
from tickweave.operators.windows import (
    cooccur_same_window, cooccur_within, landmark, last_tick, sliding_every_tick, sliding_time, tumbling,
)

AGGS = [Agg(f, f) for f in ("avg", "min", "max", "sum", "count", "last")]
FIELDS = "event_id long, tick long, device_id string, value double"


def plain(vals):
    """vals: (tick, event_id, value) with nulls; an aggregate over no values is 0."""
    vs = [v for v in sorted(vals, key=lambda x: x[:2]) if v[2] is not None]
    if not vs:
        return (0.0,) * 6
    xs = [v[2] for v in vs]
    return tuple(round(float(x), 6) for x in (sum(xs) / len(xs), min(xs), max(xs), sum(xs), len(xs), xs[-1]))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    out = []
    for i in range(400):
        dev = rng.choice(["a", "a", "a", "b", None])
        tick = rng.choice([7, rng.randrange(-30, 60), rng.randrange(200, 230)])
        out.append((i, tick, dev, None if rng.random() < 0.1 else round(rng.gauss(5, 9), 2)))
    return out


@pytest.fixture(scope="module")
def df(spark, rows):
    return spark.createDataFrame(rows, FIELDS).repartition(4)


def near(r):
    return tuple(round(r[f], 6) for f in ("avg", "min", "max", "sum", "count", "last"))


@pytest.mark.parametrize("size", [1, 2, 6, 30, 500])
@pytest.mark.parametrize("max_rows", [0, 10_000])
def test_sliding_per_reading(df, rows, size, max_rows):
    got = {r.event_id: near(r) for r in sliding_time(df, size, AGGS, max_rows=max_rows).collect()}
    want = {}
    for i, t, d, _ in rows:
        if t >= size:
            want[i] = plain([(u, j, v) for j, u, e, v in rows if e == d and t - size < u <= t])
    assert got == want


@pytest.mark.parametrize("size", [2, 30])
def test_sliding_per_tick(df, rows, size):
    got = {(r.device_id, r.tick): near(r) for r in sliding_time(df, size, AGGS, emit="tick").collect()}
    want = {(d, t): plain([(u, j, v) for j, u, e, v in rows if e == d and t - size < u <= t])
            for _, t, d, _ in rows if t >= size}
    assert got == want


@pytest.mark.parametrize("slide", [1, 5])
def test_sliding_every_tick(df, rows, slide):
    out = sliding_every_tick(df, 10, AGGS, until=F.lit(100), slide=slide)
    got = {(r.device_id, r.tick): near(r) for r in out.collect()}
    want = {}
    for d in {r[2] for r in rows}:
        for t in range(10, 101, slide):
            inside = [(u, j, v) for j, u, e, v in rows if e == d and t - 10 < u <= t]
            if inside:
                want[(d, t)] = plain(inside)
    assert got == want


@pytest.mark.parametrize("max_rows,block", [(0, 16), (0, 4096), (10_000, 16)])
def test_landmark(df, rows, max_rows, block):
    out = landmark(df, AGGS, max_rows=max_rows, block_ticks=block)
    got = {r.event_id: near(r) for r in out.collect()}
    want = {i: plain([(u, j, v) for j, u, e, v in rows if e == d and u <= t]) for i, t, d, _ in rows}
    assert got == want


def test_tumbling_edges(spark):
    rows = [(1, 0, "d", 1.0), (2, 9, "d", 3.0), (3, 10, "d", 5.0), (4, 29, "d", 7.0), (5, 30, "d", 9.0)]
    df = spark.createDataFrame(rows, FIELDS)
    out = tumbling(df, 10, [Agg("m"), Agg("n", "count")]).orderBy("window_start").collect()
    # a reading on an edge opens the next window; the window without readings has no row
    assert [(r.window_start, r.window_end, r.m, r.n) for r in out] == [
        (0, 10, 2.0, 2.0), (10, 20, 5.0, 1.0), (20, 30, 7.0, 1.0), (30, 40, 9.0, 1.0)]
    closed = tumbling(df, 10, [Agg("m")], closed_at=last_tick(df))
    assert sorted(r.window_end for r in closed.collect()) == [10, 20, 30]
    anchored = tumbling(df, 10, [Agg("m")], start=5).orderBy("window_start").collect()
    assert [(r.window_start, r.m) for r in anchored] == [(-5, 1.0), (5, 4.0), (25, 8.0)]
    gated = tumbling(df, 10, [Agg("m")], start=5, gated=True).orderBy("window_start").collect()
    assert [(r.window_start, r.m) for r in gated] == [(5, 4.0), (25, 8.0)]


def test_last_breaks_ties_by_event(spark):
    df = spark.createDataFrame([(5, 1, "d", 1.0), (9, 1, "d", 2.0), (7, 1, "d", 3.0), (10, 1, "d", None)], FIELDS)
    assert tumbling(df, 10, [Agg("x", "last")]).first().x == 2.0


def test_unknown_aggregate():
    with pytest.raises(ValueError):
        Agg("x", "median")


@pytest.mark.parametrize("within", [0, 3, 40])
def test_cooccur_within(spark, rows, within):
    left = [r for r in rows if r[0] % 3 == 0]
    right = [r for r in rows if r[0] % 3 == 1]
    out = cooccur_within(spark.createDataFrame(left, FIELDS), spark.createDataFrame(right, FIELDS), within)
    got = {r.event_id: (r.n_matches, r.first_match, r.last_match) for r in out.collect()}
    want = {}
    for i, t, d, _ in left:
        hits = [u for _, u, e, _ in right if e == d and abs(u - t) <= within]
        if hits:
            want[i] = (len(hits), min(hits), max(hits))
    assert got == want


def test_cooccur_same_window(spark):
    df = spark.createDataFrame([(1, 0, "a", 1.0), (2, 9, "a", -1.0), (3, 10, "a", 1.0), (4, 19, "b", -1.0)], FIELDS)
    out = cooccur_same_window(df, 10, F.col("value") > 0, F.col("value") < 0).collect()
    assert [(r.device_id, r.window_start, r.n_first, r.n_second) for r in out] == [("a", 0, 1, 1)]
