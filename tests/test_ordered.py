"""Ordered operators against plain Python, with and without split keys."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickweave.operators.deadband import GROUPS, after, first_hits, segment_table, transfer_rows
from tickweave.operators.ordered import keep_last_n, keep_recent, rolling_rows, with_previous, with_row_number
from tickweave.operators.segments import HOT, SEGMENT, Segments, plan_segments
from tickweave.operators.transmit import (
    crossing_status, deadband_status, drop_counts, lossy, periodic, transmit,
)

KEYS, ORDER = ["device_id"], ["tick", "event_id"]


def make_rows(n=600, seed=3):
    """One device holds most rows and most of those share a tick."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        dev = rng.choice(["hot"] * 6 + ["a", "b", None])
        tick = 50 if (dev == "hot" and rng.random() < 0.5) else rng.randrange(100)
        rows.append((i, tick, dev, round(rng.gauss(0, 10), 2), rng.random() < 0.8,
                     rng.choice(["NORMAL", "ABOVE", "BELOW"])))
    return rows


@pytest.fixture(scope="module")
def rows():
    return make_rows()


@pytest.fixture(scope="module")
def df(spark, rows):
    return spark.createDataFrame(
        rows, "event_id long, tick long, device_id string, value double, ok boolean, tier string"
    ).repartition(5)


@pytest.fixture(scope="module", params=["whole", "split"])
def segments(request, df):
    if request.param == "whole":
        return Segments(tuple(KEYS), tuple(ORDER))
    seg = plan_segments(df, KEYS, ORDER, min_rows=40)
    assert seg.any_hot
    return seg


def by_key(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r[1], r[0])):
        out.setdefault(r[2], []).append(r)
    return out


def test_segments_are_balanced_and_ordered(df, rows):
    seg = plan_segments(df, KEYS, ORDER, min_rows=40)
    got = seg.assign(df).select("device_id", "tick", "event_id", SEGMENT, HOT).collect()
    assert len(got) == len(rows)
    hot = sorted((r for r in got if r.device_id == "hot"), key=lambda r: (r.tick, r.event_id))
    labels = [r[SEGMENT] for r in hot]
    assert labels == sorted(labels) and len(set(labels)) > 5
    assert max(labels.count(s) for s in set(labels)) <= 90
    cold = [r for r in got if not r[HOT]]
    assert all(r[SEGMENT] == 0 for r in cold)


def test_segments_keep_a_least_size(df):
    seg = plan_segments(df, KEYS, ORDER, min_rows=40, min_segment_rows=70)
    sizes = [r["count"] for r in seg.hot_rows(df).groupBy(*KEYS, SEGMENT).count().collect()]
    assert len(sizes) > 1 and min(sizes) >= 70


def test_previous(df, rows, segments):
    got = {r.event_id: r.prev for r in with_previous(
        df, F.col("tier"), "prev", KEYS, ORDER, segments=segments).collect()}
    want = {}
    for group in by_key(rows).values():
        last = None
        for r in group:
            want[r[0]], last = last, r[5]
    assert got == want


def test_previous_where(df, rows, segments):
    got = {r.event_id: r.prev for r in with_previous(
        df, F.col("value"), "prev", KEYS, ORDER, where=F.col("ok"), default=F.lit(-1.0),
        segments=segments).collect()}
    want = {}
    for group in by_key(rows).values():
        last = -1.0
        for r in group:
            want[r[0]] = last
            last = r[3] if r[4] else last
    assert got == want


def test_row_number(df, rows, segments):
    got = {r.event_id: r.n for r in with_row_number(df, "n", KEYS, ORDER, segments).collect()}
    want = {r[0]: i for g in by_key(rows).values() for i, r in enumerate(g, 1)}
    assert got == want


@pytest.mark.parametrize("n", [1, 7])
def test_keep_last_n(df, rows, n):
    want = {r[0] for g in by_key(rows).values() for r in g[-n:]}
    for min_rows in (40, 10_000):
        seg = plan_segments(df, KEYS, ORDER, min_rows=min_rows, min_segment_rows=n)
        got = [r.event_id for r in keep_last_n(df, n, KEYS, ORDER, seg).collect()]
        assert sorted(got) == sorted(want)


@pytest.mark.parametrize("n", [1, 6])
def test_rolling_rows(df, rows, n):
    want = {}
    for g in by_key(rows).values():
        for i, r in enumerate(g):
            vals = [x[3] for x in g[max(0, i - n + 1): i + 1]]
            want[r[0]] = round(sum(vals) / len(vals), 6)
    for min_rows in (40, 10_000):
        seg = plan_segments(df, KEYS, ORDER, min_rows=min_rows, min_segment_rows=max(1, n - 1))
        out = rolling_rows(df, n, {"m": F.avg("value")}, KEYS, ORDER, seg)
        got = {r.event_id: round(r.m, 6) for r in out.collect()}
        assert got == want


def fold(group, limit):
    last, out = None, {}
    for r in group:
        if last is not None and abs(r[3] - last) < limit:
            out[r[0]] = "suppressed"
        elif r[4]:
            out[r[0]], last = "sent", r[3]
        else:
            out[r[0]] = "lost"
    return out


@pytest.mark.parametrize("limit", [0.5, 8.0, 25.0])
def test_deadband(df, rows, segments, limit):
    got = {r.event_id: r.status for r in deadband_status(
        df, limit, F.col("ok"), KEYS, ORDER, segments).collect()}
    want = {}
    for g in by_key(rows).values():
        want |= fold(g, limit)
    assert got == want


def last_of(values, limit, last):
    for v in values:
        if last is None or abs(v - last) >= limit:
            last = v
    return last


def test_segment_table_equals_fold():
    """The table of a segment must hold what folding it gives, for any value before it, in few groups."""
    rng = random.Random(5)
    n_exact = n_all = 0
    for case in range(400):
        limit = rng.choice([0.0, 0.5, 1.0, 3.0, 10.0])
        kind = rng.random()
        n = rng.randrange(0, 40)
        if kind < 0.3:      # a slow ramp never forgets where it started
            values = [0.25 * i for i in range(n)]
        elif kind < 0.6:
            values = [float(rng.randrange(0, 8)) for _ in range(n)]
        else:
            values = [rng.gauss(0, 3) for _ in range(n)]
        table = segment_table(np.array(values), limit, groups=4)
        assert all(len(table[f"{side}_edge"]) <= 4 for side in ("up", "down"))
        assert table["from_nothing"] == last_of(values, limit, None)
        some = [rng.choice([rng.gauss(0, 4), float(rng.randrange(-2, 9))]) for _ in range(12)]
        for before in some:
            want = last_of(values, limit, before)
            low, high = after(table, before, before)
            assert low <= want <= high, (case, limit, values, before)
            n_exact, n_all = n_exact + (low == high), n_all + 1
            point = segment_table(np.array(values), limit, before, before, groups=4)
            assert after(point, before, before) == (want, want)
        low, high = after(table, min(some), max(some))
        narrow = after(segment_table(np.array(values), limit, min(some), max(some), groups=4), min(some), max(some))
        for got in ((low, high), narrow):
            assert all(got[0] <= last_of(values, limit, v) <= got[1] for v in some)
    assert n_exact > 0.7 * n_all


def test_first_hits():
    rng = np.random.default_rng(3)
    for n in (1, 2, 3, 7, 64, 333):
        value = np.cumsum(rng.normal(size=n)).round(1)
        at, end = rng.integers(0, n + 1, 200), rng.integers(0, n + 1, 200)
        last, limit = rng.normal(size=200).round(1), rng.choice([0.0, 0.5, 2.0, 9.0], 200)
        got = first_hits(value, at, last, limit, end)
        for a, e, x, d, g in zip(at, end, last, limit, got):
            assert g == next((j for j in range(a, e) if abs(value[j] - x) >= d), e)


@pytest.mark.parametrize("limit", [30.0, 1000.0])
def test_deadband_of_a_drift(spark, limit):
    """A million readings of one key that creep: every new reading is a new extreme, tables stay small."""
    n = 1_000_000
    df = spark.range(n).select(
        F.col("id").alias("event_id"), F.col("id").alias("tick"), F.lit("d").alias("device_id"),
        F.lit("m").alias("measure_name"), (F.col("id") / 1000).alias("value"))
    segments = plan_segments(df, KEYS, ORDER, min_rows=50_000)
    assert segments.any_hot and segments.max_cuts >= 10
    hot = segments.hot_rows(df).withColumns({
        "_limit": F.lit(limit), "_ok": F.lit(True), "_low": F.lit(float("-inf")), "_high": F.lit(float("inf")),
        "_start": F.row_number().over(segments.window()) == 1})
    sizes = transfer_rows(hot, KEYS).select(F.size("up_edge") + F.size("down_edge")).collect()
    assert len(sizes) >= 10 and max(r[0] for r in sizes) <= 2 * GROUPS
    got = [r.tick for r in deadband_status(df, limit, None, KEYS, ORDER, segments).filter(
        "status = 'sent'").orderBy("tick").collect()]
    want, last = [], None
    for i in range(n):
        if last is None or abs(i / 1000 - last) >= limit:
            want.append(i)
            last = i / 1000
    assert got == want


def test_crossing(df, rows, segments):
    got = {r.event_id: r.status for r in crossing_status(
        df, 5.0, F.col("ok"), KEYS, ORDER, segments).collect()}
    want = {}
    for g in by_key(rows).values():
        last = 0.0
        for r in g:
            if (r[3] >= 5.0) == (last >= 5.0):
                want[r[0]] = "suppressed"
            elif r[4]:
                want[r[0]], last = "sent", r[3]
            else:
                want[r[0]] = "lost"
    assert got == want


def test_thinning_small(spark):
    df = spark.createDataFrame([(t, "d", "m", float(t)) for t in range(0, 13)],
                               "tick long, device_id string, measure_name string, value double")
    assert [r.tick for r in periodic(df, 5).orderBy("tick").collect()] == [0, 5, 10]
    assert [r.tick for r in periodic(df, 5, start=2).orderBy("tick").collect()] == [2, 7, 12]
    assert lossy(df, 0.0, 1).count() == 13 and lossy(df, 1.0, 1).count() == 0
    some = {r.tick for r in lossy(df, 0.4, 1).collect()}
    assert some == {r.tick for r in lossy(df.repartition(7), 0.4, 1).collect()}
    assert 0 < len(some) < 13
    assert [r.tick for r in keep_recent(df, 3, F.lit(12)).orderBy("tick").collect()] == [9, 10, 11, 12]


def test_transmit_by_mode(spark):
    rows = []
    for t in range(6):
        rows.append((t, t, "p", "m", 1.0, "PERIODIC", 120000.0, None))
        rows.append((t + 10, t, "c", "m", float(t), "ON_CHANGE", None, 2.0))
        rows.append((t + 20, t, "x", "m", float(t), "ON_THRESHOLD", None, 3.0))
    df = spark.createDataFrame(
        rows, "event_id long, tick long, device_id string, measure_name string, value double, "
              "mode string, interval_ms double, threshold double").withColumn("failure", F.lit(0.0))
    out = transmit(df, 60000, seed=1)
    sent = sorted((r.device_id, r.tick) for r in out.filter("status = 'sent'").collect())
    assert sent == [("c", 0), ("c", 2), ("c", 4), ("p", 0), ("p", 2), ("p", 4), ("x", 3)]
    counts = {r.status: r.n for r in drop_counts(out).collect()}
    assert counts == {"sent": 7, "suppressed": 8}
