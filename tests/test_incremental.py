"""Merged summaries give what one pass over all readings gives."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tickweave.functions.scalars import exact_mean
from tickweave.operators.conformance import conformance, observed_stats
from tickweave.operators.incremental import appended, finished, merged, moves, statistics, stretch_columns, verdicts
from tickweave.operators.segments import plan_segments
from tickweave.streaming import windows as sw
from tickweave.streaming.conformance import DEVICE_GROUP, keep_summaries, kept_summaries, stretches

FIELDS = "event_id long, tick long, device_id string, measure_name string, value double, tier string"
KEYS = ("device_id", "measure_name")
ORIGIN = 1704067200
BOUNDS = (-10.0, 10.0)


def rows(n=600, shift=1e6):
    """Two readings a tick, ties in order of event_id, missing values and tiers, one key without values."""
    rng = random.Random(5)
    out = []
    for i in range(n):
        device = rng.choice("aaab")
        value = None if device == "b" and i < 300 or rng.random() < 0.1 else shift + rng.gauss(0, 5)
        out.append((n - i, i // 2, device, "m", value, rng.choice(["NORMAL", "ABOVE", "BELOW", None])))
    out += [(n + i, 17 * i, "c", "m", None, "BELOW") for i in range(6)] + [(n + 9, 40, None, "m", 1.0, "ABOVE")]
    return out


def summarised(df, length=25):
    cut = F.floor(F.col("tick") / length) * length
    return finished(df.groupBy(*KEYS, cut.alias("stretch")).agg(*stretch_columns(*map(F.lit, BOUNDS))))


def same(got, want):
    key = lambda r: str(r["device_id"])
    got, want = sorted(got.collect(), key=key), sorted(want.collect(), key=key)
    assert [key(r) for r in got] == [key(r) for r in want]
    for g, w in zip(got, want):
        for c in w.asDict():
            close = isinstance(w[c], float) and g[c] is not None
            assert math.isclose(g[c], w[c], rel_tol=1e-9, abs_tol=1e-9) if close else g[c] == w[c], (c, g, w)


def test_moves(spark):
    paths = [([],), (["x"],), (["x", "x"],), (["x", "y", "y", "x"],)]
    got = spark.createDataFrame(paths, "p array<string>").select(moves(F.col("p")).alias("n")).collect()
    assert [r["n"] for r in got] == [0, 0, 0, 2]


@pytest.mark.parametrize("hot", [False, True])
def test_stretches_merge_to_the_whole(spark, hot):
    df = spark.createDataFrame(rows(), FIELDS)
    parts = summarised(df)
    segments = plan_segments(parts, KEYS, ("stretch",), min_rows=4) if hot else None
    assert segments is None or segments.any_hot
    same(statistics(merged(parts, KEYS, segments=segments)).drop("stretch"), observed_stats(df, KEYS, *map(F.lit, BOUNDS)))


def test_histories_append(spark):
    """A key that only the first, only the second, or both parts have."""
    df = spark.createDataFrame(rows() + [(9999, 299, "late", "m", 3.0, "ABOVE")], FIELDS)
    parts = summarised(df)
    early, late = (merged(parts.where(c), KEYS) for c in ("stretch < 150", "stretch >= 150"))
    got = appended(early, late, KEYS)
    same(statistics(got).drop("stretch"), observed_stats(df, KEYS, *map(F.lit, BOUNDS)))
    assert {r["device_id"]: r["stretch"] for r in got.collect()}["a"] == 275


def test_means_go_by_no_order(spark):
    """Two-decimal readings whose plain sums differ in the last bit with the order; an exact sum has one value."""
    rng = random.Random(3)
    data = [(i, rng.randrange(200), f"d{i % 150}", "m", round(rng.expovariate(0.02), 2), "NORMAL") for i in range(2000)]
    want = {}
    for r in data:
        want.setdefault(r[2], []).append(r[4])
    want = {device: math.fsum(values) / len(values) for device, values in want.items()}
    df = spark.createDataFrame(data, FIELDS).repartition(7)
    batch = observed_stats(df, KEYS, *map(F.lit, BOUNDS))
    assert {r["device_id"]: r["observed_mean"] for r in batch.collect()} == want
    for length in (7, 60):
        parts = summarised(df, length)
        early, late = (merged(parts.where(c), KEYS) for c in ("stretch < 90", "stretch >= 90"))
        for got in (merged(parts, KEYS), appended(early, late, KEYS)):
            assert {r["device_id"]: r["mean"] for r in got.collect()} == want


def test_mean_of_odd_values(spark):
    """Values beyond the exact range, infinite, missing or not a number mean what they always did."""
    inf, nan = math.inf, math.nan
    cases = {"wide": [1e300, -1e300, 6.0], "big": [2.0**40, 2.0**40 + 1], "inf": [1.0, inf], "nan": [1.0, nan], "none": [None, None],
             "some": [None, 0.25]}
    df = spark.createDataFrame([(k, v) for k, values in cases.items() for v in values], "k string, value double")
    got = {r["k"]: r["m"] for r in df.coalesce(1).groupBy("k").agg(exact_mean(F.col("value")).alias("m")).collect()}
    assert math.isnan(got.pop("nan"))
    assert got == {"wide": 2.0, "big": 2.0**40 + 0.5, "inf": inf, "none": None, "some": 0.25}


def test_no_readings(spark):
    empty = summarised(spark.createDataFrame([], FIELDS))
    assert appended(merged(empty, KEYS), merged(empty, KEYS), KEYS).count() == 0


def test_stream_keeps_what_batch_finds(spark, tmp_path):
    """Four out-of-order micro-batches, a restart between them; the store holds two versions at most."""
    data = [r for r in rows(shift=0.0) if r[2] in ("a", "b")]
    rng = random.Random(1)
    files = [[] for _ in range(4)]
    for r in data:
        files[min(3, max(0, (r[1] + rng.randrange(-8, 9)) // 75))].append(r)
    bindings = spark.createDataFrame(
        [("a", "K", "m", 1, -10.0, 10.0, 2), ("b", "K", "m", 1, -5.0, 5.0, 1)],
        "device_id string, device_class string, measure_name string, zone_id long, range_min double, range_max double, binding_idx long")
    tiers = spark.createDataFrame(
        [("K", "m", 1, t, "NORMAL", {"mean": 0.0, "std_dev": 5.0}, p) for t, p in (("NORMAL", 0.5), ("ABOVE", 0.25), ("BELOW", 0.25))],
        "device_class string, measure_name string, zone_id long, tier string, family string, params map<string,double>, probability double")
    source, folder = str(tmp_path / "in"), str(tmp_path / "store")
    for half in (files[:2], files[2:]):
        for part in half:
            spark.createDataFrame(part, FIELDS).coalesce(1).write.mode("append").parquet(source)
        raw = spark.readStream.schema(FIELDS).option("maxFilesPerTrigger", 1).parquet(source)
        bound = sw.with_event_time(raw, "25 minutes", ORIGIN).join(bindings.drop("binding_idx"), list(KEYS))
        q = keep_summaries(stretches(bound, 20, ORIGIN), folder, min_rows=2).trigger(availableNow=True).start()
        q.awaitTermination()
        assert q.exception() is None
    got = kept_summaries(spark, folder)
    end = (299 - 25) // 20 * 20
    df = spark.createDataFrame([r for r in data if r[1] < end], FIELDS)
    assert got.agg(F.sum("n_events")).first()[0] == df.count()
    for devices in ("all", "representative"):
        same(verdicts(got, bindings, tiers, devices).drop("tiers"), conformance(df, bindings, tiers, devices).drop("tiers"))
    assert got.columns[:4] == list(DEVICE_GROUP)
    assert len(list((tmp_path / "store" / "store").iterdir())) <= 2
