"""Streams in several out-of-order micro-batches give what batch gives."""

import calendar
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickweave.operators.aggregates import Agg
from tickweave.operators.conformance import transition_log
from tickweave.operators.ordered import rolling_rows
from tickweave.operators.transmit import crossing, deadband, transmit
from tickweave.plans.rules import Having, Rule, Source
from tickweave.sources.synthetic import readings_at
from tickweave.streaming import transmission as st
from tickweave.streaming import windows as sw
from tickweave.streaming.retention import purged

FIELDS = "event_id long, event_type string, tick long, device_id string, measure_name string, value double, tier string"
KEYS = ("device_id", "measure_name")
ORIGIN = 1704067200


def tick(ts):
    return (calendar.timegm(ts.utctimetuple()) - ORIGIN) / 60


@pytest.fixture(scope="module")
def source(spark, tmp_path_factory):
    """Four files; readings are up to 20 ticks out of order between them."""
    rng = random.Random(2)
    rows = [(i, "sensor_reading", i // 3, rng.choice("aab"), "m", round(rng.gauss(0, 10), 2), rng.choice(["NORMAL", "ABOVE", "BELOW"]))
            for i in range(600)]
    path = str(tmp_path_factory.mktemp("stream"))
    home = lambda r: min(3, max(0, (r[2] + rng.randrange(-10, 11)) // 50))
    files = [[] for _ in range(4)]
    for r in rows:
        files[home(r)].append(r)
    for part in files:
        rng.shuffle(part)
        spark.createDataFrame(part, FIELDS).coalesce(1).write.mode("append").parquet(path)
    return path, spark.createDataFrame(rows, FIELDS)


def stream(spark, path, delay="25 minutes"):
    raw = spark.readStream.schema(FIELDS).option("maxFilesPerTrigger", 1).parquet(path)
    return sw.with_event_time(raw, delay, ORIGIN)


def run(spark, df, tmp_path, mode="append"):
    q = (df.writeStream.format("parquet").outputMode(mode).option("path", str(tmp_path / "out"))
         .option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start())
    q.awaitTermination()
    assert q.exception() is None
    return spark.read.schema(df.schema).parquet(str(tmp_path / "out"))


MARK = 199 - 25     # last tick less the watermark's delay


@pytest.mark.parametrize("name", ["deadband", "crossing"])
def test_gate(spark, source, tmp_path, name):
    path, batch = source
    limit = 9.0 if name == "deadband" else 2.0
    s = getattr(st, name)(stream(spark, path), limit, KEYS, survive=F.col("event_id") % 7 != 0)
    got = sorted((r.device_id, r.event_id, r.value) for r in run(spark, s, tmp_path).collect())
    op = deadband if name == "deadband" else crossing
    want = sorted((r.device_id, r.event_id, r.value) for r in op(batch, limit, survive=F.col("event_id") % 7 != 0, keys=KEYS).collect() if r.tick < MARK)
    assert got == want and len(got) > 50


def test_rolling_rows_with_missing_values():
    fold = st._Rows(KEYS, 2)
    fold.recent = type("Recent", (), {"get": lambda self: [(4.0,)], "put": lambda self, rows: None})()
    rows = [(None, 1, 1, None, True), (None, 2, 2, None, True), (None, 3, 3, 8.0, True), (None, 4, 4, 6.0, False)]
    assert fold.fold(rows) == [(1, 1, 4.0), (2, 2, None), (3, 3, 8.0)]


def test_rolling_rows(spark, source, tmp_path):
    path, batch = source
    got = {r.event_id: round(r.mean_value, 6) for r in run(spark, st.rolling_rows_mean(stream(spark, path), 4, KEYS), tmp_path).collect()}
    want = {r.event_id: round(r.m, 6) for r in rolling_rows(batch, 4, {"m": F.avg("value")}, KEYS).collect() if r.tick < MARK}
    assert got == want


def test_transitions(spark, source, tmp_path):
    path, batch = source
    got = sorted((r.event_id, r.from_tier, r.to_tier) for r in run(spark, st.transitions(stream(spark, path)), tmp_path).collect())
    want = sorted((r.event_id, r.from_tier, r.to_tier) for r in transition_log(batch).collect() if r.tick < MARK)
    assert got == want


def test_windows_close_like_batch(spark, source, tmp_path):
    path, batch = source
    rule = Rule("alert", "tumbling", 10, (Source("sensor_reading", "m"),), (Agg("value", "avg"),), (Having(">", 0),), label="X", fire_offset=11)
    from tickweave.plans.rules import tumbling_rules
    out = run(spark, sw.tumbling_rule(stream(spark, path), rule, origin_s=ORIGIN).drop("window"), tmp_path)
    got = sorted((r.device_id, tick(r.fire_time), round(r.value, 6)) for r in out.collect())
    want = sorted((r.device_id, float(r.tick), round(r.value, 6)) for r in tumbling_rules(batch, [rule], digits=None).collect()
                  if r.window_end <= MARK)
    assert got == want and got


def test_chain(spark, source, tmp_path):
    path, batch = source
    alert = Rule("alert", "tumbling", 10, (Source("sensor_reading"),), (Agg("value", "avg"),), (Having(">", 0),), label="X")
    report = Rule("report", "tumbling", 50, (Source("alert", "X"),), (Agg("value", "count"),))
    out = run(spark, sw.tumbling_rule(sw.as_source(sw.tumbling_rule(stream(spark, path), alert, origin_s=ORIGIN)), report, origin_s=ORIGIN).drop("window"), tmp_path)
    rows = [r for r in batch.groupBy("device_id", F.floor(F.col("tick") / 10).alias("w")).agg(F.avg("value").alias("v")).collect() if r.v > 0]
    want = {}
    for r in rows:
        end = (r.w // 5 + 1) * 50
        if end <= MARK:
            want[(r.device_id, float(end))] = want.get((r.device_id, float(end)), 0) + 1.0
    assert {(r.device_id, tick(r.fire_time)): r.value for r in out.collect()} == want and want


def test_cooccur_within(spark, source, tmp_path):
    path, batch = source
    s = stream(spark, path)
    out = run(spark, sw.cooccur_within(s.filter("value > 12"), s.filter("value < -12"), "5 MINUTES").select("device_id", "event_id"), tmp_path)
    got = sorted(r.event_id for r in out.collect())
    rows = batch.collect()
    want = sorted(l.event_id for l in rows if l.value > 12 and any(
        r.value < -12 and r.device_id == l.device_id and abs(r.tick - l.tick) <= 5 for r in rows))
    assert got == want and got


def test_late_readings_are_dropped(spark, tmp_path):
    src = str(tmp_path / "src")
    row = lambda i, t, v: (i, "sensor_reading", t, "a", "m", v, "NORMAL")
    for part in ([row(1, 100, 0.0)], [row(3, 101, 9.0)], [row(2, 10, 50.0)], [row(4, 200, 30.0)]):
        spark.createDataFrame(part, FIELDS).coalesce(1).write.mode("append").parquet(src)
    out = run(spark, st.deadband(stream(spark, src, "5 minutes"), 5.0, KEYS), tmp_path)
    assert sorted(r.event_id for r in out.collect()) == [1, 3]


def test_fresh_and_immediate(spark, source, tmp_path):
    path, batch = source
    s = stream(spark, path).withColumn("ingest_ts", F.col("event_ts") + F.expr("INTERVAL 1 MINUTE") * (F.col("event_id") % 10))
    rule = Rule("alert", "none", sources=(Source("sensor_reading"),), aggs=(Agg("value", "last"),), having=(Having("<", -20),))
    out = run(spark, sw.immediate(sw.fresh_only(s, "5 MINUTES"), rule), tmp_path)
    want = sorted((r.device_id, r.tick + 1, r.value) for r in batch.collect() if r.value < -20 and r.event_id % 10 <= 5)
    assert sorted((r.device_id, r.tick, r.value) for r in out.collect()) == want


def test_synthetic_feed_reaches_every_binding(spark):
    spec = "struct<family:string,params:map<string,double>,probability:double>"
    cdf = "struct<first:bigint,cdf:array<double>>"
    normal = F.struct(F.lit("NORMAL").alias("family"), F.create_map(F.lit("mean"), F.lit(5.0), F.lit("std_dev"), F.lit(1.0)).alias("params"), F.lit(1.0).alias("probability"))
    bound = spark.range(20).select(
        F.col("id").cast("string").alias("device_id"), F.lit("m").alias("measure_name"), normal.alias("normal"),
        F.lit(None).cast(spec).alias("above"), F.lit(None).cast(spec).alias("below"),
        *[F.lit(None).cast(cdf).alias(f"{t}_cdf") for t in ("normal", "above", "below")],
        F.lit(0.0).alias("range_min"), F.lit(10.0).alias("range_max"))
    ticks = spark.range(5).select(F.col("id").alias("tick"))
    out = readings_at(ticks, bound, 1, shards=4)
    assert out.select("device_id", "tick").distinct().count() == out.count() == 100
    timed = bound.withColumn("interval_ms", F.lit(120_000.0)).withColumn(
        "mode", F.when(F.col("device_id") == "0", "ON_CHANGE").otherwise("PERIODIC"))
    due = readings_at(ticks, timed, 1, shards=4)
    assert sorted(r.tick for r in due.where("device_id = '0'").collect()) == [0, 1, 2, 3, 4]
    assert sorted(r.tick for r in due.where("device_id = '1'").collect()) == [0, 2, 4]


@pytest.mark.parametrize("mode,limit", [("ON_CHANGE", 9.0), ("ON_THRESHOLD", 2.0)])
def test_hot_keys_in_batches(spark, tmp_path, mode, limit):
    from tickweave.streaming.hot_keys import delivered, thin_in_batches
    rng = random.Random(4)
    rows = [(i, "sensor_reading", i // 3, rng.choice("aaab"), "m", round(rng.gauss(0, 10), 2), "NORMAL") for i in range(400)]
    src = str(tmp_path / "src")
    for n in range(4):      # a key may be missing from a batch
        part = [r for r in rows[n * 100: n * 100 + 100] if n != 1 or r[3] == "a"]
        rng.shuffle(part)
        spark.createDataFrame(part, FIELDS).coalesce(1).write.mode("append").parquet(src)
    s = spark.readStream.schema(FIELDS).option("maxFilesPerTrigger", 1).parquet(src)
    q = thin_in_batches(s, mode, limit, str(tmp_path / "work"), KEYS, min_rows=20).trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted(r.event_id for r in delivered(spark, str(tmp_path / "work")).collect())
    op = deadband if mode == "ON_CHANGE" else crossing
    want = sorted(r.event_id for r in op(spark.read.schema(FIELDS).parquet(src), limit, keys=KEYS).collect())
    assert got == want and len(got) > 50


@pytest.mark.parametrize("mode", ["ON_CHANGE", "ON_THRESHOLD"])
def test_thinning_in_parts_equals_a_plain_fold(mode):
    rng = random.Random(9)
    value = [float("nan") if rng.random() < 0.1 else round(rng.gauss(0, 10), 1) for _ in range(900)]
    value[300:600] = [v / 100 for v in value[300:600]]      # a long stretch in which nothing is sent
    ok = [rng.random() > 0.2 for _ in value]
    want, last = [], None if mode == "ON_CHANGE" else 0.0
    for v, o in zip(value, ok):
        if mode == "ON_CHANGE":
            passes = v == v and (last is None or abs(v - last) >= 6.0)
        else:
            passes = v == v and (v >= 6.0) != (last >= 6.0)
        want.append(0 if not passes else 1 + o)
        if passes and o:
            last = v
    got, carried = [], None
    for s in (0, 1, 250, 640):
        e = {0: 1, 1: 250, 250: 640, 640: 900}[s]
        code, carried = st.thinned(np.array(value[s:e]), np.array(ok[s:e]), mode, 6.0, carried)
        got += code.tolist()
    assert got == want and {0, 1, 2} <= set(want)


def test_transmit_by_declared_mode(spark, source, tmp_path):
    path, batch = source
    st.configure(spark)
    profiles = lambda df: df.withColumn(
        "measure_name", F.concat("measure_name", (F.col("event_id") % 3).cast("string"))).withColumns({
            "mode": F.element_at(F.array(F.lit("PERIODIC"), F.lit("ON_CHANGE"), F.lit("ON_THRESHOLD")), (F.col("event_id") % 3 + 1).cast("int")),
            "interval_ms": F.lit(180_000.0), "threshold": F.lit(4.0), "failure": F.lit(0.2)})
    out = run(spark, st.transmit(profiles(stream(spark, path)), 60_000, 7), tmp_path)
    want = transmit(profiles(batch), 60_000, 7)
    rows = lambda df: sorted((r.event_id, r.mode, r.status) for r in df.collect() if r.tick < MARK)
    assert rows(out) == rows(want) and len({r[1:] for r in rows(want)}) == 8


def test_retention(spark, source, tmp_path):
    """A purge every 10 ticks takes out what is older than 20; state holds no more than these and the delay."""
    src, rows = source
    st.configure(spark)
    df = purged(stream(spark, src), ORIGIN, 60_000, 20, 10, spread=3)
    q = (df.writeStream.format("parquet").option("path", str(tmp_path / "out"))
         .option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start())
    q.awaitTermination()
    out = spark.read.schema(df.schema).parquet(str(tmp_path / "out"))
    got = {r.event_id: (r.tick, r.purged_at, r.value) for r in out.collect() if r.purged_at < MARK}
    at = lambda t: next(p for p in range(0, 400, 10) if p - t > 20)
    want = {r.event_id: (r.tick, at(r.tick), r.value) for r in rows.collect() if at(r.tick) < MARK}
    assert got == want and len(got) > 300
    assert out.count() == out.select("event_id").distinct().count()
    # what is stored at the end of the stream: nothing that was due before the watermark
    left = (spark.read.format("statestore").option("path", str(tmp_path / "state")).option("stateVarName", "stored")
            .load().count())
    assert 0 < left <= 3 * (20 + 10 + 25 + 10) and left + out.count() == rows.count()


def test_a_step_that_reads_few_readings_does_not_hold_back_the_watermark(spark, tmp_path):
    """Its filter must not slip below the watermark, or the last readings of the stream would not count."""
    src = str(tmp_path / "src")
    rows = [(i, "sensor_reading", t, "a", m, 30.0 * (i % 2), "NORMAL") for i, (t, m) in enumerate([(10, "m"), (90, "m"), (100, "n")])]
    spark.createDataFrame(rows, FIELDS).coalesce(1).write.parquet(src)
    s = stream(spark, src, "5 minutes").where("measure_name = 'm'")
    assert sorted(r.tick for r in run(spark, st.deadband(s, 5.0, KEYS), tmp_path).collect()) == [10, 90]


def test_many_keys_share_the_groups_of_the_state(spark, tmp_path):
    """A group per key would cost calls and frames for each; a missing value is not delivered."""
    from tickweave.streaming.buckets import BUCKETS
    st.configure(spark)
    n, src = 2 * BUCKETS, str(tmp_path / "src")
    rows = spark.range(2 * n).select(
        F.col("id").alias("event_id"), F.lit("sensor_reading").alias("event_type"), F.floor(F.col("id") / n * 50).cast("bigint").alias("tick"),
        (F.col("id") % n).cast("string").alias("device_id"), F.lit("m").alias("measure_name"),
        F.when(F.col("id") % 5 > 0, F.floor(F.col("id") / n) * 10.0).cast("double").alias("value"), F.lit("NORMAL").alias("tier"))
    rows.coalesce(1).write.parquet(src)
    got = sorted((r.device_id, r.event_id) for r in run(spark, st.deadband(stream(spark, src, "10 minutes"), 5.0, KEYS), tmp_path).collect())
    want = sorted((r.device_id, r.event_id) for r in deadband(rows, 5.0, keys=KEYS).collect() if r.tick < 99 - 10)
    assert got == want and len(got) > n
    held = spark.read.format("statestore").option("path", str(tmp_path / "state")).option("stateVarName", "held").load()
    assert 0 < held.count() <= BUCKETS
