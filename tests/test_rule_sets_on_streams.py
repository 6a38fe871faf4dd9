"""A rule set on a stream in several out-of-order micro-batches gives what it gives in batch."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickweave.operators.aggregates import Agg
from tickweave.plans.rules import Having, Rule, RuleSet, Source
from tickweave.streaming import transmission as st
from tickweave.streaming import windows as sw
from tickweave.streaming.rule_sets import Clock, check_order, running, stream_rules

FIELDS = "event_id long, event_type string, tick long, device_id string, measure_name string, value double, value2 double"
ORIGIN = 1704067200
DELAY = 25
ALL = tuple(Agg(f, f) for f in ("avg", "sum", "count", "min", "max", "last"))


@pytest.fixture(scope="module")
def source(spark, tmp_path_factory):
    rng = random.Random(3)
    value = lambda: None if rng.random() < 0.1 else round(rng.gauss(0, 10), 2)
    rows = [(i, "sensor_reading", i // 3, rng.choice("aab"), rng.choice("mn"), value(), value()) for i in range(600)]
    path = str(tmp_path_factory.mktemp("stream"))
    files = [[] for _ in range(4)]
    for r in rows:
        files[min(3, max(0, (r[2] + rng.randrange(-10, 11)) // 50))].append(r)
    for part in files:
        rng.shuffle(part)
        spark.createDataFrame(part, FIELDS).coalesce(1).write.mode("append").parquet(path)
    return path, spark.createDataFrame(rows, FIELDS)


def both(spark, source, tmp_path, rules, heads=None, start=0):
    """(rows of the stream, rows of the batch whose event is certainly behind the watermark)."""
    path, batch = source
    st.configure(spark)
    raw = spark.readStream.schema(FIELDS).option("maxFilesPerTrigger", 1).parquet(path)
    rules = RuleSet(rules, start, digits=None)
    out = stream_rules(rules, sw.with_event_time(raw, f"{DELAY} minutes", ORIGIN), Clock(ORIGIN), heads)
    q = (out.writeStream.format("parquet").option("path", str(tmp_path / "out"))
         .option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start())
    q.awaitTermination()
    columns = ["event_type", "device_id", "measure_name", "tick", "value", "rule_label", "window_start", "window_end", "aggregates"]
    plain = lambda x: None if x is None else round(x + 1e-7, 4) + 0.0
    # a window is closed once the watermark has reached its end; a reading's tick counts as its window's end
    rows = lambda df: sorted((tuple(
        {k: plain(v) for k, v in sorted(x.items())} if isinstance(x, dict) else plain(x) if isinstance(x, float) else x
        for x in r) for r in df.select(*columns).where(F.col("window_end") <= 199 - DELAY).collect()), key=repr)
    return rows(spark.read.schema(out.schema).parquet(str(tmp_path / "out"))), rows(
        rules.run(batch) if heads is None else rules.run(batch).where(F.col("event_type").isin(*heads)))


@pytest.mark.parametrize("window,size", [("sliding", 7), ("rows", 5), ("landmark", 0), ("none", 0), ("tumbling", 10)])
def test_each_window(spark, source, tmp_path, window, size):
    keys = ("device_id",) if window != "rows" else ("device_id", "measure_name")
    rule = Rule("alert", window, size, (Source("sensor_reading", "m"), Source("sensor_reading", where=F.col("value") > 2)),
                (*ALL, Agg("other", "avg", "value2")), (Having(">", -1),), keys, "X")
    got, want = both(spark, source, tmp_path, (rule,), start=3)
    assert got == want and len(got) > 10


def test_two_chained_levels_and_a_mixed_source(spark, source, tmp_path):
    alert = Rule("alert", "tumbling", 10, (Source("sensor_reading"),), (Agg("value", "avg"),), (Having(">", -2),), label="X", fire_offset=11)
    report = Rule("report", "tumbling", 30, (Source("alert", "X"),), (Agg("value", "count"), Agg("mean", "avg")), label="Y")
    mixed = Rule("mixed", "tumbling", 30, (Source("alert"), Source("sensor_reading", "m")), (Agg("value", "max"), Agg("n", "count")))
    last = Rule("last", "rows", 2, (Source("report", "Y"),), (Agg("value", "sum"),))
    got, want = both(spark, source, tmp_path, (last, mixed, report, alert))
    assert got == want and {r[0] for r in got} == {"alert", "report", "mixed", "last"}


def test_chosen_heads(spark, source, tmp_path):
    near = Rule("near", "sliding", 5, (Source("sensor_reading", "m"),), (Agg("value", "avg"),), (Having(">", 0),))
    many = Rule("many", "tumbling", 20, (Source("near"),), (Agg("value", "count"),), (Having(">", 1),))
    unread = Rule("unread", "landmark", 0, (Source("sensor_reading"),), (Agg("value", "count"),))
    got, want = both(spark, source, tmp_path, (near, many, unread), ("many",))
    assert got == want and {r[0] for r in got} == {"many"}


def test_a_head_that_is_read_must_not_fire_early():
    reader = Rule("b", "none", 0, (Source("a"),))
    check_order((Rule("a", "tumbling", 10, (Source("x"),), fire_offset=3),))
    with pytest.raises(ValueError):
        check_order((Rule("a", "tumbling", 10, (Source("x"),), fire_offset=3), reader))
    check_order((Rule("a", "tumbling", 10, (Source("x"),), fire_offset=10), reader))


def test_running_aggregates():
    rng = np.random.default_rng(0)
    block, values = np.repeat(np.arange(9), rng.integers(1, 40, 9)), None
    values = rng.normal(size=len(block))
    for op in (np.add, np.minimum, np.maximum):
        want = np.concatenate([op.accumulate(values[block == b]) for b in range(9)])
        assert np.allclose(running(values, block, op), want)
