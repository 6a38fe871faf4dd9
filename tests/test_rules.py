"""Rules: bounds, constraints, labels, chaining and merging on small inputs."""

import pytest
from pyspark.sql import functions as F

from tickweave.functions.scalars import compare
from tickweave.operators.aggregates import Agg
from tickweave.plans.rules import (
    Having, Rule, RuleSet, Source, bind_positional, count_by_kind, merge_events, row_rule, tumbling_rules,
)

FIELDS = "event_id long, event_type string, tick long, device_id string, measure_name string, value double"
MEAN = (Agg("value", "avg"),)
MOIST = Source("sensor_reading", "Moisture")


def readings(spark, rows):
    data = [(i, "sensor_reading", t, d, m, v) for i, (t, d, m, v) in enumerate(rows)]
    return spark.createDataFrame(data, FIELDS)


def test_constraint_is_on_the_mean(spark):
    df = readings(spark, [(0, "d", "Moisture", 10.0), (1, "d", "Moisture", 60.0),
                          (30, "d", "Moisture", 24.0), (31, "d", "Moisture", 26.0), (60, "d", "Moisture", 20.0)])
    rule = Rule("alert", "tumbling", 30, (MOIST,), (Agg("top", "max"), Agg("n", "count")), (Having("<", 25),),
                label="DROUGHT", fire_offset=31)
    out = tumbling_rules(df, [rule]).collect()
    # the first window's mean is 35 although one reading is low; the second's is 25, which is not below 25
    assert [(r.window_start, r.tick, r.value, r.aggregates["n"], r.rule_label) for r in out] == [(60, 91, 20.0, 1.0, "DROUGHT")]
    assert out[0].measure_name == out[0].triggered_by == out[0].event_type == "alert"
    at_most = Rule("alert", "tumbling", 30, (MOIST,), MEAN, (Having("<=", 25),))
    assert sorted(r.tick for r in tumbling_rules(df, [at_most]).collect()) == [60, 90]


@pytest.mark.parametrize("op,want", [("<", [1]), (">", [3]), ("<=", [1, 2]), (">=", [2, 3]), ("=", [2]), ("==", [2]), ("!=", [1, 3])])
def test_comparisons(spark, op, want):
    df = spark.createDataFrame([(1,), (2,), (3,)], "v int")
    assert [r.v for r in df.filter(compare(F.col("v"), op, 2)).orderBy("v").collect()] == want


def test_measure_filter_and_row_filter(spark):
    df = readings(spark, [(0, "d", "Moisture", 10.0), (1, "d", "AirTemp", 90.0), (2, "d", "Moisture", 50.0)])
    any_measure = Rule("a", "tumbling", 10, (Source("sensor_reading"),), MEAN)
    moisture = Rule("b", "tumbling", 10, (MOIST,), MEAN)
    low_rows = Rule("c", "tumbling", 10, (Source("sensor_reading", "Moisture", F.col("value") < 25),), MEAN)
    got = {r.event_type: r.value for r in tumbling_rules(df, [any_measure, moisture, low_rows]).collect()}
    assert got == {"a": 50.0, "b": 30.0, "c": 10.0}


def test_every_source_is_evaluated(spark):
    df = readings(spark, [(0, "d", "x", 1.0), (1, "d", "y", 3.0)])
    rule = Rule("a", "tumbling", 10, (Source("sensor_reading", "x"), Source("sensor_reading", "y")), MEAN)
    assert sorted(r.value for r in tumbling_rules(df, [rule]).collect()) == [1.0, 3.0]


def test_chain_and_complete_windows(spark):
    rows = [(t, "d", "Moisture", 10.0) for t in range(0, 125, 5)] + [(t, "e", "Moisture", 40.0) for t in range(0, 125, 5)]
    rules = (
        Rule("alert", "tumbling", 30, (MOIST,), MEAN, (Having("<", 25),), label="DROUGHT"),
        Rule("report", "tumbling", 60, (Source("alert", "DROUGHT"),), (), (Having("<", 25),), label="IRRIGATE"),
    )
    out = RuleSet(rules).run(readings(spark, rows)).collect()
    alerts = sorted((r.device_id, r.tick, r.value) for r in out if r.event_type == "alert")
    assert alerts == [("d", 30, 10.0), ("d", 60, 10.0), ("d", 90, 10.0), ("d", 120, 10.0)]
    reports = sorted((r.tick, r.value, r.rule_label) for r in out if r.event_type == "report")
    # the alert at tick 60 belongs to [60, 120); the one at 120 to a window that is still open
    assert reports == [(60, 0.0, "IRRIGATE"), (120, 0.0, "IRRIGATE")]


def test_chained_rule_sees_unrounded_values(spark):
    df = readings(spark, [(0, "d", "m", 1 / 3)])
    rules = (Rule("a", "tumbling", 10, (Source("sensor_reading"),), MEAN),
             Rule("b", "tumbling", 20, (Source("a"),), (Agg("value", "sum"),), (Having(">", 0.33333),)))
    out = {r.event_type: r.value for r in RuleSet(rules, complete_only=False).run(df).collect()}
    assert out == {"a": 0.3333, "b": 0.3333}


def test_plan_of_a_chain_is_linear_and_inner_alerts_come_out(spark):
    df = readings(spark, [(i * 10, "d", "m", 1.0) for i in range(60)]).repartition(2)
    scans = []
    for depth in (2, 4, 6):
        rules = [Rule("e0", "tumbling", 10, (Source("sensor_reading"),), label="L")]
        rules += [Rule(f"e{k}", "tumbling", 20, (Source(f"e{k - 1}"),), label="L") for k in range(1, depth)]
        out = RuleSet(tuple(rules), complete_only=False).run(df)
        scans.append(out._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD"))
        assert {r.event_type for r in out.collect()} == {f"e{k}" for k in range(depth)}
    assert scans == [2, 4, 6]


def test_windows_of_rows_and_landmark(spark):
    df = readings(spark, [(0, "d", "m", 1.0), (5, "d", "m", 3.0), (9, "d", "m", 8.0)])
    rows = row_rule(df, Rule("r", "rows", 2, (Source("sensor_reading"),), MEAN, fire_offset=1))
    assert sorted((r.tick, r.value) for r in rows.collect()) == [(1, 1.0), (6, 2.0), (10, 5.5)]
    mark = row_rule(df, Rule("l", "landmark", 0, (Source("sensor_reading"),), MEAN))
    assert sorted(r.value for r in mark.collect()) == [1.0, 2.0, 4.0]
    slide = row_rule(df, Rule("s", "sliding", 5, (Source("sensor_reading"),), MEAN, fire_offset=7))
    assert sorted((r.window_start, r.tick, r.value) for r in slide.collect()) == [(1, 8, 3.0), (5, 12, 5.5)]
    now = row_rule(df, Rule("n", "none", 0, (Source("sensor_reading"),), (Agg("value", "last"),), (Having("<", 3.5),), fire_offset=1))
    assert sorted((r.tick, r.value) for r in now.collect()) == [(1, 1.0), (6, 3.0)]


def test_merge_and_count(spark):
    df = readings(spark, [(0, "d", "m", 1.0), (5, "d", "m", 3.0)])
    derived = tumbling_rules(df, [Rule("a", "tumbling", 10, (Source("sensor_reading"),), MEAN)])
    assert {r.kind: r.n for r in count_by_kind(merge_events(df, derived)).collect()} == {"persistent": 2, "triggered": 1}


def test_grouping_by_more_keys_keeps_the_measure(spark):
    df = readings(spark, [(0, "d", "x", 1.0), (1, "d", "y", 3.0)])
    rule = Rule("a", "tumbling", 10, (Source("sensor_reading"),), MEAN, keys=("device_id", "measure_name"))
    assert sorted((r.measure_name, r.value) for r in tumbling_rules(df, [rule]).collect()) == [("x", 1.0), ("y", 3.0)]


def test_bad_rules():
    with pytest.raises(ValueError):
        Rule("a", "tumbling", 0, (Source("x"),))
    with pytest.raises(ValueError):
        Rule("a", "hopping", 5, (Source("x"),))
    with pytest.raises(ValueError):
        Having("~", 1)
    with pytest.raises(ValueError):
        RuleSet((Rule("a", "tumbling", 5, (Source("b"),)), Rule("b", "tumbling", 5, (Source("a"),)))).levels()


def test_positional_binding(spark):
    df = spark.createDataFrame([("d", "m", 2.0, 5)], "device_id string, kind string, value double, t int")
    out = bind_positional(df, ("dev", "_", "v"), df.columns)
    assert out.columns == ["dev", "v"] and tuple(out.first()) == ("d", 2.0)


def test_names_stand_for_each_sources_own_columns(spark):
    """In aggregates and constraints, over windows of all kinds."""
    df = readings(spark, [(0, "d", "Moisture", 1.0), (1, "d", "Moisture", 3.0), (2, "d", "Heat", 50.0)]).withColumn(
        "other", F.col("value") * 10)
    columns = ("device_id", "value", "other")
    sources = (Source("sensor_reading", "Moisture", bind=("_", "x", "y"), columns=columns),
               Source("sensor_reading", "Heat", bind=("_", "y", "x"), columns=columns))
    for window, size in (("tumbling", 10), ("rows", 2), ("landmark", 0), ("none", 0)):
        make = lambda limit: Rule("alert", window, size, sources, (Agg("x_max", "max", "x"), Agg("y_max", "max", "y")),
                                  (Having(">", 0, "y"), Having("<", limit, "x")))
        def got(limit):
            rows = (tumbling_rules(df, [make(limit)]) if window == "tumbling" else row_rule(df, make(limit))).collect()
            return sorted((r.aggregates["x_max"], r.aggregates["y_max"]) for r in rows)
        assert got(1000)[-2:] == [(3.0, 30.0), (500.0, 50.0)]
        assert (500.0, 50.0) not in got(100) and got(100)[-1] == (3.0, 30.0)


@pytest.mark.parametrize("bind,columns", [(("v", "v"), ("a", "b")), (("a", "b", "v"), ("a", "b")), (("a", "_"), ("a", "b"))])
def test_names_that_are_bound_twice_beyond_the_columns_or_not_at_all(bind, columns):
    with pytest.raises(ValueError):
        Rule("a", "tumbling", 5, (Source("s", bind=bind, columns=columns),), (Agg("x", "avg", "v"),))


def test_rule_over_readings_and_alerts(spark):
    df = readings(spark, [(0, "d", "Moisture", 10.0), (1, "d", "Moisture", 20.0), (61, "d", "Moisture", 90.0)])
    rules = RuleSet((
        Rule("alert", "tumbling", 30, (MOIST,), MEAN, (Having("<", 25),), label="DRY"),
        Rule("report", "tumbling", 60, (Source("alert", "DRY"), MOIST), (Agg("value", "count"),)),
    ))
    out = [r for r in rules.run(df).collect() if r.event_type == "report"]
    assert sorted(r.value for r in out) == [1.0, 2.0]       # one from the alert, one from the two readings


def test_window_without_values_does_not_fire(spark):
    df = readings(spark, [(0, "d", "Moisture", None), (1, "d", "Moisture", None)])
    rule = Rule("alert", "tumbling", 30, (MOIST,), MEAN, (Having("<", 25),))
    assert tumbling_rules(df, [rule]).count() == 0


def test_streams_read_files_and_folders_alike(spark, tmp_path):
    from tickweave.catalogue import QUERIES

    for parts in (1, 3):
        rows = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
        rows.repartition(parts).write.parquet(f"{tmp_path}/{parts}/events.parquet")
    count = lambda path: QUERIES["stream_fresh_only"](spark, path).count()
    assert count(f"{tmp_path}/1") == count(f"{tmp_path}/3") == count("/root/testdata/sf0.001") > 0
