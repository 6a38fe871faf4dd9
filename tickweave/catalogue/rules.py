"""Windowed rules over the event and line-item tables."""

from pyspark.sql import functions as F

from tickweave.catalogue.base import DAY, query, r4, readings, sql_r4, table, with_readings
from tickweave.operators.aggregates import Agg, result, states_for
from tickweave.operators.ordered import keep_last_n, keep_recent, rolling_rows
from tickweave.operators.specs import pack_measures, unpack_measures, value_columns
from tickweave.operators.windows import (
    cooccur_same_window, cooccur_within, landmark, last_tick, sliding_every_tick, sliding_time, tumbling,
)
from tickweave.plans.rules import (
    Having, Rule, RuleSet, Source, bind_positional, count_by_kind, merge_events, row_rule, tumbling_rules,
)

DEVICE_MEASURE = ("device_id", "measure_name")
MEAN = (Agg("mean_value", "avg"),)
ALL_AGGS = tuple(Agg(f"{f}_value", f) for f in ("avg", "min", "max", "sum", "count", "last"))

DAILY_HIGH = Rule("alert", "tumbling", DAY, (Source("sensor_reading"),), (Agg("value", "avg"),),
                  (Having(">", 50),), DEVICE_MEASURE, "HIGH_MEAN", DAY + 1)


@query(with_readings(f"""
  SELECT device_id, measure_name, 'alert' AS event_type, 'HIGH_MEAN' AS rule_label,
         tick // 1440 * 1440 + 1441 AS tick, tick // 1440 * 1440 AS window_start,
         tick // 1440 * 1440 + 1440 AS window_end, {sql_r4('avg(value)')} AS value
  FROM readings GROUP BY device_id, measure_name, tick // 1440 HAVING avg(value) > 50"""))
def tumbling_avg_alert(spark, sf_dir):
    out = tumbling_rules(readings(spark, sf_dir), [DAILY_HIGH], digits=None)
    return out.select("device_id", "measure_name", "event_type", "rule_label", "tick",
                      "window_start", "window_end", r4("value").alias("value"))


_ALL_SQL = f"""{sql_r4('avg(value)')} AS avg_value, min(value) AS min_value, max(value) AS max_value,
         {sql_r4('sum(value)')} AS sum_value, CAST(count(value) AS DOUBLE) AS count_value,
         arg_max(value, tick * 1000000000 + event_id) AS last_value"""


def _rounded(df, *rounded):
    return df.select(*[r4(c).alias(c) if c in rounded else c for c in df.columns])


@query(with_readings(f"""
  SELECT device_id, measure_name, tick // 1440 * 1440 AS window_start,
         tick // 1440 * 1440 + 1440 AS window_end, {_ALL_SQL}
  FROM readings GROUP BY device_id, measure_name, tick // 1440"""))
def tumbling_all_aggs(spark, sf_dir):
    out = tumbling(readings(spark, sf_dir), DAY, ALL_AGGS, DEVICE_MEASURE)
    return _rounded(out, "avg_value", "sum_value")


@query(with_readings(f"""
  SELECT device_id, (tick - 100) // 1000 * 1000 + 100 AS window_start,
         (tick - 100) // 1000 * 1000 + 1100 AS window_end, {sql_r4('avg(value)')} AS mean_value
  FROM readings WHERE tick >= 100
  GROUP BY device_id, (tick - 100) // 1000
  HAVING (tick - 100) // 1000 * 1000 + 1100 <= (SELECT max(tick) FROM readings)"""))
def tumbling_complete_only(spark, sf_dir):
    r = readings(spark, sf_dir)
    out = tumbling(r, 1000, MEAN, start=100, closed_at=last_tick(r), gated=True)
    return _rounded(out, "mean_value")


@query(with_readings(f"""
  SELECT device_id, event_id, tick, {sql_r4('m')} AS mean_value, lo AS min_value, hi AS max_value, n AS count_value
  FROM (SELECT *, avg(value) OVER w AS m, min(value) OVER w AS lo, max(value) OVER w AS hi,
               CAST(count(value) OVER w AS DOUBLE) AS n
        FROM readings WINDOW w AS (PARTITION BY device_id ORDER BY tick
                                   RANGE BETWEEN 1439 PRECEDING AND CURRENT ROW))
  WHERE tick >= 1440"""))
def sliding_time_avg(spark, sf_dir):
    aggs = (*MEAN, Agg("min_value", "min"), Agg("max_value", "max"), Agg("count_value", "count"))
    out = sliding_time(readings(spark, sf_dir), DAY, aggs)
    return out.select("device_id", "event_id", "tick", r4("mean_value").alias("mean_value"),
                      "min_value", "max_value", "count_value")


@query(with_readings(f"""
  SELECT DISTINCT device_id, tick, {sql_r4('m')} AS mean_value, {sql_r4('s')} AS sum_value
  FROM (SELECT device_id, tick, avg(value) OVER w AS m, sum(value) OVER w AS s
        FROM readings WINDOW w AS (PARTITION BY device_id ORDER BY tick
                                   RANGE BETWEEN 359 PRECEDING AND CURRENT ROW))
  WHERE tick >= 360"""))
def sliding_time_per_tick(spark, sf_dir):
    out = sliding_time(readings(spark, sf_dir), 360, (*MEAN, Agg("sum_value", "sum")), emit="tick")
    return _rounded(out, "mean_value", "sum_value")


@query(with_readings(f"""
  SELECT device_id, t AS tick, {sql_r4('avg(value)')} AS mean_value
  FROM (SELECT device_id, value, unnest(range((tick + 59) // 60 * 60, (tick + 59) // 60 * 60 + 360, 60)) AS t
        FROM readings)
  WHERE t >= 360 AND t <= (SELECT max(tick) FROM readings) GROUP BY device_id, t"""))
def sliding_every_hour(spark, sf_dir):
    r = readings(spark, sf_dir)
    out = sliding_every_tick(r, 360, MEAN, until=last_tick(r), slide=60)
    return _rounded(out, "mean_value")


@query(with_readings(f"""
  SELECT device_id, event_id, tick, {sql_r4('avg(value) OVER w')} AS mean_value,
         {sql_r4('sum(value) OVER w')} AS sum_value
  FROM readings WINDOW w AS (PARTITION BY device_id ORDER BY tick, event_id
                             ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)"""))
def sliding_rows_avg(spark, sf_dir):
    aggs = (*MEAN, Agg("sum_value", "sum"))
    out = rolling_rows(readings(spark, sf_dir), 6, {s.name: s.from_rows for s in states_for(aggs)})
    out = out.select("device_id", "event_id", "tick", *[result(a) for a in aggs])
    return _rounded(out, "mean_value", "sum_value")


@query(with_readings(f"""
  SELECT device_id, event_id, tick, {sql_r4('avg(value) OVER w')} AS mean_value,
         max(value) OVER w AS max_value
  FROM readings WINDOW w AS (PARTITION BY device_id ORDER BY tick
                             RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""))
def landmark_avg(spark, sf_dir):
    out = landmark(readings(spark, sf_dir), (*MEAN, Agg("max_value", "max")))
    return out.select("device_id", "event_id", "tick", r4("mean_value").alias("mean_value"), "max_value")


@query(with_readings("""
  SELECT device_id, 'alert' AS event_type, tick + 1 AS tick, value, 'LOW' AS rule_label
  FROM readings WHERE measure_name = 'error' AND value < 3"""))
def immediate_alert(spark, sf_dir):
    rule = Rule("alert", "none", sources=(Source("sensor_reading", "error"),), aggs=(Agg("value", "last"),),
                having=(Having("<", 3),), label="LOW", fire_offset=1)
    return row_rule(readings(spark, sf_dir), rule, digits=None).select(
        "device_id", "event_type", "tick", "value", "rule_label")


_CHAIN = RuleSet((
    Rule("alert", "tumbling", DAY, (Source("sensor_reading", "error"),), (Agg("value", "avg"),),
         (Having(">", 40),), label="ERRORS"),
    Rule("report", "tumbling", 7 * DAY, (Source("alert", "ERRORS"),), (Agg("n", "count"),),
         (Having(">", 60),), label="CHECK", fire_offset=7 * DAY + 1),
), digits=None)


@query(with_readings("""
  SELECT device_id, 'report' AS event_type, 'CHECK' AS rule_label, tick // 10080 * 10080 + 10081 AS tick,
         CAST(count(*) AS DOUBLE) AS value
  FROM alerts WHERE tick // 10080 * 10080 + 10080 <= (SELECT max(tick) FROM readings)
  GROUP BY device_id, tick // 10080 HAVING avg(v) > 60""", """
  alerts AS (SELECT device_id, tick // 1440 * 1440 + 1440 AS tick, avg(value) AS v FROM readings
             WHERE measure_name = 'error' AND tick // 1440 * 1440 + 1440 <= (SELECT max(tick) FROM readings)
             GROUP BY device_id, tick // 1440 HAVING avg(value) > 40)"""))
def chained_report(spark, sf_dir):
    return _CHAIN.run(readings(spark, sf_dir)).filter("event_type = 'report'").select(
        "device_id", "event_type", "rule_label", "tick", "value")


_SEVERAL = RuleSet((
    Rule("alert", "tumbling", DAY, (Source("sensor_reading", "error"), Source("sensor_reading", "click")),
         (Agg("value", "max"), Agg("n", "count")), (Having("<", 20),), label="QUIET"),
    Rule("alert", "tumbling", DAY, (Source("sensor_reading", "view"),), (Agg("value", "avg"),),
         (Having(">=", 100),), label="BUSY"),
    Rule("metric_avg", "sliding", DAY, (Source("sensor_reading", "purchase"),), (Agg("value", "avg"),),
         label="PURCHASE"),
), complete_only=False, digits=None)

_SEVERAL_SQL = (f"""
  fired AS (
    SELECT device_id, 'alert' AS event_type, 'QUIET' AS rule_label, tick // 1440 * 1440 + 1440 AS tick,
           {sql_r4('max(value)')} AS value
    FROM readings WHERE measure_name IN ('error', 'click')
    GROUP BY device_id, measure_name, tick // 1440 HAVING avg(value) < 20
    UNION ALL
    SELECT device_id, 'alert', 'BUSY', tick // 1440 * 1440 + 1440, {sql_r4('avg(value)')}
    FROM readings WHERE measure_name = 'view' GROUP BY device_id, tick // 1440 HAVING avg(value) >= 100
    UNION ALL
    SELECT device_id, 'metric_avg', 'PURCHASE', tick + 1, {sql_r4('m')}
    FROM (SELECT device_id, tick, avg(value) OVER (PARTITION BY device_id ORDER BY tick
                 RANGE BETWEEN 1439 PRECEDING AND CURRENT ROW) AS m
          FROM readings WHERE measure_name = 'purchase') WHERE tick >= 1440)""")


@query(with_readings("SELECT * FROM fired", _SEVERAL_SQL))
def multi_rule_union(spark, sf_dir):
    return _SEVERAL.run(readings(spark, sf_dir)).select(
        "device_id", "event_type", "rule_label", "tick", r4("value").alias("value"))


@query(with_readings("""
  SELECT 'triggered' AS kind, count(*) AS n FROM fired
  UNION ALL SELECT 'persistent', count(*) FROM readings""", _SEVERAL_SQL))
def persistent_vs_triggered(spark, sf_dir):
    r = readings(spark, sf_dir)
    return count_by_kind(merge_events(r, _SEVERAL.run(r)))


@query(with_readings("""
  SELECT device_id, 'report' AS event_type, 'report' AS measure_name, 'SEEN' AS rule_label,
         tick // 1440 * 1440 + 1440 AS tick, CAST(0.0 AS DOUBLE) AS value
  FROM readings WHERE measure_name = 'signup' GROUP BY device_id, tick // 1440"""))
def literal_group_label(spark, sf_dir):
    rule = Rule("report", "tumbling", DAY, (Source("sensor_reading", "signup"),), label="SEEN")
    return tumbling_rules(readings(spark, sf_dir), [rule]).select(
        "device_id", "event_type", "measure_name", "rule_label", "tick", "value")


_POSITIONS = ("error", "view", "click", "purchase", "signup")
_COLUMNS = value_columns(len(_POSITIONS))
_PACKED_SQL = """packed AS (
  SELECT device_id, tick,
         arg_max(value, event_id) FILTER (WHERE measure_name = 'error') AS value,
         arg_max(value, event_id) FILTER (WHERE measure_name = 'view') AS value2,
         arg_max(value, event_id) FILTER (WHERE measure_name = 'click') AS value3,
         arg_max(value, event_id) FILTER (WHERE measure_name = 'purchase') AS value4,
         arg_max(value, event_id) FILTER (WHERE measure_name = 'signup') AS value5
  FROM readings GROUP BY device_id, tick)"""


def _packed(spark, sf_dir):
    names = F.array(*[F.lit(p) for p in _POSITIONS])
    place = F.array_position(names, F.col("measure_name")) - 1
    return pack_measures(readings(spark, sf_dir).withColumn("position", place), columns=_COLUMNS)


@query(with_readings("SELECT * FROM packed", _PACKED_SQL))
def packed_measures(spark, sf_dir):
    return _packed(spark, sf_dir)


@query(with_readings("""
  SELECT device_id, tick, 0 AS position, value FROM packed WHERE value IS NOT NULL
  UNION ALL SELECT device_id, tick, 1, value2 FROM packed WHERE value2 IS NOT NULL
  UNION ALL SELECT device_id, tick, 2, value3 FROM packed WHERE value3 IS NOT NULL
  UNION ALL SELECT device_id, tick, 3, value4 FROM packed WHERE value4 IS NOT NULL
  UNION ALL SELECT device_id, tick, 4, value5 FROM packed WHERE value5 IS NOT NULL""", _PACKED_SQL))
def unpacked_measures(spark, sf_dir):
    return unpack_measures(_packed(spark, sf_dir), columns=_COLUMNS)


@query(with_readings(f"""
  SELECT device_id, tick // 1440 * 1440 AS window_start,
         coalesce({sql_r4('avg(value2)')}, 0) AS avg2, coalesce(max(value3), 0) AS max3,
         CAST(count(value3) AS DOUBLE) AS n3
  FROM packed GROUP BY device_id, tick // 1440""", _PACKED_SQL))
def value2_aggs(spark, sf_dir):
    packed = _packed(spark, sf_dir).withColumn("event_id", F.lit(0).cast("bigint"))
    aggs = (Agg("avg2", "avg", "value2"), Agg("max3", "max", "value3"), Agg("n3", "count", "value3"))
    out = tumbling(packed, DAY, aggs)
    # an aggregate over no values is 0, which the nudge must not turn into 0.0000001
    return out.select("device_id", "window_start", r4("avg2").alias("avg2"), "max3", "n3")


@query(with_readings("""
  SELECT device_id, tick AS t, value AS v FROM readings"""))
def positional_binding(spark, sf_dir):
    columns = ("device_id", "measure_name", "value", "tick")
    return bind_positional(readings(spark, sf_dir), ("device_id", "_", "v", "t"), columns)


@query(with_readings("""
  SELECT device_id, tick // 1440 * 1440 AS window_start, tick // 1440 * 1440 + 1440 AS window_end,
         count(*) FILTER (WHERE measure_name = 'error' AND value > 20) AS n_first,
         count(*) FILTER (WHERE measure_name = 'view' AND value > 20) AS n_second
  FROM readings GROUP BY device_id, tick // 1440
  HAVING count(*) FILTER (WHERE measure_name = 'error' AND value > 20) > 0
     AND count(*) FILTER (WHERE measure_name = 'view' AND value > 20) > 0"""))
def cooccur_daily(spark, sf_dir):
    high = F.col("value") > 20
    return cooccur_same_window(readings(spark, sf_dir), DAY,
                               (F.col("measure_name") == "error") & high,
                               (F.col("measure_name") == "view") & high)


@query(with_readings("""
  SELECT l.device_id, l.event_id, l.tick, count(*) AS n_matches, min(r.tick) AS first_match,
         max(r.tick) AS last_match
  FROM readings l JOIN readings r ON r.device_id = l.device_id AND r.tick BETWEEN l.tick - 600 AND l.tick + 600
  WHERE l.measure_name = 'error' AND r.measure_name = 'view' GROUP BY l.device_id, l.event_id, l.tick"""))
def cooccur_within_10h(spark, sf_dir):
    r = readings(spark, sf_dir)
    out = cooccur_within(r.filter("measure_name = 'error'"), r.filter("measure_name = 'view'"), 600)
    return out.select("device_id", "event_id", "tick", "n_matches", "first_match", "last_match")


@query(with_readings("""
  SELECT device_id, measure_name, event_id, tick, value FROM readings
  QUALIFY row_number() OVER (PARTITION BY measure_name, device_id ORDER BY tick DESC, event_id DESC) <= 5"""))
def keep_last_5(spark, sf_dir):
    return keep_last_n(readings(spark, sf_dir), 5, ("measure_name", "device_id")).select(
        "device_id", "measure_name", "event_id", "tick", "value")


@query(with_readings("""
  SELECT event_id, device_id, tick, value FROM readings
  WHERE (SELECT max(tick) FROM readings) - tick <= 5000"""))
def retention(spark, sf_dir):
    r = readings(spark, sf_dir)
    return keep_recent(r, 5000, last_tick(r)).select("event_id", "device_id", "tick", "value")


@query(f"""
  SELECT l_suppkey, CAST(floor(epoch(l_shipdate) / 86400) AS BIGINT) // 30 * 30 AS window_start,
         {sql_r4('avg(l_quantity)')} AS mean_quantity, {sql_r4('max(l_quantity)')} AS max_quantity,
         CAST(count(l_quantity) AS DOUBLE) AS n
  FROM lineitem GROUP BY ALL HAVING avg(l_quantity) > 25""")
def tumbling_lineitem(spark, sf_dir):
    days = table(spark, sf_dir, "lineitem").select(
        "l_suppkey", "l_quantity",
        F.floor(F.unix_seconds(F.col("l_shipdate").cast("timestamp")) / 86400).cast("bigint").alias("tick"),
        F.lit(0).alias("event_id"),
    )
    aggs = (Agg("mean_quantity", "avg", "l_quantity"), Agg("max_quantity", "max", "l_quantity"),
            Agg("n", "count", "l_quantity"))
    out = tumbling(days, 30, aggs, ("l_suppkey",)).filter("mean_quantity > 25")
    return out.select("l_suppkey", "window_start", r4("mean_quantity").alias("mean_quantity"),
                      r4("max_quantity").alias("max_quantity"), "n")
