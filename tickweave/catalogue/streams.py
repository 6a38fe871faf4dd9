"""The streaming twins, run to the end of the event table with ``availableNow``.

Each writes to a file sink in the shared folder and returns what was written. A
stream's windows close when the watermark passes their end, so the SQL keeps the
windows that end at least the watermark's delay before the last event.
"""

from pyspark.sql import DataFrame, functions as F

from tickweave.catalogue.base import (
    DAY, ORIGIN_S, SEED, query, r4, readings as batch_readings, sql_r4, table, uniform_sql, with_readings,
)
from tickweave.catalogue.conformance import _bindings, _declared, _flat, judged_sql
from tickweave.catalogue.storage import shared_folder
from tickweave.operators.aggregates import Agg
from tickweave.operators.incremental import verdicts
from tickweave.operators.transmit import drop_counts, lossy, transmit as batch_transmit
from tickweave.operators.windows import last_tick
from tickweave.plans.rules import Having, Rule, RuleSet, Source
from tickweave.sources.tables import events_as_readings
from tickweave.streaming import transmission as st
from tickweave.streaming import windows as sw
from tickweave.streaming.conformance import keep_summaries, kept_summaries, stretches
from tickweave.streaming.retention import purged
from tickweave.streaming.rule_sets import Clock, stream_rules

DELAY_MINUTES = 5
# the last tick that is certainly behind the watermark at the end of the input
_MARK = f"(SELECT max(tick) - {DELAY_MINUTES} FROM readings)"
_MEAN = (Agg("value", "avg"),)


def _stream(spark, sf_dir) -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    events = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*")       # one file, or a folder of files
    tier = F.when(F.col("value") >= 100, "ABOVE").when(F.col("value") < 5, "BELOW").otherwise("NORMAL")
    ticks = events_as_readings(events, ORIGIN_S).withColumn("tier", tier)
    return sw.with_event_time(ticks, f"{DELAY_MINUTES} minutes", ORIGIN_S)


def _run(df: DataFrame, name: str) -> DataFrame:
    spark = df.sparkSession
    folder = shared_folder(spark, name)
    q = (df.writeStream.format("parquet").option("path", f"{folder}/out")
         .option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{folder}/out")


def _tick(ts) -> F.col:
    return (F.unix_seconds(ts) - ORIGIN_S).cast("bigint") / 60


@query(with_readings(f"""
  SELECT device_id, measure_name, tick // 1440 * 1440 AS window_start, {sql_r4('avg(value)')} AS value,
         CAST(count(*) AS DOUBLE) AS n
  FROM readings GROUP BY device_id, measure_name, tick // 1440
  HAVING tick // 1440 * 1440 + 1440 <= {_MARK}"""))
def stream_tumbling(spark, sf_dir):
    out = sw.windowed(_stream(spark, sf_dir), "1 day", (*_MEAN, Agg("n", "count")), ("device_id", "measure_name"))
    return _run(out, "tumbling").select(
        "device_id", "measure_name", _tick(F.col("window.start")).cast("bigint").alias("window_start"),
        r4("value").alias("value"), "n")


@query(with_readings(f"""
  SELECT device_id, w AS window_start, {sql_r4('avg(value)')} AS value
  FROM (SELECT device_id, value, unnest(range(tick // 720 * 720 - 720, tick // 720 * 720 + 1, 720)) AS w FROM readings)
  GROUP BY device_id, w HAVING w + 1440 <= {_MARK}"""))
def stream_sliding(spark, sf_dir):
    out = sw.windowed(_stream(spark, sf_dir), "1 day", _MEAN, slide="12 hours")
    return _run(out, "sliding").select(
        "device_id", _tick(F.col("window.start")).cast("bigint").alias("window_start"), r4("value").alias("value"))


@query(with_readings("""
  SELECT device_id, tick + 1 AS tick, value, 'LOW' AS rule_label FROM readings
  WHERE measure_name = 'error' AND value < 3"""))
def stream_immediate(spark, sf_dir):
    rule = Rule("alert", "none", sources=(Source("sensor_reading", "error"),), aggs=(Agg("value", "last"),),
                having=(Having("<", 3),), label="LOW")
    return _run(sw.immediate(_stream(spark, sf_dir), rule), "immediate").select("device_id", "tick", "value", "rule_label")


@query(with_readings(f"""
  SELECT device_id, week * 10080 AS window_start, CAST(count(*) AS DOUBLE) AS n
  FROM (SELECT device_id, tick // 1440 // 7 AS week, avg(value) AS v FROM readings
        WHERE measure_name = 'error' GROUP BY device_id, tick // 1440 HAVING avg(value) > 40)
  GROUP BY device_id, week HAVING avg(v) > 60 AND week * 10080 + 10080 <= {_MARK}"""))
def stream_chained(spark, sf_dir):
    alert = Rule("alert", "tumbling", DAY, (Source("sensor_reading", "error"),), _MEAN, (Having(">", 40),), label="ERRORS")
    report = Rule("report", "tumbling", 7 * DAY, (Source("alert", "ERRORS"),), (Agg("value", "count"),), (Having(">", 60),))
    alerts = sw.as_source(sw.tumbling_rule(_stream(spark, sf_dir), alert, origin_s=ORIGIN_S))
    reports = sw.tumbling_rule(alerts, report, origin_s=ORIGIN_S)
    return _run(reports, "chained").select(
        "device_id", _tick(F.col("window.start")).cast("bigint").alias("window_start"), F.col("value").alias("n"))


@query(with_readings(f"""
  SELECT device_id, {sql_r4('avg(value)')} AS mean_value, max(value) AS max_value FROM readings GROUP BY device_id"""))
def stream_landmark(spark, sf_dir):
    """Written in complete mode by each micro-batch; the last one is the result."""
    out = sw.landmark_running(_stream(spark, sf_dir), (Agg("mean_value", "avg"), Agg("max_value", "max")))
    folder = shared_folder(spark, "landmark")
    q = (out.writeStream.outputMode("complete").trigger(availableNow=True)
         .option("checkpointLocation", f"{folder}/state")
         .foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{folder}/out")).start())
    q.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{folder}/out").select(
        "device_id", r4("mean_value").alias("mean_value"), "max_value")


@query(with_readings(f"""
  SELECT device_id, tick // 1440 * 1440 AS window_start,
         count(*) FILTER (WHERE measure_name = 'error') AS n_first, count(*) FILTER (WHERE measure_name = 'view') AS n_second
  FROM readings GROUP BY device_id, tick // 1440
  HAVING count(*) FILTER (WHERE measure_name = 'error') > 0 AND count(*) FILTER (WHERE measure_name = 'view') > 0
     AND tick // 1440 * 1440 + 1440 <= {_MARK}"""))
def stream_cooccur_daily(spark, sf_dir):
    out = sw.cooccur_same_window(_stream(spark, sf_dir), "1 day", F.col("measure_name") == "error",
                                 F.col("measure_name") == "view")
    return _run(out, "cooccur").select(
        "device_id", _tick(F.col("window.start")).cast("bigint").alias("window_start"), "n_first", "n_second")


@query(with_readings("""
  SELECT device_id, event_id, tick FROM readings l
  WHERE measure_name = 'error' AND EXISTS (
    SELECT 1 FROM readings r WHERE r.measure_name = 'view' AND r.device_id = l.device_id
       AND r.tick BETWEEN l.tick - 600 AND l.tick + 600)"""))
def stream_cooccur_within(spark, sf_dir):
    s = _stream(spark, sf_dir)
    out = sw.cooccur_within(s.filter("measure_name = 'error'"), s.filter("measure_name = 'view'"), "600 MINUTES")
    return _run(out, "cooccur-within").select("device_id", "event_id", "tick")


@query(with_readings(f"""
  SELECT event_id, device_id, tick FROM readings
  WHERE {uniform_sql("device_id, measure_name, CAST(tick AS VARCHAR), CAST(event_id AS VARCHAR)", "loss")} >= 0.1"""))
def stream_lossy(spark, sf_dir):
    return _run(lossy(_stream(spark, sf_dir), 0.1, SEED), "lossy").select("event_id", "device_id", "tick")


@query(with_readings("SELECT event_id, device_id, tick FROM readings WHERE event_id % 600 <= 300"))
def stream_fresh_only(spark, sf_dir):
    late = F.make_dt_interval(secs=(F.col("event_id") % 600).cast("decimal(18,6)"))
    s = _stream(spark, sf_dir).withColumn("ingest_ts", F.col("event_ts") + late)
    return _run(sw.fresh_only(s, "5 MINUTES"), "fresh").select("event_id", "device_id", "tick")


@query(with_readings(f"""
  SELECT device_id, event_id, tick, value FROM (
    SELECT *, lag(value >= 50, 1, false) OVER (PARTITION BY device_id ORDER BY tick, event_id) AS before
    FROM readings) WHERE (value >= 50) <> before AND tick < {_MARK}"""))
def stream_crossing(spark, sf_dir):
    st.configure(spark)
    return _run(st.crossing(_stream(spark, sf_dir), 50.0, ("device_id",)), "crossing").select(
        "device_id", "event_id", "tick", "value")


@query(f"""
  WITH RECURSIVE {with_readings('')[5:]}, numbered AS (
    SELECT *, row_number() OVER (PARTITION BY device_id ORDER BY tick, event_id) AS rn FROM readings),
  fold AS (
    SELECT device_id, event_id, tick, value, rn, true AS sent, value AS last FROM numbered WHERE rn = 1
    UNION ALL
    SELECT n.device_id, n.event_id, n.tick, n.value, n.rn, abs(n.value - f.last) >= 20,
           CASE WHEN abs(n.value - f.last) >= 20 THEN n.value ELSE f.last END
    FROM numbered n JOIN fold f ON n.device_id = f.device_id AND n.rn = f.rn + 1)
  SELECT device_id, event_id, tick, value FROM fold WHERE sent AND tick < {_MARK}""")
def stream_deadband(spark, sf_dir):
    st.configure(spark)
    return _run(st.deadband(_stream(spark, sf_dir), 20.0, ("device_id",)), "deadband").select(
        "device_id", "event_id", "tick", "value")


@query(with_readings(f"""
  SELECT device_id, event_id, tick, {sql_r4('m')} AS mean_value FROM (
    SELECT *, avg(value) OVER (PARTITION BY device_id ORDER BY tick, event_id ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS m
    FROM readings) WHERE tick < {_MARK}"""))
def stream_rolling_rows(spark, sf_dir):
    st.configure(spark)
    return _run(st.rolling_rows_mean(_stream(spark, sf_dir), 6, ("device_id",)), "rolling").select(
        "device_id", "event_id", "tick", r4("mean_value").alias("mean_value"))


@query(with_readings(f"""
  SELECT device_id, measure_name, tick, event_id, before AS from_tier, tier AS to_tier
  FROM (SELECT *, lag(tier, 1, 'NORMAL') OVER (PARTITION BY device_id, measure_name ORDER BY tick, event_id) AS before
        FROM readings) WHERE tier <> before AND tick < {_MARK}"""))
def stream_transitions(spark, sf_dir):
    st.configure(spark)
    return _run(st.transitions(_stream(spark, sf_dir)), "transitions").select(
        "device_id", "measure_name", "tick", "event_id", "from_tier", "to_tier")


# rule sets: the same Rule objects in batch and on the stream

HIGH_DAYS = Rule("alert", "tumbling", DAY, (Source("sensor_reading"),), (Agg("value", "avg"), Agg("n", "count")), (Having(">", 50),),
                 label="HIGH", fire_offset=DAY + 1)
HIGH_WEEKS = Rule("report", "tumbling", 7 * DAY, (Source("alert", "HIGH"),), (Agg("value", "count"),), label="WEEK")
TOGETHER = Rule("summary", "tumbling", 7 * DAY, (Source("alert", "HIGH"), Source("sensor_reading", "error")), (Agg("value", "max"),))
LAST_WEEKS = Rule("trend", "rows", 2, (Source("report", "WEEK"),), (Agg("value", "sum"),))
CHAIN = RuleSet((HIGH_DAYS, HIGH_WEEKS, TOGETHER, LAST_WEEKS), digits=None)

_CHAIN_SQL = """
  alert AS (SELECT device_id, tick // 1440 * 1440 AS s, avg(value) AS v FROM readings GROUP BY ALL HAVING avg(value) > 50),
  weeks AS (SELECT device_id, (s + 1441) // 10080 * 10080 AS s, v FROM alert),
  report AS (SELECT device_id, s, CAST(count(*) AS DOUBLE) AS v FROM weeks GROUP BY device_id, s),
  summary AS (
    SELECT device_id, s, max(v) AS v FROM weeks GROUP BY device_id, s
    UNION ALL SELECT device_id, tick // 10080 * 10080, max(value) FROM readings WHERE measure_name = 'error' GROUP BY ALL),
  trend AS (
    SELECT device_id, s + 10080 AS s, sum(v) OVER (PARTITION BY device_id ORDER BY s ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS v
    FROM report),
  chained AS (
    SELECT device_id, 'alert' AS event_type, s + 1441 AS tick, s + 1440 AS window_end, v FROM alert
    UNION ALL SELECT device_id, 'report', s + 10080, s + 10080, v FROM report
    UNION ALL SELECT device_id, 'summary', s + 10080, s + 10080, v FROM summary
    UNION ALL SELECT device_id, 'trend', s + 1, s + 1, v FROM trend)"""
_CHAIN_COLUMNS = ("device_id", "event_type", "tick", "window_end")


def _chain_sql(behind: str) -> str:
    return with_readings(f"SELECT device_id, event_type, tick, window_end, {sql_r4('v')} AS value FROM chained WHERE {behind}",
                         _CHAIN_SQL)


@query(_chain_sql("event_type = 'trend' AND window_end <= (SELECT max(tick) FROM readings) + 1 OR window_end <= (SELECT max(tick) FROM readings)"))
def rules_mixed_sources(spark, sf_dir):
    """Four rules in three levels, one of which reads alerts and readings together."""
    out = CHAIN.run(batch_readings(spark, sf_dir))
    return out.select(*_CHAIN_COLUMNS, r4("value").alias("value"))


@query(_chain_sql(f"window_end <= {_MARK}"))
def stream_rule_set(spark, sf_dir):
    """The same rule set on the stream."""
    st.configure(spark)
    out = _run(stream_rules(CHAIN, _stream(spark, sf_dir), Clock(ORIGIN_S)), "rule-set")
    # what became due before the last watermark: a window's end, or a reading's tick, is not behind the mark
    out = out.where(F.col("window_end") <= last_tick(batch_readings(spark, sf_dir)) - DELAY_MINUTES)
    return out.select(*_CHAIN_COLUMNS, r4("value").alias("value"))


# one rule whose sources bind its names to different columns

_POSITIONS = ("device_id", "value", "hour")
BOUND = RuleSet((Rule(
    "report", "tumbling", DAY,
    (Source("sensor_reading", "error", bind=("_", "v", "h"), columns=_POSITIONS),
     Source("sensor_reading", "view", bind=("_", "h", "v"), columns=_POSITIONS)),
    (Agg("value", "avg", "v"), Agg("high", "max", "h")), (Having(">", 10, "v"), Having("<", 30, "h"))),), digits=None)


def _bound_sql(mark: str) -> str:
    return with_readings(f"""
  SELECT device_id, s AS window_start, {sql_r4('avg(v)')} AS value, max(h) AS high
  FROM (SELECT device_id, measure_name, tick // 1440 * 1440 AS s,
               CASE measure_name WHEN 'error' THEN value ELSE CAST(tick % 1440 // 60 AS DOUBLE) END AS v,
               CASE measure_name WHEN 'error' THEN CAST(tick % 1440 // 60 AS DOUBLE) ELSE value END AS h
        FROM readings WHERE measure_name IN ('error', 'view'))
  WHERE s + 1440 <= {mark}
  GROUP BY device_id, measure_name, s HAVING avg(v) > 10 AND avg(h) < 30""")


def _with_hour(df: DataFrame) -> DataFrame:
    return df.withColumn("hour", F.floor(F.col("tick") % DAY / 60).cast("double"))


def _bound_columns(events: DataFrame) -> DataFrame:
    return events.select("device_id", "window_start", r4("value").alias("value"), F.col("aggregates")["high"].alias("high"))


@query(_bound_sql("(SELECT max(tick) FROM readings)"))
def rules_bound_names(spark, sf_dir):
    return _bound_columns(BOUND.run(_with_hour(batch_readings(spark, sf_dir))))


@query(_bound_sql(_MARK))
def stream_bound_names(spark, sf_dir):
    out = _run(stream_rules(BOUND, _with_hour(_stream(spark, sf_dir)), Clock(ORIGIN_S)), "bound-names")
    return _bound_columns(out)


_ROW_AGGS = (Agg("value", "avg"), Agg("low", "min"), Agg("high", "max"), Agg("n", "count"), Agg("latest", "last"))
SLIDING = Rule("level", "sliding", DAY, (Source("sensor_reading"),), _ROW_AGGS, (Having(">", 20),))
LAST_N = Rule("level", "rows", 6, (Source("sensor_reading"),), _ROW_AGGS, (Having(">", 20),))
LANDMARK = Rule("level", "landmark", 0, (Source("sensor_reading"),), _ROW_AGGS, (Having(">", 20),))


def _row_sql(order: str, frame: str, where: str = "true") -> str:
    peers = "tick * 1000000000 + event_id"
    return with_readings(f"""
  SELECT device_id, tick + 1 AS tick, {sql_r4('m')} AS value, lo AS low, hi AS high, n, latest
  FROM (SELECT *, avg(value) OVER w AS m, min(value) OVER w AS lo, max(value) OVER w AS hi, CAST(count(value) OVER w AS DOUBLE) AS n,
               arg_max(value, {peers}) OVER w AS latest
        FROM readings WINDOW w AS (PARTITION BY device_id ORDER BY {order} {frame}))
  WHERE m > 20 AND {where} AND tick < {_MARK}""")


def _row_columns(events: DataFrame) -> DataFrame:
    a = F.col("aggregates")
    return events.select("device_id", "tick", r4("value").alias("value"), *[a[c].alias(c) for c in ("low", "high", "n", "latest")])


def _stream_row(spark, sf_dir, rule: Rule, name: str) -> DataFrame:
    st.configure(spark)
    return _row_columns(_run(stream_rules(RuleSet((rule,), digits=None), _stream(spark, sf_dir), Clock(ORIGIN_S)), name))


@query(_row_sql("tick", "RANGE BETWEEN 1439 PRECEDING AND CURRENT ROW", "tick >= 1440"))
def stream_sliding_rule(spark, sf_dir):
    return _stream_row(spark, sf_dir, SLIDING, "sliding-rule")


@query(_row_sql("tick, event_id", "ROWS BETWEEN 5 PRECEDING AND CURRENT ROW"))
def stream_last_n_rule(spark, sf_dir):
    return _stream_row(spark, sf_dir, LAST_N, "last-n-rule")


@query(_row_sql("tick", "RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"))
def stream_landmark_rule(spark, sf_dir):
    return _stream_row(spark, sf_dir, LANDMARK, "landmark-rule")


# thinning by the mode that each measure's profile declares

_LOSS = uniform_sql("device_id, measure_name, CAST(tick AS VARCHAR), CAST(event_id AS VARCHAR)", "loss")
_TRANSMIT_CTES = f"""
  profiled AS (
    SELECT *, CASE measure_name WHEN 'error' THEN 'ON_CHANGE' WHEN 'view' THEN 'ON_THRESHOLD' ELSE 'PERIODIC' END AS mode,
           {_LOSS} >= CASE measure_name WHEN 'error' THEN 0.1 WHEN 'view' THEN 0.2 ELSE 0.05 END AS ok FROM readings),
  numbered AS (
    SELECT *, row_number() OVER (PARTITION BY device_id ORDER BY tick, event_id) AS rn FROM profiled WHERE mode = 'ON_CHANGE'),
  fold AS (
    SELECT device_id, measure_name, event_id, tick, rn, mode, CASE WHEN ok THEN 'sent' ELSE 'lost' END AS status,
           CASE WHEN ok THEN value END AS last FROM numbered WHERE rn = 1
    UNION ALL
    SELECT n.device_id, n.measure_name, n.event_id, n.tick, n.rn, n.mode,
           CASE WHEN f.last IS NOT NULL AND abs(n.value - f.last) < 20 THEN 'suppressed' WHEN n.ok THEN 'sent' ELSE 'lost' END,
           CASE WHEN (f.last IS NULL OR abs(n.value - f.last) >= 20) AND n.ok THEN n.value ELSE f.last END
    FROM numbered n JOIN fold f ON n.device_id = f.device_id AND n.rn = f.rn + 1),
  crossed AS (
    SELECT *, coalesce(last_value(CASE WHEN ok THEN value >= 50 END IGNORE NULLS) OVER (
             PARTITION BY device_id ORDER BY tick, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS before
    FROM profiled WHERE mode = 'ON_THRESHOLD'),
  labelled AS (
    SELECT device_id, measure_name, event_id, tick, mode, status FROM fold
    UNION ALL
    SELECT device_id, measure_name, event_id, tick, mode,
           CASE WHEN (value >= 50) = before THEN 'suppressed' WHEN ok THEN 'sent' ELSE 'lost' END FROM crossed
    UNION ALL
    SELECT device_id, measure_name, event_id, tick, mode, CASE WHEN ok THEN 'sent' ELSE 'lost' END
    FROM profiled WHERE mode = 'PERIODIC' AND tick % 5 = 0)"""


def _transmit_sql(body: str) -> str:
    return with_readings(body, _TRANSMIT_CTES).replace("WITH ", "WITH RECURSIVE ", 1)


def _profiles(spark, sf_dir) -> DataFrame:
    """How each measure of the event table is sent."""
    by = lambda change, crossing, other: (F.when(F.col("event_type") == "error", change)
                                          .when(F.col("event_type") == "view", crossing).otherwise(other))
    return table(spark, sf_dir, "events").select("event_type").distinct().select(
        F.col("event_type").alias("measure_name"), by("ON_CHANGE", "ON_THRESHOLD", "PERIODIC").alias("mode"),
        F.lit(300_000.0).alias("interval_ms"), by(20.0, 50.0, None).alias("threshold"), by(0.1, 0.2, 0.05).alias("failure"))


@query(_transmit_sql("SELECT device_id, measure_name, event_id, tick, mode, status FROM labelled"))
def transmit_by_mode(spark, sf_dir):
    profiled = batch_readings(spark, sf_dir).join(_profiles(spark, sf_dir), "measure_name")
    return batch_transmit(profiled, 60_000, SEED).select("device_id", "measure_name", "event_id", "tick", "mode", "status")


def _stream_labelled(spark, sf_dir, name: str) -> DataFrame:
    st.configure(spark)
    profiled = _stream(spark, sf_dir).join(_profiles(spark, sf_dir), "measure_name")
    out = _run(st.transmit(profiled, 60_000, SEED), name)
    return out.where(F.col("tick") < last_tick(batch_readings(spark, sf_dir)) - DELAY_MINUTES)


@query(_transmit_sql(f"SELECT device_id, measure_name, event_id, tick, mode, status FROM labelled WHERE tick < {_MARK}"))
def stream_transmit(spark, sf_dir):
    return _stream_labelled(spark, sf_dir, "transmit").select("device_id", "measure_name", "event_id", "tick", "mode", "status")


@query(_transmit_sql(f"SELECT mode, status, count(*) AS n FROM labelled WHERE tick < {_MARK} GROUP BY mode, status"))
def stream_drop_counts(spark, sf_dir):
    return drop_counts(_stream_labelled(spark, sf_dir, "drop-counts"), ("mode",))


_PURGED_AT = "((tick + 5000) // 1000 + 1) * 1000"


@query(with_readings(f"""
  SELECT device_id, measure_name, event_id, tick, value, {_PURGED_AT} AS purged_at
  FROM readings WHERE {_PURGED_AT} < {_MARK}"""))
def stream_retention(spark, sf_dir):
    """What has left the store by the end of the table: purges every 1,000 ticks, kept for 5,000."""
    st.configure(spark)
    out = _run(purged(_stream(spark, sf_dir), ORIGIN_S, 60_000, spread=16), "retention")
    out = out.where(F.col("purged_at") < last_tick(batch_readings(spark, sf_dir)) - DELAY_MINUTES)
    return out.select("device_id", "measure_name", "event_id", "tick", "value", "purged_at")


@query(with_readings("SELECT * FROM judged", *judged_sql(f"WHERE tick // 1440 * 1440 + 1440 <= {_MARK}")))
def stream_conformance(spark, sf_dir):
    """Verdicts on all devices from summaries of the closed days, merged batch by batch."""
    bindings = _bindings(spark, sf_dir)
    bound = _stream(spark, sf_dir).join(bindings.drop("binding_idx"), ["device_id", "measure_name"])
    folder = shared_folder(spark, "conformance")
    q = keep_summaries(stretches(bound, DAY, ORIGIN_S), folder).trigger(availableNow=True).start()
    q.awaitTermination()
    return _flat(verdicts(kept_summaries(spark, folder), bindings, _declared(spark, sf_dir)))
