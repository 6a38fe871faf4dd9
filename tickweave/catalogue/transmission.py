"""Thinning queries over the event table."""

from pyspark.sql import functions as F

from tickweave.catalogue.base import READINGS_SQL, SEED, query, readings, table, uniform_sql, with_readings
from tickweave.functions.scalars import duration_ms, interval_ticks
from tickweave.operators.transmit import (
    crossing, crossing_status, deadband, deadband_status, drop_counts, lossy, periodic, survives,
    with_stale_flag,
)

USER = ("device_id",)
_LOSS_KEYS = "device_id, measure_name, CAST(tick AS VARCHAR), CAST(event_id AS VARCHAR)"
_U = uniform_sql(_LOSS_KEYS, "loss")


def _survive(p):
    return survives(p, SEED, ("device_id", "measure_name", "tick", "event_id"))


@query(with_readings("SELECT event_id, device_id, tick, value FROM readings WHERE tick % 5 = 0"))
def periodic_absolute(spark, sf_dir):
    return periodic(readings(spark, sf_dir), 5).select("event_id", "device_id", "tick", "value")


@query(with_readings("""
  SELECT event_id, device_id, tick, value FROM readings WHERE ((tick - 3) % 7 + 7) % 7 = 0"""))
def periodic_anchored(spark, sf_dir):
    return periodic(readings(spark, sf_dir), 7, start=3).select("event_id", "device_id", "tick", "value")


def _fold_sql(survive: str) -> str:
    """The dead-band as a recursion over each device's readings in order."""
    return f"""
  WITH RECURSIVE {READINGS_SQL},
  numbered AS (SELECT *, {survive} AS ok,
                      row_number() OVER (PARTITION BY device_id ORDER BY tick, event_id) AS rn FROM readings),
  fold AS (
    SELECT device_id, event_id, tick, value, rn,
           CASE WHEN ok THEN 'sent' ELSE 'lost' END AS status, CASE WHEN ok THEN value END AS last
    FROM numbered WHERE rn = 1
    UNION ALL
    SELECT n.device_id, n.event_id, n.tick, n.value, n.rn,
           CASE WHEN f.last IS NOT NULL AND abs(n.value - f.last) < 20 THEN 'suppressed'
                WHEN n.ok THEN 'sent' ELSE 'lost' END,
           CASE WHEN (f.last IS NULL OR abs(n.value - f.last) >= 20) AND n.ok THEN n.value ELSE f.last END
    FROM numbered n JOIN fold f ON n.device_id = f.device_id AND n.rn = f.rn + 1)"""


@query(_fold_sql("true") + " SELECT device_id, event_id, tick, value FROM fold WHERE status = 'sent'")
def deadband_kept(spark, sf_dir):
    return deadband(readings(spark, sf_dir), 20.0, keys=USER).select("device_id", "event_id", "tick", "value")


@query(_fold_sql(f"{_U} >= 0.2") + " SELECT status, count(*) AS n FROM fold GROUP BY status")
def deadband_drop_counts(spark, sf_dir):
    return drop_counts(deadband_status(readings(spark, sf_dir), 20.0, _survive(0.2), keys=USER))


@query(with_readings("""
  SELECT device_id, event_id, tick, value FROM (
    SELECT *, lag(value >= 50, 1, false) OVER (PARTITION BY device_id ORDER BY tick, event_id) AS before
    FROM readings) WHERE (value >= 50) <> before"""))
def crossing_kept(spark, sf_dir):
    return crossing(readings(spark, sf_dir), 50.0, keys=USER).select("device_id", "event_id", "tick", "value")


@query(with_readings(f"SELECT event_id, device_id, tick, value FROM readings WHERE {_U} >= 0.1"))
def lossy_kept(spark, sf_dir):
    return lossy(readings(spark, sf_dir), 0.1, SEED).select("event_id", "device_id", "tick", "value")


@query(with_readings(f"""
  SELECT device_id, event_id, tick, value FROM (
    SELECT *, lag(value >= 50, 1, false) OVER (PARTITION BY device_id ORDER BY tick, event_id) AS before
    FROM readings WHERE {_U} >= 0.1) WHERE (value >= 50) <> before"""))
def lossy_crossing(spark, sf_dir):
    out = crossing(readings(spark, sf_dir), 50.0, survive=_survive(0.1), keys=USER)
    return out.select("device_id", "event_id", "tick", "value")


@query(with_readings(f"""
  SELECT measure_name, CASE WHEN (value >= 50) = before THEN 'suppressed' WHEN ok THEN 'sent' ELSE 'lost' END AS status,
         count(*) AS n
  FROM (SELECT *, coalesce(last_value(CASE WHEN ok THEN value >= 50 END IGNORE NULLS) OVER (
                    PARTITION BY device_id, measure_name ORDER BY tick, event_id
                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS before
        FROM (SELECT *, {_U} >= 0.1 AS ok FROM readings)) GROUP BY ALL"""))
def crossing_drop_counts(spark, sf_dir):
    return drop_counts(crossing_status(readings(spark, sf_dir), 50.0, _survive(0.1)), ["measure_name"])


@query("""
  SELECT event_id, user_id,
         ts + to_seconds(event_id % 600) > ts + INTERVAL 5 MINUTE AS stale FROM events""")
def stale_flag(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("event_ts", F.col("ts").cast("timestamp"))
    delay = F.make_dt_interval(secs=(F.col("event_id") % 600).cast("decimal(18,6)"))
    e = e.withColumn("ingest_ts", F.col("event_ts") + delay)
    return with_stale_flag(e, "5 MINUTES").select("event_id", "user_id", "stale")


@query("""
  SELECT l_orderkey, l_linenumber, l_quantity * CASE l_linenumber % 6 WHEN 0 THEN 1 WHEN 1 THEN 1000 WHEN 2 THEN 60000
         WHEN 3 THEN 3600000 WHEN 4 THEN 86400000 ELSE 1000 END AS ms,
         greatest(1, CAST(floor(l_quantity * CASE l_linenumber % 6 WHEN 0 THEN 1 WHEN 1 THEN 1000 WHEN 2 THEN 60000
         WHEN 3 THEN 3600000 WHEN 4 THEN 86400000 ELSE 1000 END / 60000) AS BIGINT)) AS ticks
  FROM lineitem""")
def unit_conversion(spark, sf_dir):
    unit = F.get(F.array(*[F.lit(u) for u in ("MS", "SEC", "MIN", "HOURS", "days", "FORTNIGHT")]),
                 F.col("l_linenumber") % 6)
    ms = table(spark, sf_dir, "lineitem").withColumn("ms", duration_ms(F.col("l_quantity"), unit))
    return ms.select("l_orderkey", "l_linenumber", "ms", interval_ticks(F.col("ms"), 60_000).alias("ticks"))
