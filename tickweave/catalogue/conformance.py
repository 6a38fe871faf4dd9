"""Observed against declared statistics of the event table."""

from pyspark.sql import functions as F

from tickweave.catalogue.base import query, r4, readings, sql_r4, table, with_readings
from tickweave.operators.conformance import (
    conformance, mixture_stats, persistent_readings, summary, tier_rates, tier_tallies, totals,
    transition_log,
)

RANGE_MAX = 300.0

_DECLARED_SQL = """declared AS (
  SELECT device_class, measure_name, zone_id, tier, round(avg(value)) AS mean, round(coalesce(stddev_samp(value), 1)) AS std,
         round(CAST(count(*) AS DOUBLE) / sum(count(*)) OVER (PARTITION BY device_class, measure_name, zone_id), 2) AS prob
  FROM classed GROUP BY device_class, measure_name, zone_id, tier)"""
_CLASSED_SQL = """classed AS (
  SELECT r.*, c_mktsegment AS device_class FROM readings r JOIN customer ON CAST(device_id AS BIGINT) = c_custkey)"""
_MIX_SQL = """mixture AS (
  SELECT device_class, measure_name, zone_id, any_value(mu) AS mu, sqrt(sum(prob * (std * std + (mean - mu) * (mean - mu)))) AS sigma,
         100.0 * (1.0 - sum(prob * prob)) AS expected_rate
  FROM (SELECT *, sum(prob * mean) OVER (PARTITION BY device_class, measure_name, zone_id) AS mu FROM declared)
  GROUP BY device_class, measure_name, zone_id)"""
_CTES = (_CLASSED_SQL, _DECLARED_SQL, _MIX_SQL)


def _classed(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("device_id"),
                                                F.col("c_mktsegment").alias("device_class"))
    return readings(spark, sf_dir).join(c, "device_id")


def _declared(spark, sf_dir):
    """Tier declarations: the measured statistics, rounded to whole numbers and percent."""
    by = ["device_class", "measure_name", "zone_id"]
    counts = _classed(spark, sf_dir).groupBy(*by, "tier").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("value")).alias("mean"),
        F.round(F.coalesce(F.stddev_samp("value"), F.lit(1.0))).alias("std"))
    total = counts.groupBy(*by).agg(F.sum("n").alias("total"))
    return counts.join(total, by).select(
        *by, "tier", F.lit("NORMAL").alias("family"),
        F.create_map(F.lit("mean"), "mean", F.lit("std_dev"), "std").alias("params"),
        F.round(F.col("n") / F.col("total"), 2).alias("probability"))


def _bindings(spark, sf_dir):
    """Which user reports which event type, numbered by user."""
    return _classed(spark, sf_dir).select("device_id", "device_class", "measure_name", "zone_id").distinct().select(
        "*", F.lit(0.0).alias("range_min"), F.lit(RANGE_MAX).alias("range_max"),
        F.col("device_id").cast("bigint").alias("binding_idx"))


def _plain(spark, sf_dir):
    return readings(spark, sf_dir).drop("zone_id")


@query(with_readings(f"""
  SELECT device_class, measure_name, zone_id, {sql_r4('mu')} AS declared_mean, {sql_r4('sigma')} AS declared_std,
         {sql_r4('expected_rate')} AS expected_transition_rate FROM mixture""", *_CTES))
def mixture_statistics(spark, sf_dir):
    return mixture_stats(_declared(spark, sf_dir)).select(
        "device_class", "measure_name", "zone_id",
        *[r4(c).alias(c) for c in ("declared_mean", "declared_std", "expected_transition_rate")])


def judged_sql(devices: str) -> tuple[str, ...]:
    stats = f"""stats AS (
  SELECT device_id, device_class, measure_name, zone_id, count(*) AS n, avg(value) AS m, coalesce(stddev_samp(value), 0) AS s,
         count(*) FILTER (WHERE tier <> prev) AS moves, count(*) FILTER (WHERE value < 0 OR value > {RANGE_MAX}) AS outside,
         count(*) FILTER (WHERE tier = 'NORMAL') AS t_normal, count(*) FILTER (WHERE tier = 'ABOVE') AS t_above,
         count(*) FILTER (WHERE tier = 'BELOW') AS t_below
  FROM (SELECT *, lag(tier) OVER (PARTITION BY device_id, measure_name ORDER BY tick, event_id) AS prev FROM classed)
  {devices} GROUP BY device_id, device_class, measure_name, zone_id HAVING count(*) >= 5)"""
    tiers = """tiers_ok AS (
  SELECT s.device_id, s.measure_name, bool_and(abs(CAST(CASE tier WHEN 'NORMAL' THEN t_normal WHEN 'ABOVE' THEN t_above
                                       ELSE t_below END AS DOUBLE) / n - prob) <= 0.05) AS ok
  FROM stats s JOIN declared USING (device_class, measure_name, zone_id) GROUP BY s.device_id, s.measure_name)"""
    judged = f"""judged AS (
  SELECT device_id, device_class, measure_name, zone_id, n AS n_events, {sql_r4('m')} AS observed_mean, {sql_r4('mu')} AS declared_mean,
         abs(m - mu) <= CASE WHEN mu = 0 THEN 1 ELSE abs(mu) * 0.15 END AS mean_ok,
         {sql_r4('s')} AS observed_std, {sql_r4('sigma')} AS declared_std, abs(s - sigma) <= sigma * 0.2 AS std_ok,
         moves AS n_transitions, {sql_r4('100.0 * moves / n')} AS transition_rate,
         {sql_r4('expected_rate')} AS expected_transition_rate, abs(100.0 * moves / n - expected_rate) < 5 AS transition_ok,
         outside AS n_out_of_range, outside = 0 AS range_ok,
         abs(m - mu) <= CASE WHEN mu = 0 THEN 1 ELSE abs(mu) * 0.15 END AND abs(s - sigma) <= sigma * 0.2
           AND outside = 0 AND ok AS overall_pass
  FROM stats JOIN mixture USING (device_class, measure_name, zone_id) JOIN tiers_ok USING (device_id, measure_name))"""
    return (*_CTES, stats, tiers, judged)


FIRST = """WHERE (device_class, measure_name, zone_id, CAST(device_id AS BIGINT)) IN (
    SELECT (device_class, measure_name, zone_id, min(CAST(device_id AS BIGINT))) FROM classed
    GROUP BY device_class, measure_name, zone_id)"""


def _flat(df):
    return df.select(
        "device_id", "device_class", "measure_name", "zone_id", "n_events", r4("observed_mean").alias("observed_mean"),
        r4("declared_mean").alias("declared_mean"), "mean_ok", r4("observed_std").alias("observed_std"),
        r4("declared_std").alias("declared_std"), "std_ok", "n_transitions", r4("transition_rate").alias("transition_rate"),
        r4("expected_transition_rate").alias("expected_transition_rate"), "transition_ok", "n_out_of_range",
        "range_ok", "overall_pass")


def results(spark, sf_dir, devices="representative"):
    return conformance(_plain(spark, sf_dir), _bindings(spark, sf_dir), _declared(spark, sf_dir), devices)


@query(with_readings("SELECT * FROM judged", *judged_sql(FIRST)))
def conformance_representative(spark, sf_dir):
    return _flat(results(spark, sf_dir))


@query(with_readings("SELECT * FROM judged", *judged_sql("")))
def conformance_all_devices(spark, sf_dir):
    return _flat(results(spark, sf_dir, "all"))


@query(with_readings("""
  SELECT measure_name, zone_id, count(*) AS n, count(*) FILTER (WHERE overall_pass) AS n_pass,
         count(*) FILTER (WHERE NOT overall_pass) AS n_fail,
         100 * count(*) FILTER (WHERE overall_pass) // count(*) AS pass_percent
  FROM judged GROUP BY measure_name, zone_id""", *judged_sql("")))
def conformance_summary(spark, sf_dir):
    return summary(results(spark, sf_dir, "all"))


@query(with_readings("""
  SELECT count(*) FILTER (WHERE overall_pass) AS n_pass, count(*) FILTER (WHERE NOT overall_pass) AS n_fail,
         100 * count(*) FILTER (WHERE overall_pass) // greatest(count(*), 1) AS pass_percent
  FROM judged""", *judged_sql(FIRST)))
def conformance_totals(spark, sf_dir):
    return totals(results(spark, sf_dir))


@query(with_readings(f"""
  SELECT d.measure_name, d.zone_id, d.device_class, d.tier, total AS n_events, {sql_r4('coalesce(n, 0)::DOUBLE / total')} AS observed_prob,
         prob AS declared_prob, {sql_r4('abs(coalesce(n, 0)::DOUBLE / total - prob) * 100')} AS deviation_pp,
         abs(coalesce(n, 0)::DOUBLE / total - prob) <= 0.05 AS pass
  FROM declared d
  JOIN (SELECT device_class, measure_name, zone_id, count(*) AS total FROM classed GROUP BY ALL) t
    USING (device_class, measure_name, zone_id)
  LEFT JOIN (SELECT device_class, measure_name, zone_id, tier, count(*) AS n FROM classed GROUP BY ALL) c
    USING (device_class, measure_name, zone_id, tier)""", *_CTES))
def tier_rates_first_weeks(spark, sf_dir):
    out = tier_rates(_classed(spark, sf_dir), _declared(spark, sf_dir),
                     ["device_class", "measure_name", "zone_id"])
    return out.select("device_class", "measure_name", "zone_id", "tier", "n_events", r4("observed_prob").alias("observed_prob"),
                      "declared_prob", r4("deviation_pp").alias("deviation_pp"), "pass")


@query(with_readings("""
  SELECT device_id, measure_name, count(*) FILTER (WHERE tier = 'NORMAL') AS "NORMAL",
         count(*) FILTER (WHERE tier = 'ABOVE') AS "ABOVE", count(*) FILTER (WHERE tier = 'BELOW') AS "BELOW"
  FROM readings GROUP BY device_id, measure_name"""))
def tier_tallies_per_device(spark, sf_dir):
    return tier_tallies(readings(spark, sf_dir))


@query(with_readings("""
  SELECT device_id, measure_name, tick, event_id, before AS from_tier, tier AS to_tier
  FROM (SELECT *, lag(tier, 1, 'NORMAL') OVER (PARTITION BY device_id, measure_name ORDER BY tick, event_id) AS before
        FROM readings) WHERE tier <> before"""))
def transitions(spark, sf_dir):
    return transition_log(readings(spark, sf_dir))


@query(with_readings("""
  SELECT measure_name, count(*) AS n FROM readings WHERE event_id % 3 <> 0 GROUP BY measure_name"""))
def persistent_only(spark, sf_dir):
    derived = F.when(F.col("event_id") % 3 == 0, "alert")
    r = readings(spark, sf_dir).withColumn("triggered_by", derived)
    return persistent_readings(r).groupBy("measure_name").agg(F.count(F.lit(1)).alias("n"))
